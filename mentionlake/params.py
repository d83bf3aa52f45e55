"""Tunable values of the job, in one immutable object."""

from __future__ import annotations

import os
from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    hamming_threshold: int = 3
    similarity_threshold: float = 0.82
    top_k: int = 5
    dim: int = 312
    ttl_seconds: int = 86400
    content_cut: int = 500
    encode_batch: int = 32

    @classmethod
    def from_env(cls) -> "Params":
        env = os.environ
        return cls(
            hamming_threshold=int(env.get("DEDUP_HAMMING_THRESHOLD", cls.hamming_threshold)),
            similarity_threshold=float(env.get("SIMILARITY_THRESHOLD", cls.similarity_threshold)),
            top_k=int(env.get("CLUSTER_TOP_K", cls.top_k)),
            dim=int(env.get("EMBEDDING_DIM", cls.dim)),
            ttl_seconds=int(env.get("DEDUP_TTL_SECONDS", cls.ttl_seconds)),
        )
