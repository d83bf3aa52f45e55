"""Secret scans: fixed patterns, and credentials told apart by who uses them.

Fixed patterns give the base spans. Their values, and every other long token that looks
random, are candidates. For each candidate's digest the distinct repositories and owners
that use it are counted over the whole corpus: a credential that is live belongs to one
owner, an example from a manual is copied by many. Random-looking tokens of few owners
become further spans ("unlisted"), and base spans are marked as shared or owned.

In the documents table the owner is the source, and a repository is one source's
documents of one language.

Edge cases: a null text is empty; an empty one has no spans; a null source or language
counts as one owner or repository of its own; repeated rows each get their spans and
count once. Offsets count code points, ends are exclusive. Columns other than doc_id,
text, source and lang are never read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionlake.llm.arrays import slices
from mentionlake.staging import stage

KINDS = ("assign", "access", "hex")
UNLISTED = "unlisted"
# A digest used by more owners than this is a shared example.
OWNERS = 3
LEAST_LENGTH, LEAST_BITS = 20, 3.2

# The patterns of the contract
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
# A run shorter than 24 can't match, a longer one matches whole.
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST_LENGTH},}}")


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the base spans, by start, then kind."""
    found = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def bits(token: str) -> float:
    """Shannon entropy of the letters of a token, in bits per letter."""
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values())


def random_tokens(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, str]]:
    """(start, end, token) of tokens with digits, both cases and high entropy, off all base spans."""
    found, k = [], 0
    reach = [0]
    for _, _, end, _ in base:
        reach.append(max(reach[-1], end))
    starts = [s for s, *_ in base]
    for m in TOKEN.finditer(text):
        token = m[0]
        while k < len(starts) and starts[k] < m.end():
            k += 1
        if reach[k] > m.start():
            continue
        kinds = any(c.isdigit() for c in token), any(c.islower() for c in token), any(c.isupper() for c in token)
        if all(kinds) and bits(token) >= LEAST_BITS:
            found.append((m.start(), m.end(), token))
    return found


def digest(value: str) -> int:
    """64 bits of SHA-256: values themselves never leave their task."""
    return int.from_bytes(hashlib.sha256(value.encode()).digest()[:8], "little", signed=True)


_SHAPE = "doc_id long, owner string, repository string, row_key long, spans array<struct<start:long,kind:int,end:long,digest:long>>"


def candidates(docs: DataFrame) -> DataFrame:
    """One row per document: owner, repository and all spans, kind 3 being random tokens.

    ``row_key`` stands for the row's id and text; equal rows share it.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("digest", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = []
                for text in part.column("text").to_pylist():
                    text = text or ""
                    base = base_spans(text)
                    own = [{"start": s, "kind": k, "end": e, "digest": digest(v)} for s, k, e, v in base]
                    own += [{"start": s, "kind": 3, "end": e, "digest": digest(v)} for s, e, v in random_tokens(text, base)]
                    out.append(own)
                names = ["doc_id", "owner", "repository", "row_key"]
                yield pa.RecordBatch.from_arrays([*map(part.column, names), pa.array(out, kind)], [*names, "spans"])

    def column(name: str) -> Column:
        return F.col(name).cast("string") if name in docs.columns else F.lit(None).cast("string")

    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(column("source"), F.lit("")).alias("owner"),
        F.concat_ws("/", F.coalesce(column("source"), F.lit("")), F.coalesce(column("lang"), F.lit(""))).alias("repository"),
        F.xxhash64("doc_id", text).alias("row_key"), text.alias("text"),
    )
    return rows.mapInArrow(run, _SHAPE)


def ownership(found: DataFrame) -> DataFrame:
    """(digest, owners, repositories): in how many different ones a value occurs.

    Repeats are combined before each shuffle, so a value that a third of all documents
    copy is one row per repository.
    """
    uses = found.select("owner", "repository", F.explode("spans").alias("s")).select("s.digest", "owner", "repository")
    per_owner = uses.distinct().groupBy("digest", "owner").agg(F.count("*").alias("repositories"))
    return per_owner.groupBy("digest").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))


def with_ownership(found: DataFrame, owners: int = OWNERS) -> DataFrame:
    """``found`` with ``shared`` and ``own``: the places of spans by how many owners use the value."""
    counts = stage(ownership(found), "secret-owners")
    # Only random tokens and base values of few owners travel back, as places in their row.
    places = found.select("row_key", F.posexplode("spans").alias("at", "s")).select("row_key", "at", "s.digest").distinct()
    own = places.join(counts.filter(F.col("owners") <= owners), "digest").groupBy("row_key").agg(F.collect_set("at").alias("own"))
    return found.join(own, "row_key", "left").withColumn("own", F.coalesce("own", F.array().cast("array<int>")))


def scanned(docs: DataFrame, owners: int = OWNERS) -> DataFrame:
    """(doc_id, base, spans, n_live, n_shared): base spans, all spans with the unlisted ones,
    and how many base spans have few and many owners."""
    found = stage(candidates(docs), "secret-spans")
    rows = with_ownership(found, owners).withColumn(
        "marked", F.transform("spans", lambda s, i: s.withField("own", F.array_contains("own", i)))
    )
    base = F.filter("marked", lambda s: s["kind"] < 3)
    everything = F.array_sort(F.filter("marked", lambda s: (s["kind"] < 3) | s["own"]))
    return rows.select(
        "doc_id", base.alias("base"), everything.alias("spans"),
        F.size(F.filter(base, lambda s: s["own"])).cast("long").alias("n_live"),
        F.size(F.filter(base, lambda s: ~s["own"])).cast("long").alias("n_shared"),
    )


def written(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, UNLISTED)])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scanned(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return rows.select(
        "doc_id", *counts, F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"), "n_live", "n_shared"
    )
