"""Raw scores to probabilities: isotonic regression on a histogram of the labelled rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 4096


def pool(positives: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Pool-adjacent-violators: the non-decreasing rates closest to positives / totals."""
    blocks: list[list[float]] = []
    for p, n in zip(positives, totals):
        blocks.append([p, n, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            p2, n2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + p2, blocks[-1][1] + n2, blocks[-1][2] + k2]
    return np.concatenate([np.full(int(k), p / n) for p, n, k in blocks]) if blocks else np.zeros(0)


@dataclass(frozen=True)
class Calibration:
    """Knots of a rising curve; without knots every score is ``prior``."""

    low: float
    high: float
    x: np.ndarray
    y: np.ndarray
    prior: float

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        if not len(self.x):
            return np.full(len(raw), self.prior)
        # a thousandth keeps the order of raw scores that share a step
        place = np.clip((raw - self.low) / max(self.high - self.low, 1e-12), 0, 1)
        return 0.999 * np.interp(raw, self.x, self.y) + 0.001 * place


def fit(scored: DataFrame, smoothing: float = 0.5) -> Calibration:
    """From rows of (raw, label). Only the histogram, of at most ``BINS`` bins, is collected.

    ``smoothing`` pseudo-rows of the prior in each step keep small steps off 0 and 1.
    """
    bounds = scored.agg(F.min("raw"), F.max("raw"), F.avg("label"), F.count("*")).first()
    low, high, prior, rows = bounds
    if not rows or prior in (0.0, 1.0) or low == high:
        return Calibration(0.0, 1.0, np.zeros(0), np.zeros(0), 0.5 if prior is None else float(prior))
    place = F.least(F.floor((F.col("raw") - low) / (high - low) * BINS), F.lit(BINS - 1))
    found = scored.groupBy(place.alias("bin")).agg(
        F.avg("raw").alias("x"), F.sum("label").alias("p"), F.count("*").alias("n")
    ).orderBy("bin").collect()
    x = np.array([r.x for r in found])
    p, n = np.array([r.p for r in found]), np.array([float(r.n) for r in found])
    y = pool(p, n)
    # one knot per step, at its mean score
    step = np.concatenate([[0], np.cumsum(y[1:] != y[:-1])])
    weight = np.bincount(step, n)
    heights = (np.bincount(step, p) + smoothing * prior) / (weight + smoothing)
    return Calibration(float(low), float(high), np.bincount(step, x * n) / weight, np.maximum.accumulate(heights), float(prior))
