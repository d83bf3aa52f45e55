"""Quality classifier: kernel ridge on document statistics by random Fourier features.

Every text becomes a few statistics of its letters, words and lines. A Gaussian kernel
over them is approximated by random Fourier features (Rahimi, Recht, NIPS 2007); each
partition sums its share of the normal equations, the shares are summed by row of the
matrix, and one small system is solved. Isotonic regression turns ridge scores into
probabilities.

Edge cases: a null text counts as empty; empty texts are scored like any other; repeated
rows are scored each; no labels, or labels of one class, give every text that class's
rate (0.5 without labels). Columns other than doc_id and text are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionlake.llm.arrays import distinct_pairs, lists, slices, split_words, text_bytes, windows
from mentionlake.llm.calibration import Calibration, fit
from mentionlake.llm.tables import documents, held_out, labels_of, texts_of
from mentionlake.staging import stage

FEATURES = 256
RIDGE = 1.0
THRESHOLD = 0.3

# Byte classes: 0 lower, 1 upper, 2 digit, 3 blank, 4 newline, 5 sentence marks, 6 other ASCII, 7 other
_CLASS = np.full(256, 7, np.int64)
_CLASS[:128] = 6
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[32, 9, 11, 12, 13]], _CLASS[10] = 3, 4
_CLASS[[ord(c) for c in ".,;:?'\"-"]] = 5
_NAMES = 19


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of ``_NAMES`` statistics per text."""
    data, offsets = text_bytes(texts)
    n = len(texts)
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(n), sizes)
    kinds = np.bincount(row * 8 + _CLASS[data], minlength=n * 8).reshape(n, 8).astype(float)
    rates = kinds / np.maximum(sizes, 1)[:, None]
    words = split_words(texts)
    counts, word_rows = words.counts, words.rows
    some = np.maximum(counts, 1)
    lengths = words.ends - words.starts
    mean = np.bincount(word_rows, lengths, n) / some
    spread = np.sqrt(np.maximum(np.bincount(word_rows, lengths.astype(float) ** 2, n) / some - mean**2, 0))
    longest = np.zeros(n)
    np.maximum.at(longest, word_rows, lengths)
    first, last = words.data[words.starts], words.data[words.ends - 1]
    capital = np.bincount(word_rows, (first >= 65) & (first <= 90), n) / some
    ended = np.bincount(word_rows, (_CLASS[last] == 5), n) / some
    marked = np.bincount(word_rows, (_CLASS[last] == 6), n) / some
    alone = np.bincount(word_rows, (_CLASS[first] == 6) & (lengths <= 3), n) / some
    used, _ = distinct_pairs(word_rows, words.hashes)
    variety = np.bincount(used, minlength=n) / some
    triples = windows(words.hashes, 3)
    inside = word_rows[: len(triples)] == word_rows[2:] if len(triples) else np.zeros(0, bool)
    triple_rows = word_rows[: len(triples)][inside]
    own, _ = distinct_pairs(triple_rows, triples[inside])
    fresh = (np.bincount(own, minlength=n) + 1) / (np.bincount(triple_rows, minlength=n) + 1)
    per_line = counts / (kinds[:, 4] + 1)
    return np.column_stack([
        np.log1p(counts), np.log1p(per_line), mean, np.log1p(spread), np.log1p(longest), capital, ended, marked,
        alone, variety, np.log1p(variety * some), fresh, np.sqrt(rates),
    ])[:, :_NAMES]


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) of (doc_id, text)."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                stats = statistics(part.column("text"))
                offsets = np.arange(len(stats) + 1) * stats.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), lists(stats.ravel(), offsets, pa.float64())], ["doc_id", "stats"]
                )

    return texts_of(docs).mapInArrow(measured, "doc_id long, stats array<double>")


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    turns: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    curve: Calibration

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -8, 8)
        waves = np.sqrt(2 / len(self.phases)) * np.cos(x @ self.turns + self.phases)
        return np.column_stack([waves, np.ones(len(x))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(self.curve(self.raw(stats)), 0, 1)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _scaling(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of every statistic over all of ``rows``."""
    values = [F.col("stats")[i] for i in range(_NAMES)]
    got = rows.agg(*[F.avg(v) for v in values], *[F.stddev_pop(v) for v in values]).first()
    mean = np.array([x or 0.0 for x in got[:_NAMES]])
    return mean, np.maximum(np.array([x or 0.0 for x in got[_NAMES:]]), 1e-3)


def _normal_equations(model: QualityModel, rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Z'Z and Z'y over all rows: summed in each partition, then by row of the matrix."""

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            z = model.features(_matrix(batch))
            both = z.T @ np.column_stack([z, batch.column("label").to_numpy(zero_copy_only=False)])
            total = both if total is None else total + both
        if total is not None:
            offsets = np.arange(len(total) + 1) * total.shape[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(total)), pa.int32()), lists(total.ravel(), offsets, pa.float64())], ["k", "v"]
            )

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, v in zip(batch.column("k").to_pylist(), batch.column("v")):
                v = v.values.to_numpy()
                sums[k] = sums[k] + v if k in sums else v
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))],
                ["k", "v"],
            )

    shape = "k int, v array<double>"
    found = rows.mapInArrow(share, shape).repartition(16, "k").mapInArrow(added, shape).collect()
    both = np.array([r.v for r in sorted(found, key=lambda r: r.k)])
    return both[:, :-1], both[:, -1]


def train(stats: DataFrame, labels: DataFrame, features: int = FEATURES, ridge: float = RIDGE) -> QualityModel:
    """A model of (doc_id, label) over (doc_id, stats), all labelled rows used."""
    rows = stage(stats.join(labels, "doc_id").select("stats", "label"), "quality-train")
    mean, scale = _scaling(rows)
    draw = np.random.default_rng(20)
    turns = draw.normal(size=(_NAMES, features)) / np.sqrt(_NAMES)
    phases = draw.uniform(0, 2 * np.pi, features)
    none = Calibration(0.0, 1.0, np.zeros(0), np.zeros(0), 0.5)
    model = QualityModel(mean, scale, turns, phases, np.zeros(features + 1), none)
    if rows.isEmpty():
        return model
    gram, target = _normal_equations(model, rows)
    damp = ridge * np.eye(len(gram))
    damp[-1, -1] = 1e-9
    model = QualityModel(mean, scale, turns, phases, np.linalg.solve(gram + damp, target), none)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(_matrix(batch))), batch.column("label")], ["raw", "label"])

    curve = fit(stage(rows.mapInArrow(scored, "raw double, label double"), "quality-raw"))
    return QualityModel(mean, scale, turns, phases, model.weights, curve)


def scores(stats: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score) of (doc_id, stats)."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(model.score(_matrix(batch)))], ["doc_id", "score"]
            )

    return stats.mapInArrow(scored, "doc_id long, score double")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = stage(with_statistics(documents(spark, sf_dir)), "quality-stats")
    labels = labels_of(spark, sf_dir, "quality").filter(~held_out())
    scored = scores(stats, train(stats, labels))
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that score at least ``threshold``.

    The model learns from the labelled among them; a row is then scored where it is
    read, so no text is shuffled.
    """
    model = train(stage(with_statistics(docs), "quality-stats"), labels)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                good = model.score(statistics(part.column("text"))) >= threshold
                yield part.filter(pa.array(good))

    return docs.mapInArrow(kept, docs.schema)
