"""Whitening of embeddings: pivoted Cholesky of the centred scatter, one-sided Jacobi on its factor.

Entries become whole numbers, so counts and sums are exact. Tasks multiply what is already
centred, x - S/n, and their partial scatters are summed entry by entry in Spark; only one
number per pair of dimensions reaches the driver, however many rows there are. There the
scatter is factored with pivoting, which shows its rank, and Jacobi rotations make the
columns of the triangular factor orthogonal: their squared norms are the eigenvalues,
their directions the components. No product of the factor with itself is ever formed, so
small eigenvalues keep their relative accuracy.

Edge cases: rows whose vector is null or empty, or holds null or non-finite entries, are
dropped. Vectors of several lengths have no common covariance: those of the commonest
length are the table (of equally common ones the longest), others are dropped. Repeated
rows each count; a null vec_id stays. Components are as many as the rank of the scatter,
at most ``COMPONENTS``; equal vectors, a single one and an empty table have none and
give no rows. Entries beyond 64-bit whole numbers take the nearest one; a deviation
beyond them is null. Columns other than vec_id and embedding are never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 32

_LIMIT = 2.0**62


def whole_numbers(vectors: pa.Array, dims: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat whole-numbered entries, the length of each vector, and which vectors count (of
    length ``dims`` if given). The entries are those of vectors that count."""
    lengths = vectors.value_lengths().fill_null(0).to_numpy()
    flat = vectors.flatten()
    values = flat.fill_null(np.nan).to_numpy(zero_copy_only=False)
    sums = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    ends = np.cumsum(lengths)
    good = (sums[ends] == sums[ends - lengths]) & (lengths > 0)
    if dims is not None:
        good &= lengths == dims
    scaled = np.floor(SCALE * values[np.repeat(good, lengths)]) + 0.0
    out = np.clip(scaled, -(2.0**63), np.nextafter(2.0**63, 0)).astype(np.int64)
    small = np.abs(scaled) < _LIMIT
    out[small] += SHIFT
    return out, lengths, good


@dataclass
class Whitening:
    """A fitted whitening. ``components`` has one column per component, ``eigenvalues`` falls."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    @property
    def dims(self) -> int:
        return len(self.sums)

    def differences(self, rows: np.ndarray) -> np.ndarray:
        """n * x - S, exact: whole numbers of 64 bits, or of any size where those overflow."""
        if self.dims and self.n * max(np.abs(rows.astype(float)).max(initial=0), 1.0) + max(map(abs, self.sums)) >= _LIMIT:
            return rows.astype(object) * self.n - np.array(self.sums, object)
        return rows * self.n - np.array(self.sums, np.int64)

    def centred(self, rows: np.ndarray) -> np.ndarray:
        return self.differences(rows).astype(np.float64) / self.n

    def whitened(self, rows: np.ndarray) -> np.ndarray:
        return self.centred(rows) @ (self.components / np.sqrt(self.eigenvalues))

    def deviations(self, rows: np.ndarray) -> pa.Array:
        d = self.differences(rows)
        rough = (d.astype(np.float64) ** 2).sum(1)
        if d.dtype != object and (rough < _LIMIT).all():
            return pa.array((d * d).sum(1), pa.int64())
        exact = (d.astype(object) ** 2).sum(1)
        return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L with L @ L.T = a, its rows in a's order, its columns as many as a's numerical rank."""
    rest, columns = a.copy(), []
    floor = len(a) * np.finfo(float).eps * max(a.diagonal().max(initial=0), 0)
    for _ in range(len(a)):
        pivot = int(rest.diagonal().argmax())
        if rest[pivot, pivot] <= floor:
            break
        column = rest[:, pivot] / np.sqrt(rest[pivot, pivot])
        rest = rest - np.outer(column, column)
        rest[pivot, :] = rest[:, pivot] = 0
        columns.append(column)
    return np.stack(columns, axis=1) if columns else np.zeros((len(a), 0))


def jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors of factor @ factor.T by one-sided rotations.

    A round rotates disjoint pairs of columns at once; the rounds of a sweep are those of
    a round-robin tournament, so that every pair meets once.
    """
    u = factor.copy()
    r = u.shape[1]
    players = list(range(r)) + ([-1] if r % 2 else [])
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(len(players) - 1):
            pairs = [(a, b) for a, b in zip(players[: len(players) // 2], reversed(players)) if a >= 0 and b >= 0]
            players = [players[0], players[-1], *players[1:-1]]
            if not pairs:
                continue
            i, j = np.array(pairs).T
            x, y = u[:, i], u[:, j]
            a, b, c = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            size = np.sqrt(a * b)
            worst = max(worst, float((np.abs(c) / np.where(size > 0, size, 1)).max()))
            turn = np.abs(c) > 1e-300
            zeta = (b - a) / np.where(turn, 2 * c, 1)
            t = np.where(turn, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta)), 0.0)
            cos = 1 / np.hypot(1, t)
            u[:, i], u[:, j] = cos * (x - t * y), cos * (t * x + y)
        if worst < 1e-15 * max(len(u), 8):
            break
    norms = np.sqrt((u * u).sum(0))
    order = np.argsort(-norms, kind="stable")
    return norms[order] ** 2, u[:, order] / norms[order]


def _vectors(frame: DataFrame, vector: str, *others: str) -> DataFrame:
    return frame.select(*others, F.col(vector).cast("array<double>").alias("vector"))


def _column_sums(frame: DataFrame) -> DataFrame:
    """(dims, at, n, total) of each batch; ``total`` in text, as sums may need over 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, lengths, good = whole_numbers(batch.column("vector"))
            lengths = lengths[good]
            starts = np.cumsum(lengths) - lengths
            for dims in np.unique(lengths).tolist():
                first = starts[lengths == dims]
                rows = flat[first[:, None] + np.arange(dims)]
                wide = len(rows) * np.abs(rows.astype(float)).max() >= _LIMIT
                total = (rows.astype(object) if wide else rows).sum(0)
                yield pa.RecordBatch.from_arrays([
                    pa.array([dims] * dims, pa.int32()), pa.array(range(dims), pa.int32()),
                    pa.array([len(rows)] * dims, pa.int64()), pa.array([str(t) for t in total]),
                ], ["dims", "at", "n", "total"])

    sums = frame.mapInArrow(run, "dims int, at int, n long, total string")
    return sums.groupBy("dims", "at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))


def _products(frame: DataFrame, model: Whitening, rows_of: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """The sum over all rows of the products of all pairs of their ``width`` values and a one
    at the end: partial sums of each task, added up in Spark."""
    upper = np.triu_indices(width + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width + 1))
        for batch in batches:
            flat, _, _ = whole_numbers(batch.column("vector"), model.dims)
            values = rows_of(flat.reshape(-1, model.dims))
            values = np.column_stack([values, np.ones(len(values))])
            total += values.T @ values
        yield pa.RecordBatch.from_arrays(
            [pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), pa.array(total[upper])], ["i", "j", "value"]
        )

    summed = frame.mapInArrow(run, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))
    out = np.zeros((width + 1, width + 1))
    for i, j, value in summed.collect():  # one number per pair of dimensions
        out[i, j] = out[j, i] = value
    return out


def fit(frame: DataFrame, vector: str = "embedding", most: int = COMPONENTS) -> Whitening:
    """The whitening of all vectors of ``frame``."""
    vectors = _vectors(frame, vector)
    sums = _column_sums(vectors)
    commonest = sums.filter("at = 0").orderBy(F.desc("n"), F.desc("dims")).select("dims").first()
    empty = Whitening(0, [], np.zeros((0, 0)), np.zeros(0), 0.0)
    if commonest is None:
        return empty
    table = sums.filter(F.col("dims") == commonest[0]).orderBy("at").collect()  # one row per dimension
    model = Whitening(table[0]["n"], [int(r["total"]) for r in table], empty.components, empty.eigenvalues, 0.0)
    scatter = _products(vectors, model, model.centred, model.dims)[:-1, :-1]
    values, components = jacobi(pivoted_cholesky(scatter))
    model.components, model.eigenvalues = components[:, :most], values[:most] / model.n
    model.trace = float(scatter.trace()) / model.n
    return model


def identity_error(frame: DataFrame, model: Whitening, vector: str = "embedding") -> float:
    """The largest entry of the whitened vectors' covariance minus the identity."""
    k = len(model.eigenvalues)
    if not k:
        return 0.0
    moments = _products(_vectors(frame, vector), model, model.whitened, k) / model.n
    covariance = moments[:-1, :-1] - np.outer(moments[-1, :-1], moments[-1, :-1])
    return float(np.abs(covariance - np.eye(k)).max())


def transform(frame: DataFrame, model: Whitening, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, deviation, whitened) of every row that counts, ``whitened`` with one entry per component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, _, good = whole_numbers(batch.column("vector"), model.dims)
            rows = flat.reshape(-1, max(model.dims, 1))
            white = model.whitened(rows) if model.dims else np.zeros((0, 0))
            yield pa.RecordBatch.from_arrays([
                batch.column(key).filter(pa.array(good)), model.deviations(rows),
                pa.ListArray.from_arrays(pa.array(np.arange(len(white) + 1) * white.shape[1], pa.int32()), pa.array(white.ravel(), pa.float64())),
            ], [key, "deviation", "whitened"])

    vectors = _vectors(frame, vector, key)
    return vectors.mapInArrow(run, f"`{key}` {vectors.schema[key].dataType.simpleString()}, deviation long, whitened array<double>")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    model = fit(vectors)
    error = identity_error(vectors, model)
    share = F.array(*[F.lit(float(e / model.trace)) for e in model.eigenvalues]).cast("array<double>")
    return (
        transform(vectors, model)
        .select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
        .select(
            "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
            F.get(share, "at").alias("explained"), F.lit(error).alias("identity_error"),
        )
    )
