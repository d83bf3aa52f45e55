"""Document fingerprints: digests of content-defined chunks.

A gear hash of the last 16 bytes (Xia et al., FastCDC, USENIX ATC 2016) decides where a
text is cut; up to the normal chunk size a rarer event is wanted than beyond it, which
keeps chunk sizes close together. Cuts depend on nearby bytes only, so an insertion
changes few chunks. A fingerprint is the set of (digest, length) of the chunks; likeness
is the length of common chunks over that of the smaller set.

Texts are dealt out by ranges of doc_id and sorted there, so almost every document has
the next one beside it; only the ends of the ranges are matched by a join.

Edge cases: a null text is empty; an empty text has an empty fingerprint, like another
empty one (1.0) and unlike any other (0.0); documents of equal id come in the order of
their texts; the last document is followed by the first, a single one by itself.
Columns other than doc_id and text are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mentionlake.llm.arrays import byte_hashes, seeded, slices
from mentionlake.llm.tables import documents, texts_of
from mentionlake.staging import stage

LEAST, NORMAL, MOST = 16, 48, 255
_BITS = 5
_GEAR = (seeded(256, 7) >> np.uint64(32)).astype(np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash of the 16 bytes that end at each place, by doubling of the window."""
    h = _GEAR[data]
    for width in (1, 2, 4, 8):
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
    return h


def cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, start, end) of all chunks; all texts take their next cut together."""
    h = gear(data)
    rare = np.append(np.flatnonzero(h >> np.uint32(31 - _BITS) == 0), len(data) + MOST)
    often = np.append(np.flatnonzero(h >> np.uint32(33 - _BITS) == 0), len(data) + MOST)
    row = np.flatnonzero(np.diff(offsets) > 0)
    at, end = offsets[row], offsets[row + 1]
    found = []
    while len(row):
        early = rare[np.searchsorted(rare, at + LEAST)] + 1
        late = often[np.searchsorted(often, at + NORMAL)] + 1
        cut = np.where(early <= np.minimum(at + NORMAL, end), early, np.minimum(np.minimum(late, at + MOST), end))
        found.append((row, at, cut))
        live = cut < end
        row, at, end = row[live], cut[live], end[live]
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    row, at, cut = map(np.concatenate, zip(*found))
    order = np.argsort(row, kind="stable")
    return row[order], at[order], cut[order]


def chunk_sets(texts: list[bytes]) -> list[dict[int, int]]:
    """Digest -> length of the chunks of each text."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    row, start, end = cuts(data, offsets)
    digests = (byte_hashes(data, start, end - start) >> np.uint64(32)).tolist()
    sizes, bounds = (end - start).tolist(), np.searchsorted(row, np.arange(len(texts) + 1)).tolist()
    return [dict(zip(digests[a:b], sizes[a:b])) for a, b in zip(bounds, bounds[1:])]


def likeness(a: dict[int, int], b: dict[int, int]) -> float:
    """Length of the common chunks over the length of the smaller set's chunks."""
    if not a or not b:
        return float(a == b)
    common = sum(size for digest, size in a.items() if digest in b)
    return min(1.0, common / min(sum(a.values()), sum(b.values())))


def packed(chunks: dict[int, int]) -> bytes:
    """Four bytes of digest and one of length per chunk, sorted; written out as hex digits
    at the very end, which halves what is staged."""
    return b"".join(sorted([((d << 8) | n).to_bytes(5, "big") for d, n in chunks.items()]))


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_COLUMNS = [
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.binary()), ("fingerprint", pa.binary()),
    ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
]
_SHAPE = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _results(ids: list, texts: list[str], following: list[str]) -> dict[str, list]:
    changed = [edited(t, f).encode() for t, f in zip(texts, following)]
    own, next_, other = (chunk_sets(x) for x in ([t.encode() for t in texts], [f.encode() for f in following], changed))
    return dict(zip([name for name, _ in _COLUMNS], [
        ids, [len(t) for t in texts], [hashlib.sha256(c).digest() for c in changed], list(map(packed, own)),
        list(map(packed, other)), list(map(likeness, own, other)), list(map(likeness, own, next_)),
    ]))


_ENDS = pa.schema([*_COLUMNS, ("range", pa.int32()), ("first", pa.bool_()), ("text", pa.string())])


def _in_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of all documents of a range but its last; then its first and last texts."""
    part = TaskContext.get().partitionId()
    first, held = None, None
    for batch in batches:
        for some in slices(batch):
            rows = list(zip(some.column("doc_id").to_pylist(), [t or "" for t in some.column("text").to_pylist()]))
            first = first or rows[0]
            rows = rows if held is None else [held, *rows]
            held = rows[-1]
            if len(rows) > 1:
                ids, texts = map(list, zip(*rows))
                made = _results(ids[:-1], texts[:-1], texts[1:])
                none = [None] * (len(rows) - 1)
                yield pa.RecordBatch.from_pydict({**made, "range": none, "first": none, "text": none}, schema=_ENDS)
    if held is not None:
        ends = [{"doc_id": i, "text": t, "range": part, "first": is_first} for (i, t), is_first in ((first, True), (held, False))]
        yield pa.RecordBatch.from_pylist(ends, schema=_ENDS)


def _of_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for some in slices(batch):
            rows = some.to_pydict()
            made = _results(rows["doc_id"], rows["text"], rows["following"])
            yield pa.RecordBatch.from_pydict(made, schema=pa.schema(_COLUMNS))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints and both likenesses of every row."""
    ranges = texts_of(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    made = stage(ranges.mapInArrow(_in_range, f"{_SHAPE}, range int, first boolean, text string"), "fingerprints")
    ends = made.filter("range IS NOT NULL")
    # one row per range: a short list, and without texts
    order = Window.orderBy("range")
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = ends.select("range").distinct().select(
        "range", F.coalesce(F.lead("range").over(order), F.min("range").over(everything)).alias("next")
    )
    heads = ends.filter("first").select(F.col("range").alias("next"), F.col("text").alias("following"))
    pairs = ends.filter("NOT first").select("range", "doc_id", "text").join(following, "range").join(heads, "next")
    rest = pairs.select("doc_id", "text", "following").mapInArrow(_of_pairs, _SHAPE)
    both = made.filter("range IS NULL").select(*[name for name, _ in _COLUMNS]).unionByName(rest)
    return both.select(*[F.lower(F.hex(name)).alias(name) if kind == pa.binary() else F.col(name) for name, kind in _COLUMNS])


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))
