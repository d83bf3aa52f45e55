"""Benchmark decontamination: SimHash of item-sized windows, then exact similarity.

Words are runs of letters and digits, lower-cased. An item has fingerprints, the SimHashes
of some of its windows. Two are its first and its last L words, L being the largest window
size below its length. The others are shorter and lie in a row, so close that wherever
words are changed and the plain similarity still holds, one window has none of them and
its fingerprint is as it was. Window sizes form a short
geometric ladder. Every window of every document is
fingerprinted for each size by prefix sums of the words' votes. Window and item
fingerprints within a Hamming radius are found by a multi-index (Norouzi, Punjani,
Fleet, CVPR 2012): of four 16-bit blocks, one differs by at most a quarter of the radius,
so looking up all values near a window's block in that block's postings, lists of the item
fingerprints with each value, misses no fingerprint within the radius; only items found
there are compared with the window.
A candidate is then verified exactly: the shingles of the item against those of the
item-sized window of the document around it. Its similarity is the plain one or, if that
is higher, the one with weights that fall with the number of different items that share a
shingle; so near copies count as such in groups of similar items too.

The benchmark is a query set against all documents. It is taken in blocks of bounded
number of items and words, so a task never holds more than one block whatever the
benchmark's size; an item longer than that is a block of its own.

Edge cases: a null or empty document leaks nothing; items without words are never found;
an item of fewer than five words has its whole sequence as its only shingle; an item is a
distinct (item_id, text), so a repeated row counts once, texts that share an id are
different items reported under that id, and a null id is reported as null; equal texts
are all reported; a document repeated in the input is reported for each row. Columns
other than doc_id, text, item_id are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionlake.llm.arrays import Words, mix, slices, split_words, windows
from mentionlake.llm.tables import documents, texts_of
from mentionlake.staging import stage

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 11
# Items per pass over the documents
BLOCK = 20_000
# Words of the items of a block, about
BLOCK_WORDS = 4_000_000
# Windows looked up, and pairs of fingerprints compared, at a time
WINDOWS, PAIRS = 4096, 1 << 20

# ASCII signs and blanks separate words; every other byte belongs to one.
SEPARATORS = np.zeros(256, bool)
SEPARATORS[:128] = True
SEPARATORS[48:58] = SEPARATORS[65:91] = SEPARATORS[97:123] = False


def words_of(texts: pa.Array) -> Words:
    return split_words(pc.utf8_lower(texts), separators=SEPARATORS)


def ladder(longest: int, ratio: float = 1.3) -> np.ndarray:
    """Window sizes from 1 up, growing by ``ratio``, one word at least."""
    sizes = [1]
    while sizes[-1] < longest:
        sizes.append(max(sizes[-1] + 1, int(sizes[-1] * ratio)))
    return np.array(sizes)


def votes(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 per bit and word, as running sums with a leading zero.

    Sums wrap at 16 bits; differences over a window of less than 2^15 words do not.
    """
    total = np.zeros((64, len(hashes) + 1), np.int16)
    spread = mix(hashes)
    for b in range(64):
        bit = ((spread >> np.uint64(b)) & np.uint64(1)).astype(np.int16)
        np.cumsum(bit * np.int16(2) - np.int16(1), out=total[b, 1:], dtype=np.int16)
    return total


def prints(total: np.ndarray, size: int) -> np.ndarray:
    """The SimHash of ``size`` words from each start; a tie sets the bit."""
    ones = (total[:, size:] - total[:, : total.shape[1] - size]) >= 0
    marks = np.zeros((8, ones.shape[1]), np.uint8)
    for b in range(64):
        marks[b // 8] |= ones[b].view(np.uint8) << np.uint8(b % 8)
    return np.ascontiguousarray(marks.T).view(np.uint64).ravel()


def item_windows(length: int, similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """(size, first word) of the windows of an item that are fingerprinted.

    If f of its k shingles may be replaced at the similarity, a change at an end costs a
    shingle a word, one inside ``SHINGLE`` and more: so at most f words are changed, in at
    most f / SHINGLE places inside, and one of the stretches between is as long as
    ``intact``. Windows of a row less than that apart can't all miss it.
    """
    sizes = ladder(length)
    long = int(sizes[sizes <= max(length - 1, 1)][-1])
    found = {(long, 0), (long, length - long)}
    foreign = int(max(length - SHINGLE + 1, 1) * (1 - similarity) / (1 + similarity) + 1e-9)
    intact = -(-(length - foreign) // (foreign // SHINGLE + 1))
    size = int(sizes[sizes <= max(intact * 2 // 3, 1)][-1]) if foreign >= SHINGLE else int(sizes[sizes <= intact][-1])
    found.update((size, min(at, length - size)) for at in range(0, length - size + intact - size + 1, intact - size + 1))
    return sorted(found)


@dataclass(frozen=True)
class Items:
    """A block of benchmark items with their weighted shingles; ``owners``, ``sizes``,
    ``shifts`` and ``prints`` are those of all their fingerprints."""

    ids: np.ndarray
    lengths: np.ndarray
    owners: np.ndarray
    sizes: np.ndarray
    shifts: np.ndarray
    prints: np.ndarray
    shingles: list[np.ndarray]
    weights: list[np.ndarray]


def _shingles_of(hashes: np.ndarray) -> np.ndarray:
    if len(hashes) >= SHINGLE:
        return np.unique(windows(hashes, SHINGLE))
    return windows(hashes, len(hashes)) if len(hashes) else hashes


def item_shingles(bench: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(item_key, item_id, length, sizes, shifts, prints, shingles) of every item with words.

    ``item_key`` stands for the item's id and text; repeated rows are one item.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = words_of(part.column("text"))
                total = votes(words.hashes)
                rows = []
                for i, (key, item) in enumerate(zip(part.column("item_key").to_pylist(), part.column("item_id").to_pylist())):
                    lo, hi = int(words.offsets[i]), int(words.offsets[i + 1])
                    if hi == lo:
                        continue
                    sizes, shifts = zip(*item_windows(hi - lo, similarity))
                    marks = {size: prints(total[:, lo : hi + 1], size).view(np.int64) for size in set(sizes)}
                    rows.append({"item_key": key, "item_id": item, "length": hi - lo, "sizes": list(sizes), "shifts": list(shifts),
                                 "prints": [int(marks[size][at]) for size, at in zip(sizes, shifts)],
                                 "shingles": _shingles_of(words.hashes[lo:hi]).view(np.int64).tolist()})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([("item_key", pa.int64()), ("item_id", pa.int64()), ("length", pa.int64()),
                        *[(name, pa.list_(pa.int64())) for name in ("sizes", "shifts", "prints", "shingles")]])
    table = bench.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    return table.select(F.xxhash64("item_id", "text").alias("item_key"), "item_id", "text").mapInArrow(
        made,
        "item_key long, item_id long, length long, sizes array<long>, shifts array<long>, prints array<long>, shingles array<long>",
    )


def weighted(items: DataFrame) -> DataFrame:
    """Adds ``weights``: 1 / (1 + log2 of the number of different items that share the
    shingle); items with the same shingles are not different."""
    each = items.select("item_key", F.posexplode("shingles").alias("at", "shingle"))
    different = items.groupBy("shingles").agg(F.lit(1)).select(F.explode("shingles").alias("shingle"))
    shared = different.groupBy("shingle").agg(F.count("*").alias("n"))
    weights = each.join(shared, "shingle").groupBy("item_key").agg(
        F.array_sort(F.collect_list(F.struct("at", (1 / (1 + F.log2("n"))).alias("w")))).alias("w")
    ).select("item_key", F.col("w.w").alias("weights"))
    return items.join(weights, "item_key")


class Postings:
    """Which of some fingerprints share a near block with a window."""

    def __init__(self, marks: np.ndarray, flips: np.ndarray):
        self.flips = flips.astype(np.uint16)
        self.lists, self.starts = [], []
        self.near = np.zeros((4, 1 << 16), bool)
        for b, block in enumerate(np.ascontiguousarray(marks)[:, None].view(np.uint16).T):
            self.lists.append(np.argsort(block, kind="stable"))
            self.starts.append(np.concatenate([[0], np.cumsum(np.bincount(block, minlength=1 << 16))]))
            for f in self.flips:
                self.near[b, block ^ f] = True

    def any(self, blocks: np.ndarray) -> np.ndarray:
        """Whether each row of four blocks is near any fingerprint's."""
        hit = self.near[0][blocks[:, 0]]
        for b in range(1, 4):
            hit |= self.near[b][blocks[:, b]]
        return hit

    def pairs(self, blocks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, fingerprint) that share a near block; those that share several come again."""
        for b in range(4):
            rows = np.flatnonzero(self.near[b][blocks[:, b]])
            values = blocks[rows, b][:, None] ^ self.flips[None, :]
            first, sizes = self.starts[b][values], self.starts[b][values.astype(np.int64) + 1]
            sizes = (sizes - first).ravel()
            held = np.flatnonzero(sizes)
            first, sizes = first.ravel()[held], sizes[held]
            # in runs of a bounded number of pairs, or one list
            ends = np.cumsum(sizes)
            cuts = np.unique(np.searchsorted(ends, np.arange(0, ends[-1] if len(ends) else 0, PAIRS)))
            for lo, hi in zip(cuts, [*cuts[1:], len(held)]):
                some = sizes[lo:hi]
                inner = np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some)
                yield rows[np.repeat(held[lo:hi] // len(self.flips), some)], self.lists[b][np.repeat(first[lo:hi], some) + inner]


class Index:
    """Finds the items whose window appears in texts, for one block of items."""

    def __init__(self, items: Items, radius: int, similarity: float):
        self.items, self.radius, self.similarity = items, radius, similarity
        flips = [0, *(1 << b for b in range(16))] if radius >= 4 else [0]
        if radius >= 8:
            flips += [(1 << a) | (1 << b) for a in range(16) for b in range(a)]
        if radius >= 12:
            raise ValueError("four blocks serve radii below 12")
        flips = np.array(flips)
        self.shingles = np.unique(np.concatenate(items.shingles))
        # the fewest shingles that can reach the similarity, by their weights or their number
        self.need = np.array([
            min(np.searchsorted(np.cumsum(-np.sort(-w)), similarity * w.sum() - 1e-9) + 1, int(np.ceil(similarity * len(w) - 1e-9)))
            for w in items.weights
        ])
        self.compared = 0  # pairs of fingerprints so far
        self.sizes = {}
        for size in np.unique(items.sizes).tolist():
            some = items.sizes == size
            own, marks, shifts = items.owners[some], items.prints[some], items.shifts[some]
            self.sizes[size] = own, marks, shifts, Postings(marks, flips)

    def find(self, words: Words) -> list[tuple[int, int, int, float]]:
        """(text, item, first word, similarity): the best place of each item in each text."""
        total, offsets = votes(words.hashes), words.offsets
        best: dict[tuple[int, int], tuple[float, int]] = {}
        rows = words.rows
        # how many shingles up to each place belong to any item
        known = np.concatenate([[0], np.cumsum(np.isin(windows(words.hashes, SHINGLE), self.shingles))])
        for size, (own, targets, shifts, postings) in self.sizes.items():
            if len(rows) < size:
                continue
            marks = prints(total, size)
            inside = np.arange(len(marks)) + size <= offsets[rows[: len(marks)] + 1]
            blocks = marks[:, None].view(np.uint16)
            hit = np.flatnonzero(postings.any(blocks) & inside)
            # the fewest known shingles that any item of this size could do with, around the window
            around, last = int(self.items.lengths[own].max()), len(known) - 1
            near_known = known[np.minimum(hit + around, last)] - known[np.maximum(hit - around, 0)]
            hit = hit[near_known >= self.need[own][self.items.lengths[own] >= SHINGLE].min(initial=around)] if size >= SHINGLE else hit
            for k in range(0, len(hit), WINDOWS):
                some = hit[k : k + WINDOWS]
                close = []
                for at, which in postings.pairs(blocks[some]):
                    self.compared += len(at)
                    there = np.bitwise_count(marks[some[at]] ^ targets[which]) <= self.radius
                    close.append(at[there] * len(targets) + which[there])
                at, which = np.divmod(np.unique(np.concatenate(close)) if close else np.zeros(0, np.int64), len(targets))
                starts = some[at] - shifts[which]
                full = self._plausible(known, starts, own[which])
                at, which = at[full], which[full]
                row_of = rows[some[at]]
                begin = some[at] - shifts[which] - offsets[row_of]
                for row, start, item in sorted(set(zip(row_of.tolist(), begin.tolist(), own[which].tolist()))):
                    score = self._similarity(words, row, start, item)
                    old = best.get((row, item), (0.0, 0))
                    if score >= self.similarity and score > old[0]:
                        best[row, item] = score, max(start, 0)
        return [(row, item, at, score) for (row, item), (score, at) in best.items()]

    def _plausible(self, known: np.ndarray, starts: np.ndarray, items: np.ndarray) -> np.ndarray:
        """False where even if all known shingles of the window were the item's, they were too few.

        Distinct shingles of the item are never more than places in the window they stand at.
        """
        lengths = self.items.lengths[items]
        last = len(known) - 1
        first, end = np.clip(starts, 0, last), np.clip(starts + lengths - SHINGLE + 1, 0, last)
        return (lengths < SHINGLE) | (known[np.maximum(end, first)] - known[first] >= self.need[items])

    def _similarity(self, words: Words, row: int, start: int, item: int) -> float:
        """The higher one of the plain and the weighted Jaccard of the item and the item-sized
        window; foreign shingles weigh 1."""
        lo, hi = int(words.offsets[row]), int(words.offsets[row + 1])
        length = int(self.items.lengths[item])
        first = max(lo, lo + start)
        there = _shingles_of(words.hashes[first : min(first + length, hi)])
        here, weights = self.items.shingles[item], self.items.weights[item]
        common = np.isin(here, there)
        shared, n = float(weights[common].sum()), int(common.sum())
        return max(shared / (float(weights.sum()) + len(there) - n), n / (len(here) + len(there) - n))


def _blocks(items: DataFrame, size: int) -> Iterator[Items]:
    """The items in blocks of about ``size`` and ``BLOCK_WORDS`` at most, each collected on its own."""
    keyed = stage(items, "items")
    n, words = keyed.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    parts = max(1, -(-n // size), -(-words // BLOCK_WORDS))
    for part in range(parts):
        rows = keyed.filter(F.pmod(F.xxhash64("item_key"), F.lit(parts)) == part).collect()
        if rows:
            yield Items(
                np.array([r.item_id for r in rows], object), np.array([r.length for r in rows]),
                np.repeat(np.arange(len(rows)), [len(r.sizes) for r in rows]),
                *[np.concatenate([np.array(r[name], np.int64) for r in rows]) for name in ("sizes", "shifts")],
                np.concatenate([np.array(r.prints, np.int64) for r in rows]).view(np.uint64),
                [np.array(r.shingles, np.int64).view(np.uint64) for r in rows], [np.array(r.weights) for r in rows],
            )


def leaks(docs: DataFrame, bench: DataFrame, radius: int = RADIUS, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, first_word, similarity): the best place of each item found in a document."""
    shape = "doc_id long, item_id long, first_word long, similarity double"
    found = None
    for items in _blocks(weighted(item_shingles(bench, similarity)), block):

        def search(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            index = Index(items, radius, similarity)
            for batch in batches:
                for part in slices(batch, size=1 << 18):
                    hits = index.find(words_of(part.column("text")))
                    if hits:
                        row, item, at, score = zip(*hits)
                        yield pa.RecordBatch.from_arrays([
                            part.column("doc_id").take(pa.array(row)), pa.array(items.ids[list(item)], pa.int64()),
                            pa.array(at, pa.int64()), pa.array(score, pa.float64()),
                        ], ["doc_id", "item_id", "first_word", "similarity"])

        one = texts_of(docs).mapInArrow(search, shape)
        found = one if found is None else found.unionByName(one)
    return docs.sparkSession.createDataFrame([], shape) if found is None else found


def without_leaks(docs: DataFrame, bench: DataFrame, radius: int = RADIUS, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs``, all columns, in which no item is found; filtered where they are read."""
    for items in _blocks(weighted(item_shingles(bench, similarity)), block):

        def clean(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            index = Index(items, radius, similarity)
            for batch in batches:
                for part in slices(batch, size=1 << 18):
                    keep = np.ones(part.num_rows, bool)
                    keep[[h[0] for h in index.find(words_of(part.column("text")))]] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), benchmark(spark, sf_dir))
