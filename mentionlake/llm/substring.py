"""Removal of repeated passages by recompression.

Rounds of recompression (Jez, JACM 2016) replace maximal runs of one symbol, then pairs
of a left and a right symbol, by new symbols. A symbol's name is a hash of what it stands
for and its side a bit of its name, so all tasks name equal runs and pairs alike without a
dictionary. With each symbol goes the stretch of words that decides it: its own and the
neighbours that the rounds looked at. A symbol decided by words inside a window stands in
every equal window at the same place.

Each window of 20 words looks up the least of the symbols decided inside it, or without one
its least word, and takes the half window before or after that place, whichever lies
inside, as its anchor. Equal windows have equal anchors, a shared anchor is ten words long,
and of the many places only a few are anchors. One shuffle of (anchor, text digest) finds the
anchors that different texts share; one more finds the documents that hold them. Only
windows at shared anchors are then compared, by 96 bits of their words, and the first
document of each is known. Windows repeated inside one document, and documents whose
whole word sequence stands in an earlier one, are settled where they are read.

Edge cases: a null text has no words; fewer than 20 words lose nothing; equal rows of one
doc_id are the same document and get the same result; rows that share a doc_id but not
their words are compared with smaller ids and themselves only; a null doc_id sorts before
all others. Columns other than doc_id and text are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionlake.llm.arrays import SPACES, Words, mix, slices, split_words, windows
from mentionlake.llm.tables import documents, texts_of
from mentionlake.staging import stage

WINDOW = 20
LEVELS = 2
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_FAR = 1 << 60
_X, _Y = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def _runs(name, at_word, lo, hi, row, level):
    """Maximal runs of one symbol as one symbol, decided by the symbols on both sides too."""
    new = np.ones(len(name), bool)
    new[1:] = (name[1:] != name[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    length = np.diff(np.append(at, len(name))).astype(np.uint64)
    own_lo, own_hi = np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)
    last = np.append(at[1:], len(name)) - 1
    # only the symbol next to a run tells where it ends, not that one's own run
    row = row[at]
    before, after = np.flatnonzero(row[1:] == row[:-1]) + 1, np.flatnonzero(row[1:] == row[:-1])
    new_lo, new_hi = np.full(len(at), -_FAR), np.full(len(at), _FAR)
    new_lo[before], new_hi[after] = lo[at[before] - 1], hi[last[after] + 1]
    new_lo[after], new_hi[before] = np.minimum(new_lo[after], lo[last[after] + 1]), np.maximum(new_hi[before], hi[at[before] - 1])
    name = np.where(length == 1, name[at], mix(name[at] ^ mix(length * _X + np.uint64(level))))
    return name, at_word[at], np.minimum(own_lo, new_lo), np.maximum(own_hi, new_hi), row


def _pairs(name, at_word, lo, hi, row, level):
    """Left symbols with a right symbol behind them as one symbol; the others are decided by
    the neighbour that might have made a pair."""
    right = (mix(name + np.uint64(level) * _Y) >> np.uint64(63)).astype(bool)
    joined = row[1:] == row[:-1]
    merge = np.zeros(len(name), bool)
    merge[:-1] = joined & ~right[:-1] & right[1:]
    second = np.concatenate([[False], merge[:-1]])
    alone_left, alone_right = ~right & ~merge, right & ~second
    new_lo, new_hi = lo.copy(), hi.copy()
    there = np.append(joined, False)
    i = np.flatnonzero(alone_left & there | merge)
    new_lo[i], new_hi[i] = np.minimum(lo[i], lo[i + 1]), np.maximum(hi[i], hi[i + 1])
    new_hi[alone_left & ~there] = _FAR
    here = np.concatenate([[False], joined])
    i = np.flatnonzero(alone_right & here)
    new_lo[i], new_hi[i] = np.minimum(lo[i], lo[i - 1]), np.maximum(hi[i], hi[i - 1])
    new_lo[alone_right & ~here] = -_FAR
    i = np.flatnonzero(merge)
    name = name.copy()
    name[i] = mix(name[i] * _X + name[i + 1] * _Y + np.uint64(level))
    return name[~second], at_word[~second], new_lo[~second], new_hi[~second], row[~second]


def anchors(words: Words, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(first word, anchor) of every window inside one text, by place."""
    rows, n = words.rows, len(words.hashes)
    starts = np.flatnonzero(np.arange(n) + window <= words.offsets[rows + 1]) if n else np.zeros(0, np.int64)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        name, at_word, lo, row = words.hashes, np.arange(n), np.arange(n), rows
        hi = lo + 1
        for level in range(1, LEVELS + 1):
            name, at_word, lo, hi, row = _pairs(*_runs(name, at_word, lo, hi, row, level), level)
        small = hi - lo <= window
        key, at_word, lo, hi = mix(name[small] ^ _Y), at_word[small], lo[small], hi[small]
        best, where = np.full(n, _NONE), np.full(n, n)
        for shift in range(window + 1):
            place = hi - window + shift
            live = (place <= lo) & (place >= 0)
            np.minimum.at(best, place[live], key[live])
        for shift in range(window + 1):  # the first place of the least symbol
            place = hi - window + shift
            live = np.flatnonzero((place <= lo) & (place >= 0))
            live = live[best[place[live]] == key[live]]
            np.minimum.at(where, place[live], at_word[live])
        where = where[starts]
        missing = np.flatnonzero(where == n)
        for k in range(0, len(missing), 1 << 14):
            some = missing[k : k + (1 << 14)]
            where[some] = starts[some] + mix(words.hashes[starts[some][:, None] + np.arange(window)] ^ _X).argmin(1)
        half = window // 2
        halves = windows(words.hashes, half, 3)
        late = where - starts >= half
        return starts, mix(halves[np.where(late, where - half, where)] + late.astype(np.uint64))


def window_hashes(words: Words, starts: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each window; the second has 32 bits."""
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return windows(words.hashes, window, 1)[starts], windows(words.hashes, window, 2)[starts] >> np.uint64(32)


def _per_text(words: Words, starts: np.ndarray) -> np.ndarray:
    """Offsets into ``starts`` of each text."""
    return np.searchsorted(starts, words.offsets)


def sequence_names(words: Words) -> np.ndarray:
    """A digest of the whole word sequence of each text."""
    with np.errstate(over="ignore"):
        place = np.arange(len(words.hashes)) - np.repeat(words.offsets[:-1], words.counts)
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(words.hashes ^ mix(place.astype(np.uint64) * _X)))])
        return mix((total[words.offsets[1:]] - total[words.offsets[:-1]]) ^ mix(words.counts.astype(np.uint64)))


def first_places(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """True for the first of equal windows of one text."""
    order = np.lexsort((np.arange(len(h1)), h2, h1))
    first = np.ones(len(h1), bool)
    a, b = h1[order], h2[order]
    first[order[1:]] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return first


def kept_text(words: Words, i: int, removed: np.ndarray, window: int = WINDOW) -> tuple[int, bytes]:
    """(number of removed words, the others joined by blanks) of text ``i`` without the
    windows that start at ``removed`` places in it."""
    lo, n = int(words.offsets[i]), int(words.counts[i])
    change = np.bincount(removed, minlength=n + 1) - np.bincount(removed + window, minlength=n + 1)
    gone = np.cumsum(change)[:n] > 0
    left = lo + np.flatnonzero(~gone)
    data = words.data
    return int(gone.sum()), b" ".join([data[a:b].tobytes() for a, b in zip(words.starts[left].tolist(), words.ends[left].tolist())])


def local_results(docs: DataFrame) -> DataFrame:
    """(doc_id, sequence, n_words, n_removed, sha): what each row is left with if no other
    document counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = split_words(part.column("text"))
                starts = np.flatnonzero(np.arange(len(words.hashes)) + WINDOW <= words.offsets[words.rows + 1])
                h1, h2 = window_hashes(words, starts)
                bounds = _per_text(words, starts)
                removed, sha = [], []
                plain = _plain_joined(words)
                for i, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())):
                    again = ~first_places(h1[a:b], h2[a:b]) if b - a > 1 else np.zeros(0, bool)
                    if again.any():
                        gone, text = kept_text(words, i, np.flatnonzero(again))
                    else:
                        gone, text = 0, plain[i]
                    removed.append(gone)
                    sha.append(hashlib.sha256(text).digest())
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array(sequence_names(words).view(np.int64)), pa.array(words.counts, pa.int64()),
                    pa.array(removed, pa.int64()), pa.array(sha, pa.binary()),
                ], ["doc_id", "sequence", "n_words", "n_removed", "sha"])

    return docs.mapInArrow(run, "doc_id long, sequence long, n_words long, n_removed long, sha binary")


def _plain_joined(words: Words) -> list[bytes]:
    """All words of each text joined by single blanks, made at once."""
    size = words.ends - words.starts
    keep = ~SPACES[words.data]
    out = np.full(int(keep.sum()) + len(size), 32, np.uint8)
    begin = np.cumsum(size + 1) - size - 1
    letters = np.ones(len(out), bool)
    letters[begin + size] = False
    out[letters] = words.data[keep]
    flat = out.tobytes()
    first = np.append(begin, len(out))[words.offsets]
    return [flat[a : max(b - 1, a)] for a, b in zip(first.tolist(), first[1:].tolist())]


def _anchor_rows(docs: DataFrame, with_ids: bool) -> DataFrame:
    """Distinct anchors: with the least and greatest text digest of each slice's texts that
    hold them, or with the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = split_words(part.column("text"))
                starts, keys = anchors(words)
                rows = words.rows[starts]
                order = np.lexsort((rows, keys))
                keys, rows = keys[order], rows[order]
                new = np.ones(len(keys), bool)
                new[1:] = keys[1:] != keys[:-1]
                if with_ids:
                    new[1:] |= rows[1:] != rows[:-1]
                    at = np.flatnonzero(new)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[at].view(np.int64)), part.column("doc_id").take(pa.array(rows[at]))], ["anchor", "doc_id"]
                    )
                elif len(keys):
                    at = np.flatnonzero(new)
                    texts = sequence_names(words).view(np.int64)[rows]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(keys[at].view(np.int64)), pa.array(np.minimum.reduceat(texts, at)), pa.array(np.maximum.reduceat(texts, at)),
                    ], ["anchor", "least", "most"])

    return docs.mapInArrow(run, "anchor long, doc_id long" if with_ids else "anchor long, least long, most long")


def shared_anchors(docs: DataFrame) -> DataFrame:
    """(anchor) of the anchors that different word sequences hold."""
    ends = _anchor_rows(docs, False).groupBy("anchor").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    return ends.filter("least <> most").select("anchor")


def _packed(docs: DataFrame) -> DataFrame:
    """Texts compressed for the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part in slices(batch):
                packed = [pack.compress((t or "").encode()) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(packed, pa.binary())], ["doc_id", "packed"])

    return docs.mapInArrow(run, "doc_id long, packed binary")


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Parts of a batch with their words; few rows at a time, as sizes are not known before."""
    unpack = zstandard.ZstdDecompressor()
    for k in range(0, batch.num_rows, 64):
        part = batch.slice(k, 64)
        yield part, split_words(pa.array([unpack.decompress(p).decode() for p in part.column("packed").to_pylist()], pa.string()))


def _window_rows(held: DataFrame) -> DataFrame:
    """(h1, h2, doc_id, sequence, start): windows at the shared ``anchors`` of each text, each
    at its first place in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words in _unpacked(batch):
                starts, keys = anchors(words)
                h1, h2 = window_hashes(words, starts)
                bounds, names = _per_text(words, starts), sequence_names(words).view(np.int64)
                for i, shared in enumerate(part.column("anchors")):
                    a, b = bounds[i], bounds[i + 1]
                    own = np.isin(keys[a:b], shared.values.to_numpy().view(np.uint64)) & first_places(h1[a:b], h2[a:b])
                    at = a + np.flatnonzero(own)
                    n = len(at)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(h1[at].view(np.int64)), pa.array(h2[at].astype(np.int64)), pa.array([part.column("doc_id")[i].as_py()] * n, pa.int64()),
                        pa.array(np.full(n, names[i])), pa.array((starts[at] - words.offsets[i]).astype(np.int32)),
                    ], ["h1", "h2", "doc_id", "sequence", "start"])

    return held.mapInArrow(run, "h1 long, h2 long, doc_id long, sequence long, start int")


def _final(held: DataFrame) -> DataFrame:
    """(doc_id, sequence, n_removed, sha) of texts with ``removed`` window starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words in _unpacked(batch):
                starts = np.flatnonzero(np.arange(len(words.hashes)) + WINDOW <= words.offsets[words.rows + 1])
                h1, h2 = window_hashes(words, starts)
                bounds, names = _per_text(words, starts), sequence_names(words).view(np.int64)
                out = []
                for i, (removed, wanted) in enumerate(zip(part.column("removed"), part.column("sequence").to_pylist())):
                    a, b = bounds[i], bounds[i + 1]
                    if names[i] != wanted:  # another text with the same doc_id
                        continue
                    again = np.flatnonzero(~first_places(h1[a:b], h2[a:b]))
                    gone, text = kept_text(words, i, np.union1d(again, removed.values.to_numpy()))
                    out.append((part.column("doc_id")[i].as_py(), wanted, gone, hashlib.sha256(text).digest()))
                if out:
                    ids, sequences, gone, sha = zip(*out)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids, pa.int64()), pa.array(sequences, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.binary())],
                        ["doc_id", "sequence", "n_removed", "sha"],
                    )

    return held.mapInArrow(run, "doc_id long, sequence long, n_removed long, sha binary")


_LOWEST = -(1 << 63)


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row."""
    docs = texts_of(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(_LOWEST)))
    local = stage(local_results(docs), "repeat-local")
    first = local.groupBy("sequence").agg(F.min("doc_id").alias("first_doc"))
    rows = stage(local.join(first, "sequence").withColumn("copy", F.col("doc_id") > F.col("first_doc")), "repeat-rows")

    shared = stage(shared_anchors(docs), "repeat-anchors")
    holders = _anchor_rows(docs, True).join(shared, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))
    # whole copies are settled: their first document holds the same windows
    fresh = rows.filter("NOT copy").select("doc_id").distinct()
    holders = stage(holders.join(fresh, "doc_id", "left_semi"), "repeat-holders")
    held = stage(_packed(docs).join(holders, "doc_id"), "repeat-texts")

    # made anew for both uses below: cheaper than to keep them, texts at hand are few
    found = _window_rows(held)
    least = found.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most")
    late = found.join(least.drop("most"), ["h1", "h2"]).filter("doc_id > least")
    removed = late.groupBy("doc_id", "sequence").agg(F.collect_set("start").alias("removed"))
    final = _final(held.select("doc_id", "packed").join(stage(removed, "repeat-removed"), "doc_id"))
    final = stage(final, "repeat-final").dropDuplicates(["doc_id", "sequence"])

    whole = F.col("copy") & (F.col("n_words") >= WINDOW)
    nothing = F.unhex(F.lit(hashlib.sha256(b"").hexdigest()))
    merged = rows.join(
        final.select("doc_id", "sequence", F.col("n_removed").alias("more"), F.col("sha").alias("more_sha")), ["doc_id", "sequence"], "left"
    )
    return merged.select(
        F.when(F.col("doc_id") != _LOWEST, F.col("doc_id")).alias("doc_id"), "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("more", "n_removed")).alias("n_removed"),
        F.lower(F.hex(F.when(whole, nothing).otherwise(F.coalesce("more_sha", "sha")))).alias("kept_sha256"),
    )


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir))
