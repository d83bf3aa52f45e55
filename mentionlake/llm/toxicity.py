"""Toxicity: maximum-scoring word segments under learned log-odds.

From the labelled rows, the number of toxic and clean documents with each word gives its
log-odds under a Dirichlet prior proportional to its overall frequency, and a z-score
(Monroe, Colaresi, Quinn, 2008). Words that are clearly likelier in toxic documents score
their log-odds; all others share one slightly negative score, the log-odds of "any other
word". Ruzzo and Tompa's linear scan (ISMB 1999) then finds every maximal scoring segment
of a text. For scores that are log-likelihood ratios the best segment of n clean words
follows an extreme-value law with rate 1 (Karlin, Altschul, 1990), so a segment of score
S is expected n e^-S times by chance; that makes segments significant and texts of any
length comparable. Isotonic regression on the labelled rows turns the best one into a
probability.

All words with a clear z-score are kept, so the lexicon grows with the corpus. Up to
``SHIP`` words go to the tasks that read the texts; a larger lexicon stays in Spark and is
joined with the words of the texts.

Edge cases: a null text is empty; an empty text has no segment and is scored like a text
without any; repeated rows are scored each; without labels every score is 0.5, with
labels of one class it is that class's rate. Columns other than doc_id and text are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionlake.llm.arrays import distinct_pairs, lists, slices
from mentionlake.llm.calibration import Calibration, fit
from mentionlake.llm.decontaminate import words_of
from mentionlake.llm.tables import documents, held_out, labels_of, texts_of
from mentionlake.staging import stage

LEAST_DOCUMENTS = 3
Z = 3.0
SHIP = 200_000
# Weight of the prior, as a share of all counts: a word seen in toxic documents alone keeps
# a finite score and a small variance
PRIOR = 0.1
E_VALUE = 0.05
THRESHOLD = 0.5
# Different words counted in a task before they are passed on
_HELD = 1 << 20


def word_counts(labelled: DataFrame) -> DataFrame:
    """(word, toxic, clean): in how many documents of each class a word occurs.

    ``labelled`` holds text and label. Words are counted where they are read and combined
    before the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def merged(parts: list[np.ndarray]) -> np.ndarray:
            keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            unique, inverse = np.unique(keys, return_inverse=True)
            sums = np.column_stack([np.bincount(inverse, counts[:, k], len(unique)) for k in range(2)])
            return unique, sums

        def out(held: list) -> pa.RecordBatch:
            words, counts = merged(held)
            return pa.RecordBatch.from_arrays(
                [pa.array(words.view(np.int64)), *[pa.array(counts[:, k].astype(np.int64)) for k in range(2)]], ["word", "toxic", "clean"]
            )

        held, size = [], 0
        for batch in batches:
            for part in slices(batch):
                words = words_of(part.column("text"))
                rows, values = distinct_pairs(words.rows, words.hashes)
                toxic = (part.column("label").to_numpy() >= 0.5)[rows].astype(np.int64)
                held.append((values, np.column_stack([toxic, 1 - toxic])))
                size += len(values)
                if size > 2 * _HELD:
                    held = [merged(held)]
                    size = len(held[0][0])
                    if size > _HELD:
                        yield out(held)
                        held, size = [], 0
        if held:
            yield out(held)

    counts = labelled.select("text", "label").mapInArrow(run, "word long, toxic long, clean long")
    return counts.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def lexicon(counts: DataFrame) -> tuple[DataFrame, float]:
    """(word, score) of the kept words, and the score of any other word."""
    counts = stage(counts, "toxic-counts")
    n1, n0 = counts.agg(F.sum("toxic"), F.sum("clean")).first()
    if not n1 or not n0:
        return counts.limit(0).select("word", F.lit(0.0).alias("score")), -1.0
    n = n1 + n0
    prior = PRIOR * (F.col("toxic") + F.col("clean"))
    y1, y0 = F.col("toxic") + prior, F.col("clean") + prior
    odds = F.log(y1 / (n1 + PRIOR * n - y1)) - F.log(y0 / (n0 + PRIOR * n - y0))
    scored = counts.withColumn("score", odds).withColumn("z", odds / F.sqrt(1 / y1 + 1 / y0))
    kept = stage(
        scored.filter((F.col("z") >= Z) & (F.col("toxic") >= LEAST_DOCUMENTS)).select("word", "score", "toxic", "clean"), "toxic-lexicon"
    )
    toxic, clean = kept.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum("clean"), F.lit(0))).first()
    other = np.log((n1 - toxic + 1) / (n1 + 1)) - np.log((n0 - clean + 1) / (n0 + 1))
    return kept.select("word", "score"), float(min(other, -1e-3))


def segments(before: list[float], after: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments, as (first, last, score), of scores whose positive
    items have these running sums just before and after them. Linear time: each
    candidate remembers the nearest earlier one that starts lower."""
    stack: list[list] = []  # first, last, sum before, sum after, index of the nearest lower one
    for k, (left, right) in enumerate(zip(before, after)):
        first = k
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= right:
                stack.append([first, k, left, right, j])
                break
            first, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, right - left) for a, b, left, right, _ in stack]


def _scan(places: np.ndarray, value: np.ndarray, n: int, other: float) -> tuple[float, str]:
    """The best segment's score, and all significant segments, of a text of ``n`` words with
    kept ones at ``places``, in order."""
    after = np.cumsum(value) + other * (places - np.arange(len(places)))
    runs = segments((after - value).tolist(), after.tolist())
    return max(s for _, _, s in runs), ",".join(f"{places[a]}:{places[b] + 1}" for a, b, s in runs if n * np.exp(-s) <= E_VALUE)


def _passage_rows(ids: pa.Array, counts: np.ndarray, best: np.ndarray, found: list[str]) -> pa.RecordBatch:
    raw = best - np.log(counts + 1)
    return pa.RecordBatch.from_arrays([ids, pa.array(raw), pa.array(best), pa.array(found, pa.string())], ["doc_id", "raw", "best", "passages"])


_PASSAGES = "doc_id long, raw double, best double, passages string"


def passages(docs: DataFrame, kept: DataFrame, other: float, ship: int = SHIP) -> DataFrame:
    """(doc_id, raw, best, passages): the calibrated best score of each row, its best
    segment's score, and start:end of all significant segments, in words, ends exclusive."""
    if kept.count() > ship:
        return _joined_passages(docs, kept, other)
    rows = kept.collect()
    words = np.array([r.word for r in rows], np.int64).view(np.uint64)
    order = np.argsort(words)
    words, scores = words[order], np.array([r.score for r in rows])[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                split = words_of(part.column("text"))
                at = np.searchsorted(words, split.hashes)
                at[at == len(words)] = 0
                hit = np.flatnonzero(words[at] == split.hashes) if len(words) else np.zeros(0, np.int64)
                value, row = scores[at[hit]], split.rows[hit]
                bounds = np.searchsorted(row, np.arange(part.num_rows + 1))
                best, found = np.zeros(part.num_rows), [""] * part.num_rows
                for i in np.flatnonzero(np.diff(bounds)).tolist():
                    own = slice(bounds[i], bounds[i + 1])
                    best[i], found[i] = _scan(hit[own] - split.offsets[i], value[own], split.counts[i], other)
                yield _passage_rows(part.column("doc_id"), split.counts, best, found)

    return texts_of(docs).mapInArrow(run, _PASSAGES)


def _joined_passages(docs: DataFrame, kept: DataFrame, other: float) -> DataFrame:
    """As ``passages``, for a lexicon of any size: the different words of each text, with
    their places, meet it in a join."""

    def taken_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                split = words_of(part.column("text"))
                rows = split.rows
                order = np.lexsort((split.hashes, rows))
                row, word, place = rows[order], split.hashes[order], (np.arange(len(rows)) - split.offsets[:-1][rows])[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (word[1:] != word[:-1])
                starts = np.flatnonzero(new)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row_key").take(pa.array(row[starts])), pa.array(word[starts].view(np.int64)),
                     lists(place, np.append(starts, len(row)), pa.int64())], ["row_key", "word", "places"],
                )

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                counts = words_of(part.column("text")).counts
                best, found = np.zeros(part.num_rows), [""] * part.num_rows
                for i, hits in enumerate(part.column("hits")):
                    if hits.is_valid:
                        places = [np.array(h["places"], np.int64) for h in hits.as_py()]
                        value = np.repeat([h["score"] for h in hits.as_py()], [len(p) for p in places])
                        places = np.concatenate(places)
                        order = np.argsort(places)
                        best[i], found[i] = _scan(places[order], value[order], counts[i], other)
                yield _passage_rows(part.column("doc_id"), counts, best, found)

    keyed = texts_of(docs).withColumn("row_key", F.xxhash64("doc_id", "text"))
    each = keyed.select("row_key", "text").mapInArrow(taken_apart, "row_key long, word long, places array<long>")
    # a set, as repeated rows share their key
    hits = each.join(kept, "word").groupBy("row_key").agg(F.collect_set(F.struct("score", "places")).alias("hits"))
    return keyed.join(hits, "row_key", "left").select("doc_id", "text", "hits").mapInArrow(scanned, _PASSAGES)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score, passages) of every row, learned from (doc_id, label)."""
    # labels grow with the documents: one plan at every size, and never a broadcast
    model = lexicon(word_counts(texts_of(docs).join(labels.hint("merge"), "doc_id")))
    raw = stage(passages(docs, *model), "toxic-raw")
    curve: Calibration = fit(stage(raw.join(labels, "doc_id").select("raw", "label"), "toxic-train"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.clip(curve(batch.column("raw").to_numpy()), 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), batch.column("passages")], ["doc_id", "score", "passages"])

    return raw.select("doc_id", "raw", "passages").mapInArrow(run, "doc_id long, score double, passages string")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = labels_of(spark, sf_dir, "toxic").filter(~held_out())
    return scored(documents(spark, sf_dir), labels).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "passages"
    )
