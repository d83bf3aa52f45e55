"""The two classifiers, the calibration, and the registered queries."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mentionlake.llm import calibration, quality, toxicity
from mentionlake.llm.catalog import QUERIES
from mentionlake.llm.tables import held_out, labels_of

FOLDER = "/root/testdata/sf0.01"


def test_pool_is_the_best_rising_fit():
    draw = np.random.default_rng(4)
    p, n = draw.integers(0, 5, 6).astype(float), np.full(6, 5.0)
    got = calibration.pool(p, n)
    assert (np.diff(got) >= 0).all()
    grid = np.linspace(0, 1, 11)
    best = min(sum(n * (p / n - np.array(y)) ** 2) for y in itertools.combinations_with_replacement(grid, 6))
    assert sum(n * (p / n - got) ** 2) <= best + 1e-9


def test_segments_match_brute_force():
    draw = random.Random(6)
    for _ in range(200):
        scores = [draw.choice([-3, -1, 1, 2, 4]) for _ in range(draw.randrange(1, 25))]
        if not any(s > 0 for s in scores):
            continue
        total = list(itertools.accumulate(scores, initial=0))
        places = [i for i, s in enumerate(scores) if s > 0]
        runs = toxicity.segments([total[i] for i in places], [total[i + 1] for i in places])
        best = max(total[j] - total[i] for i in range(len(total)) for j in range(i, len(total)))
        assert max(s for *_, s in runs) == best
        ends = [(places[a], places[b] + 1) for a, b, _ in runs]
        assert all(x[1] <= y[0] for x, y in zip(ends, ends[1:]))  # apart and in order
        assert all(total[j] - total[i] == s for (i, j), (*_, s) in zip(ends, runs))


@pytest.mark.parametrize("name", ["op10_quality_classifier", "op6_toxicity"])
def test_no_labels_and_one_class(spark, docs, no_docs, rows_of, name):
    run = {
        "op10_quality_classifier": lambda d, l: quality.scores(quality.with_statistics(d), quality.train(quality.with_statistics(d), l)),
        "op6_toxicity": toxicity.scored,
    }[name]
    none = spark.createDataFrame([], "doc_id long, label double")
    rows = run(docs, none).collect()
    assert len(rows) == len(rows_of) and {r.score for r in rows} == {0.5}
    ones = spark.createDataFrame([(i, 1.0) for i in range(20)], "doc_id long, label double")
    assert {r.score for r in run(docs, ones).collect()} == {1.0}
    assert run(no_docs, ones).count() == 0


def test_clear_words_stay_however_large_the_corpus(spark):
    counts = spark.createDataFrame([(1, 50, 0), (2, 10**7, 10**7), (3, 2, 0)], "word long, toxic long, clean long")
    kept, other = toxicity.lexicon(counts)
    assert [r.word for r in kept.collect()] == [1] and other < 0


def test_joined_lexicon_finds_the_same(spark, docs):
    labels = labels_of(spark, "/root/testdata/sf0.001", "toxic")
    some = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    counts = toxicity.word_counts(some.join(labels, "doc_id"))
    kept, other = counts.filter("pmod(word, 7) = 0").select("word", (F.pmod("word", F.lit(5)) + 2.5).alias("score")), -1.0
    everything = some.unionByName(some.limit(5)).unionByName(docs.select("doc_id", "text"))
    shipped, joined = (
        sorted(((r.doc_id, round(r.raw, 9), round(r.best, 9), r.passages) for r in toxicity.passages(everything, kept, other, ship).collect()), key=repr)
        for ship in (toxicity.SHIP, 0)
    )
    assert shipped == joined and any(r[3] for r in shipped)


def test_statistics_of_odd_texts(docs):
    rows = quality.with_statistics(docs).collect()
    assert len(rows) == docs.count() and all(np.isfinite(r.stats).all() and len(r.stats) == 19 for r in rows)


@pytest.mark.parametrize("name, kind, threshold, least", [
    ("op10_quality_classifier", "quality", 0.3, 0.9), ("op6_toxicity", "toxic", 0.5, 0.9),
])
def test_held_out_accuracy(spark, name, kind, threshold, least):
    rows = QUERIES[name](spark, FOLDER)
    assert rows.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert rows.filter((F.col("held_out") != held_out()) | ~F.col("score").between(0, 1)).isEmpty()
    assert rows.filter((F.col("score") >= threshold).cast("int") != F.col("predicted")).isEmpty()
    judged = rows.filter("held_out").join(labels_of(spark, FOLDER, kind), "doc_id")
    assert judged.agg(F.avg((F.col("predicted") == F.col("label")).cast("double"))).first()[0] >= least


def test_good_documents_stay(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = labels_of(spark, FOLDER, "quality")
    left = quality.keep_good(docs, labels)
    assert left.columns == docs.columns
    both = labels.join(left.select("doc_id", F.lit(1).alias("kept")), "doc_id", "left").groupBy("label").agg(F.avg(F.coalesce("kept", F.lit(0)))).collect()
    rates = {r[0]: r[1] for r in both}
    assert rates[1.0] > 0.97 and rates[0.0] < 0.3
