import corpus_pipeline
from mentionlake.llm.decontaminate import leaks
from mentionlake.llm.near import REGISTERS, band_rows, near_duplicates
from mentionlake.llm.pii import found_spans

FOLDER = "/root/testdata/sf0.001"


def test_near_duplicates_from_four_fifths_on(spark):
    """Pairs of which one inner run was changed, 0.75 to 0.9 alike: one stays from 0.8 on."""
    assert (1 - 0.8083 ** band_rows(80)) ** (REGISTERS // band_rows(80)) < 1e-6 and band_rows(85) == 5
    rows, left = [], set()
    for k in range(60):
        words = [f"p{k}w{i}" for i in range(104)]
        run = 2 + k % 9
        other = [*words[:50], *(f"p{k}x{i}" for i in range(run)), *words[50 + run :]]
        a, b = ({tuple(w[i : i + 5]) for i in range(100)} for w in (words, other))
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        left |= {2 * k} if 100 * len(a & b) >= 80 * len(a | b) else {2 * k, 2 * k + 1}
    assert 60 < len(left) < 120
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, FOLDER).collect()} == left


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    first = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, FOLDER)
        assert out.columns == first.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert 0 < docs.count() < first.count()
    rows = near_duplicates(docs)
    assert rows.filter("NOT kept").isEmpty()
    assert leaks(docs, spark.read.parquet(f"{FOLDER}/benchmark.parquet")).isEmpty()
    assert found_spans(docs).filter("size(base) > 0").isEmpty()
    last = corpus_pipeline.run(spark, FOLDER)
    assert {r.doc_id for r in last.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
