import random

import pytest

CLASHING = ["label", "score", "key", "class", "component", "sequence", "anchor", "words", "row_key", "_row_key", "row_key_", "spans", "_spans", "group", "own", "n_words", "kept"]


@pytest.fixture(scope="session")
def texts():
    """Nulls, blanks, one word, a very long text, one very long word, ties and copies."""
    draw = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    prose = [" ".join(draw.choices(vocabulary, k=draw.randrange(30, 120))) for _ in range(40)]
    long = " ".join(draw.choices(vocabulary, k=40_000))
    odd = [None, "", "  \n\t ", "one", "a b", "x" * 50_000, long, "é 🙂 ñandú " * 8]
    return odd + prose + prose[:4] + [prose[0] + " tail of its own here"]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with columns whose names clash with those of the operators, one row twice
    and one id missing."""
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[9], (None, texts[10], None, None, 0)]
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    frame = spark.createDataFrame(rows, shape)
    for name in CLASHING:
        frame = frame.withColumn(name, frame["doc_id"].cast("string"))
    return frame.repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
