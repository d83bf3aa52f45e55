import hashlib
import re
import uuid

from pyspark.sql import functions as F

from mentionlake.functions.bits import bucket_key
from mentionlake.functions.ids import name_uuid
from mentionlake.functions.text import WHITESPACE, is_blank, let, words
from mentionlake.operators.simhash import bucket_rows, fingerprints


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first().y


def plain_simhash(text):
    votes = [0] * 64
    for token in re.sub(r"[^\w\s]", "", text.lower()).split():
        h = int(hashlib.md5(token.encode()).hexdigest(), 16)
        for i in range(64):
            votes[i] += 1 if h >> i & 1 else -1
    word = sum(1 << i for i in range(64) if votes[i] >= 0)
    return word - (1 << 64) if word >> 63 else word


def test_whitespace_is_pythons():
    space = re.compile(f"[{WHITESPACE}]")
    assert all(bool(space.match(chr(i))) == chr(i).isspace() for i in range(0x110000))


def test_words_and_blank(spark):
    text = " a\x1fb c  d\n"
    assert one(spark, text, words(F.col("x"))) == text.split()
    assert one(spark, " 　\n", is_blank(F.col("x")))
    assert not one(spark, " a ", is_blank(F.col("x")))
    assert one(spark, "a", let(F.length("x"), lambda n: n + n)) == 2


def test_point_id(spark):
    assert one(spark, "post-7", name_uuid(F.col("x"))) == "77033e83-813b-526b-a280-3f4936678902"
    rows = spark.createDataFrame([(f"пост {i}",) for i in range(50)], "x string")
    for r in rows.select("x", name_uuid(F.col("x")).alias("y")).collect():
        assert r.y == str(uuid.uuid5(uuid.NAMESPACE_URL, r.x))


def test_fingerprints(spark):
    texts = ["", "a", "a b", "a-b, c_d! Ёлка", "мама мыла раму " * 40, "x y z x x", "!!! ..."]
    posts = spark.createDataFrame([(i, str(i), "", t) for i, t in enumerate(texts)], "seq long, post_id string, title string, content string")
    got = {r.seq: r.simhash for r in fingerprints(posts).collect()}
    assert got == {i: plain_simhash(" " + t) for i, t in enumerate(texts)}
    assert got[0] == -1 and got[1] == 3585878926028121697 and got[2] == 0x3BD79DF77D7777EF


def test_buckets_low_first(spark):
    prints = spark.createDataFrame([(0x3BD79DF77D7777EF,)], "simhash long")
    rows = bucket_rows(prints).orderBy("bucket_idx").collect()
    assert [r.fragment for r in rows] == [0x77EF, 0x7D77, 0x9DF7, 0x3BD7]
    assert rows[0].bucket == f"simhash_bucket:0:{0x77EF:016b}"
    assert spark.range(1).select(bucket_key(F.lit(2), F.lit(5)).alias("k")).first().k == "simhash_bucket:2:" + "0" * 13 + "101"
