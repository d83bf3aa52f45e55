import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from mentionlake.llm import simhash
from mentionlake.llm.simhash import classes, fingerprints, joining, linked, near_duplicates, triples

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    parts = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, min(len(words), 1)))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(prints):
    """The least member linked with each, by comparing all pairs."""
    group = list(range(len(prints)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in combinations(range(len(prints)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 4:
            a, b = sorted((find(a), find(b)))
            group[b] = a
    return [find(i) for i in range(len(prints))]


def test_any_four_positions_hold_a_triple():
    assert len(triples()) == 20
    for four in combinations(range(8), 4):
        assert any(set(t) <= set(four) for t in triples())


def test_fingerprints(texts):
    odd = texts[:60] + ["a  b\tc d", "A b C d e", "é É é É é", "x\x0by z w", " lead and trail "]
    assert fingerprints(pa.array(odd, pa.string())).tolist() == [fingerprint(t) for t in odd]


def test_documents(docs, rows_of):
    rows = sorted(rows_of, key=lambda r: (r[0] is None, r[0] or 0))
    want = brute([fingerprint(t) for _, t in rows])
    want = sorted(((i, f"{fingerprint(t):016x}", rows[c][0]) for (i, t), c in zip(rows, want)), key=repr)
    assert sorted(map(tuple, near_duplicates(docs).collect()), key=repr) == want


def around(seed, size, centres, flips):
    """Fingerprints that differ from some centres in a few bits: dense, chained postings."""
    draw = random.Random(seed)
    base = [draw.getrandbits(64) for _ in range(centres)]
    out = set()
    while len(out) < size:
        x = draw.choice(base)
        for _ in range(draw.randrange(flips + 1)):
            x ^= 1 << draw.randrange(64)
        out.add(x)
    return sorted(out)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_crowded_postings(spark, monkeypatch):
    for part, (size, centres, flips) in ((2048, (700, 2, 9)), (16, (500, 1, 7)), (16, (400, 30, 12))):
        monkeypatch.setattr(simhash, "PART", part)
        prints = around(size, size, centres, flips)
        frame = spark.createDataFrame([(signed(p),) for p in prints], "print long")
        got = {r.print: r.component for r in classes(frame).collect()}
        by_signed = sorted(prints, key=signed)
        want = [signed(by_signed[c]) for c in brute(by_signed)]
        assert [got.get(signed(p), signed(p)) for p in by_signed] == want


def test_blocks_report_a_forest():
    prints = np.array(around(3, 600, 1, 4), np.uint64)
    a, b = joining(prints, np.array([0]), prints.view(np.int64))
    assert len(a) < 4 * len(prints)
    a, b = joining(prints, np.arange(0, 600, 50), np.zeros(600, np.int64))
    assert not len(a)


def test_tally_in_sql(spark):
    prints = around(9, 60, 3, 10)
    frame = spark.createDataFrame([(signed(x), signed(y)) for x, y in combinations(prints, 2)], "x long, y long")
    got = [r.l for r in frame.select(linked(F.col("x"), F.col("y")).alias("l")).collect()]
    assert got == [(x ^ y).bit_count() <= 4 for x, y in combinations(prints, 2)]


def test_rows_of_blocks_grow_with_the_members(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART", 64)
    counts = []
    for size in (600, 1200, 2400):
        frame = spark.createDataFrame([(7, i, 0 if i < size - 20 else i) for i in range(size)], "key long, print long, component long")
        counts.append(simhash._blocks(frame).count() / size)
    assert max(counts) < 2.5 and max(counts) < 1.2 * min(counts)


def test_no_rows(no_docs):
    assert near_duplicates(no_docs).count() == 0
