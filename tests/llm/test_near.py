import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from mentionlake.llm import near
from mentionlake.llm.components import components
from mentionlake.llm.near import REGISTERS, near_duplicates, plausible, without_near_duplicates

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, min(len(words), 1)))}


def brute(rows):
    """(n_shingles, component) of each row by comparing all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        common = len(sets[a] & sets[b])
        if sets[a] and 100 * common >= 85 * len(sets[a] | sets[b]):
            group[find(a)] = find(b)
    least = {}
    for i in range(len(rows)):
        if rows[i][0] is not None:
            least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return sorted(((rows[i][0], len(sets[i]), least.get(find(i))) for i in range(len(rows))), key=repr)


def found(frame):
    rows = near_duplicates(frame).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=repr)


def test_edges(docs, rows_of):
    assert found(docs) == brute(rows_of)


def chained():
    """Copies of templates with more and more changes: links run in chains and across."""
    draw, rows = random.Random(3), []
    for group in range(4):
        words = [f"g{group}w{draw.randrange(10**6)}" for _ in range(200)]
        for _ in range(60):
            if draw.random() < 0.5:
                words = list(words)
                words[draw.randrange(200)] = f"n{draw.randrange(10**6)}"
            changed = list(words)
            for _ in range(draw.randrange(0, 4)):
                changed[draw.randrange(200)] = f"c{draw.randrange(10**6)}"
            rows.append(" ".join(changed))
    draw.shuffle(rows)
    return list(enumerate(rows))


def test_chains(spark):
    rows = chained()
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_rows_without_an_id(spark):
    """A near copy whose only row has no id is linked; of groups without any id one row stays."""
    draw = random.Random(8)
    words = [f"w{draw.randrange(10**6)}" for _ in range(300)]
    other = [f"o{draw.randrange(10**6)}" for _ in range(300)]
    rows = [(None, words), (5, [*words[:-1], "x"]), (7, ["y", *words[1:]]), (None, other), (None, [*other[:-1], "z"]), (None, ["lone"] * 9)]
    rows = [(i, " ".join(w)) for i, w in rows]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(frame) == brute(rows)
    left = [(r.doc_id, r.text) for r in without_near_duplicates(frame).collect()]
    assert len(left) == 3 and rows[1] in left and rows[5] in left and (rows[3] in left) != (rows[4] in left)


def test_block_rows_grow_with_the_members(spark, monkeypatch):
    """One large component and 20 outsiders: outsiders meet all parts, members are dealt once."""
    monkeypatch.setattr(near, "BLOCK", 64)
    shape, each = "key long, band int, class long, component long", []
    for size in (600, 1200, 2400):
        members = spark.createDataFrame([(1, 0, i, 0 if i < size - 20 else i) for i in range(size)], shape)
        each.append(near._blocks(members).count() / size)
    assert max(each) < 1.5
    members = spark.createDataFrame([(1, 0, i, i) for i in range(200)], shape)  # all in components of their own
    met = set()
    for block in near._blocks(members).groupBy("i", "j").agg({"class": "collect_list"}).collect():
        met |= {(a, b) for a in block[2] for b in block[2] if a < b}
    assert len(met) == 200 * 199 // 2


def test_crowded_buckets_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 16)
    rows = chained()
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_one_of_each_group_stays(docs, rows_of):
    left = without_near_duplicates(docs)
    assert left.columns == docs.columns
    ids = [r.doc_id for r in left.collect()]
    assert sorted(ids, key=repr) == sorted({i for i, _, c in brute(rows_of) if i == c}, key=repr)


def test_no_rows(no_docs):
    assert near_duplicates(no_docs).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7), (60, 50), (200, 60)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 60: 0, 200: 0, 100: 100, 101: 100}


def test_wanted_pairs_stay_plausible():
    draw = np.random.default_rng(1)
    n = np.full(5000, 100.0)
    outcomes = draw.multinomial(REGISTERS, [0.08, 0.08, 0.84], 5000)  # registers of pairs at 0.85
    assert plausible(outcomes[:, 0], outcomes[:, 1], n, n).all()
    assert not plausible(np.array([40]), np.array([40]), n[:1], n[:1]).any()


@pytest.mark.parametrize("percent", [80, 85])
def test_pairs_without_enough_equal_registers_are_never_plausible(percent):
    rng = np.random.default_rng(percent)
    more = rng.integers(0, near.REGISTERS + 1, 200_000)
    less = (rng.random(len(more)) ** 3 * (near.REGISTERS + 1 - more)).astype(int)
    n_b = rng.integers(1, 3000, len(more)).astype(float)
    n_a = np.ceil(n_b * (percent / 100 + rng.random(len(more)) ** 2 * (1 - percent / 100) * 1.5))
    for one, two in ((more, less), (less, more)):
        good = near.plausible(one, two, n_a, n_b, percent)
        assert good.any() and (near.REGISTERS - one - two)[good].min() >= near.least_equal(percent) > 40


@pytest.mark.parametrize("parts", [1, 2])
def test_members_of_a_bucket_are_weighed_only_if_their_registers_agree(monkeypatch, parts):
    rng = np.random.default_rng(7)
    n, band = 300, 2
    marks = rng.integers(0, 60, (20, near.REGISTERS)).astype(np.uint8)[rng.integers(0, 20, n)]
    other = rng.random((n, near.REGISTERS)) < rng.random((n, 1)) * 0.6
    marks[other] = rng.integers(0, 60, other.sum())
    sizes, names, groups, part = rng.integers(50, 200, n), rng.permutation(n), rng.integers(0, 90, n), rng.integers(0, parts, n)
    block = pa.table({
        "class": names, "component": groups, "n": sizes, "part": part, "band": [band] * n, "i": [0] * n, "j": [parts - 1] * n, "key": [5] * n,
        "sketch": pa.array([m.tobytes() for m in marks], pa.binary()),
    })
    width, want = near.band_rows(80), []
    for x in np.flatnonzero(part == 0):
        for y in np.flatnonzero(part == parts - 1):
            if groups[x] == groups[y] or parts == 1 and names[x] >= names[y]:
                continue
            more, less = np.array([(marks[x] > marks[y]).sum()]), np.array([(marks[x] < marks[y]).sum()])
            if near.plausible(more, less, sizes[[x]].astype(float), sizes[[y]].astype(float), 80)[0]:
                if (marks[x] == marks[y]).reshape(-1, width).all(1).argmax() == band:
                    want.append((x, y))
    weighed, plain = [], near.plausible
    near.least_equal(80)
    monkeypatch.setattr(near, "plausible", lambda more, *rest: weighed.append(len(more)) or plain(more, *rest))
    assert sorted(near._apart(block, 80)) == sorted(want) and want
    assert sum(weighed) < n * n / 40
    # blocks one behind another are those blocks
    thrice = pa.concat_tables([block.set_column(block.schema.get_field_index("key"), "key", pa.array([k] * n)) for k in range(3)])
    assert sorted(near._apart(thrice, 80)) == sorted((x + k * n, y + k * n) for k in range(3) for x, y in want)


def test_small_buckets_are_no_groups_of_their_own(spark):
    """5,000 buckets of two members, in one task and few batches, also where a batch ends inside a bucket."""
    rng = np.random.default_rng(3)
    marks = rng.integers(0, 60, (5000, REGISTERS)).astype(np.uint8)
    rows = [(k, 0, 0, 0, 0, 2 * k + e, 2 * k + e, 100, bytearray(marks[k].tobytes())) for k in range(5000) for e in (0, 1)]
    shape = "key long, band int, i int, j int, part int, class long, component long, n long, sketch binary"
    blocks = spark.createDataFrame(rows, shape)
    found = near._members_apart(blocks, 80)
    assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted(r["class"] for r in near._members_apart(blocks, 80).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == list(range(10_000)) == sorted(r["class"] for r in found.collect())
