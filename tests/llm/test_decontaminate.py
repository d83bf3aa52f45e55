import math
import random
from collections import Counter

import numpy as np

from mentionlake.llm.decontaminate import Postings, item_windows, ladder, leaks, without_leaks

DRAW = random.Random(8)
WORDS = [f"w{i}" for i in range(3000)]
ITEMS = [(i, " ".join(DRAW.choices(WORDS, k=DRAW.randrange(15, 60)))) for i in range(60)]


def frame(spark, rows, name="doc_id"):
    return spark.createDataFrame(rows, f"{name} long, text string")


def test_finds_passages_and_leaves_the_rest(spark):
    docs, want = [], set()
    for i in range(200):
        words = DRAW.choices(WORDS, k=DRAW.randrange(50, 400))
        if i % 4 == 0:
            item, text = DRAW.choice(ITEMS)
            passage = text.split()
            if i % 8 == 0 and len(passage) > 20:
                passage[DRAW.choice([0, -1])] = "other"  # a changed end keeps the similarity above 0.8
            at = DRAW.randrange(len(words))
            words = words[:at] + [w.upper() + "," for w in passage] + words[at:]
            want.add((i, item))
        docs.append((i, " ".join(words)))
    table, bench = frame(spark, docs), frame(spark, ITEMS, "item_id")
    got = leaks(table, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and all(r.similarity >= 0.8 for r in got)
    assert {(r.doc_id, r.item_id) for r in leaks(table, bench, block=7).collect()} == want  # in several passes
    assert {r.doc_id for r in without_leaks(table, bench).collect()} == {i for i, _ in docs} - {i for i, _ in want}


def test_edges(spark, docs, rows_of, texts):
    bench = frame(spark, [(1, "one"), (2, None), (3, ""), (4, texts[8]), (5, texts[8]), (None, texts[9])], "item_id")
    got = {(r.doc_id, r.item_id) for r in leaks(docs, bench).collect()}
    holders = {i for i, t in rows_of if t and texts[8] in t}
    assert {(i, k) for i in holders for k in (4, 5)} <= got
    assert (3, 1) in got  # a one-word item in the one-word text
    left = without_leaks(docs, bench)
    assert left.columns == docs.columns and left.count() == sum(i not in {d for d, _ in got} for i, _ in rows_of)


def test_empty_tables(spark, docs, no_docs):
    bench = frame(spark, ITEMS, "item_id")
    assert leaks(no_docs, bench).count() == 0
    assert leaks(docs, bench.limit(0)).count() == 0
    assert without_leaks(docs, bench.limit(0)).count() == docs.count()


def test_repeated_rows_shared_and_null_ids(spark):
    """An item is a distinct pair of id and text."""
    text = {name: " ".join(f"{name}{i}" for i in range(40)) for name in "abcd"}
    bench = frame(spark, [(1, text["a"]), (1, text["a"]), (2, text["b"]), (2, text["c"]), (2, "cc dd"), (None, text["d"])], "item_id")
    table = frame(spark, [(i, f"before {t} after") for i, t in enumerate(text.values())])
    got = sorted((r.doc_id, r.item_id, r.similarity) for r in leaks(table, bench).collect())
    assert got == [(0, 1, 1.0), (1, 2, 1.0), (2, 2, 1.0), (3, None, 1.0)]
    assert without_leaks(table, bench).isEmpty()


def test_near_copies_of_items_that_share_text(spark):
    """One inner word changed in an item of 60, 0.836 alike: unique, copied, and templated."""
    words = [f"t{i}" for i in range(60)]
    for others in ([], [words] * 9, [words[:50] + [f"o{k}x{i}" for i in range(10)] for k in range(9)]):
        bench = frame(spark, [(k, " ".join(w)) for k, w in enumerate([words, *others])], "item_id")
        table = frame(spark, [(0, " ".join(["before", *words[:30], "other", *words[31:], "after"]))])
        got = {r.item_id: r.similarity for r in leaks(table, bench).collect()}
        assert set(got) == set(range(10 if others and others[0] == words else 1))
        assert all(round(s, 3) >= 0.836 for s in got.values())


def test_runs_of_changed_words_inside_long_items(spark):
    """Ten copies each with a run inside, 0.8 alike or a little more, none of which is missed."""
    bench, docs = [], []
    for k, (size, run) in enumerate([(80, 4), (100, 6), (200, 17), (400, 40)] * 10):
        words = DRAW.choices([f"v{i}" for i in range(10**6)], k=size)
        bench.append((k, " ".join(words)))
        at = (size - run) // 2
        docs.append((k, " ".join(["before", *words[:at], *(f"n{k}x{i}" for i in range(run)), *words[at + run :], "after"])))
    got = {(r.doc_id, r.item_id) for r in leaks(frame(spark, docs), frame(spark, bench, "item_id")).collect()}
    assert got == {(k, k) for k in range(40)}


def test_some_window_has_no_change():
    """Changes at ends and inside, as costly as the similarity allows, by the number of shingles they meet."""
    draw = random.Random(5)
    for length in [*range(13, 140), 200, 333, 400, 1000]:
        places, k = item_windows(length), length - 4
        assert all(0 <= at <= length - size for size, at in places)
        for _ in range(200):
            changed, met = set(), set()
            while True:
                first = draw.choice([0, length - 1, draw.randrange(length), *changed, *(i + 1 for i in changed)])
                more = met | {i for i in range(first - 4, first + 1) if 0 <= i < k}
                if first >= length or (k - len(more)) * 10 < 8 * (k + len(more)):
                    break
                changed, met = changed | {first}, more
            assert any(not changed & set(range(at, at + size)) for size, at in places), (length, changed)


def shingles(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else {tuple(words)}


def exhaustive(docs, items):
    """The best similarity of each item in each text, over all windows of its size."""
    different = {frozenset(shingles(t.split())) for _, t in items}
    shared = Counter(s for item in different for s in item)
    out = {}
    for doc, text in docs:
        words = text.lower().replace(",", "").split()
        for item, wanted in items:
            here, size = shingles(wanted.split()), len(wanted.split())
            weight = {s: 1 / (1 + math.log2(shared[s])) for s in here}
            for at in range(len(words)):  # windows are cut at the end of the text
                there = shingles(words[at : at + size])
                common = here & there
                plain = len(common) / len(here | there)
                score = max(plain, sum(weight[s] for s in common) / (sum(weight.values()) + len(there) - len(common)))
                out[doc, item] = max(out.get((doc, item), (0, 0)), (score, plain))
    return out


def test_against_an_exhaustive_scan(spark):
    """Words replaced, put in and left out, items of one template: nothing is found that the scan
    does not find, all that is alike by plain similarity with words replaced, and at least 98 of 100 of all."""
    draw = random.Random(21)
    base = draw.choices(WORDS, k=24)
    items = [(i, " ".join(draw.choices(WORDS, k=draw.randrange(15, 50)))) for i in range(20)]
    items += [(20 + i, " ".join([*base, *draw.choices(WORDS, k=draw.randrange(4, 12))])) for i in range(8)]
    docs, replaced = [], set()
    for i in range(160):
        item, text = draw.choice(items)
        words, how = text.split(), i % 4
        at = draw.choice([0, 1, len(words) // 2, len(words) - 1])
        if how == 0:
            words[at] = "new"
            replaced.add((i, item))
        elif how == 1:
            words.insert(at, "new")
        elif how == 2:
            del words[at]
        else:
            words[-1] = words[-2] = "new"
            replaced.add((i, item))
        docs.append((i, " ".join(draw.choices(WORDS, k=draw.randrange(20)) + words + draw.choices(WORDS, k=draw.randrange(20)))))
    scan = exhaustive(docs, items)
    want = {pair for pair, (score, _) in scan.items() if score >= 0.8}
    got = {(r.doc_id, r.item_id): r.similarity for r in leaks(frame(spark, docs), frame(spark, items, "item_id")).collect()}
    assert set(got) <= want and all(s <= scan[p][0] + 1e-9 for p, s in got.items())
    assert {p for p in replaced if scan[p][1] >= 0.8} <= set(got)
    assert len(want) > 100 and len(got) >= 0.98 * len(want)


def test_postings_hold_all_that_is_near_and_little_else():
    draw = np.random.default_rng(3)
    flips = np.array([0, *(1 << a for a in range(16)), *((1 << a) | (1 << b) for a in range(16) for b in range(a))])
    for n in (40, 5000):
        marks = draw.integers(0, 1 << 63, n, np.uint64) * np.uint64(2)
        windows = draw.integers(0, 1 << 63, 300, np.uint64)
        for k in range(100):  # within the radius of 11
            windows[k] = marks[k % n]
            for b in draw.choice(64, 11, replace=False):
                windows[k] ^= np.uint64(1) << np.uint64(b)
        postings = Postings(marks, flips)
        blocks = windows[:, None].view(np.uint16)
        found = [(a, b) for at, which in postings.pairs(blocks) for a, b in zip(at.tolist(), which.tolist())]
        near = np.argwhere(np.bitwise_count(windows[:, None] ^ marks[None, :]) <= 11)
        assert {tuple(p) for p in near.tolist()} <= set(found) and len(near) >= 100
        assert len(found) < 0.02 * n * len(windows) + 500
        assert set(a for a, _ in found) == set(np.flatnonzero(postings.any(blocks)).tolist())


def test_ladder():
    sizes = ladder(100)
    assert sizes[0] == 1 and (sizes[1:] > sizes[:-1]).all() and sizes[-1] >= 100
