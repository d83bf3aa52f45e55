import hashlib
import random
import re

from mentionlake.llm.substring import WINDOW, without_repeats


def brute(rows):
    """Every window against every earlier one."""
    ids = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    first = {}
    for i in sorted(ids, key=lambda i: (i is not None, i)):
        for s in range(len(ids[i]) - WINDOW + 1):
            first.setdefault(tuple(ids[i][s : s + WINDOW]), (i, s))
    out = {}
    for i, words in ids.items():
        gone = [False] * len(words)
        for s in range(len(words) - WINDOW + 1):
            if first[tuple(words[s : s + WINDOW])] != (i, s):
                gone[s : s + WINDOW] = [True] * WINDOW
        left = " ".join(w for w, g in zip(words, gone) if not g)
        out[i] = len(words), sum(gone), hashlib.sha256(left.encode()).hexdigest()
    return out


def check(frame, rows):
    want = brute(rows)
    got = without_repeats(frame).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id]


def test_edges(docs, rows_of):
    check(docs, rows_of)


def test_pasted_passages_and_periods(spark):
    draw = random.Random(5)
    sources = [[draw.choice("a b c dd e".split()) for _ in range(200)] for _ in range(4)]
    texts = ["a " * 19, "a " * 25, "a " * 400, "b " * 30 + "a " * 30, "x y " * 50, "y x " * 60]
    for _ in range(80):
        words = []
        for _ in range(draw.randrange(1, 5)):
            source, start = draw.choice(sources), draw.randrange(150)
            words += source[start : start + draw.randrange(5, 60)] + [f"u{draw.randrange(10**6)}"]
        texts.append(draw.choice([" ", "\n "]).join(words))
    rows = list(enumerate(texts + texts[10:20]))
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows)


def test_no_rows(no_docs):
    assert without_repeats(no_docs).count() == 0
