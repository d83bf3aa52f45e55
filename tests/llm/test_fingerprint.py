import hashlib
import random

import numpy as np

from mentionlake.llm.fingerprint import LEAST, MOST, NORMAL, _GEAR, chunk_sets, cuts, edited, fingerprints, likeness


def sequential(data):
    """Cut ends of one text, byte by byte."""
    ends, start = [], 0
    while start < len(data):
        end = min(start + MOST, len(data))
        for i in range(start + LEAST, end):
            h = sum(int(_GEAR[data[i - k]]) << k for k in range(16)) & 0xFFFFFFFF
            if h >> (26 if i < start + NORMAL else 28) == 0:
                end = i + 1
                break
        ends.append(end)
        start = end
    return ends


def test_cuts():
    draw = random.Random(2)
    texts = [bytes(draw.choices(b"abcdefgh ", k=n)) for n in (0, 1, 20, 400, 3000)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    row, _, end = cuts(data, offsets)
    for i, text in enumerate(texts):
        assert (end[row == i] - offsets[i]).tolist() == sequential(text)


def test_insertion_changes_few_chunks():
    text = " ".join(random.Random(1).choices([f"w{i}" for i in range(500)], k=600)).encode()
    a, b = chunk_sets([text, text[:700] + b"inserted" + text[700:]])
    assert likeness(a, b) > 0.9 and likeness(a, a) == 1 and likeness({}, {}) == 1 and likeness(a, {}) == 0


def test_next_documents(docs, rows_of):
    rows = sorted(rows_of, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    texts = [t or "" for _, t in rows]
    got = sorted(fingerprints(docs).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert [(r.doc_id, r.n_chars) for r in got] == [(i, len(t or "")) for i, t in rows]
    want = [hashlib.sha256(edited(a, b).encode()).hexdigest() for a, b in zip(texts, texts[1:] + texts[:1])]
    assert [r.edited_sha256 for r in got] == want
    prints = {}
    for r, t in zip(got, texts):
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1


def test_single_and_no_rows(spark, no_docs):
    one = fingerprints(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one[0].near_next == 1
    assert fingerprints(no_docs).count() == 0
