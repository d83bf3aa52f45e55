import hashlib
import random
import re

from pyspark.sql import functions as F

from mentionlake.llm.pii import KINDS, base_spans, found_spans, redact, with_learned, written

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def fits(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {
        "email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in value.split(".")),
        "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15,
    }[kind]


def brute(text):
    return [
        (k, m.start(), m.end()) for k in KINDS for m in re.finditer(PATTERNS[k], text or "") if fits(k, m.group())
    ]


def test_base_spans(spark, texts):
    draw = random.Random(3)
    cases = [
        "a@b.c.._x@d.e a@b@c.d", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4", "4111 1111 1111 1111 4111111111111111", "+1 (988) 555-2485 +12",
        "x" * 20000 + "@a" + ".b" * 5000, " ".join(map(str, range(5000))), "é🙂 a@b.co 4111-1111-1111-1111.", "1" * 20000,
        *["".join(draw.choice("a1@.- +é(") for _ in range(60)) for _ in range(300)], *texts,
    ]
    frame = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    rows = frame.select("doc_id", base_spans(F.coalesce("text", F.lit(""))).alias("s")).collect()
    for r in rows:
        assert [(s.kind, s.start, s.end) for s in r.s] == brute(cases[r.doc_id])


def test_contexts_find_other_identifiers(spark):
    seeds = [(i, f"please call number +1 555 123 45{i:02d} today") for i in range(12)]
    texts = [*seeds, (90, "please call number 5551234-x now"), (91, "they made 5551234-y boxes")]
    found = found_spans(spark.createDataFrame(texts, "doc_id long, text string"))
    got = {r.doc_id: r.spans for r in with_learned(found).select("doc_id", written(F.col("spans")).alias("spans")).collect()}
    assert got[90] == "context_phone:19:28" and got[91] == ""
    assert got[3].startswith("phone:")


def test_contexts_are_the_two_words_before(spark):
    long = "w" * 100
    cases = {
        "account no2 id7 5551234": "no2 id7", f"a {long} b 5551234": f"{long} b", "see x1,a@b.co,c@d.co,e@f.co at 5551234": "x1,a@b.co,c@d.co,e@f.co at",
        "one 5551234": "", "5551234": "", "é1 ñ2  5551234": "é1 ñ2", f"my id {'9' * 90}": "my id",
    }
    frame = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r.doc_id: r.others[-1].context for r in found_spans(frame).collect()}
    assert list(cases.values()) == [got[i] for i in range(len(cases))]
    mail = spark.createDataFrame([(1, "see x1 a@b.co,c@d.co,e@f.co,g@h.co i@j.co")], "doc_id long, text string")
    assert found_spans(mail).first().base[-1].context == "x1 a@b.co,c@d.co,e@f.co,g@h.co"


def test_found_tokens_bring_in_further_contexts(spark):
    """No base value stands after 'reach desk', only tokens found after 'call number'."""
    texts = [f"please call number +1 555 123 4{i:03d} today" for i in range(100)]
    texts += [f"please call number 77{i:03d}-x now" for i in range(15)] + [f"please reach desk 77{i:03d}-x now" for i in range(15)]
    texts += ["please reach desk 88000-y now", "please reach door 88000-z now"]
    found = found_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {r.doc_id: r.spans for r in with_learned(found).select("doc_id", written(F.col("spans")).alias("spans")).collect()}
    assert got[130] == "context_phone:18:25" and got[131] == ""


def test_redaction(spark, docs, rows_of):
    text = "write to a@b.co or +1 555 123 4567, card 4111 1111 1111 1111."
    frame = spark.createDataFrame([(1, text, "x"), (1, None, "y"), (2, "", "z")], "doc_id long, text string, spans string")
    left = {r.spans: r.text for r in redact(frame).collect()}
    assert left == {"x": "write to [EMAIL] or [PHONE], card [CARD].", "y": None, "z": ""}
    same = redact(docs)
    assert same.columns == docs.columns
    assert sorted([(r.doc_id, r.text) for r in same.collect()], key=repr) == sorted(rows_of, key=repr)


def test_no_rows(no_docs):
    assert with_learned(found_spans(no_docs)).count() == 0 and redact(no_docs).count() == 0


def test_digest(spark):
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(written(F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")), 256)).first()[0]


def test_words_of_many_matches(spark):
    """Contexts reach back over words that hold any number of matches."""
    rows = []
    for k, size in enumerate((1, 2, 5, 9, 70)):
        word = ",".join(f"u{i}@h{k}.co" for i in range(size))
        rows.append((k, f"start here {word} then {word} {word} {word} end"))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for row in found_spans(frame).collect():
        text = dict(rows)[row.doc_id]
        spans = [s for s in row.base if s.kind == "email"]
        assert [s.value for s in spans] == [text[s.start : s.end] for s in spans] and len(spans) == text.count("@")
        for s in spans:
            before = text[: s.start]
            words = before.split()
            assert s.context == (re.search(r"\S+\s+\S+$", before.rstrip())[0] if before.endswith(" ") and len(words) > 1 else "")
