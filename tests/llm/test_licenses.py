import random
import re

from mentionlake.llm.license_rules import rules
from mentionlake.llm.licenses import PHRASES, licenses, matched, places, scanned
from mentionlake.staging import stage

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = [
    "...", "cc by nc cc by nc", "CC BY-NC 4.0", "under the mit license under the mit license", "x cc by nc",
    "Under the MIT license, Apache License, Version 2.0; cc by nc", "mit", "é cc by ncé cc by nc.", "cc by by nc",
    "You can redistribute it and/or modify it under the terms of the GNU General Public License version 3 or later",
]


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places, labels = [], set()
    for phrase, label in PHRASES.items():
        wanted = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(wanted)] == wanted:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base(spark, docs, rows_of):
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for rows, by_id in ((licenses(frame).collect(), dict(enumerate(TEXTS))), (licenses(docs).collect(), dict(rows_of))):
        assert len(rows) in (len(TEXTS), len(rows_of))
        for r in rows:
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(by_id[r.doc_id])
            assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_rules(spark):
    assert len(rules()) > 200 and len({r[1:] for r in rules()}) > 200
    cases = {
        "released under the GNU Lesser General Public License v2.1.": "lgpl-2.1", "MPL 2.0": "mpl-2",
        "Creative Commons Attribution ShareAlike 4.0 International License": "cc-by-sa-4.0", "All rights reserved": "proprietary",
        "the BSD 3-Clause License": "bsd-3", "we met at nine": "",
    }
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r.labels.split(",") for r in licenses(frame).collect()}
    for i, label in enumerate(cases.values()):
        assert label in got[i], (i, got[i])
    assert got[5] == [""]
    assert "lgpl" not in got[0]  # lies inside the longer detection with the version


def examples(pattern):
    """Texts that the pattern matches, each of its alternatives in one of them at least."""

    def of(parsed):
        out = [""]
        for kind, value in parsed:
            name = str(kind)
            if name == "LITERAL":
                more = [chr(value)]
            elif name == "IN":
                more = [chr(value[0][1])] if str(value[0][0]) == "LITERAL" else ["x"]
            elif name == "MAX_REPEAT":
                more = ([""] if value[0] == 0 else []) + of(value[2])
            elif name == "SUBPATTERN":
                more = of(value[3])
            elif name == "BRANCH":
                more = [t for branch in value[1] for t in of(branch)]
            else:
                assert name == "ASSERT_NOT"
                continue
            out = [a + b for a in out for b in more]
        return out

    return of(re._parser.parse(pattern))


def test_every_rule_finds_its_examples(spark):
    """Alone, and as the second mention next to the first."""
    rows = []
    for k, (_, _, keyword, pattern) in enumerate(rules()):
        texts = examples(pattern)
        for text in {texts[0], texts[-1], *random.Random(k).sample(texts, min(len(texts), 4))}:
            assert keyword in text.split()
            rows += [(k, text, (0,)), (k, f"{text} then {text}", (0, len(text.split()) + 1))]
    frame = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(rows)], "doc_id long, text string")
    found = stage(scanned(frame), "licenses-test")
    got = {(r.doc_id, r.rule, r.start) for r in matched(found).join(found.select("row_key", "doc_id"), "row_key").collect()}
    assert [rows[i] for i, (k, _, at) in enumerate(rows) for a in at if (i, k, a) not in got] == []


def test_names_without_the_short_one_and_second_mentions(spark):
    cases = {
        "European Union Public License": "eupl", "Universal Permissive License": "upl", "the zero clause BSD license": "0bsd",
        "PSF license": "python-2", "FreeBSD license": "bsd-2", "BSD 3-Clause License or else the BSD License": "bsd",
    }
    frame = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r.doc_id: r.labels.split(",") for r in licenses(frame).collect()}
    for i, label in enumerate(cases.values()):
        assert label in got[i], (i, got[i])


def test_ordinary_words_are_no_licenses(spark):
    mit = "Copyright 2020. All rights reserved. Permission is hereby granted, free of charge, to any person obtaining a copy"
    cases = {
        "under the artistic direction of a friend": "", "hidden under the ruby stone": "", "under proprietary control": "",
        "the house is in the public domain of debate": "", mit: "mit", "the poet took some artistic license": "",
        "released under the WTFPL": "wtfpl", "licensed under Ruby": "ruby", "this work is in the public domain": "public-domain",
        "All rights reserved. " + "word " * 400 + "the MIT License": "mit,proprietary", "All rights reserved": "proprietary",
        "All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted": "bsd",
    }
    frame = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses(frame).collect()}
    assert {i: got[i][0] for i in got} == dict(enumerate(cases.values()))
    assert got[10][1] < 0.5 < got[4][1]


def test_places_in_long_texts_dense_with_keywords(spark):
    """Every place of a keyword, wherever stretches of the text begin."""
    text = "mit " * 3 + "x " * 59 + "python " * 500 + "y " * 40 + "under the MIT license " * 60
    found = scanned(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    words = text.lower().split()
    got = {(r["from"] + len(r.before.split()), r.keyword) for r in places(found).collect()}
    assert got == {(i, w) for i, w in enumerate(words) if w in {k for _, _, k, _ in rules()}}
    assert {r.start for r in matched(found).filter("label = 'mit'").collect()} >= {i for i, w in enumerate(words) if w == "under"}
    sizes = found.selectExpr("aggregate(stretches, 0, (n, s) -> n + size(s.ws)) as n").first().n
    assert sizes <= 2.5 * len(words)


def test_no_rows(no_docs):
    assert licenses(no_docs).count() == 0
