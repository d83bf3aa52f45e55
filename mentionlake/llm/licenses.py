"""License scans: ordered signature rules over words, gated by keywords.

DataFrame functions only. A text becomes its words, joined by one blank. Three base
phrases are counted in it directly. Rules are tried only near their keywords: stretches of
a text with a keyword are kept by the number of their first word, each place in them with
the words around it is joined with the rules of its keyword, a short list of fixed size,
and a rule that matches across the place gives a detection with its first and last word. A
detection that lies inside another one of the same or higher priority is suppressed; of
equal intervals the higher priority, then the earlier rule stays. Boilerplate that open
licenses contain too ("all rights reserved") is suppressed near any other detection.

Edge cases: a null text is empty; an empty one has no words, no places and no labels;
repeated rows are scanned each. A text dense with keywords is held as stretches that
overlap, two and a half times its length; the words around a place are cut out of one
stretch. Columns other than doc_id and text are never read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mentionlake.llm.license_rules import WEAK, rules
from mentionlake.llm.tables import documents
from mentionlake.staging import stage

# Phrases and labels of the contract
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Words on either side of a keyword that a rule may see; no rule is longer.
REACH = 24
# Words of a stretch that is searched on its own, besides REACH on either side
STRETCH = 32
# Words between boilerplate and a license that it may belong to
NEAR = 300
# Stands before the keyword of a place; no word contains it.
_MARK = "#"


def normal(text: Column) -> Column:
    """The words of a text, one blank between them and at both ends; one blank without words."""
    lower = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.regexp_replace(F.concat(F.lit(" "), lower, F.lit(" ")), _SEPARATORS, " ")


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _phrase(words: Column, phrase: str) -> tuple[Column, Column, Column]:
    """Number of places, first and last start of ``phrase``; no two places overlap."""
    wanted = f" {phrase} "
    doubled = F.replace(words, F.lit(" "), F.lit("  "))
    size = len(phrase.split()) * 2 + sum(map(len, phrase.split()))
    spread = "".join(f" {w} " for w in phrase.split())
    count = F.floor((F.length(doubled) - F.length(F.replace(doubled, F.lit(spread), F.lit("")))) / size).cast("long")
    there = words.contains(wanted)
    first = F.when(there, _blanks(F.left(words, F.instr(words, wanted) - 1)))
    after = F.length(words) - F.instr(F.reverse(words), wanted[::-1]) - len(wanted) + 1
    last = F.when(there, _blanks(F.left(words, after)))
    return F.when(there, count).otherwise(F.lit(0)).cast("long"), first.cast("long"), last.cast("long")


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, n_words, n_base, first_word, last_word, base, stretches) per row;
    ``stretches`` have the words around keywords of the rules."""
    table = rules()
    keywords = sorted({keyword for _, _, keyword, _ in table})
    words = docs.select(
        "doc_id", F.xxhash64("doc_id", "text").alias("row_key"), normal(F.col("text")).alias("words")
    )
    found = [_phrase(F.col("words"), phrase) for phrase in PHRASES]
    n_words = F.when(F.col("words") == " ", F.lit(0)).otherwise(_blanks(F.col("words")) - 1).cast("long")
    n_base = sum((count for count, _, _ in found[1:]), found[0][0])
    labels = F.filter(F.array(*[F.when(c > 0, F.lit(label)) for (c, _, _), label in zip(found, PHRASES.values())]), lambda x: x.isNotNull())
    gate = F.col("words").rlike(f" (?:{'|'.join(keywords)}) ")
    listed = F.array(*[F.lit(k) for k in keywords])

    def stretch(ws: Column, first: Column) -> Column:
        start = F.greatest(first - REACH, F.lit(0))
        return F.struct(first.cast("long").alias("first"), start.cast("long").alias("from"),
                        F.slice(ws, start + 1, first - start + STRETCH + REACH).alias("ws"))

    # each stretch of the text whose own words have a keyword
    split = F.element_at(F.transform(F.array(F.split(F.btrim("words"), " ")), lambda ws: F.transform(
        F.filter(F.sequence(F.lit(0), F.size(ws) - 1, F.lit(STRETCH)), lambda i: F.arrays_overlap(F.slice(ws, i + 1, F.lit(STRETCH)), listed)),
        lambda i: stretch(ws, i),
    )), 1)
    none = F.array().cast("array<struct<first:bigint,from:bigint,ws:array<string>>>")
    return words.select(
        "doc_id", "row_key", n_words.alias("n_words"), n_base.alias("n_base"),
        F.least(*[first for _, first, _ in found]).alias("first_word"),
        F.greatest(*[last for _, _, last in found]).alias("last_word"),
        labels.alias("base"), F.when(gate, split).otherwise(none).alias("stretches"),
    )


def marked(pattern: str, keyword: str) -> str:
    """``pattern`` with the mark before its keyword."""
    return re.sub(rf"(?<!\w){keyword}(?!\w)", _MARK + keyword, pattern)


def places(found: DataFrame) -> DataFrame:
    """(row_key, keyword, from, before, after): every keyword's place with the words around it,
    ``from`` being the number of the first of them."""
    listed = F.array(*[F.lit(k) for k in sorted({keyword for _, _, keyword, _ in rules()})])
    each = found.select("row_key", F.explode("stretches").alias("s")).select("row_key", "s.*").distinct()
    skipped = (F.col("first") - F.col("from")).cast("int")
    own = F.sequence(skipped, F.least(skipped + STRETCH, F.size("ws")) - 1)
    at = each.withColumn("i", F.explode(F.filter(own, lambda i: F.array_contains(listed, F.get("ws", i)))))
    at = at.withColumn("keyword", F.get("ws", F.col("i")))
    start = F.greatest(F.col("i") - REACH, F.lit(0))
    return at.select(
        "row_key", "keyword", (F.col("from") + start).alias("from"),
        F.concat(F.lit(" "), F.array_join(F.transform(F.slice("ws", start + 1, F.col("i") - start), lambda w: F.concat(w, F.lit(" "))), "")).alias("before"),
        F.concat(F.array_join(F.slice("ws", F.col("i") + 1, F.lit(REACH)), " "), F.lit(" ")).alias("after"),
    )


def matched(found: DataFrame) -> DataFrame:
    """(row_key, rule, priority, label, start, end) of the rules across their keywords' places."""
    spark = found.sparkSession
    table = spark.createDataFrame(
        [(i, p, label, k, f" (?:{marked(pattern, k)}) ", f"^(.*?) ({marked(pattern, k)}) ") for i, (p, label, k, pattern) in enumerate(rules())],
        "rule int, priority int, label string, keyword string, anywhere string, pattern string",
    )
    near = places(found).join(F.broadcast(table), "keyword")  # the rules are of fixed number
    tried = near.withColumn("around", F.concat("before", F.lit(_MARK), "after")).filter(F.rlike("around", F.col("anywhere")))
    head, match = (F.expr(f"regexp_extract(around, pattern, {i})") for i in (1, 2))
    return tried.select(
        "row_key", "rule", "priority", "label",
        (F.col("from") + _blanks(F.concat(head, F.lit(" "))) - 1).alias("start"), (_blanks(match) + 1).alias("size"),
    ).withColumn("end", F.col("start") + F.col("size")).drop("size").distinct()


def detections(found: DataFrame) -> DataFrame:
    """(row_key, label, start, end, priority) of rules, suppressed ones left out."""
    placed = matched(found)
    # boilerplate is at priority 1; what else is detected near it explains it
    weak = (F.col("priority") == 1) & F.col("label").isin(WEAK)
    around = Window.partitionBy("row_key").orderBy("start").rangeBetween(-NEAR, NEAR)
    placed = placed.withColumn("others", F.count(F.when(~weak, 1)).over(around)).filter(~weak | (F.col("others") == 0)).drop("others")
    # Inside another of at least its priority: the furthest end among those that start no
    # later, longer ones first, for each priority.
    order = Window.partitionBy("row_key").orderBy("start", F.desc("end"), F.desc("priority"), "rule").rowsBetween(Window.unboundedPreceding, -1)
    reach = {p: F.max(F.when(F.col("priority") >= p, F.col("end"))).over(order) for p in (1, 2, 3)}
    covered = F.when(F.col("priority") == 3, reach[3]).when(F.col("priority") == 2, reach[2]).otherwise(reach[1])
    return placed.withColumn("covered", covered).filter(F.coalesce(F.col("covered") < F.col("end"), F.lit(True))).drop("covered", "rule")


def licenses(docs: DataFrame) -> DataFrame:
    """n_words, n_base, first_word, last_word, base_labels, labels and score of every row.

    The score is the highest priority of a detection, as a share, or 1 with a base phrase.
    """
    found = stage(scanned(docs), "licenses")
    labels = detections(found).groupBy("row_key").agg(F.collect_set("label").alias("more"), F.max("priority").alias("best"))
    joined = found.drop("stretches").join(labels, "row_key", "left")
    everything = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.col("best") / 3, F.lit(0.0)))
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(everything, ",").alias("labels"), score.alias("score"),
    )


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(documents(spark, sf_dir))
