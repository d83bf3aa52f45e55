"""Personal data: fixed patterns, and identifiers found by bootstrapped contexts.

DataFrame functions only. Fixed patterns give the base spans. Every base span and every
other token with a digit in it is also seen with the two words on its left: those
contexts and the tokens found in them are the two sides of a graph. Base values are
seeds of confidence 1. In each round a context's score is the share of confidence among
its distinct tokens, and a token's confidence the noisy-or of the scores of its
contexts (Riloff, Jones, AAAI 1999; Agichtein, Gravano, 2000). Only contexts with enough
seeds are trusted; tokens of high confidence are seeds of the next round, so they bring
in further contexts. In trusted contexts they become further spans.

Edge cases: a null text is empty; an empty one has no spans; repeated rows each get
their spans; a table without personal data has no contexts and the loop ends at once.
Offsets count code points, ends are exclusive. Columns other than doc_id and text are
never read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionlake.llm.tables import documents, unused
from mentionlake.staging import stage

# Each pattern is followed by the form Java's matcher runs: a start inside a run that
# could only repeat a failed match is ruled out, and repeats never give back, so time is
# linear in the text and no repeat recurses.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# A chain of digits with single blanks or dashes between them, of 13 to 19 digits
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Any token with a digit in it
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"

_SPACE, _WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"

KINDS = ("email", "ip", "card", "phone")
_SPAN = "struct<kind:string,start:bigint,end:bigint,value:string,context:string>"

_BLOCK = 128
# Matches looked back on for two words, where two matches hold less: ever more, so that the
# time follows the length of the words, not that of the text before them
_BACK = (8, 64, 512, 4096, 32768)

ROUNDS = 3
CONFIDENCE = 0.8
SEEDS = 3


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _sum(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0).cast("bigint"), lambda total, x: total + x)


def _block_starts(steps: Column) -> Column:
    """The sum of all steps before each block of ``_BLOCK``: prefix sums in two levels."""
    blocks = F.sequence(F.lit(0), F.floor(F.size(steps) / _BLOCK).cast("int"))
    totals = F.transform(blocks, lambda b: _sum(F.slice(steps, b * _BLOCK + 1, F.lit(_BLOCK))))
    return _let(totals, lambda t: F.transform(t, lambda _, b: _sum(F.slice(t, F.lit(1), b))))


def matches(text: Column, pattern: str, kind: str) -> Column:
    """All matches of ``pattern``, leftmost and non-overlapping, as spans with their contexts.
    Values and the gaps between them give the offsets and the text before a span."""

    def window(values: Column, gaps: Column, i: Column, back: int | None) -> Column:
        """The text from ``back`` matches before on, or from its start."""
        first, size = (F.lit(1), i) if back is None else (F.greatest(i - back, F.lit(0)) + 1, F.least(i, F.lit(back)))
        pieces = F.zip_with(F.slice(gaps, first, size), F.slice(values, first, size), lambda g, v: F.concat(g, v))
        return F.concat(F.array_join(pieces, ""), F.get(gaps, i))

    def two_words(near: Column) -> Column:
        return F.rlike(F.reverse(near), F.lit(rf"^{_SPACE}++{_WORD}++{_SPACE}++{_WORD}++{_SPACE}"))

    def before(values: Column, gaps: Column, i: Column) -> Column:
        near = F.concat(
            F.when(i > 1, F.concat(F.get(gaps, i - 2), F.get(values, i - 2))).otherwise(""),
            F.when(i > 0, F.concat(F.get(gaps, i - 1), F.get(values, i - 1))).otherwise(""), F.get(gaps, i),
        )
        # two matches before hold two words, unless several matches share a word
        enough = (i <= 2) | ~F.rlike(F.right(near, F.lit(1)), F.lit(_SPACE)) | two_words(near)
        wider = F.when(enough, near)
        for back in _BACK:
            wider = wider.when(two_words(window(values, gaps, i, back)), window(values, gaps, i, back))
        return wider.otherwise(window(values, gaps, i, None))

    def placed(values: Column, gaps: Column, steps: Column, blocks: Column) -> Column:
        def span(value: Column, i: Column) -> Column:
            block = F.floor(i / _BLOCK).cast("int")
            start = F.get(blocks, block) + _sum(F.slice(steps, block * _BLOCK + 1, i % _BLOCK)) + F.length(F.get(gaps, i))
            return F.struct(
                F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(value)).alias("end"),
                value.alias("value"), _context(before(values, gaps, i)).alias("context"),
            )

        return F.transform(values, span)

    def stepped(values: Column, gaps: Column) -> Column:
        steps = F.zip_with(
            F.slice(gaps, F.lit(1), F.size(values)), values, lambda g, v: (F.length(g) + F.length(v)).cast("bigint")
        )
        return _let(steps, lambda s: _let(_block_starts(s), lambda b: placed(values, gaps, s, b)))

    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return _let(values, lambda v: _let(F.split(text, pattern, -1), lambda g: stepped(v, g)))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _small_parts(value: Column) -> Column:
    def small(part: Column) -> Column:
        short = F.regexp_replace(part, "^0+", "")
        return (F.length(short) <= 3) & (F.coalesce(short.try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(value, "[.]"), small)


def _luhn(value: Column) -> Column:
    digits = F.reverse(_digits(value))

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, i, F.lit(1)).cast("int")
        doubled = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return total + F.when(i % 2 == 1, digit).otherwise(doubled)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def base_spans(text: Column) -> Column:
    """The base spans of a text, by kind as listed in ``KINDS``, then by start."""
    none = F.array().cast(f"array<{_SPAN}>")
    email = F.when(text.contains("@"), matches(text, EMAIL, "email")).otherwise(none)
    ip = F.when(
        text.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"),
        F.filter(matches(text, IP, "ip"), lambda s: _small_parts(s["value"])),
    ).otherwise(none)
    card = F.when(
        text.rlike(CARD), F.filter(matches(text, CARD, "card"), lambda s: _luhn(s["value"]))
    ).otherwise(none)
    phone = F.when(
        text.rlike(r"\+[0-9]"),
        F.filter(matches(text, PHONE, "phone"), lambda s: F.length(_digits(s["value"])).between(9, 15)),
    ).otherwise(none)
    return F.concat(email, ip, card, phone)


def _context(left: Column) -> Column:
    """The two words before a span, if there are two and the span starts a new word.

    Read backwards, so that the time is linear in the words.
    """
    return F.reverse(F.regexp_extract(F.reverse(left), rf"^{_SPACE}++({_WORD}++{_SPACE}++{_WORD}++)", 1))


def found_spans(docs: DataFrame) -> DataFrame:
    """(row_key, doc_id, base, others): base spans, and the tokens that lie outside them.

    ``row_key`` stands for (doc_id, text); equal rows share it and their spans.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).select(
        "doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "text", base_spans(F.col("text")).alias("base")
    )
    tokens = F.when(F.col("text").rlike("[0-9]"), matches(F.col("text"), TOKEN, "token")).otherwise(
        F.array().cast(f"array<{_SPAN}>")
    )

    def free(t: Column) -> Column:
        apart = ~F.exists(F.col("base"), lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))
        return (F.length(t["value"]) >= 4) & apart

    def short(s: Column) -> Column:
        return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
                        s["value"].alias("value"), s["context"].alias("context"))

    return rows.select(
        "row_key", "doc_id", F.transform("base", short).alias("base"),
        F.transform(F.filter(tokens, free), short).alias("others"),
    )


def learned(found: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, seeds: int = SEEDS) -> DataFrame:
    """(context, value, kind) of the tokens that contexts give away as identifiers.

    Works on distinct (kind, context, value), so copies of a text count once and no join
    key holds more rows than there are different tokens. Each round writes its scores.
    """
    spans = found.select(F.explode(F.concat("base", "others")).alias("s")).select("s.*").filter("context <> ''")
    edges = stage(spans.select("kind", "context", "value").distinct(), "pii-edges")
    base = edges.filter("kind <> 'token'").groupBy("context", "kind").agg(F.count("*").alias("seeds"))
    base = stage(base.select("context", "kind", "seeds", F.lit(0.0).alias("sure"), F.lit(0).cast("long").alias("firm")), "pii-contexts")
    tokens = edges.filter("kind = 'token'").select("context", "value")
    sizes = tokens.groupBy("context").agg(F.count("*").alias("tokens"))
    support, graph = base, None
    for _ in range(rounds):
        scores = support.filter(F.col("seeds") + F.col("firm") >= seeds).join(sizes, "context").select(
            "context", "kind", ((F.col("seeds") + F.col("sure")) / (F.col("seeds") + F.col("tokens") + 1)).alias("score")
        )
        graph = stage(tokens.join(scores, "context"), "pii-graph")
        if graph.isEmpty():
            break
        sure = stage(graph.groupBy("value", "kind").agg(
            (1 - F.exp(F.sum(F.log1p(-F.least("score", F.lit(0.999)))))).alias("confidence")
        ), "pii-sure")
        # what was found supports every context it stands in, trusted before or not
        found_in = tokens.join(sure, "value").groupBy("context", "kind").agg(
            F.lit(0).cast("long").alias("seeds"), F.sum("confidence").alias("sure"), F.count_if(F.col("confidence") >= confidence).alias("firm")
        )
        support = base.unionByName(found_in).groupBy("context", "kind").agg(*[F.sum(c).alias(c) for c in ("seeds", "sure", "firm")])
    if graph is None or graph.isEmpty():
        return edges.limit(0).select("context", "value", "kind")
    best = graph.join(sure, ["value", "kind"]).groupBy("context", "value").agg(
        F.max_by("kind", F.struct("confidence", "kind")).alias("kind"), F.max("confidence").alias("c")
    )
    return best.filter(F.col("c") >= confidence).select("context", "value", F.concat(F.lit("context_"), "kind").alias("kind"))


def with_learned(found: DataFrame) -> DataFrame:
    """``found`` with ``spans``: base ones, then learned ones by kind and start."""
    more = (
        found.select("row_key", F.explode("others").alias("s")).select("row_key", "s.context", "s.value", "s.start", "s.end")
        .join(learned(found), ["context", "value"])
        .groupBy("row_key").agg(F.array_sort(F.collect_set(F.struct("kind", "start", "end"))).alias("more"))
    )
    plain = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.join(stage(more, "pii-learned"), "row_key", "left").withColumn(
        "spans", F.concat(plain, F.coalesce("more", F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")))
    )


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stage(found_spans(documents(spark, sf_dir)), "pii-found")
    kinds = F.transform("base", lambda s: s["kind"])
    count = [F.size(F.array_remove(F.array_append(kinds, F.lit("")), k)) for k in KINDS]
    count = [(F.size("base") + 1 - c).cast("long").alias(f"n_{k}") for c, k in zip(count, KINDS)]
    return with_learned(found).select(
        "doc_id", *count, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans")
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of personal data replaced by its kind in brackets.

    Base spans are found again where a text is read; only learned spans come by a join.
    A text without spans, and a null one, stay as they are. Overlapping spans are
    replaced as one, named after the first.
    """
    found = stage(found_spans(docs), "pii-found")
    spans = with_learned(found).filter(F.size("spans") > F.size("base")).select("row_key", "spans").dropDuplicates(["row_key"])
    names = docs.columns
    text = F.coalesce(F.col("text"), F.lit(""))
    key, held = unused(docs, "row_key"), unused(docs, "spans")
    keyed = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), text))
    # written first: its size is known, and a table without learned spans costs no shuffle
    marked = stage(spans.select(F.col("row_key").alias(key), F.col("spans").alias(held)), "pii-marked")
    joined = keyed if marked.isEmpty() else keyed.join(marked, key, "left")
    if held not in joined.columns:
        joined = joined.withColumn(held, F.lit(None).cast("array<struct<kind:string,start:bigint,end:bigint>>"))
    base = F.transform(base_spans(F.col("text")), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    more = F.transform(held, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    joined = joined.withColumn(held, F.array_sort(F.coalesce(more, base)))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        fresh = F.concat(acc["out"], F.array(F.concat(gap, F.lit("["), F.upper(s["kind"]), F.lit("]"))))
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))
    clean = F.aggregate(
        F.col(held), start, step,
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text"))),
    )
    changed = F.when(F.size(held) > 0, clean).otherwise(F.col("text"))
    return joined.withColumn("text", changed).select(*names)
