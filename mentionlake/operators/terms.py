"""Keyword lists of any length: one automaton per project instead of one search per keyword."""

from __future__ import annotations

import os
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mentionlake.functions.text import WHITESPACE, match_text
from mentionlake.staging import stage

# Characters of terms that go to the tasks at a time; the rest is searched for in further passes.
BLOCK_CHARACTERS = 8_000_000
_COUNTS = "keywords_found int, exclusions_found int, has_keywords boolean, has_exclusions boolean"
_built: dict = {}


def term_rows(lists: DataFrame, project: str = "projectId") -> DataFrame:
    """Distinct (project, excludes, spaced, term) of ``lists``, terms in lower case, nulls left out.

    ``spaced``: only a keyword with white space can be in the joined words of a text
    without being in the text.
    """
    def of(column: str, excludes: bool) -> DataFrame:
        return lists.select(
            F.col(project).alias("project"), F.lit(excludes).alias("excludes"), F.explode(F.transform(column, F.lower)).alias("term")
        )

    rows = of("keywords", False).unionByName(of("exclusions", True)).filter("term IS NOT NULL")
    spaced = ~F.col("excludes") & F.col("term").rlike(f"[{WHITESPACE}]")
    return rows.select("project", "excludes", spaced.alias("spaced"), "term").distinct()


def _blocks(terms: DataFrame, characters: int) -> Iterator[list[tuple]]:
    """The terms in blocks of at most ``characters``, or of one longer term."""
    block, size = [], 0
    for row in terms.toLocalIterator():
        width = max(len(row["term"]), 1)
        if block and size + width > characters:
            yield block
            block, size = [], 0
        block.append(tuple(row))
        size += width
    if block:
        yield block


def _machines(terms: list[tuple]) -> dict:
    """Per project: the automaton of all its terms, that of those with white space, the
    codes of empty terms, and which kinds it has. An exclusion has an odd code."""
    out: dict = {}
    for number, (project, excludes, spaced, term) in enumerate(terms):
        plain, joined, empty, kinds = out.setdefault(project, (ahocorasick.Automaton(), ahocorasick.Automaton(), [], set()))
        code = 2 * number + excludes
        kinds.add(excludes)
        if not term:
            empty.append(code)
            continue
        for machine in (plain, joined)[: 1 + spaced]:
            machine.add_word(term, (*machine.get(term, ()), code))
    for plain, joined, _, _ in out.values():
        plain.make_automaton()
        joined.make_automaton()
    return out


def _found(machines: dict, project: str | None, low: str | None) -> tuple[int, int, bool, bool]:
    if project not in machines:
        return 0, 0, False, False
    plain, joined, empty, kinds = machines[project]
    seen: set[int] = set()
    if low is not None:
        seen.update(empty)
        for machine, text in ((plain, low), (joined, " ".join(low.split()) if len(joined) else "")):
            if len(machine):
                for _, codes in machine.iter(text):
                    seen.update(codes)
    odd = sum(code & 1 for code in seen)
    return len(seen) - odd, odd, False in kinds, True in kinds


def _counter(terms: Broadcast):
    name = terms._jbroadcast.id() if hasattr(terms, "_jbroadcast") and terms._jbroadcast else id(terms)

    @F.pandas_udf(_COUNTS)
    def count(project: pd.Series, low: pd.Series) -> pd.DataFrame:
        # one set of automata per worker at a time
        if _built.get("of") != (os.getpid(), name):
            _built.update(of=(os.getpid(), name), machines=_machines(terms.value))
        machines = _built["machines"]
        rows = [
            _found(machines, p if isinstance(p, str) else None, t if isinstance(t, str) else None)
            for p, t in zip(project, low)
        ]
        return pd.DataFrame(rows, columns=["keywords_found", "exclusions_found", "has_keywords", "has_exclusions"])

    return count


def mark_terms(
    posts: DataFrame, lists: DataFrame, project: str = "projectId", characters: int = BLOCK_CHARACTERS
) -> DataFrame:
    """Adds ``keywords_found`` and ``exclusions_found``, the numbers of different terms in a
    post's text, and the boolean ``_pass``.

    ``lists``: project, keywords, exclusions. The rule is that of ``prefilter`` without a
    dictionary, for lists of thousands of terms that do not travel with every post: a text is
    read once, whatever the length of the list. Null terms count for nothing; a project
    without terms lets all pass; a null text has none. Posts stay where they are, so a hot
    project is nobody's single task. Terms beyond ``characters`` take another pass each.
    """
    spark = posts.sparkSession
    low = F.lower(match_text())
    marked = None
    for block in _blocks(stage(term_rows(lists, project), "terms"), characters):
        found = _counter(spark.sparkContext.broadcast(block))(F.col(project), low)
        if marked is None:
            marked = posts.withColumn("_found", found)
            continue
        both = stage(marked, "marked").withColumn("_more", found)
        marked = both.withColumn("_found", F.struct(
            *[(F.col(f"_found.{c}") + F.col(f"_more.{c}")).alias(c) for c in ("keywords_found", "exclusions_found")],
            *[(F.col(f"_found.{c}") | F.col(f"_more.{c}")).alias(c) for c in ("has_keywords", "has_exclusions")],
        )).drop("_more")
    if marked is None:
        marked = posts.withColumn("_found", F.expr(
            "named_struct('keywords_found', 0, 'exclusions_found', 0, 'has_keywords', false, 'has_exclusions', false)"
        ))
    kept = ~F.col("_found.has_exclusions") | (low.isNotNull() & (F.col("_found.exclusions_found") == 0))
    wanted = ~F.col("_found.has_keywords") | (F.col("_found.keywords_found") > 0)
    return marked.select(*posts.columns, "_found.keywords_found", "_found.exclusions_found", (kept & wanted).alias("_pass"))
