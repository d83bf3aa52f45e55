"""Text expressions: matching text, tokens and their hashes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points Python's str.split() treats as white space.
WHITESPACE = r"\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for ``body``.

    Inside a lambda the optimizer would evaluate an inlined ``value`` again for every
    element; as the element of a one-element array it is evaluated once per row.
    """
    return F.transform(F.array(value), body)[0]


def match_text(title: str | Column = "title", content: str | Column = "content") -> Column:
    """Title and content with one space between, null if either is null."""
    title = F.col(title) if isinstance(title, str) else title
    content = F.col(content) if isinstance(content, str) else content
    return F.concat(title, F.lit(" "), content)


def words(text: Column) -> Column:
    """Whitespace-separated pieces, no empty ones."""
    return F.filter(F.split(text, f"[{WHITESPACE}]+"), lambda w: w != "")


def is_blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(f"[^{WHITESPACE}]")


def hash_tokens(text: Column) -> Column:
    """Lower-case words without punctuation; ``a-b`` becomes ``ab``."""
    bare = F.regexp_replace(F.lower(text), rf"[^\p{{L}}\p{{N}}_{WHITESPACE}]+", "")
    return words(bare)


def token_hash(token: Column) -> Column:
    """Low 64 bits of md5 as the bigint with the same bits."""
    return F.conv(F.substring(F.md5(token), 17, 16), 16, -10).cast("bigint")


def id_hash(value: Column) -> Column:
    """32 bits of md5, the same in any engine, for repeatable labels and parts."""
    return F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("bigint")
