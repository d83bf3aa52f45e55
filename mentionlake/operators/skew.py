"""A lookup join that stays balanced when one key holds much of the left side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mentionlake.staging import stage

ROWS_PER_SALT = 1_000_000


def shuffled(table: DataFrame) -> DataFrame:
    """``table`` as a side of a join that is never broadcast: one that grows with the data.

    Columns of few values or of numbers in order take a few bytes a row as a file and a hundred
    as a hash table, so the planner would broadcast it by the size of its files and pass it
    whole through the driver.
    """
    return table.hint("merge")


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    row_key: str,
    how: str = "inner",
    rows_per_salt: int = ROWS_PER_SALT,
    left_rows: int | None = None,
) -> DataFrame:
    """``left`` joined with ``right``, which has at most one row per ``key``.

    Keys are counted first, combined before the shuffle. One with more than
    ``rows_per_salt`` rows is split over as many salts as it needs, and its single right
    row is repeated for each; all other keys stay as they are. The hot keys are a written
    table, so the planner joins them by their true size; there are none at all if
    ``left_rows``, the known size of the left side, is no more than ``rows_per_salt``.
    """
    if left_rows is not None and left_rows <= rows_per_salt:
        return left.join(right, key, how)
    hot = stage(
        left.groupBy(key).count().filter((F.col("count") > rows_per_salt) & F.col(key).isNotNull())
        .select(key, F.ceil(F.col("count") / rows_per_salt).cast("int").alias("_salts")),
        "hot-keys",
    )
    salted = left.join(hot, key, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(row_key), F.coalesce("_salts", F.lit(1))).cast("int")
    ).drop("_salts")
    repeated = right.join(hot, key, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))
    ).drop("_salts")
    return salted.join(repeated, [key, "_salt"], how).drop("_salt")
