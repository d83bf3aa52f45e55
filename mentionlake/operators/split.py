"""Batches that are rows already: one row per post, the batch fields repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mentionlake.functions.ids import name_uuid


def with_exclusions(batches: DataFrame) -> DataFrame:
    """``risk_words`` wins over ``exclusions`` unless it is null; neither gives ``[]``."""
    given = [c for c in ("risk_words", "exclusions") if c in batches.columns]
    value = F.coalesce(*given, F.array().cast("array<string>"))
    return batches.withColumn("exclusions", value).drop("risk_words")


def split_batches(batches: DataFrame) -> DataFrame:
    """``batches``: batch_id, projectId, keywords, exclusions, posts[]; adds pos and the
    id derived from (projectId, batch_id, pos). A batch without posts gives no row."""
    none = F.array().cast("array<string>")
    rows = batches.select(
        "batch_id",
        F.coalesce("projectId", F.lit("")).alias("projectId"),
        F.coalesce("keywords", none).alias("keywords"),
        F.coalesce("exclusions", none).alias("exclusions"),
        F.posexplode("posts").alias("pos", "post"),
    )
    texts = [F.coalesce(f"post.{c}", F.lit("")).alias(c) for c in ("title", "content", "type", "url_string")]
    post_id = name_uuid(F.concat_ws("#", "projectId", "batch_id", "pos"))
    return rows.select(post_id.alias("post_id"), "batch_id", "pos", "projectId", "keywords", "exclusions", *texts)
