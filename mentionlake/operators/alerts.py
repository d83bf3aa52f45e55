"""Spike alerts with a threshold and a cool-down, and health counts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mentionlake.staging import stage, stage_counted


def window_counts(posts: DataFrame, window_seconds: int, ts: str = "ts", project: str = "projectId") -> DataFrame:
    """Posts per project and tumbling window; works on streams with a watermark too."""
    counted = posts.groupBy(project, F.window(ts, f"{window_seconds} seconds").alias("w")).agg(F.count("*").alias("n"))
    return counted.select(project, F.col("w.start").alias("window_start"), "n")


def cool_down(
    spikes: DataFrame, cooldown_seconds: int, project: str = "projectId", last: DataFrame | None = None
) -> DataFrame:
    """Drop spikes less than the cool-down after the last alert of their project.

    ``last``: (project, window_start) of alerts fired before; spikes come after them.
    ``spikes`` has one row per project and window.

    Whichever spikes fired before, one that follows a gap of the cool-down fires: it begins
    a run. In a run every spike points to the next that may fire after it, and the spikes
    that fire are those reached from the first. They are marked by doubling the pointers,
    so rounds grow with the logarithm of the longest run.
    """
    step = max(cooldown_seconds * 1_000_000, 1)
    rows = spikes.withColumn("_at", F.unix_micros("window_start"))
    if last is not None:
        before = last.select(F.col(project).alias("_p"), F.unix_micros("window_start").alias("_last"))
        rows = rows.join(before, F.col(project).eqNullSafe(F.col("_p")), "left").filter(
            F.col("_last").isNull() | (F.col("_at") - F.col("_last") >= step)
        ).drop("_p", "_last")
    rows = stage(rows, "spikes")

    in_time = Window.partitionBy("p").orderBy("at")
    begins = F.coalesce(F.col("at") - F.lag("at").over(in_time) >= step, F.lit(True))
    runs = rows.select(F.col(project).alias("p"), F.col("_at").alias("at")).withColumn("fires", begins).withColumn(
        "run", F.sum(F.col("fires").cast("int")).over(in_time)
    )
    # from the latest on, so that the frame only grows; a preceding row is a later spike
    later = Window.partitionBy("p", "run").orderBy(F.col("at").desc()).rangeBetween(Window.unboundedPreceding, -step)
    marked, moving = stage_counted(
        runs.withColumn("to", F.min("at").over(later)).drop("run"), "pointers", F.col("to")
    )
    while moving:
        onward = marked.select(F.col("p").alias("p2"), F.col("at").alias("at2"), F.col("to").alias("further"))
        hits = marked.filter("fires AND to IS NOT NULL").select(F.col("p").alias("p3"), F.col("to").alias("hit"))
        doubled = marked.join(onward, F.col("p").eqNullSafe(F.col("p2")) & (F.col("to") == F.col("at2")), "left")
        doubled = doubled.join(hits, F.col("p").eqNullSafe(F.col("p3")) & (F.col("at") == F.col("hit")), "left")
        marked, moving = stage_counted(
            doubled.select("p", "at", (F.col("fires") | F.col("hit").isNotNull()).alias("fires"), F.col("further").alias("to")),
            "pointers", F.col("to"),
        )
    fired = marked.filter("fires").select("p", "at")
    on = F.col(project).eqNullSafe(F.col("p")) & (F.col("_at") == F.col("at"))
    return rows.join(fired, on, "left_semi").select(*spikes.columns)


def spike_alerts(
    posts: DataFrame, window_seconds: int, threshold: int, cooldown_seconds: int,
    ts: str = "ts", project: str = "projectId",
) -> DataFrame:
    counts = window_counts(posts, window_seconds, ts, project)
    return cool_down(counts.filter(F.col("n") >= threshold), cooldown_seconds, project)


def health(stages: Mapping[str, DataFrame], last_seen: Column, *by: str) -> DataFrame:
    """Rows and last activity per stage (and ``by``), one row each."""
    out = None
    for name, rows in stages.items():
        counted = rows.groupBy(*by).agg(F.count("*").alias("n"), F.max(last_seen).alias("last_seen"))
        counted = counted.select(F.lit(name).alias("stage"), *by, "n", "last_seen")
        out = counted if out is None else out.unionByName(counted)
    return out
