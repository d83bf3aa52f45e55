"""Spike alerts on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mentionlake.operators.alerts import cool_down, window_counts
from mentionlake.staging import scratch
from mentionlake.streaming.state import BatchTable


class StreamingAlerts:
    """Counts posts per window as the watermark closes it, and fires alerts.

    Alerts are kept per micro-batch below ``folder``; the last one of each project is all
    the cool-down needs to know of earlier batches.
    """

    def __init__(self, spark: SparkSession, folder: str, window_seconds: int, threshold: int, cooldown_seconds: int):
        self.window_seconds, self.threshold, self.cooldown_seconds = window_seconds, threshold, cooldown_seconds
        self.alerts = BatchTable(spark, f"{folder.rstrip('/')}/alerts", "projectId string, window_start timestamp, n bigint")

    def process(self, counts: DataFrame, batch: int) -> None:
        with scratch(self.alerts.spark):
            self._process(counts, batch)

    def _process(self, counts: DataFrame, batch: int) -> None:
        spikes = counts.filter(F.col("n") >= self.threshold).select("projectId", "window_start", "n")
        last = None
        if not self.alerts.empty(batch):
            last = self.alerts.read(batch).groupBy("projectId").agg(F.max("window_start").alias("window_start"))
        self.alerts.write(cool_down(spikes, self.cooldown_seconds, last=last), batch)

    def start(self, posts: DataFrame, watermark: str, checkpoint: str, **trigger) -> StreamingQuery:
        """``posts``: a streaming frame with projectId and ts."""
        counts = window_counts(posts.withWatermark("ts", watermark), self.window_seconds)
        writer = counts.writeStream.outputMode("append").foreachBatch(lambda rows, n: self.process(rows, n))
        return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def read_alerts(self) -> DataFrame:
        return self.alerts.read(1 << 62).drop("batch")
