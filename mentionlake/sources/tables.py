"""Reading columnar inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# A table of this size at most is dealt out to all cores after reading, however many.
_SMALL = 64 << 20


def read_table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """The named columns of ``<folder>/<name>.parquet``.

    Text operators cost far more than reading; a table of one split's size is spread over
    the cores first. A larger one is split by its row groups and moves nowhere.
    """
    table = spark.read.parquet(f"{folder}/{name}.parquet")
    table = table.select(*columns) if columns else table
    cores = spark.sparkContext.defaultParallelism
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return table.repartition(cores) if cores > 1 and size < _SMALL else table
