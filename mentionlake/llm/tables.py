"""Input tables of the operators, reduced to the columns they read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDS = 5


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text) of every document."""
    return texts_of(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def unused(frame: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until no column is called so."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fifth of the documents whose labels no model may learn from."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(text) % FOLDS == 0


def labels_of(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """(doc_id, label) with one row per document; repeated labels are averaged."""
    table = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return (
        table.select("doc_id", F.col(kind).cast("double").alias("label"))
        .dropna().groupBy("doc_id").agg(F.avg("label").alias("label"))
    )
