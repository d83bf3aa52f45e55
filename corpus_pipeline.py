"""From raw documents to token ids: quality, near-duplicates, benchmark leaks, personal data, BPE.

``run`` applies the stages in order; each is written as Parquet to the shared folder and
read again as the documents of the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionlake.llm.bpe import digests
from mentionlake.llm.decontaminate import benchmark, without_leaks
from mentionlake.llm.near import without_near_duplicates
from mentionlake.llm.pii import redact
from mentionlake.llm.quality import keep_good
from mentionlake.llm.tables import held_out, labels_of
from mentionlake.staging import stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the classifier scores below its threshold."""
    return keep_good(docs, labels_of(spark, sf_dir, "quality").filter(~held_out()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays whose five-word shingles are alike at 0.8 or more."""
    return without_near_duplicates(docs, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item stands are taken out."""
    return without_leaks(docs, benchmark(spark, sf_dir))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; n_chars follows the new text."""
    clean = redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(clean.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of the token ids of what is left, and of their decoded text."""
    return digests(docs)


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("BPE encoding and decoding", bpe),
]

# The stages learn, hash and merge; SQL can't express them. Tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
