"""Corpus pipeline: quality, near duplicates, decontamination, secrets, mixture.

Every stage takes all rows that the stage before kept, as a Parquet table, and all but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tmweave.llm.common import saved, table
from tmweave.llm.decontam import decontaminate
from tmweave.llm.mixing import mix, word_count
from tmweave.llm.near_dup import keep_first
from tmweave.llm.quality import keep_good
from tmweave.llm.secret_scan import redact


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from ``labels``, does not reject."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced; ``n_chars`` follows the text."""
    out = redact(docs, scope=None)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture takes, with ``taken`` words (repeats counted)."""
    return mix(docs, word_count(F.col("text")), keep=docs.columns).where("taken > 0")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination),
          ("secrets", secrets), ("mixture", mixture)]

# The classifier can't be written in SQL.  Each stage's operator has its own tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's rows written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
