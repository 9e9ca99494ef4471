"""Document (S5) and translation-memory (S6) readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tmweave import schemas
from tmweave.functions.keys import document_id


def read_documents(spark: SparkSession, path: str, *, fmt: str = "parquet",
                   streaming: bool = False) -> DataFrame:
    """Documents to translate.

    ``parquet``: a table with at least ``document_id`` and ``text``.
    ``text``: one document per file (``wholetext``), ``original_key`` = file path (decoded)
    and ``document_id`` derived from the file name as admission does.
    """
    r = spark.readStream if streaming else spark.read
    if fmt == "parquet":
        return r.parquet(path)
    if fmt != "text":
        raise ValueError(fmt)
    df = r.text(path, wholetext=True)
    # The path is a URI, in which a plus sign stands for itself.
    path = F.try_url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return df.select(document_id(path).alias("document_id"), F.col("value").alias("text"),
                     path.alias("original_key"))


def read_tm(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the TM store written by ``sinks.write_tm``."""
    return spark.read.schema(schemas.TM_RECORD).parquet(path)
