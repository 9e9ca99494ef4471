"""TMX translation-memory files (S4) and the file-level checks they need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tmweave import schemas

CORRUPT = "_corrupt_record"
# Error texts of empty, unreadable and malformed TMX files.
EMPTY_FILE_ERROR = "TMX file is empty or could not be read"
MALFORMED_ERROR = "Malformed TMX content"


UNIT_START = r"<tu[\s>/]"


def read_tmx_pieces(spark: SparkSession, path: str, *, streaming: bool = False) -> DataFrame:
    """Text of TMX files (UTF-8), cut behind every ``</tu>``: columns ``piece`` and ``file_path``.

    The text source splits large files, so one file may be read by many tasks.  The rows of a
    file hold all of its text, its head and its end included.
    """
    r = spark.readStream if streaming else spark.read
    return (r.option("lineSep", "</tu>").text(path)
            .select(F.col("value").alias("piece"), F.col("_metadata.file_path").alias("file_path")))


def tmx_units(pieces: DataFrame) -> DataFrame:
    """S4 + G3: one row per ``<tu>`` of ``read_tmx_pieces``, each parsed alone.

    Surrounding spaces of ``seg`` text are kept and entities decoded; a unit that cannot be
    parsed, or is not closed, keeps its raw text in ``_corrupt_record`` and leaves the units
    around it untouched.  A piece without ``<tu>`` gives no row.
    """
    parts = F.filter(F.split("piece", f"(?={UNIT_START})"), lambda p: p.rlike(f"^{UNIT_START}"))
    units = (pieces.select("file_path", F.posexplode(parts).alias("_i", "xml"),
                           F.size(parts).alias("_n"))
             # Only the last unit of a piece lost its end tag to the cut.
             .withColumn("xml", F.when(F.col("_i") == F.col("_n") - 1,
                                       F.concat("xml", F.lit("</tu>"))).otherwise(F.col("xml"))))
    return parse_units(units.select("file_path", "xml")).select("tuv", CORRUPT, "file_path")


def read_tmx(spark: SparkSession, path: str, *, streaming: bool = False) -> DataFrame:
    """The units (``tmx_units``) of the TMX files under ``path``."""
    return tmx_units(read_tmx_pieces(spark, path, streaming=streaming))


def file_errors(pieces: DataFrame) -> DataFrame:
    """G5 per file: (file_path, error) of every file without ``tmx`` and ``body`` elements that
    both open and close.  Such a file contributes no pair."""
    def seen(pattern):
        return F.max(F.col("piece").rlike(pattern))

    whole = (seen(r"<tmx[\s>]") & seen(r"<body[\s>/]") & seen(r"</tmx\s*>")
             & seen(r"</body\s*>|<body\s*/>"))
    return (pieces.groupBy("file_path").agg(whole.alias("whole")).where(~F.col("whole"))
            .select("file_path", F.lit(MALFORMED_ERROR).alias("error")))


def parse_units(df: DataFrame, xml_col: str = "xml") -> DataFrame:
    """``from_xml`` of ``<tu>`` strings into the reader's unit shape."""
    parsed = F.from_xml(F.col(xml_col), f"{schemas.TMX_UNIT}, {CORRUPT} string",
                        {"ignoreSurroundingSpaces": "false", "mode": "PERMISSIVE",
                         "columnNameOfCorruptRecord": CORRUPT})
    return (df.withColumn("_u", parsed)
            .withColumn("tuv", F.col("_u.tuv"))
            .withColumn(CORRUPT, F.col(f"_u.{CORRUPT}"))
            .drop("_u", xml_col))


def empty_files(spark: SparkSession, path: str) -> DataFrame:
    """Zero-length files under ``path`` (Spark's file sources skip them).

    Lists through the Hadoop file system on the driver, as every file source
    does when it plans a scan; only names and sizes are read.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    found = []
    if fs.exists(p):
        it = fs.listFiles(p, True)
        while it.hasNext():
            st = it.next()
            name = st.getPath().getName()
            if st.getLen() == 0 and not name.startswith((".", "_")):
                found.append((st.getPath().toString(), EMPTY_FILE_ERROR))
    return spark.createDataFrame(found, "file_path string, error string")
