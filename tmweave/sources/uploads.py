"""Upload events (S1, S2) and object metadata lookup (S3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tmweave import schemas
from tmweave.session import materialize


def _reader(spark: SparkSession, schema: str, streaming: bool, multi_line: bool):
    r = spark.readStream if streaming else spark.read
    return r.schema(schema).option("multiLine", str(multi_line).lower())


def read_upload_notifications(spark: SparkSession, path: str, *, streaming: bool = False,
                              multi_line: bool = False) -> DataFrame:
    """Notification JSON documents, one output row per element of ``Records``.

    Output: bucket, raw_key (still encoded), event_name, event_time, size,
    record_pos (position in its document, so multi-record order is kept).
    """
    df = _reader(spark, schemas.UPLOAD_NOTIFICATION, streaming, multi_line).json(path)
    return uploads_from_notifications(df)


def uploads_from_notifications(df: DataFrame) -> DataFrame:
    """One row per element of ``Records`` (other columns of ``df`` are kept)."""
    keep = [c for c in df.columns if c != "Records"]
    rec = df.select(*keep, F.posexplode("Records").alias("record_pos", "r"))
    return rec.select(
        *keep,
        F.col("r.s3.bucket.name").alias("bucket"),
        F.col("r.s3.object.key").alias("raw_key"),
        F.col("r.eventName").alias("event_name"),
        F.col("r.eventTime").alias("event_time"),
        F.col("r.s3.object.size").alias("size"),
        "record_pos",
    )


def read_audit_events(spark: SparkSession, path: str, *, streaming: bool = False,
                      multi_line: bool = False) -> DataFrame:
    """Audit-log upload events (nested struct, see ``schemas.AUDIT_EVENT``)."""
    return _reader(spark, schemas.AUDIT_EVENT, streaming, multi_line).json(path)


def attach_object_metadata(uploads: DataFrame, manifest: DataFrame) -> DataFrame:
    """Content type of each upload from a ``(bucket, key, content_type)``
    manifest; a missing object leaves it NULL.

    A plain left equi-join: the optimizer broadcasts the manifest only while its
    estimated size is under ``spark.sql.autoBroadcastJoinThreshold`` and shuffles
    both sides otherwise.  The manifest is de-duplicated per object first so the
    join can never multiply uploads.
    """
    m = (manifest.groupBy("bucket", "key")
         .agg(F.max("content_type").alias("content_type")))
    return uploads.join(m, ["bucket", "key"], "left")


def attach_metadata_as_of(uploads: DataFrame, versions: DataFrame, *, event_time: str = "event_time",
                          modified_at: str = "modified_at") -> DataFrame:
    """S3/J4 as a point-in-time lookup: the content type that each upload's object had when the
    upload took place.

    ``versions`` holds a row per write of an object (bucket, key, ``modified_at``, content_type);
    an upload gets the newest one not after its ``event_time`` (one of the same time counts; of
    several written at one time, the greatest content type).  A newest version without content
    type, no earlier version, or a null key or time leaves it NULL.  Every upload row is kept,
    repeats included; a column ``content_type`` of ``uploads`` is replaced.

    Uploads and versions are sorted together by (bucket, key, time) into ranges, which are
    written, and each range is merged on its own; what a range needs from earlier ones is
    the last version of its first object.  An object that holds most rows is so spread
    over many ranges.
    """
    cols = [c for c in uploads.columns if c != "content_type"]
    kept = F.struct(*[F.col(c) for c in cols])
    # Ties of one object and time are dealt by content, so that they can be cut between ranges.
    plain = [f.name for f in uploads.schema.fields if f.name in cols and "map<" not in f.dataType.simpleString()
             and "variant" not in f.dataType.simpleString()]
    ups = uploads.select("bucket", "key", F.col(event_time).alias("t"), F.lit(1).alias("kind"),
                         F.xxhash64(*plain).alias("tie"), kept.alias("u"))
    vers = (versions.where(F.col("bucket").isNotNull() & F.col("key").isNotNull() & F.col(modified_at).isNotNull())
            .groupBy("bucket", "key", F.col(modified_at).alias("t"))
            .agg(F.max("content_type").alias("content_type"))
            .select("bucket", "key", "t", F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("tie"),
                    F.struct("content_type").alias("version")))
    order = ["bucket", "key", "t", "kind", "tie"]
    both = materialize(ups.unionByName(vers, allowMissingColumns=True).repartitionByRange(*order)
                       .withColumn("part", F.spark_partition_id()), "as-of")
    here = Window.partitionBy("part", "bucket", "key").orderBy("t", "kind") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = both.withColumn("version", F.last("version", True).over(here)).where("kind = 1")
    # At most one object per range begins in an earlier one: its first.  So ``firsts``, ``ends``
    # and ``before`` are bounded by the number of ranges, or twice that.
    firsts = (both.groupBy("part").agg(F.min(F.struct("bucket", "key")).alias("f"))
              .select("f.bucket", "f.key").distinct())
    ends = (both.join(F.broadcast(firsts), ["bucket", "key"], "left_semi").groupBy("part", "bucket", "key")
            .agg(F.max_by("version", F.when(F.col("kind") == 0, F.col("t"))).alias("version")))
    earlier = Window.partitionBy("bucket", "key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = (ends.withColumn("carried", F.last("version", True).over(earlier))
              .where("carried is not null").select("part", "bucket", "key", "carried"))
    timed = F.col("t").isNotNull()
    return (merged.join(F.broadcast(before), ["part", "bucket", "key"], "left")
            .select(*[F.col("u")[c].alias(c) for c in cols],
                    F.when(timed, F.coalesce("version", "carried")["content_type"]).alias("content_type")))
