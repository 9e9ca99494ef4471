"""Access to the sample tables and the stand-in inputs derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values used when sample tables stand in for pipeline inputs.
DOCUMENTS_BUCKET = "translation-memory-docs"
TARGET_LANGUAGE = "es"
SOURCE_LANGUAGE = "en"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A sample table as a streaming file source, be it one file or a folder of part files.

    The glob matches just that name: a stream takes a path without one for a folder."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir.rstrip('/')}/[{name[0]}]{name[1:]}.parquet")


def conversation_sections(spark: SparkSession, sf_dir: str,
                          source: DataFrame | None = None) -> DataFrame:
    """``conversations`` as translated sections: conversation = document, turn =
    section id, text = translation, confidence derived from the text length."""
    c = source if source is not None else table(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").alias("document_id"),
        F.col("turn").alias("section_id"),
        F.col("text").alias("translated_text"),
        # (length mod 64) / 64 is dyadic: sums and means are exact and identical in
        # any summation order, so engines agree to the last bit.
        ((F.length("text") % 64).cast("double") / F.lit(64.0)).alias("confidence"),
    )


def conversation_documents(sections: DataFrame) -> DataFrame:
    """One document row per conversation, with its request fields."""
    return sections.select("document_id").distinct().select(
        "document_id",
        F.lit(DOCUMENTS_BUCKET).alias("bucket"),
        F.concat(F.lit("documents/"), F.col("document_id").cast("string"), F.lit(".txt"))
        .alias("original_key"),
        F.lit(SOURCE_LANGUAGE).alias("source_language"),
        F.lit(TARGET_LANGUAGE).alias("target_language"),
    )


# How ``events`` rows stand in for audit-log upload events.
TMX_BUCKET = "translation-memory-tmx"
OTHER_BUCKET = "unrelated-bucket"
EVENT_NAME_BY_TYPE = {
    "click": "PutObject",
    "purchase": "CompleteMultipartUpload",
    "view": "GetObject",
    "signup": "PutObject",
    "error": "DeleteObject",
}
# Object kind by document language (extension, content type).
OBJECT_BY_LANG = {
    "en": (".txt", "text/plain"),
    "fr": (".pdf", "application/pdf"),
    "de": (".docx", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"),
    "es": (".jpg", "image/jpeg"),
}


def _case(column: str, mapping: dict[str, str], default=None):
    expr = F.lit(default)
    for k, v in reversed(list(mapping.items())):
        expr = F.when(F.col(column) == F.lit(k), F.lit(v)).otherwise(expr)
    return expr


def events_as_audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` rows as audit-log events (schema ``schemas.AUDIT_EVENT``).

    Event type picks the API call and the range of ``props.k`` the bucket (below
    34: documents, below 67: TM, else an unrelated one); the object key is built
    from user and event ids.  Every event is kept; routing decides.
    """
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    bucket = (F.when(k < 34, F.lit(DOCUMENTS_BUCKET))
              .when(k < 67, F.lit(TMX_BUCKET)).otherwise(F.lit(OTHER_BUCKET)))
    key = F.concat(F.lit("uploads/"), F.col("user_id").cast("string"), F.lit("/"),
                   F.col("event_id").cast("string"), F.lit(".txt"))
    return e.select(
        "event_id",
        F.lit("aws.s3").alias("source"),
        F.lit("AWS API Call via CloudTrail").alias("detail-type"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("time"),
        F.struct(
            F.lit("s3.amazonaws.com").alias("eventSource"),
            _case("event_type", EVENT_NAME_BY_TYPE).alias("eventName"),
            F.struct(bucket.alias("bucketName"), key.alias("key")).alias("requestParameters"),
        ).alias("detail"),
    )


def page_uploads(spark: SparkSession, sf_dir: str,
                 source: DataFrame | None = None) -> DataFrame:
    """``pages.url`` as uploads: host = bucket, path = (encoded) object key."""
    p = source if source is not None else table(spark, sf_dir, "pages")
    return p.select(
        "page_id",
        F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1).alias("bucket"),
        F.regexp_extract("url", r"^[a-z]+://[^/]+/(.*)$", 1).alias("raw_key"),
    )


def document_objects(spark: SparkSession, sf_dir: str,
                     source: DataFrame | None = None) -> DataFrame:
    """``documents`` as uploaded objects with a content type by language."""
    d = source if source is not None else table(spark, sf_dir, "documents")
    ext = _case("lang", {k: v[0] for k, v in OBJECT_BY_LANG.items()}, ".bin")
    ctype = _case("lang", {k: v[1] for k, v in OBJECT_BY_LANG.items()})
    return d.select(
        F.lit(DOCUMENTS_BUCKET).alias("bucket"),
        F.concat(F.lit("documents/"), F.col("doc_id").cast("string"), ext).alias("raw_key"),
        ctype.alias("content_type"),
    )


def upload_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Object metadata: every document object, and page objects whose path ends in
    ``.html`` (``text/html``) or ``/`` (``application/octet-stream``).  Other page
    objects have no metadata record."""
    pages = page_uploads(spark, sf_dir)
    page_ct = (F.when(F.col("raw_key").endswith(".html"), F.lit("text/html"))
               .when(F.col("raw_key").endswith("/"), F.lit("application/octet-stream")))
    page_m = pages.select("bucket", F.col("raw_key").alias("key"), page_ct.alias("content_type"))
    docs = document_objects(spark, sf_dir).select(
        "bucket", F.col("raw_key").alias("key"), "content_type")
    return page_m.filter(F.col("content_type").isNotNull()).unionByName(docs)


def object_versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``events`` as uploads (clicks) and as writes of objects (signups and purchases); the object
    is the user's, written several times, with a content type by the event id."""
    e = table(spark, sf_dir, "events")
    obj = [F.lit(DOCUMENTS_BUCKET).alias("bucket"),
           F.concat(F.lit("uploads/"), F.col("user_id").cast("string")).alias("key")]
    kind = F.col("event_id") % 4
    ctype = (F.when(kind == 0, "text/plain").when(kind == 1, "image/png").when(kind == 2, "application/pdf"))
    ups = e.where("event_type = 'click'").select("event_id", *obj, F.col("ts").alias("event_time"))
    return ups, e.where("event_type in ('signup', 'purchase')").select(
        *obj, F.col("ts").alias("modified_at"), ctype.alias("content_type"))


def timed_uploads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The uploads of ``page_uploads`` and ``document_objects``, one a second, and the metadata
    events of those that ``upload_manifest`` lists, half a minute behind."""
    def at(i, seconds=0):
        return F.timestamp_seconds(F.lit(1_704_067_200 + seconds) + i)
    pages = page_uploads(spark, sf_dir).select("bucket", "raw_key", F.col("page_id").alias("i"))
    docs = document_objects(spark, sf_dir).select(
        "bucket", "raw_key", F.regexp_extract("raw_key", r"(\d+)", 1).cast("bigint").alias("i"))
    ups = pages.union(docs)
    listed = ups.withColumnRenamed("raw_key", "key").join(
        upload_manifest(spark, sf_dir).groupBy("bucket", "key").agg(F.max("content_type").alias("content_type")),
        ["bucket", "key"])
    return (ups.select("bucket", "raw_key", at(F.col("i")).alias("event_time")),
            listed.select("bucket", "key", "content_type", at(F.col("i"), 30).alias("modified_at")))


def tm_from_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A translation memory from ``embeddings`` (vectors, stored score
    ``label / 10``) with the text of the document of the same id as translation
    (NULL where no such document exists)."""
    e = table(spark, sf_dir, "embeddings")
    # has_translation is derived before the join, so a search that needs only the
    # flag does not move the texts.
    d = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("tm_id"), F.col("text").alias("translation"),
        (F.coalesce(F.col("text"), F.lit("")) != F.lit("")).alias("has_translation"))
    return (e.select(F.col("vec_id").alias("tm_id"), "embedding",
                     (F.col("label").cast("double") / F.lit(10.0)).alias("score"))
            .join(d, "tm_id", "left"))


def benchmark_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``benchmark`` items as one-section documents to translate en -> es."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("document_id"),
                    F.lit(0).alias("section_id"),
                    F.col("text").alias("section"),
                    F.lit(SOURCE_LANGUAGE).alias("source_language"),
                    F.lit(TARGET_LANGUAGE).alias("target_language"))


def document_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as translation requests: own language -> es (en for es)."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("document_id"), "text",
        F.lit(DOCUMENTS_BUCKET).alias("bucket"),
        F.concat(F.lit("documents/"), F.col("doc_id").cast("string"), F.lit(".txt"))
        .alias("original_key"),
        F.col("lang").alias("source_language"),
        F.when(F.col("lang") == F.lit(TARGET_LANGUAGE), F.lit(SOURCE_LANGUAGE))
        .otherwise(F.lit(TARGET_LANGUAGE)).alias("target_language"))


def write_tmx_documents(units_xml: DataFrame, path: str) -> None:
    """Write ``<tu>`` strings (column ``value``) as TMX files, one well-formed
    document per partition (root, header and body around that partition's units).
    Used to produce TMX input from the sample tables."""
    import pandas as pd

    head = '<?xml version="1.0" encoding="UTF-8"?>\n<tmx version="1.4"><header/><body>'

    def wrap(batches):
        yield pd.DataFrame({"value": [head]})
        for pdf in batches:
            yield pdf[["value"]]
        yield pd.DataFrame({"value": ["</body></tmx>"]})

    units_xml.select("value").mapInPandas(wrap, "value string").write.mode("overwrite").text(path)
