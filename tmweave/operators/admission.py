"""Admission of uploaded documents (F1-F3, P1-P3, C1 pieces)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tmweave.functions.keys import decode_key, document_id

# The event pattern of upload routing.
EVENT_SOURCE = "aws.s3"
EVENT_DETAIL_TYPE = "AWS API Call via CloudTrail"
EVENT_SERVICE = "s3.amazonaws.com"
UPLOAD_EVENT_NAMES = ("PutObject", "CompleteMultipartUpload")
# Accepted content types (case-sensitive substring tests).
ACCEPTED_CONTENT_TYPES = (
    "text",
    "application/pdf",
    "application/msword",
    "application/vnd.openxmlformats-officedocument",
)
# Our deviation: combined outputs are written back under this prefix and would
# otherwise be admitted again.
OUTPUT_PREFIX = "translated/"


def route_uploads(events: DataFrame, routes: dict[str, str]) -> DataFrame:
    """keep upload events of the configured buckets and name their route.

    ``routes`` maps route name to bucket (e.g. documents -> docs bucket, tmx -> TM
    bucket); both routes come out of one scan.  Output adds route, bucket,
    raw_key, event_name, event_time.
    """
    bucket = F.col("detail.requestParameters.bucketName")
    route = F.lit(None).cast("string")
    for name, b in reversed(list(routes.items())):
        route = F.when(bucket == F.lit(b), F.lit(name)).otherwise(route)
    matched = (
        (F.col("source") == F.lit(EVENT_SOURCE))
        & (F.col("`detail-type`") == F.lit(EVENT_DETAIL_TYPE))
        & (F.col("detail.eventSource") == F.lit(EVENT_SERVICE))
        & F.col("detail.eventName").isin(*UPLOAD_EVENT_NAMES)
        & bucket.isin(*routes.values())
    )
    return events.filter(F.coalesce(matched, F.lit(False))).select(
        "*",
        route.alias("route"),
        bucket.alias("bucket"),
        F.col("detail.requestParameters.key").alias("raw_key"),
        F.col("detail.eventName").alias("event_name"),
        F.col("time").alias("event_time"),
    )


def decode_keys(uploads: DataFrame) -> DataFrame:
    """Decoded ``key`` and ``document_id`` from ``raw_key``."""
    return (uploads.withColumn("key", decode_key("raw_key"))
            .withColumn("document_id", document_id("key")))


def content_type_accepted(ct) -> Column:
    """TRUE when the content type names a supported document; NULL -> FALSE."""
    c = F.col(ct) if isinstance(ct, str) else ct
    test = F.lit(False)
    for t in ACCEPTED_CONTENT_TYPES:
        test = test | c.contains(t)
    return F.coalesce(test, F.lit(False))


def rejection_reason(df: DataFrame, exclude_outputs: bool = True) -> Column:
    """Why a row is not admitted (NULL when it is)."""
    ct_text = F.coalesce(F.col("content_type"), F.lit("undefined"))
    reason = F.when(F.col("key").isNull(), F.lit("URI malformed"))
    reason = reason.when(F.col("key").contains("�"), F.lit("URI malformed"))
    if exclude_outputs:
        reason = reason.when(F.col("key").startswith(OUTPUT_PREFIX),
                             F.lit("Combined output, not admitted"))
    return reason.when(~content_type_accepted("content_type"),
                       F.concat(F.lit("Unsupported file type: "), ct_text))


def admit(df: DataFrame, mode: str = "quarantine", exclude_outputs: bool = True):
    """split rows into admitted and rejected.

    ``quarantine`` (default) returns ``(admitted, rejected)``; rejected rows carry
    ``reason``.  ``failfast`` returns the admitted rows and fails the job on the
    first rejected one, with the reason as message.
    """
    tagged = df.withColumn("reason", rejection_reason(df, exclude_outputs))
    if mode == "failfast":
        checked = tagged.withColumn(
            "_check", F.when(F.col("reason").isNotNull(), F.raise_error(F.col("reason"))))
        return checked.filter(F.col("_check").isNull()).drop("_check", "reason")
    if mode != "quarantine":
        raise ValueError(f"unknown mode {mode!r}")
    admitted = tagged.filter(F.col("reason").isNull()).drop("reason")
    rejected = tagged.filter(F.col("reason").isNotNull())
    return admitted, rejected


def iso_timestamp(ts: _dt.datetime | str | None = None) -> Column:
    """ISO-8601 UTC text with milliseconds, e.g. ``2024-01-01T00:00:00.000Z``.

    Without ``ts`` the time of the call is used, fixed as a literal so every
    evaluation of the plan (and every task) stamps the same value.  A Column
    (e.g. ``current_timestamp()``, evaluated per micro-batch in a stream) is
    formatted as is.
    """
    if isinstance(ts, Column):
        return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    if isinstance(ts, str):
        return F.lit(ts)
    when = ts or _dt.datetime.now(_dt.timezone.utc)
    if when.tzinfo is not None:
        when = when.astimezone(_dt.timezone.utc).replace(tzinfo=None)
    return F.lit(when.strftime("%Y-%m-%dT%H:%M:%S.") + f"{when.microsecond // 1000:03d}Z")


def execution_request(admitted: DataFrame, timestamp=None) -> DataFrame:
    """The execution request of each admitted upload, as struct and JSON.

    ``timestamp`` stamps every request; pass a fixed value for repeatable output.
    """
    req = F.struct(
        F.col("bucket").alias("bucket"),
        F.col("key").alias("key"),
        F.col("content_type").alias("contentType"),
        F.col("document_id").alias("documentId"),
        iso_timestamp(timestamp).alias("timestamp"),
    )
    return admitted.withColumn("request", F.to_json(req))


def admit_uploads(uploads: DataFrame, manifest: DataFrame, *, mode: str = "quarantine",
                  timestamp=None, exclude_outputs: bool = True):
    """C1 without the sink: decode, look up metadata, validate, build requests."""
    from tmweave.sources.uploads import attach_object_metadata

    decoded = decode_keys(uploads)
    with_ct = attach_object_metadata(decoded, manifest)
    if mode == "failfast":
        return execution_request(admit(with_ct, "failfast", exclude_outputs), timestamp)
    ok, bad = admit(with_ct, "quarantine", exclude_outputs)
    return execution_request(ok, timestamp), bad


def admission_outcomes(uploads: DataFrame, manifest: DataFrame, *, timestamp=None,
                       exclude_outputs: bool = True) -> DataFrame:
    """C1 as one table: every upload with ``admitted``, ``reason`` and, when
    admitted, its execution ``request`` (the form streaming sinks append)."""
    from tmweave.sources.uploads import attach_object_metadata

    return judged(attach_object_metadata(decode_keys(uploads), manifest), timestamp=timestamp,
                  exclude_outputs=exclude_outputs)


def judged(with_ct: DataFrame, *, timestamp=None, exclude_outputs: bool = True) -> DataFrame:
    """``admitted``, ``reason`` and ``request`` of decoded uploads that carry their content type."""
    tagged = with_ct.withColumn("reason", rejection_reason(with_ct, exclude_outputs))
    ok = F.col("reason").isNull()
    return (execution_request(tagged, timestamp)
            .withColumn("admitted", ok)
            .withColumn("request", F.when(ok, F.col("request"))))
