"""Streaming jobs.  Each returns a started ``StreamingQuery``; exactly-once output
comes from the checkpoint plus a file sink (or batch-id keyed writes)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from decimal import ROUND_HALF_UP, Decimal, localcontext

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tmweave.operators.admission import admission_outcomes, decode_keys, judged
from tmweave.operators.combine import SECTION_SEPARATOR


def _start(df: DataFrame, sink_path: str, checkpoint: str, available_now: bool,
           partition_by: list[str] | None = None) -> StreamingQuery:
    w = (df.writeStream.format("parquet").outputMode("append")
         .option("path", sink_path).option("checkpointLocation", checkpoint))
    if partition_by:
        w = w.partitionBy(*partition_by)
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()


def run_available_now(query: StreamingQuery, timeout_s: float | None = None) -> None:
    """Wait for an ``availableNow`` query to finish; re-raise its failure."""
    query.awaitTermination(timeout_s)
    if query.exception() is not None:
        raise query.exception()


def stream_admission(uploads: DataFrame, manifest: DataFrame, sink_path: str,
                     checkpoint: str, *, timestamp=None,
                     available_now: bool = True) -> StreamingQuery:
    """Every upload event, as it arrives, becomes an execution request or a
    rejection (``admitted`` flag and ``reason``).

    ``uploads`` is a streaming DataFrame with bucket and raw_key; ``manifest`` a
    static (bucket, key, content_type) table joined to each micro-batch.  Requests
    are stamped with their micro-batch's time unless ``timestamp`` is given.
    """
    ts = F.current_timestamp() if timestamp is None else timestamp
    out = admission_outcomes(uploads, manifest, timestamp=ts)
    return _start(out, sink_path, checkpoint, available_now)


def stream_admission_from_events(events: DataFrame, documents_bucket: str,
                                 manifest: DataFrame, sink_path: str, checkpoint: str, *,
                                 timestamp=None, available_now: bool = True) -> StreamingQuery:
    """R1 from raw audit-log events (S2): route uploads of the documents bucket (F1),
    then admit each one as ``stream_admission`` does."""
    from tmweave.operators.admission import route_uploads

    uploads = route_uploads(events, {"documents": documents_bucket}).select("bucket", "raw_key")
    return stream_admission(uploads, manifest, sink_path, checkpoint, timestamp=timestamp,
                            available_now=available_now)


def stream_admission_live(uploads: DataFrame, metadata: DataFrame, sink_path: str, checkpoint: str, *,
                          wait: str = "1 hour", timestamp=None,
                          available_now: bool = True) -> StreamingQuery:
    """R1 with a living manifest: uploads and object metadata are both streams.

    ``uploads`` has bucket, raw_key and ``event_time``, ``metadata`` bucket, key, content_type and
    ``modified_at`` (timestamps).  Metadata belong to an upload of their object if modified
    within ``wait`` before or after it.  An upload is judged when they arrive, batches later
    too; without any it is rejected when both streams have passed its time by ``wait``
    (the watermark), and only then, so late metadata admit what a lookup at arrival would have
    turned away.  Rows more than ``wait`` behind their stream's newest may be dropped as too late.
    State holds the rows of about that time alone; no batch reads earlier files.  A run that ends
    (``available_now``) moves the watermark only if both streams have new rows in it, as
    Spark keeps no watermark of a single stream between runs.

    An upload that meets several versions has a row for each; ``read_admissions`` gives one.
    """
    ts = F.current_timestamp() if timestamp is None else timestamp
    ups = decode_keys(uploads.withWatermark("event_time", wait)).alias("u")
    meta = (metadata.select("bucket", "key", "content_type", "modified_at")
            .withWatermark("modified_at", wait).alias("m"))
    near = F.expr(f"m.modified_at between u.event_time - interval {wait} and u.event_time + interval {wait}")
    same = (F.col("u.bucket") == F.col("m.bucket")) & (F.col("u.key") == F.col("m.key"))
    both = ups.join(meta, same & near, "left").select("u.*", "m.content_type", "m.modified_at")
    with _rocksdb(uploads.sparkSession):
        return _start(judged(both, timestamp=ts), sink_path, checkpoint, available_now)


def read_admissions(spark: SparkSession, path: str) -> DataFrame:
    """The outcomes of ``stream_admission_live``, one per upload (bucket, raw_key, event_time):
    the one by the metadata modified last (then the greatest content type)."""
    rows = spark.read.parquet(path)
    key = ["bucket", "raw_key", "event_time"]
    rest = F.struct(*[c for c in rows.columns if c not in key])
    return (rows.groupBy(*key).agg(F.max_by(rest, F.struct("modified_at", "content_type")).alias("r"))
            .select(*key, "r.*"))


def stream_tmx(files: DataFrame, tm_path: str, checkpoint: str, *, embedder=None,
               embed_target: bool = False, errors_path: str | None = None,
               available_now: bool = True) -> StreamingQuery:
    """R2: each new TMX file extends the TM.  ``files`` comes from
    ``read_tmx_pieces(..., streaming=True)``, whose micro-batches hold whole files, or is
    already cut into units (``read_tmx``; then no file can be rejected).

    Each micro-batch is paired, reduced to new pairs, embedded and appended with the
    idempotent TM sink, so a replayed batch adds nothing.  Rejected files and units go to
    ``errors_path`` (file_path, error, units), one folder per batch, which a replay
    overwrites.
    """
    from tmweave.operators.tmx import pair_segments, tm_records, tmx_errors
    from tmweave.sinks.tables import append_tm, new_pairs
    from tmweave.sources.tmx import file_errors, tmx_units

    def batch(df: DataFrame, epoch: int) -> None:
        if "piece" in df.columns:
            rejected = [file_errors(df)]
            pairs = pair_segments(tmx_units(df))
        else:
            rejected, pairs = [], pair_segments(df)
        if errors_path is not None:
            (tmx_errors(pairs, *rejected).write.mode("overwrite")
             .parquet(f"{errors_path.rstrip('/')}/batch={epoch}"))
        for r in rejected:
            pairs = pairs.join(r, "file_path", "left_anti")
        ok = new_pairs(pairs.filter(F.col("error").isNull()), tm_path)
        append_tm(tm_records(ok, embed_target=embed_target, embedder=embedder), tm_path)

    w = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()


def _mean(confs: list[float]) -> float:
    """The mean as ``combine_sections`` gives it: the shortest digits summed as decimals, so the
    order of arrival doesn't show; NaN for none or any that is missing or not finite."""
    if not confs or not all(math.isfinite(c) for c in confs):
        return float("nan")
    with localcontext(prec=60, rounding=ROUND_HALF_UP):
        total = sum(Decimal(repr(float(c))).quantize(Decimal("1e-18")) for c in confs)
    return float(total) / len(confs)


class _FanIn(StatefulProcessor):
    """The barrier of one document: a map entry per section, and the counts."""

    def __init__(self, timeout_s: float | None):
        self.timeout_s = timeout_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("sections", "section_id long, pos long", "text string, confidence double")
        self.counts = handle.getValueState("counts", "arrived long, expected long, deadline long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.counts.exists()
        arrived, expected, deadline = self.counts.get() if known else (0, None, None)
        new = {}
        for pdf in rows:
            for place, pos, text, conf, count in zip(*(pdf[c] for c in _INPUT)):
                if not pd.isna(count):
                    expected = int(count) if expected is None else max(expected, int(count))
                if not pd.isna(place):
                    new[int(place), int(pos)] = (text, None if pd.isna(conf) else float(conf))
        fresh = [k for k in new if not (arrived and self.held.containsKey(k))]
        arrived += len(fresh)
        if expected is not None and arrived >= expected:
            if known:
                new = {**dict(self._sections()), **new}
                self._forget()
            yield _combined(key, new, expected, True)
            return
        for k, v in new.items():
            self.held.updateValue(k, v)
        if not known and self.timeout_s is not None:
            deadline = int(timerValues.getCurrentProcessingTimeInMs()) + int(self.timeout_s * 1000)
            self.handle.registerTimer(deadline)
        self.counts.update((arrived, expected, deadline))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # A timer that outlived its document finds no state, or that of a later start.
        if not self.counts.exists():
            return
        _, expected, deadline = self.counts.get()
        if deadline > expiredTimerInfo.getExpiryTimeInMs():
            return
        held = dict(self._sections())
        self._forget()
        yield _combined(key, held, expected, False)

    def close(self) -> None:
        pass

    def _sections(self):
        for k, v in self.held.iterator():
            yield (int(k[0]), int(k[1])), (v[0], v[1])

    def _forget(self) -> None:
        self.held.clear()
        self.counts.clear()


_INPUT = ("section_id", "pos", "translated_text", "confidence", "expected")


def _combined(key, sections: dict, expected: int | None, complete: bool) -> pd.DataFrame:
    order = sorted(sections)
    body = SECTION_SEPARATOR.join(sections[k][0] or "" for k in order) if complete else None
    confs = [float("nan") if sections[k][1] is None else sections[k][1] for k in order]
    return pd.DataFrame({"document_id": [key[0]], "body": pd.Series([body], dtype=object),
                         "confidence": [_mean(confs)], "sections": [len(order)],
                         "expected": pd.Series([expected], dtype="Int64"), "complete": [complete]})


@contextmanager
def _rocksdb(spark):
    """Keyed state (a map entry each) needs the RocksDB state store; a query keeps the setting that
    its session had when it started."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def stream_combine(sections: DataFrame, expected: DataFrame | None, sink_path: str,
                   checkpoint: str, *, timeout_s: float | None = None,
                   available_now: bool = True) -> StreamingQuery:
    """The fan-in barrier.  A document is combined once all its sections have
    arrived, possibly over many micro-batches.

    ``sections``: streaming (document_id, section_id, translated_text, confidence
    [, pos]).  Where its documents' section counts come from, by ``expected``: None, the
    column ``expected`` of the sections themselves (null where a row doesn't know it); a
    stream (document_id, expected), such as that of the requests, whose rows may come before
    or after the sections and which also gives the documents without sections (empty body,
    NaN confidence); a static table of them, where a section whose document is missing fails
    the query rather than being dropped.  Of several counts the largest holds.

    The state is a map with an entry per (section_id, pos), so a section that arrives writes
    itself alone, and one that arrives twice before its document is complete counts once (the
    later row holds).  It is dropped on emit: a section that comes after starts anew.  With
    ``timeout_s``, a document that isn't complete that long after its first row is given up:
    ``complete`` false, no body, the number of ``sections`` that came.  Its timers keep a query
    going, so it needs ``available_now=False``.

    The sink has document_id, body, confidence (as ``combine_sections``), sections, expected,
    complete.
    """
    if timeout_s is not None and available_now:
        raise ValueError("timeout_s needs available_now=False: timers keep the query running")
    if "pos" not in sections.columns:
        sections = sections.withColumn("pos", F.lit(0).cast("bigint"))
    id_type = sections.schema["document_id"].dataType.simpleString()
    rows = sections
    if expected is not None and not expected.isStreaming:
        # Null-safe: an id that is null in both is a document like any other.
        count = expected.select(F.col("document_id").alias("_document"), "expected")
        rows = rows.join(count, F.col("document_id").eqNullSafe(F.col("_document")), "left").drop("_document")
        rows = rows.withColumn("expected", F.when(
            F.col("expected").isNull(), F.raise_error(F.concat(
                F.lit("no expected section count for document "),
                F.coalesce(F.col("document_id").cast("string"), F.lit("null")))))
            .otherwise(F.col("expected")))
    elif expected is not None:
        rows = rows.withColumn("expected", F.lit(None).cast("bigint"))
    rows = rows.select("document_id", F.col("section_id").cast("bigint"), F.col("pos").cast("bigint"),
                       F.col("translated_text").cast("string"), F.col("confidence").cast("double"),
                       F.col("expected").cast("bigint"))
    if expected is not None and expected.isStreaming:
        none = [F.lit(None).cast(t).alias(c) for c, t in zip(_INPUT, ("bigint", "bigint", "string", "double"))]
        rows = rows.union(expected.select(F.col("document_id").cast(id_type), *none,
                                          F.col("expected").cast("bigint")))
    out = rows.groupBy("document_id").transformWithStateInPandas(
        _FanIn(timeout_s), f"document_id {id_type}, body string, confidence double, sections long, "
        "expected long, complete boolean", "append", "none" if timeout_s is None else "processingTime")
    # Arrow hands a NaN of pandas over as null.
    out = out.withColumn("confidence", F.coalesce("confidence", F.lit(float("nan"))))
    with _rocksdb(sections.sparkSession):
        return _start(out, sink_path, checkpoint, available_now)
