"""Streaming forms: barrier across micro-batches, admission, TMX ingest."""

import os

from pyspark.sql import functions as F

from tmweave.operators.admission import admission_outcomes
from tmweave.operators.combine import combine_sections
from tmweave.plans import tables as T
from tmweave.sources.tmx import read_tmx
from tmweave.streaming import run_available_now, stream_admission, stream_combine, stream_tmx

SF = "/root/testdata/sf0.001"


def test_combine_waits_for_all_sections(spark, tmpdir_path):
    sections = T.conversation_sections(spark, SF)
    src = os.path.join(tmpdir_path, "sections")
    # three files, each holding every third turn: documents complete only in the last batch
    for i in range(3):
        sections.filter(F.col("section_id") % 3 == i).coalesce(1).write.parquet(f"{src}/part={i}")
    stream = (spark.readStream.schema(sections.schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(src))
    expected = sections.groupBy("document_id").agg(F.count(F.lit(1)).alias("expected"))
    q = stream_combine(stream, expected, f"{tmpdir_path}/out", f"{tmpdir_path}/ckpt")
    run_available_now(q, 300)
    assert len(q.recentProgress) >= 3
    got = {r["document_id"]: (r["body"], r["sections"], round(r["confidence"], 9))
           for r in spark.read.parquet(f"{tmpdir_path}/out").collect()}
    want = {r["document_id"]: (r["body"], r["sections"], round(r["confidence"], 9))
            for r in combine_sections(sections).collect()}
    assert got == want


def test_stream_admission_equals_batch(spark, tmpdir_path):
    pages = T.page_uploads(spark, SF, T.stream_table(spark, SF, "pages")).select("bucket", "raw_key")
    manifest = T.upload_manifest(spark, SF)
    q = stream_admission(pages, manifest, f"{tmpdir_path}/out", f"{tmpdir_path}/ckpt", timestamp="t")
    run_available_now(q, 300)
    cols = ["bucket", "key", "admitted", "reason", "request"]
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmpdir_path}/out").select(cols).collect())
    batch = admission_outcomes(T.page_uploads(spark, SF).select("bucket", "raw_key"), manifest, timestamp="t")
    assert got == sorted(tuple(r) for r in batch.select(cols).collect())


def test_stream_tmx_extends_tm_once(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "tmx")
    os.makedirs(src)
    unit = '<tu><tuv xml:lang="en"><seg>{}</seg></tuv><tuv xml:lang="es"><seg>{}</seg></tuv></tu>'
    for i in range(2):
        with open(os.path.join(src, f"f{i}.tmx"), "w") as f:
            f.write("<tmx><body>" + unit.format(f"one {i}", f"uno {i}") + unit.format("same", "igual")
                    + "</body></tmx>")
    tm = os.path.join(tmpdir_path, "tm")
    q = stream_tmx(read_tmx(spark, src, streaming=True), tm, f"{tmpdir_path}/ckpt")
    run_available_now(q, 300)
    rows = spark.read.parquet(tm).collect()
    assert sorted(r["source_text"] for r in rows) == ["one 0", "one 1", "same"]


def test_admission_from_audit_events(spark, tmpdir_path):
    import json

    from tmweave.sources.uploads import read_audit_events
    from tmweave.streaming import stream_admission_from_events

    src = os.path.join(tmpdir_path, "events")
    os.makedirs(src)

    def ev(name, bucket, key):
        return {"source": "aws.s3", "detail-type": "AWS API Call via CloudTrail", "time": "t",
                "detail": {"eventSource": "s3.amazonaws.com", "eventName": name,
                           "requestParameters": {"bucketName": bucket, "key": key}}}
    with open(os.path.join(src, "a.json"), "w") as f:
        for e in [ev("PutObject", "docs", "documents/a+b.txt"), ev("GetObject", "docs", "documents/c.txt"),
                  ev("PutObject", "tmx", "memory.tmx")]:
            f.write(json.dumps(e) + "\n")
    manifest = spark.createDataFrame([("docs", "documents/a b.txt", "text/plain")],
                                     "bucket string, key string, content_type string")
    q = stream_admission_from_events(read_audit_events(spark, src, streaming=True), "docs", manifest,
                                     f"{tmpdir_path}/out", f"{tmpdir_path}/ckpt", timestamp="t")
    run_available_now(q, 300)
    rows = spark.read.parquet(f"{tmpdir_path}/out").collect()
    assert [(r["key"], r["admitted"], r["document_id"]) for r in rows] == [("documents/a b.txt", True, "a b")]


def test_combine_fails_without_expected_count(spark, tmpdir_path):
    import pytest

    sections = spark.createDataFrame([(1, 0, "a", 0.5), (2, 0, "b", 0.5)],
                                     "document_id long, section_id long, translated_text string, confidence double")
    src = os.path.join(tmpdir_path, "s")
    sections.write.parquet(src)
    stream = spark.readStream.schema(sections.schema).parquet(src)
    expected = spark.createDataFrame([(1, 1)], "document_id long, expected long")
    q = stream_combine(stream, expected, f"{tmpdir_path}/out", f"{tmpdir_path}/ckpt")
    with pytest.raises(Exception, match="no expected section count"):
        run_available_now(q, 300)


def test_stream_tmx_records_errors(spark, tmpdir_path):
    from tmweave.sources.tmx import read_tmx_pieces

    src = os.path.join(tmpdir_path, "tmx")
    os.makedirs(src)
    good = '<tu><tuv xml:lang="en"><seg>g</seg></tuv><tuv xml:lang="es"><seg>h</seg></tuv></tu>'
    for name, text in (("a", f"<tmx><body>{good}<tu><tuv><seg>s</seg></tuv></tu></body></tmx>"),
                       ("b", f"<tmx><body>{good.replace('>g<', '>z<')}")):
        with open(os.path.join(src, f"{name}.tmx"), "w") as f:
            f.write(text)
    q = stream_tmx(read_tmx_pieces(spark, src, streaming=True), f"{tmpdir_path}/tm",
                   f"{tmpdir_path}/ckpt", errors_path=f"{tmpdir_path}/errors")
    run_available_now(q, 300)
    assert [r["source_text"] for r in spark.read.parquet(f"{tmpdir_path}/tm").collect()] == ["g"]
    errors = spark.read.parquet(f"{tmpdir_path}/errors").collect()
    assert {(os.path.basename(r["file_path"]), r["error"], r["units"]) for r in errors} == {
        ("a.tmx", "Translation unit needs a source and a target variant", 1),
        ("b.tmx", "Malformed TMX content", 0)}


def test_combine_with_string_ids(spark, tmpdir_path):
    sections = spark.createDataFrame(
        [("report", 1, "b", 0.5), ("report", 0, "a", 0.5), ("x-1", 0, "c", 1.0)],
        "document_id string, section_id long, translated_text string, confidence double")
    src = os.path.join(tmpdir_path, "s")
    sections.write.parquet(src)
    expected = sections.groupBy("document_id").agg(F.count(F.lit(1)).alias("expected"))
    q = stream_combine(spark.readStream.schema(sections.schema).parquet(src), expected,
                       f"{tmpdir_path}/out", f"{tmpdir_path}/ckpt")
    run_available_now(q, 300)
    got = {(r["document_id"], r["body"]) for r in spark.read.parquet(f"{tmpdir_path}/out").collect()}
    assert got == {("report", "a\n\nb"), ("x-1", "c")}


def test_mean_does_not_depend_on_arrival_and_equals_the_batch(spark):
    import itertools
    import math

    from tmweave.operators.combine import combine_sections
    from tmweave.streaming.jobs import _mean

    confs = [0.1, 0.2, 0.3, 1e-7, 0.7]
    assert len({_mean(list(p)) for p in itertools.permutations(confs)}) == 1
    df = spark.createDataFrame([("d", i, "t", c) for i, c in enumerate(confs)],
                               "document_id string, section_id int, translated_text string, confidence double")
    assert combine_sections(df).first()["confidence"] == _mean(confs)
    assert math.isnan(_mean([])) and math.isnan(_mean([0.5, float("nan")]))


def _stream(spark, df, path):
    """One file per ``batch``, taken in order, one a micro-batch."""
    for i in sorted(r[0] for r in df.select("batch").distinct().collect()):
        df.filter(F.col("batch") == i).drop("batch").coalesce(1).write.mode("append").parquet(path)
    return (spark.readStream.schema(df.drop("batch").schema).option("maxFilesPerTrigger", 1).parquet(path))


def test_combine_counts_from_a_stream_with_empty_documents(spark, tmpdir_path):
    sections = spark.createDataFrame(
        [(0, "a", 1, "a1", 0.1), (1, "a", 0, "a0", 0.2), (2, "a", 2, None, 0.7), (1, "b", 0, "b0", None),
         (2, "a", 1, "a1", 0.1)],                          # the last row: a section sent again
        "batch int, document_id string, section_id int, translated_text string, confidence double")
    requests = spark.createDataFrame([(0, "empty", 0), (0, "never", 2), (2, "a", 3), (0, "b", 1)],
                                     "batch int, document_id string, expected int")
    q = stream_combine(_stream(spark, sections, f"{tmpdir_path}/s"), _stream(spark, requests, f"{tmpdir_path}/r"),
                       f"{tmpdir_path}/out", f"{tmpdir_path}/ckpt")
    run_available_now(q, 300)
    got = {r["document_id"]: r for r in spark.read.parquet(f"{tmpdir_path}/out").collect()}
    docs = spark.createDataFrame([("a",), ("b",), ("empty",)], "document_id string")
    want = {r["document_id"]: r for r in combine_sections(
        sections.drop("batch").distinct(), docs).collect()}
    assert set(got) == set(want)
    for d, w in want.items():
        assert (got[d]["body"], got[d]["sections"], repr(got[d]["confidence"])) == (
            w["body"], w["sections"], repr(w["confidence"]))
        assert got[d]["complete"] and got[d]["expected"] == w["sections"]


def test_combine_counts_from_the_sections_and_gives_up_late_documents(spark, tmpdir_path):
    import time

    import pytest

    schema = "document_id long, section_id long, translated_text string, confidence double, expected long"
    sink = "document_id long, body string, sections long, expected long, complete boolean"
    src = f"{tmpdir_path}/s"
    rows = [(1, 0, "a", 0.5, 2), (2, 0, "x", 0.5, None), (2, 1, "y", 0.5, 2)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(src)

    def start(**options):
        return stream_combine(spark.readStream.schema(schema).parquet(src), None, f"{tmpdir_path}/out",
                              f"{tmpdir_path}/ckpt", timeout_s=1, **options)
    with pytest.raises(ValueError, match="timeout_s"):
        start()
    q, got, end = start(available_now=False), {}, time.time() + 60
    try:
        while len(got) < 2 and time.time() < end and q.exception() is None:
            time.sleep(1)
            if os.path.isdir(f"{tmpdir_path}/out/_spark_metadata"):
                got = {r["document_id"]: (r["body"], r["sections"], r["expected"], r["complete"])
                       for r in spark.read.schema(sink).parquet(f"{tmpdir_path}/out").collect()}
    finally:
        q.stop()
    assert got == {1: (None, 1, 2, False), 2: ("x\n\ny", 2, 2, True)}


def test_late_metadata_admit_and_silence_rejects(spark, tmpdir_path):
    from tmweave.streaming import read_admissions, stream_admission_live

    up, meta = "bucket string, raw_key string, event_time timestamp", \
        "bucket string, key string, content_type string, modified_at timestamp"

    def run(uploads, metadata):
        for name, rows, schema in (("up", uploads, up), ("meta", metadata, meta)):
            times = spark.createDataFrame([(i, f"2024-01-01 {r[-1]}") for i, r in enumerate(rows)], "i int, t string")
            cols = [c.split()[0] for c in schema.split(", ")]
            df = spark.createDataFrame([(i, *r[:-1]) for i, r in enumerate(rows)],
                                       "i int, " + schema.rsplit(",", 1)[0])
            df.join(times, "i").withColumn(cols[-1], F.to_timestamp("t")).select(*cols) \
                .write.mode("append").parquet(f"{tmpdir_path}/{name}")
        q = stream_admission_live(spark.readStream.schema(up).parquet(f"{tmpdir_path}/up"),
                                  spark.readStream.schema(meta).parquet(f"{tmpdir_path}/meta"),
                                  f"{tmpdir_path}/out", f"{tmpdir_path}/ckpt", timestamp="t")
        run_available_now(q, 300)
        return {r["raw_key"]: (r["admitted"], r["content_type"])
                for r in read_admissions(spark, f"{tmpdir_path}/out").collect()} if q.recentProgress else {}

    first = run([("b", "late.txt", "10:00:00"), ("b", "never.txt", "10:00:01"), ("b", "twice.txt", "10:00:02"),
                 ("b", "bad%zz", "10:00:03")],
                [("b", "other.txt", "text/plain", "10:00:00")])
    assert first == {}
    second = run([], [("b", "late.txt", "text/plain", "10:05:00"), ("b", "twice.txt", "image/png", "10:05:00"),
                      ("b", "twice.txt", "text/plain", "10:06:00"), ("b", "never.txt", "text/plain", "12:30:00")])
    assert second == {"late.txt": (True, "text/plain"), "twice.txt": (True, "text/plain")}
    third = run([("b", "end", "18:00:00")], [("b", "end2", "x", "18:00:00")])
    assert third == second | {"never.txt": (False, None), "bad%zz": (False, None)}


def _folder_tables(spark, path):
    """Small tables, each a folder of two part files."""
    rows = {"documents": ("doc_id long, text string, lang string", [(1, "a", "en"), (2, "b", "es"), (3, None, None)]),
            "pages": ("page_id long, url string", [(1, "http://h/x.html"), (2, "http://h/x%20y/"), (3, None)]),
            "conversations": ("conv_id long, turn int, role string, text string",
                              [(1, 0, "u", "hi"), (1, 1, "a", "there"), (2, 0, "u", None)])}
    for name, (schema, values) in rows.items():
        spark.createDataFrame(values, schema).repartition(2).write.parquet(f"{path}/{name}.parquet")
    return path


def test_stream_admission_reads_tables_of_several_files(spark, tmpdir_path):
    from tmweave.plans.queries import QUERIES

    sf = _folder_tables(spark, tmpdir_path)
    got, want = (sorted(map(repr, QUERIES[n](spark, sf).collect())) for n in ("stream_admission", "admit_documents"))
    assert got == want and len(got) == 6


def test_stream_combine_reads_tables_of_several_files(spark, tmpdir_path):
    from tmweave.plans.queries import QUERIES

    sf = _folder_tables(spark, tmpdir_path)
    got, want = (sorted(map(repr, QUERIES[n](spark, sf).collect())) for n in ("stream_combine", "combine_documents"))
    assert got == want and len(got) == 2


def test_stream_combine_of_null_conversations_and_of_none(spark, tmpdir_path):
    from tmweave.plans.queries import QUERIES

    schema = "conv_id long, turn int, role string, text string"
    rows = [(None, 0, "u", "lost"), (None, 1, "a", "found"), (7, 0, "u", "hi")]
    for name, some in (("null", rows), ("none", [])):
        spark.createDataFrame(some, schema).write.parquet(f"{tmpdir_path}/{name}/conversations.parquet")
    got = {r["document_id"]: (r["output_key"], r["body"], r["sections"])
           for r in QUERIES["stream_combine"](spark, f"{tmpdir_path}/null").collect()}
    assert got == {None: (None, "lost\n\nfound", 2), 7: ("translated/7_es.txt", "hi", 1)}
    assert QUERIES["stream_combine"](spark, f"{tmpdir_path}/none").collect() == []
