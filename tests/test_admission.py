"""Admission goldens: notification records, content types, routing, failfast."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tmweave.operators import admission as A
from tmweave.sources.uploads import read_audit_events, read_upload_notifications


def record(key, bucket="test-bucket"):
    return {
        "eventVersion": "2.1", "eventSource": "aws:s3", "awsRegion": "us-east-1",
        "eventTime": "2023-01-01T00:00:00.000Z", "eventName": "ObjectCreated:Put",
        "userIdentity": {"principalId": "EXAMPLE"},
        "requestParameters": {"sourceIPAddress": "127.0.0.1"},
        "responseElements": {"x-amz-request-id": "EXAMPLE123456789"},
        "s3": {"s3SchemaVersion": "1.0", "configurationId": "testConfigRule",
               "bucket": {"name": bucket, "ownerIdentity": {"principalId": "EXAMPLE"},
                          "arn": f"arn:aws:s3:::{bucket}"},
               "object": {"key": key, "size": 1024, "eTag": "0123456789abcdef",
                          "sequencer": "0A1B2C3D4E5F678901"}},
    }


def write_events(path, *docs):
    with open(os.path.join(path, "events.json"), "w") as f:
        for d in docs:
            f.write(json.dumps(d) + "\n")
    return path


def manifest(spark, rows):
    return spark.createDataFrame(rows, "bucket string, key string, content_type string")


TS = "2024-01-01T00:00:00.000Z"


def test_text_plain_admitted(spark, tmpdir_path):
    up = read_upload_notifications(spark, write_events(tmpdir_path, {"Records": [record("documents/test.txt")]}))
    ok, bad = A.admit_uploads(up, manifest(spark, [("test-bucket", "documents/test.txt", "text/plain")]),
                              timestamp=TS)
    assert bad.count() == 0
    req = json.loads(ok.first()["request"])
    assert req == {"bucket": "test-bucket", "key": "documents/test.txt", "contentType": "text/plain",
                   "documentId": "test", "timestamp": TS}


def test_image_rejected_and_missing_metadata(spark, tmpdir_path):
    up = read_upload_notifications(spark, write_events(
        tmpdir_path, {"Records": [record("documents/image.jpg"), record("documents/missing.txt")]}))
    ok, bad = A.admit_uploads(up, manifest(spark, [("test-bucket", "documents/image.jpg", "image/jpeg")]))
    assert ok.count() == 0
    reasons = dict(bad.select("key", "reason").collect())
    assert reasons == {"documents/image.jpg": "Unsupported file type: image/jpeg",
                       "documents/missing.txt": "Unsupported file type: undefined"}


def test_failfast_raises_with_reason(spark, tmpdir_path):
    up = read_upload_notifications(spark, write_events(tmpdir_path, {"Records": [record("documents/image.jpg")]}))
    out = A.admit_uploads(up, manifest(spark, [("test-bucket", "documents/image.jpg", "image/jpeg")]),
                          mode="failfast")
    with pytest.raises(Exception, match="Unsupported file type: image/jpeg"):
        out.collect()


def test_two_records_keep_order(spark, tmpdir_path):
    up = read_upload_notifications(spark, write_events(
        tmpdir_path, {"Records": [record("documents/test1.txt"), record("documents/test2.txt")]}))
    m = manifest(spark, [("test-bucket", "documents/test1.txt", "text/plain"),
                         ("test-bucket", "documents/test2.txt", "text/plain")])
    ok, _ = A.admit_uploads(up, m, timestamp=TS)
    assert [r["document_id"] for r in ok.orderBy("record_pos").collect()] == ["test1", "test2"]


def test_keys_decoded_and_outputs_not_readmitted(spark):
    up = spark.createDataFrame([("b", "docs/my+file%21.txt"), ("b", "translated/x_es.txt"),
                                ("b", "bad%zz.txt")], "bucket string, raw_key string")
    m = manifest(spark, [("b", "docs/my file!.txt", "application/pdf"),
                         ("b", "translated/x_es.txt", "text/plain")])
    ok, bad = A.admit_uploads(up, m)
    assert [r["key"] for r in ok.collect()] == ["docs/my file!.txt"]
    assert dict(bad.select("raw_key", "reason").collect()) == {
        "translated/x_es.txt": "Combined output, not admitted", "bad%zz.txt": "URI malformed"}


@pytest.mark.parametrize("ct,ok", [("text/plain", True), ("text/html; charset=utf-8", True),
                                   ("application/pdf", True), ("application/msword", True),
                                   ("application/vnd.openxmlformats-officedocument.wordprocessingml.document", True),
                                   ("image/jpeg", False), ("TEXT/PLAIN", False), (None, False)])
def test_content_type_predicate(spark, ct, ok):
    df = spark.createDataFrame([(ct,)], "c string")
    assert df.select(A.content_type_accepted("c")).first()[0] is ok


def test_route_uploads(spark, tmpdir_path):
    def ev(name, bucket, source="aws.s3"):
        return {"source": source, "detail-type": "AWS API Call via CloudTrail", "time": "t",
                "detail": {"eventSource": "s3.amazonaws.com", "eventName": name,
                           "requestParameters": {"bucketName": bucket, "key": "k"}}}
    write_events(tmpdir_path, ev("PutObject", "docs"), ev("CompleteMultipartUpload", "tmx"),
                 ev("GetObject", "docs"), ev("PutObject", "other"), ev("PutObject", "docs", "aws.ec2"))
    routed = A.route_uploads(read_audit_events(spark, tmpdir_path), {"documents": "docs", "tmx": "tmx"})
    got = sorted((r["route"], r["event_name"]) for r in routed.collect())
    assert got == [("documents", "PutObject"), ("tmx", "CompleteMultipartUpload")]


def test_admission_outcomes_one_table(spark):
    up = spark.createDataFrame([("b", "a.txt"), ("b", "b.jpg")], "bucket string, raw_key string")
    m = manifest(spark, [("b", "a.txt", "text/plain"), ("b", "b.jpg", "image/jpeg")])
    out = A.admission_outcomes(up, m, timestamp=TS).orderBy("key").collect()
    assert [(r["admitted"], r["request"] is not None) for r in out] == [(True, True), (False, False)]
    assert F is not None


def test_default_timestamp_is_fixed_per_call(spark):
    import datetime as dt
    import time

    up = spark.createDataFrame([("b", "a.txt")], "bucket string, raw_key string")
    m = manifest(spark, [("b", "a.txt", "text/plain")])
    ok, _ = A.admit_uploads(up, m)
    first = json.loads(ok.first()["request"])["timestamp"]
    time.sleep(0.01)
    assert json.loads(ok.first()["request"])["timestamp"] == first
    assert dt.datetime.strptime(first, "%Y-%m-%dT%H:%M:%S.%fZ")
    fixed = A.admit_uploads(up, m, timestamp=dt.datetime(2024, 5, 1, 12, 30, 1, 250000))[0]
    assert json.loads(fixed.first()["request"])["timestamp"] == "2024-05-01T12:30:01.250Z"


def test_metadata_as_of_equals_a_loop(spark):
    import random

    from tmweave.sources.uploads import attach_metadata_as_of

    rng = random.Random(7)
    # One object holds most rows; times repeat, also between uploads and versions.
    keys = ["hot"] * 8 + ["a", "b", None]
    types = ["text/plain", "image/png", None]
    ups = [(i, "x", rng.choice(keys), rng.choice([None, *range(60)]), "old") for i in range(600)]
    ups += [ups[0], ups[1]]
    vers = [("x", rng.choice(keys), rng.choice([None, *range(0, 60, 3)]), rng.choice(types)) for _ in range(40)]

    def at(key, t):
        held = [(m, c or "", c) for _, k, m, c in vers if None not in (key, t, k, m) and k == key and m <= t]
        return max(held)[2] if held else None
    u = spark.createDataFrame(ups, "i int, bucket string, key string, event_time int, content_type string")
    v = spark.createDataFrame(vers, "bucket string, key string, modified_at int, content_type string")
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions",
                                             "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        # Twelve ranges: the hot object spans several.
        for c, x in zip(before, ("12", "false")):
            spark.conf.set(c, x)
        got = attach_metadata_as_of(u, v)
        assert got.columns == ["i", "bucket", "key", "event_time", "content_type"]
        rows = got.collect()
        assert attach_metadata_as_of(u, v.limit(0)).where("content_type is not null").count() == 0
        assert attach_metadata_as_of(u.limit(0), v).count() == 0
    finally:
        for c, x in before.items():
            spark.conf.set(c, x)
    assert sorted(map(str, rows)) == sorted(
        str(type(rows[0])(i=i, bucket=b, key=k, event_time=t, content_type=at(k, t))) for i, b, k, t, _ in ups)
