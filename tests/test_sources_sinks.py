"""Document and TM readers, admission and combine sinks."""

import os

from tmweave.operators.tmx import pair_segments, tm_records
from tmweave.plans.composites import admit_documents, combine_documents
from tmweave.sinks.tables import read_runs, write_run, write_tm
from tmweave.sources.tables import read_documents, read_tm
from tmweave.sources.tmx import read_tmx


def test_read_text_documents(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "docs")
    os.makedirs(d)
    with open(os.path.join(d, "report.final.txt"), "w") as f:
        f.write("line one\n\nline two\n")
    r = read_documents(spark, d, fmt="text").first()
    assert r["document_id"] == "report" and r["text"] == "line one\n\nline two\n"
    assert r["original_key"].endswith("report.final.txt")


def test_read_tm_round_trip(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "tmx")
    os.makedirs(src)
    with open(os.path.join(src, "a.tmx"), "w") as f:
        f.write('<tmx><body><tu><tuv xml:lang="en"><seg>Hi</seg></tuv><tuv xml:lang="es">'
                '<seg>Hola</seg></tuv></tu></body></tmx>')
    out = os.path.join(tmpdir_path, "tm")
    write_tm(tm_records(pair_segments(read_tmx(spark, src))), out)
    r = read_tm(spark, out).first()
    assert (r["source_text"], r["translation"], r["source_lang"], r["score"]) == ("Hi", "Hola", "en", 1.0)
    assert len(r["embedding"]) == 64


def test_admit_and_combine_write_their_sinks(spark, tmpdir_path):
    up = spark.createDataFrame([("b", "docs/a.txt"), ("b", "docs/b.png")], "bucket string, raw_key string")
    m = spark.createDataFrame([("b", "docs/a.txt", "text/plain"), ("b", "docs/b.png", "image/png")],
                              "bucket string, key string, content_type string")
    admit_documents(up, m, requests_path=f"{tmpdir_path}/req", rejected_path=f"{tmpdir_path}/rej",
                    timestamp="t")
    assert [r["document_id"] for r in read_runs(spark, f"{tmpdir_path}/req").collect()] == ["a"]
    assert read_runs(spark, f"{tmpdir_path}/rej").first()["reason"] == "Unsupported file type: image/png"
    secs = spark.createDataFrame([("a", 0, "Hola", 0.9)],
                                 "document_id string, section_id int, translated_text string, confidence double")
    docs = spark.createDataFrame([("a", "es")], "document_id string, target_language string")
    combine_documents(secs, docs, out_path=f"{tmpdir_path}/out")
    r = spark.read.parquet(f"{tmpdir_path}/out").first()
    assert (r["body"], r["output_key"], r["target_language"]) == ("Hola", "translated/a_es.txt", "es")


def test_runs_replace_themselves_and_show_when_committed(spark, tmpdir_path):
    path = f"{tmpdir_path}/runs"
    one, two = (spark.createDataFrame([(i,)], "n int") for i in (1, 2))
    write_run(one, path, "007")
    write_run(two, path, "007")
    write_run(one, path, "8")
    # An attempt that was never committed.
    one.selectExpr("n + 9 as n", "'8' as run", "'x' as attempt").write.mode("append") \
        .partitionBy("attempt").parquet(f"{path}/rows")
    assert sorted(tuple(r) for r in read_runs(spark, path).select("run", "n").collect()) == [("007", 2), ("8", 1)]


def test_only_the_batch_languages_of_the_store_are_read(spark, tmpdir_path):
    from tmweave.sinks.tables import new_pairs

    out = os.path.join(tmpdir_path, "tm")
    schema = "source_lang string, target_lang string, source_text string, target_text string, error string"
    rows = [("en", "es", "a", "b", None), ("en", "fr", "a", "b", None), (None, "es", "a", "b", None),
            ("", "es", "a", "b", None)]
    write_tm(tm_records(spark.createDataFrame(rows, schema)), out)
    batch = spark.createDataFrame([*rows[2:], ("en", "es", "a", "b", None), ("en", "es", "a", "c", None),
                                   ("de", "es", "a", "b", None)], schema)
    new = new_pairs(batch, out)
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert sorted((r[0] or "", r[3]) for r in new.collect()) == [("de", "b"), ("en", "c")]
    # One scan of the store, with a filter on its partitions.
    scans = [x for x in plan.split("FileScan parquet")[1:] if "tm_id" in x.split("]")[0]]
    assert len(scans) == 1, plan
    assert "source_lang" in scans[0].split("PartitionFilters: [")[1].split("PushedFilters")[0], plan


def test_text_documents_keep_their_names(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "docs")
    os.makedirs(d)
    with open(os.path.join(d, "a b+c 50%.txt"), "w") as f:
        f.write("x")
    r = read_documents(spark, d, fmt="text").first()
    assert r["document_id"] == "a b+c 50%" and r["original_key"].endswith("/a b+c 50%.txt")
