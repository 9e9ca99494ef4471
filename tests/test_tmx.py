"""TMX goldens: pairing, empty/malformed/short units, failures, idempotent sink."""

import os

import pytest

from tmweave.operators.tmx import pair_segments, tm_records
from tmweave.plans.composites import ingest_tmx
from tmweave.sinks.tables import write_tm
from tmweave.sources.tmx import EMPTY_FILE_ERROR, empty_files, read_tmx

TWO_UNITS = """<?xml version="1.0" encoding="UTF-8"?>
<tmx version="1.4">
  <header creationtool="test" srclang="en-us" datatype="plaintext"/>
  <body>
    <tu>
      <tuv xml:lang="en-us"><seg>Hello world</seg></tuv>
      <tuv xml:lang="es-es"><seg>Hola mundo</seg></tuv>
    </tu>
    <tu>
      <tuv xml:lang="en-us"><seg>How are you?</seg></tuv>
      <tuv xml:lang="es-es"><seg>¿Cómo estás?</seg></tuv>
    </tu>
  </body>
</tmx>"""


def write(path, name, content):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w", encoding="utf-8") as f:
        f.write(content)
    return path


class Double:
    def embed(self, texts):
        return [[0.1, 0.2, 0.3, 0.4, 0.5] for _ in texts]


def test_two_units_in_order_source_embedded(spark, tmpdir_path):
    d = write(tmpdir_path, "a.tmx", TWO_UNITS)
    pairs = pair_segments(read_tmx(spark, d)).collect()
    assert [(p["source_lang"], p["target_lang"], p["source_text"], p["target_text"]) for p in pairs] == [
        ("en-us", "es-es", "Hello world", "Hola mundo"), ("en-us", "es-es", "How are you?", "¿Cómo estás?")]
    recs, errors = ingest_tmx(spark, d, embedder=Double())
    assert errors.count() == 0
    rows = recs.collect()
    assert {r["source_text"] for r in rows} == {"Hello world", "How are you?"}
    assert all(r["embedding"] == [0.1, 0.2, 0.3, 0.4, 0.5] and r["translation"] == r["target_text"]
               for r in rows)


def test_empty_file(spark, tmpdir_path):
    d = write(tmpdir_path, "empty.tmx", "")
    assert [r["error"] for r in empty_files(spark, d).collect()] == [EMPTY_FILE_ERROR]
    with pytest.raises(ValueError, match="TMX file is empty or could not be read"):
        ingest_tmx(spark, d, mode="failfast")


def test_malformed_file(spark, tmpdir_path):
    d = write(tmpdir_path, "bad.tmx", "<invalid></xml>")
    _, errors = ingest_tmx(spark, d)
    assert [r["error"] for r in errors.collect()] == ["Malformed TMX content"]
    with pytest.raises(ValueError, match="Malformed"):
        ingest_tmx(spark, d, mode="failfast")


def test_unit_without_target_and_no_header(spark, tmpdir_path):
    d = write(tmpdir_path, "one.tmx",
              '<tmx><body><tu><tuv xml:lang="en"><seg>One</seg></tuv></tu>'
              '<tu><tuv xml:lang="en"><seg>Two</seg></tuv><tuv xml:lang="es"><seg>Dos</seg></tuv></tu>'
              '</body></tmx>')
    recs, errors = ingest_tmx(spark, d)
    assert [r["error"] for r in errors.collect()] == ["Translation unit needs a source and a target variant"]
    assert [(r["source_text"], r["translation"]) for r in recs.collect()] == [("Two", "Dos")]


def test_spaces_and_entities_kept(spark, tmpdir_path):
    d = write(tmpdir_path, "s.tmx", '<tmx><body><tu><tuv xml:lang="en"><seg> A &amp; B </seg></tuv>'
                                    '<tuv xml:lang="fr"><seg>A &lt;et&gt; B</seg></tuv></tu></body></tmx>')
    p = pair_segments(read_tmx(spark, d)).first()
    assert (p["source_text"], p["target_text"]) == (" A & B ", "A <et> B")


def test_tm_sink_is_idempotent(spark, tmpdir_path):
    d = write(os.path.join(tmpdir_path, "in"), "a.tmx", TWO_UNITS)
    out = os.path.join(tmpdir_path, "tm")
    recs = tm_records(pair_segments(read_tmx(spark, d)))
    assert write_tm(recs, out).count() == 2
    assert write_tm(recs, out).count() == 0
    tm = spark.read.parquet(out)
    assert tm.count() == 2
    assert set(tm.columns) >= {"tm_id", "source_text", "translation", "score", "embedding",
                               "source_lang", "target_lang"}


class Failing:
    def embed(self, texts):
        raise RuntimeError("model unavailable")


def test_model_failure_is_passed_on(spark, tmpdir_path):
    d = write(tmpdir_path, "one.tmx",
              '<tmx><body><tu><tuv xml:lang="en"><seg>One</seg></tuv><tuv xml:lang="es"><seg>Uno</seg></tuv>'
              '</tu></body></tmx>')
    recs, _ = ingest_tmx(spark, d, embedder=Failing(), max_attempts=2, initial_backoff=0.0)
    with pytest.raises(Exception, match="model unavailable"):
        recs.collect()


def test_read_failure_is_passed_on(spark, tmpdir_path):
    with pytest.raises(Exception, match="(?i)path does not exist|PATH_NOT_FOUND"):
        recs, _ = ingest_tmx(spark, os.path.join(tmpdir_path, "missing"))
        recs.collect()


def unit(source, target):
    return (f'<tu>\n<tuv xml:lang="en"><seg>{source}</seg></tuv>\n'
            f'<tuv xml:lang="fr"><seg>{target}</seg></tuv>\n</tu>\n')


def tmx(body):
    return f'<?xml version="1.0"?>\n<tmx version="1.4"><header/><body>\n{body}</body></tmx>\n'


def test_bad_units_leave_the_others(spark, tmpdir_path):
    d = write(tmpdir_path, "a.tmx", tmx(unit("first", "premier") + "<tu><tuv><seg>x</tuv></tu>"
                                        + unit("third", "troisieme")
                                        + '<tu><tuv xml:lang="en"><seg>open</seg></tuv>'
                                        + unit("fifth", "cinquieme")))
    recs, errors = ingest_tmx(spark, d)
    assert sorted(r["source_text"] for r in recs.collect()) == ["fifth", "first", "third"]
    assert [(r["error"], r["units"]) for r in errors.collect()] == [("Malformed TMX content", 2)]


def test_rejected_files_contribute_no_pair(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "in")
    write(d, "good.tmx", tmx(unit("good", "bon")))
    write(d, "bodyless.tmx", f"<tmx>{unit('a', 'b')}</tmx>")
    write(d, "cut.tmx", tmx(unit("kept", "non") + unit("cut", "non"))[:-25])
    write(d, "unclosed.tmx", "<tmx><body>" + unit("u", "v"))
    write(d, "page.tmx", "<html><body>" + unit("w", "x") + "</body></html>")
    write(d, "none.tmx", "<tmx><body/></tmx>")
    write(d, "empty.tmx", "")
    recs, errors = ingest_tmx(spark, d)
    assert [r["source_text"] for r in recs.collect()] == ["good"]
    got = {(os.path.basename(r["file_path"]), r["error"]) for r in errors.collect()}
    assert got == {(f, "Malformed TMX content") for f in
                   ("bodyless.tmx", "cut.tmx", "unclosed.tmx", "page.tmx")} | {
                       ("empty.tmx", EMPTY_FILE_ERROR)}


def test_large_file_is_split(spark, tmpdir_path):
    n = 8000
    d = write(tmpdir_path, "big.tmx", tmx("".join(unit(f"s {i}", f"t {i}") for i in range(n))))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        units = read_tmx(spark, d)
        assert units.rdd.getNumPartitions() > 1
        pairs = pair_segments(units)
        assert pairs.select("source_text").distinct().count() == n == pairs.count()
        assert pairs.where("error is not null").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_known_pairs_are_not_embedded_again(spark, tmpdir_path):
    tm = os.path.join(tmpdir_path, "tm")
    d1 = write(os.path.join(tmpdir_path, "one"), "a.tmx", tmx(unit("a", "x")))
    d2 = write(os.path.join(tmpdir_path, "two"), "b.tmx", tmx(unit("a", "x") + unit("b", "y")))
    assert ingest_tmx(spark, d1, tm, embedder=Double())[0].count() == 1

    class OnlyNew:
        def embed(self, texts):
            assert texts == ["b"], texts
            return [[0.5] * 5 for _ in texts]

    assert [r["source_text"] for r in ingest_tmx(spark, d2, tm, embedder=OnlyNew())[0].collect()] == ["b"]


def test_null_and_empty_language_are_two_pairs(spark, tmpdir_path):
    rows = [(None, "fr", "a", "x", None), ("", "fr", "a", "x", None), ("", "fr", "a", "x", None)]
    pairs = spark.createDataFrame(rows, "source_lang string, target_lang string, source_text string, "
                                        "target_text string, error string")
    out = os.path.join(tmpdir_path, "tm")
    assert write_tm(tm_records(pairs), out).count() == 2
    assert write_tm(tm_records(pairs), out).count() == 0
