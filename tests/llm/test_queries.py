"""Registered queries against DuckDB, and the pipeline against its operators on small tables."""

import duckdb
import pytest

import __spark_entry__ as E
import corpus_pipeline
from tmweave.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "documents embeddings pages benchmark labels".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_registered():
    assert {*QUERIES, "pipeline"} <= set(E.queries()) and set(ORACLE_SQL) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    res = duck.execute(ORACLE_SQL[name])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted((tuple(r) for r in res.fetchall()), key=repr)
    assert sorted((tuple(r) for r in df.select(cols).collect()), key=repr) == want


def test_pipeline_keeps_columns_and_takes_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        ids = [r["doc_id"] for r in out.collect()]
        assert len(set(ids)) == len(ids) and set(ids) <= {r["doc_id"] for r in rows}
    last = corpus_pipeline.run(spark, SF)
    got = last.collect()
    assert got and all(0 < r["taken"] <= 3 * r["size"] for r in got)
    assert not any("AKIA" in r["text"] and len(r["text"].split("AKIA")[1][:16]) == 16
                   and r["text"].split("AKIA")[1][:16].isalnum() and r["text"].split("AKIA")[1][:16].isupper() for r in got)
