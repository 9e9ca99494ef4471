"""Plan hygiene of every registered query: no cross products, pruned scans."""

import contextlib
import io
import re

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def formatted_plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_no_cross_products(spark, name):
    plan = formatted_plan(E.queries()[name](spark, SF))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["translate_documents", "retrieval_context", "combine_documents",
                                  "admit_documents", "split_sections", "notifications"])
def test_scans_read_only_needed_columns(spark, name):
    plan = formatted_plan(E.queries()[name](spark, SF))
    schemas = re.findall(r"ReadSchema: struct<([^\n]*)>", plan)
    assert schemas
    # no scan of a wide sample table reads every column (documents has 5, pages 3)
    for sch in schemas:
        cols = [c.split(":")[0] for c in sch.split(",")]
        assert not {"doc_id", "text", "lang", "source", "n_chars"} <= set(cols), sch
