"""Column functions: keys, JavaScript-compatible number text, templates, JSON."""

import json
from decimal import ROUND_HALF_UP, Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tmweave.functions import (
    build_prompt, confidence_percent, context_size, decode_key, document_id,
    js_number_string, model_request, output_key, parse_completion, parse_embedding,
    resolve_model,
)


def one(spark, col, value, ddl="x string"):
    return spark.createDataFrame([(value,)], ddl).select(col.alias("r")).first()["r"]


def test_decode_key(spark):
    rows = spark.createDataFrame(
        [("documents/test.txt",), ("a+b%20c",), ("bad%zz",), ("%E2%82%AC",)], "k string")
    got = [r[0] for r in rows.select(decode_key("k")).collect()]
    assert got == ["documents/test.txt", "a b c", None, "€"]


def test_document_id(spark):
    cases = {"documents/test.txt": "test", "a/b.c.d": "b", "x/": "unknown", ".h": "unknown",
             "documents/image.jpg": "image", "noext": "noext"}
    df = spark.createDataFrame([(k,) for k in cases], "k string")
    got = dict(df.select("k", document_id("k").alias("d")).collect())
    assert got == cases


def test_output_key(spark):
    df = spark.createDataFrame([("doc123", "es")], "d string, l string")
    assert df.select(output_key("d", "l")).first()[0] == "translated/doc123_es.txt"


def js_to_fixed2(y: float) -> str:
    """JavaScript toFixed(2) for non-negative finite y: exact value, ties up."""
    return str(Decimal(y).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP))


def test_confidence_percent_examples(spark):
    cases = [0.95, 0.925, 0.00125, 0.92505, 1.0, 0.0, 0.123456]
    df = spark.createDataFrame([(c,) for c in cases], "c double")
    got = [r[0] for r in df.select(confidence_percent("c")).collect()]
    assert got == [js_to_fixed2(c * 100) + "%" for c in cases]
    assert got[0] == "95.00%"
    assert one(spark, confidence_percent(F.col("x")), float("nan"), "x double") == "NaN%"


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(min_value=0, max_value=10, allow_nan=False), min_size=1, max_size=20))
def test_confidence_percent_property(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "c double")
    got = [r[0] for r in df.select(confidence_percent("c")).collect()]
    assert got == [js_to_fixed2(v * 100) + "%" for v in values]


def test_js_number_string(spark):
    cases = {0.925: "0.925", 1.0: "1", 0.5: "0.5", 0.95: "0.95", 1e-7: "1e-7",
             123456789.5: "123456789.5", 1e21: "1e+21", 0.0001: "0.0001", 42.0: "42"}
    df = spark.createDataFrame([(k,) for k in cases], "c double")
    got = dict(df.select("c", js_number_string("c")).collect())
    assert got == cases
    assert one(spark, js_number_string(F.col("x")), float("nan"), "x double") == "NaN"


def test_context_size(spark):
    df = spark.createDataFrame([("",), ("a",), ("a\nb",), (None,)], "c string")
    assert [r[0] for r in df.select(context_size("c")).collect()] == [1, 1, 2, 1]


def test_prompt_is_exact(spark):
    df = spark.createDataFrame([("ctx line", "en", "es", "Hello")], "c string, s string, t string, x string")
    got = df.select(build_prompt("c", "s", "t", "x")).first()[0]
    assert got == ("\n      Context from similar translations:\n      ctx line\n\n"
                   "      Translate the following text from en to es,\n"
                   "      maintaining consistency with the context provided above:\n\n"
                   "      Text: Hello\n    ")


def test_model_request_and_replies(spark):
    df = spark.createDataFrame([("p \"q\"\n",)], "p string")
    body = json.loads(df.select(model_request("p")).first()[0])
    assert body == {"prompt": "p \"q\"\n", "max_tokens": 2000, "temperature": 0.7}
    r = spark.createDataFrame([('{"embedding": [0.1, 0.2], "completion": "hola"}',)], "b string")
    row = r.select(parse_embedding("b").alias("e"), parse_completion("b").alias("c")).first()
    assert row["e"] == [0.1, 0.2] and row["c"] == "hola"


def test_resolve_model(spark):
    df = spark.createDataFrame([(None,), ("",), ("m1",)], "m string")
    got = [r[0] for r in df.select(resolve_model("m", "anthropic.claude-v2")).collect()]
    assert got == ["anthropic.claude-v2", "anthropic.claude-v2", "m1"]


def js_string(x: float) -> str:
    """Number.prototype.toString for finite doubles, from Python's shortest repr."""
    if x == 0:
        return "0"
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    r = repr(x)
    if "e" in r or "E" in r:
        mant, exp = r.lower().split("e")
        e = int(exp)
        if -7 < e < 21:
            return format(Decimal(r), "f")
        mant = mant.rstrip("0").rstrip(".") if "." in mant else mant
        return f"{mant}e{'+' if e > 0 else '-'}{abs(e)}"
    return r


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.floats(min_value=1e-5, max_value=1e6, allow_nan=False),
                          st.integers(0, 10 ** 6).map(lambda i: i / 64)), min_size=1, max_size=20))
def test_js_number_string_property(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "c double")
    got = [r[0] for r in df.select(js_number_string("c")).collect()]
    assert got == [js_string(v) for v in values]
