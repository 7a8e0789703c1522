import json

import pytest
from pyspark.sql import functions as F

from graphlens.functions.json import canonical, canonical_text, number

VALUES = [
    {"b": 1, "a": [1, 2.5, {"z": None, "y": True}], "ä": "é\"\\\n\t\u001f/ 😀"}, [], {}, [[], {}, [[1]]], None, 7, "x|y", -0.5, 1e16, 1e-5, 123456789.125, 1e22, 1.5e300, 12345678901234567890, {"a|b": None, "a": "b|"},
    {"deep": {"er": {"est": [{"k": [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11]}]}}}, 0.0001, 1e15, 100.0, 0.00012345, {"": {"": ""}},
]


@pytest.mark.parametrize("ascii_only", [False, True])
def test_texts_of_any_shape(spark, ascii_only):
    rows = [(k, json.dumps(v, ensure_ascii=bool(k % 2), indent=k % 3 or None)) for k, v in enumerate(VALUES)] + [(98, "{"), (99, None)]
    got = {r.id: r.canonical for r in canonical_text(spark.createDataFrame(rows, "id long, text string"), "id", "text", ascii_only).collect()}
    want = {k: json.dumps(v, ensure_ascii=ascii_only, sort_keys=True, separators=(",", ":")) for k, v in enumerate(VALUES)} | {98: None, 99: None}
    assert got == want


def test_declared_types(spark):
    schema = "v struct<name:string, b:int, a:array<struct<y:double, x:boolean>>, m:map<string,bigint>, n:string>"
    values = [{"name": "é|", "b": 3, "a": [{"y": 1e-7, "x": True}, {"y": 2.0, "x": None}], "m": {"q": 1, "p": None}, "n": None}, {"name": None, "b": None, "a": None, "m": {}, "n": "null"}]
    df = spark.createDataFrame([(v,) for v in values], schema)
    got = [r[0] for r in df.select(canonical(F.col("v"), df.schema["v"].dataType, True)).collect()]
    assert got == [json.dumps(v, sort_keys=True, separators=(",", ":")) for v in values]


def test_numbers(spark):
    values = [0.1, -0.0, 1e7, 12345678.9, 1e-3, 9.999e-4, 1.234e-5, 2.5e-300, 1.7976931348623157e308, 123456789012345680.0, 2.0**53, 3.0, -1e21]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(number(F.col("v"))).collect()]
    assert got == [json.dumps(v) for v in values]


def test_levels_are_never_broadcast(spark):
    """A level's size on disk, less its variants, is guessed at a hundredth of what its rows take."""
    df = spark.range(2000).selectExpr("id", """'{"a": [' || id || ', {"b": "' || id || '"}]}' AS text""")
    plan = canonical_text(df, "id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
