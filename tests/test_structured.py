"""Repair and schema checks of answers."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from corpusgraph.functions import structured

CASES = [
    ('{"a": 1, "b": "x"}', {"a": 1, "b": "x"}), ('```json\n{"a": 1, "b": "x"}\n```', {"a": 1, "b": "x"}), ('Here:\n```\n{"a": 1, "b": "}"}\n```\nDone {ok}', {"a": 1, "b": "}"}),
    ('{"a": 1, "b": "x",}', {"a": 1, "b": "x"}), ('{"a": 1, "b": "x, ]", "c": [1, 2,],}', {"a": 1, "b": "x, ]", "c": [1, 2]}), ('{"a": 1, "b": "cut of', {"a": 1, "b": "cut of"}),
    ('{"a": 1, "c": [{"d": [1, 2', {"a": 1, "c": [{"d": [1, 2]}]}), ('{"a": 1, "b":', {"a": 1, "b": None}), ('{"a": 1, "b', {"a": 1}), ('{"a": 1, "b": tr', {"a": 1}), ('{"a": 1,', {"a": 1}),
    ('{"a": "say \\"hi\\", {', {"a": 'say "hi", {'}), ("{", {}), ("", None), (None, None), ("no object", None), ("[1, 2]", None), ('{"a" 1}', None), ('x {"a": {"b": {"c": 2}}} y', {"a": {"b": {"c": 2}}}),
]


def test_repair(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, t string")
    got = {r["i"]: r["v"] for r in rows.select("i", F.to_json(structured.parsed(F.col("t"))).alias("v")).collect()}
    for i, (text, want) in enumerate(CASES):
        assert (json.loads(got[i]) if got[i] is not None else None) == want, text


@pytest.mark.parametrize(
    ("text", "fault"),
    [
        ('{"n": 1, "s": "x", "o": {"b": true}}', ""), ('{"n": 1.5, "s": "x", "o": {"b": true}, "l": [1]}', ""), ('{"n": "1", "s": "x", "o": {"b": true}}', "$.n: number expected, not string"),
        ('{"n": 1, "o": {"b": true}}', "$.s: missing"), ('{"n": 1, "s": null, "o": {"b": true}}', "$.s: missing"), ('{"n": 1, "s": "x", "o": {"b": 0}}', "$.o.b: boolean expected, not bigint"),
        ('{"n": 1, "s": "x", "o": {"b": true}, "l": {}}', "$.l: array expected, not object"), ("nothing", "not an object"), ('{"n": 1, "s": "x", "o": [1]}', "$.o: object expected, not array"),
    ],
)
def test_schema(spark, text, fault):
    schema = {"n": "number", "s": "string", "o": "object", "o.b": "boolean", "l": "array?"}
    row = spark.createDataFrame([(text,)], "t string").select(structured.checked(F.col("t"), schema).alias("x")).select("x.fault", F.to_json("x.value").alias("v")).first()
    assert row["fault"] == fault and (row["v"] is None) == (fault != "")
