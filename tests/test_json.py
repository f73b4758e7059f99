import json

import pytest
from pyspark.sql import functions as F

from ledgerlark.functions import json as J

KEYS = {"found": None, "items": None, "email": None}


def wrap(value, times):
    for _ in range(times):
        value = json.dumps(value)
    return value


@pytest.mark.parametrize("times, kept", [(0, True), (1, True), (3, True), (4, False)])
def test_object_is_unwrapped_up_to_three_times(spark, times, kept):
    df = spark.createDataFrame([(wrap('{"a":1}', times),)], "t string")
    assert (df.select(J.json_object_of(F.col("t")).isNotNull()).head()[0]) is kept


@pytest.mark.parametrize("text", [None, "[1]", "7", "null", "{bad", '"text"', '"{bad"', ""])
def test_other_values_hold_no_object(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(J.json_object_of(F.col("t"))).head()[0] is None
    fields = df.select(J.json_fields(J.plain_json(F.col("t")), ["a"]).alias("f")).select("f.a")
    assert fields.head()[0] is None


def count(spark, text):
    df = spark.createDataFrame([(text,)], "t string").withColumn("plain", J.plain_json(F.col("t")))
    df = df.withColumn("f", J.json_fields(F.col("plain"), list(KEYS)))
    return float(df.select(J.count_of("plain", "f", list(KEYS))).head()[0])


@pytest.mark.parametrize(
    "text, want",
    [
        ('{"found": 4}', 4), ('{"found": " 2.5 "}', 2.5), ('{"found": 0, "items": [1, 2]}', 2), ('{"found": -3, "email": "x"}', 1), ('{"found": [], "items": {"total": 5}}', 5),
        ('{"items": {"count": 0, "length": "7"}}', 7), ('{"items": {"other": 1}, "email": false}', 1), ('{"email": ""}', 0), ('{"email": "  "}', 0), ('{"email": null}', 0), ("{}", 0), (None, 0),
        ('{"found": "[1,2,3]"}', 1), ('{"found": "[\\u0031,2]"}', 1), ('{"items": "{\\"count\\": 9}"}', 1), ('{"items": [[1, 2], "a"]}', 2), (json.dumps('{"found": 3}'), 3),
    ],
)
def test_count(spark, text, want):
    assert count(spark, text) == want


def test_number_and_bool(spark):
    df = spark.createDataFrame([("12",), (" -1.5 ",), ("1e3",), ("x",), (None,), ("true",), ("YES",), ("0",)], "t string")
    got = df.select(J.number_of(F.col("t")).cast("double"), J.bool_of(F.col("t"))).collect()
    assert [r[0] for r in got] == [12, -1.5, 0, 0, 0, 0, 0, 0]
    assert [r[1] for r in got] == [False, False, False, False, False, True, True, False]


def test_set_keeps_types(spark):
    df = spark.createDataFrame([('{"n": 1, "a": [1, {"b": null}], "s": "x"}',), (None,), ("[1]",)], "t string")
    got = [json.loads(r[0]) for r in df.select(J.json_set(F.col("t"), {"s": F.lit("new")}, {"o": F.lit('{"k": 2}')})).collect()]
    assert got[0] == {"n": 1, "a": [1, {"b": None}], "s": "new", "o": {"k": 2}}
    assert got[1] == got[2] == {"s": "new", "o": {"k": 2}}
    removed = df.select(J.json_remove(F.col("t"), ["a"])).head()[0]
    assert json.loads(removed) == {"n": 1, "s": "x"}
