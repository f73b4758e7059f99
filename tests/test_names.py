"""Trigram search against brute force: substrings, similar names, and pairs at the threshold."""

import random
import re

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from ledgerlark.operators.names import NameIndex, similarity, trigrams


def grams(text):
    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    return {f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1)}


def alike(a, b):
    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b) if a | b else 0.0


def some_names(seed=4, n=300):
    r = random.Random(seed)
    parts = ["Anna", "Ana", "Hannah", "Müller", "Mueller", "van", "Smith", "Smyth", "Acme", "Corp", "GmbH", "O'Neil", "99", "x", "Li"]
    rows = [(i, " ".join(r.choice(parts) for _ in range(r.choice([1, 2, 3])))) for i in range(n)]
    return [*rows, (1000, None), (1001, ""), (1002, " - "), (1003, "Anna" * 2000), (1004, "acme  CORP"), (1005, "ÉCLAIR")]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    names = spark.createDataFrame(some_names(), "id long, name string").repartition(3).cache()
    index = NameIndex(spark, str(tmp_path_factory.mktemp("names") / "index"))
    index.build(names)
    return index, names


def test_trigrams(spark):
    got = {r.id: (None if r.t is None else set(r.t)) for r in spark.createDataFrame(some_names(), "id long, name string").withColumn("t", trigrams(F.col("name"))).collect()}
    assert got == {i: None if t is None else grams(t) for i, t in some_names()}
    assert grams("Li") == {"  l", " li", "li "}


@pytest.mark.parametrize("text", ["ann", "ANNA s", "mue", "üll", "e corp", "x", "%", "zzz", "acme corp", "o'neil", "nnaanna", "éclair"])
def test_substrings(index, text):
    index, names = index
    want = sorted((i, t) for i, t in some_names() if t is not None and text.lower() in t.lower())
    assert sorted(tuple(r) for r in index.containing(names, text).collect()) == want


@pytest.mark.parametrize("threshold", [0.2, 0.3, 0.5, 1 / 3, 0.8, 1.0])
def test_similar_names(spark, index, threshold):
    index, names = index
    asked = [("q1", "Ana Smith"), ("q2", "Mueler"), ("q3", "acme corp"), ("q4", ""), ("q5", None), ("q6", "qqq www"), ("q7", "Anna Anna Li"), ("q8", "x")]
    queries = spark.createDataFrame(asked, "query string, text string")
    got = {(r.query, r.id): r.similarity for r in index.similar(names, queries, threshold).collect()}
    want = {(q, i): alike(a, b) for q, a in asked for i, b in some_names() if alike(a, b) >= threshold - 1e-12}
    assert got == pytest.approx(want)


def test_threshold_is_checked_and_empty_tables(spark, index, tmp_path):
    index, names = index
    with pytest.raises(ValueError):
        index.similar(names, names.select(F.lit("q").alias("query"), F.lit("t").alias("text")), 0)
    empty = NameIndex(spark, str(tmp_path / "none"))
    empty.build(names.limit(0))
    assert empty.containing(names.limit(0), "anna").collect() == []
    assert rows_of(spark.range(1).select(similarity(F.array(), F.array()).alias("s"))) == [(0.0,)]


def test_only_asked_row_groups_are_read(index):
    index, names = index
    plan = names.sparkSession._jvm.PythonSQLUtils.explainString(index.containing(names, "mueller")._jdf.queryExecution(), "formatted")
    assert "In(trigram," in plan


def test_repeated_names_are_compared_once(spark, tmp_path):
    names = spark.createDataFrame([(i, f"Anna Smith{i % 3}") for i in range(600)], "id long, name string")
    queries = spark.createDataFrame([(q, "Anna Smith1") for q in range(40)], "query long, text string")
    index = NameIndex(spark, str(tmp_path / "index"))
    index.build(names)
    rows = index.similar(names, queries, 0.5)
    got = {(r.query, r.id): r.similarity for r in rows.collect()}
    assert got == pytest.approx({(q, i): alike("Anna Smith1", f"Anna Smith{i % 3}") for q in range(40) for i in range(600)})
    # one set of trigrams asks, three are asked for: the comparison has them and no ids
    compared = [len(part) for part in ("a_grams", "b_grams") for part in [spark.read.parquet(*_sets_with(rows, part)).collect()]]
    assert compared == [1, 3]


def _sets_with(rows, column):
    return [f for f in rows.inputFiles() if "/sets-" in f and column in rows.sparkSession.read.parquet(f).columns]
