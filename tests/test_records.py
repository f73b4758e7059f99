"""CSV with line breaks inside quotes, split at every possible place, against Spark's one-task reader."""

import csv
import json
import random

import pytest

from conftest import rows_of
from ledgerlark.sources import io, records


@pytest.fixture
def small_splits(spark, request):
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum") if spark.conf.get(k, None)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    spark.conf.set("spark.sql.files.minPartitionNum", "16")
    yield request.param
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"):
        spark.conf.set(k, held[k]) if k in held else spark.conf.unset(k)


def field(r):
    return r.choice(["", "plain", "a,b", 'say "hi"', "two\nlines", '"', "\n", 'x\n"y"\n\nz,', "é ü", " pad ", "long " * 30 + "\n" + "tail " * 20])


def write_files(folder, seed, end="\n", files=3, rows=120):
    r = random.Random(seed)
    folder.mkdir()
    for n in range(files):
        with open(folder / f"{n}.csv", "w", newline="", encoding="utf-8") as f:
            w = csv.writer(f, lineterminator=end)
            w.writerow(["id", "First Name", "note", "e mail"])
            for i in range(rows):
                w.writerow([f"{n}-{i}", field(r), field(r), field(r)])


@pytest.mark.parametrize("small_splits, seed", [("97", 1), ("512", 2)], indirect=["small_splits"])
def test_equal_to_the_reader_of_whole_files(spark, tmp_path, small_splits, seed):
    write_files(tmp_path / "in", seed, files=2, rows=50)
    path = str(tmp_path / "in")
    want = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    got = records.read_csv(spark, path)
    assert got.columns == want.columns and rows_of(got) == rows_of(want)
    assert records._marked(spark, path).rdd.getNumPartitions() > 8


@pytest.mark.parametrize("small_splits", ["64"], indirect=True)
def test_line_ends_headers_and_blank_lines(spark, tmp_path, small_splits):
    (tmp_path / "in").mkdir()
    text = '﻿id,"two\r\nlines",ID,\r\n1,"a\r\nb",x,\r\n\r\n2,,"",last\r\n3,short\r\n4,a,b,c,too many\r\n5,"open \r\nto the end, ""quoted""",,z'
    (tmp_path / "in" / "a.csv").write_bytes(text.encode())
    got = records.read_csv(spark, str(tmp_path / "in"))
    assert got.columns == ["id0", "two\nlines", "ID2", "_c3"]
    whole = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "in"))
    assert rows_of(got) == rows_of(whole)
    assert sorted(tuple(r) for r in got.collect()) == [
        ("1", "a\nb", "x", None), ("2", None, None, "last"), ("3", "short", None, None), ("4", "a", "b", "c"), ("5", 'open \nto the end, "quoted"', None, "z")
    ]


@pytest.mark.parametrize("small_splits", ["200"], indirect=True)
def test_import_of_split_files(spark, tmp_path, small_splits):
    write_files(tmp_path / "in", 5, end="\r\n", files=2, rows=40)
    path = str(tmp_path / "in")
    split, whole = (io.import_csv_records(spark, path, "l1", **k) for k in ({}, {"whole_files": True}))
    plain = lambda df: sorted((r.record_type, json.dumps(json.loads(r.raw_data), sort_keys=True).replace("\\r", "")) for r in df.collect())
    assert plain(split) == plain(whole) and split.count() == 80


def test_empty_input(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("")
    assert records.read_csv(spark, str(tmp_path / "in")).count() == 0
    (tmp_path / "in" / "a.csv").write_text("id,name\n")
    assert records.read_csv(spark, str(tmp_path / "in")).columns == ["id", "name"] and records.read_csv(spark, str(tmp_path / "in")).count() == 0
