"""CSV files with line breaks inside quotes, read by many tasks.

Where a record begins depends on all quotes before it, but only on whether their number is odd. So files are
read as lines, split over tasks as any text. A first pass finds for each block of a file whether its
quotes are odd in number, and where its last record begins, for both cases of what comes before; sums over the
few blocks of a file then tell which case holds. In the second pass each line knows its record. Lines that
are records, nearly all, stay where they are; only the pieces of records with line breaks are brought together.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUOTE = '"'
#: a block's lines are numbered from 0; there is no line before the first
NONE = -1


def _marked(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file, block and number, their quotes, and for both cases the line with which their record begins.

    `odd`: whether the block has an odd number of quotes before the line. `even_head`, `odd_head`: the last line up to this
    one with an even or odd number of quotes before it.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit(QUOTE), F.lit("")))
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), quotes.alias("quotes"), "value"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come in the order of the file; what is known of the block at hand goes from batch to batch
        at, number, before, heads = None, 0, 0, [NONE, NONE]
        for batch in batches:
            file, block, n = (batch.column(c).to_numpy() for c in ("file", "block", "quotes"))
            out = np.empty((4, len(n)), np.int64)
            edges = np.flatnonzero(np.concatenate([[True], (file[1:] != file[:-1]) | (block[1:] != block[:-1])])) if len(n) else []
            for a, b in zip(edges, [*edges[1:], len(n)], strict=True):
                if (file[a], block[a]) != at:
                    at, number, before, heads = (file[a], block[a]), 0, 0, [NONE, NONE]
                numbers = np.arange(number, number + b - a)
                odd = (before + np.cumsum(n[a:b]) - n[a:b]) % 2
                out[0, a:b], out[1, a:b] = numbers, odd
                for case in (0, 1):
                    found = np.maximum.accumulate(np.where(odd == case, numbers, NONE))
                    out[2 + case, a:b] = np.maximum(found, heads[case])
                    heads[case] = int(out[2 + case, b - 1])
                number, before = number + b - a, int(before + n[a:b].sum()) % 2
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, out)], ["file", "block", "quotes", "value", "number", "odd", "even_head", "odd_head"])

    return lines.mapInArrow(run, "file long, block long, quotes int, value string, number long, odd long, even_head long, odd_head long")


def _blocks(lines: DataFrame) -> DataFrame:
    """file, block, inside (whether the block begins inside quotes), carried (the record that it goes on with): a row for each block."""
    each = lines.groupBy("file", "block").agg((F.sum("quotes") % 2).alias("turns"), F.max("even_head").alias("even_head"), F.max("odd_head").alias("odd_head"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("inside", F.coalesce(F.sum("turns").over(before), F.lit(0)) % 2)
    head = F.when(F.col("inside") == 0, F.col("even_head")).otherwise(F.col("odd_head"))
    last = F.when(head != NONE, F.struct("block", head.alias("number")))
    return each.withColumn("carried", F.last(last, ignorenulls=True).over(before)).select("file", "block", "inside", "carried")


def csv_texts(spark: SparkSession, path: str) -> DataFrame:
    """file, block, number, text: the records of CSV files as text, with their quotes and line breaks; blank lines between records are left out."""
    lines = _marked(spark, path)
    lines = lines.join(_blocks(lines), ["file", "block"])
    begins = F.col("odd") == F.col("inside")
    head = F.when(F.col("inside") == 0, F.col("even_head")).otherwise(F.col("odd_head"))
    record = F.when(head != NONE, F.struct("block", head.alias("number"))).otherwise(F.col("carried"))
    lines = lines.select("file", "block", "number", "value", record.alias("record"), (begins & (F.col("quotes") % 2 == 0)).alias("whole"))
    whole = lines.filter("whole").select("file", "block", "number", F.col("value").alias("text"))
    # a group is one record
    pieces = lines.filter("NOT whole").groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("block", "number", "value"))).alias("pieces"))
    joined = pieces.select("file", "record.block", "record.number", F.array_join(F.transform("pieces", lambda p: p["value"]), "\n").alias("text"))
    # lines may end in both signs; inside quotes one is left, as Spark's reader has it
    both = whole.unionByName(joined).withColumn("text", F.replace(F.regexp_replace("text", "\r$", ""), F.lit("\r\n"), F.lit("\n")))
    return both.filter(F.trim("text") != "")


def header_names(text: str) -> list[str]:
    """Column names of a header record, made distinct as Spark's reader does."""
    names = next(csv.reader([text.removeprefix("﻿")] if "\n" not in text else text.removeprefix("﻿").splitlines(keepends=True)), [])
    low = [n.lower() for n in names]
    return [f"_c{i}" if not n else f"{n}{i}" if low.count(n.lower()) > 1 else n for i, n in enumerate(names)]


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """The rows of CSV files with a header in each; every column is text, empty unquoted fields are NULL.

    The result is that of Spark's reader with `multiLine`, in which a task reads a whole file. The names
    are those of the first file in order of its hash, which only matters if the headers differ. Without
    files or lines there are no columns.
    """
    texts = csv_texts(spark, path)
    # the first line of a file is in its first block
    first = (F.col("block") == 0) & (F.col("number") == 0)
    header = texts.filter(first).orderBy("file").select("text").first()
    if header is None:
        return spark.createDataFrame([], "struct<>")
    names = header_names(header["text"])
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    row = F.from_csv("text", schema, {"escape": QUOTE, "multiLine": "true"})
    return texts.filter(~first).select(row.alias("r")).select(*[_field(n) for n in names])


def _field(name: str) -> Column:
    return F.col("r").getField(name).alias(name)
