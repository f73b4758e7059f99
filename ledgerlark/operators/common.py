"""Small building blocks shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.session import work_dir

MONEY = "decimal(38,6)"


def for_org(df: DataFrame, org_id: str | None) -> DataFrame:
    """Tenant scope as an early filter; None keeps every tenant."""
    return df if org_id is None else df.filter(F.col("organization_id") == org_id)


def wanted(value) -> bool:
    """Optional filters treat None and '' as no filter."""
    return value is not None and value != ""


def total(name: str) -> Column:
    """Sum that reads NULL as 0."""
    return F.sum(F.coalesce(F.col(name), F.lit(0)))


def money(name: str) -> Column:
    return total(name).cast(MONEY)


def count_where(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def percent(part: Column, whole: Column) -> Column:
    """Rounded share in percent, 0 for an empty whole."""
    wide = "decimal(20,0)"
    share = F.round(part.cast(wide) * 100 / F.nullif(whole.cast(wide), F.lit(0).cast(wide)), 2)
    return F.coalesce(share, F.lit(0)).cast("decimal(12,2)")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key. The `rank == 1` filter lets Spark keep one row per key and map task
    before the shuffle, so a hot key never reaches a task whole."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") == 1).drop("_rank")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """At most k rows per key, pruned before the shuffle like `first_per_key`."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k).drop("_rank")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared work folder and read back: a stable cut of the lineage."""
    path = work_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def spread(df: DataFrame, *columns: str, rows: int = 1 << 18) -> DataFrame:
    """The rows over so many tasks that each has about `rows`, by columns with many values.

    For rows that take little room where they lie and much in the next step: a split of a compressed file may
    hold millions. Counting reads no columns of a file unless the rows are filtered.
    """
    return df.repartition(tasks_for(df, rows), *columns)


def tasks_for(df: DataFrame, rows: int = 1 << 18) -> int:
    """So many tasks that each has about `rows`, and none of the cores is idle."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


def number_rows(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Dense 1-based numbers per group in a total order, without a one-task window.

    Rows are range-sorted over all tasks and stored; the numbers are the position inside a
    range plus the sizes of the group's earlier ranges (ranges x groups rows, tiny).
    """
    tagged = (
        df.repartitionByRange(group, *order)
        .sortWithinPartitions(group, *order)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_range", F.shiftright("_at", 33))
    )
    kept = stored(tagged, "numbered")
    sizes = kept.groupBy(group, "_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_from"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(group, "_range", "_from", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (
        kept.join(offsets, [group, "_range"])
        .withColumn(name, F.col("_before") + F.col("_at") - F.col("_from") + 1)
        .drop("_at", "_range", "_from", "_before")
    )
