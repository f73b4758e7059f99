"""Change rows between two states of a keyed table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def joined_states(old: DataFrame, new: DataFrame, key: list[str], columns: list[str] | None = None) -> DataFrame:
    """Full outer join of two states as structs `old` and `new` next to the key."""
    columns = columns or [c for c in new.columns if c not in key]
    before = old.select(*key, F.struct(*columns).alias("old"))
    after = new.select(*key, F.struct(*columns).alias("new"))
    return before.join(after, key, "full_outer")


def differs(column: str) -> Column:
    return ~F.col(f"old.{column}").eqNullSafe(F.col(f"new.{column}"))


def change_feed(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """INSERT, UPDATE and DELETE rows with both states as JSON and the changed columns.

    `changes` maps a column of an UPDATE to its old and new value as text. Rows without a change
    do not appear.
    """
    columns = [c for c in new.columns if c not in key]
    rows = joined_states(old, new, key, columns)
    kind = F.when(F.col("old").isNull(), "INSERT").when(F.col("new").isNull(), "DELETE").otherwise("UPDATE")

    def entry(c: str) -> Column:
        values = F.struct(F.col(f"old.{c}").cast("string").alias("old"), F.col(f"new.{c}").cast("string").alias("new"))
        return F.when(differs(c), F.struct(F.lit(c).alias("key"), values.alias("value")))

    changes = F.map_from_entries(F.array_compact(F.array(*(entry(c) for c in columns))))
    rows = rows.withColumn("event_type", kind).withColumn("changes", F.when(F.col("event_type") == "UPDATE", changes))
    rows = rows.filter((F.col("event_type") != "UPDATE") | (F.size("changes") > 0))
    state = lambda side: F.when(F.col(side).isNotNull(), F.to_json(F.struct(*key, f"{side}.*"))).alias(side)
    return rows.select(*key, "event_type", state("old"), state("new"), "changes")
