"""Data-quality checks and clean-up as snapshot transforms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORG = "organization_id"


def drop_orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str = "id") -> DataFrame:
    """Keep the rows whose reference exists in the same workspace."""
    return child.join(parent.select(ORG, F.col(parent_key).alias(key)), [ORG, key], "left_semi")


def null_orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str = "id") -> DataFrame:
    """Blank references that do not exist; all rows stay."""
    known = parent.select(ORG, F.col(parent_key).alias(key), F.lit(True).alias("_known")).distinct()
    return child.join(known, [ORG, key], "left").withColumn(key, F.when(F.col("_known"), F.col(key))).drop("_known")


def same_org(child: DataFrame, parent: DataFrame, key: str, parent_key: str = "id") -> DataFrame:
    """Violations: references that are set but not a row of the child's own workspace."""
    return child.filter(F.col(key).isNotNull()).join(parent.select(ORG, F.col(parent_key).alias(key)), [ORG, key], "left_anti")


def allowed_values(df: DataFrame, column: str, allowed: Sequence[str], default: str | None, mapping: Mapping[str, str] | None = None) -> DataFrame:
    """Map legacy values, then replace what is still not allowed by the default. NULL stays."""
    value: Column = F.col(column)
    for old, new in (mapping or {}).items():
        value = F.when(F.col(column) == old, F.lit(new)).otherwise(value)
    return df.withColumn(column, F.when(value.isNull() | value.isin(*allowed), value).otherwise(F.lit(default)))


def unique(df: DataFrame, keys: Sequence[str], where: Column | None = None) -> DataFrame:
    """Key groups that break a (partial) unique rule. NULL keys never collide."""
    rows = df if where is None else df.filter(where)
    for k in keys:
        rows = rows.filter(F.col(k).isNotNull())
    return rows.groupBy(*keys).agg(F.count("*").alias("rows")).filter(F.col("rows") > 1)


def table_contract(tables: Mapping[str, DataFrame], primary_keys: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Per table: hash of (column, type, nullability) in order, whether a key is declared, and its size in rows."""
    keys = primary_keys or {}
    out = None
    for name, df in tables.items():
        contract = "|".join(f"{f.name}:{f.dataType.simpleString()}:{str(not f.nullable).lower()}" for f in df.schema.fields)
        row = df.agg(F.count("*").alias("rows")).select(
            F.lit(name).alias("table_name"), F.md5(F.lit(contract)).alias("column_contract_hash"), F.lit(name in keys).alias("has_primary_key"),
            F.lit(len(df.schema.fields)).alias("columns"), "rows",
        )
        out = row if out is None else out.unionByName(row)
    return out


def _fingerprint() -> Column:
    empty = lambda c: F.when(F.col(c) != "", F.col(c))
    parts = F.struct(
        "version", F.coalesce("size", F.lit(0)).alias("size"), empty("etag").alias("etag"), empty("mimetype").alias("mimetype"),
        empty("cache_control").alias("cache_control"), F.coalesce("user_metadata", F.lit("{}")).alias("user_metadata"),
    )
    return F.sha2(F.to_json(parts, {"ignoreNullFields": "false"}), 256)


def manifest_diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Objects by (bucket, name): added, changed, removed or unchanged by fingerprint."""
    key = ["bucket_id", "name"]
    before = previous.select(*key, _fingerprint().alias("previous_fingerprint"))
    after = current.select(*key, _fingerprint().alias("fingerprint"))
    old, new = F.col("previous_fingerprint"), F.col("fingerprint")
    state = F.when(new.isNull(), "removed").when(old.isNull(), "added").when(old != new, "changed").otherwise("unchanged")
    return before.join(after, key, "full_outer").withColumn("change", state)


def links_from_key(children: DataFrame, key: str, existing: DataFrame | None = None) -> DataFrame:
    """Bridge rows (workspace, id, key) from a foreign-key column, without those that exist."""
    pairs = children.filter(F.col(key).isNotNull()).select(ORG, F.col("id").alias("child_id"), key).distinct()
    return pairs if existing is None else pairs.join(existing.select(ORG, "child_id", key), [ORG, "child_id", key], "left_anti")


def remove_references(df: DataFrame, array_column: str, files: DataFrame) -> DataFrame:
    """Drop ids of files that no longer exist from an array column.

    The array is taken apart, matched and put together per row id, so the list of files is never
    collected or broadcast; the order of the remaining ids is kept.
    """
    at = F.posexplode(array_column).alias("_pos", "_file")
    known = files.select(ORG, F.col("id").alias("_file"))
    kept = df.select(ORG, "id", at).join(known, [ORG, "_file"], "left_semi")
    kept = kept.groupBy(ORG, "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_file"))), lambda x: x["_file"]).alias("_kept"))
    empty = F.array().cast("array<string>")
    return df.join(kept, [ORG, "id"], "left").withColumn(array_column, F.when(F.col(array_column).isNotNull(), F.coalesce("_kept", empty))).drop("_kept")


def fill_nulls(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Replace NULL by a literal, or by another column when the default is a Column."""
    return df.withColumns({c: F.coalesce(F.col(c), d if isinstance(d, Column) else F.lit(d)) for c, d in defaults.items()})
