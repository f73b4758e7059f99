"""Table scans and the table set handed to every registered query."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlark.session import prepare
from ledgerlark.sources.adapters import ADAPTERS, BASE_TABLES, dependencies
from ledgerlark.sources.layouts import SCHEMAS

#: a stored type may be narrower than the declared one
_WIDER = {("int", "bigint"), ("float", "double"), ("int", "double"), ("date", "timestamp")}


def read_tables(spark: SparkSession, folder: str, names=None) -> dict[str, DataFrame]:
    """Parquet scans, one per name; declared layouts are applied where known."""
    names = list(names or BASE_TABLES)
    return {n: read_table(spark, folder, n) for n in names}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet scan. A table with a declared layout must have its columns; others that it has are left out."""
    rows = prepare(spark).read.parquet(os.path.join(folder, f"{name}.parquet"))
    return conform(rows, name) if name in SCHEMAS else rows


def layout_faults(found: T.StructType, name: str) -> list[str]:
    """What keeps a table from its declared layout: missing columns and types that hold less."""
    have, faults = {f.name: f.dataType for f in found}, []
    for f in T.StructType.fromDDL(SCHEMAS[name]):
        if f.name not in have:
            faults.append(f"{f.name} is missing")
        elif not _fits(have[f.name], f.dataType):
            faults.append(f"{f.name} is {have[f.name].simpleString()}, not {f.dataType.simpleString()}")
    return faults


def _fits(stored: T.DataType, declared: T.DataType) -> bool:
    if isinstance(stored, T.ArrayType) and isinstance(declared, T.ArrayType):
        return _fits(stored.elementType, declared.elementType)
    if isinstance(stored, T.DecimalType) and isinstance(declared, T.DecimalType):
        return stored.scale <= declared.scale and stored.precision - stored.scale <= declared.precision - declared.scale
    return stored == declared or (stored.simpleString(), declared.simpleString()) in _WIDER


def conform(rows: DataFrame, name: str) -> DataFrame:
    """The columns of the declared layout, in its order and types; raises if the table does not hold them."""
    faults = layout_faults(rows.schema, name)
    if faults:
        raise ValueError(f"table {name}: " + "; ".join(faults))
    kinds = {f.name: f.dataType for f in rows.schema}
    return rows.select(*[F.col(f.name) if kinds[f.name] == f.dataType else F.col(f.name).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(SCHEMAS[name])])


class Tables:
    """Lazy access to the driver tables and to the CRM-shaped tables derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = prepare(spark)
        self.folder = folder
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in ADAPTERS and name not in BASE_TABLES):
            raise AttributeError(name)
        if name not in self._cache:
            self._cache[name] = self._load(name)
        return self._cache[name]

    def _load(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return read_table(self.spark, self.folder, name)
        text = ADAPTERS[name]
        return self.spark.sql(text, **{d: getattr(self, d) for d in dependencies(text)})
