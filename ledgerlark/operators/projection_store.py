"""The stored usage projection, kept up to date partition by partition.

Rows lie by workspace, grain and day. A batch of signed deltas rewrites the partitions it touches and no
others: the new rows go to a folder of their own version beside the old one, named by the batch, and readers
take the newest version. A batch that is run again reads what was there before it and replaces its own folders,
so a retry changes nothing, whatever the failed run had written. `vacuum` removes superseded versions.
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.operators import usage
from ledgerlark.operators.common import stored
from ledgerlark.session import drop_folder

PLACE = ["workspace", "grain", "day"]
#: touched partitions that become a filter on folders; beyond that they are matched by a join
MOST_LISTED = 2000
_COLUMNS = [*usage.PROJECTION_KEY, *usage.MEASURES, "usage_row_count"]


class ProjectionStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    # ---- reading ---------------------------------------------------------------------------

    def _all(self) -> DataFrame | None:
        kinds = {**dict.fromkeys(usage.PROJECTION_KEY, "string"), "bucket_start": "timestamp", **dict.fromkeys(usage.COUNTERS, "bigint")}
        kinds |= {**dict.fromkeys(usage.FOUND + usage.COSTS, usage.MONEY), "usage_row_count": "bigint"}
        schema = ", ".join([*(f"{c} {kinds[c]}" for c in _COLUMNS), *(f"{c} string" for c in PLACE), "version bigint"])
        try:
            rows = self.spark.read.schema(schema).parquet(self.folder)
        except AnalysisException:  # nothing written yet
            return None
        return rows

    def _newest(self, rows: DataFrame, below: int | None = None) -> DataFrame:
        """The newest version of each partition, of those before `below`."""
        rows = rows if below is None else rows.filter(F.col("version") < below)
        # versions are folder names: finding the newest reads no column of the files
        newest = rows.groupBy(*PLACE).agg(F.max("version").alias("version"))
        return rows.join(newest, [*PLACE, "version"])

    def read(self, org_id: str | None = None) -> DataFrame:
        """The projection; one workspace is read from its own folders."""
        rows = self._all()
        if rows is None:
            raise FileNotFoundError(self.folder)
        if org_id is not None:
            rows = rows.filter(F.col("workspace") == _workspace(F.lit(org_id)))
        return self._newest(rows).filter("usage_row_count > 0").select(*_COLUMNS)

    # ---- writing ---------------------------------------------------------------------------

    def _touched(self, rows: DataFrame, marks: DataFrame) -> DataFrame:
        listed = marks.limit(MOST_LISTED + 1).collect()  # at most MOST_LISTED + 1 folder names
        if len(listed) > MOST_LISTED:
            return rows.join(marks, PLACE, "left_semi")
        name = F.concat_ws("/", *PLACE)
        return rows.filter(name.isin(["/".join(r) for r in listed]))

    def apply(self, deltas: DataFrame, batch: int) -> None:
        """Add signed rows (see `usage.build_signed`). Batches are numbered upwards; a number used before is replaced.

        Groups that reach zero rows disappear and a group below zero fails the job.
        """
        placed = stored(usage.sum_deltas(deltas).withColumns(_place()), "deltas")
        marks = placed.select(*PLACE).distinct()
        rows = placed.select(*_COLUMNS)
        past = self._all()
        if past is not None:
            rows = usage.sum_deltas(self._newest(self._touched(past, marks), batch).filter("usage_row_count > 0").select(*_COLUMNS).unionByName(rows))
        kept = usage.checked_sums(rows).withColumns(_place())
        # a row without content in each touched partition, so that one without groups has a new version, too
        empty = marks.select(*(F.lit(0 if c == "usage_row_count" else None).cast(kept.schema[c].dataType).alias(c) for c in _COLUMNS), *PLACE)
        out = kept.unionByName(empty).withColumn("version", F.lit(batch).cast("bigint"))
        # one file for a partition, more for a large one
        out.hint("rebalance", *PLACE).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(*PLACE, "version").parquet(self.folder)

    def vacuum(self) -> int:
        """Remove the folders that newer versions have replaced; returns how many."""
        rows = self._all()
        if rows is None:
            return 0
        held = rows.select(*PLACE, "version").distinct()
        newest = held.groupBy(*PLACE).agg(F.max("version").alias("newest"))
        old = held.join(newest, PLACE).filter("version < newest").select(*PLACE, "version")
        gone = 0
        for row in old.toLocalIterator():  # folder names, one after the other
            drop_folder(self.spark, os.path.join(self.folder, *(f"{c}={row[c]}" for c in PLACE), f"version={row['version']}"))
            gone += 1
        return gone


def _workspace(org: Column) -> Column:
    """A folder name for any workspace: none for NULL, others behind a letter, so that they stay texts."""
    return F.coalesce(F.concat(F.lit("w"), F.hex(org)), F.lit("none"))


def _place() -> dict[str, Column]:
    return {"workspace": _workspace(F.col("organization_id")), "grain": F.col("bucket_granularity"), "day": F.date_format("bucket_start", "yyyy-MM-dd")}

