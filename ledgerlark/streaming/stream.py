"""Continuous forms of the event operators.

Streams are read from files, as append-only event tables are written. Every job keeps its
checkpoint and its output under the shared work folder and can be restarted there.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.operators import usage
from ledgerlark.operators.common import first_per_key, spread, stored
from ledgerlark.operators.dashboard import _reply_candidates
from ledgerlark.operators.projection_store import ProjectionStore
from ledgerlark.session import prepare, work_dir
from ledgerlark.streaming import keyed

ORG = "organization_id"


def read_events(spark: SparkSession, folder: str, schema, file_format: str = "parquet", glob: str | None = None, max_files: int | None = None) -> DataFrame:
    """Append-only events of a folder as a stream; the schema is declared, never inferred."""
    reader = prepare(spark).readStream.schema(schema).format(file_format)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(folder)


def read_table_events(spark: SparkSession, folder: str, table: str, schema) -> DataFrame:
    """The events of a Parquet table that is a file in the folder or a folder of files there. Streams are of folders only."""
    path = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(folder, table))
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return read_events(spark, os.path.join(folder, table), schema)
    return read_events(spark, folder, schema, glob=table)


# ---- running a stream to the end of its input -----------------------------------------------


def _batch_path(store: str, batch_id: int) -> str:
    return os.path.join(store, f"batch={batch_id}")


def run_to_store(stream: DataFrame, store: str, output_mode: str, made=lambda batch: batch) -> None:
    """Process all input there is and stop. What is `made` of batch n is written to `batch=n`, replaced when retried."""

    def write(batch: DataFrame, batch_id: int) -> None:
        made(batch).write.mode("overwrite").parquet(_batch_path(store, batch_id))

    job = (
        stream.writeStream.outputMode(output_mode)
        .option("checkpointLocation", os.path.join(store, "_checkpoint"))
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    job.awaitTermination()


def read_store(spark: SparkSession, store: str) -> DataFrame:
    """All batches of a store."""
    return spark.read.option("basePath", store).option("pathGlobFilter", "*.parquet").parquet(os.path.join(store, "batch=*"))


def latest_rows(rows: DataFrame, key: list[str]) -> DataFrame:
    """Newest emitted version per key of an update-mode store."""
    rest = [c for c in rows.columns if c not in key and c != "batch"]
    newest = rows.groupBy(*key).agg(F.max(F.struct("batch", *rest)).alias("v"))
    return newest.select(*key, *(F.col(f"v.{c}").alias(c) for c in rest))


def run_and_read(stream: DataFrame, label: str, output_mode: str, store: str | None = None) -> DataFrame:
    spark = stream.sparkSession
    store = store or work_dir(spark, label)
    run_to_store(stream, store, output_mode)
    return read_store(spark, store)


# ---- jobs -----------------------------------------------------------------------------------


def _bounded(events: DataFrame, time_column: str, lateness: str | None) -> DataFrame:
    """With a lateness, later rows are dropped and state is forgotten; without, nothing is."""
    return events if lateness is None else events.withWatermark(time_column, lateness)


def usage_buckets(events: DataFrame, grain: str = "hour", lateness: str | None = None) -> DataFrame:
    """Hour or day aggregates of the usage stream over the full dimension key, in update mode.

    The state is as large as the aggregates; rows count however late they come, unless `lateness` is given.
    Without it, `UsageBuckets` keeps the same aggregates and no state.
    """
    rows = _bounded(usage.contribution(events), "occurred_at", lateness)
    return (
        rows.groupBy(F.window("occurred_at", f"1 {grain}").alias("w"), *usage.DIMENSIONS)
        .agg(
            *(F.sum(m).alias(m) for m in usage.COUNTERS),
            *(F.sum(m).cast(usage.MONEY).alias(m) for m in usage.FOUND + usage.COSTS),
            F.count("*").alias("usage_row_count"),
        )
        .withColumns({"bucket_granularity": F.lit(grain), "bucket_start": F.col("w.start")})
        .drop("w")
    )


def dedup_events(events: DataFrame, time_column: str = "received_at", lateness: str | None = None) -> DataFrame:
    """One row per workspace and dedup key; keys are remembered for ever, or for `lateness` if given.

    The keys lie in RocksDB, on disk; a batch looks up its own.
    """
    if lateness is None:
        return events.dropDuplicates([ORG, "dedup_key"])
    return _bounded(events, time_column, lateness).dropDuplicatesWithinWatermark([ORG, "dedup_key"])


def first_replies(emails: DataFrame, replies: DataFrame) -> DataFrame:
    """Earliest reply per campaign and conversation, in update mode. Both inputs are streams."""
    return _reply_candidates(emails, replies).groupBy(ORG, "campaign_id", "conversation").agg(F.min("replied_at").alias("replied_at"))


def funnel_state(events: DataFrame) -> DataFrame:
    """Current status per workspace from the transition stream, in update mode."""
    last = F.max(F.struct("occurred_at", "id", "to_status"))
    return events.groupBy(ORG).agg(last.alias("last")).select(ORG, F.col("last.to_status").alias("status"), F.col("last.occurred_at").alias("since"))


def daily_action_counts(log: DataFrame, lateness: str | None = None) -> DataFrame:
    """Actions and failures per account, type and day, however late they come unless `lateness` is given."""
    return (
        _bounded(log, "created_at", lateness)
        .groupBy(F.window("created_at", "1 day").alias("w"), ORG, "account_id", "action_type")
        .agg(F.count("*").alias("actions"), F.count_if(F.col("success") == F.lit(False)).alias("failures"))
        .withColumn("day", F.to_date("w.start"))
        .drop("w")
    )


class UsageBuckets:
    """The aggregates of `usage_buckets` without a lateness bound and without state of keys.

    Sums add up: a batch leaves the sums of its own rows and looks up no earlier ones, and the batches are summed
    when they are read. A batch that is run again replaces its own sums.
    """

    def __init__(self, spark: SparkSession, store: str, grain: str = "hour"):
        self.spark, self.store, self.grain = spark, store, grain

    def run(self, events: DataFrame) -> None:
        """Process all input there is and stop; run again, it goes on where it stopped."""
        run_to_store(usage.contribution(events), self.store, "append", lambda batch: usage.bucket_sums(batch, self.grain))

    def totals(self) -> DataFrame:
        return usage.sum_deltas(read_store(self.spark, self.store))


class UsageChanges:
    """Exact contributions and projection from a stream of usage changes, without a lateness bound.

    Each batch leaves the contributions it changed, as they were and as they are, in buckets of their ids. The last one
    of a usage row is the newest it has there, so a batch reads the buckets of its own rows. The differences
    go to the stored projection, of which a batch rewrites the partitions it touches. Both take a batch that is
    run again from what was there before it.
    """

    #: a batch that has rows in few buckets reads these only; the number is part of the store
    BUCKETS = 64

    def __init__(self, spark: SparkSession, store: str):
        self.spark, self.checkpoint = spark, os.path.join(store, "_checkpoint")
        self.changes = os.path.join(store, "changes")
        self.table = ProjectionStore(spark, os.path.join(store, "projection"))

    @staticmethod
    def _shape() -> str:
        kinds = {"usage_id": "string", "occurred_at": "timestamp", **dict.fromkeys(usage.DIMENSIONS, "string"), **dict.fromkeys(usage.COUNTERS, "bigint")}
        kinds |= dict.fromkeys(usage.FOUND + usage.COSTS, usage.MONEY)
        return ", ".join(f"{c}: {t}" for c, t in kinds.items())

    def _read(self, path: str) -> DataFrame:
        row = f"struct<{self._shape()}>"
        return self.spark.read.schema(f"key string, old {row}, new {row}, batch bigint, bucket int").option("basePath", self.changes).parquet(path)

    def _newest(self, below: int | None = None) -> DataFrame:
        """key, bucket, held: the last contribution of each usage row, NULL if it is gone."""
        rows = self._read(self.changes).select("key", "bucket", "batch", "new")
        rows = rows if below is None else rows.filter(F.col("batch") < below)
        return rows.groupBy("bucket", "key").agg(F.max_by("new", "batch").alias("held"))

    def versions(self, changes: DataFrame) -> DataFrame:
        """key, bucket, new for usage rows with `op` and `seq`: the last change of each; deleted and undated rows have no contribution."""
        last = first_per_key(changes, ["id"], [F.desc("seq")])
        live = (F.col("op") != "delete") & F.col("created_at").isNotNull()
        there = usage.contribution(last.filter(live)).select(F.col("usage_id").alias("key"), F.struct("*").cast(f"struct<{self._shape()}>").alias("new"))
        gone = last.filter(~live).select(F.col("id").alias("key"), F.lit(None).cast(f"struct<{self._shape()}>").alias("new"))
        return there.unionByName(gone).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(self.BUCKETS)).cast("int"))

    def fold(self, batch: DataFrame, batch_id: int) -> None:
        """Add the differences that a batch makes to the stored projection."""
        path = _batch_path(self.changes, batch_id)
        rows = stored(self.versions(batch), "versions")  # the metadata is read once
        if batch_id:
            asked = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # at most BUCKETS
            held = self._newest(batch_id).filter(F.col("bucket").isin(asked)).withColumnsRenamed({"key": "_key", "bucket": "_bucket"})
            same = (F.col("bucket") == F.col("_bucket")) & F.col("key").eqNullSafe(F.col("_key"))
            rows = rows.join(held, same, "left").select("key", F.col("held").alias("old"), "new", "bucket")
        else:
            rows = rows.select("key", F.lit(None).cast(rows.schema["new"].dataType).alias("old"), "new", "bucket")
        changed = rows.filter(~F.col("old").eqNullSafe(F.col("new")))
        changed.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)  # read twice below, computed once
        rows = self._read(path)
        signed = [usage.signed_rows(spread(rows.filter(F.col(c).isNotNull()).select(f"{c}.*"), "usage_id", "occurred_at"), sign) for c, sign in (("old", -1), ("new", 1))]
        self.table.apply(signed[0].unionByName(signed[1]), batch_id)

    def run(self, changes: DataFrame) -> None:
        """Process all input there is and stop; run again, it goes on where it stopped."""
        stream = changes.writeStream.outputMode("append").option("checkpointLocation", self.checkpoint)
        stream.trigger(availableNow=True).foreachBatch(self.fold).start().awaitTermination()

    def projection(self) -> DataFrame:
        return self.table.read()

    def contributions(self) -> DataFrame:
        return self._newest().filter(F.col("held").isNotNull()).select("held.*")


class ThreadSummary:
    """Per-chat summaries as keyed state; each batch also writes the summaries that it changed."""

    def __init__(self, spark: SparkSession, store: str):
        self.spark, self.store = spark, store

    def run(self, messages: DataFrame) -> None:
        run_to_store(keyed.thread_summary(messages), self.store, "update")

    def changed(self) -> DataFrame:
        return read_store(self.spark, self.store)

    def state(self) -> DataFrame:
        return keyed.thread_summaries(self.spark, os.path.join(self.store, "_checkpoint"))
