"""The usage ledger stored with its metadata read: typed columns instead of JSON text.

Rows lie by month. Within a month files are ranges of workspaces, sorted by workspace, service, operation
and company, so the least and greatest values that Parquet keeps for each row group let a scan skip what a
query does not ask for. Months are replaced whole: `write` takes all rows of the months it is given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.functions.dates import moment
from ledgerlark.operators import usage as U
from ledgerlark.operators.common import tasks_for

SORTED_BY = ("organization_id", "service_name", "operation_name", "company_id", "created_at")
_KINDS = {"id": "string", "created_at": "timestamp", **dict.fromkeys(U.COUNTERS, "bigint"), "grounding_queries": U.MONEY, **dict.fromkeys(U.FOUND + U.COSTS, U.MONEY)}
SCHEMA = ", ".join(f"{c} {_KINDS.get(c, 'string')}" for c in ("id", "created_at", *U.FACT_DIMENSIONS, *U.MEASURES)) + ", month string"


def write(usage: DataFrame, folder: str) -> None:
    """Store the facts of usage rows. The months that the rows belong to are replaced, others stay as they are.

    Undated rows have no facts. The ranges are found on the ledger's own columns, before the metadata is read. Their
    number goes by rows, not bytes: reading the metadata takes far longer than moving it, so a range by size is a long task.
    """
    dated = usage.filter(F.col("created_at").isNotNull())
    # a workspace of any size is spread over as many ranges as it fills
    ranged = dated.withColumn("month", F.date_format("created_at", "yyyy-MM")).repartitionByRange(tasks_for(dated), "month", "organization_id", "created_at").drop("month")
    rows = U.facts(ranged).withColumn("month", F.date_format("created_at", "yyyy-MM")).sortWithinPartitions("month", *SORTED_BY)
    rows.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("month").parquet(folder)


def read(spark: SparkSession, folder: str, start=None, end=None) -> DataFrame:
    """The stored facts, of the months from `start` to `end` if these are given."""
    rows = spark.read.schema(SCHEMA).parquet(folder)
    for bound, test in ((start, lambda m, b: m >= b), (end, lambda m, b: m <= b)):
        if bound is not None:
            rows = rows.filter(test(F.col("month"), F.date_format(moment(bound), "yyyy-MM")))
    return rows.drop("month")


def rollup(spark: SparkSession, folder: str, start, end, bucket: str = "day", org_id: str | None = None, **filters) -> DataFrame:
    """`usage.rollup` from the stored facts."""
    return U.rollup_facts(read(spark, folder, start, end), start, end, bucket, org_id, **filters)
