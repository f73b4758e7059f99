"""Plan shapes that must hold at scale. The checks made for every query are in test_oracles."""

import pytest

from conftest import SF_DIR
from ledgerlark.operators import usage as U
from ledgerlark.plans import load

REGISTRY = load()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["dashboard_email_performance", "identity_soft_merge", "tasks_cancel_duplicates", "deals_attach_activity", "contacts_export_template", "inbox_unmatched_queue"])
def test_first_row_per_key_is_pruned_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan_of(REGISTRY.QUERIES[name](spark, SF_DIR))


@pytest.fixture(scope="module")
def stored_usage(spark, tables, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("usage") / "usage")
    tables.usage.write.partitionBy("organization_id").parquet(path)
    return spark.read.parquet(path)


def test_filters_and_columns_reach_the_scan(stored_usage):
    plan = U.rollup(stored_usage, "2024-01-05", "2024-01-06", "day", org_id="org_1", campaign_id="camp_1")._jdf.queryExecution().explainString(
        stored_usage.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    scan = plan[plan.index("Scan parquet"):]
    assert "GreaterThanOrEqual(created_at" in scan and "EqualTo(campaign_id,camp_1)" in scan
    assert "PartitionFilters" in scan and "org_1" in scan.split("PartitionFilters")[1].split("\n")[0]
    narrow = plan_of(U.cost(stored_usage, "daily", "campaign"))
    assert "metadata" not in narrow[narrow.index("ReadSchema"):]


def test_projection_reads_the_ledger_once(stored_usage):
    plan = plan_of(U.build_projection(U.contribution(stored_usage)))
    assert plan.count("FileScan parquet") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_paging_is_a_top_k(spark):
    assert "TakeOrderedAndProject" in plan_of(REGISTRY.QUERIES["query_page"](spark, SF_DIR))
