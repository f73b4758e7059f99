"""The stored ledger answers like the ledger, prunes, and replaces whole months only."""

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from ledgerlark.operators import ledger_store
from ledgerlark.operators import usage as U
from ledgerlark.operators.common import tasks_for

START, END = "2024-01-03 05:30:00", "2024-01-25 17:45:30"


@pytest.fixture(scope="module")
def stored(spark, tables, tmp_path_factory):
    folder = tmp_path_factory.mktemp("ledger") / "facts"
    ledger_store.write(tables.usage, str(folder))
    return folder


@pytest.mark.parametrize("bucket", U.BUCKETS)
@pytest.mark.parametrize("filters", [
    {}, {"category": "tokens"}, {"service_name": "chat"}, {"operation": "draft", "org_id": "org_1"}, {"campaign_id": "camp_1", "user_id": ""}, {"campaign_id": "all", "model_name": "exa-search"},
    {"research_run_id": "run_1"}, {"company_id": "none"},
])
def test_rollups_agree(spark, tables, stored, bucket, filters):
    want = U.rollup(tables.usage, START, END, bucket, **filters)
    got = ledger_store.rollup(spark, str(stored), START, END, bucket, **filters)
    assert rows_of(got.select(want.columns)) == rows_of(want)


def test_contributions_agree(spark, tables, stored):
    want = U.contribution(tables.usage)
    got = U.contribution_of(ledger_store.read(spark, str(stored)))
    assert got.schema.simpleString() == want.schema.simpleString() and rows_of(got) == rows_of(want)


def test_nothing_is_parsed_and_filters_reach_the_scan(spark, stored):
    df = ledger_store.rollup(spark, str(stored), START, END, "day", "org_1", service_name="chat", operation="draft", company_id="c1")
    plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "from_json" not in plan and "parse_json" not in plan and "get_json_object" not in plan
    pushed = plan[plan.index("PushedFilters") :].split("\n")[0]
    assert all(f"EqualTo({c}," in pushed for c in ("organization_id", "service_name", "operation_name", "company_id"))
    assert "month" in plan[plan.index("PartitionFilters") : plan.index("PushedFilters")]


def test_a_month_is_replaced_and_others_stay(spark, tables, tmp_path):
    folder = tmp_path / "facts"
    two = tables.usage.filter("created_at IS NULL OR created_at < '2024-01-10'")
    later = two.withColumn("created_at", F.col("created_at") + F.expr("INTERVAL 62 DAYS"))
    ledger_store.write(two.unionByName(later), str(folder))
    files = lambda month: {p.name for p in folder.glob(f"month={month}/*.parquet")}
    january, march = files("2024-01"), files("2024-03")
    assert january and march and len(list(folder.glob("month=*"))) == 2
    for _ in range(2):  # the second run is the retry
        ledger_store.write(later.withColumn("api_calls", F.lit(7)), str(folder))
        assert files("2024-01") == january and not files("2024-03") & march
        got = ledger_store.read(spark, str(folder), "2024-03-01", "2024-03-31")
        assert got.count() == later.filter("created_at IS NOT NULL").count() and {r[0] for r in got.select("api_calls").distinct().collect()} == {7}
    assert ledger_store.read(spark, str(folder)).count() == 2 * got.count()
    assert ledger_store.rollup(spark, str(folder), "2025-01-01", "2025-02-01").collect() == []


def test_files_are_sorted_for_skipping(stored):
    import pyarrow.parquet as pq

    for file in stored.rglob("*.parquet"):
        rows = pq.read_table(file, columns=["organization_id", "service_name"]).to_pylist()
        keys = [(r["organization_id"] is not None, r["organization_id"] or "", r["service_name"] or "") for r in rows]
        assert keys == sorted(keys)


def test_ranges_go_by_rows(spark, tables, tmp_path, monkeypatch):
    ledger_store.write(tables.usage, str(tmp_path / "few"))
    assert len(list((tmp_path / "few").rglob("*.parquet"))) >= spark.sparkContext.defaultParallelism // 2  # however few bytes
    monkeypatch.setattr(ledger_store, "tasks_for", lambda df: tasks_for(df, rows=50))
    ledger_store.write(tables.usage, str(tmp_path / "many"))
    sizes = [spark.read.parquet(str(p)).count() for p in (tmp_path / "many").rglob("*.parquet")]
    assert sum(sizes) == tables.usage.filter("created_at IS NOT NULL").count() and max(sizes) < 150


def test_a_rollup_of_one_workspace_stores_its_rows_only(spark, monkeypatch):
    import conftest
    from ledgerlark.plans import load, registry

    seen, write = [], ledger_store.write
    monkeypatch.setattr(registry, "_WRITTEN", {})
    monkeypatch.setattr(ledger_store, "write", lambda rows, folder: (seen.append({r[0] for r in rows.select("organization_id").distinct().collect()}), write(rows, folder)))
    run = lambda name: rows_of(load().QUERIES[name](spark, conftest.SF_DIR))
    first = run("usage_rollup_filtered")
    assert first and seen == [{"org_1"}]
    run("usage_rollup_day")
    assert run("usage_rollup_filtered") == first and len(seen) == 2 and len(seen[1]) > 1  # all are stored by now
