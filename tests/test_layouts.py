"""Declared layouts: the derived tables keep to them, and a read table is checked against its own."""

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from ledgerlark.sources.adapters import ADAPTERS
from ledgerlark.sources.layouts import SCHEMAS
from ledgerlark.sources.tables import conform, layout_faults, read_table


def test_core_tables_are_declared():
    core = """usage token_usage contacts companies company_contacts campaigns campaign_companies campaign_contacts campaign_emails tasks email_reply_events provider_event_log
        linkedin_action_log sequence_actions deals deal_activities onboarding_events reengagement_sends chunks crm_raw_records crm_list_members document_access_events short_urls
        billing_invoices billing_customers linkedin_threads linkedin_messages""".split()
    assert not [n for n in core if n not in SCHEMAS] and len(SCHEMAS) > 40


@pytest.mark.parametrize("name", sorted(SCHEMAS))
def test_derived_tables_keep_to_their_layout(tables, name):
    assert name in ADAPTERS and layout_faults(getattr(tables, name).schema, name) == []


def test_reading_checks_the_layout(spark, tables, tmp_path):
    rows = tables.deals.limit(20)
    rows.withColumn("more", F.lit(1)).select(*reversed([*rows.columns, "more"])).write.parquet(str(tmp_path / "deals.parquet"))
    got = read_table(spark, str(tmp_path), "deals")
    assert got.columns == rows.columns and rows_of(got) == rows_of(rows)
    plan = spark._jvm.PythonSQLUtils.explainString(got.select("id")._jdf.queryExecution(), "formatted")
    assert "ReadSchema: struct<id:string>" in plan  # the check costs no column
    with pytest.raises(ValueError, match="table deals: stage is missing; amount is double, not decimal"):
        conform(rows.drop("stage").withColumn("amount", F.col("amount").cast("double")), "deals")
    narrow = conform(rows.withColumn("amount", F.col("amount").cast("decimal(9,1)")), "deals")
    assert narrow.schema["amount"].dataType.simpleString() == "decimal(14,2)"
    with pytest.raises(ValueError, match="amount"):
        conform(rows.withColumn("amount", F.col("amount").cast("decimal(20,2)")), "deals")
