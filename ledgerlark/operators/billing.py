"""Billing summaries, invoice lines and seat counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.dates import in_range, moment
from ledgerlark.operators.common import MONEY, for_org, money, number_rows, total

INVOICE_NUMBER_START = 100001
INVOICE_NUMBER_MAX_LENGTH = 26
OPEN_INVOICES = ("open", "sent", "draft")


def daily_by_service_user(usage: DataFrame, org_id: str | None = None) -> DataFrame:
    """Workspace x UTC date x service x user."""
    rows = for_org(usage, org_id).filter(F.col("created_at").isNotNull())
    return rows.groupBy(
        "organization_id", F.to_date("created_at").alias("usage_date"), F.get_json_object("metadata", "$.service").alias("service"), "user_id"
    ).agg(total("total_tokens").alias("total_tokens"), money("billed_cost").alias("total_billed_cost"), F.count("*").alias("total_records"))


def uninvoiced_by_service_user(usage: DataFrame, org_id: str | None = None) -> DataFrame:
    return daily_by_service_user(usage.filter(F.col("invoice_id").isNull()), org_id)


def workspace_rollup(
    organizations: DataFrame, customers: DataFrame, usage: DataFrame, invoices: DataFrame, start, end
) -> DataFrame:
    """One row per workspace that is live, a customer, or has usage or invoices in [start, end)."""
    open_bill = F.col("invoice_id").isNull()
    used = (
        usage.filter(in_range(F.col("created_at"), start, end))
        .groupBy("organization_id")
        .agg(
            money("list_cost").alias("total_list_cost"),
            money("billed_cost").alias("total_billed_cost"),
            total("total_tokens").alias("total_tokens"),
            total("api_calls").alias("api_calls"),
            F.count("*").alias("usage_rows"),
            F.countDistinct("user_id").alias("user_count"),
            F.sum(F.when(open_bill, F.coalesce("billed_cost", F.lit(0)))).cast(MONEY).alias("uninvoiced_billed_cost"),
            F.max("created_at").alias("last_usage_at"),
        )
    )
    status = F.col("status")
    billed = (
        invoices.filter(in_range(F.col("period_end"), start, end))
        .groupBy("organization_id")
        .agg(
            F.sum(F.coalesce("total", F.lit(0))).cast("decimal(38,2)").alias("invoice_total"),
            F.count("*").alias("invoice_count"),
            F.count_if(status == "paid").alias("paid_invoice_count"),
            F.count_if(status.isin(*OPEN_INVOICES)).alias("open_invoice_count"),
            F.count_if(status == "failed").alias("failed_invoice_count"),
            F.max(F.coalesce("created_at", "period_end", "period_start")).alias("last_invoice_at"),
        )
    )
    orgs = organizations.select(
        F.col("id").alias("organization_id"), F.col("name").alias("org_name"), "work_access_mode", "work_access_reason", "work_access_until", "dispatch_suspended",
        (~F.col("deleted").eqNullSafe(True)).alias("_live"),
    )
    access = customers.filter(F.col("organization_id").isNotNull()).select(
        "organization_id", F.col("status").alias("billing_status"), "auto_charge_enabled", "billing_email", "card_brand", "card_last4", "monthly_spend_limit", F.lit(True).alias("_customer")
    )
    counters = ["total_tokens", "api_calls", "usage_rows", "user_count", "invoice_count", "paid_invoice_count", "open_invoice_count", "failed_invoice_count"]
    amounts = ["total_list_cost", "total_billed_cost", "uninvoiced_billed_cost", "invoice_total"]
    out = orgs
    for side in (access, used, billed):
        out = out.join(side, "organization_id", "full_outer")
    # a deleted workspace shows only with a customer, usage or invoices
    shown = F.col("_live") | F.col("_customer") | F.col("usage_rows").isNotNull() | F.col("invoice_count").isNotNull()
    out = out.filter(F.col("organization_id").isNotNull() & F.coalesce(shown, F.lit(False))).drop("_live", "_customer")
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast(MONEY if c != "invoice_total" else "decimal(38,2)") for c in amounts})
    name = F.col("org_name")
    return (
        out.fillna(0, counters)
        .fillna(False, ["dispatch_suspended"])
        .withColumn("_sort_name", F.coalesce(name, "organization_id"))
        .withColumn("org_name", F.coalesce(name, F.lit("")))
        .orderBy(F.desc("total_billed_cost"), F.desc("invoice_total"), "_sort_name")
        .drop("_sort_name")
    )


def _lines(usage: DataFrame, *keys) -> DataFrame:
    return usage.groupBy("organization_id", *keys, "provider", "model_name").agg(
        total("api_calls").alias("api_calls"), money("billed_cost").alias("billed_cost")
    )


def week_snapshot(usage: DataFrame, org_id: str | None = None) -> DataFrame:
    """Line items as JSON and the total per workspace and ISO week.

    Rows are first summed per provider and model, so a group holds one entry per model, not per usage row.
    """
    rows = for_org(usage, org_id).filter(F.col("created_at").isNotNull())
    week = F.to_date(F.date_trunc("week", "created_at"))
    item = F.struct("provider", F.coalesce("model_name", F.lit("")).alias("model_name"), "api_calls", F.col("billed_cost").cast("string").alias("billed_cost"))
    return (
        _lines(rows.withColumn("week_start", week), "week_start")
        .groupBy("organization_id", "week_start")
        .agg(F.to_json(F.array_sort(F.collect_list(item))).alias("line_items"), F.sum("billed_cost").cast(MONEY).alias("total_billed_cost"))
        .withColumn("week_end", F.date_add("week_start", 7))
    )


def invoice_lines(usage: DataFrame, start, end, org_id: str | None = None) -> DataFrame:
    """Invoice lines of [start, end): one row per workspace, provider, model and user with the line's sums.

    The per-user breakdown stays in rows, so a line with very many users is never one value.
    """
    rows = for_org(usage, org_id).filter(in_range(F.col("created_at"), start, end))
    per_user = rows.groupBy("organization_id", "provider", "model_name", "user_id").agg(
        total("api_calls").alias("user_api_calls"), money("billed_cost").alias("user_cost")
    )
    key = ["organization_id", "provider", "line_model"]
    per_user = per_user.withColumn("line_model", F.coalesce("model_name", F.lit(""))).drop("model_name")
    lines = per_user.groupBy(*key).agg(F.sum("user_api_calls").alias("api_calls"), F.sum("user_cost").cast(MONEY).alias("billed_cost"))
    return per_user.join(lines, key).withColumnRenamed("line_model", "model_name")


def assign_invoice_numbers(
    invoices: DataFrame, prefix: str = "INV", separator: str = "/", start: int = INVOICE_NUMBER_START, reserved: DataFrame | None = None
) -> DataFrame:
    """`PREFIX-YEAR/NNNNNN` in (created_at, id) order per year.

    `reserved` (invoice_year, next_number) continues earlier numbering. Numbers come from a
    range sort over all tasks, not from a one-task window per year.
    """
    dated = invoices.withColumn("invoice_year", F.year(F.coalesce("created_at", "period_end")))
    dated = dated.withColumn("_order_at", F.coalesce("created_at", "period_end"))
    bad_year = F.raise_error(F.lit("invoice year must be >= 2000")).cast("int")
    dated = dated.withColumn("invoice_year", F.when(F.col("invoice_year") >= 2000, F.col("invoice_year")).otherwise(bad_year))
    numbered = number_rows(dated, "invoice_year", ["_order_at", "id"], "_n").drop("_order_at")
    if reserved is not None:
        numbered = numbered.join(reserved.select("invoice_year", "next_number"), "invoice_year", "left")
    else:
        numbered = numbered.withColumn("next_number", F.lit(None).cast("bigint"))
    number = F.coalesce("next_number", F.lit(start)) + F.col("_n") - 1
    digits = F.when(number < 1_000_000, F.lpad(number.cast("string"), 6, "0")).otherwise(number.cast("string"))
    text = F.concat(F.lit(prefix.strip() or "INV"), F.lit("-"), F.col("invoice_year").cast("string"), F.lit(separator), digits)
    too_long = F.raise_error(F.concat(F.lit("invoice number too long: "), text)).cast("string")
    return numbered.withColumn("invoice_number", F.when(F.length(text) <= INVOICE_NUMBER_MAX_LENGTH, text).otherwise(too_long)).drop("_n", "next_number")


def billable_seats(members: DataFrame, as_of, org_id: str | None = None) -> DataFrame:
    """Seats that are active at `as_of`, billable and of a customer."""
    ended: Column = F.col("ends_at").isNotNull() & (F.col("ends_at") <= moment(as_of))
    return (
        for_org(members, org_id)
        .filter((F.col("status") == "active") & ~ended & F.col("billable").eqNullSafe(True) & (F.col("member_type") == "customer"))
        .groupBy("organization_id")
        .agg(F.countDistinct("user_id").alias("billable_seats"))
    )


def discount_redemptions(codes: DataFrame, redemptions: DataFrame, as_of) -> DataFrame:
    """Uses and discounted amount per code, against its use limit and expiry."""
    used = redemptions.groupBy("code").agg(
        F.count("*").alias("uses"), F.countDistinct("organization_id").alias("workspaces"),
        F.sum("amount_discounted").cast("decimal(38,2)").alias("amount_discounted"), F.max("redeemed_at").alias("last_redeemed_at"),
    )
    expired = F.coalesce(F.col("expires_at") <= moment(as_of), F.lit(False))
    full = F.coalesce(F.col("uses") >= F.col("max_uses"), F.lit(False))
    return (
        codes.join(used, "code", "left")
        .fillna(0, ["uses", "workspaces"])
        .withColumn("amount_discounted", F.coalesce("amount_discounted", F.lit(0)).cast("decimal(38,2)"))
        .withColumn("state", F.when(expired, "expired").when(full, "used_up").otherwise("usable"))
    )
