"""Registered billing queries and their oracles."""

from pyspark.sql import functions as F

from ledgerlark.operators import billing as B
from ledgerlark.plans.registry import query

_BY_SERVICE = """SELECT organization_id, CAST(created_at AS DATE) AS usage_date, TRY_CAST(metadata AS JSON) ->> '$.service' AS service, user_id,
  CAST(sum(coalesce(total_tokens, 0)) AS BIGINT) AS total_tokens, CAST(sum(coalesce(billed_cost, 0)) AS DECIMAL(38,6)) AS total_billed_cost, count(*) AS total_records
FROM usage WHERE created_at IS NOT NULL {extra} GROUP BY 1, 2, 3, 4"""


@query("billing_daily_by_service_user", _BY_SERVICE.format(extra=""))
def _by_service(t):
    return B.daily_by_service_user(t.usage)


@query("billing_uninvoiced_by_service_user", _BY_SERVICE.format(extra="AND invoice_id IS NULL"))
def _uninvoiced(t):
    return B.uninvoiced_by_service_user(t.usage)


@query(
    "billing_workspace_rollup",
    """WITH facts AS (
      SELECT organization_id, 'usage' AS kind, list_cost AS a, billed_cost AS b, total_tokens AS tokens, api_calls AS calls, user_id AS who, invoice_id AS state, created_at AS tm FROM usage
        WHERE created_at BETWEEN TIMESTAMP '1997-01-01 00:00:00' AND TIMESTAMP '2024-01-19 23:59:59.999999'
      UNION ALL SELECT organization_id, 'invoice', total, NULL, NULL, NULL, NULL, status, coalesce(created_at, period_end, period_start) FROM billing_invoices
        WHERE period_end BETWEEN TIMESTAMP '1997-01-01 00:00:00' AND TIMESTAMP '2024-01-19 23:59:59.999999'
      UNION ALL SELECT organization_id, 'customer', NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM billing_customers
      UNION ALL SELECT id, 'workspace', NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM organization WHERE NOT coalesce(deleted, FALSE)),
    folded AS (
      SELECT organization_id, coalesce(sum(a) FILTER (WHERE kind = 'usage'), 0) AS listed, coalesce(sum(b), 0) AS billed, coalesce(sum(tokens), 0) AS tokens, coalesce(sum(calls), 0) AS calls, count(*) FILTER (WHERE kind = 'usage') AS uses,
        count(DISTINCT who) AS people, coalesce(sum(b) FILTER (WHERE kind = 'usage' AND state IS NULL), 0) AS unbilled, coalesce(sum(a) FILTER (WHERE kind = 'invoice'), 0) AS invoiced, count(*) FILTER (WHERE kind = 'invoice') AS invoices,
        count(*) FILTER (WHERE kind = 'invoice' AND state = 'paid') AS paid, count(*) FILTER (WHERE kind = 'invoice' AND list_contains(['open', 'sent', 'draft'], state)) AS opened, count(*) FILTER (WHERE kind = 'invoice' AND state = 'failed') AS failed, max(tm) FILTER (WHERE kind = 'usage') AS used_last, max(tm) FILTER (WHERE kind = 'invoice') AS invoiced_last
      FROM facts WHERE organization_id IS NOT NULL GROUP BY organization_id)
    SELECT x.organization_id, coalesce(o.name, '') AS org_name, CAST(listed AS DECIMAL(38,6)) AS total_list_cost, CAST(billed AS DECIMAL(38,6)) AS total_billed_cost, CAST(tokens AS BIGINT) AS total_tokens,
      CAST(calls AS BIGINT) AS api_calls, uses AS usage_rows, people AS user_count, CAST(unbilled AS DECIMAL(38,6)) AS uninvoiced_billed_cost, CAST(invoiced AS DECIMAL(38,2)) AS invoice_total, invoices AS invoice_count,
      paid AS paid_invoice_count, opened AS open_invoice_count, failed AS failed_invoice_count, used_last AS last_usage_at, invoiced_last AS last_invoice_at, c.status AS billing_status, auto_charge_enabled, billing_email,
      card_brand, card_last4, monthly_spend_limit, work_access_mode, work_access_reason, work_access_until, dispatch_suspended IS TRUE AS dispatch_suspended
    FROM folded x LEFT JOIN organization o ON o.id = x.organization_id LEFT JOIN billing_customers c USING (organization_id)""",
)
def _workspace(t):
    return B.workspace_rollup(t.organization, t.billing_customers, t.usage, t.billing_invoices, "1997-01-01", "2024-01-20")


@query(
    "billing_week_snapshot",
    """WITH lines AS (SELECT organization_id, CAST(date_trunc('week', created_at) AS DATE) AS week_start, provider, coalesce(model_name, '') AS model_name,
        CAST(sum(coalesce(api_calls, 0)) AS BIGINT) AS api_calls, CAST(sum(coalesce(billed_cost, 0)) AS DECIMAL(38,6)) AS billed_cost FROM usage WHERE created_at IS NOT NULL GROUP BY 1, 2, 3, 4)
    SELECT organization_id, week_start, CAST(week_start + INTERVAL 7 DAY AS DATE) AS week_end, sum(billed_cost)::DECIMAL(38,6) AS total_billed_cost,
      '[' || string_agg('{"provider":"' || provider || '","model_name":"' || model_name || '","api_calls":' || api_calls || ',"billed_cost":"' || billed_cost || '"}', ',' ORDER BY provider, model_name) || ']' AS line_items
    FROM lines GROUP BY 1, 2""",
)
def _week(t):
    return B.week_snapshot(t.usage)


@query(
    "billing_invoice_lines",
    """WITH scope AS (SELECT organization_id, provider, coalesce(model_name, '') AS model_name, user_id, api_calls, billed_cost FROM usage
        WHERE created_at >= TIMESTAMP '2024-01-08 00:00:00' AND created_at < TIMESTAMP '2024-01-15 00:00:00'),
    per_user AS (SELECT organization_id, provider, model_name, user_id, CAST(sum(coalesce(api_calls, 0)) AS BIGINT) AS user_api_calls, CAST(sum(coalesce(billed_cost, 0)) AS DECIMAL(38,6)) AS user_cost FROM scope GROUP BY 1, 2, 3, 4)
    SELECT *, CAST(sum(user_api_calls) OVER line AS BIGINT) AS api_calls, CAST(sum(user_cost) OVER line AS DECIMAL(38,6)) AS billed_cost
    FROM per_user WINDOW line AS (PARTITION BY organization_id, provider, model_name)""",
)
def _invoice_lines(t):
    return B.invoice_lines(t.usage, "2024-01-08", "2024-01-15")


@query(
    "billing_invoice_numbers",
    """WITH dated AS (SELECT *, coalesce(created_at, period_end) + INTERVAL 20 YEAR AS tm FROM billing_invoices)
    SELECT id, CAST(year(tm) AS INT) AS invoice_year, 'INV-' || year(tm) || '/' || lpad(CAST(100000 + row_number() OVER (PARTITION BY year(tm) ORDER BY tm, id) AS VARCHAR), 6, '0') AS invoice_number FROM dated""",
)
def _numbers(t):
    """All invoices, dated twenty years later, as numbers begin with the year 2000."""
    later = {c: F.col(c) + F.expr("INTERVAL 20 YEARS") for c in ("created_at", "period_end")}
    return B.assign_invoice_numbers(t.billing_invoices.withColumns(later)).select("id", "invoice_year", "invoice_number")


@query(
    "billing_billable_seats",
    """SELECT organization_id, count(DISTINCT user_id) AS billable_seats FROM members WHERE status = 'active' AND billable IS TRUE AND member_type = 'customer'
      AND (ends_at IS NULL OR ends_at > TIMESTAMP '2024-01-15 00:00:00') GROUP BY 1""",
)
def _seats(t):
    return B.billable_seats(t.members, "2024-01-15")


@query(
    "billing_discount_redemptions",
    """WITH r AS (SELECT code, count(*) AS uses, count(DISTINCT organization_id) AS workspaces, sum(amount_discounted) AS amount, max(redeemed_at) AS last_redeemed_at FROM discount_redemptions GROUP BY 1)
    SELECT c.code, discount_type, max_uses, expires_at, coalesce(uses, 0) AS uses, coalesce(workspaces, 0) AS workspaces, CAST(coalesce(amount, 0) AS DECIMAL(38,2)) AS amount_discounted, last_redeemed_at,
      CASE WHEN expires_at <= TIMESTAMP '1999-01-01 00:00:00' THEN 'expired' WHEN coalesce(uses, 0) >= max_uses THEN 'used_up' ELSE 'usable' END AS state
    FROM discount_codes c LEFT JOIN r USING (code)""",
)
def _discounts(t):
    return B.discount_redemptions(t.discount_codes, t.discount_redemptions, "1999-01-01")
