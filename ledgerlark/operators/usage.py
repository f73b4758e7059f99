"""Usage ledger analytics: contributions, rollups, the incremental projection, cost views."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta, timezone
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.dates import moment
from ledgerlark.functions.json import bool_of, count_of, json_fields, number_of, plain_json
from ledgerlark.functions.text import non_empty, provider_label
from ledgerlark.operators.common import MONEY, first_per_key, for_org, money, total, wanted

# ---- fixed values -------------------------------------------------------------------------

TOKEN_PROVIDERS = ("openai", "anthropic", "deepseek", "togetherai", "perplexity", "gemini", "mistral", "xai", "grok")

# metadata entries that report a result count, in order of preference
EMAIL_KEYS = (
    "found_emails", "emails_found", "email_matches", "returned_email_matches", "returned_emails",
    "emails_returned", "emails", "email_found", "found_email", "email",
)
PEOPLE_KEYS = (
    "profiles_returned", "people_found", "people_returned", "returned_people", "returned_profiles",
    "profile_count", "profiles_found", "results_found",
)
COMPANY_KEYS = (
    "companies_found", "companies_returned", "returned_companies", "company_count",
    "company_profiles_returned", "similar_companies",
)
GENERIC_KEYS = ("results", "items", "data")
PHONE_KEYS = (
    "phones_found", "phone_found", "phone_number", "phone_numbers", "phone", "phones", "mobile_phone", "mobile",
)

RESEARCH = "Company research · "

# ---- shapes -------------------------------------------------------------------------------

DIMENSIONS = (
    "organization_id", "category", "campaign_id", "user_id", "task_label", "model_label", "raw_model_name",
    "service_name", "operation_name", "company_id", "run_id", "metadata_research_run_id",
)
COUNTERS = ("api_calls", "input_tokens", "output_tokens", "total_tokens", "grounding_queries")
FOUND = ("units", "emails_found", "people_found", "companies_found", "phones_found")
COSTS = ("list_cost", "billed_cost")
MEASURES = COUNTERS + FOUND + COSTS
PROJECTION_KEY = ("organization_id", "bucket_granularity", "bucket_start") + DIMENSIONS[1:]
ROLLUP_KEY = ("organization_id", "bucket_start", "category", "campaign_id", "user_id", "task_label", "model_label")
BUCKETS = ("hour", "day", "total")


def _model_like(*patterns: str) -> Column:
    model = F.coalesce(F.col("model_name"), F.lit(""))
    out = F.lit(False)
    for p in patterns:
        out = out | model.like(p)
    return out


def _research_label() -> Column:
    """Task label of company-research usage; the first rule that applies wins."""
    effective, named, flow = F.col("effective_provider"), F.col("provider_name"), F.col("research_flow")
    both = effective == "both"
    label = (
        F.when(both & (named == "gemini"), "Gemini Summarizer")
        .when(both & (named != ""), provider_label(named))
        .when(both, "Multi-provider")
        .when((effective == "gemini_ultra_lean") | (flow == "ultra_lean"), "Gemini Ultra Lean")
        .when(effective.isin("grok", "xai") | (flow == "advanced_research"), "Advanced Research")
        .when((effective == "gemini_pro") | (flow == "gemini_pro"), "Gemini Pro Legacy")
        .when(((effective == "gemini") | (named == "gemini")) & (flow == "compact"), "Gemini Compact")
        .when(effective != "", provider_label(effective))
        .when(named != "", provider_label(named))
        .otherwise("Unknown")
    )
    return F.concat(F.lit(RESEARCH), label)


def _task_label() -> Column:
    provider, action = F.col("provider"), F.col("action_key")
    ark, b2b = provider == "ai_ark", provider == "b2b_enrichment"
    return (
        F.when(F.col("service_name") == "company_research", _research_label())
        .when((provider == "gemini") & (F.col("grounding") > 0), "Web search (grounding)")
        .when(F.col("category") == "phones", "Phone discovery")
        .when(provider.isin("hunter", "icypeas", "apollo"), "Email finder")
        .when(provider == "exa", "Web research")
        .when(ark & ((action == "similar_companies") | _model_like("%similar_companies%")), "Company search")
        .when(ark & ((action == "person_profile") | _model_like("%person_profile%")), "Contact enrichment")
        .when(ark, "People search")
        .when(b2b & _model_like("b2b-email_verifier%"), "Email verifier")
        .when(b2b & _model_like("b2b-email_finder%"), "Email finder")
        .when(b2b & _model_like("b2b-people_search%"), "People search")
        .when(b2b & _model_like("b2b-similar_companies%", "b2b-company_profile%"), "Company search")
        .when(b2b, "Contact enrichment")
        .otherwise("LLM generation")
    )


def _category(token_providers: Sequence[str], action: Column) -> Column:
    phone = (F.col("provider") == "airscale") & ((action == "phone_finder") | _model_like("airscale-phone%"))
    return F.when(phone, "phones").when(F.col("provider").isin(*token_providers), "tokens").otherwise("b2b_data")


META_TEXTS = (
    "action", "provider_name", "effective_provider", "provider", "research_flow", "service", "operation", "company_id",
    "research_run_id", "grounding_queries", "billable_units", "success",
)
META_VALUES = tuple(dict.fromkeys(EMAIL_KEYS + PEOPLE_KEYS + COMPANY_KEYS + GENERIC_KEYS + PHONE_KEYS))


def _classified(usage: DataFrame) -> DataFrame:
    """Parse the metadata once and derive category, labels and the raw result counts."""
    meta = lambda key: F.col(f"meta.{key}")
    text = lambda key: F.coalesce(meta(key), F.lit(""))
    zero = F.lit(0).cast(MONEY)
    # entries are examined only in the rows whose category uses the count
    count = lambda category, keys: F.when(F.col("category") == category, count_of("plain", "meta", keys)).otherwise(zero)
    tokens_in, tokens_out = (F.coalesce(F.col(c), F.lit(0)) for c in ("input_tokens", "output_tokens"))
    parsed = (
        usage.filter(F.col("created_at").isNotNull())
        .withColumn("plain", plain_json(F.col("metadata")))
        .withColumn("meta", json_fields(F.col("plain"), META_TEXTS + META_VALUES))
        .withColumns(
            {
                "action_key": F.lower(F.trim(text("action"))),
                "raw_action": text("action"),
                "provider_name": F.coalesce(non_empty(meta("provider_name")), "provider", F.lit("")),
                "effective_provider": F.coalesce(
                    *(non_empty(meta(k)) for k in ("effective_provider", "provider", "provider_name")), "provider", F.lit("")
                ),
                "research_flow": text("research_flow"),
                "service_name": text("service"),
                "operation_name": text("operation"),
                "company_id": text("company_id"),
                "metadata_research_run_id": text("research_run_id"),
                "grounding": number_of(meta("grounding_queries")),
                "billable": number_of(meta("billable_units")),
                "success": bool_of(meta("success")),
                "all_tokens": F.when(
                    F.coalesce(F.col("total_tokens"), F.lit(0)) > 0, F.col("total_tokens")
                ).otherwise(tokens_in + tokens_out),
            }
        )
        .drop("metadata", "total_tokens")
        .withColumnRenamed("all_tokens", "total_tokens")
    )
    labelled = parsed.withColumn("category", _category(TOKEN_PROVIDERS, F.col("raw_action")))
    return labelled.withColumns(
        {
            "emails_raw": count("b2b_data", EMAIL_KEYS),
            "people_raw": count("b2b_data", PEOPLE_KEYS),
            "companies_raw": count("b2b_data", COMPANY_KEYS),
            "generic_raw": count("b2b_data", GENERIC_KEYS),
            "phones_raw": count("phones", PHONE_KEYS),
            "task_label": _task_label(),
            "model_label": F.when(F.col("category") == "tokens", F.col("model_name")),
        }
    ).drop("meta", "plain")


def _measured(classified: DataFrame) -> DataFrame:
    """Turn the raw counts into the final measures of each category."""
    provider, action = F.coalesce(F.col("provider"), F.lit("")), F.col("action_key")
    zero = F.lit(0).cast(MONEY)
    finder = (action == "email_finder") | _model_like("%email_finder%")
    resolved = classified.withColumns(
        {
            "people_search": (action == "people_search") | _model_like("%people_search%") | ((provider == "ai_ark") & (action == "")),
            "company_search": action.isin("similar_companies", "company_search", "company_profile")
            | _model_like("%similar_companies%", "%company_profile%"),
            "email_provider": provider.isin("hunter", "icypeas")
            | (provider.isin("apollo", "airscale") & finder)
            | ((provider == "b2b_enrichment") & _model_like("b2b-email_finder%")),
            "b2b": F.col("category") == "b2b_data",
        }
    ).withColumns(
        {
            "emails": F.when(F.col("emails_raw") > 0, F.col("emails_raw"))
            .when((F.col("billable") > 0) & F.col("email_provider"), F.col("billable"))
            .otherwise(zero),
            "people": F.when(F.col("people_raw") > 0, F.col("people_raw"))
            .when(F.col("people_search"), F.col("generic_raw"))
            .otherwise(zero),
            "companies": F.when(F.col("companies_raw") > 0, F.col("companies_raw"))
            .when(F.col("company_search"), F.col("generic_raw"))
            .otherwise(zero),
        }
    )
    # nothing counted: the billable units stand in for the searched kind
    empty = F.col("b2b") & (F.col("emails") + F.col("people") + F.col("companies") == 0)
    units_in = empty & (F.col("billable") > 0)
    profile = empty & (provider == "b2b_enrichment") & _model_like("b2b-company_profile%")
    found = resolved.withColumns(
        {
            "phones_found": F.when(
                F.col("category") == "phones",
                F.when(F.col("phones_raw") != 0, F.col("phones_raw")).when(F.col("success"), F.lit(1)).otherwise(zero),
            ).otherwise(zero),
            "emails_found": F.when(F.col("b2b"), F.col("emails")).otherwise(zero),
            "people_found": F.when(F.col("b2b") & (F.col("people") > 0) & ~F.col("company_search"), F.col("people"))
            .when(units_in & F.col("people_search"), F.col("billable"))
            .otherwise(zero),
            "companies_found": F.when(F.col("b2b") & (F.col("companies") > 0), F.col("companies"))
            .when(units_in & F.col("company_search"), F.col("billable"))
            .when(profile, F.when(F.col("billable") != 0, F.col("billable")).otherwise(F.lit(1)))
            .otherwise(zero),
        }
    )
    counters = {c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in COUNTERS[:4]}
    return found.withColumns(
        {
            **counters,
            "grounding_queries": F.col("grounding"),
            "units": F.when(F.col("category") == "phones", F.col("phones_found"))
            .when(F.col("b2b"), F.col("emails_found") + F.col("people_found") + F.col("companies_found"))
            .otherwise(zero),
            **{c: F.coalesce(F.col(c), F.lit(0)).cast(MONEY) for c in COSTS},
        }
    )


def _whole(col: Column) -> Column:
    """Numeric to bigint rounds half away from zero."""
    return F.round(col).cast("bigint")


#: columns of `facts`: the ledger's own values, NULL where they are missing, and what its metadata tells
FACT_DIMENSIONS = (
    "organization_id", "category", "campaign_id", "user_id", "task_label", "model_label", "model_name",
    "service_name", "operation_name", "company_id", "run_id", "metadata_research_run_id",
)


def facts(usage: DataFrame) -> DataFrame:
    """The dated usage rows with their metadata read once into typed columns: `id`, `created_at`, dimensions and measures. No shuffle."""
    return _measured(_classified(usage)).select("id", "created_at", *FACT_DIMENSIONS, *MEASURES)


def contribution_of(facts: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Contributions (see `contribution`) of facts; nothing is parsed."""
    names = dict(zip(FACT_DIMENSIONS, DIMENSIONS, strict=True))
    whole = ("organization_id", "category", "task_label")
    dims = [(F.col(c) if c in whole else F.coalesce(F.col(c), F.lit(""))).alias(n) for c, n in names.items()]
    return facts.select(
        F.col("id").alias("usage_id"), F.col("created_at").alias("occurred_at"), *dims, *COUNTERS[:4],
        _whole(F.col("grounding_queries")).alias("grounding_queries"), *(F.col(m).cast(MONEY).alias(m) for m in FOUND + COSTS), *carry,
    )


def contribution(usage: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """One normalised row per dated usage row: 12 dimensions (NULL -> '') and 12 measures, and the columns in carry. No shuffle."""
    return contribution_of(_measured(_classified(usage)), carry)


def _bucket(col: Column, bucket: str, start) -> Column:
    if bucket == "total":
        return F.date_trunc("day", moment(start))
    return F.date_trunc(bucket, col)


def _check_bucket(bucket: str) -> None:
    if bucket not in BUCKETS:
        raise ValueError(f"unsupported usage bucket {bucket!r}")


def _scope_filters(df: DataFrame, model_column: str, **f) -> DataFrame:
    """The optional filters; only the ones set become predicates, so they can be pushed down."""
    for key, column, all_word in (
        ("category", "category", False), ("campaign_id", "campaign_id", True), ("model_name", model_column, True),
        ("user_id", "user_id", False), ("service_name", "service_name", False), ("operation", "operation_name", False),
        ("company_id", "company_id", False),
    ):
        value = f.get(key)
        if wanted(value) and not (all_word and value == "all"):
            df = df.filter(F.col(column) == value)
    run = f.get("research_run_id")
    if wanted(run):
        df = df.filter((F.col("run_id") == run) | (F.col("metadata_research_run_id") == run))
    return df


def _rolled_up(df: DataFrame, bucket_start: Column, one_workspace: bool) -> DataFrame:
    """Sums per bucket and label; only the result for one workspace is sorted, as the service returns it."""
    sums = [_whole(F.sum(m)).alias(m) for m in COUNTERS]
    sums += [F.sum(m).cast(MONEY).alias(m) for m in FOUND]
    sums += [F.round(F.sum(m), 6).cast(MONEY).alias(m) for m in COSTS]
    rows = df.withColumn("bucket_start", bucket_start).groupBy(*ROLLUP_KEY).agg(*sums)
    order = [F.asc_nulls_last("bucket_start"), F.desc_nulls_first("billed_cost"), "category", "task_label", F.asc_nulls_last("model_label")]
    return rows.orderBy(*order) if one_workspace else rows


def rollup(usage: DataFrame, start, end, bucket: str = "day", org_id: str | None = None, **filters) -> DataFrame:
    """Usage straight from the ledger, grouped by bucket x category x campaign x user x task x model.

    `[start, end]` is inclusive. Filters: category, campaign_id, model_name, user_id, service_name,
    operation, company_id, research_run_id; NULL and '' mean none, 'all' too for campaign and model.
    NULL and '' campaigns stay apart here.
    """
    _check_bucket(bucket)
    rows = for_org(usage, org_id).filter(F.col("created_at").between(moment(start), moment(end)))
    # ledger columns are filtered before the metadata is parsed
    early = {k: filters.get(k) for k in ("campaign_id", "model_name", "user_id")}
    rows = _scope_filters(rows, "model_name", **early)
    late = {k: v for k, v in filters.items() if k not in early}
    rows = _scope_filters(_classified(rows), "model_name", **late)
    return _rolled_up(_measured(rows), _bucket(F.col("created_at"), bucket, start), org_id is not None)


def rollup_facts(facts: DataFrame, start, end, bucket: str = "day", org_id: str | None = None, **filters) -> DataFrame:
    """`rollup` over `facts`: all filters are on stored columns, so they reach the scan, and no metadata is parsed."""
    _check_bucket(bucket)
    rows = for_org(facts, org_id).filter(F.col("created_at").between(moment(start), moment(end)))
    return _rolled_up(_scope_filters(rows, "model_name", **filters), _bucket(F.col("created_at"), bucket, start), org_id is not None)


# ---- projection ---------------------------------------------------------------------------


def _projection_sums(df: DataFrame, count: Column) -> DataFrame:
    return df.groupBy(*PROJECTION_KEY).agg(
        *(F.sum(m).alias(m) for m in COUNTERS),
        *(F.sum(m).cast(MONEY).alias(m) for m in FOUND + COSTS),
        count.alias("usage_row_count"),
    )


def build_projection(contributions: DataFrame) -> DataFrame:
    """Hour and day aggregates over the full dimension key.

    A contribution is computed once, then counted for both grains in one aggregation: one scan
    and one shuffle of partial sums.
    """
    return _projection_sums(_grains(contributions), F.count("*"))


def bucket_sums(contributions: DataFrame, grain: str) -> DataFrame:
    """Hour or day aggregates alone."""
    rows = contributions.withColumns({"bucket_granularity": F.lit(grain), "bucket_start": F.date_trunc(grain, "occurred_at")})
    return _projection_sums(rows, F.count("*"))


def _grains(contributions: DataFrame) -> DataFrame:
    """Each contribution once for the hour and once for the day."""
    grain = F.col("bucket_granularity")
    rows = contributions.withColumn("bucket_granularity", F.explode(F.array(F.lit("hour"), F.lit("day"))))
    start = F.when(grain == "hour", F.date_trunc("hour", "occurred_at")).otherwise(F.date_trunc("day", "occurred_at"))
    return rows.withColumn("bucket_start", start)


def signed_rows(contributions: DataFrame, sign: int) -> DataFrame:
    """Hour and day deltas of contributions, one row each, not yet summed."""
    rows = _grains(contributions).withColumn("usage_row_count", F.lit(1).cast("bigint"))
    return rows.select(
        *PROJECTION_KEY, *((F.col(m) * sign).cast(MONEY if m in FOUND + COSTS else "bigint").alias(m) for m in (*MEASURES, "usage_row_count"))
    )


def _as_utc(value) -> datetime:
    if isinstance(value, str):
        value = datetime.fromisoformat(value)
    return value.astimezone(timezone.utc).replace(tzinfo=None) if value.tzinfo else value


def rollup_from_projection(
    projection: DataFrame, contributions: DataFrame, start, end, bucket: str = "day",
    org_id: str | None = None, *, ready: bool, **filters,
) -> DataFrame:
    """`rollup` answered from whole projection buckets plus the contributions at the two ragged edges.

    '' dimensions come back as NULL. `ready` is the result of `projection_ready`; the operator
    refuses to answer from a projection that misses rows.
    """
    _check_bucket(bucket)
    if not ready:
        raise RuntimeError("usage projection is not ready")
    grain = "hour" if bucket == "hour" else "day"
    width = timedelta(hours=1) if grain == "hour" else timedelta(days=1)
    start, end = _as_utc(start), _as_utc(end)
    floor = lambda t: t.replace(minute=0, second=0, microsecond=0, **({} if grain == "hour" else {"hour": 0}))
    first = floor(start) if floor(start) == start else floor(start) + width
    last = max(floor(end), first)
    whole = for_org(projection, org_id).filter(
        (F.col("bucket_granularity") == grain) & (F.col("bucket_start") >= moment(first)) & (F.col("bucket_start") < moment(last))
    )
    at = F.col("occurred_at")
    edges = for_org(contributions, org_id).filter(
        at.between(moment(start), moment(end)) & ((at < moment(first)) | (at >= moment(last)))
    )
    columns = [*DIMENSIONS, "bucket_start", *MEASURES]
    rows = whole.select(*columns).unionByName(edges.withColumn("bucket_start", F.date_trunc(grain, at)).select(*columns))
    rows = _scope_filters(rows, "raw_model_name", **filters)
    rows = rows.withColumns({d: non_empty(F.col(d)) for d in ("campaign_id", "user_id", "model_label")})
    return _rolled_up(rows, F.col("bucket_start") if bucket != "total" else _bucket(at, bucket, start), org_id is not None)


def missing_contributions(usage: DataFrame, contributions: DataFrame) -> DataFrame:
    """Dated usage rows without a contribution."""
    done = contributions.select(F.col("usage_id").alias("id"))
    return usage.filter(F.col("created_at").isNotNull()).join(done, "id", "left_anti")


def projection_ready(usage: DataFrame, contributions: DataFrame) -> bool:
    return missing_contributions(usage, contributions).isEmpty()


def backfill(
    usage: DataFrame, contributions: DataFrame, start=None, end=None, org_id: str | None = None,
    batch_size: int | None = None, after: tuple | None = None,
) -> DataFrame:
    """Contributions still to be added; run again it returns none.

    Without `batch_size` all missing rows are projected in one job. With it, the next 1..10000
    rows in (created_at, id) order behind the cursor `after`.
    """
    if batch_size is not None and not 1 <= batch_size <= 10000:
        raise ValueError("batch size must be between 1 and 10000")
    at, key = F.col("created_at"), F.col("id")
    rows = for_org(missing_contributions(usage, contributions), org_id)
    if start is not None:
        rows = rows.filter(at >= moment(start))
    if end is not None:
        rows = rows.filter(at <= moment(end))
    if after is not None:
        when, last_id = after
        later = at > moment(when)
        tie = at == moment(when)
        rows = rows.filter(later | (tie if last_id is None else tie & (key > last_id)))
    if batch_size is not None:
        rows = rows.orderBy(at, key).limit(batch_size)
    return contribution(rows)


def backfill_summary(batch: DataFrame) -> DataFrame:
    """Inserted rows and the cursor for the next batch."""
    last = F.max(F.struct("occurred_at", "usage_id"))
    return batch.agg(F.count("*").alias("inserted_count"), last.alias("last")).select(
        "inserted_count", F.col("last.occurred_at").alias("last_created_at"), F.col("last.usage_id").alias("last_usage_id")
    )


def apply_changes(contributions: DataFrame, projection: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fold inserts, updates and deletes of usage rows into contributions and projection, exactly.

    `changes` holds usage rows plus `op` (insert, update, delete) and `seq`; the last change of an
    id counts. Stored contributions are subtracted, new ones added; groups that reach zero rows
    disappear and a group below zero fails the job. `signed_changes` and a `ProjectionStore` do the same
    to a stored projection, rewriting what the changes touch only.
    """
    old, new, touched = _replaced(contributions, changes)
    signed = build_signed(old, -1).unionByName(build_signed(new, 1))
    next_contributions = contributions.join(touched, "usage_id", "left_anti").unionByName(new)
    return next_contributions, merge_projection(projection, signed)


def signed_changes(contributions: DataFrame, changes: DataFrame) -> DataFrame:
    """The deltas of the projection that the changes make: stored contributions of their rows negative, new ones positive."""
    old, new, _ = _replaced(contributions, changes)
    return build_signed(old, -1).unionByName(build_signed(new, 1))


def _replaced(contributions: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored and new contributions of the changed rows, and their ids."""
    latest = first_per_key(changes, ["id"], [F.desc("seq")])
    touched = latest.select(F.col("id").alias("usage_id"))
    old = contributions.join(touched, "usage_id", "left_semi")
    return old, contribution(latest.filter(F.col("op") != "delete").drop("op", "seq")), touched


def build_signed(contributions: DataFrame, sign: int) -> DataFrame:
    """Hour and day deltas of a set of contributions."""
    return build_projection(contributions).withColumns(
        {m: (F.col(m) * sign).cast(MONEY if m in FOUND + COSTS else "bigint") for m in (*MEASURES, "usage_row_count")}
    )


def merge_projection(projection: DataFrame, deltas: DataFrame) -> DataFrame:
    columns = [*PROJECTION_KEY, *MEASURES, "usage_row_count"]
    return merge_deltas(projection.select(*columns).unionByName(deltas.select(*columns)))


def sum_deltas(deltas: DataFrame) -> DataFrame:
    """Signed rows summed per group."""
    return _projection_sums(deltas, F.sum("usage_row_count"))


def merge_deltas(deltas: DataFrame) -> DataFrame:
    """Sum signed rows per group; empty groups vanish and a negative one fails the job."""
    return checked_sums(sum_deltas(deltas))


def checked_sums(merged: DataFrame) -> DataFrame:
    """Sums without empty groups; a negative one fails the job."""
    count = F.col("usage_row_count")
    fail = F.raise_error(F.lit("usage projection subtraction has no matching aggregate")).cast("boolean")
    return merged.filter(F.when(count < 0, fail).otherwise(count > 0))


# ---- labels from a rule table -------------------------------------------------------------


class LabelRule(NamedTuple):
    """'' matches any provider or service; the pattern is a LIKE pattern; lowest priority wins."""

    provider: str
    service: str
    model_pattern: str
    needs_grounding: bool
    label: str
    priority: int


def _rules(label: str, priority: int, pairs, service: str = "", grounding: bool = False) -> list[LabelRule]:
    return [LabelRule(p, service, m, grounding, label, priority) for p, m in pairs]


# fixed values: the default rule table
WRITERS = [("openai", "%"), ("anthropic", "%"), ("togetherai", "%")]
DEFAULT_LABEL_RULES = [
    *_rules("Email copywriting", 10, WRITERS, service="email_generation_service"),
    *_rules("Email reply handling", 10, WRITERS, service="email_reply_processor_service"),
    *_rules("Web search (grounding)", 5, [("gemini", "gemini-%")], grounding=True),
    *_rules("LLM generation", 20, [("gemini", "gemini-%"), ("openai", "gpt-%"), ("openai", "o%-mini"), ("openai", "o3"), ("togetherai", "deepseek%")]),
    *_rules("Web research", 20, [("perplexity", "sonar%")]),
    *_rules("Web research", 10, [("exa", "exa-%")]),
    *_rules("Email finder", 10, [("hunter", "hunter-%"), ("icypeas", "icypeas-%"), ("apollo", "apollo-%"), ("airscale", "airscale-email%"), ("b2b_enrichment", "b2b-email_finder%")]),
    *_rules("Phone discovery", 10, [("airscale", "airscale-phone%")]),
    *_rules("People search", 10, [("ai_ark", "ai-ark-%"), ("b2b_enrichment", "b2b-people_search%")]),
    *_rules("Email verifier", 10, [("b2b_enrichment", "b2b-email_verifier%")]),
    *_rules("Company search", 10, [("b2b_enrichment", "b2b-company_profile%"), ("b2b_enrichment", "b2b-similar_companies%")]),
    *_rules("Contact enrichment", 50, [("b2b_enrichment", "b2b-%")]),
]

MAX_LABEL_RULES = 1000


def _rule_label(rules: Sequence[LabelRule]) -> Column:
    """Best rule per row as one CASE in priority order: no join, no shuffle."""
    if len(rules) > MAX_LABEL_RULES:
        raise ValueError(f"at most {MAX_LABEL_RULES} label rules")
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (r.priority, r.label), reverse=True):
        hit = F.lit(True)
        if rule.provider:
            hit = hit & (F.col("provider") == rule.provider)
        if rule.service:
            hit = hit & (F.col("service") == rule.service)
        if rule.model_pattern:
            hit = hit & _model_like(rule.model_pattern)
        if rule.needs_grounding:
            hit = hit & (F.col("grounding_queries") > 0)
        out = F.when(hit, F.lit(rule.label)).otherwise(out)
    return out


def rollup_labelled(
    usage: DataFrame, start, end, bucket: str = "day", org_id: str | None = None, user_id: str | None = None,
    rules: Sequence[LabelRule] = DEFAULT_LABEL_RULES,
) -> DataFrame:
    """Rollup whose task label is the best match of a rule table, with a fallback per provider."""
    rows = for_org(usage, org_id).filter(F.col("created_at").between(moment(start), moment(end)))
    if user_id is not None:
        rows = rows.filter(F.col("user_id") == user_id)
    provider, grounding = F.col("provider"), F.col("grounding_queries")
    b2b = provider == "b2b_enrichment"
    rows = rows.withColumns(
        {
            "service": F.coalesce(F.get_json_object("metadata", "$.service"), F.lit("")),
            "action": F.coalesce(F.get_json_object("metadata", "$.action"), F.lit("")),
            "grounding_queries": F.coalesce(F.get_json_object("metadata", "$.grounding_queries").try_cast("bigint"), F.lit(0)),
            "bucket_start": _bucket(F.col("created_at"), bucket if bucket in ("hour", "day") else "total", start),
        }
    ).withColumn("category", _category(TOKEN_PROVIDERS[:7], F.col("action")))
    fallback = (
        F.when((provider == "gemini") & (grounding > 0), "Web search (grounding)")
        .when(F.col("category") == "phones", "Phone discovery")
        .when(provider.isin("hunter", "icypeas", "apollo"), "Email finder")
        .when(provider == "exa", "Web research")
        .when(provider == "ai_ark", "People search")
        .when(b2b & _model_like("b2b-email_verifier%"), "Email verifier")
        .when(b2b & _model_like("b2b-email_finder%"), "Email finder")
        .when(b2b & _model_like("b2b-people_search%"), "People search")
        .when(b2b & _model_like("b2b-company_profile%"), "Company search")
        .when(b2b, "Contact enrichment")
        .otherwise("LLM generation")
    )
    return (
        rows.withColumns(
            {
                "task_label": F.coalesce(_rule_label(rules), fallback),
                "model_label": F.when(F.col("category") == "tokens", F.col("model_name")),
            }
        )
        .groupBy(*ROLLUP_KEY)
        .agg(
            *(F.sum(c).cast("bigint").alias(c) for c in ("api_calls", "input_tokens", "output_tokens", "grounding_queries")),
            *(F.round(money(c), 6).cast(MONEY).alias(c) for c in COSTS),
        )
        .orderBy("organization_id", F.desc_nulls_first("bucket_start"), "category", "task_label", F.asc_nulls_last("model_label"))
    )


# ---- summary views ------------------------------------------------------------------------


def _ledger_sums() -> list[Column]:
    return [
        total("input_tokens").alias("total_input_tokens"),
        total("output_tokens").alias("total_output_tokens"),
        total("total_tokens").alias("total_tokens"),
        total("api_calls").alias("total_api_calls"),
        money("list_cost").alias("total_list_cost"),
        money("billed_cost").alias("total_billed_cost"),
        F.count("*").alias("total_records"),
        F.min("created_at").alias("first_usage_at"),
        F.max("created_at").alias("last_usage_at"),
    ]


def _dated(usage: DataFrame) -> DataFrame:
    return usage.filter(F.col("created_at").isNotNull()).withColumn("usage_date", F.to_date("created_at"))


def daily(usage: DataFrame, org_id: str | None = None) -> DataFrame:
    """Workspace x UTC date x provider x model x campaign x user."""
    return (
        _dated(for_org(usage, org_id))
        .groupBy("organization_id", "usage_date", "provider", "model_name", "campaign_id", "user_id")
        .agg(*_ledger_sums(), F.countDistinct("session_id").alias("unique_sessions"))
    )


def cost(usage: DataFrame, grain: str | None = "daily", by: str | None = None, org_id: str | None = None) -> DataFrame:
    """The cost views.

    grain: 'daily', 'monthly' or None (all time). by: None (campaign rows only), 'campaign',
    'context' or 'split' (campaign against non-campaign).
    """
    rows = for_org(usage, org_id)
    keys = ["organization_id"]
    distinct = ["provider", "model_name", "session_id", "campaign_id"]
    if by in (None, "campaign"):
        rows = rows.filter(F.col("campaign_id").isNotNull())
    if by == "campaign":
        keys.append("campaign_id")
        distinct.remove("campaign_id")
    elif by == "context":
        rows = rows.filter(F.col("usage_context").isNotNull())
        keys.append("usage_context")
    elif by == "split":
        rows = rows.withColumn("cost_type", F.when(F.col("campaign_id").isNotNull(), "campaign").otherwise("non_campaign"))
        keys.append("cost_type")
    if grain is not None:
        rows = _dated(rows)
        if grain == "monthly":
            rows = rows.withColumn("usage_month", F.trunc("usage_date", "month"))
        keys.append("usage_date" if grain == "daily" else "usage_month")
    names = {"provider": "unique_providers", "model_name": "unique_models", "session_id": "unique_sessions", "campaign_id": "unique_campaigns"}
    # several distinct counts multiply their input, so the ledger is summed first
    summed = rows.groupBy(*keys, *distinct).agg(*_ledger_sums())
    sums = [F.sum(c).alias(c) for c in ("total_input_tokens", "total_output_tokens", "total_tokens", "total_api_calls", "total_records")]
    sums += [F.sum(c).cast(MONEY).alias(c) for c in ("total_list_cost", "total_billed_cost")]
    sums += [F.min("first_usage_at").alias("first_usage_at"), F.max("last_usage_at").alias("last_usage_at")]
    return summed.groupBy(*keys).agg(*sums, *(F.countDistinct(c).alias(names[c]) for c in distinct))


def daily_stats(usage: DataFrame) -> DataFrame:
    """Provider and model sums per day; undated rows form their own day."""
    return (
        usage.groupBy("organization_id", F.to_date("created_at").alias("usage_date"), "provider", "model_name")
        .agg(
            *(F.sum(c).alias(f"daily_{c}") for c in ("api_calls", "input_tokens", "output_tokens", "total_tokens")),
            F.countDistinct("session_id").alias("unique_sessions"),
            F.count("*").alias("total_operations"),
        )
    )


def _between_days(usage: DataFrame, first_day: str, last_day: str) -> DataFrame:
    """Both days inclusive, written as a range on the stored instant so it reaches the scan."""
    at = F.col("created_at")
    return usage.filter((at >= moment(first_day)) & (at < moment(last_day) + F.expr("INTERVAL 1 DAY")))


def by_date_range(usage: DataFrame, first_day: str, last_day: str, provider: str | None = None, org_id: str | None = None) -> DataFrame:
    rows = _between_days(for_org(usage, org_id), first_day, last_day)
    if provider is not None:
        rows = rows.filter(F.col("provider") == provider)
    return (
        rows.groupBy("organization_id", "provider", "model_name")
        .agg(
            *(F.sum(c).alias(n) for c, n in _TOTALS),
            F.countDistinct("session_id").alias("unique_sessions"),
        )
        .orderBy("organization_id", F.asc_nulls_last("provider"), F.asc_nulls_last("model_name"))
    )


_TOTALS = (
    ("api_calls", "total_api_calls"), ("input_tokens", "total_input_tokens"),
    ("output_tokens", "total_output_tokens"), ("total_tokens", "total_tokens"),
)


def _token_scope(usage, first_day, last_day, model_name, campaign_id, org_id) -> DataFrame:
    rows = _between_days(for_org(usage, org_id), first_day, last_day)
    if model_name is not None:
        rows = rows.filter(F.col("model_name") == model_name)
    if campaign_id is not None:
        rows = rows.filter(F.col("campaign_id") == campaign_id)
    return rows


def token_summary(
    usage: DataFrame, organizations: DataFrame, first_day: str, last_day: str,
    model_name: str | None = None, campaign_id: str | None = None, org_id: str | None = None,
) -> DataFrame:
    """One row per workspace and calendar day, empty days included."""
    rows = _token_scope(usage, first_day, last_day, model_name, campaign_id, org_id)
    days = rows.groupBy("organization_id", F.date_trunc("day", "created_at").alias("period_start")).agg(
        *(total(c).alias(n) for c, n in _TOTALS),
        # the distinct names are few: they are reduced before they are joined to text
        F.array_join(F.array_sort(F.collect_set("provider")), ", ").alias("provider"),
        F.array_join(F.array_sort(F.collect_set("model_name")), ", ").alias("model_name"),
        F.countDistinct("session_id").alias("unique_sessions"),
    )
    spine = for_org(organizations.select(F.col("id").alias("organization_id")), org_id).withColumn(
        "period_start", F.explode(F.sequence(moment(first_day), moment(last_day), F.expr("INTERVAL 1 DAY")))
    )
    zero = [n for _, n in _TOTALS] + ["unique_sessions"]
    return (
        spine.join(days, ["organization_id", "period_start"], "left")
        .fillna(0, zero)
        .fillna("", ["provider", "model_name"])
        .withColumn("total_runs", F.col("total_api_calls"))
        .orderBy("organization_id", "period_start")
    )


def token_stats(
    usage: DataFrame, organizations: DataFrame, first_day: str, last_day: str,
    model_name: str | None = None, campaign_id: str | None = None, org_id: str | None = None,
) -> DataFrame:
    """Totals per workspace, zeros for a workspace without usage."""
    rows = _token_scope(usage, first_day, last_day, model_name, campaign_id, org_id)
    sums = rows.groupBy("organization_id").agg(*(total(c).alias(n) for c, n in _TOTALS))
    ids = for_org(organizations.select(F.col("id").alias("organization_id")), org_id)
    return (
        ids.join(sums, "organization_id", "left")
        .fillna(0)
        .withColumns({"total_runs": F.col("total_api_calls"), "total_processing_time": F.lit(0).cast("bigint")})
    )


def token_usage_range(tokens: DataFrame, start, end, provider: str | None = None, org_id: str | None = None) -> DataFrame:
    """Legacy token fact, trackings that lie inside [start, end]."""
    rows = for_org(tokens, org_id).filter((F.col("tracking_start") >= moment(start)) & (F.col("tracking_end") <= moment(end)))
    if provider is not None:
        rows = rows.filter(F.col("provider") == provider)
    names = ("total_calls", "total_tokens", "total_input_tokens", "total_output_tokens")
    return (
        rows.groupBy("organization_id", "provider", "model_name")
        .agg(*(F.sum(c).alias(c) for c in names), F.count_if(F.col("provider") == "agent_run").alias("total_runs"))
        .orderBy("organization_id", "provider", F.asc_nulls_last("model_name"))
    )


def daily_token_usage(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("organization_id", F.to_date("tracking_start").alias("usage_date"), "provider", "model_name").agg(
        F.sum("total_calls").alias("daily_calls"),
        F.sum("total_tokens").alias("daily_tokens"),
        F.sum("total_input_tokens").alias("daily_input_tokens"),
        F.sum("total_output_tokens").alias("daily_output_tokens"),
        F.countDistinct("session_id").alias("unique_sessions"),
    )


def summary_table(usage: DataFrame) -> DataFrame:
    """Workspace x provider x model x date; a call is a ledger row."""
    return usage.groupBy("organization_id", "provider", "model_name", F.to_date("created_at").alias("date")).agg(
        F.count("*").alias("total_api_calls"),
        *(F.sum(c).alias(n) for c, n in _TOTALS[1:]),
        F.countDistinct("session_id").alias("unique_sessions"),
    )


def hourly_run_summary(runs: DataFrame) -> DataFrame:
    """Agent runs per workspace, model and hour of the run."""
    hour = F.date_trunc("hour", "created_at")
    return (
        runs.groupBy("organization_id", "model_name", hour.alias("period_start"))
        .agg(
            F.count("*").alias("total_runs"),
            *(F.sum(c).alias(c) for c in ("total_input_tokens", "total_output_tokens", "total_tokens", "total_processing_time")),
        )
        .withColumn("period_end", F.col("period_start") + F.expr("INTERVAL 1 HOUR"))
    )


def from_agent_runs(runs: DataFrame, usage: DataFrame) -> DataFrame:
    """Usage rows for runs the ledger does not hold yet."""
    known = usage.select("run_id", "organization_id")
    return runs.join(known, ["run_id", "organization_id"], "left_anti").select(
        "organization_id", "session_id", F.lit("openai").alias("provider"), "model_name", F.lit(1).alias("api_calls"),
        F.col("total_input_tokens").alias("input_tokens"), F.col("total_output_tokens").alias("output_tokens"), "total_tokens",
        "run_id", "agent_id", F.col("content").alias("description"),
        F.coalesce("event", F.lit("direct_api")).alias("usage_context"),
        "created_at", F.col("created_at").alias("tracking_start"), F.col("created_at").alias("tracking_end"),
        F.col("metrics_raw").alias("metadata"),
    )


# ---- corrections --------------------------------------------------------------------------

# fixed values: unit prices of the two providers that are repriced
REPRICED = {
    "ai_ark": {"model": "ai-ark-similar_companies", "list": "0.0135", "billed": "0.0405"},
    "icypeas": {"model": "icypeas-email-finder", "list": "0.02", "billed": "0.03"},
}
UNSIGNED_PATTERN = r"^[0-9]+(\.[0-9]+)?$"


def reprice_missing(usage: DataFrame, as_of) -> DataFrame:
    """Price uninvoiced zero-cost rows of two providers from the first unit source that is not 0.

    Returns the whole ledger with `repriced` telling the changed rows.
    """
    provider = F.col("provider")
    kind = "decimal(38,6)"

    def units(key: str) -> Column:
        text = F.col(f"_meta.{key}")
        return F.nullif(F.when(text.rlike(UNSIGNED_PATTERN), text.cast(kind)), F.lit(0).cast(kind))

    def stored_units(name: str) -> Column:
        return F.nullif(F.coalesce(F.col(name), F.lit(0)).cast(kind), F.lit(0).cast(kind))

    half = F.lit(2).cast("decimal(2,0)")  # half a credit per profile
    ark_units = F.coalesce(
        units("billable_units"), units("profiles_returned"), (units("total_credits") * half).cast(kind),
        (stored_units("output_tokens") * half).cast(kind), stored_units("api_calls"),
    )
    icy_units = F.coalesce(units("found_emails"), units("billable_units"), stored_units("output_tokens"), stored_units("api_calls"))
    ark = (provider == "ai_ark") & (
        (F.col("model_name") == REPRICED["ai_ark"]["model"]) | (F.col("_meta.action") == "similar_companies")
    )
    icy = (provider == "icypeas") & F.col("model_name").like("icypeas%")
    unpriced = (F.coalesce("list_cost", F.lit(0)) == 0) | (F.coalesce("billed_cost", F.lit(0)) == 0)
    hit = F.coalesce(F.col("invoice_id").isNull() & unpriced & (ark | icy), F.lit(False))

    def price(side: str) -> Column:
        rate = F.when(provider == "ai_ark", F.lit(REPRICED["ai_ark"][side]).cast("decimal(6,4)")).otherwise(
            F.lit(REPRICED["icypeas"][side]).cast("decimal(6,4)")
        )
        return F.round(F.col("priced_units") * rate, 6).cast("decimal(12,6)")

    rows = (
        usage.withColumn("_meta", json_fields(plain_json(F.col("metadata")), ["action", "billable_units", "profiles_returned", "total_credits", "found_emails"]))
        .withColumn("repriced", hit)
        .withColumn("priced_units", F.when(F.col("repriced"), F.when(provider == "ai_ark", ark_units).otherwise(icy_units)))
        .drop("_meta")
    )
    return rows.withColumns(
        {
            "list_cost": F.when(F.col("repriced"), price("list")).otherwise(F.col("list_cost")),
            "billed_cost": F.when(F.col("repriced"), price("billed")).otherwise(F.col("billed_cost")),
            "pricing": F.when(
                F.col("repriced"),
                F.to_json(
                    F.struct(
                        F.when(provider == "ai_ark", REPRICED["ai_ark"]["model"]).otherwise(REPRICED["icypeas"]["model"]).alias("model_id"),
                        provider.alias("provider"),
                        F.when(provider == "ai_ark", "credit_based").otherwise("request_based").alias("provider_type"),
                    )
                ),
            ),
            "repriced_at": F.when(F.col("repriced"), moment(as_of)),
        }
    )


def mark_failed_lookups(usage: DataFrame, as_of) -> DataFrame:
    """Failed, uninvoiced phone lookups become unbilled telemetry. Returns the whole ledger."""
    meta = F.col("metadata")
    is_object = F.coalesce(F.ltrim(meta).startswith("{") & F.try_parse_json(meta).isNotNull(), F.lit(False))
    hit = F.coalesce(
        (F.col("provider") == "airscale")
        & F.col("model_name").isin("airscale-phone_finder", "airscale-phone-finder")
        & is_object
        & (F.coalesce(F.get_json_object(meta, "$.action"), F.lit("phone_finder")) == "phone_finder")
        & ~F.lower(F.coalesce(F.get_json_object(meta, "$.success"), F.lit("false"))).isin("true", "1", "yes")
        & F.col("invoice_id").isNull()
        & (F.coalesce("billed_cost", F.lit(0)) > 0),
        F.lit(False),
    )
    # the stamp is spliced in before the closing brace, so the other entries keep their JSON types
    body = F.regexp_replace(meta, r"\s*\}\s*$", "")
    stamp = ', "cost_mode":"telemetry","billing_adjustment":"failed-phone-lookup-not-billable","billing_adjusted_at":"'
    joined = F.concat(body, F.when(F.trim(body) == "{", F.lit(stamp[2:])).otherwise(F.lit(stamp[0] + stamp[2:])), F.lit(f'{as_of}"}}'))
    zero = lambda c: F.when(F.col("adjusted"), F.lit(0)).otherwise(F.col(c))
    return usage.withColumn("adjusted", hit).withColumns(
        {
            "output_tokens": zero("output_tokens").cast("int"),
            "total_tokens": zero("total_tokens").cast("int"),
            "billed_cost": zero("billed_cost").cast("decimal(12,6)"),
            "metadata": F.when(F.col("adjusted"), joined).otherwise(meta),
        }
    )
