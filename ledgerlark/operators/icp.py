"""Ideal-customer-profile blocking and profiles, company and contact analytics."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.json import json_strings

ORG = "organization_id"
BLOCKING_STEPS = ("icp_scoring", "early_block_check")
LOG = "struct<final_status: string, steps: array<struct<step: string, data: struct<failed_filters: array<string>>>>>"

# fixed values: criteria of the default profile
DEFAULT_CRITERIA = {
    "industries": {"enabled": False, "isHardFilter": False, "weight": 3, "value": []},
    "company_size": {"enabled": True, "isHardFilter": False, "weight": 3, "value": {"min": 11, "max": 500}},
    "regions": {"enabled": False, "isHardFilter": False, "weight": 2, "value": {"primary": [], "secondary": []}},
    "job_titles": {"enabled": True, "isHardFilter": False, "weight": 3, "value": ["Founder", "CEO"]},
}


def _score_filters() -> tuple[Column, Column, Column]:
    at = lambda path: F.get_json_object("icp_score", path)
    return json_strings(at("$.llm_analysis.failed_filters")), json_strings(at("$.reasoning.failed_hard_filters")), at("$.reasoning.hard_filter_failed")


def blocked_detail(companies: DataFrame, n: int) -> DataFrame:
    """Newest blocked companies with the failed filters of the processing log and of the score."""
    steps = F.from_json("processing_log", LOG)["steps"]
    relevant = F.filter(steps, lambda s: s["step"].isin(*BLOCKING_STEPS))
    from_analysis, from_reasoning, single = _score_filters()
    return (
        companies.filter(F.col("blocked_by_icp").eqNullSafe(True))
        .orderBy(F.desc("created_at"), "id")
        .limit(n)
        .select(
            "id", ORG, "name", "created_at", F.get_json_object("processing_log", "$.final_status").alias("final_status"),
            F.flatten(F.transform(relevant, lambda s: F.coalesce(s["data"]["failed_filters"], F.array().cast("array<string>")))).alias("failed_filters_from_log"),
            from_analysis.alias("failed_filters_from_score"), from_reasoning.alias("failed_filters_from_reasoning"), single.alias("hard_filter_failed"),
        )
    )


def blocking_reasons(companies: DataFrame) -> DataFrame:
    """How often each failed filter blocks a company: the first of the three sources that exists counts."""
    from_analysis, from_reasoning, single = _score_filters()
    reasons = F.coalesce(from_analysis, from_reasoning, F.array_compact(F.array(single)))
    rows = companies.filter(F.col("blocked_by_icp").eqNullSafe(True)).select(F.explode(reasons).alias("failed_filter"))
    return rows.filter(F.col("failed_filter").isNotNull()).groupBy("failed_filter").agg(F.count("*").alias("blocked_count")).orderBy(F.desc("blocked_count"), "failed_filter")


def reset_blocking(links: DataFrame, profile_id: str) -> DataFrame:
    """Clear the blocked flag of one profile; `was_reset` tells the changed links."""
    hit = F.coalesce((F.col("icp_profile_id") == profile_id) & F.col("blocked_by_icp"), F.lit(False))
    return links.withColumn("was_reset", hit).withColumn("blocked_by_icp", F.when(F.col("was_reset"), False).otherwise(F.col("blocked_by_icp")))


def default_profiles(organizations: DataFrame, profiles: DataFrame) -> DataFrame:
    """Default profile rows for live workspaces that have none."""
    return (
        organizations.filter(~F.col("deleted").eqNullSafe(True))
        .select(F.col("id").alias(ORG))
        .join(profiles.select(ORG), ORG, "left_anti")
        .withColumns(
            {
                "name": F.lit("Default Profile"),
                "description": F.lit("Default Ideal Customer Profile configuration"),
                "is_default": F.lit(True),
                "criteria": F.lit(json.dumps(DEFAULT_CRITERIA, separators=(",", ":"))),
                "boosts_penalties": F.lit("{}"),
            }
        )
    )


SCORE_PARTS = ("industry_fit", "company_size_revenue", "tech_stack_compatibility", "engagement_intent", "customer_success_match", "strategic_value")
SUMMARIES = ("company_overview", "icp_analysis", "growth_signals", "recent_news", "company_profile")
FINDINGS = SUMMARIES[:3]


def _number(column: str, key: str) -> Column:
    return F.get_json_object(column, f"$.{key}").cast("decimal(18,6)")


def company_analytics(companies: DataFrame, company_contacts: DataFrame) -> DataFrame:
    """Companies with flattened scores, research summaries and findings, and their contact count."""
    counts = company_contacts.groupBy(ORG, F.col("company_id").alias("id")).agg(F.count("*").alias("total_contacts"))
    module = lambda name, key: F.get_json_object("research_modules", f"$.{name}.{key}")
    nothing = F.array().cast("array<string>")
    return (
        companies.join(counts, [ORG, "id"], "left")
        .select(
            "id", ORG, "name", "employee_count", "processing_status", "created_at",
            *(_number("icp_component_scores", p).alias(f"{p}_score") for p in SCORE_PARTS),
            *(module(m, "summary").alias(f"{m}_summary") for m in SUMMARIES),
            *(F.coalesce(json_strings(module(m, "key_findings")), nothing).alias(f"{m}_key_findings") for m in FINDINGS),
            F.coalesce("total_contacts", F.lit(0)).alias("total_contacts"),
        )
    )


OCEAN = {"openness": "openness", "conscientiousness": "conscientiousness", "extraversion": "extraversion", "agreeableness": "agreeableness", "emotionalStability": "emotional_stability"}
DISC = ("dominance", "influence", "steadiness", "calculativeness")


def contact_analytics(contacts: DataFrame, company_contacts: DataFrame, companies: DataFrame) -> DataFrame:
    """Contacts with flattened personality scores and the columns of their (newest) company."""
    from ledgerlark.operators.campaign import latest_link

    link = latest_link(company_contacts, [ORG, "contact_id"]).select(ORG, F.col("contact_id").alias("id"), "company_id")
    firms = companies.select(ORG, F.col("id").alias("company_id"), F.col("name").alias("company_name"), F.col("employee_count").alias("company_employee_count"))
    return (
        contacts.join(link, [ORG, "id"], "left")
        .join(firms, [ORG, "company_id"], "left")
        .select(
            "id", ORG, "company_id", "name", "email", "job_title", "fit_score", "processing_status", "created_at",
            *(_number("ocean_traits", k).alias(f"{n}_score") for k, n in OCEAN.items()),
            *(_number("disc_traits", k).alias(f"{k}_score") for k in DISC),
            "company_name", "company_employee_count",
        )
    )
