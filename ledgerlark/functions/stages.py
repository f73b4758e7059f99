"""Stage, status and score rules as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlark.functions.text import choose

# fixed values: contact stage -> deal stage; a won contact never moves a deal by itself
DEAL_STAGE_OF_CONTACT = {
    "LEAD": "LEAD",
    "REENGAGEMENT": "LEAD",
    "APPOINTMENT_REQUESTED": "MEETING_REQUESTED",
    "APPOINTMENT_CANCELLED": "MEETING_REQUESTED",
    "APPOINTMENT_SCHEDULED": "MEETING_BOOKED",
    "PRESENTATION_SCHEDULED": "PRESENTATION",
    "CONTRACT_NEGOTIATIONS": "NEGOTIATION",
    "AGREEMENT_IN_PRINCIPLE": "AGREEMENT",
    "CLOSED_LOST": "LOST",
    "NOT_INTERESTED": "LOST",
}
DEAL_STAGES = ("LOST", "LEAD", "MEETING_REQUESTED", "MEETING_BOOKED", "PRESENTATION", "NEGOTIATION", "AGREEMENT", "WON")
ACTIVE_DEAL_STAGES = DEAL_STAGES[1:-1]
PRIORITY_RANKS = {"urgent": 1, "high": 2, "normal": 3, "low": 4}


def stage_to_deal_stage(stage: Column) -> Column:
    return choose(F.upper(stage), DEAL_STAGE_OF_CONTACT, F.lit(None).cast("string"))


def deal_stage_level(stage: Column) -> Column:
    """Position of a deal stage, -1 for an unknown one."""
    out = F.lit(-1)
    for level, name in enumerate(DEAL_STAGES):
        out = F.when(F.upper(stage) == name, level).otherwise(out)
    return out


def priority_rank(priority: Column) -> Column:
    out = F.lit(3)
    for name, rank in PRIORITY_RANKS.items():
        out = F.when(priority == name, rank).otherwise(out)
    return out


def icp_tier(score: Column, current: Column) -> Column:
    """Tier 1 from 80, Tier 2 from 60, else Tier 3; no score keeps the current tier."""
    return F.when(score.isNull(), current).when(score >= 80, "Tier 1").when(score >= 60, "Tier 2").otherwise("Tier 3")


def lead_quality_score(fit, enrichment, has_url, has_summary, has_history, has_open, social) -> Column:
    """Weighted lead score; a missing social score makes the whole sum 0."""
    score = F.coalesce(fit * 0.4, F.lit(0.0)) + F.coalesce(enrichment * 0.2, F.lit(0.0))
    for flag, points in ((has_url, 10), (has_summary, 5), (has_history, 5), (has_open, 10)):
        score = score + F.when(F.coalesce(flag, F.lit(False)), points).otherwise(0)
    return F.coalesce(score + F.when(social > 50, F.lit(10.0)).otherwise(social * 0.2), F.lit(0.0))


def blocked_by_icp(current: Column, score_json: Column, manually_unblocked: Column) -> Column:
    """A manual unblock wins, else either JSON flag; without a score nothing changes."""
    flag = lambda path: F.coalesce(F.get_json_object(score_json, path) == "true", F.lit(False))
    either = flag("$.blocked") | flag("$.llm_analysis.blocked")
    return F.when(manually_unblocked.eqNullSafe(True), F.lit(False)).when(score_json.isNull(), current).otherwise(either)


# fixed values: processing status -> coarse status, NULL for any other
SIMPLE_STATUS = {
    "approved": "approved",
    "processed": "processed",
    "pending": "processing",
    "scheduled": "processing",
    "processing": "processing",
    "failed": "failed",
    "cancelled": "cancelled",
    "blocked_by_icp": "blocked",
}


def simple_status(status: Column) -> Column:
    return choose(status, SIMPLE_STATUS, F.lit(None).cast("string"))


def default_assignee(assigned: Column, owner: Column) -> Column:
    return F.coalesce(assigned, owner)
