"""Sales funnel: stage shares, conversion rates, industries, locations, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.operators.common import count_where, for_org, percent, top_per_key

# fixed values: stages that a contact at or beyond each step can hold
REACHED_LEAD = (
    "LEAD", "APPOINTMENT_REQUESTED", "APPOINTMENT_SCHEDULED", "APPOINTMENT_CANCELLED", "PRESENTATION_SCHEDULED",
    "CONTRACT_NEGOTIATIONS", "AGREEMENT_IN_PRINCIPLE", "CLOSED_WON", "CLOSED_LOST", "REENGAGEMENT",
)
REACHED_PRESENTATION = ("PRESENTATION_SCHEDULED", "CONTRACT_NEGOTIATIONS", "AGREEMENT_IN_PRINCIPLE", "CLOSED_WON")


def stages(contacts: DataFrame, org_id: str | None = None) -> DataFrame:
    """Count and share per stage; blank stages are UNKNOWN."""
    stage = F.upper(F.coalesce(F.when(F.trim("pipeline_stage") != "", F.trim("pipeline_stage")), F.lit("Unknown")))
    counts = for_org(contacts, org_id).groupBy("organization_id", stage.alias("stage")).agg(F.count("*").alias("contacts"))
    # the window runs over the few stage rows of a workspace, not over its contacts
    whole = F.sum("contacts").over(Window.partitionBy("organization_id"))
    return counts.withColumn("percentage", percent(F.col("contacts"), whole)).orderBy("organization_id", F.desc("contacts"), "stage")


def conversion(contacts: DataFrame, org_id: str | None = None) -> DataFrame:
    """Cumulative conversion prospect -> lead -> appointment -> presentation, in one pass."""
    stage = F.upper("pipeline_stage")
    counts = for_org(contacts, org_id).groupBy("organization_id").agg(
        F.count("*").alias("total_contacts"),
        count_where(stage.isin(*REACHED_LEAD)).alias("reached_lead"),
        count_where(stage.isin(*REACHED_LEAD[1:])).alias("reached_appointment"),
        count_where(stage.isin(*REACHED_LEAD[2:])).alias("reached_scheduled"),
        count_where(stage.isin(*REACHED_PRESENTATION)).alias("reached_presentation"),
    )
    return counts.withColumns(
        {
            "prospect_to_lead": percent(F.col("reached_lead"), F.col("total_contacts")),
            "lead_to_appointment": percent(F.col("reached_appointment"), F.col("reached_lead")),
            "appointment_to_presentation": percent(F.col("reached_presentation"), F.col("reached_scheduled")),
        }
    )


def _top_share(counts: DataFrame, name: str, k: int) -> DataFrame:
    top = top_per_key(counts, ["organization_id"], [F.desc("contacts"), F.col(name)], k)
    whole = F.sum("contacts").over(Window.partitionBy("organization_id"))
    return top.withColumn("percentage", percent(F.col("contacts"), whole)).orderBy("organization_id", F.desc("contacts"), name)


def top_industries(companies: DataFrame, company_contacts: DataFrame, org_id: str | None = None, k: int = 10) -> DataFrame:
    """Contact links per industry, the k largest and their share among them."""
    links = company_contacts.groupBy("organization_id", F.col("company_id").alias("id")).agg(F.count("*").alias("links"))
    # links are counted per company first, so the industries are exploded over companies only
    firms = for_org(companies, org_id).select("organization_id", "id", F.explode(F.array_distinct("industries")).alias("industry"))
    counts = firms.join(links, ["organization_id", "id"]).groupBy("organization_id", "industry").agg(F.sum("links").alias("contacts"))
    return _top_share(counts, "industry", k)


def top_locations(contacts: DataFrame, org_id: str | None = None, k: int = 10) -> DataFrame:
    """Contacts per non-empty location, the k largest and their share among them."""
    known = for_org(contacts, org_id).filter(F.col("location").isNotNull() & (F.col("location") != ""))
    counts = known.groupBy("organization_id", "location").agg(F.count("*").alias("contacts"))
    return _top_share(counts, "location", k)


def company_coverage(companies: DataFrame, company_contacts: DataFrame, org_id: str | None = None) -> DataFrame:
    """Companies, companies with contacts and mean contacts per company, empty ones included."""
    links = company_contacts.groupBy("organization_id", F.col("company_id").alias("id")).agg(F.count("*").alias("links"))
    firms = for_org(companies, org_id).select("organization_id", "id").join(links, ["organization_id", "id"], "left")
    mean = F.sum(F.coalesce("links", F.lit(0))).cast("decimal(20,0)") / F.count("*").cast("decimal(20,0)")
    return firms.groupBy("organization_id").agg(
        F.count("*").alias("total_companies"),
        F.count("links").alias("companies_with_contacts"),
        F.round(mean, 2).cast("decimal(12,2)").alias("average_contacts_per_company"),
    )
