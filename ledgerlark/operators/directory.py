"""Company and contact lists, the contact export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.json import json_strings
from ledgerlark.functions.text import first_name_of, last_name_of, non_empty, website_domain
from ledgerlark.operators.common import first_per_key, for_org
from ledgerlark.operators.query import ordering

ORG = "organization_id"


def _status_filter(status: str) -> Column:
    state, blocked = F.col("processing_status"), F.col("blocked_by_icp").eqNullSafe(True)
    rules = {
        "approved": (state == "approved") & ~blocked,
        "processing": state.isin("processing", "pending"),
        "processed": state.isin("processed", "approved", "declined") | blocked,
        "declined": state == "declined",
        "blocked_by_icp": blocked,
        "failed": state == "failed",
        "scheduled": state == "scheduled",
    }
    return rules.get(status, F.lit(False))


def by_campaign(
    companies: DataFrame, links: DataFrame, campaign_id: str, status: str | None = None, search: str | None = None,
    sort_by: str = "name", descending: bool = False, page: int = 1, limit: int = 50, org_id: str | None = None,
) -> DataFrame:
    """One page of a campaign's companies; `total_count` is the number before paging."""
    scope = for_org(links, org_id).filter(F.col("campaign_id") == campaign_id).select(ORG, F.col("company_id").alias("id"))
    rows = for_org(companies, org_id)
    if status:
        rows = rows.filter(_status_filter(status))
    if search:
        rows = rows.filter(F.col("name").ilike(f"%{search}%") | F.col("location").ilike(f"%{search}%"))
    rows = rows.join(scope, [ORG, "id"], "inner")
    total = rows.agg(F.countDistinct("id").alias("n")).scalar()
    key = ordering([f"-{sort_by}" if descending else sort_by, "name", "id"])
    out = rows.orderBy(*key)
    if page > 1:
        out = out.offset((page - 1) * limit)
    return out.limit(limit).withColumn("total_count", total)


def size_values(companies: DataFrame) -> DataFrame:
    known = companies.filter(F.col("company_size").isNotNull())
    return known.groupBy("company_size").agg(F.count("*").alias("company_count")).orderBy(F.desc("company_count"))


def size_mismatch(companies: DataFrame) -> DataFrame:
    known = companies.filter(F.col("company_size").isNotNull())
    return known.groupBy("company_size", "employee_count").agg(F.count("*").alias("companies")).orderBy("company_size", F.asc_nulls_last("employee_count"))


def needing_email(contacts: DataFrame, org_id: str | None = None) -> DataFrame:
    """Contacts without an email and without a lookup result, newest first."""
    return for_org(contacts, org_id).filter(F.col("email").isNull() & F.col("email_validation_response").isNull()).orderBy(F.desc("created_at"))


def _with_domain(contacts, company_contacts, companies, org_id) -> DataFrame:
    named = non_empty(F.col("first_name")).isNotNull() & non_empty(F.col("last_name")).isNotNull()
    missing = F.col("email").isNull() & F.col("email_validation_response").isNull()
    people = for_org(contacts, org_id).filter(missing & named).withColumnRenamed("id", "contact_id")
    links = company_contacts.select(ORG, "contact_id", "company_id", F.col("created_at").alias("linked_at"))
    firms = companies.filter(non_empty(F.col("website")).isNotNull()).select(
        ORG, F.col("id").alias("company_id"), F.col("name").alias("company_name"), "website", website_domain(F.col("website")).alias("extracted_domain")
    )
    return people.join(links, [ORG, "contact_id"]).join(firms, [ORG, "company_id"])


def needing_email_with_domain(contacts, company_contacts, companies, org_id: str | None = None) -> DataFrame:
    """The same contacts when named and linked to a company with a website, with the website's domain."""
    return _with_domain(contacts, company_contacts, companies, org_id).select(
        "contact_id", ORG, "first_name", "last_name", "company_id", "company_name", "website", "extracted_domain", "created_at", "linked_at"
    ).orderBy(F.desc("created_at"))


def domain_distribution(contacts, company_contacts, companies, org_id: str | None = None) -> DataFrame:
    rows = _with_domain(contacts, company_contacts, companies, org_id)
    return rows.groupBy("extracted_domain").agg(F.count("*").alias("contact_count")).orderBy(F.desc("contact_count"), "extracted_domain")


def export_template(contacts: DataFrame, company_contacts: DataFrame, companies: DataFrame, org_id: str | None = None) -> DataFrame:
    """One row per contact with the export columns; the best company exists, has a name and the newest link."""
    firms = companies.select(
        ORG, F.col("id").alias("company_id"), F.col("name").alias("company_name"), F.col("website").alias("company_website"),
        F.col("profile_url").alias("company_profile"), F.col("location").alias("company_location"),
        F.col("phone").alias("company_phone"), F.col("specialities").alias("company_specialities"), F.lit(True).alias("known"),
    )
    linked = company_contacts.join(firms, [ORG, "company_id"], "left")
    named = non_empty(F.col("company_name")).isNotNull()
    best = first_per_key(
        linked, [ORG, "contact_id"], [F.desc(F.coalesce("known", F.lit(False))), F.desc(named), F.desc_nulls_last("created_at"), F.asc("company_id")]
    ).select(ORG, F.col("contact_id").alias("id"), "company_name", "company_website", "company_profile", "company_location", "company_phone", "company_specialities")
    text = lambda c: F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit(""))
    place = F.coalesce(*(F.get_json_object("location", f"$.{k}") for k in ("city", "default", "country")))
    tools = F.coalesce(json_strings(F.col("skills")), json_strings(F.col("company_specialities")))
    return (
        for_org(contacts, org_id)
        .join(best, [ORG, "id"], "left")
        .select(
            "id", ORG,
            F.coalesce(F.col("first_name"), first_name_of(F.col("name")), F.lit("")).alias("first_name"),
            F.coalesce(F.col("last_name"), last_name_of(F.col("name")), F.lit("")).alias("last_name"),
            text("job_title").alias("title"), text("company_name").alias("company_name"), text("company_website").alias("company_website"),
            text("profile_url").alias("personal_profile"), text("company_profile").alias("company_profile"), F.lit("").alias("company_email"),
            text("email").alias("personal_email"), text("phone").alias("mobile_number"), text("company_phone").alias("company_number"), text(place).alias("person_location"), text("company_location").alias("company_location"),
            F.coalesce("pipeline_stage", F.lit("PROSPECT")).alias("stage"), text(F.array_join(tools, ", ")).alias("technologies"),
        )
    )
