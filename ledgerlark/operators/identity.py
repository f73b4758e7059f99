"""Contact identity: duplicates, soft merge, phantoms, raw record links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.text import non_blank, non_empty, normalize_profile_url
from ledgerlark.operators.common import first_per_key

ORG = "organization_id"
PHANTOM = "phantom_pending_rediscovery"


def with_keys(contacts: DataFrame) -> DataFrame:
    return contacts.withColumns({"url_key": normalize_profile_url(F.col("profile_url")), "email_key": F.lower(non_empty(F.col("email")))})


def duplicate_contacts(contacts: DataFrame, key: str) -> DataFrame:
    """Members of every group that shares a key ('url_key' or 'email_key') inside a workspace.

    One row per contact with its group's size and oldest contact, ordered by creation, so a group
    of any size stays spread over tasks.
    """
    rows = with_keys(contacts).filter(F.col(key).isNotNull()).select(ORG, F.col(key).alias("dup_key"), F.col("id").alias("contact_id"), "created_at")
    groups = rows.groupBy(ORG, "dup_key").agg(F.count("*").alias("dup_count"), F.min(F.struct("created_at", "contact_id"))["contact_id"].alias("first_contact_id"))
    return rows.join(groups.filter(F.col("dup_count") > 1), [ORG, "dup_key"]).orderBy(ORG, "dup_key", "created_at", "contact_id")


RICHNESS_COLUMNS = (
    "first_name", "last_name", "name", "email", "profile_url", "pipeline_stage", "location", "skills", "specialities", "assigned_to_user_id", "job_title", "lead_score", "research",
)


def soft_merge(contacts: DataFrame, measured: tuple[str, ...] = RICHNESS_COLUMNS) -> DataFrame:
    """Point duplicates at the richest row: first per URL, then per email among the rows left.

    Afterwards at most one row without a pointer exists per key. Richest: most filled columns,
    then oldest, then id.
    """
    filled = sum((F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in measured[1:]), F.when(F.col(measured[0]).isNotNull(), 1).otherwise(0))
    rows = with_keys(contacts).select(ORG, "id", "url_key", "email_key", "created_at", filled.alias("richness"))
    best = [F.desc("richness"), F.asc_nulls_last("created_at"), F.asc("id")]

    def winners(df: DataFrame, key: str) -> DataFrame:
        return first_per_key(df.filter(F.col(key).isNotNull()), [ORG, key], best).select(ORG, key, F.col("id").alias("winner"))

    by_url = rows.join(winners(rows, "url_key"), [ORG, "url_key"], "left").withColumn("url_owner", F.coalesce("winner", "id")).drop("winner")
    heads = by_url.filter(F.col("url_owner") == F.col("id"))
    by_email = heads.join(winners(heads, "email_key"), [ORG, "email_key"], "left").select(ORG, F.col("id").alias("url_owner"), F.coalesce("winner", "id").alias("owner"))
    merged = by_url.select(ORG, "id", "url_owner").join(by_email, [ORG, "url_owner"])
    return merged.select(ORG, "id", F.when(F.col("owner") != F.col("id"), F.col("owner")).alias("canonical_contact_id"))


def _phantom() -> Column:
    blank = lambda c: non_blank(F.col(c)).isNull()
    return blank("first_name") & blank("last_name") & blank("email") & blank("profile_url")


def flag_phantoms(contacts: DataFrame) -> DataFrame:
    """Contacts without name, email and URL get the rediscovery status."""
    return contacts.withColumn("processing_status", F.when(_phantom(), PHANTOM).otherwise(F.col("processing_status")))


def phantom_backup(contacts: DataFrame) -> DataFrame:
    """Snapshot rows of the contacts that `flag_phantoms` changes."""
    return contacts.filter(_phantom()).select("id", ORG, "processing_status", F.to_json(F.struct("*")).alias("contact_snapshot"))


def phantom_link_backup(links: DataFrame, contacts: DataFrame) -> DataFrame:
    ghosts = contacts.filter(_phantom()).select(ORG, F.col("id").alias("contact_id"))
    return links.join(ghosts, [ORG, "contact_id"], "left_semi").select("id", "contact_id", "company_id", ORG, F.to_json(F.struct("*")).alias("relationship_snapshot"))


def link_raw_records(raw: DataFrame, updates: DataFrame) -> DataFrame:
    """Set extracted company and person ids from bulk updates; the other rows stay."""
    new = updates.groupBy(ORG, F.col("record_id").alias("id")).agg(F.max("company_id").alias("_company"), F.max("person_id").alias("_person"))
    return (
        raw.join(new, [ORG, "id"], "left")
        .withColumns({"extracted_company_id": F.coalesce("_company", "extracted_company_id"), "extracted_person_id": F.coalesce("_person", "extracted_person_id")})
        .drop("_company", "_person")
    )


def list_members(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid members, rejected rows): exactly one of company and contact, each once per list."""
    one = F.col("company_id").isNotNull() != F.col("contact_id").isNotNull()
    valid = members.filter(one).groupBy(ORG, "list_id", "company_id", "contact_id").agg(F.min("created_at").alias("created_at"))
    return valid, members.filter(~one)
