"""Campaign metrics, links and activity rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.json import json_remove
from ledgerlark.functions.text import choose
from ledgerlark.operators.common import count_where, first_per_key, percent

SENT_STATES = ("sent", "delivered", "opened", "clicked", "replied")
REACHED_STATES = SENT_STATES + ("bounced",)


def metrics(emails: DataFrame, activities: DataFrame) -> DataFrame:
    """Counters per campaign, recomputed from the emails and the booked meetings."""
    status = F.col("status")
    sent = emails.filter(F.col("campaign_id").isNotNull()).groupBy("organization_id", "campaign_id").agg(
        count_where(status.isin(*SENT_STATES)).alias("emails_sent"),
        count_where(status.isin(*SENT_STATES[1:])).alias("emails_delivered"),
        F.count("opened_at").alias("emails_opened"),
        F.count("replied_at").alias("emails_replied"),
        count_where(status == "bounced").alias("emails_bounced"),
    )
    booked = activities.filter(F.col("activity_type") == "meeting_booked").groupBy("organization_id", "campaign_id").agg(F.count("*").alias("meetings_booked"))
    return sent.join(booked, ["organization_id", "campaign_id"], "left").fillna(0, ["meetings_booked"])


def summary(counters: DataFrame) -> DataFrame:
    """Open, reply and meeting rate in percent of sent emails."""
    sent = F.col("emails_sent")
    return counters.withColumns(
        {
            "open_rate": percent(F.col("emails_opened"), sent),
            "reply_rate": percent(F.col("emails_replied"), sent),
            "meeting_rate": percent(F.col("meetings_booked"), sent),
        }
    )


def reach(emails: DataFrame) -> DataFrame:
    """Distinct contacts reached and distinct contacts that replied, per campaign."""
    contact, status = F.col("contact_id"), F.col("status")
    return emails.filter(F.col("campaign_id").isNotNull()).groupBy("organization_id", "campaign_id").agg(
        F.countDistinct(F.when(status.isin(*REACHED_STATES), contact)).alias("contacts_reached"),
        F.countDistinct(F.when(status == "replied", contact)).alias("contacts_replied"),
    )


def totals(campaigns: DataFrame, campaign_companies: DataFrame, campaign_contacts: DataFrame) -> DataFrame:
    """Distinct companies and active contacts of every campaign, zeros included."""
    key = ["organization_id", "campaign_id"]
    firms = campaign_companies.groupBy(*key).agg(F.countDistinct("company_id").alias("total_companies"))
    people = campaign_contacts.filter(F.col("status") == "active").groupBy(*key).agg(F.count("*").alias("total_contacts"))
    base = campaigns.select("organization_id", F.col("id").alias("campaign_id"))
    return base.join(firms, key, "left").join(people, key, "left").fillna(0)


# fixed values: activity kind, title and wording per new status
ACTIVITY_KIND = {"sent": "email_sent", "delivered": "email_sent", "opened": "email_sent", "replied": "email_received", "bounced": "email_sent"}
ACTIVITY_TITLE = {
    "sent": "Campaign email sent",
    "delivered": "Email delivered",
    "opened": "Email opened",
    "replied": "Received reply to campaign email",
    "bounced": "Email bounced",
}
ACTIVITY_TEXT = {
    "sent": ('Email "', '" sent successfully', "Campaign email sent"),
    "delivered": ('Email "', '" was delivered', "Campaign email delivered"),
    "opened": ('Email "', '" was opened by recipient', "Campaign email opened"),
    "replied": ('Reply received for email "', '"', "Reply received to campaign email"),
    "bounced": ('Email "', '" bounced', "Campaign email bounced"),
}


def email_status_activities(changes: DataFrame) -> DataFrame:
    """Status changes of campaign emails -> activity rows. `old_status` is NULL for a new email."""
    status, subject = F.col("status"), F.col("subject")
    nothing = F.lit(None).cast("string")
    text: Column = nothing
    at: Column = F.lit(None).cast("timestamp")
    for state, (before, after, plain) in ACTIVITY_TEXT.items():
        text = F.when(status == state, F.coalesce(F.concat(F.lit(before), subject, F.lit(after)), F.lit(plain))).otherwise(text)
        at = F.when(status == state, F.col(f"{state}_at")).otherwise(at)
    details = F.to_json(
        F.struct(
            F.col("id").alias("campaign_email_id"), "campaign_id", status.alias("email_status"), "subject", "message_id", "thread_id"
        ),
        {"ignoreNullFields": "false"},
    )
    changed = F.col("old_status").isNull() | (F.col("old_status") != status)
    return changes.filter(changed & status.isin(*ACTIVITY_KIND)).select(
        "organization_id", "contact_id", F.col("id").alias("campaign_email_id"),
        choose(status, ACTIVITY_KIND, nothing).alias("activity_type"),
        choose(status, ACTIVITY_TITLE, nothing).alias("title"),
        text.alias("description"), details.alias("metadata"), at.alias("occurred_at"),
    )


CURATED = "array<struct<id: string, selected: boolean>>"


def selected_companies(campaigns: DataFrame) -> DataFrame:
    """Ids marked `selected: true` in the curated JSON array."""
    chosen = F.filter(F.from_json("curated_companies", CURATED), lambda c: c["selected"].eqNullSafe(True))
    return campaigns.withColumn("selected_company_ids", F.transform(chosen, lambda c: c["id"]))


def select_all_curated(companies_json: Column) -> Column:
    """Mark every company of a curated JSON array as selected; all other entries keep their types."""
    entries = F.try_variant_get(F.try_parse_json(companies_json), "$", "array<map<string,variant>>")
    yes = F.create_map(F.lit("selected"), F.lit(True).cast("variant"))
    return F.to_json(F.transform(entries, lambda m: F.map_concat(F.map_filter(m, lambda k, _: k != "selected"), yes)))


def link_contacts(contacts: DataFrame, emails: DataFrame, links: DataFrame) -> DataFrame:
    """Campaign-contact pairs named by contacts or emails that are not linked yet."""
    key = ["organization_id", "campaign_id", "contact_id"]
    named = contacts.filter(F.col("campaign_id").isNotNull()).select(
        "organization_id", "campaign_id", F.col("id").alias("contact_id"), F.col("created_at").alias("added_at")
    )
    mailed = emails.filter(F.col("campaign_id").isNotNull() & F.col("contact_id").isNotNull()).select(
        "organization_id", "campaign_id", "contact_id", F.col("created_at").alias("added_at")
    )
    pairs = named.unionByName(mailed).groupBy(*key).agg(F.min("added_at").alias("added_at"))
    fixed = {"source_type": F.lit("manual"), "created_from_campaign": F.lit(False), "status": F.lit("active")}
    return pairs.join(links.select(*key), key, "left_anti").withColumns(fixed)


def attribute_actions(log: DataFrame, tasks: DataFrame, actions: DataFrame, journeys: DataFrame) -> DataFrame:
    """Fill the missing campaign of logged actions through task -> sequence action -> journey."""
    org = "organization_id"
    known = tasks.select(org, F.col("id").alias("task_id"))
    by_task = (
        actions.select(org, F.col("review_task_id").alias("task_id"), "campaign_contact_id")
        .join(journeys.select(org, F.col("id").alias("campaign_contact_id"), F.col("campaign_id").alias("found_campaign")), [org, "campaign_contact_id"])
        .groupBy(org, "task_id")
        .agg(F.min("found_campaign").alias("found_campaign"))
        .join(known, [org, "task_id"], "left_semi")
    )
    rows = log.withColumn("task_id", F.when(F.col("campaign_id").isNull(), F.get_json_object("payload", "$.task_id")))
    return rows.join(by_task, [org, "task_id"], "left").withColumn("campaign_id", F.coalesce("campaign_id", "found_campaign")).drop("found_campaign", "task_id")


def company_status(links: DataFrame, companies: DataFrame) -> DataFrame:
    """Link status from the company's processing status."""
    state = F.col("processing_status")
    firms = companies.select("organization_id", F.col("id").alias("company_id"), "processing_status", F.lit(True).alias("_known"))
    mapped = F.when(state == "approved", "approved").when(state == "declined", "rejected").otherwise("pending")
    return (
        links.join(firms, ["organization_id", "company_id"], "left")
        .withColumn("status", F.when(F.col("_known"), mapped).otherwise(F.col("status")))
        .drop("processing_status", "_known")
    )


def for_contact(links: DataFrame, campaigns: DataFrame, contact_id: str | None = None) -> DataFrame:
    """Campaigns of contacts, newest link first."""
    rows = links if contact_id is None else links.filter(F.col("contact_id") == contact_id)
    names = campaigns.select("organization_id", F.col("id").alias("campaign_id"), F.col("name").alias("campaign_name"), F.col("status").alias("campaign_status"))
    return rows.withColumnRenamed("status", "relationship_status").join(names, ["organization_id", "campaign_id"]).select(
        "organization_id", "contact_id", "campaign_id", "campaign_name", "campaign_status", "added_at", "source_type", "relationship_status"
    ).orderBy("contact_id", F.desc_nulls_first("added_at"))


def contacts_of(links: DataFrame, contacts: DataFrame, campaign_id: str | None = None) -> DataFrame:
    """Contacts of campaigns, newest link first."""
    rows = links if campaign_id is None else links.filter(F.col("campaign_id") == campaign_id)
    people = contacts.select(
        "organization_id", F.col("id").alias("contact_id"), F.col("name").alias("contact_name"), F.col("email").alias("contact_email"), "job_title"
    )
    return rows.withColumnRenamed("status", "relationship_status").join(people, ["organization_id", "contact_id"]).select(
        "organization_id", "campaign_id", "contact_id", "contact_name", "contact_email", "job_title", "added_at", "source_type", "relationship_status"
    ).orderBy("campaign_id", F.desc_nulls_first("added_at"))


# fixed values: statuses and steps of a finished wizard
STARTED = ("active", "paused", "completed")
WIZARD_STEPS = ("campaign-details", "icp-settings", "lead-source", "curate-leads", "review-launch")


def normalize(campaigns: DataFrame) -> DataFrame:
    """Wizard flag, start time (launch time in the metadata, else the creation), defaults for missing values."""
    status = F.col("status")
    steps = F.from_json(F.get_json_object("metadata", "$.completed_steps"), "array<string>")
    all_done = (status == "draft") & (F.size(F.array_intersect(steps, F.array(*(F.lit(s) for s in WIZARD_STEPS)))) == len(WIZARD_STEPS))
    done = F.coalesce(status.isin(*STARTED, "cancelled") | all_done, F.lit(False))
    launched = F.get_json_object("metadata", "$.launched_at")
    started = F.when(F.col("started_at").isNull() & status.isin(*STARTED), F.coalesce(launched.try_cast("timestamp"), F.col("created_at"))).otherwise(F.col("started_at"))
    return campaigns.withColumns(
        {
            "wizard_completed": F.when(done, True).otherwise(F.col("wizard_completed")),
            "started_at": started,
            "metadata": F.when(launched.isNotNull(), json_remove(F.col("metadata"), ["launched_at"])).otherwise(F.coalesce("metadata", F.lit("{}"))),
            "emails_sent": F.coalesce("emails_sent", F.lit(0)),
        }
    )


def latest_link(links: DataFrame, key: list[str]) -> DataFrame:
    """Newest link per key; a link without a time counts as oldest."""
    return first_per_key(links, key, [F.desc_nulls_last("created_at"), F.desc("company_id")])
