"""Contact-to-deal projection, reconciliation and the effects of deal changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.dates import moment
from ledgerlark.functions.json import json_set
from ledgerlark.functions.stages import ACTIVE_DEAL_STAGES, deal_stage_level, stage_to_deal_stage
from ledgerlark.functions.text import non_blank
from ledgerlark.operators.cdc import differs, joined_states
from ledgerlark.operators.common import count_where, first_per_key, for_org

ORG = "organization_id"
CURRENCIES = ("USD", "EUR", "GBP")
OPEN_TASK_STATES = ("pending", "in_progress", "scheduled", "in_review")
NURTURE_TASKS = ("nurture_reminder", "linkedin_connect")
FLOOR_DAYS, IDLE_DAYS = 13, 14


def _staged(contacts: DataFrame) -> DataFrame:
    stage = stage_to_deal_stage(F.col("pipeline_stage"))
    return contacts.withColumn("deal_stage", stage).withColumn("level", deal_stage_level(F.col("deal_stage"))).withColumn(
        "seen_at", F.greatest("stage_updated_at", "last_incoming_email_at")
    )


def _is_active() -> Column:
    return F.col("deal_stage").isin(*ACTIVE_DEAL_STAGES)


def _open(deals: DataFrame) -> DataFrame:
    return deals.filter(F.col("closed_at").isNull())


def _newest_link(links: DataFrame, companies: DataFrame) -> DataFrame:
    """The company a contact counts for: its newest link to an existing company."""
    firms = companies.select(ORG, F.col("id").alias("company_id"), F.col("name").alias("company_name"), F.col("owner_user_id").alias("company_owner"))
    known = links.join(firms, [ORG, "company_id"])
    return first_per_key(known, [ORG, "contact_id"], [F.desc_nulls_last("created_at"), F.desc("id")]).select(
        ORG, "contact_id", "company_id", "company_name", "company_owner"
    )


def _member(owner: str, members: DataFrame, df: DataFrame) -> DataFrame:
    """Keep a user id only when it is a member of the workspace."""
    ids = members.select(ORG, F.col("user_id").alias(owner), F.lit(True).alias("_member")).distinct()
    return df.join(ids, [ORG, owner], "left").withColumn(owner, F.when(F.col("_member"), F.col(owner))).drop("_member")


def _single_campaign(campaign_companies: DataFrame, campaigns: DataFrame, members: DataFrame) -> DataFrame:
    """The campaign of a company when it has exactly one, with the campaign's owner if a member."""
    named = campaigns.select(ORG, F.col("id").alias("campaign_id"), F.col("user_id").alias("campaign_owner"))
    single = (
        campaign_companies.select(ORG, "company_id", "campaign_id")
        .join(named, [ORG, "campaign_id"])
        .groupBy(ORG, "company_id")
        .agg(F.min("campaign_id").alias("campaign"), F.max("campaign_id").alias("_last"), F.max("campaign_owner").alias("campaign_owner"))
        .filter(F.col("campaign") == F.col("_last"))
        .drop("_last")
    )
    return _member("campaign_owner", members, single)


ORDER = ("stage_updated_at", "created_at", "id")  # NULL sorts first inside a struct, as wanted


def _candidates(contacts, links, companies, members) -> DataFrame:
    """Active contacts with the company they count for (NULL when they have none)."""
    people = _staged(contacts).filter(_is_active())
    people = _member("assigned_to_user_id", members, people)
    newest = _newest_link(links, companies).withColumnRenamed("contact_id", "id")
    return people.join(newest, [ORG, "id"], "left")


def project(
    contacts, company_contacts, companies, campaigns, campaign_companies, settings, members, deals, as_of, org_id: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Project all active contacts onto the deals of their companies.

    Returns (deals, failures). A company without an open deal gets one from its first contact;
    stages only move up; owner and source campaign are only filled, never replaced. Contacts are
    reduced to one row per company before they meet the deals.
    """
    contacts, company_contacts, companies, campaigns, campaign_companies, members, deals = (
        for_org(d, org_id) for d in (contacts, company_contacts, companies, campaigns, campaign_companies, members, deals)
    )
    order = F.struct(*ORDER)
    people = _candidates(contacts, company_contacts, companies, members).filter(F.col("company_id").isNotNull())
    per_company = people.groupBy(ORG, "company_id").agg(
        F.min(F.struct(order.alias("order"), F.col("id").alias("contact"), "deal_stage", "seen_at")).alias("first"),
        F.min(F.struct((-F.col("level")).alias("down"), order.alias("order"), F.col("id").alias("contact"), "deal_stage", "level")).alias("top"),
        F.min(F.when(F.col("assigned_to_user_id").isNotNull(), F.struct(order.alias("order"), F.col("assigned_to_user_id").alias("owner")))).alias("assigned"),
        F.min(F.struct(order.alias("order"), F.col("assigned_to_user_id").alias("owner")))["owner"].alias("first_owner"),
        F.max("company_name").alias("company_name"),
        F.max("company_owner").alias("company_owner"),
    )
    per_company = _member("company_owner", members, per_company)
    per_company = per_company.join(_single_campaign(campaign_companies, campaigns, members), [ORG, "company_id"], "left")
    fallback = F.coalesce("company_owner", "campaign_owner")
    per_company = per_company.withColumn("new_owner", F.coalesce(F.col("first_owner"), fallback, F.col("assigned.owner"))).select(
        ORG, "company_id", "first", "top", "campaign", "company_name", "new_owner"
    )

    columns, now, nothing = deals.columns, moment(as_of), F.lit(None).cast("timestamp")
    currencies = settings.select(ORG, "default_deal_amount", F.coalesce("default_deal_currency", F.lit("USD")).alias("default_currency"))
    # open deals and companies meet once: a row with a deal grows it, a row without one is a new deal or a failure
    met = _open(deals).withColumn("_known", F.lit(True)).join(per_company, [ORG, "company_id"], "full_outer").join(currencies, ORG, "left")
    broken = (
        F.when(non_blank(F.col("company_name")).isNull(), "deal name is blank")
        .when(F.col("default_deal_amount") < 0, "amount is negative")
        .when(~F.col("default_currency").isin(*CURRENCIES), "currency is not allowed")
    )
    raised = F.coalesce(F.col("top.level") > deal_stage_level(F.col("stage")), F.lit(False))
    filled = F.col("owner_user_id").isNull() & F.col("new_owner").isNotNull()
    met = met.withColumn("default_currency", F.coalesce("default_currency", F.lit("USD"))).withColumns(
        {"_known": F.coalesce("_known", F.lit(False)), "_raised": raised, "_touched": raised | filled, "error_message": broken}
    )
    grown = {
        "stage": F.when(F.col("_raised"), F.col("top.deal_stage")).otherwise(F.col("stage")),
        "stage_contact_id": F.when(F.col("_raised"), F.col("top.contact")).otherwise(F.col("stage_contact_id")),
        "stage_updated_at": F.when(F.col("_raised"), now).otherwise(F.col("stage_updated_at")),
        "owner_user_id": F.coalesce("owner_user_id", "new_owner"),
        "source_campaign_id": F.when(F.col("_touched"), F.coalesce("source_campaign_id", "campaign")).otherwise(F.col("source_campaign_id")),
    }
    created = {
        "id": F.concat(F.lit("new:"), F.col("company_id")), "primary_contact_id": F.col("first.contact"), "stage_contact_id": F.col("top.contact"),
        "source_campaign_id": F.col("campaign"), "owner_user_id": F.col("new_owner"), "name": F.col("company_name"), "stage": F.col("top.deal_stage"),
        "amount": F.col("default_deal_amount").cast("decimal(14,2)"), "currency": F.col("default_currency"), "creation_source": F.lit("automatic"),
        "nurture_enabled": F.lit(True), "snoozed_until": nothing, "stage_updated_at": now, "last_activity_at": F.coalesce(F.col("first.seen_at"), now),
        "closed_at": nothing, "created_at": now,
    }
    either = lambda c: F.when(F.col("_known"), grown.get(c, F.col(c))).otherwise(created[c]).alias(c) if c in created else F.col(c)
    after = met.filter(F.col("_known") | F.col("error_message").isNull()).select(*[either(c) for c in columns])
    missing = per_company.join(_open(deals).select(ORG, "company_id"), [ORG, "company_id"], "left_anti").join(currencies, ORG, "left")
    missing = missing.withColumn("default_currency", F.coalesce("default_currency", F.lit("USD"))).withColumn("error_message", broken)
    failures = people.join(missing.filter(F.col("error_message").isNotNull()).select(ORG, "company_id", "error_message"), [ORG, "company_id"]).select(
        ORG, F.col("id").alias("contact_id"), F.col("pipeline_stage").alias("contact_stage"), "error_message"
    )
    closed = deals.filter(F.col("closed_at").isNotNull())
    return closed.unionByName(after), failures


def projection_failures(*args, **kwargs) -> DataFrame:
    """The failure ledger of `project`: contacts whose deal would break a rule. Sources are untouched."""
    return project(*args, **kwargs)[1]


def _best_contact(contacts: DataFrame, company_contacts: DataFrame) -> DataFrame:
    """The contact that should lead the company's deal: highest stage, latest contact, id."""
    people = _staged(contacts).filter(_is_active()).select(ORG, F.col("id").alias("contact_id"), "level", "seen_at")
    linked = company_contacts.select(ORG, "contact_id", "company_id").join(people, [ORG, "contact_id"])
    return first_per_key(linked, [ORG, "company_id"], [F.desc("level"), F.desc_nulls_last("seen_at"), F.asc("contact_id")]).select(
        ORG, "company_id", F.col("contact_id").alias("best_contact"), F.col("level").alias("best_level")
    )


def close_lost(contacts, company_contacts, companies, deals, as_of) -> DataFrame:
    """Lost contacts close their company's open deal unless another contact is active; then a lost
    primary contact hands over to the best active one."""
    lost = _staged(contacts).filter(F.col("deal_stage") == "LOST")
    newest = _newest_link(company_contacts, companies).withColumnRenamed("contact_id", "id")
    lost = lost.join(newest, [ORG, "id"])
    first_lost = lost.groupBy(ORG, "company_id").agg(F.min(F.struct(*ORDER))["id"].alias("lost_contact"))
    lost_primary = lost.select(ORG, "company_id", F.col("id").alias("primary_contact_id"), F.lit(True).alias("primary_lost"))
    now = moment(as_of)
    rows = (
        _open(deals)
        .join(first_lost, [ORG, "company_id"], "left")
        .join(lost_primary, [ORG, "company_id", "primary_contact_id"], "left")
        .join(_best_contact(contacts, company_contacts), [ORG, "company_id"], "left")
    )
    closes = F.col("lost_contact").isNotNull() & F.col("best_contact").isNull()
    hands_over = F.col("primary_lost").eqNullSafe(True) & F.col("best_contact").isNotNull()
    rows = rows.withColumn("_closes", closes).withColumns(
        {
            "primary_contact_id": F.when(hands_over, F.col("best_contact")).otherwise(F.col("primary_contact_id")),
            "stage_contact_id": F.when(closes, F.col("lost_contact")).otherwise(F.col("stage_contact_id")),
            "stage": F.when(closes, "LOST").otherwise(F.col("stage")),
            "stage_updated_at": F.when(closes, now).otherwise(F.col("stage_updated_at")),
            "closed_at": F.when(closes, now).otherwise(F.col("closed_at")),
        }
    )
    return deals.filter(F.col("closed_at").isNotNull()).unionByName(rows.select(*deals.columns))


def reconcile(
    contacts, company_contacts, companies, campaigns, campaign_companies, settings, members, deals, as_of, org_id: str | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Project, floor the activity clock of open automatic deals, re-pick the primary contact.

    Returns (deals, failures, counters). Nothing is written: a dry run is `readiness` on the input
    and on the returned deals.
    """
    projected, failures = project(contacts, company_contacts, companies, campaigns, campaign_companies, settings, members, deals, as_of, org_id)
    contacts, company_contacts, companies, members = (for_org(d, org_id) for d in (contacts, company_contacts, companies, members))
    is_open = F.col("closed_at").isNull()
    floor = moment(as_of) - F.expr(f"INTERVAL {FLOOR_DAYS} DAY")
    floored = is_open & (F.col("creation_source") == "automatic")
    best = _best_contact(contacts, company_contacts).drop("best_level")
    deals_out = (
        projected.join(best, [ORG, "company_id"], "left")
        .withColumns(
            {
                "last_activity_at": F.when(floored, F.greatest(F.col("last_activity_at"), floor)).otherwise(F.col("last_activity_at")),
                "primary_contact_id": F.when(is_open, F.coalesce("best_contact", "primary_contact_id")).otherwise(F.col("primary_contact_id")),
            }
        )
        .select(*projected.columns)
    )
    linked = _newest_link(company_contacts, companies).select(ORG, F.col("contact_id").alias("id"), F.lit(True).alias("_linked"))
    tried = _staged(contacts).filter(_is_active()).select(ORG, "id").join(linked, [ORG, "id"], "left")
    tried = tried.join(failures.select(ORG, F.col("contact_id").alias("id"), F.lit(True).alias("_failed")), [ORG, "id"], "left")
    ok = F.col("_linked").isNotNull() & F.col("_failed").isNull()
    counters = tried.groupBy(ORG).agg(
        count_where(ok).alias("projected"), count_where(F.col("_linked").isNull()).alias("skipped"), count_where(F.col("_failed").isNotNull()).alias("failed")
    )
    clock = projected.filter(floored).groupBy(ORG).agg(F.count("*").alias("activity_clock_floored"))
    return deals_out, failures, counters.join(clock, ORG, "full_outer").fillna(0)


def readiness(organizations, settings, contacts, company_contacts, deals, failures, org_id: str | None = None) -> DataFrame:
    """Eight counts and the ready flag per workspace."""
    contacts, company_contacts, deals, failures = (for_org(d, org_id) for d in (contacts, company_contacts, deals, failures))
    people = _staged(contacts).filter(_is_active()).select(ORG, F.col("id").alias("contact_id"))
    eligible = people.join(company_contacts.select(ORG, "contact_id"), [ORG, "contact_id"]).groupBy(ORG).agg(F.count("*").alias("eligible_contact_count"))
    best = _best_contact(contacts, company_contacts)
    opened = _open(deals).select(ORG, "company_id", F.col("id").alias("deal_id"), "primary_contact_id", deal_stage_level(F.col("stage")).alias("deal_level"))
    has_deal = F.col("deal_id").isNotNull()
    expected = (
        best.join(opened, [ORG, "company_id"], "left")
        .groupBy(ORG)
        .agg(
            F.countDistinct("company_id").alias("eligible_company_count"),
            count_where(~has_deal).alias("missing_deal_count"),
            count_where(has_deal & (F.col("deal_level") < F.col("best_level"))).alias("lagging_stage_count"),
            count_where(has_deal & ~F.col("primary_contact_id").eqNullSafe(F.col("best_contact"))).alias("primary_contact_mismatch_count"),
        )
    )
    per_company = opened.groupBy(ORG, "company_id").agg(F.count("*").alias("n"))
    existing = per_company.groupBy(ORG).agg(F.sum("n").alias("existing_open_deal_count"), count_where(F.col("n") > 1).alias("duplicate_open_deal_count"))
    unresolved = failures.filter(F.col("resolved_at").isNull()).groupBy(ORG).agg(F.count("*").alias("unresolved_projection_failure_count"))
    out = organizations.select(F.col("id").alias(ORG))
    out = for_org(out, org_id).join(settings.select(ORG, F.lit(True).alias("organization_settings_present")).distinct(), ORG, "left")
    for side in (eligible, expected, existing, unresolved):
        out = out.join(side, ORG, "left")
    out = out.fillna(0).fillna(False)
    gates = ("missing_deal_count", "lagging_stage_count", "primary_contact_mismatch_count", "duplicate_open_deal_count", "unresolved_projection_failure_count")
    ready = F.lit(True)
    for g in gates:
        ready = ready & (F.col(g) == 0)
    return out.withColumn("ready_for_flag_enablement", ready)


def resolve_failures(failures, contacts, company_contacts, deals, as_of) -> DataFrame:
    """Stamp failures that the current state no longer shows: a lost contact, or a linked open deal at its level."""
    reach = (
        company_contacts.select(ORG, "contact_id", "company_id")
        .join(_open(deals).select(ORG, "company_id", deal_stage_level(F.col("stage")).alias("deal_level")), [ORG, "company_id"])
        .groupBy(ORG, "contact_id")
        .agg(F.max("deal_level").alias("deal_level"))
    )
    people = _staged(contacts).select(ORG, F.col("id").alias("contact_id"), "deal_stage", "level")
    fixed = F.coalesce((F.col("deal_stage") == "LOST") | (F.col("deal_level") >= F.col("level")), F.lit(False))
    return (
        failures.join(people, [ORG, "contact_id"], "left")
        .join(reach, [ORG, "contact_id"], "left")
        .withColumn("resolved_at", F.when(F.col("resolved_at").isNull() & fixed, moment(as_of)).otherwise(F.col("resolved_at")))
        .drop("deal_stage", "level", "deal_level")
    )


# ---- effects of deal changes --------------------------------------------------------------

DEAL_COLUMNS = [
    "primary_contact_id", "stage_contact_id", "owner_user_id", "name", "stage", "amount", "currency", "creation_source", "nurture_enabled", "snoozed_until", "closed_at", "created_at",
]


def _changes(old: DataFrame, new: DataFrame) -> DataFrame:
    return joined_states(old, new, [ORG, "id"], DEAL_COLUMNS).filter(F.col("new").isNotNull())


def _json(**entries: Column) -> Column:
    return F.to_json(F.struct(*(v.alias(k) for k, v in entries.items())), {"ignoreNullFields": "false"})


def _pair(column: str) -> dict[str, Column]:
    return {"from": F.col(f"old.{column}"), "to": F.col(f"new.{column}")}


def audit(old: DataFrame, new: DataFrame, actor: str = "system", actor_user_id: str | None = None) -> DataFrame:
    """Activity rows for new deals and for each kind of change."""
    created, updated = F.col("old").isNull(), F.col("old").isNotNull()
    stage_contact = F.lit(None).cast("string") if actor == "user" else F.col("new.stage_contact_id")
    none = F.lit(None).cast("string")
    snooze_title = F.when(F.col("new.snoozed_until").isNull(), "Deal snooze cleared").otherwise("Deal snoozed")
    value = {f"{side}_{c}": F.col(f"{'old' if side == 'from' else 'new'}.{c}") for c in ("amount", "currency") for side in ("from", "to")}
    rules = [
        (created, "deal_created", F.lit("Deal created"), _json(stage=F.col("new.stage"), creation_source=F.col("new.creation_source")), False, F.col("new.primary_contact_id")),
        (updated & differs("stage"), "stage_change", F.lit("Deal stage changed"), _json(**_pair("stage")), True, stage_contact),
        (updated & (differs("amount") | differs("currency")), "amount_change", F.lit("Deal value changed"), _json(**value), False, none),
        (updated & differs("owner_user_id"), "owner_change", F.lit("Deal owner changed"), _json(**_pair("owner_user_id")), False, none),
        (updated & differs("nurture_enabled"), "nurture_change", F.lit("Deal nurture setting changed"), _json(enabled=F.col("new.nurture_enabled")), False, none),
        (updated & differs("snoozed_until"), "snooze_change", snooze_title, _json(**_pair("snoozed_until")), False, none),
    ]
    rows = [
        F.when(
            cond,
            F.struct(
                F.lit(kind).alias("activity_type"), title.alias("title"), meta.alias("metadata"), F.lit(bumps).alias("bumps_last_activity"), contact.alias("contact_id")
            ),
        )
        for cond, kind, title, meta, bumps, contact in rules
    ]
    return (
        _changes(old, new)
        .select(F.col("id").alias("deal_id"), ORG, F.explode(F.array_compact(F.array(*rows))).alias("a"))
        .select("deal_id", ORG, "a.*", F.lit(actor).alias("actor"), F.lit(actor_user_id if actor == "user" else None).cast("string").alias("actor_user_id"))
    )


CONTACT_ACTIVITIES = ("email_in", "email_out", "linkedin_in", "linkedin_out")


def attach_activity(events, deals, company_contacts, activities) -> tuple[DataFrame, DataFrame]:
    """Contact events -> activities of the best open deal of the contact.

    Returns (new activities, conflicts). An event key is stored once per workspace; the same key
    for another deal, contact or type is a conflict.
    """
    key = F.trim("source_event_key")
    bad_type = F.raise_error(F.lit("unsupported activity type")).cast("string")
    bad_key = F.raise_error(F.lit("a stable source event key is required")).cast("string")
    rows = events.withColumns(
        {
            "activity_type": F.when(F.col("activity_type").isin(*CONTACT_ACTIVITIES), F.col("activity_type")).otherwise(bad_type),
            "source_event_key": F.when(key != "", key).otherwise(bad_key),
            "title": F.coalesce(non_blank(F.trim("title")), F.lit("Deal activity")),
            "actor_user_id": F.when(F.col("actor") == "user", F.col("actor_user_id")),
        }
    )
    opened = _open(deals).select(ORG, "company_id", F.col("id").alias("deal_id"), "primary_contact_id", "stage_updated_at")
    choice = company_contacts.select(ORG, "contact_id", "company_id").distinct().join(opened, [ORG, "company_id"])
    is_primary = F.coalesce(F.col("primary_contact_id") == F.col("contact_id"), F.lit(False))
    best = first_per_key(choice, [ORG, "contact_id"], [F.desc(is_primary), F.desc("stage_updated_at"), F.asc("deal_id")]).select(ORG, "contact_id", "deal_id")
    placed = rows.join(best, [ORG, "contact_id"])
    first = first_per_key(placed, [ORG, "source_event_key"], [F.asc("occurred_at"), F.asc("contact_id"), F.asc("activity_type")])
    stored = activities.filter(F.col("source_event_key").isNotNull()).select(ORG, "source_event_key")
    fresh = first.join(stored, [ORG, "source_event_key"], "left_anti").select(
        "deal_id", ORG, "activity_type", "actor", "actor_user_id", "contact_id", "title", F.lit(True).alias("bumps_last_activity"),
        "source_event_key", F.col("occurred_at").alias("created_at"),
    )
    owner = first.select(
        ORG, "source_event_key", F.col("deal_id").alias("first_deal"), F.col("contact_id").alias("first_contact"), F.col("activity_type").alias("first_type")
    )
    other = (F.col("deal_id") != F.col("first_deal")) | (F.col("contact_id") != F.col("first_contact")) | (F.col("activity_type") != F.col("first_type"))
    return fresh, placed.join(owner, [ORG, "source_event_key"]).filter(other)


def last_activity(deals: DataFrame, activities: DataFrame) -> DataFrame:
    """Raise a deal's activity clock to its latest bumping activity."""
    bumps = activities.filter(F.col("bumps_last_activity")).groupBy(ORG, F.col("deal_id").alias("id")).agg(F.max("created_at").alias("_latest"))
    return deals.join(bumps, [ORG, "id"], "left").withColumn("last_activity_at", F.greatest("last_activity_at", "_latest")).drop("_latest")


def task_effects(old: DataFrame, new: DataFrame, tasks: DataFrame) -> DataFrame:
    """Tasks after deal edits: a new owner takes the open tasks, a closed deal cancels its nurture tasks."""
    edits = _changes(old, new).filter(F.col("old").isNotNull()).select(
        ORG, F.col("id").alias("deal_id"), differs("owner_user_id").alias("_reassign"), F.col("new.owner_user_id").alias("_owner"),
        (F.col("new.closed_at").isNotNull() & F.col("old.closed_at").isNull()).alias("_closes"), F.col("new.stage").alias("_stage"),
    )
    is_open = F.col("status").isin(*OPEN_TASK_STATES)
    takes = is_open & F.coalesce("_reassign", F.lit(False))
    stops = is_open & F.coalesce("_closes", F.lit(False)) & F.col("task_type").isin(*NURTURE_TASKS, "manual_outreach")
    note = json_set(F.col("metadata"), {"cancelled_reason": F.lit("deal_closed"), "deal_stage": F.col("_stage")})
    return (
        tasks.join(edits, [ORG, "deal_id"], "left")
        .withColumns({"_takes": takes, "_stops": stops})
        .withColumns(
            {
                "assigned_to_user_id": F.when(F.col("_takes"), F.col("_owner")).otherwise(F.col("assigned_to_user_id")),
                "status": F.when(F.col("_stops"), "cancelled").otherwise(F.col("status")),
                "metadata": F.when(F.col("_stops"), note).otherwise(F.col("metadata")),
            }
        )
        .drop("_reassign", "_owner", "_closes", "_stage", "_takes", "_stops")
    )


def notifications(old: DataFrame, new: DataFrame, settings: DataFrame, actor: str = "system") -> DataFrame:
    """Notices to deal owners of workspaces with the pipeline on, once per user and dedup key."""
    owner, deal = F.col("new.owner_user_id"), F.col("id")
    created, updated, owned = F.col("old").isNull(), F.col("old").isNotNull(), F.col("new.owner_user_id").isNotNull()
    name = F.col("new.name")
    stage_text = F.initcap(F.replace(F.lower("new.stage"), F.lit("_"), F.lit(" ")))
    notice = lambda cond, kind, title, body, dedup: F.when(
        cond, F.struct(F.lit(kind).alias("type"), title.alias("title"), body.alias("body"), dedup.alias("dedup_key"))
    )
    found = [
        notice(created & owned, "deal_created", F.concat(F.lit("New deal: "), name), F.concat(F.lit("A deal entered the "), stage_text, F.lit(" stage.")), F.concat(F.lit("deal_created:"), deal)),
        notice(
            updated & owned & differs("owner_user_id"), "deal_owner_changed", F.concat(F.lit("Deal assigned: "), name),
            F.lit("You are now responsible for this deal and its open tasks."), F.concat(F.lit("deal_owner:"), deal, F.lit(":"), owner),
        ),
    ]
    if actor == "system":
        found.append(
            notice(
                updated & owned & differs("stage"), "deal_stage_changed", F.concat(F.lit("Deal advanced: "), name),
                F.concat(F.lit("The deal moved to "), stage_text, F.lit(".")), F.concat(F.lit("deal_stage:"), deal, F.lit(":"), F.col("new.stage")),
            )
        )
    enabled = settings.filter(F.col("crm_pipeline_enabled").eqNullSafe(True)).select(ORG)
    rows = _changes(old, new).join(enabled, ORG, "left_semi")
    rows = rows.select(ORG, owner.alias("user_id"), F.col("id").alias("entity_id"), F.explode(F.array_compact(F.array(*found))).alias("n")).select(ORG, "user_id", "entity_id", "n.*")
    return rows.dropDuplicates(["user_id", "dedup_key"])


def nurture_due(deals: DataFrame, tasks: DataFrame, settings: DataFrame, as_of, idle_days: int = IDLE_DAYS) -> DataFrame:
    """Open deals to nurture: idle long enough, not snoozed, no open nurture task, automation on."""
    now = moment(as_of)
    busy = tasks.filter(F.col("task_type").isin(*NURTURE_TASKS) & F.col("status").isin(*OPEN_TASK_STATES) & F.col("deal_id").isNotNull())
    automated = settings.filter(F.col("crm_automation_enabled").eqNullSafe(True)).select(ORG)
    return (
        _open(deals)
        .filter(F.col("nurture_enabled") & (F.col("snoozed_until").isNull() | (F.col("snoozed_until") <= now)))
        .filter(F.col("last_activity_at") <= now - F.expr(f"INTERVAL {int(idle_days)} DAY"))
        .join(automated, ORG, "left_semi")
        .join(busy.select(ORG, F.col("deal_id").alias("id")), [ORG, "id"], "left_anti")
    )


def task_activities(old_tasks: DataFrame, new_tasks: DataFrame, users: DataFrame, as_of) -> DataFrame:
    """Activity rows for tasks made for a deal and for their first completion."""
    columns = ["deal_id", "contact_id", "task_type", "status", "metadata", "created_by_user_id", "completed_by_user_id", "due_date", "completed_at", "created_at"]
    rows = joined_states(old_tasks, new_tasks, [ORG, "id"], columns).filter(F.col("new.deal_id").isNotNull())
    made = F.col("old").isNull()
    done = F.col("old").isNotNull() & (F.col("new.status") == "completed") & differs("status")
    rows = rows.filter(made | done).withColumn("user_id", F.when(made, F.col("new.created_by_user_id")).otherwise(F.col("new.completed_by_user_id")))
    known = users.select("user_id", F.lit(True).alias("_known")).distinct()
    channel = F.get_json_object("new.metadata", "$.channel")
    now = moment(as_of)
    return rows.join(known, "user_id", "left").select(
        F.col("new.deal_id").alias("deal_id"), ORG,
        F.when(made, "task_created").otherwise("task_completed").alias("activity_type"),
        F.when(~made | F.col("_known"), "user").otherwise("system").alias("actor"),
        F.when(F.col("_known"), F.col("user_id")).alias("actor_user_id"),
        F.col("new.contact_id").alias("contact_id"),
        F.when(made, "Deal task created").otherwise("Deal task completed").alias("title"),
        F.when(made, _json(task_id=F.col("id"), task_type=F.col("new.task_type"), channel=channel, due_date=F.col("new.due_date").cast("string")))
        .otherwise(_json(task_id=F.col("id"), task_type=F.col("new.task_type"), channel=channel)).alias("metadata"),
        (~made).alias("bumps_last_activity"),
        F.concat(F.when(made, "task_created:").otherwise("task_completed:"), F.col("id")).alias("source_event_key"),
        F.when(made, F.col("new.created_at")).otherwise(F.least(F.coalesce("new.completed_at", now), now)).alias("created_at"),
    )


def stamp_stage(old: DataFrame, new: DataFrame, as_of) -> DataFrame:
    """A stage change sets the stage time; WON or LOST sets the closing time, other stages clear it."""
    now = moment(as_of)
    before = old.select(ORG, "id", F.col("stage").alias("_old_stage"), F.lit(True).alias("_had"))
    moved = F.coalesce(F.col("_had"), F.lit(False)) & ~F.col("stage").eqNullSafe(F.col("_old_stage"))
    return new.join(before, [ORG, "id"], "left").withColumn("_moved", moved).withColumns(
        {
            "stage_updated_at": F.when(F.col("_moved"), now).otherwise(F.col("stage_updated_at")),
            "closed_at": F.when(F.col("_moved"), F.when(F.col("stage").isin("WON", "LOST"), now)).otherwise(F.col("closed_at")),
        }
    ).drop("_old_stage", "_had", "_moved")


def scope_violations(deals: DataFrame, company_contacts: DataFrame, activities: DataFrame) -> DataFrame:
    """Activities whose deal is not of their workspace, or whose contact is not linked to the deal's company."""
    owned = deals.select(ORG, F.col("id").alias("deal_id"), "company_id")
    rows = activities.join(owned, [ORG, "deal_id"], "left")
    links = company_contacts.select(ORG, "company_id", "contact_id", F.lit(True).alias("_linked")).distinct()
    rows = rows.join(links, [ORG, "company_id", "contact_id"], "left")
    reason = F.when(F.col("company_id").isNull(), "deal of another workspace").when(F.col("contact_id").isNotNull() & F.col("_linked").isNull(), "contact not linked")
    return rows.withColumn("violation", reason).filter(F.col("violation").isNotNull()).drop("_linked", "company_id")
