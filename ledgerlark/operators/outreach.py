"""Who may be contacted next: follow-ups, queues, exclusions and company matching."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.dates import moment
from ledgerlark.functions.json import json_set
from ledgerlark.functions.text import non_blank, non_empty
from ledgerlark.operators.common import count_where, for_org, stored
from ledgerlark.operators.components import components

ORG = "organization_id"


def _draft_counts(tasks: DataFrame) -> DataFrame:
    status = F.col("status")
    drafts = tasks.filter(F.col("task_type") == "review_draft")
    return drafts.groupBy(ORG, "campaign_id", "contact_id").agg(
        count_where((status == "completed") & F.col("sent_at").isNotNull()).alias("sent_email_count"),
        count_where(status.isin("pending", "in_review")).alias("pending_tasks"),
        count_where(status.isin("rejected", "cancelled")).alias("declined_tasks"),
        F.count("*").alias("total_tasks"),
        F.max("sent_at").alias("last_sent_at"),
    )


def _hours_since(last: Column, as_of) -> Column:
    micros = (F.unix_micros(moment(as_of)) - F.unix_micros(last)).cast("decimal(20,0)")
    return F.round(micros / F.lit(3_600_000_000).cast("decimal(10,0)"), 1).cast("decimal(20,1)")


def _rules(as_of, max_emails: int, min_hours: int) -> dict[str, tuple[Column, str]]:
    """Rule name -> (passes, text when it fails)."""
    last, incoming = F.col("last_sent_at"), F.col("last_incoming_email_at")
    sent = F.col("sent_email_count")
    off = lambda c: ~F.col(c).eqNullSafe(True)
    yes = lambda c: F.coalesce(c, F.lit(False))
    return {
        "campaign_active": (yes(F.col("campaign_status") == "active"), "campaign not active"),
        "prospect": (yes(F.col("pipeline_stage") == "PROSPECT"), "not PROSPECT"),
        "unsubscribed": (F.col("unsubscribed_at").isNull(), "unsubscribed"),
        "stop_drafts": (off("stop_drafts"), "stop_drafts=true"),
        "do_not_contact": (off("do_not_contact"), "do_not_contact"),
        "has_thread": (non_empty(F.col("last_thread_id")).isNotNull(), "no thread id"),
        "has_sent": (sent > 0, "no emails sent"),
        "under_max": (sent < max_emails, "max emails reached"),
        "no_pending": (F.col("pending_tasks") == 0, "has pending tasks"),
        "no_declined": (F.col("declined_tasks") == 0, "has declined tasks"),
        "time_elapsed": (yes(last < moment(as_of) - F.expr(f"INTERVAL {int(min_hours)} HOUR")), f"too recent (<{int(min_hours)}h)"),
        "no_reply": (incoming.isNull() | yes(incoming <= last), "contact replied"),
    }


def _draft_scope(tasks, contacts, campaigns, org_id) -> DataFrame:
    """Draft counts per workspace, campaign and contact, with the campaign and contact state."""
    live = campaigns.select(ORG, F.col("id").alias("campaign_id"), F.col("name").alias("campaign_name"), F.col("status").alias("campaign_status"))
    people = contacts.select(
        ORG, F.col("id").alias("contact_id"), F.col("name").alias("contact_name"), F.col("email").alias("contact_email"), "pipeline_stage",
        "last_thread_id", "last_incoming_email_at", "unsubscribed_at", "stop_drafts", "do_not_contact",
    )
    # tasks shrink to one row per campaign and contact before any join
    return _draft_counts(for_org(tasks, org_id)).join(live, [ORG, "campaign_id"]).join(people, [ORG, "contact_id"], "left")


def followup_eligible(
    tasks, contacts, campaigns, company_contacts, companies, as_of, max_emails: int = 5, min_hours: int = 96, org_id: str | None = None
) -> DataFrame:
    """Contacts that may get the next email; a contact of two companies gives two rows."""
    rows = _draft_scope(tasks, contacts, campaigns, org_id)
    for passes, _ in _rules(as_of, max_emails, min_hours).values():
        rows = rows.filter(passes)
    links = company_contacts.select(ORG, "contact_id", "company_id").distinct()
    firms = companies.select(ORG, F.col("id").alias("company_id"), F.col("name").alias("company_name"))
    return (
        rows.join(links, [ORG, "contact_id"], "left")
        .join(firms, [ORG, "company_id"], "left")
        .select(
            ORG, "campaign_name", "contact_name", "contact_email", "last_thread_id", "last_incoming_email_at", "company_name", "campaign_id", "contact_id", "company_id",
            "sent_email_count", (F.col("sent_email_count") + 1).alias("next_sequence_number"), "pending_tasks", "declined_tasks", "total_tasks", "last_sent_at",
            _hours_since(F.col("last_sent_at"), as_of).alias("hours_since_last_email"),
        )
        .orderBy(ORG, "campaign_name", F.desc("sent_email_count"), "contact_name")
    )


def followup_diagnostics(tasks, contacts, campaigns, as_of, max_emails: int = 5, min_hours: int = 96, org_id: str | None = None) -> DataFrame:
    """The same scope with 'ok' or the reason per rule instead of a filter."""
    rules = _rules(as_of, max_emails, min_hours)
    return _draft_scope(tasks, contacts, campaigns, org_id).select(
        ORG, "campaign_id", "contact_id", "campaign_name", "campaign_status", "contact_name", "pipeline_stage", "sent_email_count", "pending_tasks", "declined_tasks", "last_sent_at",
        _hours_since(F.col("last_sent_at"), as_of).alias("hours_since_last_email"),
        *(F.when(passes, "ok").otherwise(why).alias(f"chk_{name}") for name, (passes, why) in rules.items()),
    )


# ---- queues -------------------------------------------------------------------------------


def due_actions(actions: DataFrame, as_of, lease_expires_at, batch: int) -> DataFrame:
    """Next batch of sequence actions to run, as claimed rows; no scheduled time means now."""
    now, status = moment(as_of), F.col("status")
    due = (status == "pending") & (F.col("scheduled_at").isNull() | (F.col("scheduled_at") <= now)) & (F.col("retry_at").isNull() | (F.col("retry_at") <= now))
    stale = (status == "claimed") & (F.col("lease_expires_at") < now)
    return (
        actions.filter(due | stale)
        .orderBy(F.asc_nulls_first("scheduled_at"), "id")
        .limit(batch)
        .withColumns(
            {
                "status": F.lit("claimed"),
                "lease_expires_at": moment(lease_expires_at),
                "attempts": F.coalesce("attempts", F.lit(0)) + 1,
                "updated_at": now,
            }
        )
    )


#: the rows that one request of the service claims at most
MANUAL_BATCH = 500


def due_manual_tasks(tasks: DataFrame, as_of, limit: int | None, claim_token: str, org_id: str | None = None) -> DataFrame:
    """The first `limit` rows of due manual outreach without text and without a fresh claim, claimed; MANUAL_BATCH without a limit."""
    if not claim_token.strip():
        raise ValueError("a claim token is required")
    now = moment(as_of)
    claimed = F.get_json_object("metadata", "$.copy_claimed_at")
    free = non_empty(claimed).isNull() | (claimed.try_cast("timestamp") < now - F.expr("INTERVAL 15 MINUTE"))
    return (
        for_org(tasks, org_id)
        .filter((F.col("task_type") == "manual_outreach") & (F.col("status") == "pending") & (F.col("due_date") <= now) & non_blank(F.col("body")).isNull() & free)
        .orderBy("due_date", F.asc_nulls_last("created_at"), "id")
        .limit(MANUAL_BATCH if limit is None else max(limit, 1))
        .withColumn("metadata", json_set(F.col("metadata"), {"copy_claim_token": F.lit(claim_token.strip()), "copy_claimed_at": F.lit(str(as_of))}))
    )


# fixed values: states a journey does not leave
TERMINAL_JOURNEYS = ("replied", "declined", "failed", "completed", "cancelled")


def due_journeys(journeys: DataFrame, as_of, org_id: str | None = None) -> DataFrame:
    return (
        for_org(journeys, org_id)
        .filter((F.col("next_action_at") <= moment(as_of)) & ~F.col("journey_state").isin(*TERMINAL_JOURNEYS))
        .orderBy("next_action_at", "id")
    )


# ---- matching companies -------------------------------------------------------------------


def _match_keys(url: Column, name: Column, domain: Column) -> Column:
    """Keys in order of trust: profile URL, lower-case name, domain. Absent ones are left out."""
    named = lambda rank, kind, value: F.when(value.isNotNull(), F.struct(F.lit(rank).alias("rank"), F.concat(F.lit(kind), value).alias("key")))
    return F.array_compact(F.array(named(1, "u:", non_empty(url)), named(2, "n:", F.lower(non_empty(name))), named(3, "d:", non_empty(domain))))


def match_companies(companies: DataFrame, candidates: DataFrame) -> DataFrame:
    """Best company per candidate by URL, else name, else domain.

    `candidates`: organization_id, candidate_id, profile_url, name, domain. Every key is reduced
    to one company before the join, so the join is many-to-one whatever the key's frequency,
    and the three OR branches are one equi-join over exploded keys.
    """
    keys = _match_keys(F.col("profile_url"), F.col("name"), F.col("domain"))
    owned = companies.select(ORG, F.col("id").alias("company_id"), F.coalesce("used_for_outreach", F.lit(False)).alias("used"), F.explode(keys).alias("k"))
    owned = owned.groupBy(ORG, F.col("k.key").alias("key")).agg(F.min(F.struct("company_id", "used")).alias("hit"))
    asked = candidates.select(ORG, "candidate_id", F.explode(keys).alias("k")).select(ORG, "candidate_id", "k.rank", "k.key")
    best = asked.join(owned, [ORG, "key"]).groupBy(ORG, "candidate_id").agg(F.min(F.struct("rank", "hit")).alias("best"))
    return candidates.join(
        best.select(ORG, "candidate_id", F.col("best.hit.company_id").alias("company_id"), F.col("best.hit.used").alias("company_used")), [ORG, "candidate_id"], "left"
    )


def filter_companies(companies: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates with the flag whether the matching company is already used for outreach."""
    return match_companies(companies, candidates).withColumn("is_already_used", F.coalesce("company_used", F.lit(False))).drop("company_used")


#: rounds in which candidates that are first under all of their keys settle their neighbours; what is left then are chains
SETTLING_ROUNDS = 3


def _creators(unknown: DataFrame) -> DataFrame:
    """Of candidates that no company matches, those that create one: taken in order of their ids,
    a candidate creates a company unless an earlier creator has one of its keys.

    A few rounds settle nearly all: candidates that are first under all of their keys create, and the others
    that have one of these keys are settled with them, so a key that many share is done with at once. Chains
    of candidates, each waiting for the one before, are left. They fall into components without a key in
    common, and each component is settled in the order of its ids, in one pass over its sorted rows.
    """
    keyed = stored(unknown.select(ORG, "candidate_id", "keys"), "unknown")
    made = stored(keyed.filter(F.size("keys") == 0).select(ORG, "candidate_id"), "created")
    left = stored(keyed.select(ORG, "candidate_id", F.explode("keys").alias("key")), "undecided")
    for _ in range(SETTLING_ROUNDS):
        if left.isEmpty():
            return made
        first = left.groupBy(ORG, "key").agg(F.min("candidate_id").alias("first"))
        own = left.join(first, [ORG, "key"]).groupBy(ORG, "candidate_id").agg(F.bool_and(F.col("first") == F.col("candidate_id")).alias("sure"))
        sure = stored(own.filter("sure").select(ORG, "candidate_id"), "created")
        taken = left.join(sure, [ORG, "candidate_id"], "left_semi").select(ORG, "key").distinct()
        settled = left.join(taken, [ORG, "key"], "left_semi").select(ORG, "candidate_id").distinct()
        left = stored(left.join(settled, [ORG, "candidate_id"], "left_anti"), "undecided")
        made = made.union(sure)
    return made if left.isEmpty() else made.union(_settled_chains(left))


def _settled_chains(left: DataFrame) -> DataFrame:
    """The creators among candidates with their keys (one row for each), component by component."""
    # nodes are hashes: two that meet by chance only make two components one, which changes no choice
    node = F.xxhash64(ORG, "candidate_id")
    first = left.groupBy(ORG, "key").agg(F.min(F.struct("candidate_id")).alias("first")).select(ORG, "key", F.xxhash64(ORG, "first.candidate_id").alias("b"))
    found, _ = components(left.join(first, [ORG, "key"]).select(node.alias("a"), "b"))
    rows = left.withColumn("node", node).join(found, "node").select("component", ORG, "candidate_id", "key")
    schema = left.select(ORG, "candidate_id").schema

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come by component and candidate; of a component only the keys of its creators are held
        here, taken, candidate, keys = None, set(), None, []

        def decided() -> bool:
            free = candidate is not None and not any((candidate[0], k) in taken for k in keys)
            if free:
                taken.update((candidate[0], k) for k in keys)
            return free

        for batch in batches:
            out = []
            for component, org, name, key in zip(*(batch.column(c).to_pylist() for c in ("component", ORG, "candidate_id", "key")), strict=True):
                if (org, name) != candidate or component != here:
                    if decided():
                        out.append(candidate)
                    if component != here:
                        here, taken = component, set()
                    candidate, keys = (org, name), []
                keys.append(key)
            yield pa.RecordBatch.from_arrays([pa.array([c[i] for c in out], pa.string()) for i in (0, 1)], [ORG, "candidate_id"])
        if decided():
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in candidate], [ORG, "candidate_id"])

    ordered = rows.repartition("component").sortWithinPartitions("component", ORG, "candidate_id")
    return stored(ordered.mapInArrow(choose, schema), "created")


def mark_companies(companies: DataFrame, candidates: DataFrame, campaign_name: str, as_of) -> tuple[DataFrame, DataFrame]:
    """Mark matched companies as used by a campaign and create the unknown ones.

    Returns (companies, result per candidate). Candidates count in the order of their ids: a later
    one sees the companies that earlier ones created or marked.
    """
    now = moment(as_of)
    keys = _match_keys(F.col("profile_url"), F.col("name"), F.col("domain"))
    matched = match_companies(companies, candidates)
    unknown = matched.filter(F.col("company_id").isNull()).withColumn("keys", F.transform(keys, lambda k: k["key"]))
    makers = stored(candidates.join(_creators(unknown), [ORG, "candidate_id"], "left_semi"), "makers")
    # a key has one maker at most; who comes after it may match it under a better key than an old company
    offered = makers.select(ORG, F.col("candidate_id").alias("maker"), F.explode(keys).alias("k")).select(ORG, "maker", F.col("k.key").alias("key"))
    asked = candidates.select(ORG, "candidate_id", F.explode(keys).alias("k")).select(ORG, "candidate_id", "k.rank", "k.key")
    fresh = asked.join(offered, [ORG, "key"]).filter(F.col("maker") <= F.col("candidate_id")).groupBy(ORG, "candidate_id").agg(F.min(F.struct("rank", "maker")).alias("fresh"))
    owned = companies.select(ORG, F.explode(keys).alias("k")).select(ORG, F.col("k.key").alias("key")).distinct()
    old_rank = asked.join(owned, [ORG, "key"], "left_semi").groupBy(ORG, "candidate_id").agg(F.min("rank").alias("old_rank"))
    lone = makers.select(ORG, "candidate_id", F.lit(True).alias("made"))
    new_id = lambda c: F.concat(F.lit("new:"), c)
    better = F.col("fresh").isNotNull() & (F.col("old_rank").isNull() | (F.col("fresh.rank") < F.col("old_rank")))
    settled = matched.join(fresh, [ORG, "candidate_id"], "left").join(old_rank, [ORG, "candidate_id"], "left").join(lone, [ORG, "candidate_id"], "left")
    settled = settled.select(
        ORG, "candidate_id", F.when(F.col("made"), new_id(F.col("candidate_id"))).when(better, new_id(F.col("fresh.maker"))).otherwise(F.col("company_id")).alias("company_id"),
        F.when(F.col("made") | better, F.lit(False)).otherwise(F.coalesce("company_used", F.lit(False))).alias("company_used"),
    )
    settled = stored(settled, "marked")
    per_company = settled.groupBy(ORG, F.col("company_id").alias("id")).agg(F.count("*").alias("hits"), F.min("candidate_id").alias("first"))
    hit = F.col("hits").isNotNull()
    known = F.coalesce("outreach_campaigns", F.array().cast("array<string>"))
    old = companies.join(per_company.drop("first"), [ORG, "id"], "left").withColumns(
        {
            "used_for_outreach": F.when(hit, True).otherwise(F.col("used_for_outreach")),
            "first_outreach_date": F.when(hit, F.coalesce("first_outreach_date", now)).otherwise(F.col("first_outreach_date")),
            "last_outreach_date": F.when(hit, now).otherwise(F.col("last_outreach_date")),
            "outreach_count": (F.coalesce("outreach_count", F.lit(0)) + F.coalesce("hits", F.lit(0))).cast("int"),
            "outreach_campaigns": F.when(hit, F.array_union(known, F.array(F.lit(campaign_name)))).otherwise(F.col("outreach_campaigns")),
        }
    ).drop("hits")
    new = makers.withColumn("id", new_id(F.col("candidate_id"))).join(per_company, [ORG, "id"]).select(
        "id", ORG, F.coalesce("name", F.lit("Unknown Company")).alias("name"), "domain", "profile_url", F.lit(True).alias("used_for_outreach"),
        now.alias("first_outreach_date"), now.alias("last_outreach_date"), F.col("hits").cast("int").alias("outreach_count"),
        F.array(F.lit(campaign_name)).alias("outreach_campaigns"), now.alias("created_at"),
    )
    # the first candidate of a company sees its state before the batch, the others see it marked
    result = settled.join(per_company.withColumnRenamed("id", "company_id"), [ORG, "company_id"]).select(
        ORG, "candidate_id", "company_id", (F.col("company_used") | (F.col("first") != F.col("candidate_id"))).alias("was_already_used"), F.lit(True).alias("marked_successfully")
    )
    return old.unionByName(new, allowMissingColumns=True), result


def unused_companies(companies: DataFrame, limit: int, org_id: str | None = None) -> DataFrame:
    """Newest companies not yet used for outreach."""
    return for_org(companies, org_id).filter(~F.col("used_for_outreach").eqNullSafe(True)).orderBy(F.desc("created_at"), "id").limit(limit)


# ---- exclusions ---------------------------------------------------------------------------


def exclude_competitors(companies: DataFrame) -> DataFrame:
    return companies.filter(~F.col("is_competitor").eqNullSafe(True))


def exclude_suppressed(recipients: DataFrame, suppressions: DataFrame, scope: str) -> DataFrame:
    """Drop recipients suppressed for every workspace or for their own."""
    stopped = suppressions.filter(F.col("scope") == scope).select(F.lower(F.trim("email")).alias("_email"), ORG)
    rows = recipients.withColumn("_email", F.lower(F.trim("email")))
    everywhere = stopped.filter(F.col(ORG).isNull()).select("_email")
    own = stopped.filter(F.col(ORG).isNotNull())
    return rows.join(everywhere, "_email", "left_anti").join(own, ["_email", ORG], "left_anti").drop("_email")


def reply_autosend_gate(drafts: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Whether a drafted reply may go out alone: channel switch on, intent allowed, confidence high enough."""
    rules = campaigns.select(ORG, F.col("id").alias("campaign_id"), "autosend_intents", "autosend_min_confidence", "autosend_email", "autosend_linkedin")
    switch = F.when(F.col("channel") == "linkedin", F.col("autosend_linkedin")).otherwise(F.col("autosend_email"))
    allowed = F.array_contains("autosend_intents", F.col("intent"))
    sure = F.col("confidence") >= F.col("autosend_min_confidence")
    reason = (
        F.when(~switch.eqNullSafe(True), "channel off")
        .when(~allowed.eqNullSafe(True), "intent not allowed")
        .when(~sure.eqNullSafe(True), "confidence too low")
        .otherwise("send")
    )
    return drafts.join(rules, [ORG, "campaign_id"], "left").withColumn("gate", reason).drop(
        "autosend_intents", "autosend_min_confidence", "autosend_email", "autosend_linkedin"
    )
