"""Dashboard counters and email performance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.dates import in_range, moment, time_key
from ledgerlark.functions.text import non_empty
from ledgerlark.operators.common import count_where, first_per_key, for_org

# ---- fixed values
REPLY_EMAIL_TYPES = (
    "reply", "meeting_response", "inquiry_response", "information_response", "neutral_follow_up",
    "not_interested_response", "general_response", "timeslots", "booking_confirmation",
)
EMAIL_TYPE_KEYS = ("email_type", "emailType", "type", "reply_type", "replyType")
AUDITED_REPLY_TYPES = (
    "reply", "timeslots", "booking_confirmation", "inquiry_response", "information_response", "general_response",
    "not_interested_response", "slot_reminder_1", "slot_reminder_2", "case_study_followup_1", "case_study_followup_2",
    "positive_follow_up_1", "positive_follow_up_2",
)
PIPELINE_STAGES = (
    "LEAD", "APPOINTMENT_REQUESTED", "APPOINTMENT_SCHEDULED", "PRESENTATION_SCHEDULED", "CONTRACT_NEGOTIATIONS",
    "AGREEMENT_IN_PRINCIPLE", "CLOSED_WON", "REENGAGEMENT",
)
INTERNAL_TASK = "email_generation_processing"

# ---- summary ------------------------------------------------------------------------------


def _prefixed(df: DataFrame, keys: list[str], **columns: str) -> DataFrame:
    return df.select(*keys, *(F.col(c).alias(n) for n, c in columns.items()))


def summary(
    campaigns: DataFrame, contacts: DataFrame, emails: DataFrame, tasks: DataFrame, previous_start, start, end,
    scope: str = "all", user_id: str | None = None, org_id: str | None = None,
) -> DataFrame:
    """Headline counters per workspace.

    Scope 'mine' keeps the user's campaigns, the contacts seen in those campaigns' emails or
    tasks, and the tasks the user made or that belong to those campaigns.
    """
    mine = scope == "mine"
    campaigns, contacts, emails, tasks = (for_org(d, org_id) for d in (campaigns, contacts, emails, tasks))
    own = campaigns.filter(F.col("user_id") == user_id) if mine else campaigns
    status = F.col("status")
    campaign_counts = own.groupBy("organization_id").agg(
        count_where(status == "active").alias("active_campaigns"), count_where(status == "paused").alias("paused_campaigns")
    )
    people = contacts
    if mine:
        keys = own.select("organization_id", F.col("id").alias("campaign_id"))
        seen = emails.select("organization_id", "campaign_id", "contact_id").union(tasks.select("organization_id", "campaign_id", "contact_id"))
        seen = seen.join(keys, ["organization_id", "campaign_id"], "left_semi").select("organization_id", F.col("contact_id").alias("id"))
        people = contacts.join(seen, ["organization_id", "id"], "left_semi")
    stage = F.upper(F.trim(F.coalesce("pipeline_stage", F.lit(""))))
    in_pipeline = stage.isin(*PIPELINE_STAGES)
    at = F.col("created_at")
    contact_counts = people.groupBy("organization_id").agg(
        count_where(in_pipeline & in_range(at, start, end)).alias("generated_leads"),
        count_where(in_pipeline & in_range(at, previous_start, start)).alias("previous_generated_leads"),
        count_where(in_pipeline).alias("pipeline_contacts"),
        count_where(stage == "APPOINTMENT_SCHEDULED").alias("meetings_booked"),
    )
    org = ["organization_id"]
    open_tasks = tasks.filter(status.isin("pending", "in_progress", "scheduled") & ~F.col("task_type").eqNullSafe(INTERNAL_TASK))
    open_tasks = open_tasks.join(_prefixed(contacts, org, contact_id="id", blocked="do_not_contact"), org + ["contact_id"], "left")
    linked = _prefixed(campaigns, org, campaign_id="id", campaign_status="status", owner="user_id").withColumn("known", F.lit(True))
    open_tasks = open_tasks.join(linked, org + ["campaign_id"], "left").filter(
        ~F.col("blocked").eqNullSafe(True)
        & (F.col("campaign_id").isNull() | F.col("known").isNotNull())
        & ~F.col("campaign_status").eqNullSafe("cancelled")
    )
    if mine:
        open_tasks = open_tasks.filter((F.col("created_by_user_id") == user_id) | (F.col("owner") == user_id))
    task_counts = open_tasks.groupBy("organization_id").agg(F.count("*").alias("open_tasks"))
    return (
        campaign_counts.join(contact_counts, "organization_id", "full_outer").join(task_counts, "organization_id", "full_outer").fillna(0)
    )


# ---- email performance --------------------------------------------------------------------


def _email_type() -> Column:
    return F.lower(F.trim(F.coalesce(*(F.get_json_object("metadata", f"$.{k}") for k in EMAIL_TYPE_KEYS), F.lit(""))))


def _joined(*parts) -> Column:
    return F.concat_ws(":", *(p if isinstance(p, Column) else F.lit(p) for p in parts))


def _send_key(message: Column, fallback: Column) -> Column:
    """Identity of a sent email: message id, else thread and time, else contact and time."""
    sent = F.col("sent_at").isNotNull()
    base = [F.col("campaign_id"), F.col("contact_id")]
    complete = sent & F.col("campaign_id").isNotNull() & F.col("contact_id").isNotNull()
    thread = non_empty(F.col("thread_id"))
    # a missing campaign or contact leaves no key, as concatenation with NULL does
    return (
        F.when(non_empty(message).isNotNull(), _joined("message", message))
        .when(thread.isNotNull() & sent, F.when(complete, _joined("thread-sent", *base, thread, time_key(F.col("sent_at")))))
        .when(sent, F.when(complete, _joined("campaign-contact-sent", *base, time_key(F.col("sent_at")))))
        .otherwise(fallback)
    )


def _campaign_scope(df: DataFrame, org_id, campaign_ids) -> DataFrame:
    df = for_org(df, org_id)
    return df if campaign_ids is None else df.filter(F.col("campaign_id").isin(*campaign_ids))


def _outreach(emails: DataFrame, tasks: DataFrame, start, end, with_replies: bool) -> DataFrame:
    """Sent outreach of both sources, one row per real email."""
    sent, made = F.col("sent_at"), F.col("created_at")
    touched = in_range(F.coalesce(sent, made), start, end)
    for moment_column in ["opened_at", "bounced_at"] + (["replied_at"] if with_replies else []):
        touched = touched | in_range(F.coalesce(F.col(moment_column), sent, made), start, end)
    outreach_type = ~_email_type().isin(*REPLY_EMAIL_TYPES)
    columns = ["organization_id", "campaign_id", "status", "sent_at", "opened_at", "bounced_at", "replied_at", "created_at", "source_rank", "source_id", "dedup_key"]
    real = (
        emails.filter(touched & outreach_type)
        .withColumns({"source_rank": F.lit(0), "source_id": F.col("id"), "dedup_key": _send_key(F.col("message_id"), _joined("campaign-email", F.col("id")))})
        .select(*columns)
    )
    opened_text = F.coalesce(*(non_empty(F.get_json_object("metadata", f"$.open_tracking.{k}")) for k in ("first_opened_at", "last_opened_at")))
    nothing = F.lit(None).cast("timestamp")
    from_tasks = (
        tasks.filter(
            (F.col("task_type") == "review_draft")
            & (F.col("send_status") == "sent_success")
            & in_range(sent, start, end)
            & F.col("campaign_id").isNotNull()
            & F.col("contact_id").isNotNull()
            & outreach_type
        )
        .withColumns(
            {
                "dedup_key": _send_key(F.col("email_id"), F.lit(None).cast("string")),
                "opened_at": F.when(opened_text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), opened_text.try_cast("timestamp")),
                "status": F.lit("sent"),
                "bounced_at": nothing,
                "replied_at": nothing,
                "created_at": F.coalesce(made, sent),
                "source_rank": F.lit(1),
                "source_id": F.col("id"),
            }
        )
        .select(*columns)
    )
    return first_per_key(real.unionByName(from_tasks), ["organization_id", "dedup_key"], [F.col("source_rank"), F.col("source_id")])


def _reply_candidates(emails: DataFrame, replies: DataFrame) -> DataFrame:
    campaign, thread, contact = F.col("campaign_id"), non_empty(F.col("thread_id")), F.col("contact_id")
    by_thread = _joined("thread", campaign, thread)
    by_contact = _joined("contact", campaign, contact)
    answered = F.col("replied_at").isNotNull() | F.col("reply_received_at").isNotNull() | (F.col("status") == "replied")
    message = non_empty(F.col("message_id"))
    from_emails = emails.filter(campaign.isNotNull() & answered).select(
        "organization_id", "campaign_id",
        F.coalesce("reply_received_at", "replied_at", "sent_at", "created_at").alias("replied_at"),
        F.when(thread.isNotNull(), by_thread).when(message.isNotNull(), _joined("message", campaign, message)).otherwise(by_contact).alias("conversation"),
    )
    from_events = replies.filter(campaign.isNotNull()).select(
        "organization_id", "campaign_id", F.col("received_at").alias("replied_at"),
        F.when(thread.isNotNull(), by_thread).when(contact.isNotNull(), by_contact).otherwise(_joined("message", campaign, F.col("email_id"))).alias("conversation"),
    )
    return from_emails.unionByName(from_events).filter(F.col("replied_at").isNotNull())


def first_replies(emails: DataFrame, replies: DataFrame) -> DataFrame:
    """Earliest reply per campaign and conversation, over all history."""
    return _reply_candidates(emails, replies).groupBy("organization_id", "campaign_id", "conversation").agg(F.min("replied_at").alias("replied_at"))


METRICS = ("sent_count", "opened_count", "replied_count", "bounced_count")


def _metric_rows(df: DataFrame, kinds: dict[str, tuple[Column, Column]], start, end) -> DataFrame:
    """One row per (email, metric) whose moment lies in the range, from one pass over the emails."""
    entries = F.array(
        *(F.when(cond & in_range(at, start, end), F.struct(F.lit(name).alias("metric"), F.to_date(at).alias("bucket_date"))) for name, (cond, at) in kinds.items())
    )
    return df.select("organization_id", "campaign_id", F.explode(F.array_compact(entries)).alias("e")).select("organization_id", "campaign_id", "e.*")


def _performance(rows: DataFrame) -> DataFrame:
    metric = F.col("metric")
    return (
        rows.groupBy("organization_id", "bucket_date", "campaign_id")
        .agg(*(F.count_if(metric == m).alias(m) for m in METRICS))
        .orderBy("organization_id", F.asc_nulls_last("bucket_date"), F.asc_nulls_last("campaign_id"))
    )


def _kinds(*names: str) -> dict[str, tuple[Column, Column]]:
    status, sent, made = F.col("status"), F.col("sent_at"), F.col("created_at")
    by_status = {"sent": ("sent", "delivered", "opened", "clicked", "replied"), "opened": ("opened", "clicked", "replied"), "replied": ("replied",), "bounced": ("bounced",)}
    out = {}
    for n in names:
        own = F.col(f"{n}_at")
        out[f"{n}_count"] = (own.isNotNull() | status.isin(*by_status[n]), F.coalesce(own, sent, made))
    return out


def email_performance(
    emails: DataFrame, tasks: DataFrame, replies: DataFrame, start, end, campaign_ids=None, org_id: str | None = None
) -> DataFrame:
    """Sent, opened, replied and bounced per UTC date and campaign in [start, end).

    A reply counts once per conversation, on the date of its first reply in all history.
    """
    emails, tasks, replies = (_campaign_scope(d, org_id, campaign_ids) for d in (emails, tasks, replies))
    outreach = _metric_rows(_outreach(emails, tasks, start, end, with_replies=False), _kinds("sent", "opened", "bounced"), start, end)
    replied = first_replies(emails, replies).filter(in_range(F.col("replied_at"), start, end))
    replied = replied.select("organization_id", "campaign_id", F.lit("replied_count").alias("metric"), F.to_date("replied_at").alias("bucket_date"))
    return _performance(outreach.unionByName(replied))


def email_performance_v1(emails: DataFrame, tasks: DataFrame, start, end, campaign_ids=None, org_id: str | None = None) -> DataFrame:
    """Older rule: the reply is read from the deduplicated email itself."""
    emails, tasks = (_campaign_scope(d, org_id, campaign_ids) for d in (emails, tasks))
    rows = _outreach(emails, tasks, start, end, with_replies=True)
    return _performance(_metric_rows(rows, _kinds("sent", "opened", "replied", "bounced"), start, end))


# ---- counters -----------------------------------------------------------------------------


def _visible_tasks(tasks: DataFrame, contacts: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Tasks a user sees: no internal ones, no do-not-contact people, no lost or cancelled campaigns."""
    org = ["organization_id"]
    people = _prefixed(contacts, org, contact_id="id", blocked="do_not_contact")
    live = _prefixed(campaigns, org, campaign_id="id", campaign_status="status")
    return (
        tasks.filter(F.col("task_type") != INTERNAL_TASK)
        .join(people, org + ["contact_id"], "left")
        .join(live, org + ["campaign_id"], "left")
        .filter(~F.col("blocked").eqNullSafe(True) & (F.col("campaign_id").isNull() | (F.col("campaign_status") != "cancelled")))
    )


def _company_counts() -> list[Column]:
    status, blocked = F.col("processing_status"), F.col("blocked_by_icp").eqNullSafe(True)
    return [
        F.count("*").alias("companies_total"),
        count_where(status == "scheduled").alias("companies_scheduled"),
        count_where(status.isin("processing", "pending")).alias("companies_processing"),
        count_where(status == "approved").alias("companies_approved"),
        count_where(status == "declined").alias("companies_declined"),
        count_where(blocked).alias("companies_blocked_by_icp"),
        count_where(status == "failed").alias("companies_failed"),
    ]


def _contact_counts(contacts: DataFrame) -> DataFrame:
    status = F.col("processing_status")
    return contacts.groupBy("organization_id").agg(
        F.count("*").alias("contacts_total"),
        count_where(status.isin("pending", "processing")).alias("contacts_processing"),
        count_where(status == "completed").alias("contacts_completed"),
    )


TASK_STATES = ("pending", "in_progress", "completed", "cancelled", "scheduled")
PENDING_KINDS = {"review_draft": "review_draft_tasks", "meeting": "meeting_tasks", "company_verification": "company_verification_tasks"}


def _task_state_counts() -> list[Column]:
    status, kind = F.col("status"), F.col("task_type")
    return [
        F.count("*").alias("total_tasks"),
        *(count_where(status == s).alias(f"{s}_tasks") for s in TASK_STATES),
        *(count_where((kind == k) & (status == "pending")).alias(n) for k, n in PENDING_KINDS.items()),
    ]


def _outer(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, "organization_id", "full_outer")
    return out.fillna(0)


def stats(companies, contacts, tasks, campaigns, as_of, org_id: str | None = None) -> DataFrame:
    """Company, contact and task counters per workspace."""
    companies, contacts, tasks, campaigns = (for_org(d, org_id) for d in (companies, contacts, tasks, campaigns))
    status = F.col("processing_status")
    processed = status.isin("processed", "approved", "declined") | F.col("blocked_by_icp").eqNullSafe(True)
    firms = companies.groupBy("organization_id").agg(*_company_counts(), count_where(processed).alias("companies_processed"))
    now, due = moment(as_of), F.col("due_date")
    active = F.col("status").isin("pending", "in_progress")
    day, week = F.date_trunc("day", now), F.date_trunc("week", now)
    work = _visible_tasks(tasks, contacts, campaigns).groupBy("organization_id").agg(
        *_task_state_counts(),
        count_where(active & (due < now)).alias("overdue_tasks"),
        count_where(active & (due >= day) & (due < day + F.expr("INTERVAL 1 DAY"))).alias("due_today_tasks"),
        count_where(active & (due >= week) & (due < week + F.expr("INTERVAL 7 DAY"))).alias("due_this_week_tasks"),
    )
    return _outer(firms, _contact_counts(contacts), work)


def task_counts(tasks, contacts, campaigns, as_of, org_id: str | None = None) -> DataFrame:
    """All task counters per workspace; the four priority counters are always 0."""
    tasks, contacts, campaigns = (for_org(d, org_id) for d in (tasks, contacts, campaigns))
    status, kind, due, now = F.col("status"), F.col("task_type"), F.col("due_date"), moment(as_of)
    unfinished = ~status.isin("completed", "cancelled")
    today = F.to_date(now)
    check = kind == "company_verification"
    counters = [
        *_task_state_counts(),
        count_where((kind == "meeting") & status.isin("pending", "scheduled")).alias("meetings_scheduled"),
        count_where((kind == "meeting") & (status == "completed")).alias("meetings_completed"),
        *(F.count(f"{c}_id").alias(f"tasks_with_{c}") for c in ("company", "campaign", "contact")),
        count_where(check & (status == "pending")).alias("company_verification_pending"),
        count_where(check & (status == "completed")).alias("company_verification_completed"),
        count_where((due < now) & unfinished).alias("overdue_tasks"),
        count_where((F.to_date(due) == today) & unfinished).alias("due_today_tasks"),
        count_where(due.between(now, now + F.expr("INTERVAL 7 DAY")) & unfinished).alias("due_this_week_tasks"),
        count_where(F.to_date("created_at") == today).alias("created_today"),
        count_where(F.to_date("completed_at") == today).alias("completed_today"),
    ]
    zeros = {f"{p}_priority_tasks": F.lit(0).cast("bigint") for p in ("urgent", "high", "normal", "low")}
    return _visible_tasks(tasks, contacts, campaigns).groupBy("organization_id").agg(*counters).withColumns(zeros)


def organization_summary(companies, contacts, tasks, org_id: str | None = None) -> DataFrame:
    """Plain counters per workspace; see `failure_reasons` for the reason breakdown."""
    companies, contacts, tasks = (for_org(d, org_id) for d in (companies, contacts, tasks))
    firms = companies.groupBy("organization_id").agg(*_company_counts(), count_where(F.col("processing_status") == "processed").alias("companies_processed"))
    work = tasks.groupBy("organization_id").agg(
        F.count("*").alias("total_tasks"), *(count_where(F.col("status") == s).alias(f"{s}_tasks") for s in TASK_STATES[:4])
    )
    return _outer(firms, _contact_counts(contacts), work)


def failure_reasons(companies: DataFrame, org_id: str | None = None) -> DataFrame:
    """Failed companies per workspace and reason, one row each."""
    failed = for_org(companies, org_id).filter((F.col("processing_status") == "failed") & F.col("failure_reason").isNotNull())
    return failed.groupBy("organization_id", "failure_reason").agg(F.count("*").alias("companies"))


def organization_stats(campaigns, companies, contacts, tasks, org_id: str | None = None) -> DataFrame:
    """Six totals per workspace."""
    campaigns, companies, contacts, tasks = (for_org(d, org_id) for d in (campaigns, companies, contacts, tasks))
    return _outer(
        campaigns.groupBy("organization_id").agg(F.count("*").alias("total_campaigns"), count_where(F.col("status") == "active").alias("active_campaigns")),
        companies.groupBy("organization_id").agg(F.count("*").alias("total_companies"), count_where(F.col("processing_status") == "processing").alias("processing_companies")),
        contacts.groupBy("organization_id").agg(F.count("*").alias("total_contacts")),
        tasks.groupBy("organization_id").agg(count_where(F.col("status") == "pending").alias("pending_tasks")),
    )


def reply_delivery_audit(tasks: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Reply tasks of the last days by type, status and delivery."""
    status = F.col("status")
    kind = F.col("task_type")
    audited = (kind == "review_reply") | (
        (kind == "review_draft") & F.coalesce(F.get_json_object("metadata", "$.email_type"), F.lit("")).isin(*AUDITED_REPLY_TYPES)
    )
    delivery = F.col("delivery_status")
    return (
        tasks.filter((F.col("created_at") >= moment(as_of) - F.expr(f"INTERVAL {int(days)} DAY")) & audited)
        .withColumn("delivery_status", F.coalesce("send_status", F.lit("not_sent")))
        .groupBy("organization_id", "task_type", F.col("status").alias("task_status"), "delivery_status")
        .agg(
            F.count("*").alias("task_count"),
            count_where((status == "completed") & ((delivery != "sent_success") | F.col("sent_at").isNull())).alias("completed_but_not_sent"),
            count_where(~status.isin("cancelled", "failed") & (delivery == "not_sent")).alias("open_or_completed_not_sent"),
        )
        .orderBy("organization_id", "task_type", "task_status", "delivery_status")
    )


def recent_task_pattern(tasks: DataFrame, as_of, hours: int = 1) -> DataFrame:
    """Tasks per minute, type and status over the last hours."""
    return (
        tasks.filter(F.col("created_at") > moment(as_of) - F.expr(f"INTERVAL {int(hours)} HOUR"))
        .groupBy(F.date_trunc("minute", "created_at").alias("minute"), "task_type", "status")
        .agg(F.count("*").alias("task_count"))
        .orderBy(F.desc("minute"), F.desc("task_count"))
    )


def document_engagement(urls: DataFrame, events: DataFrame, as_of) -> DataFrame:
    """Opens, first and last access and viewing time per shared link."""
    seen = events.groupBy(F.col("short_url_id").alias("id")).agg(
        count_where(F.col("event_type") == "open").alias("opens"),
        F.min("accessed_at").alias("first_accessed_at"),
        F.max("accessed_at").alias("last_accessed_at"),
        F.sum(F.coalesce("duration_seconds", F.lit(0))).alias("viewing_seconds"),
    )
    expired = F.coalesce(F.col("expires_at") <= moment(as_of), F.lit(False))
    return (
        urls.join(seen, "id", "left")
        .fillna(0, ["opens", "viewing_seconds"])
        .withColumn("link_state", F.when(~F.col("is_active"), "inactive").when(expired, "expired").otherwise("active"))
    )


def action_window(log: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """Actions and failures per account and type in the look-back window, for rate limits."""
    now = moment(as_of)
    return (
        log.filter((F.col("created_at") > now - F.expr(f"INTERVAL {int(hours)} HOUR")) & (F.col("created_at") <= now))
        .groupBy("organization_id", "account_id", "action_type")
        .agg(
            F.count("*").alias("actions"),
            count_where(F.col("success") == F.lit(False)).alias("failures"),
            F.max("created_at").alias("last_action_at"),
        )
    )
