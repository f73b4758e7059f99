"""Stated fixtures of the dashboards, deals, funnel and manifest."""

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from ledgerlark.operators import dashboard as D
from ledgerlark.operators import deals as E
from ledgerlark.operators import funnel as P
from ledgerlark.operators import quality as Q


def at(text):
    return datetime.fromisoformat(text) if text else None


EMAILS = "id string, organization_id string, campaign_id string, contact_id string, status string, message_id string, thread_id string, sent_at timestamp, opened_at timestamp, replied_at timestamp, reply_received_at timestamp, bounced_at timestamp, created_at timestamp, metadata string"
TASKS = "id string, organization_id string, status string, contact_id string, campaign_id string, task_type string, send_status string, email_id string, thread_id string, sent_at timestamp, created_at timestamp, metadata string"
REPLIES = "organization_id string, dedup_key string, email_id string, account_id string, thread_id string, contact_id string, campaign_id string, received_at timestamp, classification string, relevance string"


def test_email_performance(spark):
    day = "2026-07-30 "
    emails = spark.createDataFrame(
        [("e1", "a", "c", "p", "replied", "out-1", "t1", at(day + "09:00:00"), None, at(day + "12:00:00"), None, None, at(day + "09:00:00"), '{"email_type":"initial"}')], EMAILS
    )
    tasks = spark.createDataFrame(
        [
            ("k1", "a", "completed", "p", "c", "review_draft", "sent_success", "out-2", "t2", at(day + "10:00:00"), at(day + "10:00:00"), '{"email_type":"initial"}'),
            ("k2", "a", "completed", "p", "c", "review_draft", "sent_success", None, "t1", at(day + "11:00:00"), at(day + "11:00:00"), '{"emailType":"reply"}'),
        ],
        TASKS,
    )
    event = lambda org, key, hour: (org, key, "m", "acc", "t1", "p", "c", at(f"{day}{hour}:00:00"), "interested", "high")
    replies = spark.createDataFrame([event("a", "k1", 13), event("a", "k1", 13), event("a", "k2", 14), event("b", "k1", 15)], REPLIES)
    assert replies.dropDuplicates(["organization_id", "dedup_key"]).filter("organization_id = 'a' AND dedup_key = 'k1'").count() == 1
    row = D.email_performance(emails, tasks, replies, "2026-07-30", "2026-07-31", org_id="a").head()
    assert (row.sent_count, row.replied_count, row.opened_count) == (2, 1, 1)
    assert not {"subject", "body", "contact_email"} & set(D.email_performance(emails, tasks, replies, "2026-07-30", "2026-07-31").columns)
    # the first reply lies before the range: it is not counted again later
    assert D.email_performance(emails.limit(0), tasks.limit(0), replies, "2026-07-30 13:30:00", "2026-07-31", org_id="a").count() == 0


CONTACTS = "id string, organization_id string, name string, pipeline_stage string, stage_updated_at timestamp, last_incoming_email_at timestamp, assigned_to_user_id string, created_at timestamp"
LINKS = "id string, organization_id string, company_id string, contact_id string, created_at timestamp"
COMPANIES = "id string, organization_id string, name string, owner_user_id string"
DEALS = (
    "id string, organization_id string, company_id string, primary_contact_id string, stage_contact_id string, source_campaign_id string, owner_user_id string, name string, stage string,"
    " amount decimal(14,2), currency string, creation_source string, nurture_enabled boolean, snoozed_until timestamp, stage_updated_at timestamp, last_activity_at timestamp, closed_at timestamp, created_at timestamp"
)
NOW = "2026-08-01 00:00:00"


class Crm:
    def __init__(self, spark, contacts, companies=(("co", "a", "Acme", None),), deals=None):
        self.spark = spark
        self.contacts = spark.createDataFrame([(i, "a", i, s, at(t), None, None, at("2026-01-01 00:00:00")) for i, s, t in contacts], CONTACTS)
        self.links = spark.createDataFrame([("l" + i, "a", "co", i, at("2026-01-02 00:00:00")) for i, _, _ in contacts], LINKS)
        self.companies = spark.createDataFrame(list(companies), COMPANIES)
        self.campaigns = spark.createDataFrame([], "id string, organization_id string, user_id string")
        self.campaign_companies = spark.createDataFrame([], "organization_id string, company_id string, campaign_id string")
        self.settings = spark.createDataFrame([("a", Decimal(25000), "EUR", True, True)], "organization_id string, default_deal_amount decimal(14,2), default_deal_currency string, crm_pipeline_enabled boolean, crm_automation_enabled boolean")
        self.members = spark.createDataFrame([("a", "u1"), ("a", "u2")], "organization_id string, user_id string")
        self.organizations = spark.createDataFrame([("a",)], "id string")
        self.failures = spark.createDataFrame([], "organization_id string, contact_id string, resolved_at timestamp")
        self.deals = deals if deals is not None else spark.createDataFrame([], DEALS)

    def inputs(self):
        return (self.contacts, self.links, self.companies, self.campaigns, self.campaign_companies, self.settings, self.members, self.deals, NOW)

    def project(self):
        return E.project(*self.inputs())

    def readiness(self, deals=None, failures=None):
        return E.readiness(self.organizations, self.settings, self.contacts, self.links, deals if deals is not None else self.deals, failures if failures is not None else self.failures).head()


def test_new_contact_opens_a_deal(spark):
    deals, failures = Crm(spark, [("p", "LEAD", None)]).project()
    row = deals.head()
    assert (row.stage, row.amount, row.currency, row.closed_at, row.primary_contact_id) == ("LEAD", Decimal(25000), "EUR", None, "p")
    assert failures.count() == 0


def test_stage_only_moves_up_and_won_is_never_automatic(spark):
    first = Crm(spark, [("p", "CONTRACT_NEGOTIATIONS", None)]).project()[0]
    again = Crm(spark, [("p", "CLOSED_WON", None)], deals=first).project()[0].head()
    assert again.stage == "NEGOTIATION"
    booked = Crm(spark, [("p", "APPOINTMENT_SCHEDULED", None)], deals=first).project()[0].head()
    assert booked.stage == "NEGOTIATION"


def test_lost_contact_closes_only_the_last(spark):
    base = Crm(spark, [("p", "LEAD", None)]).project()[0]
    two = Crm(spark, [("p", "CLOSED_LOST", None), ("q", "LEAD", None)], deals=base)
    row = E.close_lost(two.contacts, two.links, two.companies, two.deals, NOW).head()
    assert (row.stage, row.closed_at, row.primary_contact_id) == ("LEAD", None, "q")
    both = Crm(spark, [("p", "CLOSED_LOST", None), ("q", "CLOSED_LOST", None)], deals=base)
    row = E.close_lost(both.contacts, both.links, both.companies, both.deals, NOW).head()
    assert row.stage == "LOST" and row.closed_at is not None


def test_blank_company_goes_to_the_failure_ledger(spark):
    crm = Crm(spark, [("p", "LEAD", None)], companies=[("co", "a", "  ", None)])
    deals, failures = crm.project()
    assert deals.count() == 0 and rows_of(failures, "contact_id", "contact_stage") == [("p", "LEAD")]
    assert crm.links.count() == 1


def test_reconcile_and_readiness(spark):
    crm = Crm(spark, [("p", "APPOINTMENT_SCHEDULED", None)])
    before = crm.readiness()
    assert (before.missing_deal_count, before.ready_for_flag_enablement) == (1, False)
    deals, _, counters = E.reconcile(*crm.inputs())
    after = crm.readiness(deals)
    assert (after.missing_deal_count, after.lagging_stage_count, after.ready_for_flag_enablement) == (0, 0, True)
    assert deals.head().stage == "MEETING_BOOKED"
    row = counters.head()
    assert (row.projected, row.skipped, row.failed, row.activity_clock_floored) == (1, 0, 0, 1)
    failures = spark.createDataFrame([("a", "p", None)], "organization_id string, contact_id string, resolved_at timestamp")
    assert crm.readiness(deals, failures).ready_for_flag_enablement is False
    assert E.resolve_failures(failures, crm.contacts, crm.links, deals, NOW).head().resolved_at is not None


def test_first_creator_and_highest_stage(spark):
    crm = Crm(spark, [("p", "LEAD", "2026-02-01 00:00:00"), ("q", "PRESENTATION_SCHEDULED", "2026-03-01 00:00:00"), ("r", "LEAD", None)])
    row = crm.project()[0].head()
    assert (row.primary_contact_id, row.stage, row.stage_contact_id) == ("r", "PRESENTATION", "q")


def test_inbound_event_recorded_once(spark):
    crm = Crm(spark, [("p", "LEAD", None)])
    deals = crm.project()[0]
    schema = "organization_id string, contact_id string, activity_type string, title string, source_event_key string, actor string, actor_user_id string, occurred_at timestamp"
    event = ("a", "p", "email_in", None, " k ", "system", None, at(NOW))
    events = spark.createDataFrame([event, event], schema)
    stored = spark.createDataFrame([], "organization_id string, source_event_key string")
    fresh, conflicts = E.attach_activity(events, deals, crm.links, stored)
    assert rows_of(fresh, "title", "source_event_key", "bumps_last_activity") == [("Deal activity", "k", True)]
    assert conflicts.count() == 0
    again, _ = E.attach_activity(events, deals, crm.links, fresh)
    assert again.count() == 0
    clash = events.unionByName(spark.createDataFrame([("a", "p", "email_out", "x", "k", "system", None, at(NOW))], schema))
    assert E.attach_activity(clash, deals, crm.links, stored)[1].count() > 0
    with pytest.raises(Exception, match="unsupported activity type"):
        E.attach_activity(events.withColumn("activity_type", F.lit("note")), deals, crm.links, stored)[0].collect()


def test_owner_change_moves_tasks_and_notifies(spark):
    crm = Crm(spark, [("p", "LEAD", None)])
    old = crm.project()[0].withColumn("owner_user_id", F.lit("u1"))
    new = old.withColumn("owner_user_id", F.lit("u2"))
    tasks = spark.createDataFrame(
        [("t1", "a", "new:co", "pending", "nurture_reminder", "u1", None), ("t2", "a", "new:co", "completed", "nurture_reminder", "u1", None)],
        "id string, organization_id string, deal_id string, status string, task_type string, assigned_to_user_id string, metadata string",
    )
    assert rows_of(E.task_effects(old, new, tasks), "id", "assigned_to_user_id", "status") == [("t1", "u2", "pending"), ("t2", "u1", "completed")]
    assert rows_of(E.notifications(old, new, crm.settings), "user_id", "type") == [("u2", "deal_owner_changed")]
    assert E.notifications(old, new, crm.settings.withColumn("crm_pipeline_enabled", F.lit(False))).count() == 0
    closed = new.withColumns({"stage": F.lit("WON"), "closed_at": F.lit(NOW).cast("timestamp")})
    done = E.task_effects(new, closed, tasks)
    assert rows_of(done, "id", "status") == [("t1", "cancelled"), ("t2", "completed")]


def test_snooze_leaves_an_audit_row_only(spark):
    crm = Crm(spark, [("p", "LEAD", None)])
    old = crm.project()[0]
    new = old.withColumn("snoozed_until", F.lit("2026-09-01 00:00:00").cast("timestamp"))
    audit = E.audit(old, new)
    assert rows_of(audit, "activity_type", "title", "bumps_last_activity") == [("snooze_change", "Deal snoozed", False)]
    renamed = audit.withColumn("created_at", F.lit("2027-01-01").cast("timestamp"))
    assert E.last_activity(new, renamed).head().last_activity_at == new.head().last_activity_at


def stage_rows(spark, counts):
    return spark.createDataFrame([("a", stage) for stage, n in counts.items() for _ in range(n)], "organization_id string, pipeline_stage string")


def test_funnel_examples(spark):
    small = P.conversion(stage_rows(spark, {"PROSPECT": 2241, "LEAD": 1, "APPOINTMENT_REQUESTED": 2, "CLOSED_LOST": 1})).head()
    assert (small.prospect_to_lead, small.lead_to_appointment) == (Decimal("0.18"), Decimal("75.00"))
    big = P.conversion(stage_rows(spark, {"PROSPECT": 120, "LEAD": 19, "APPOINTMENT_REQUESTED": 12, "APPOINTMENT_SCHEDULED": 2, "CLOSED_LOST": 1})).head()
    assert (big.prospect_to_lead, big.lead_to_appointment) == (Decimal("22.08"), Decimal("44.12"))


def test_manifest(spark):
    schema = "bucket_id string, name string, version string, size bigint, etag string, mimetype string, cache_control string, user_metadata string"
    row = ("documents", "folder/report.pdf", "v", 10, "e", "application/pdf", None, None)
    before = spark.createDataFrame([row, ("documents", "gone", "v", 1, None, None, None, None)], schema)
    same = Q.manifest_diff(before, spark.createDataFrame([row], schema))
    assert rows_of(same, "name", "change") == [("folder/report.pdf", "unchanged"), ("gone", "removed")]
    bigger = spark.createDataFrame([row[:3] + (11,) + row[4:]], schema)
    assert ("folder/report.pdf", "changed") in rows_of(Q.manifest_diff(before, bigger), "name", "change")
