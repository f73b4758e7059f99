"""Inbox threads, unmatched replies and event retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.dates import moment
from ledgerlark.operators.common import first_per_key, for_org

ORG = "organization_id"
VISIBLE_ORIGINS = ("outbound", "campaign_inbound")
PREVIEW_LENGTH = 200


def visible_threads(threads: DataFrame, n: int, org_id: str | None = None) -> DataFrame:
    """Active threads of own outreach, latest first."""
    shown = (F.col("thread_status") == "active") & F.col("thread_origin").isin(*VISIBLE_ORIGINS)
    return for_org(threads, org_id).filter(shown).orderBy(F.desc("last_message_at"), "id").limit(n)


def tag_thread_origin(threads: DataFrame) -> DataFrame:
    """Fill a missing origin from the linked contact."""
    guess = F.when(F.col("contact_id").isNotNull(), "campaign_inbound").otherwise("unrelated_inbound")
    return threads.withColumn("thread_origin", F.coalesce("thread_origin", guess))


def thread_summary(messages: DataFrame) -> DataFrame:
    """Per chat: last message time, preview and direction, and inbound messages since the last outbound."""
    key = [ORG, "chat_id"]
    out_at = F.max(F.when(F.col("direction") == "outbound", F.col("sent_at")))
    # only the preview travels through the aggregation, not whole message bodies
    last = F.max(F.struct("sent_at", "id", "direction", F.substring("body", 1, PREVIEW_LENGTH).alias("preview")))
    heads = messages.groupBy(*key).agg(out_at.alias("last_outbound_at"), last.alias("last"))
    inbound = messages.filter(F.col("direction") == "inbound").select(*key, "sent_at")
    fresh = inbound.join(heads.select(*key, "last_outbound_at"), key).filter(F.col("last_outbound_at").isNull() | (F.col("sent_at") > F.col("last_outbound_at")))
    unread = fresh.groupBy(*key).agg(F.count("*").alias("unread_count"))
    return (
        heads.join(unread, key, "left")
        .select(
            *key, F.col("last.sent_at").alias("last_message_at"), F.col("last.preview").alias("last_message_preview"), F.col("last.direction").alias("last_direction"),
            "last_outbound_at", F.coalesce("unread_count", F.lit(0)).alias("unread_count"),
        )
    )


def unmatched_queue(replies: DataFrame) -> DataFrame:
    """Replies per workspace and status; an email id counts once, with its first delivery."""
    key = F.coalesce(F.col("email_id"), F.concat(F.lit("row:"), F.col("id")))
    once = first_per_key(replies.withColumn("_key", key), ["_key"], [F.asc("received_at"), F.asc("id")])
    return once.groupBy(ORG, "resolution_status").agg(F.count("*").alias("replies"), F.min("received_at").alias("oldest_received_at"))


def retention(events: DataFrame, as_of, anonymize_days: int = 14, purge_days: int = 90) -> DataFrame:
    """Drop old events and blank the payload of ageing ones."""
    now, at = moment(as_of), F.col("received_at")
    kept = events.filter(~F.coalesce(at < now - F.expr(f"INTERVAL {int(purge_days)} DAY"), F.lit(False)))
    old = at < now - F.expr(f"INTERVAL {int(anonymize_days)} DAY")
    return kept.withColumn("raw_payload", F.when(old, F.lit(None).cast("string")).otherwise(F.col("raw_payload")))
