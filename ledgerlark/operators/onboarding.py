"""Onboarding funnel: drop-outs, sequence audiences, conversion, re-engagement."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.functions.dates import moment
from ledgerlark.operators.common import count_where, percent

ORG = "organization_id"


def _hours_before(as_of, hours: float) -> Column:
    return moment(as_of) - F.make_dt_interval(secs=F.lit(float(hours) * 3600).cast("decimal(18,6)"))


def dropouts(
    events: DataFrame, workspaces: DataFrame, sends: DataFrame, from_status: str, excluded: Sequence[str], hours: float, step: str, as_of
) -> DataFrame:
    """Workspaces whose latest entry to a status is older than `hours`, with no later progress and
    without this step's email. One aggregation over the events answers both questions."""
    status, at = F.col("to_status"), F.col("occurred_at")
    state = events.filter(status.isin(from_status, *excluded)).groupBy(ORG).agg(
        F.max(F.when(status == from_status, F.struct("occurred_at", "user_id", "user_email"))).alias("entry"),
        F.max(F.when(status.isin(*excluded), at)).alias("progressed_at"),
    )
    entered = F.col("entry.occurred_at")
    waiting = state.filter((entered <= _hours_before(as_of, hours)) & (F.col("progressed_at").isNull() | (F.col("progressed_at") <= entered)))
    sent = sends.filter(F.col("sequence_step") == step).select(ORG)
    orgs = workspaces.select(F.col("id").alias(ORG), "onboarding_status", "company_website")
    return waiting.join(sent, ORG, "left_anti").join(orgs, ORG).select(
        ORG, "onboarding_status", F.col("entry.user_id").alias("user_id"), F.col("entry.user_email").alias("user_email"), entered.alias("entered_status_at"), "company_website"
    )


class SequenceStep(NamedTuple):
    """One email of a sequence. Modes: 'not_activated' (workspace age) or 'funnel_stage' (drop-outs)."""

    key: str
    from_status: str = "pending"
    excluded: tuple[str, ...] = ("approved", "launched", "kb_built")
    delay_hours: float = 24
    audience_mode: str = "not_activated"
    is_active: bool = True


MAX_STEPS = 100


def sequence_audience(steps: Sequence[SequenceStep], events: DataFrame, workspaces: DataFrame, sends: DataFrame, as_of) -> DataFrame:
    """(workspace, step) pairs to mail now. Steps are configuration of a checked, small number."""
    if len(steps) > MAX_STEPS:
        raise ValueError(f"at most {MAX_STEPS} steps")
    active = [s for s in steps if s.is_active]
    # last time per status that a step names, so the map per workspace is as small as the steps
    named = {s for step in active for s in (step.from_status, *step.excluded)}
    seen = events.filter(F.col("to_status").isin(*named)).groupBy(ORG, "to_status").agg(F.max("occurred_at").alias("at"))
    seen = seen.groupBy(F.col(ORG).alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("to_status", "at"))).alias("last"))
    alive = workspaces.filter(~F.col("deleted").eqNullSafe(True)).join(seen, "id", "left")

    def due(step: SequenceStep) -> Column:
        limit = _hours_before(as_of, step.delay_hours)
        if step.audience_mode == "not_activated":
            hit = F.col("activated_at").isNull() & ~F.col("card_on_file").eqNullSafe(True) & (F.col("created_at") <= limit)
        else:
            entered = F.col("last")[step.from_status]
            hit = entered <= limit
            for status in step.excluded:
                later = F.col("last")[status]
                hit = hit & (later.isNull() | (later <= entered))
        return F.when(F.coalesce(hit, F.lit(False)), F.lit(step.key))

    pairs = alive.select(F.col("id").alias(ORG), F.explode(F.array_compact(F.array(*(due(s) for s in active)))).alias("sequence_step"))
    return pairs.join(sends.select(ORG, "sequence_step"), [ORG, "sequence_step"], "left_anti")


def _first_entries(events: DataFrame) -> DataFrame:
    return events.groupBy(ORG, "to_status").agg(F.min("occurred_at").alias("entered_at"))


def funnel(events: DataFrame) -> DataFrame:
    """Workspaces that ever reached each status and their share of all workspaces."""
    first = _first_entries(events)
    everyone = events.agg(F.countDistinct(ORG).alias("n")).scalar()
    return first.groupBy("to_status").agg(F.count("*").alias("workspaces")).withColumn("share", percent(F.col("workspaces"), everyone))


def transitions(events: DataFrame) -> DataFrame:
    """Moves between consecutive first entries: count, mean and median seconds.

    The window runs over first entries, at most one per status and workspace. The median is the
    least duration that half of the moves do not exceed, found on counts per duration.
    """
    order = Window.partitionBy(ORG).orderBy("entered_at", "to_status")
    first = _first_entries(events).withColumns({"from_status": F.lag("to_status").over(order), "left_at": F.lag("entered_at").over(order)})
    moves = first.filter(F.col("from_status").isNotNull()).withColumn("seconds", F.unix_seconds("entered_at") - F.unix_seconds("left_at"))
    pair = ["from_status", "to_status"]
    by_time = moves.groupBy(*pair, "seconds").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*pair).orderBy("seconds"))
    of_all = F.sum("n").over(Window.partitionBy(*pair))
    return by_time.withColumns({"upto": upto, "all": of_all}).groupBy(*pair).agg(
        F.sum("n").alias("moves"), F.sum(F.col("n") * F.col("seconds")).alias("total_seconds"),
        F.min(F.when(F.col("upto") * 2 >= F.col("all"), F.col("seconds"))).alias("median_seconds"),
    )


def current_status(events: DataFrame) -> DataFrame:
    """Latest status per workspace."""
    last = F.max(F.struct("occurred_at", "id", "to_status"))
    return events.groupBy(ORG).agg(last.alias("last")).select(ORG, F.col("last.to_status").alias("status"), F.col("last.occurred_at").alias("since"))


def reengagement_rates(sends: DataFrame) -> DataFrame:
    """Open, click and conversion rate per sequence step."""
    counts = sends.groupBy("sequence_step").agg(
        F.count("*").alias("sends"), F.count("opened_at").alias("opened"), F.count("clicked_at").alias("clicked"), F.count("converted_at").alias("converted")
    )
    return counts.withColumns({f"{n}_rate": percent(F.col(c), F.col("sends")) for n, c in (("open", "opened"), ("click", "clicked"), ("conversion", "converted"))})


def broadcast_progress(broadcasts: DataFrame, sends: DataFrame) -> DataFrame:
    """Send counters per broadcast, recomputed from the sends."""
    status = F.col("status")
    counts = sends.groupBy(F.col("broadcast_id").alias("id")).agg(
        F.count("*").alias("recipient_count"), *(count_where(status == s).alias(f"{s}_count") for s in ("pending", "sent", "failed", "suppressed"))
    )
    return broadcasts.join(counts, "id", "left").fillna(0)


def registrations(pages: DataFrame, registrations_: DataFrame, contacts: DataFrame) -> DataFrame:
    """One registration per event and lower-case email (the latest), matched to a contact by email."""
    email = F.lower(F.trim("email"))
    payload = [c for c in registrations_.columns if c not in ("event_id", "email")]
    latest = registrations_.groupBy("event_id", email.alias("email")).agg(F.max(F.struct("registered_at", "id", *[c for c in payload if c not in ("registered_at", "id")])).alias("r"))
    latest = latest.select("event_id", "email", *(F.col(f"r.{c}").alias(c) for c in payload))
    # one contact per email keeps the join many-to-one
    people = contacts.filter(F.col("email").isNotNull()).groupBy(ORG, F.lower(F.trim("email")).alias("email")).agg(F.min("id").alias("contact_id"))
    known = pages.select(F.col("id").alias("event_id"))
    return latest.join(known, "event_id", "left_semi").join(people, [ORG, "email"], "left")


def registration_counts(pages: DataFrame, registered: DataFrame) -> DataFrame:
    """Registrations per event and status against the capacity."""
    status = F.col("status")
    counts = registered.groupBy(F.col("event_id").alias("id")).agg(
        *(count_where(status == s).alias(s) for s in ("registered", "attended", "cancelled")), F.count("contact_id").alias("known_contacts")
    )
    taken = F.col("registered") + F.col("attended")
    out = pages.join(counts, "id", "left").fillna(0, ["registered", "attended", "cancelled", "known_contacts"])
    return out.withColumns({"seats_left": F.when(F.col("capacity").isNotNull(), F.greatest(F.col("capacity") - taken, F.lit(0)).cast("bigint")), "is_full": F.coalesce(taken >= F.col("capacity"), F.lit(False))})
