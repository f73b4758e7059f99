"""Registered streaming jobs: each reads a driver table as a file stream to its end, and the result is compared with the batch answer."""

from pyspark.sql import functions as F

from ledgerlark.operators.common import spread
from ledgerlark.plans import usage as usage_plans
from ledgerlark.plans.dashboard import REPLY_LOG
from ledgerlark.plans.onboarding import THREADS
from ledgerlark.plans.registry import query
from ledgerlark.session import work_dir
from ledgerlark.sources.adapters import ADAPTERS, dependencies
from ledgerlark.streaming import stream as S


def _late_stream(t, name, at, key, twice=False):
    """The derived table in slices, latest rows first, so that most rows come months late; with `twice` a last slice repeats a fifth of the keys.

    Each slice is written by as many tasks as it fills, so that a batch of the stream is read by as many.
    """
    folder = work_dir(t.spark, name)
    rows = getattr(t, name)
    old, new = rows.agg(F.min(F.unix_seconds(at)), F.max(F.unix_seconds(at))).first()
    part = F.least(F.lit(2), F.floor((new - F.unix_seconds(at)) * 3 / (new - old + 1)))
    slices = [rows.filter(F.coalesce(part, F.lit(2)) == n) for n in range(3)]
    if twice:
        slices.append(rows.filter(F.crc32(key) % 5 == 0))
    for some in slices:
        spread(some, key, at).write.mode("append").parquet(folder)
    files = len(t.spark.read.parquet(folder).inputFiles())
    # files are taken by their time of writing, so about a slice at once
    return S.read_events(t.spark, folder, rows.schema, max_files=max(1, files // 4))


def _stream(t, name):
    """A derived table over the stream of its driver table, which is a file or a folder of files."""
    text = ADAPTERS[name]
    sources = {}
    for d in dependencies(text):
        sources[d] = _stream(t, d) if d in ADAPTERS else S.read_table_events(t.spark, t.folder, f"{d}.parquet", getattr(t, d).schema)
    return t.spark.sql(text, **sources)


@query(
    "stream_usage_buckets",
    usage_plans._PROJECTION.replace("(VALUES ('hour'), ('day')) g(bucket_granularity)", "(VALUES ('hour')) g(bucket_granularity)"),
)
def _buckets(t):
    job = S.UsageBuckets(t.spark, work_dir(t.spark, "usage-buckets"))
    job.run(_late_stream(t, "usage", "created_at", "id"))
    return job.totals()


@query("stream_dedup_events", "SELECT DISTINCT organization_id, dedup_key FROM email_reply_events")
def _dedup(t):
    rows = S.run_and_read(S.dedup_events(_late_stream(t, "email_reply_events", "received_at", "dedup_key", twice=True)), "reply-events", "append")
    return rows.select("organization_id", "dedup_key")


@query(
    "stream_first_replies",
    f"WITH {REPLY_LOG} SELECT organization_id, campaign_id, split_part(talk, '|', 1) || ':' || campaign_id || ':' || substr(talk, strpos(talk, '|') + 1) AS conversation, tm AS replied_at FROM answers WHERE nth = 1",
)
def _replies(t):
    rows = S.run_and_read(S.first_replies(_stream(t, "campaign_emails"), _stream(t, "email_reply_events")), "first-replies", "update")
    return S.latest_rows(rows, ["organization_id", "campaign_id", "conversation"])


@query("stream_usage_changes", usage_plans.CHANGED_PROJECTION)
def _changes(t):
    """The ledger arrives as a stream of inserts; stopped, the stream is run again over a batch of edits."""
    folder, job = work_dir(t.spark, "ledger"), S.UsageChanges(t.spark, work_dir(t.spark, "usage-changes"))
    for rows in (t.usage.withColumns({"op": F.lit("insert"), "seq": F.lit(0)}), usage_plans._changes(t)):
        rows.write.mode("append").parquet(folder)
        job.run(S.read_events(t.spark, folder, t.spark.read.parquet(folder).schema))
    return job.projection()


@query("stream_funnel_state", "SELECT organization_id, max_by(to_status, (occurred_at, id)) AS status, max(occurred_at) AS since FROM onboarding_events GROUP BY 1")
def _state(t):
    return S.latest_rows(S.run_and_read(S.funnel_state(_stream(t, "onboarding_events")), "funnel-state", "update"), ["organization_id"])


@query(
    "stream_daily_action_counts",
    "SELECT organization_id, account_id, action_type, CAST(created_at AS DATE) AS day, count(*) AS actions, count(*) FILTER (WHERE NOT success) AS failures FROM linkedin_action_log GROUP BY 1, 2, 3, 4",
)
def _actions(t):
    rows = S.run_and_read(S.daily_action_counts(_late_stream(t, "linkedin_action_log", "created_at", "id")), "action-counts", "update")
    return S.latest_rows(rows, ["organization_id", "account_id", "action_type", "day"])


@query("stream_thread_summary", THREADS)
def _threads(t):
    job = S.ThreadSummary(t.spark, work_dir(t.spark, "threads"))
    job.run(_stream(t, "linkedin_messages"))
    return job.state()
