"""Streams over several files equal the batch answer; retried batches change nothing."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from ledgerlark.operators import inbox, projection_store, usage
from ledgerlark.operators.projection_store import ProjectionStore
from ledgerlark.plans import load
from ledgerlark.sources.tables import SCHEMAS
from ledgerlark.streaming import keyed
from ledgerlark.streaming import stream as S


@pytest.fixture(scope="module")
def ledger_files(spark, tables, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ledger") / "usage")
    tables.usage.repartition(5).write.parquet(path)
    return path


def test_usage_buckets(spark, tables, ledger_files):
    events = S.read_events(spark, ledger_files, SCHEMAS["usage"], max_files=1)
    rows = S.run_and_read(S.usage_buckets(events), "t-buckets", "update")
    assert rows.select("batch").distinct().count() >= 5
    got = S.latest_rows(rows, list(usage.PROJECTION_KEY))
    want = usage.build_projection(usage.contribution(tables.usage)).filter("bucket_granularity = 'hour'")
    assert rows_of(got.select(want.columns)) == rows_of(want)


def test_usage_buckets_keep_no_state_and_restart(spark, tables, ledger_files, tmp_path):
    job = S.UsageBuckets(spark, str(tmp_path / "store"))
    run = lambda: job.run(S.read_events(spark, ledger_files, SCHEMAS["usage"], max_files=1))
    run()
    want = usage.build_projection(usage.contribution(tables.usage)).filter("bucket_granularity = 'hour'")
    for _ in range(2):
        assert S.read_store(spark, job.store).select("batch").distinct().count() >= 5
        assert rows_of(job.totals().select(want.columns)) == rows_of(want)
        undo_last_batch(tmp_path / "store" / "_checkpoint")
        run()  # the last batch once more


def test_the_usage_bucket_query_looks_up_no_keys_and_spreads_its_slices(spark, monkeypatch):
    import conftest

    stores, folders, run, read = [], [], S.run_to_store, S.read_events
    monkeypatch.setattr(S, "run_to_store", lambda stream, store, *rest: (stores.append(store), run(stream, store, *rest)))
    monkeypatch.setattr(S, "read_events", lambda spark, folder, *rest, **more: (folders.append(folder), read(spark, folder, *rest, **more))[1])
    load().QUERIES["stream_usage_buckets"](spark, conftest.SF_DIR)
    assert len(stores) == 1 and "state" not in os.listdir(os.path.join(stores[0], "_checkpoint"))
    assert len(spark.read.parquet(folders[0]).inputFiles()) > 6  # three slices


def test_dedup_over_batches(spark, tmp_path):
    schema = "organization_id string, dedup_key string, received_at timestamp"
    at = datetime(2026, 7, 30, 13)
    for n in range(3):
        spark.createDataFrame([("a", "k1", at), ("b", "k1", at), ("a", f"k{n}x", at)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    events = S.read_events(spark, str(tmp_path / "in"), schema, max_files=1)
    rows = S.run_and_read(S.dedup_events(events), "t-dedup", "append")
    assert len(rows_of(rows, "organization_id", "dedup_key")) == 5


def test_nothing_is_too_late(spark, tmp_path):
    schema = "organization_id string, dedup_key string, received_at timestamp"
    for n, (key, day) in enumerate((("k", 28), ("new", 1), ("k", 27), ("later", 28), ("new", 2))):
        spark.createDataFrame([("a", key, datetime(2026, 7 - n % 2 * 3, day))], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = lambda: S.read_events(spark, str(tmp_path / "in"), schema, max_files=1)
    assert rows_of(S.run_and_read(S.dedup_events(read()), "t-late", "append"), "dedup_key") == [("k",), ("later",), ("new",)]
    bounded = S.run_and_read(S.dedup_events(read(), lateness="2 days"), "t-bound", "append")
    assert bounded.count() < 5  # asked for, the bound holds


def test_funnel_state_keeps_the_latest(spark, tmp_path):
    schema = "id string, organization_id string, to_status string, occurred_at timestamp"
    for n, status in ((2, "approved"), (1, "pending"), (3, "launched")):
        spark.createDataFrame([(str(n), "w", status, datetime(2026, 1, n))], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    events = S.read_events(spark, str(tmp_path / "in"), schema, max_files=1)
    state = S.latest_rows(S.run_and_read(S.funnel_state(events), "t-funnel", "update"), ["organization_id"])
    assert rows_of(state, "status") == [("launched",)]


# ---- keyed state -----------------------------------------------------------------------------


def undo_last_batch(checkpoint):
    """As if the stream had stopped before it could note its last batch as done."""
    commits = sorted((p for p in checkpoint.joinpath("commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    commits[-1].unlink()
    for crc in checkpoint.joinpath("commits").glob(f".{commits[-1].name}.crc"):
        crc.unlink()


def wanted_projection(rows):
    return usage.build_projection(usage.contribution(rows))


def test_usage_changes_are_exact_and_restart(spark, tables, tmp_path):
    folder, job = str(tmp_path / "in"), S.UsageChanges(spark, str(tmp_path / "store"))
    rows = tables.usage.limit(400).cache()
    send = lambda df, op, seq: df.withColumns({"op": F.lit(op), "seq": F.lit(seq)}).coalesce(1).write.mode("append").parquet(folder)
    schema = rows.withColumns({"op": F.lit(""), "seq": F.lit(0)}).schema
    run = lambda job: job.run(S.read_events(spark, folder, schema, max_files=1))

    def check(job, left):
        want = wanted_projection(left)
        assert rows_of(job.projection().select(want.columns)) == rows_of(want)
        held = usage.contribution(left)
        assert rows_of(job.contributions().select(held.columns)) == rows_of(held)

    send(rows.filter("run_id IS NULL"), "insert", 0)
    send(rows.filter("run_id IS NOT NULL"), "insert", 0)
    run(job)
    check(job, rows)
    # deleted, undated and repriced rows, several changes of a row in one batch, after a restart
    priced = rows.filter("run_id IS NOT NULL").withColumn("billed_cost", (F.col("billed_cost") + 1).cast("decimal(12,6)"))
    send(rows.filter("run_id IS NULL").withColumn("created_at", F.lit(None).cast("timestamp")), "update", 1)
    both = rows.filter("run_id IS NOT NULL").withColumns({"op": F.lit("delete"), "seq": F.lit(2)}).unionByName(priced.withColumns({"op": F.lit("update"), "seq": F.lit(3)}))
    both.coalesce(1).write.mode("append").parquet(folder)
    again = S.UsageChanges(spark, str(tmp_path / "store"))
    run(again)
    check(again, priced)
    # the last batch runs once more
    undo_last_batch(tmp_path / "store" / "_checkpoint")
    run(S.UsageChanges(spark, str(tmp_path / "store")))
    check(again, priced)
    # rows come back, the others are sent unchanged
    send(rows.filter("run_id IS NULL").unionByName(priced), "update", 4)
    run(again)
    check(again, rows.filter("run_id IS NULL").unionByName(priced))


def files_of(folder):
    return {str(p.relative_to(folder)) for p in folder.rglob("*.parquet")}


def test_a_batch_rewrites_touched_partitions_only(spark, tables, tmp_path):
    rows = tables.usage.limit(500).cache()
    store, folder = ProjectionStore(spark, str(tmp_path / "p")), tmp_path / "p"
    held = usage.contribution(rows)
    store.apply(usage.build_signed(held, 1), 0)
    before = files_of(folder)
    org, day = held.select("organization_id", F.to_date("occurred_at")).orderBy("usage_id").first()
    hit = rows.filter((F.col("organization_id") == org) & (F.to_date("created_at") == F.lit(day)))
    changes = hit.withColumns({"op": F.lit("delete"), "seq": F.lit(1)})
    signed = usage.signed_changes(held, changes).cache()
    want = wanted_projection(rows.join(hit.select("id"), "id", "left_anti"))
    for _ in range(3):  # runs of the same batch
        store.apply(signed, 1)
        assert rows_of(store.read().select(want.columns)) == rows_of(want)
    fresh = files_of(folder) - before
    assert before <= files_of(folder) and all(f"day={day}" in f and "version=1" in f for f in fresh) and {f.split("/")[1] for f in fresh} == {"grain=hour", "grain=day"}
    assert store.vacuum() == 2 and len(before - files_of(folder)) == 2
    assert rows_of(store.read().select(want.columns)) == rows_of(want)
    assert rows_of(store.read(org).select(want.columns)) == rows_of(want.filter(F.col("organization_id") == org))
    with pytest.raises(Exception, match="no matching aggregate"):
        store.apply(signed, 2)
    # many partitions are matched by a join
    listed, projection_store.MOST_LISTED = projection_store.MOST_LISTED, 1
    try:
        store.apply(usage.build_signed(usage.contribution(rows), 1), 3)
    finally:
        projection_store.MOST_LISTED = listed
    assert store.read().agg(F.sum("usage_row_count")).first()[0] == 2 * (held.count() + rows.join(hit.select("id"), "id", "left_anti").filter("created_at IS NOT NULL").count())


def test_thread_summary_in_any_order_and_after_a_restart(spark, tables, tmp_path):
    messages, folder = tables.linkedin_messages, str(tmp_path / "in")
    read = lambda: S.read_events(spark, folder, messages.schema, max_files=1)
    late = [F.col("sent_at") >= "2024-01-01 04:00:00", F.col("sent_at") < "2024-01-01 02:00:00", F.col("sent_at").between("2024-01-01 02:00:00", "2024-01-01 03:59:59.999999")]
    for n, part in enumerate(late):
        messages.filter(part).coalesce(1).write.mode("append").parquet(folder)
        S.ThreadSummary(spark, str(tmp_path / "out")).run(read())  # a new object each time: all it knows is in the checkpoint
        if n == 1:
            undo_last_batch(tmp_path / "out" / "_checkpoint")
    want = inbox.thread_summary(messages)
    job = S.ThreadSummary(spark, str(tmp_path / "out"))
    assert rows_of(job.state().select(want.columns)) == rows_of(want)
    assert rows_of(S.latest_rows(job.changed(), keyed.CHAT).select(want.columns)) == rows_of(want)


def test_only_touched_chats_are_handled(spark, tmp_path):
    schema = "id string, organization_id string, chat_id string, direction string, body string, sent_at timestamp"
    folder = str(tmp_path / "in")
    at = lambda d: datetime(2026, 5, d)
    batches = [
        [("1", "o", "a", "inbound", "x" * 300, at(1)), ("2", "o", "a", "inbound", "hi", at(3)), ("3", "o", "b", "outbound", "yo", at(2)), ("4", "o", "b", "inbound", None, None)],
        [("5", "o", "a", "outbound", "re", at(2))],
        [("6", "o", "b", "inbound", "late", at(1)), ("7", "o", "b", "inbound", "new", at(4)), ("7", "o", "b", "inbound", "new", at(4))],
    ]
    job = S.ThreadSummary(spark, str(tmp_path / "out"))
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        job.run(S.read_events(spark, folder, schema, max_files=1))
    assert rows_of(job.changed(), "batch", "chat_id", "unread_count") == [(0, "a", 2), (0, "b", 0), (1, "a", 1), (2, "b", 2)]
    want = inbox.thread_summary(spark.createDataFrame([r for b in batches for r in b], schema))
    assert rows_of(job.state().select(want.columns)) == rows_of(want)


def test_driver_tables_are_files_or_folders_of_files(spark, tables, tmp_path):
    messages = tables.conversations
    messages.repartition(3).write.parquet(str(tmp_path / "many" / "conversations.parquet"))
    (tmp_path / "one").mkdir()
    part = tmp_path / "file"
    messages.coalesce(1).write.parquet(str(part))
    next(part.glob("*.parquet")).rename(tmp_path / "one" / "conversations.parquet")
    want = inbox.thread_summary(tables.linkedin_messages)
    for layout in ("many", "one"):
        got = load().QUERIES["stream_thread_summary"](spark, str(tmp_path / layout))
        assert rows_of(got.select(want.columns)) == rows_of(want)


def test_usage_changes_keep_no_python_state(spark, tables, tmp_path):
    rows = tables.usage.limit(50).withColumns({"op": F.lit("insert"), "seq": F.lit(0)})
    versions = S.UsageChanges(spark, str(tmp_path / "store")).versions(rows)
    plan = versions._jdf.queryExecution().toString()
    assert "TransformWithState" not in plan and "bucket" in versions.columns
