"""The usage projection contract: fixtures with stated results, differential and delta properties."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from ledgerlark.operators import usage as U
from ledgerlark.sources.tables import SCHEMAS


def at(text):
    return datetime.fromisoformat(text)


def usage_row(id, org, provider, model, calls, tin, tout, total, user, campaign, created, meta, listed, billed, invoice=None):
    return (id, org, "s", provider, model, calls, tin, tout, total, None, None, campaign, user, invoice, Decimal(listed), Decimal(billed), meta, at(created) if created else None)


ROWS = [
    usage_row("1", "a", "openai", "gpt-4.1-mini", 1, 10, 20, 30, "user-a", "camp-a", "2026-07-01 10:15:00", '{"service":"email_generation","operation":"draft"}', "0.1", "1"),
    usage_row("2", "a", "hunter", "email-finder", 2, 0, 0, 0, "user-b", None, "2026-07-02 11:30:00", '{"service":"company_research","operation":"email_finder","emails_found":2,"billable_units":2}', "0.2", "2"),
    usage_row("3", "a", "airscale", "airscale-phone-finder", 1, 0, 0, 0, None, "camp-a", "2026-07-02 12:45:00", '{"service":"company_research","action":"phone_finder","phones_found":1,"success":true}', "0.3", "3"),
    usage_row("4", "b", "openai", "gpt-4.1-mini", 1, 999, 1, 1000, "user-c", "camp-b", "2026-07-01 10:15:00", '{"service":"email_generation","operation":"draft"}', "9.9", "99"),
    usage_row("5", "a", "openai", "gpt-correction", 1, 5, 5, 10, None, None, "2026-07-03 09:00:00", '{"service":"company_research","operation":"draft"}', "0.01", "0.5"),
]


@pytest.fixture(scope="module")
def ledger(spark):
    return spark.createDataFrame(ROWS, SCHEMAS["usage"])


@pytest.fixture(scope="module")
def contributions(ledger):
    return U.contribution(ledger)


def test_backfill_is_idempotent(spark, ledger, contributions):
    first = U.backfill(ledger, contributions.limit(0))
    assert first.count() == 5
    assert U.backfill(ledger, first).count() == 0
    batch = U.backfill(ledger, contributions.limit(0), batch_size=2)
    summary = U.backfill_summary(batch).head()
    assert (summary.inserted_count, summary.last_usage_id) == (2, "4")
    rest = U.backfill(ledger, batch, batch_size=10000, after=(summary.last_created_at, summary.last_usage_id))
    assert rest.count() == 3
    with pytest.raises(ValueError):
        U.backfill(ledger, batch, batch_size=10001)


def test_readiness_gate(ledger, contributions):
    assert U.projection_ready(ledger, contributions)
    assert not U.projection_ready(ledger, contributions.filter("usage_id <> '3'"))
    with pytest.raises(RuntimeError):
        U.rollup_from_projection(U.build_projection(contributions), contributions, "2026-07-01", "2026-07-04", ready=False)


def test_stated_rollups(contributions):
    projection = U.build_projection(contributions)
    day = U.rollup_from_projection(projection, contributions, "2026-07-01", "2026-07-04", "day", org_id="a", ready=True)
    emails = day.filter("category = 'b2b_data'").head()
    assert (emails.bucket_start, emails.emails_found, emails.billed_cost) == (at("2026-07-02 00:00:00"), 2, 2)
    hour = U.rollup_from_projection(projection, contributions, "2026-07-02 12:00:00", "2026-07-02 13:00:00", "hour", org_id="a", ready=True).head()
    assert (hour.phones_found, hour.units) == (1, 1)
    total = lambda org: U.rollup_from_projection(projection, contributions, "2026-07-01", "2026-07-04", "day", org_id=org, ready=True).agg(F.sum("billed_cost")).head()[0]
    assert total("a") == Decimal("6.5") and total("b") == 99


def changed(spark, rows, op, seq=1):
    return spark.createDataFrame([(*r, op, seq) for r in rows], SCHEMAS["usage"] + ", op string, seq int")


def test_correction_and_delete(spark, contributions):
    projection = U.build_projection(contributions)
    row = usage_row("5", "a", "airscale", "airscale-phone-correction", 1, 0, 0, 0, None, None, "2026-07-03 09:00:00", '{"service":"company_research","operation":"draft","phones_found":2}', "0.01", "4")
    c2, p2 = U.apply_changes(contributions, projection, changed(spark, [row], "update"))
    day = p2.filter("bucket_granularity = 'day' AND bucket_start = '2026-07-03'")
    assert rows_of(day, "category", "phones_found", "billed_cost") == [("phones", Decimal(2), Decimal(4))]
    c3, p3 = U.apply_changes(c2, p2, changed(spark, [row], "delete"))
    assert p3.filter("bucket_start >= '2026-07-03'").count() == 0
    assert c3.count() == 4


def test_unchanged_update_changes_nothing(spark, contributions):
    projection = U.build_projection(contributions)
    _, after = U.apply_changes(contributions, projection, changed(spark, ROWS[:2], "update"))
    assert rows_of(after.select(projection.columns)) == rows_of(projection)


def test_subtraction_without_aggregate_fails(spark, contributions):
    broken = U.build_projection(contributions.filter("usage_id <> '1'"))
    _, after = U.apply_changes(contributions, broken, changed(spark, ROWS[:1], "delete"))
    with pytest.raises(Exception, match="no matching aggregate"):
        after.collect()


def test_last_change_of_a_row_counts(spark, contributions):
    projection = U.build_projection(contributions)
    both = changed(spark, ROWS[:1], "update", 1).unionByName(changed(spark, ROWS[:1], "delete", 2))
    c2, _ = U.apply_changes(contributions, projection, both)
    assert c2.filter("usage_id = '1'").count() == 0


def blank_as_null(df):
    return df.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in ("campaign_id", "user_id", "model_label")})


def regrouped(df):
    sums = [F.sum(m).alias(m) for m in U.MEASURES]
    return rows_of(blank_as_null(df).groupBy(*U.ROLLUP_KEY).agg(*sums))


def test_projection_equals_ledger_on_random_ranges(tables):
    rng = random.Random(7)
    ledger = tables.usage.cache()
    contributions = U.contribution(ledger).cache()
    projection = U.build_projection(contributions).cache()
    for bucket in ("hour", "day", "total", "hour", "day"):
        start = datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(20 * 86400))
        end = start + timedelta(seconds=rng.randrange(10 * 86400))
        if rng.random() < 0.4:
            start = start.replace(hour=0, minute=0, second=0)
        direct = U.rollup(ledger, start, end, bucket)
        projected = U.rollup_from_projection(projection, contributions, start, end, bucket, ready=True)
        assert regrouped(direct) == regrouped(projected), (bucket, start, end)


def test_random_deltas_equal_recomputation(spark, tables):
    rng = random.Random(11)
    columns = [f.strip().split()[0] for f in SCHEMAS["usage"].split(", ")] if isinstance(SCHEMAS["usage"], str) else None
    ledger = tables.usage.select(*columns).limit(200).collect()
    state = {r.id: tuple(r) for r in ledger[:120]}
    base = spark.createDataFrame(list(state.values()), SCHEMAS["usage"])
    contributions = U.contribution(base)
    projection = U.build_projection(contributions)
    changes = []
    for seq in range(60):
        kind = rng.choice(["insert", "update", "delete"])
        row = tuple(ledger[rng.randrange(120, 200)]) if kind == "insert" else rng.choice(list(state.values()))
        if kind == "update":
            row = row[:15] + (Decimal(rng.randrange(100)),) + row[16:]
        if kind == "delete":
            state.pop(row[0], None)
        else:
            state[row[0]] = row
        changes.append((*row, kind, seq))
    delta = spark.createDataFrame(changes, SCHEMAS["usage"] + ", op string, seq int")
    after_c, after_p = U.apply_changes(contributions, projection, delta)
    fresh = U.contribution(spark.createDataFrame(list(state.values()), SCHEMAS["usage"]))
    assert rows_of(after_c.select(fresh.columns)) == rows_of(fresh)
    want = U.build_projection(fresh)
    assert rows_of(after_p.select(want.columns)) == rows_of(want)


def test_tenant_isolation(tables):
    one = U.rollup(tables.usage, "2024-01-01", "2024-02-01", "day", org_id="org_2")
    alone = U.rollup(tables.usage.filter("organization_id = 'org_2'"), "2024-01-01", "2024-02-01", "day")
    assert rows_of(one) == rows_of(alone)


def test_bad_bucket(tables):
    with pytest.raises(ValueError):
        U.rollup(tables.usage, "2024-01-01", "2024-02-01", "week")


def test_filters_blank_and_all_mean_none(tables):
    every = U.rollup(tables.usage, "2024-01-01", "2024-02-01", "total")
    same = U.rollup(tables.usage, "2024-01-01", "2024-02-01", "total", campaign_id="all", model_name="", user_id=None)
    assert rows_of(every) == rows_of(same)


def test_tasks_of_a_table_are_bounded(spark):
    from ledgerlark.operators.common import spread

    parts = spread(spark.range(10000).coalesce(1), "id", rows=500)
    sizes = [len(p) for p in parts.rdd.glom().collect()]
    assert sum(sizes) == 10000 and max(sizes) < 1000


def test_changes_are_read_once_for_both_runs(spark, monkeypatch):
    import conftest
    from ledgerlark.operators.projection_store import ProjectionStore
    from ledgerlark.plans import load

    seen, apply = {}, ProjectionStore.apply

    def watched(self, deltas, batch):
        seen.setdefault(batch, []).append(deltas.inputFiles())
        apply(self, deltas, batch)

    monkeypatch.setattr(ProjectionStore, "apply", watched)
    load().QUERIES["usage_projection_store"](spark, conftest.SF_DIR)
    assert len(seen[1]) == 2 and all("/changes-" in f for files in seen[1] for f in files)
    assert all("/contributions-" in f for f in seen[0][0])
