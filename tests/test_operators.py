"""Small hand-written cases: NULL, '', second tenants, ties, hot keys."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from ledgerlark.functions import text as X
from ledgerlark.operators import billing as B
from ledgerlark.operators import identity as I
from ledgerlark.operators import inbox, outreach, quality, query, search
from ledgerlark.operators.common import number_rows
from ledgerlark.sources import io


def test_numbers_of_a_hot_group_are_dense_and_ordered(spark):
    rows = spark.range(20000).select(F.when(F.col("id") % 10 < 9, "hot").otherwise("cold").alias("g"), F.xxhash64("id").alias("k"), "id")
    out = number_rows(rows, "g", ["k", "id"], "n")
    check = out.groupBy("g").agg(F.count("*").alias("c"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.countDistinct("n").alias("d"))
    assert rows_of(check) == [("cold", 2000, 1, 2000, 2000), ("hot", 18000, 1, 18000, 18000)]
    first = out.filter("g = 'hot' AND n = 1").head().k
    assert first == rows.filter("g = 'hot'").agg(F.min("k")).head()[0]


def invoices(spark, *years):
    return spark.createDataFrame([(f"i{n}", datetime(y, 1, 1 + n), None) for n, y in enumerate(years)], "id string, created_at timestamp, period_end timestamp")


def test_invoice_numbers(spark):
    out = B.assign_invoice_numbers(invoices(spark, 2026, 2026, 2025))
    assert rows_of(out, "id", "invoice_number") == [("i0", "INV-2026/100001"), ("i1", "INV-2026/100002"), ("i2", "INV-2025/100001")]
    reserved = spark.createDataFrame([(2026, 7)], "invoice_year int, next_number bigint")
    assert rows_of(B.assign_invoice_numbers(invoices(spark, 2026), reserved=reserved), "invoice_number") == [("INV-2026/000007",)]
    with pytest.raises(Exception, match="2000"):
        B.assign_invoice_numbers(invoices(spark, 1999)).collect()
    with pytest.raises(Exception, match="too long"):
        B.assign_invoice_numbers(invoices(spark, 2026), prefix="A-VERY-LONG-PREFIX-TEXT").collect()


@pytest.mark.parametrize(
    "raw, want",
    [
        ("https://www.linkedin.com/in/Ann-1/?x=1", "linkedin.com/in/ann-1"), (" //de.linkedin.com/company/acme#a ", "linkedin.com/company/acme"), ("linkedin.com/in/a//", "linkedin.com/in/a"),
        ("https://linkedin.com/feed", None), ("https://example.com/in/a", None), ("https://a.b.linkedin.com/in/a", None), ("", None), (None, None),
    ],
)
def test_profile_url(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "u string").select(X.normalize_profile_url(F.col("u"))).head()[0] == want


def test_provider_label(spark):
    df = spark.createDataFrame([("xai",), (" deep-seek_chat  v2 ",), ("",), (None,), ("GPT",)], "p string")
    assert [r[0] for r in df.select(X.provider_label(F.col("p"))).collect()] == ["Advanced Research", "Deep Seek Chat V2", "Unknown", "Unknown", "Gpt"]


CONTACTS = "id string, organization_id string, profile_url string, email string, name string, created_at timestamp"


def test_soft_merge_leaves_one_canonical_row_per_key(spark):
    t = lambda n: datetime(2026, 1, n)
    rows = [
        ("1", "a", "linkedin.com/in/x", "A@x.com", None, t(1)), ("2", "a", "https://linkedin.com/in/X/", None, "Ann", t(2)), ("3", "a", None, "a@x.com", "Ann", t(3)),
        ("4", "b", "linkedin.com/in/x", "a@x.com", "Ann", t(4)), ("5", "a", None, "", None, t(5)), ("6", "a", None, "", None, t(6)),
    ]
    df = spark.createDataFrame(rows, CONTACTS)
    merged = I.soft_merge(df, measured=("profile_url", "email", "name"))
    pointers = dict(rows_of(merged, "id", "canonical_contact_id"))
    assert pointers == {"1": None, "2": "1", "3": "1", "4": None, "5": None, "6": None}
    assert rows_of(I.duplicate_contacts(df, "email_key"), "contact_id", "dup_count", "first_contact_id") == [("1", 2, "1"), ("3", 2, "1")]


def test_matching_prefers_url_then_name_then_domain(spark):
    companies = spark.createDataFrame(
        [("c1", "a", "u1", "Acme", "acme.com", True), ("c2", "a", "u2", "Beta", "beta.com", False), ("c3", "b", "u1", "Acme", "acme.com", True)],
        "id string, organization_id string, profile_url string, name string, domain string, used_for_outreach boolean",
    ).withColumns({"first_outreach_date": F.lit(None).cast("timestamp"), "last_outreach_date": F.lit(None).cast("timestamp"), "outreach_count": F.lit(None).cast("int"), "outreach_campaigns": F.lit(None).cast("array<string>"), "created_at": F.lit(None).cast("timestamp")})
    asked = spark.createDataFrame(
        [("q1", "a", "u2", "ACME", "acme.com"), ("q2", "a", "", "acme", None), ("q3", "a", None, None, "beta.com"), ("q4", "a", None, "New", None), ("q5", "a", "", "NEW", "x.com"), ("q6", "a", None, None, None)],
        "candidate_id string, organization_id string, profile_url string, name string, domain string",
    )
    got = outreach.filter_companies(companies, asked)
    assert rows_of(got, "candidate_id", "company_id", "is_already_used") == [
        ("q1", "c2", False), ("q2", "c1", True), ("q3", "c2", False), ("q4", None, False), ("q5", None, False), ("q6", None, False)
    ]
    after, result = outreach.mark_companies(companies, asked, "Spring", "2026-01-01")
    assert result.count() == 6
    assert rows_of(after.filter("organization_id = 'a'"), "id", "outreach_count") == [("c1", 1), ("c2", 2), ("new:q4", 2), ("new:q6", 1)]


def test_manual_task_claims(spark):
    rows = [
        ("t1", "pending", "2026-01-01 00:00:00", " ", None), ("t2", "pending", "2026-01-01 00:00:00", None, '{"copy_claimed_at":"2026-01-02 11:50:00","n":1}'),
        ("t3", "pending", "2026-01-01 00:00:00", "", '{"copy_claimed_at":"2026-01-02 11:00:00","n":1}'), ("t4", "pending", "2026-01-03 00:00:00", None, None), ("t5", "pending", "2026-01-01 00:00:00", "text", None),
    ]
    df = spark.createDataFrame(rows, "id string, status string, due string, body string, metadata string").withColumns(
        {"due_date": F.col("due").cast("timestamp"), "created_at": F.lit(None).cast("timestamp"), "task_type": F.lit("manual_outreach"), "organization_id": F.lit("a")}
    )
    out = outreach.due_manual_tasks(df, "2026-01-02 12:00:00", 0, " tok ")
    assert rows_of(out, "id") == [("t1",)]
    more = outreach.due_manual_tasks(df, "2026-01-02 12:00:00", 9000, "tok")
    assert rows_of(more, "id", F.get_json_object("metadata", "$.n"), F.get_json_object("metadata", "$.copy_claim_token")) == [("t1", None, "tok"), ("t3", "1", "tok")]
    with pytest.raises(ValueError):
        outreach.due_manual_tasks(df, "2026-01-02", 1, " ")


def test_query_surface(spark):
    df = spark.createDataFrame([("1", None, 3), ("2", "b", 1), ("3", "a", 2)], "id string, name string, n int")
    assert [r.id for r in query.page(df, ["name"], 3).collect()] == ["3", "2", "1"]
    assert [r.id for r in query.page(df, ["-name"], 1, 1).collect()] == ["2"]
    assert rows_of(query.where(df, {"n": [("gt", 1), ("lte", 3)], "name": ("is", "not_null")}), "id") == [("3",)]
    with pytest.raises(ValueError):
        query.where(df, {"n": ("between", 1)})


def test_text_search(spark):
    docs = spark.createDataFrame([("1", "Alpha beta."), ("2", "alpha x x beta, beta alpha"), ("3", "alphabet beta"), ("4", None)], "id string, body string")
    got = {r.id: round(r.text_rank, 6) for r in search.search_text(docs, "body", "the ALPHA beta").collect()}
    assert got == {"1": 0.5, "2": round(1 / 4 + 1 / 2, 6)}
    assert search.search_text(docs, "body", "the").count() == 0
    assert {r.id: r.text_rank for r in search.search_text(docs, "body", "alpha").collect()} == {"1": 1.0, "2": 2.0}


def test_vector_search_skips_missing_and_zero_vectors(spark):
    rows = [("1", "a", [1.0, 0.0]), ("2", "a", [0.0, 0.0]), ("3", "a", None), ("4", "a", [1.0]), ("5", "b", [2.0, 0.1]), ("6", "a", [0.0, 3.0])]
    df = spark.createDataFrame(rows, "id string, organization_id string, embedding array<float>")
    assert [r.id for r in search.match_chunks(df, [1.0, 0.0], 0.7).collect()] == ["1", "5"]
    assert [r.id for r in search.match_chunks(df, [1.0, 0.0], 0.7, org_id="a").collect()] == ["1"]
    assert [r.id for r in search.similar_chunks(df, "1", 0.5).collect()] == ["5"]
    assert search.similar_chunks(df, "3", 0.5).count() == 0


def test_csv_round_trip(spark, tmp_path):
    rows = [("Ann", "a@x.com", 'line one\nline "two"'), ("", "", ""), ("Bob", None, None)]
    df = spark.createDataFrame(rows, "`First Name` string, `E-Mail` string, note string")
    io.write_contact_export(df, str(tmp_path / "out"))
    back = io.import_csv_records(spark, str(tmp_path / "out"), "l1", multi_line=True)
    assert sorted(r.record_type for r in back.collect()) == ["person", "person", "unknown"]
    assert any('line one\\nline \\"two\\"' in r.raw_data for r in back.collect())
    firms = spark.createDataFrame([("Acme", None), (" ", "https://linkedin.com/in/x"), (" ", None)], "company_name string, linkedin_url string")
    assert [r.record_type for r in io.raw_records(firms, "l").collect()] == ["company", "person", "unknown"]


def test_references_keep_their_order(spark):
    df = spark.createDataFrame([("1", "a", ["z", "x", "z"]), ("2", "a", None), ("3", "a", ["y"]), ("4", "b", ["x"])], "id string, organization_id string, files array<string>")
    files = spark.createDataFrame([("x", "a"), ("z", "a")], "id string, organization_id string")
    assert {r.id: r.files for r in quality.remove_references(df, "files", files).collect()} == {"1": ["z", "x", "z"], "2": None, "3": [], "4": []}


def test_retention(spark):
    rows = [("1", "p", datetime(2026, 3, 1)), ("2", "p", datetime(2026, 2, 1)), ("3", "p", datetime(2025, 11, 1)), ("4", "p", None)]
    df = spark.createDataFrame(rows, "id string, raw_payload string, received_at timestamp")
    assert rows_of(inbox.retention(df, "2026-03-02"), "id", "raw_payload") == [("1", "p"), ("2", None), ("4", "p")]
