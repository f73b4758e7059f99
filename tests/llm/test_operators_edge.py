"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for each operator and stage."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import rows_of
from ledgerlark.llm import decontam, language, mixing, ngram_join, quality_classifier, quality_rules, secrets, substring_dedup, toxicity, urls
from ledgerlark.llm.common import fold_of

from .conftest import EXTRA, SCHEMA, odd_rows

EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def operators(benchmark, labels):
    return {
        "op1": lambda d: quality_rules.judge(d),
        "op2": lambda d: ngram_join.join(d).drop("_t"),
        "op3": lambda d: quality_classifier.classify(d, labels, fold_of(5) != 0).withColumn("score", F.round("score", 6)),
        "op4": lambda d: secrets.scan(d),
        "op5": lambda d: language.identify(d, d),
        "op6": lambda d: substring_dedup.dedup(d),
        "op7": lambda d: mixing.mix(d),
        "op8": lambda d: decontam.scan(d, benchmark),
        "op9": lambda d: toxicity.score(d, labels, fold_of(4) != 2).withColumn("score", F.round("score", 6)),
    }


NAMES = [f"op{n}" for n in range(1, 10)]


@pytest.mark.parametrize("name", NAMES)
def test_every_row_once_and_other_columns_do_not_matter(odd, crowded, benchmark, labels, name):
    run = operators(benchmark, labels)[name]
    plain = run(odd)
    assert sorted((r[0] is not None, r[0]) if r[0] is not None else (False, 0) for r in plain.select("doc_id").collect()) == sorted(
        (r[0] is not None, r[0]) if r[0] is not None else (False, 0) for r in odd_rows()
    )
    assert rows_of(run(crowded)) == rows_of(plain)


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(none, benchmark, labels, name):
    assert operators(benchmark, labels)[name](none).collect() == []


def test_empty_side_tables(odd, benchmark, labels):
    run = operators(benchmark.limit(0), labels.limit(0))
    assert {r.n_hit for r in run["op8"](odd).collect()} == {0}
    assert {r.score for r in run["op3"](odd).collect()} == {0.5}
    assert len({r.score for r in run["op9"](odd).collect()}) == 1
    assert {r.lang_pred for r in language.identify(odd, odd.limit(0)).collect()} == {"und"}


def by_id(df, doc_id):
    return [r for r in df.collect() if r.doc_id == doc_id]


def test_defined_results(odd, benchmark, labels):
    run = operators(benchmark, labels)
    for doc in (1, 2, 3):
        row = by_id(run["op1"](odd), doc)[0]
        assert (row.n_words, row.word_chars, row.n_repeat_words, row.base_failed, row.kept) == (0, 0, 0, True, False)
    same = by_id(run["op1"](odd), 10)
    assert sorted(r.n_repeat_words for r in same) == [0, 200] and sorted(r.kept for r in same) == [False, True]
    assert by_id(run["op1"](odd), 11)[0].n_dup_lines == 29
    # copies and near copies under the least id; texts without words alone
    classes = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in run["op2"](odd).collect()}
    assert classes[4] == classes[5] == (4, 1, 3) and classes[6] == (4, 1, 1)
    assert classes[1] == (1, 0, 1) and classes[2] == (2, 0, 1) and classes[3] == (3, 0, 1)
    # bytes that a smaller id has; repeated rows of one id keep theirs
    left = {r.doc_id: (r.n_removed, r.n_spans) for r in run["op6"](odd).collect() if r.doc_id in (1, 2, 4, 5, 6, 8)}
    size = len(odd_rows()[4][1])
    assert left == {1: (0, 0), 2: (0, 0), 4: (0, 0), 5: (size, 1), 6: (size, 1), 8: (0, 0)}
    assert by_id(run["op6"](odd), 1)[0].kept_sha256 == EMPTY_SHA
    assert by_id(run["op4"](odd), 12)[0].spans.split(",")[0].startswith("assign:") and by_id(run["op4"](odd), 1)[0].spans == ""
    assert {r.lang_pred for r in run["op5"](odd).collect() if r.doc_id in (1, 2, 3)} == {"und"}
    marked = {r.doc_id: (r.n_words, r.n_items, r["items"]) for r in run["op8"](odd).collect()}
    assert marked[1] == (0, 0, []) and marked[11][1:] == (1, ["1"]) and marked[12][1:] == (1, ["null"]) and marked[10][1:] in ((1, ["4"]), (0, []))
    assert all(0 <= r.score <= 1 for n in ("op3", "op5", "op9") for r in run[n](odd).collect())
    mixed = run["op7"](odd).collect()
    assert all(r.taken <= 3 * r.size and r.taken % max(r.size, 1) == 0 for r in mixed)
    assert {r.taken for r in mixed if r.doc_id in (1, 2, 3)} == {0}


def test_urls(spark):
    rows = [
        (1, None, None), (2, "no scheme", "<p>"), (3, "", None), (4, "HTTP://WWW.Example.COM/en/x?y#z", None), (5, "https://a.example.com/en/", None), (6, "https://example.com", None),
        (7, "https://x.net/es/1", None), (8, "https://casino-bets.example.org/play", None), (9, "https://blog.example.org/de/3", None), (None, "https://notexample.com/en/1", None), (4, "HTTP://WWW.Example.COM/en/x?y#z", None),
        (10, "ftp://h#frag/en/", None), (11, "https://" + "a" * 5000 + ".net/fr/" + "b" * 50000, None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("own") for c in ("host", "path", "rule", "score", "verdict", "_ruled")})
    got = {r.page_id: r for r in urls.filter_urls(pages).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == (got[2].host, got[3].path, None, "allow") == ("", "", None, "allow")
    assert (got[4].host, got[4].path, got[4].rule, got[4].verdict) == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert (got[5].rule, got[5].verdict) == ("example.com/en/", "block") and (got[6].path, got[6].rule) == ("", None)
    assert (got[7].rule, got[7].verdict) == ("net/es/", "block") and (got[8].rule, got[8].verdict) == (None, "block") and got[9].verdict == "allow"
    assert got[None].rule == "com/" and (got[10].host, got[10].path) == ("h", "") and got[11].rule == "net/fr/"
    assert urls.filter_urls(pages).count() == len(rows) and urls.filter_urls(pages.limit(0)).collect() == []


def brute_rule(url):
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0].translate(str.maketrans(urls.UPPER, urls.LOWER))
    path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
    fits = [h + p for _, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=len, default=None)


def test_rules_by_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = urls.filter_urls(pages).collect()
    asked = {r.page_id: r.url for r in pages.select("page_id", "url").collect()}
    assert len(found) == len(asked) and all((r.host, r.path, r.rule) == brute_rule(asked[r.page_id]) for r in found)
    verdicts = {h + p: v for v, h, p in urls.RULES}
    weights, bias = urls.train()
    for r in found:
        assert r.verdict == (verdicts[r.rule] if r.rule else "block" if urls.score_of(r.host, r.path, weights, bias) >= 0.5 else "allow")
    bad = ("casino-win", "spam-farm", "adult-x", "cheap-pills", "free-bets", "ads-track")
    free = [r for r in found if not r.rule]
    assert all((r.verdict == "block") == any(b in r.host for b in bad) for r in free)


@pytest.mark.parametrize("stage", range(5))
def test_stages_keep_columns_and_survive(spark, odd, crowded, none, benchmark, tmp_path, stage):
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    name, run = corpus_pipeline.STAGES[stage]
    for docs in (odd, none, crowded):
        out = run(spark, docs, str(tmp_path))
        want = docs.columns if stage < 4 else [c for c in docs.columns if c != "copies"] + ["copies"]
        assert out.columns == want
        rows = out.collect()
        assert docs is not none or rows == []
        if docs is crowded:
            assert {r[c] for r in rows for c in EXTRA if c != "copies"} <= {f"own {c}" for c in EXTRA}


def test_stages_decide(spark, odd, benchmark, tmp_path):
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    after = {name: run(spark, odd, str(tmp_path)).collect() for name, run in corpus_pipeline.STAGES}
    count = len(odd_rows())
    assert {r.doc_id for r in after["quality_rules"]} == {None, 4, 5, 6, 7, 10, 11, 12} and len(after["quality_rules"]) == 9
    ids = [r.doc_id for r in after["near_copies"]]
    assert ids.count(4) == 1 and 5 not in ids and 6 not in ids and ids.count(10) == 2
    assert {11, 12} & {r.doc_id for r in after["decontamination"]} == set()
    assert len(after["secret_scan"]) == count
    masked = next(r for r in after["secret_scan"] if r.doc_id == 12)
    assert masked.text.endswith("[SECRET] [SECRET]") and masked.n_chars == len(masked.text)
    taken = {(r.doc_id, r.copies) for r in mixing.mix(odd).collect() if r.copies}
    assert {(r.doc_id, r.copies) for r in after["mixing"]} == taken


def test_schema(odd):
    assert odd.schema.simpleString().count(":") == SCHEMA.count(",") + 1
