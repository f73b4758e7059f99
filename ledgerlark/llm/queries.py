"""The registered queries of this subpackage, each over its whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm import decontam, importance, interactions, interpolation, language, mixing, ngram_join, quality_classifier, quality_rules, secrets, substring_dedup, toxicity, urls
from ledgerlark.llm.common import fold_of, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return wrap


@query("op1_quality_rules", quality_rules.ORACLE)
def op1(spark, sf_dir):
    return quality_rules.judge(table(spark, sf_dir, "documents"))


@query("op2_ngram_join")
def op2(spark, sf_dir):
    return ngram_join.join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")


@query("op3_quality_classifier")
def op3(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = quality_classifier.classify(docs, labels, fold_of(5) != 0)
    return scored.select("doc_id", (fold_of(5) == 0).alias("held_out"), "score", "predicted")


@query("op4_secret_scan")
def op4(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents"))


@query("op5_language_id")
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, docs.filter(fold_of(3) != 1))
    return found.select("doc_id", (fold_of(3) == 1).alias("held_out"), "lang_pred", "score", "rejected")


@query("op6_substring_dedup")
def op6(spark, sf_dir):
    return substring_dedup.dedup(table(spark, sf_dir, "documents"))


@query("op7_mixing", mixing.ORACLE)
def op7(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", F.col("size"), "source_size", "target", "taken")


@query("op8_decontamination", decontam.ORACLE)
def op8(spark, sf_dir):
    marked = decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return marked.select("doc_id", "n_words", "n_hit", "n_items", digest, (F.col("n_hit") > 0).alias("contaminated"))


@query("op9_toxicity")
def op9(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.score(docs, labels, fold_of(4) != 2)
    return scored.select("doc_id", (fold_of(4) == 2).alias("held_out"), "score", "predicted")


@query("op10_url_filter")
def op10(spark, sf_dir):
    return urls.filter_urls(table(spark, sf_dir, "pages"))


@query("op11_importance_resampling")
def op11(spark, sf_dir):
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


@query("op12_filter_audit", interactions.ORACLE)
def op12(spark, sf_dir):
    return interactions.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op13_lm_scoring")
def op13(spark, sf_dir):
    scored = interpolation.score(table(spark, sf_dir, "documents"), fold_of(10) != 0)
    return scored.select("doc_id", (fold_of(10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
