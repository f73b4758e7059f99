"""Vector and text search over document chunks. All searches are exact scans with a top-k."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlark.functions.stem import STOP_WORDS, common_start, stem, stems_of
from ledgerlark.operators.common import for_org


def cosine(vector: Column, query: Sequence[float]) -> Column:
    """Cosine similarity to a literal query, in Arrow batches; NULL for an empty or zero vector.

    Measured against zip_with/aggregate, which boxes every element, the batch form wins by far on
    long vectors.
    """
    q = np.asarray(query, dtype=np.float64)
    norm = float(np.sqrt(q @ q))

    def similarity(vectors: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in vectors:
            rows = batch.to_numpy()
            ok = np.fromiter((v is not None and len(v) == len(q) for v in rows), bool, len(rows))
            out = np.full(len(rows), np.nan)
            if ok.any():
                m = np.stack(rows[ok]).astype(np.float64)
                length = np.sqrt(np.einsum("ij,ij->i", m, m)) * norm
                out[ok] = np.divide(m @ q, length, out=np.full(len(m), np.nan), where=length > 0)
            yield pd.Series(out)

    # not to be copied into a pushed-down filter, which would compute it twice
    score = F.pandas_udf(similarity, T.DoubleType()).asNondeterministic()(vector)
    return F.nanvl(score, F.lit(None).cast("double"))


def match_chunks(
    chunks: DataFrame, query: Sequence[float], threshold: float = 0.7, k: int = 10, org_id: str | None = None, vector: str = "embedding"
) -> DataFrame:
    """Chunks with a similarity above the threshold, nearest first."""
    rows = for_org(chunks, org_id).filter(F.col(vector).isNotNull()).withColumn("similarity", cosine(F.col(vector), query))
    return rows.filter(F.col("similarity") > threshold).orderBy(F.desc("similarity"), "id").limit(k)


def _vector_of(chunks: DataFrame, chunk_id: str) -> list[float] | None:
    row = chunks.filter((F.col("id") == chunk_id) & F.col("embedding").isNotNull()).select("embedding").head(1)
    return [float(x) for x in row[0][0]] if row else None


def similar_chunks(chunks: DataFrame, chunk_id: str, threshold: float = 0.7, k: int = 5, org_id: str | None = None) -> DataFrame:
    """Neighbours of one chunk, itself left out; none when the chunk has no vector."""
    query = _vector_of(chunks, chunk_id)
    if query is None:
        return chunks.limit(0).withColumn("similarity", F.lit(None).cast("double"))
    return match_chunks(chunks.filter(F.col("id") != chunk_id), query, threshold, k, org_id)


def content(pages: DataFrame, query: Sequence[float], threshold: float = 0.7, k: int = 10, org_id: str | None = None) -> DataFrame:
    """Page contents by similarity."""
    return match_chunks(pages, query, threshold, k, org_id).select("id", "url", F.col("chunk_text").alias("content"), "similarity")


# ---- text ---------------------------------------------------------------------------------


def query_terms(spark: SparkSession, text: str) -> list[str]:
    """The stems of the words of a query that are no stop words, each once."""
    words = "".join(c.lower() if c.isalnum() else " " for c in text).split()
    return list(dict.fromkeys(stems_of(spark, [w for w in words if w not in STOP_WORDS])))


def term_places(text: Column, terms: Sequence[str]) -> Column:
    """Where in a text's words forms of the terms stand, as structs of `at` and `term`, in order; NULL if not all terms occur.

    Words begin like their stem, so texts without the beginnings are left out before they are split, and only
    words with one of the beginnings are stemmed. All words count as places, stop words too.
    """
    if not terms:
        return F.lit(None).cast("array<struct<at:int,term:int>>")
    low, starts = F.lower(text), [common_start(t) for t in terms]
    likely = F.lit(True)
    for start in starts:
        likely = likely & F.contains(low, F.lit(start))

    def number(word: Column) -> Column:
        near = F.lit(False)
        for start in dict.fromkeys(starts):
            near = near | word.startswith(start)
        of_stem = lambda s: reduce(lambda out, t: out.when(s == t[1], t[0]), enumerate(terms), F.when(F.lit(False), 0)).otherwise(-1)
        return F.when(near, F.transform(F.array(stem(word)), of_stem)[0]).otherwise(-1)

    words = F.split(low, r"[^\p{L}\p{N}]+")
    marked = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("at"), number(w).alias("term"))), lambda x: x["term"] >= 0)
    places = F.when(likely, marked)
    return F.transform(F.array(places), lambda p: F.when(F.size(F.array_distinct(F.transform(p, lambda x: x["term"]))) == len(terms), p))[0]


def text_rank(places: Column, terms: Sequence[str]) -> Column:
    """Cover density: every minimal span that holds all terms adds 1 / its length in words; 0 without places.

    One pass over the places of the terms keeps the last place of each; a span is minimal when its
    start moved since the span before.
    """
    if not terms:
        return F.lit(0.0)
    start = F.struct(F.array(*(F.lit(-1) for _ in terms)).alias("last"), F.lit(-1).alias("from"), F.lit(0.0).alias("score"))

    def step(state: Column, place: Column) -> Column:
        last = F.transform(state["last"], lambda old, i: F.when(place["term"] == i, place["at"]).otherwise(old))

        def moved(it: Column) -> Column:
            first = F.array_min(it)
            found = first > state["from"]
            return F.struct(
                it.alias("last"), F.when(found, first).otherwise(state["from"]).alias("from"),
                F.when(found, state["score"] + 1.0 / (place["at"] - first + 1)).otherwise(state["score"]).alias("score"),
            )

        return F.transform(F.array(last), moved)[0]

    return F.coalesce(F.aggregate(places, start, step, lambda s: s["score"]), F.lit(0.0))


def hybrid(
    chunks: DataFrame, text: str, query: Sequence[float], text_weight: float = 0.3, vector_weight: float = 0.7,
    threshold: float = 0.2, k: int = 10, org_id: str | None = None,
) -> DataFrame:
    """Weighted sum of text rank and similarity. Both scores belong to the same chunk, so one scan
    replaces the outer join of two searches."""
    terms = query_terms(chunks.sparkSession, text)
    rows = for_org(chunks, org_id).withColumns(
        {
            "text_rank": text_rank(term_places(F.col("chunk_text"), terms), terms),
            "vector_similarity": F.coalesce(cosine(F.col("embedding"), query), F.lit(0.0)),
        }
    )
    rows = rows.withColumn("combined_score", F.lit(text_weight) * F.col("text_rank") + F.lit(vector_weight) * F.col("vector_similarity"))
    return rows.filter(F.col("combined_score") > threshold).orderBy(F.desc("combined_score"), "id").limit(k)


def search_text(df: DataFrame, column: str, text: str, k: int | None = None) -> DataFrame:
    """Rows whose text holds a form of every query term, best rank first; a query without terms matches nothing."""
    terms = query_terms(df.sparkSession, text)
    rows = df.withColumn("_places", term_places(F.col(column), terms)).filter(F.col("_places").isNotNull())
    rows = rows.withColumn("text_rank", text_rank(F.col("_places"), terms)).drop("_places").orderBy(F.desc("text_rank"), "id")
    return rows if k is None else rows.limit(k)


def search_names(df: DataFrame, column: str, text: str) -> DataFrame:
    """Case-insensitive substring search."""
    return df.filter(F.contains(F.lower(F.col(column)), F.lit(text.lower())))
