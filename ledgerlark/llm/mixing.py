"""Mixing sources to target weights: capped water-filling and seeded repetition. DataFrame operations only.

1. Sources get weights by rank and share the total size. A level L is sought so that the targets
   min(MAX_EPOCHS * size, L * weight) add up to the total: sources whose cap lies below the level
   are clamped and the rest is shared anew, until no further source is clamped. Each step is one
   aggregate over the sources that returns three numbers.
2. Every document is taken floor(target / size) times whole. For the fraction that is left,
   documents are ordered by a seeded hash of their id and taken once more as long as the quota of
   words lasts. The cut is found from a histogram of 1024 hash ranges per source and the one range
   in which the quota runs out, so no task ever sorts a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.llm.common import WORD, aside, text_of
from ledgerlark.operators.common import number_rows, stored

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 20
_RANGES_SHIFT = 50  # of 60 hash bits, the 10 highest name the range


def size_of(text: str = "text") -> Column:
    """Number of words; 0 for null."""
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def place_of(doc_id: str = "doc_id", text: str = "text", seed: int = SEED) -> Column:
    """60 seeded hash bits of the id; a document without id is placed by its text."""
    name = F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("t"), F.md5(text_of(text))))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size -> source, source_size, target. Weights go by code point order, null last."""
    ranked = number_rows(sources.select("source", "source_size", F.col("source").isNull().alias("_none"), F.lit(0).alias("_all")), "_all", ["_none", "source"], "_rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    weighed = stored(ranked.select("source", "source_size", weight.cast("long").alias("_weight"), (F.col("source_size") * max_epochs).alias("_cap")), "sources")
    total = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first()["n"]
    level, clamped = 0.0, -1
    while True:
        above = F.col("_cap") <= F.lit(level) * F.col("_weight")
        row = weighed.agg(
            F.coalesce(F.sum(F.when(above, F.col("_cap"))), F.lit(0)).alias("capped"),
            F.coalesce(F.sum(F.when(~above, F.col("_weight"))), F.lit(0)).alias("weight"),
            F.count_if(above).alias("n"),
        ).first()
        if row["n"] == clamped or not row["weight"]:
            break
        level, clamped = (total - row["capped"]) / row["weight"], row["n"]
    return weighed.select(
        "source", "source_size",
        F.least(F.col("_cap").cast("double"), F.lit(level) * F.col("_weight")).alias("target"),
    )


def plan(sized: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row for each source of (source, size, place): source, source_size, target, whole, cut.

    A document of the source is taken `whole` times and once more if its place is at most `cut`.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    aims = stored(targets(sources, weights, max_epochs), "targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    aims = aims.withColumn("whole", F.floor(ratio)).withColumn("_quota", (ratio - F.floor(ratio)) * F.col("source_size"))
    spot = F.shiftright("place", _RANGES_SHIFT)
    cells = sized.groupBy("source", spot.alias("_range")).agg(F.sum("size").alias("_n"))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    running = Window.partitionBy("source").orderBy("_range")
    cells = cells.withColumn("_end", F.sum("_n").over(running))
    state = cells.join(aims, same(cells, aims)).select(
        cells["source"], "_range", (F.col("_end") - F.col("_n")).alias("_start"), "_end", "_quota",
    )
    state = stored(state, "ranges")
    # all of the ranges before the one in which the quota runs out
    full = state.filter(F.col("_end") <= F.col("_quota")).groupBy("source").agg(F.max("_range").alias("_last"))
    cross = state.filter((F.col("_start") < F.col("_quota")) & (F.col("_quota") < F.col("_end")))
    inside = sized.withColumn("_range", spot)
    inside = inside.join(cross, same(inside, cross) & (inside["_range"] == cross["_range"])).select(inside["source"], "place", "size", "_start", "_quota")
    ordered = Window.partitionBy("source").orderBy("place").rangeBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("_mid", F.col("_start") + F.sum("size").over(ordered) - F.col("size") / 2)
    part = inside.filter(F.col("_mid") <= F.col("_quota")).groupBy("source").agg(F.max("place").alias("_cut"))
    ends = full.select("source", (F.shiftleft(F.col("_last") + 1, _RANGES_SHIFT) - 1).alias("_cut")).unionByName(part.select("source", "_cut"))
    ends = ends.groupBy("source").agg(F.max("_cut").alias("cut"))
    return aims.join(ends, same(aims, ends), "left").select(
        aims["source"], "source_size", "target", "whole", F.coalesce("cut", F.lit(-1).cast("long")).alias("cut"),
    )


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row.

    Null text and empty text have size 0. Documents without source form one source. Repeated rows
    are taken alike; ties of the hash fall together, so reruns agree. An empty table gives an
    empty result; other columns are ignored.
    """
    sized = stored(
        docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), size_of(text).alias("size"), place_of(doc_id, text, seed).alias("place")),
        "sized",
    )
    aims = stored(plan(sized, weights, max_epochs), "mix")
    copies = F.col("whole") + (F.col("place") <= F.col("cut")).cast("long")
    return sized.join(aims, sized["source"].eqNullSafe(aims["source"])).select(
        "doc_id", sized["source"], "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"),
    )


def take(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED, copies: str = "copies") -> DataFrame:
    """The rows of docs that the mix takes, with the number of repetitions in `copies`.

    The plan has one row per source; Spark broadcasts it while it is small. A column of that name
    in docs gives way; all others stay as they are.
    """
    inner, names, _ = aside(docs)
    where = place_of(names[doc_id], names[text], seed)
    sized = stored(inner.select(F.col(names[source]).cast("string").alias("source"), size_of(names[text]).alias("size"), where.alias("place")), "sized")
    aims = stored(plan(sized, weights, max_epochs), "mix").select(F.col("source").alias("_source"), "whole", "cut")
    joined = inner.join(aims, F.col(names[source]).cast("string").eqNullSafe(F.col("_source")))
    times = F.col("whole") + (where <= F.col("cut")).cast("long")
    kept = [F.col(n).alias(c) for c, n in names.items() if c != copies]
    return joined.filter(times > 0).select(*kept, times.alias(copies))


ORACLE = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('20:' || coalesce(doc_id::VARCHAR, 't' || md5(coalesce(text, '')))), 1, 15))::BIGINT AS place
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM sized GROUP BY source),
ratio AS (SELECT *, 3 * source_size AS cap, 3.0::DOUBLE * source_size / weight AS bound FROM src),
levels AS (
  SELECT bound, ((SELECT sum(source_size) FROM src) - coalesce((SELECT sum(b.cap) FROM ratio b WHERE b.bound < a.bound), 0))::DOUBLE
         / (SELECT sum(b.weight) FROM ratio b WHERE b.bound >= a.bound) AS level
  FROM ratio a GROUP BY bound),
aim AS (
  SELECT source, source_size, weight, least(cap::DOUBLE, (SELECT level FROM levels WHERE level <= bound ORDER BY bound LIMIT 1) * weight) AS target FROM ratio),
part AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS r FROM aim),
ordered AS (
  SELECT s.doc_id, s.source, s.size, p.source_size, p.target, floor(p.r)::BIGINT AS whole, (p.r - floor(p.r)) * p.source_size AS quota, s.place,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(s.size) OVER (PARTITION BY s.source, s.place >> 50) AS in_range,
         max(s.place) OVER (PARTITION BY s.source, s.place >> 50) AS range_max
  FROM sized s JOIN part p ON s.source IS NOT DISTINCT FROM p.source),
ranged AS (SELECT *, max(upto) OVER (PARTITION BY source, place >> 50) AS range_end FROM ordered),
cuts AS (
  SELECT source, max(place) AS cut FROM ranged
  WHERE range_end <= quota OR (range_end - in_range < quota AND upto - size / 2 <= quota)
  GROUP BY source)
SELECT o.doc_id, o.size, o.source_size, o.target, o.size * (o.whole + CASE WHEN o.place <= coalesce(c.cut, -1) THEN 1 ELSE 0 END) AS taken
FROM ordered o LEFT JOIN cuts c ON o.source IS NOT DISTINCT FROM c.source
"""
