"""Name search over a stored trigram table: substrings, and similar names with misspellings.

A name's trigrams are those of its lower-case words of letters and digits, each word with two blanks before and
one behind it; the similarity of two names is the share of their trigrams that both have. The table has
a row for each trigram of a name, sorted by trigram, so a search reads the few row groups of the
trigrams it asks for. Rare trigrams come first in a name's order: two names of a given similarity share one
of the first few, so only those are met with each other, and a trigram that many names have is
hardly ever among them.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlark.operators.common import stored

#: similarity below which names do not count as alike
SIMILAR = 0.3
#: of the trigrams of a searched text so many are looked up, the rarest ones
LOOKED_UP = 4
_LETTERS = r"[^\p{L}\p{N}]+"


def trigrams(text: Column) -> Column:
    """The distinct trigrams of a name, NULL for NULL."""
    words = F.filter(F.split(F.lower(text), _LETTERS), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def similarity(a: Column, b: Column) -> Column:
    """Share of the trigrams of two names that both have, from their trigrams; 0 if neither has any."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(both / F.nullif(F.size(a) + F.size(b) - both, F.lit(0)), F.lit(0.0))


def _inner_trigrams(text: str) -> list[str]:
    """Trigrams that every name containing the text has: those of its runs of letters and digits, without blanks at the ends."""
    low = "".join(c if c.isalnum() else " " for c in text.lower())
    return list(dict.fromkeys(w[i : i + 3] for w in low.split() for i in range(len(w) - 2)))


class NameIndex:
    """A stored trigram table of names: `trigram`, `id`, `size` (trigrams of the name), `place` (0 for the rarest)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.table, self.counts = spark, os.path.join(folder, "trigrams"), os.path.join(folder, "counts")

    def build(self, names: DataFrame, id: str = "id", name: str = "name") -> None:
        """Write the table for all names; names without letters and digits have no rows."""
        each = stored(names.select(F.col(id).alias("id"), F.array_sort(trigrams(F.col(name))).alias("t")).filter(F.size("t") > 0), "names")
        each.select(F.explode("t").alias("trigram")).groupBy("trigram").agg(F.count("*").alias("n")).repartitionByRange("trigram").sortWithinPartitions("trigram").write.mode("overwrite").parquet(self.counts)
        rows = each.select("id", F.size("t").alias("size"), F.explode("t").alias("trigram"))
        place = F.row_number().over(Window.partitionBy("id").orderBy("n", "trigram")) - 1  # a name's trigrams are one group
        placed = rows.join(self._counts(), "trigram").withColumn("place", place).select("trigram", "id", "size", "place")
        # a trigram that many names have fills several ranges
        placed.repartitionByRange("trigram", "id").sortWithinPartitions("trigram", "place").write.mode("overwrite").parquet(self.table)

    def _counts(self) -> DataFrame:
        return self.spark.read.schema("trigram string, n bigint").parquet(self.counts)

    def _rows(self, id_type: str) -> DataFrame:
        return self.spark.read.schema(f"trigram string, id {id_type}, size int, place int").parquet(self.table)

    def containing(self, names: DataFrame, text: str, id: str = "id", name: str = "name") -> DataFrame:
        """The rows of names that contain the text, whatever the case.

        The rarest LOOKED_UP of the text's trigrams choose the rows, which are then compared. A text without
        three letters or digits in a row cannot be looked up and is searched for in all names.
        """
        hit = F.contains(F.lower(F.col(name)), F.lit(text.lower()))
        asked = _inner_trigrams(text)
        if not asked:
            return names.filter(hit)
        rare = self._counts().filter(F.col("trigram").isin(asked)).orderBy("n", "trigram").select("trigram").collect()  # at most as many as asked
        if len(rare) < len(asked):
            return names.filter(F.lit(False))  # a trigram that no name has
        wanted = [r["trigram"] for r in rare[:LOOKED_UP]]
        rows = self._rows(names.schema[id].dataType.simpleString()).filter(F.col("trigram").isin(wanted))
        found = rows.groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") == len(wanted)).select(F.col("id").alias(id))
        return names.filter(hit).join(found, id, "left_semi")

    def similar(self, names: DataFrame, queries: DataFrame, threshold: float = SIMILAR, id: str = "id", name: str = "name", query: str = "query", text: str = "text") -> DataFrame:
        """query, id, similarity: for each row of queries the names that are at least that similar, itself included.

        Of sets of a and b trigrams with that similarity, the first a - ceil(t * a) + 1 of one and b - ceil(t * b) + 1 of
        the other, rarest first, have one in common; sizes outside t * a to a / t cannot reach it. Names, and queries,
        with the same trigrams are compared as one, and a pair once, whatever number of trigrams brings it up; only the
        answer has a row for each of them. Queries without trigrams find nothing.
        """
        if not 0 < threshold <= 1:
            raise ValueError("the threshold is above 0 and at most 1")
        t = F.lit(threshold)
        first = lambda size: size - F.ceil(t * size - 1e-9) + 1
        asked, asked_sets = _by_sets(queries, query, text, "query", "a")
        known, known_sets = _by_sets(names, id, name, "id", "b")
        parts = asked_sets.select("a", F.size("a_grams").alias("a_size"), F.explode("a_grams").alias("trigram")).join(self._counts(), "trigram", "left")
        order = Window.partitionBy("a").orderBy(F.coalesce("n", F.lit(0)), "trigram")
        prefix = parts.withColumn("at", F.row_number().over(order) - 1).filter(F.col("at") < first(F.col("a_size")))
        rows = self._rows(names.schema[id].dataType.simpleString()).filter(F.col("place") < first(F.col("size")))
        rows = rows.join(known, "id").select("trigram", "b", "size", "place").distinct()
        fits = (F.col("size") >= t * F.col("a_size") - 1e-9) & (F.col("size") * t <= F.col("a_size") + 1e-9)
        # what can still be shared from here on must be enough
        rest = F.least(F.col("a_size") - F.col("at"), F.col("size") - F.col("place"))
        enough = rest + F.least("at", "place") >= t / (1 + t) * (F.col("a_size") + F.col("size")) - 1e-9
        pairs = prefix.join(rows, "trigram").filter(fits & enough).select("a", "b").distinct()
        scored = pairs.join(asked_sets, "a").join(known_sets, "b").withColumn("similarity", similarity(F.col("a_grams"), F.col("b_grams")))
        alike = scored.filter(F.col("similarity") >= threshold - 1e-12).select("a", "b", "similarity")
        # the answer is large where names are repeated: the ids are spread over all tasks before each meets its queries
        spread = alike.join(known, "b").select("a", "id", "similarity").repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        return spread.join(asked, "a").select("query", "id", "similarity")


def _by_sets(rows: DataFrame, id: str, text: str, id_name: str, set_name: str) -> tuple[DataFrame, DataFrame]:
    """The ids of texts with the number of their set of trigrams, and the sets by number; rows without id or without trigrams are left out."""
    grams = f"{set_name}_grams"
    each = rows.select(F.col(id).alias(id_name), F.array_sort(trigrams(F.col(text))).alias(grams)).filter((F.size(grams) > 0) & F.col(id_name).isNotNull())
    sets = stored(each.select(grams).distinct().withColumn(set_name, F.monotonically_increasing_id()), "sets")
    return stored(each.join(sets, grams).select(id_name, set_name), "members"), sets
