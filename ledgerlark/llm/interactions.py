"""Filter interaction audit: what each of five filters removes, in every order, by source.

1. Each text is measured once: the conditions A to D and a digest of the whole text. Only these narrow
   rows travel further. E, a copy of a document with a smaller id, is settled by counting: within a
   text all documents fail but those with the least id, so counts of all documents and counts of the
   first ones give the counts by mask of failed filters without sending a row back.
2. A mask of failed filters decides at which step each order removes a document. Every mask has a big
   integer with a field of FIELD bits for each of the 600 steps of the 120 orders, 1 where the mask is
   removed at that step, and one more field that counts documents. The integers of a part, times
   the documents of each mask, are added up: one sum for all documents, one for the good and one for the
   toxic ones. Counts are below 2**63, so no field runs over into the next, and the bytes of a sum
   are its counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.operators.common import stored

FILTERS = "ABCDE"
COPY = "E"
FIELD = 64
LEAST_WORDS = 200
SIGNS = b"#$%&*|"
UPPER = bytes(range(0x41, 0x5B))
LAST = 2**63 - 1
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def failed(text: str | None) -> int:
    """The mask of the conditions that a whole text fails, A as bit 0 to D as bit 3. Null counts as empty."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()  # bytes split at \x20 and \x09-\x0D, no others
    n, upper = len(words), len(data) - len(data.translate(None, UPPER))
    signs = len(data.translate(None, SIGNS)) < len(data)
    return (n < LEAST_WORDS) | (100 * len(set(words)) < 50 * n) << 1 | (100 * upper > 2 * len(text or "")) << 2 | signs << 3


class Wide:
    """The big integer of every mask for filters named by letters, a field for each step of each order."""

    def __init__(self, filters: str = FILTERS) -> None:
        self.filters = filters
        self.orders = ["".join(p) for p in permutations(filters)]
        self.steps = len(self.orders) * len(filters)
        self.of_mask = [self._of(mask) for mask in range(1 << len(filters))]

    def _of(self, mask: int) -> int:
        fields = 1 << FIELD * self.steps
        for i, order in enumerate(self.orders):
            at = next((s for s, letter in enumerate(order) if mask >> self.filters.index(letter) & 1), None)
            if at is not None:
                fields |= 1 << FIELD * (i * len(self.filters) + at)
        return fields

    def unpack(self, total: int) -> tuple[np.ndarray, int]:
        """Removed documents as orders by steps, and the number of all documents."""
        fields = np.frombuffer(total.to_bytes((self.steps + 1) * FIELD // 8, "little"), "<i8")
        return fields[:-1].reshape(len(self.orders), len(self.filters)), int(fields[-1])

    def outcomes(self, cells: Sequence[tuple[int, int, int, int]]) -> list[np.ndarray]:
        """The COUNTS of a part, as orders by steps, of its cells: mask, documents, good and toxic ones."""
        total = [sum(self.of_mask[c[0]] * c[k] for c in cells) for k in (1, 2, 3)]
        (removed, n), (good, _), (toxic, _) = map(self.unpack, total)
        letter = np.array([[self.filters.index(x) for x in order] for order in self.orders])
        shapley = np.array([removed[letter == f].sum() for f in range(len(self.filters))])
        # as the first filter it removes all that fail it, as the last those that fail no other
        fails, alone = (np.array([removed[letter[:, at] == f, at][0] for f in range(len(self.filters))]) for at in (0, -1))
        return [n - removed.cumsum(1), removed, fails[letter] - removed, alone[letter], good, toxic, shapley[letter]]


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, part, digest, mask of every row; a null id is the largest, a null source the part ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks, digests = [], []
            for value in batch.column("text"):
                value = value.as_py()
                masks.append(failed(value))
                digests.append(hashlib.blake2b((value or "").encode("utf-8", "surrogatepass"), digest_size=16).digest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), pa.array(digests, pa.binary()), pa.array(masks, pa.int32())], ["doc_id", "part", "digest", "mask"]
            )

    rows = docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("doc_id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("part"), F.col(text).alias("text")
    )
    return rows.mapInArrow(run, "doc_id long, part string, digest binary, mask int")


def cells(rows: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """part, mask with E, n, good, toxic: documents of measured rows, at most 32 cells a part."""
    # rows of one text under one id are one row with its number, so no text and no id is hot
    rows = stored(rows.groupBy("digest", "doc_id", "part", "mask").agg(F.count("*").alias("n")), "measured")
    known = labels.select(F.col(doc_id).cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")).filter("doc_id is not null")
    known = known.groupBy("doc_id").agg(*[F.coalesce(F.max(c), F.lit(False)).cast("long").alias(c) for c in ("good", "toxic")]).filter("good + toxic > 0")
    # rows without id have no label and would meet in one task
    named, unnamed = rows.filter(F.col("doc_id") != LAST), rows.filter(F.col("doc_id") == LAST)
    named = named.join(known, "doc_id", "left").withColumns({c: F.col("n") * F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})
    zero = F.lit(0).cast("long")
    marked = stored(named.unionByName(unnamed.withColumns({"good": zero, "toxic": zero})), "marked")
    first = marked.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    firsts = marked.join(first, ["digest", "doc_id"])
    copy = 1 << FILTERS.index(COPY)

    def summed(df: DataFrame, mask, sign: int) -> DataFrame:
        return df.groupBy("part", mask.alias("mask")).agg(*[(F.sum(c) * sign).alias(c) for c in ("n", "good", "toxic")])

    mask = F.col("mask")
    parts = summed(marked, mask.bitwiseOR(F.lit(copy)), 1).unionByName(summed(firsts, mask.bitwiseOR(F.lit(copy)), -1)).unionByName(summed(firsts, mask, 1))
    return parts.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def interactions(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, filter_order, step and the COUNTS, a row for each step of each order; cells as from `cells`, for any filters.

    A part's cells are one row for each mask, at most 2 ** len(filters), and meet in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = Wide(filters)
        orders, steps = np.repeat(wide.orders, len(filters)), np.tile(np.arange(1, len(filters) + 1, dtype=np.int32), len(wide.orders))
        for batch in batches:
            for part, held in zip(batch.column("part").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                counts = wide.outcomes([(c["mask"], c["n"], c["good"], c["toxic"]) for c in held])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * wide.steps, pa.string()), pa.array(orders.tolist(), pa.string()), pa.array(steps), *(pa.array(c.ravel(), pa.int64()) for c in counts)],
                    ["part", "filter_order", "step", *COUNTS],
                )

    held = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    return held.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """600 rows for every source: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Null text counts as empty, a null source is the part ''. A null id is larger than all others; rows
    that share a text and the least id are all first, none a copy. A label counts if any row of the id has it;
    labels without id count for nothing. Repeated rows are counted each. An empty table gives an empty
    result; other columns are ignored. Texts are measured whole.
    """
    return interactions(cells(measured(docs, doc_id, text, source), labels, doc_id))


ORACLE = r"""
WITH t AS (SELECT coalesce(doc_id, 9223372036854775807) AS id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(id) OVER (PARTITION BY text) AS first FROM t),
l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (
  SELECT part, len(w) < 200 AS a, 100 * list_unique(w) < 50 * len(w) AS b,
         100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) AS c,
         regexp_matches(text, '[#$%&*|]') AS d, id > first AS e, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM w LEFT JOIN l ON w.id = l.doc_id),
cell AS (
  SELECT part, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END, CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS fails,
         count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
  FROM m GROUP BY 1, 2),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT p.x || q.x || r.x || s.x || u.x AS o FROM letter p, letter q, letter r, letter s, letter u
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, u.x])) = 5),
steps AS (SELECT o, unnest(range(1, 6)) AS step FROM orders),
fate AS (
  SELECT part, o, step, substr(o, step, 1) AS x, fails, n, good, toxic,
         contains(fails, substr(o, step, 1)) AS here,
         length(regexp_replace(fails, '[' || substr(o, 1, step) || ']', '', 'g')) < length(fails) AS gone,
         step > 1 AND length(regexp_replace(fails, '[' || CASE WHEN step > 1 THEN substr(o, 1, step - 1) ELSE '-' END || ']', '', 'g')) < length(fails) AS before
  FROM cell, steps),
counted AS (
  SELECT part, o, step, x, sum(CASE WHEN gone THEN 0 ELSE n END) AS kept, sum(CASE WHEN here AND NOT before THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN here AND before THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = x THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN here AND NOT before THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN here AND NOT before THEN toxic ELSE 0 END) AS toxic_lost
  FROM fate GROUP BY part, o, step, x)
SELECT part, o AS filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley
FROM counted
"""
