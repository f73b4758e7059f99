"""N-gram Jaccard join: MinHash banding, verified on full n-gram sets.

1. Texts with the same set of 5-word shingles are one node, under the least id. Every node gets a
   MinHash signature; bands of ROWS hashes are chosen for the target recall at the threshold.
2. Nodes meet in the buckets of their band hashes. A bucket is shuffled to a task, which compares
   the full shingle sets of its members: the sizes of all their intersections are one product of
   a member-by-shingle matrix. No pair leaves the task; for each member it returns the least
   member it is connected with and the number of its links. Connected nodes become one class.
3. A bucket of more than BLOCK members is cut into blocks of about BLOCK members, and a task compares
   two blocks. Members that share the earlier band most common in the bucket have met there, so
   they are compared with the others only. So memory is bounded and every pair that shares a band
   is compared; the work grows with the square of the largest buckets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.llm.common import aside, gram_hashes, mix, text_of, word_hashes
from ledgerlark.operators.common import stored

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.9995
MOST_HASHES = 100
SEED = 7
#: members of a bucket that a task compares with each other
BLOCK = 2048
_COLUMNS = 4096
LAST = 2**63 - 1
IN_WORD = np.array([b != 0x20 and not 0x09 <= b <= 0x0D for b in range(256)])


def banding(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """Bands and rows: the most rows, so the fewest chance meetings, that reach the recall within `most` hashes."""
    best = (most, 1)
    for rows in range(1, most + 1):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the runs of `size` words; of fewer words, of all of them."""
    words = word_hashes(text, IN_WORD)
    if 0 < len(words) < size:
        return gram_hashes(words, len(words))
    return np.unique(gram_hashes(words, size))


class Signer:
    def __init__(self, bands: int, rows: int, seed: int = SEED) -> None:
        self.bands, self.rows = bands, rows
        self.salts = np.random.default_rng(seed).integers(1, 2**63, bands * rows, dtype=np.uint64) | np.uint64(1)

    def sign(self, grams: np.ndarray) -> np.ndarray:
        """The least product of the grams with each odd salt; the grams are mixed already."""
        out = np.full(len(self.salts), ~np.uint64(0))
        for at in range(0, len(grams), 256):
            np.minimum(out, np.multiply.outer(grams[at : at + 256], self.salts).min(0), out=out)
        return out

    def band_hashes(self, signature: np.ndarray) -> np.ndarray:
        total = np.arange(1, self.bands + 1, dtype=np.uint64)
        for column in signature.reshape(self.bands, self.rows).T:
            total = mix(total * np.uint64(0x9E3779B97F4A7C15) + column)
        return total.view(np.int64)


def signatures(docs: DataFrame, doc_id: str, text: str, signer: Signer, size: int) -> DataFrame:
    """_d, _t, node, bands for every row: id, hash of the text, digest of its shingle set (null if empty), band hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, bands = [], []
            for t in batch.column("_text"):
                grams = shingles(t.as_py(), size)
                nodes.append(hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else None)
                bands.append(signer.band_hashes(signer.sign(grams)) if len(grams) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_d"), batch.column("_t"), pa.array(nodes, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["_d", "_t", "node", "bands"]
            )

    return keyed(docs, doc_id, text).mapInArrow(run, "_d long, _t long, node binary, bands array<long>")


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    plain = text_of(text).cast("binary")
    return docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("_d"), F.xxhash64(plain).alias("_t"), plain.alias("_text"))


def linked(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Which of the sets (rows) are similar enough to which others (columns); right None: to each other."""
    sets = left + (right or [])
    sizes = np.array([len(x) for x in sets], np.float32)
    owner = np.repeat(np.arange(len(sets)), sizes.astype(np.int64))
    _, gram, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[gram] > 1
    owner, gram = owner[shared], np.unique(gram[shared], return_inverse=True)[1]
    order = np.argsort(gram, kind="stable")
    owner, gram = owner[order], gram[order]
    n = len(left)
    both = np.zeros((n, len(sets) - n if right is not None else n), np.float32)
    for first in range(0, int(gram[-1]) + 1 if len(gram) else 0, _COLUMNS):
        at = slice(*np.searchsorted(gram, (first, first + _COLUMNS)))
        has = np.zeros((len(sets), _COLUMNS), np.float32)
        has[owner[at], gram[at] - first] = 1
        both += has[:n] @ (has[n:] if right is not None else has).T
    other = sizes[n:] if right is not None else sizes
    return both >= threshold * (sizes[:n, None] + other[None, :] - both) - 1e-4


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n members the least member it is connected with by the links (a, b)."""
    label = np.arange(n)
    while True:
        fresh = label.copy()
        np.minimum.at(fresh, a, label[b])
        np.minimum.at(fresh, b, label[a])
        fresh = np.minimum(fresh, fresh[fresh])
        if (fresh == label).all():
            return label
        label = fresh


def _compared(members: DataFrame, size: int, threshold: float) -> DataFrame:
    """node, root, n: for each member of a group that has links, the least node it is connected with there and their number.

    members: band, x, y, side, node, bands, _text; a group is (band, x, y). If x and y differ, the
    members of side 0 meet those of side 1, else all meet all. A pair counts in the first of the
    bands that it shares.
    """
    names = ["band", "x", "y", "side", "node", "bands", "_text"]

    def settle(rows: list) -> pa.RecordBatch:
        across = rows[0][1] != rows[0][2]
        parts = [[r for r in rows if r[3] == 0], [r for r in rows if r[3] == 1]] if across else [rows, []]
        rows = parts[0] + parts[1]
        sets = [r[6] for r in rows]
        n = len(parts[0])
        if across and parts[0] and parts[1]:
            a, b = np.nonzero(linked(sets[:n], sets[n:], threshold))
            b = b + n
        elif across:
            a = b = np.empty(0, np.int64)
        else:
            a, b = np.nonzero(np.triu(linked(sets, None, threshold), 1))
        bands = np.array([r[5] for r in rows])
        first = bands[a, (bands[a] == bands[b]).argmax(1)] == rows[0][0] if len(a) else np.empty(0, bool)
        root = roots(a, b, len(rows))
        number = np.bincount(np.concatenate([a[first], b[first]]), minlength=len(rows))
        named = [r[4] for r in rows]
        least: dict[int, bytes] = {}
        for i, r in enumerate(root.tolist()):
            least[r] = min(least.get(r, named[i]), named[i])
        has = np.unique(np.concatenate([a, b]))
        return pa.RecordBatch.from_arrays(
            [pa.array([named[i] for i in has], pa.binary()), pa.array([least[int(root[i])] for i in has], pa.binary()), pa.array(number[has].astype(np.int64))], ["node", "root", "n"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if group and row[:3] != group[0][:3]:
                    if len(group) > 1:
                        yield settle(group)
                    group = []
                group.append((*row[:6], shingles(row[6], size)))
        if len(group) > 1:
            yield settle(group)

    return members.select(*names).repartition("band", "x", "y").sortWithinPartitions("band", "x", "y").mapInArrow(run, "node binary, root binary, n long")


def components(links: DataFrame) -> DataFrame:
    """node, class: the least node of each node's component. Least labels spread over links, and along labels."""
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    label = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("class")), "labels")
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "class"), "b").groupBy(F.col("a").alias("node")).agg(F.min("class").alias("_near"))
        spread = label.join(near, "node").select("node", F.least("class", "_near").alias("class"), F.col("class").alias("_old"))
        spread = stored(spread, "labels")
        if spread.filter(F.col("class") != F.col("_old")).isEmpty():
            return spread.select("node", "class")
        far = spread.select(F.col("node").alias("class"), F.col("class").alias("_far"))
        label = stored(spread.join(far, "class").select("node", F.least("class", "_far").alias("class")), "labels")


def _split(large: DataFrame, block: int) -> DataFrame:
    """Groups (band, x, y) in which the members of large buckets meet: band, node, x, y, side.

    large: band, at, node; at is the band's place. Each pair that shares no earlier band meets once.
    """
    own = large.groupBy("node").agg(F.collect_list(F.struct("at", "band")).alias("_own"))  # at most one for each band
    earlier = F.transform(F.filter("_own", lambda o: o["at"] < F.col("_o.at")), lambda o: o["band"])
    rows = stored(own.select("node", "_own", F.explode("_own").alias("_o")).select("_o.band", "node", earlier.alias("_earlier")), "large")
    shared = rows.select("band", F.explode("_earlier").alias("_e")).groupBy("band", "_e").agg(F.count("*").alias("n"))
    shared = shared.groupBy("band").agg(F.max(F.struct("n", "_e")).alias("_s")).select("band", F.col("_s._e").alias("_e"))
    inside = F.coalesce(F.array_contains("_earlier", F.col("_e")), F.lit(False))
    placed = stored(rows.join(shared, "band", "left").select("band", "node", inside.alias("inside")), "placed")
    counts = placed.groupBy("band").agg(F.count_if("inside").alias("_in"), F.count_if(~F.col("inside")).alias("_out")).filter("_out > 0")
    blocks = lambda n: F.ceil(F.col(n) / block).cast("int")
    rows = placed.join(counts, "band").select("band", "node", "inside", blocks("_in").alias("_in"), blocks("_out").alias("_out"))
    # outsiders' blocks are 0, 1, ..., those of the inside -1, -2, ...
    salt = lambda n: F.pmod(F.xxhash64("node"), F.greatest(F.col(n), F.lit(1)))
    own = F.when(F.col("inside"), -1 - salt("_in")).otherwise(salt("_out")).cast("int")
    others = F.when(F.col("inside"), F.sequence(F.lit(0), F.col("_out") - 1)).otherwise(F.sequence(-F.col("_in"), F.col("_out") - 1))
    rows = rows.withColumn("own", own).select("band", "node", "own", F.explode(others).alias("other"))
    x, y = F.least("own", "other"), F.greatest("own", "other")
    return rows.select("band", "node", x.alias("x"), y.alias("y"), F.when(F.col("own") == x, 0).otherwise(1).alias("side"))


def _join(nodes: DataFrame, texts_of, size: int, threshold: float, block: int) -> tuple[DataFrame, DataFrame]:
    """node, class of the nodes that have links; node, n_links. texts_of: (nodes) -> node, bands, _text."""
    met = nodes.select("node", F.posexplode("bands").alias("at", "band"))
    full = met.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    meetings = stored(met.join(full, "band"), "meetings")
    texts = stored(texts_of(meetings.select("node").distinct()), "texts")
    zero = F.lit(0)
    groups = meetings.filter(F.col("n") <= block).select("band", "node", zero.alias("x"), zero.alias("y"), zero.alias("side"))
    large = meetings.filter(F.col("n") > block)
    if not large.isEmpty():
        groups = groups.unionByName(_split(large, block))
    found = stored(_compared(groups.join(texts, "node"), size, threshold), "linked")
    edges = found.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).distinct()
    number = found.groupBy("node").agg(F.sum("n").alias("n_links"))
    return components(edges), number


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """doc_id, _t, class_id, n_links, n_copies, first for every row of docs.

    class_id: the least id in the row's class. n_links: the other shingle sets that were found
    similar enough to the row's, also in buckets above `block`. n_copies: rows with the same shingle
    set, itself included. first: whether the row, by id and text, is the one that stands for its class.

    Null, empty and wordless texts have no shingles: each is a class of its own by its id, without
    links. A null id is larger than all others; a class of such rows only has no id. Repeated rows
    are copies of each other. An empty table gives an empty result; other columns are ignored.
    """
    bands, rows = banding(threshold, recall)
    signed = stored(signatures(docs, doc_id, text, Signer(bands, rows), size), "signatures")
    nodes = stored(
        signed.filter("node is not null").groupBy("node").agg(F.min(F.struct("_d", "_t")).alias("rep"), F.count("*").alias("n_copies"), F.first("bands").alias("bands")), "nodes"
    )

    def texts_of(wanted: DataFrame) -> DataFrame:
        reps = stored(nodes.join(wanted, "node").select("node", "bands", "rep.*"), "reps")
        return keyed(docs, doc_id, text).join(reps, ["_d", "_t"]).dropDuplicates(["node"]).select("node", "bands", "_text")

    classes, number = _join(nodes, texts_of, size, threshold, block)
    found = nodes.select("node", "rep", "n_copies").join(classes, "node", "left").join(number, "node", "left")
    found = found.select("node", "rep", "n_copies", F.coalesce("class", "node").alias("class"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    found = stored(found, "found")
    heads = found.groupBy("class").agg(F.min("rep").alias("head"))
    known = found.join(heads, "class").select("node", "n_copies", "n_links", "head")
    known = stored(known, "known")
    rows = signed.select("_d", "_t", "node").join(known, "node", "left")
    own = F.struct("_d", "_t")
    rows = rows.withColumn("head", F.coalesce("head", own))
    return rows.select(
        F.nullif("_d", F.lit(LAST)).alias("doc_id"), "_t", F.nullif(F.col("head._d"), F.lit(LAST)).alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("n_copies", F.lit(1).cast("long")).alias("n_copies"),
        (F.col("head") == own).alias("first"),
    )


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs that stand for their classes, one for each class, all columns as they are.

    Of repeated rows that stand for a class, the first by their other columns stays.
    """
    inner, names, back = aside(docs)
    found = join(docs, doc_id, text, **options).filter("first").select(F.coalesce("doc_id", F.lit(LAST)).alias("_d"), "_t").distinct()
    found = stored(found, "firsts")
    marked = inner.withColumns({"_d": F.coalesce(F.col(names[doc_id]).cast("long"), F.lit(LAST)), "_t": F.xxhash64(text_of(names[text]).cast("binary"))})
    order = Window.partitionBy("_d", "_t").orderBy(*[F.col(n).cast("string") for c, n in names.items() if c != text])
    return back(marked.join(found, ["_d", "_t"]).withColumn("_n", F.row_number().over(order)).filter("_n = 1"))
