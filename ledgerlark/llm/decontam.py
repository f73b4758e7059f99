"""Benchmark decontamination: prefix-filtered join of item windows with whole documents.

An item's windows are runs of SIZE consecutive words; an item of fewer words is one window. To hold
a window, a document must hold all of its words, so it is enough to look for the rarest one, its
prefix token: document frequencies of the items' words are counted over all documents, and each
window waits at its rarest word. Where a document has that word, the position bound gives the one
place at which the window could begin and the length bound drops what would overrun the text; what
is left is verified word by word.

The items are the stated query set: they meet the documents in blocks of at most about BLOCK_WORDS
words, so what a task holds is bounded whatever the size of the benchmark, and documents are not
shuffled. With more than one block, the documents are written between blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import aside, text_of, word_hashes
from ledgerlark.operators.common import stored

SIZE = 10
BLOCK_WORDS = 500_000
IN_WORD = np.array([0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    return _WORDS.findall((text or "").encode("utf-8", "surrogatepass").translate(LOWER))


@dataclass
class Windows:
    """The distinct windows of a block of items."""

    words: list[tuple[bytes, ...]]
    items: list[set[str]]
    lengths: np.ndarray
    hashes: np.ndarray  # a row for each window, 0 beyond its length
    vocabulary: np.ndarray  # sorted word hashes


def windows_of(items: list[tuple[str, str | None]], size: int = SIZE) -> Windows:
    found: dict[tuple[bytes, ...], set[str]] = {}
    for item, text in items:
        words = words_of(text)
        for i in range(max(1, len(words) - size + 1)) if words else ():
            found.setdefault(tuple(words[i : i + size]), set()).add(item)
    hashes = np.zeros((len(found), size), np.uint64)
    for row, words in zip(hashes, found, strict=True):
        row[: len(words)] = word_hashes(b" ".join(words), IN_WORD)
    lengths = np.array([len(w) for w in found], np.int64)
    real = np.arange(size) < lengths[:, None]
    return Windows(list(found), list(found.values()), lengths, hashes, np.unique(hashes[real]))


@dataclass
class Index:
    """For each prefix token (sorted): its windows and where in them it stands."""

    tokens: np.ndarray
    first: np.ndarray
    window: np.ndarray
    offset: np.ndarray


def index_of(windows: Windows, frequency: np.ndarray) -> Index:
    """Windows by their rarest word (ties: the first in hash order)."""
    at = np.searchsorted(windows.vocabulary, windows.hashes)
    at[at == len(windows.vocabulary)] = 0
    rarity = frequency[at].astype(np.float64) if len(frequency) else np.zeros(at.shape)
    rarity[np.arange(windows.hashes.shape[1]) >= windows.lengths[:, None]] = np.inf
    offset = rarity.argmin(1) if len(rarity) else np.empty(0, np.int64)
    token = windows.hashes[np.arange(len(offset)), offset]
    order = np.argsort(token, kind="stable")
    tokens, first = np.unique(token[order], return_index=True)
    return Index(tokens, np.append(first, len(order)), order, offset[order])


def places(values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the values that are in the sorted array, and their places there."""
    if not len(wanted) or not len(values):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.searchsorted(wanted, values)
    at[at == len(wanted)] = 0
    hit = np.flatnonzero(wanted[at] == values)
    return hit, at[hit]


def matches(hashes: np.ndarray, windows: Windows, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """Starts and windows whose word hashes agree at every place."""
    at, token = places(hashes, index.tokens)
    if not len(at):
        return at, token
    many = index.first[token + 1] - index.first[token]
    slot = np.repeat(index.first[token] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    window, start = index.window[slot], np.repeat(at, many) - index.offset[slot]
    fits = (start >= 0) & (start + windows.lengths[window] <= len(hashes))
    window, start = window[fits], start[fits]
    for i in range(windows.hashes.shape[1]):
        if not len(window):
            break
        short = windows.lengths[window] <= i
        same = hashes[np.minimum(start + i, len(hashes) - 1)] == windows.hashes[window, i]
        window, start = window[short | same], start[short | same]
    return start, window


def hits(text: str | None, windows: Windows, index: Index) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, hit runs of words as (start, end), and the items whose windows occur."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(LOWER)
    hashes = word_hashes(data, IN_WORD)
    start, window = matches(hashes, windows, index)
    if not len(start):
        return len(hashes), [], set()
    words, spans, items = _WORDS.findall(data), [], set()
    for s, w in sorted(zip(start.tolist(), window.tolist(), strict=True)):
        if tuple(words[s : s + len(windows.words[w])]) == windows.words[w]:
            items |= windows.items[w]
            spans.append((s, s + len(windows.words[w])))
    return len(hashes), merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _frequency(docs: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """In how many documents each word of the vocabulary is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for text in batch.column(0):
                hashes = word_hashes(text.as_py().translate(LOWER), IN_WORD)
                counts[np.unique(places(hashes, vocabulary)[1])] += 1
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(counts[seen], pa.int64())], ["word", "n"])

    rows = docs.select(F.col("_text").cast("binary").alias("_text")).mapInArrow(run, "word long, n long")
    out = np.zeros(len(vocabulary), np.int64)
    for row in rows.groupBy("word").agg(F.sum("n").alias("n")).collect():  # at most the words of a block
        out[row["word"]] = row["n"]
    return out


def _mark(docs: DataFrame, windows: Windows, index: Index) -> DataFrame:
    """Add a block's hits to `_spans`, `_items` and `_n_words`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, spans, items = [], [], []
            texts, old_spans, old_items = (batch.column(c) for c in ("_text", "_spans", "_items"))
            for i in range(batch.num_rows):
                n, s, k = hits(texts[i].as_py(), windows, index)
                before = old_spans[i].as_py()
                s = merged([*zip(before[0::2], before[1::2], strict=True), *s])
                counts.append(n)
                spans.append([x for span in s for x in span])
                items.append(sorted({*old_items[i].as_py(), *k}))
            done = {"_n_words": pa.array(counts, pa.int64()), "_spans": pa.array(spans, pa.list_(pa.int64())), "_items": pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([done.get(c, batch.column(c)) for c in batch.schema.names], batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def _scanned(docs: DataFrame, benchmark: DataFrame, text: str, item_id: str, item_text: str, size: int, block_words: int) -> DataFrame:
    """docs with `_text`, `_n_words`, `_spans` and `_items`."""
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), F.col(item_text).alias("words"))
    amount = items.agg(F.sum(F.length("words")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-amount // (6 * block_words)))
    rows = docs.withColumns({
        "_text": text_of(text), "_n_words": F.lit(0).cast("long"),
        "_spans": F.array().cast("array<bigint>"), "_items": F.array().cast("array<string>"),
    })
    for b in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == b)
        windows = windows_of([tuple(r) for r in part.collect()], size)
        index = index_of(windows, _frequency(rows, windows.vocabulary))
        rows = _mark(rows, windows, index)
        if b + 1 < blocks:
            rows = stored(rows, "marked")
    return rows


def scan(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = SIZE, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (ids as sorted strings), spans (start and end of the hit runs of words, one after the other).

    Null and empty texts have no words and are never hit; items without words have no window. An
    item without id goes by the id `null`; repeated items count once. Repeated documents are
    marked alike. With an empty benchmark nothing is hit; no documents give no rows. Other columns
    are ignored and long texts are read whole.
    """
    rows = _scanned(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), benchmark, "text", item_id, item_text, size, block_words)
    total = lambda first: F.aggregate(
        F.filter("_spans", lambda _, i: i % 2 == first), F.lit(0).cast("long"), lambda acc, x: acc + x
    )
    return rows.select(
        "doc_id", F.col("_n_words").alias("n_words"), (total(1) - total(0)).alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
        F.col("_items").alias("items"), F.col("_spans").alias("spans"),
    )


def drop(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = SIZE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs in which no window of an item occurs, all columns as they are."""
    inner, names, back = aside(docs)
    return back(_scanned(inner, benchmark, names[text], item_id, item_text, size, block_words).filter(F.size("_items") == 0))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS n, list_slice(w, i, i + least(len(w), 10) - 1) AS x
       FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
x AS (SELECT r, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM d),
ten AS (
  SELECT r, i, [a, lead(a, 1) OVER p, lead(a, 2) OVER p, lead(a, 3) OVER p, lead(a, 4) OVER p, lead(a, 5) OVER p, lead(a, 6) OVER p, lead(a, 7) OVER p, lead(a, 8) OVER p, lead(a, 9) OVER p] AS t
  FROM x WINDOW p AS (PARTITION BY r ORDER BY i)),
dw AS (SELECT r, i, n, list_slice(t, 1, n) AS x FROM ten, sizes WHERE t[1] IN (SELECT x[1] FROM bw) AND t[n] IS NOT NULL),
hit AS (SELECT dw.r, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.n = bw.n AND dw.x = bw.x),
words AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
       sha256(coalesce(items.s, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
