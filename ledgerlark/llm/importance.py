"""Target-distribution importance resampling with hashed n-gram features.

Features are runs of one to three words; a feature's bucket is the CRC-32 of its bytes. CRC-32 is
linear: the checksum of a string is the XOR of what each byte adds for its value and its distance from
the end, and of a constant for the length. A table of these contributions is made once. The three
features that end at a word lie in one another, so their checksums come from the same looked-up bytes: the
contributions of a word, as seen from the end of itself, of the next word and of the one after, are
folded by bitwise_xor.reduceat over the words, and sums over one, two and three words are the features.
A feature longer than the table is folded block by block, the sum so far as four bytes before the next.

Counts by bucket are summed in the tasks, then over them; the logarithms of their ratios weigh the
documents. Gumbel noise, seeded by the id, makes the draw of the highest scores one without replacement
in proportion to the weights. Ranks come from a range sort over all tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import aside, word_spans
from ledgerlark.operators.common import number_rows, stored

WORDS, BUCKETS = 3, 10_000
LEAST_WORDS, PERCENT = 20, 5
SEED = 42
#: distances from the end in the table
REACH = 512
#: bytes of text that are worked on at once; documents share a block and long ones take several
BLOCK = 1 << 20
IN_WORD = np.array([0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
POLYNOMIAL = 0xEDB88320
ONES = np.uint32(0xFFFFFFFF)
LAST = 2**63 - 1


class PositionTable:
    """What each byte value adds to a CRC-32 at each distance from the end, and what each length adds."""

    def __init__(self, reach: int = REACH) -> None:
        self.reach = reach
        step = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            step = np.where(step & 1, (step >> 1) ^ np.uint32(POLYNOMIAL), step >> 1)
        # row d + 1 is for the byte with d bytes after it; row 0, for what lies outside, adds nothing
        self.rows = np.zeros((reach + 5, 256), np.uint32)
        self.rows[1] = step
        for d in range(2, reach + 5):
            self.rows[d] = (self.rows[d - 1] >> 8) ^ step[self.rows[d - 1] & 0xFF]
        self.flat = self.rows.ravel()
        self.lengths = np.zeros(reach + 1, np.uint32)  # the checksum of so many zero bytes
        state = ONES
        for n in range(1, reach + 1):
            state = (state >> np.uint32(8)) ^ step[int(state) & 0xFF]
            self.lengths[n] = state ^ ONES

    def crc(self, data: np.ndarray) -> int:
        """The checksum of one string of any length, block by block."""
        n = len(data)
        if n <= self.reach:
            return int(np.bitwise_xor.reduce(self.rows[np.arange(n, 0, -1), data])) ^ int(self.lengths[n])
        # the first block takes what is over, four bytes at least, so that the state lies before it as four bytes
        first = (n - 4) % self.reach + 4
        starts = np.append(0, np.arange(first, n, self.reach))
        ends = np.append(starts[1:], n)
        after = np.repeat(ends, ends - starts) - np.arange(n)
        parts = np.bitwise_xor.reduceat(self.rows[after, data], starts)
        state = int(ONES)
        for part, size in zip(parts.tolist(), (ends - starts).tolist(), strict=True):
            for k in range(4):
                part ^= int(self.rows[size - k, state >> 8 * k & 0xFF])
            state = part
        return state ^ int(ONES)


@lru_cache(1)
def table_of(reach: int = REACH) -> PositionTable:
    return PositionTable(reach)


def checksums(data: bytes, count: int = WORDS, table: PositionTable | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """First bytes of the words of lower-case text, and for each run length the checksums of the runs that end at each word.

    Entry e of run length k + 1 is for the words e to e + k, laid side by side with one space.
    """
    table = table or table_of()
    whole = np.frombuffer(data, np.uint8)
    starts, ends = word_spans(whole, IN_WORD)
    n, sizes = len(starts), ends - starts
    if not n:
        return starts, [np.empty(0, np.uint32)] * count
    first = np.cumsum(sizes + 1) - (sizes + 1)  # of each word in the text of words and single spaces
    last = first + sizes
    plain = np.full(int(last[-1]) + 1, 0x20, np.uint8)
    plain[np.arange(int(sizes.sum())) + np.repeat(np.arange(n), sizes)] = whole[IN_WORD[whole]]
    places = np.arange(len(plain), dtype=np.int64)
    out, above = [], []
    for k in range(min(count, n)):
        m = n - k
        size = int(last[m - 1]) + 1
        after = np.repeat(last[k:], sizes[:m] + 1) - places[:size]
        length = last[k:] - first[:m]
        after[after > table.reach] = 0  # of long features, which are done below
        part = np.bitwise_xor.reduceat(table.flat.take(after * 256 + plain[:size]), first[:m])
        # add the runs that are one word shorter and end at the same word
        total = part if not above else part ^ above[-1][1:]
        above.append(total)
        done = total ^ table.lengths[np.minimum(length, table.reach)]
        for e in np.flatnonzero(length > table.reach).tolist():
            done[e] = table.crc(plain[first[e] : last[e + k]])
        out.append(done)
    return starts, out + [np.empty(0, np.uint32)] * (count - len(out))


def blocks(texts: list[bytes], block: int = BLOCK, count: int = WORDS) -> Iterator[tuple[bytes, np.ndarray, int]]:
    """The texts in blocks: bytes, where in them each next text begins, and how many words of the block are known already.

    Small texts share a block, with a byte between them that no word has. A text above the size is cut
    between words, and a block after the first begins with the last words of the one before.
    """
    held: list[bytes] = []
    amount = 0

    def joined() -> tuple[bytes, np.ndarray, int]:
        return b"\0".join(held), np.cumsum([0, *(len(t) + 1 for t in held)])[:-1], 0

    for text in texts:
        if len(text) > block:
            if held:
                yield joined()
                held, amount = [], 0
            yield from _cut(text, block, count)
            continue
        held.append(text)
        amount += len(text) + 1
        if amount > block:
            yield joined()
            held, amount = [], 0
    if held:
        yield joined()


def _cut(text: bytes, block: int, count: int) -> Iterator[tuple[bytes, np.ndarray, int]]:
    """One text in blocks; the first has it as a new text, the others go on with it (no text begins there)."""
    whole = np.frombuffer(text, np.uint8)
    at, known = 0, []
    while at < len(text):
        end = min(at + block, len(text))
        while end < len(text) and IN_WORD[whole[end]]:
            end += 1
        piece = text[at:end]
        prefix = b" ".join([*known, b""])
        yield prefix + piece, np.zeros(0 if at else 1, np.int64), len(known)
        starts, ends = word_spans(np.frombuffer(prefix + piece, np.uint8), IN_WORD)
        known = [(prefix + piece)[s:e] for s, e in zip(starts[1 - count :].tolist(), ends[1 - count :].tolist(), strict=True)] if count > 1 else []
        at = end


def features(texts: list[bytes], count: int = WORDS, block: int = BLOCK, table: PositionTable | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each block of the texts: checksums of the features, which text each belongs to, and which text each word belongs to."""
    begun = 0
    for data, begins, known in blocks(texts, block, count):
        starts, sums = checksums(data, count, table)
        text_of = begun + np.searchsorted(begins, starts, "right") - 1
        parts, owners = [], []
        for k, crc in enumerate(sums):
            ends = text_of[k:][: len(crc)] if len(crc) else text_of[:0]
            own = text_of[: len(crc)] == ends
            own[: max(0, known - k)] = False  # the block before has them
            parts.append(crc[own])
            owners.append(ends[own])
        begun += len(begins)
        yield np.concatenate(parts), np.concatenate(owners), text_of[known:]


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS, words: int = WORDS, block: int = BLOCK) -> np.ndarray:
    """How many features fall into each bucket, over all texts. The tasks send at most `buckets` numbers each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for crc, _, _ in features(_lowered(batch.column(0)), words, block):
                total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], ["bucket", "n"])

    rows = texts.select(F.col(text).cast("string").cast("binary").alias("_text")).mapInArrow(run, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for row in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most `buckets`
        out[row["bucket"]] = row["n"]
    return out


def _lowered(column: pa.Array) -> list[bytes]:
    return [(t.as_py() or b"").translate(LOWER) for t in column]


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of how much likelier each bucket is in the target, by smoothed shares, rounded down."""
    all_source, all_target, n = int(source.sum()), int(target.sum()), len(source)
    return np.array([
        math.floor(1000 * math.log((t + 1) * (all_source + n) / ((s + 1) * (all_target + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)
    ], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, text: str = "text", words: int = WORDS, block: int = BLOCK) -> DataFrame:
    """docs with n_words, n_features and weight, the sum of the gains of the features, in the place of the text."""
    fields = [f for f in docs.schema.fields if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = np.uint32(len(gain))
        for batch in batches:
            many, total, counted = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            texts = _lowered(batch.column(batch.schema.get_field_index(text)))
            for crc, owner, word_owner in features(texts, words, block):
                counted += np.bincount(owner, minlength=len(counted))
                np.add.at(total, owner, gain[crc % buckets])
                many += np.bincount(word_owner, minlength=len(many))
            kept = [batch.column(batch.schema.get_field_index(f.name)) for f in fields]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(many), pa.array(counted), pa.array(total)], [*(f.name for f in fields), "n_words", "n_features", "weight"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "n_words long", "n_features long", "weight long"])
    return docs.withColumn(text, F.col(text).cast("string").cast("binary")).mapInArrow(run, schema)


def noise(doc_id: str, seed: int = SEED) -> Column:
    """Thousandths of Gumbel noise from 32 hash bits of the id, rounded down."""
    bits = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((bits + 0.5) / 4294967296.0)))


def learn(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", buckets: int = BUCKETS, words: int = WORDS, block: int = BLOCK) -> np.ndarray:
    """The gain of each bucket, from all of docs and all of the target."""
    return gains(bucket_counts(docs.select(text), text, buckets, words, block), bucket_counts(target.select(target_text), target_text, buckets, words, block))


def _scored(rows: DataFrame, gain: np.ndarray, doc_id: str, text: str, seed: int, words: int, block: int) -> DataFrame:
    return weighed(rows, gain, text, words, block).withColumn("score", F.col("weight") + noise(doc_id, seed))


def resample(
    docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = PERCENT, least: int = LEAST_WORDS,
    seed: int = SEED, buckets: int = BUCKETS, words: int = WORDS, block: int = BLOCK, gain: np.ndarray | None = None,
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank for every row of docs; rank is null where it is not drawn.

    Drawn are `percent` in a hundred of the rows with at least `least` words, rounded down: those of the
    highest scores, ties by the smaller id, a null id last. Null and empty texts have no features and
    weight 0, and are drawn only if `least` is 0. Repeated rows score alike and are ranked one after
    the other. With an empty target the gains only favour what is rare in docs; no documents
    give no rows. Other columns are ignored; texts are read whole. gain: what `learn` returned before.
    """
    gain = learn(docs, target, text, target_text, buckets, words, block) if gain is None else gain
    rows = _scored(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")), gain, "doc_id", "_text", seed, words, block)
    order = {"_all": F.lit(0), "_short": F.col("n_words") < least, "_minus": -F.col("score"), "_nameless": F.col("doc_id").isNull(), "_name": F.col("doc_id")}
    rows = stored(rows.withColumns(order), "weighed")
    drawn = rows.filter(~F.col("_short")).count() * percent // 100
    placed = number_rows(rows, "_all", ["_short", "_minus", "_nameless", "_name", "n_words"], "_place")
    rank = F.when((F.col("_place") <= drawn) & ~F.col("_short"), F.col("_place").cast("long"))
    return placed.select("doc_id", "n_words", "n_features", "weight", "score", rank.alias("rank"))


def draw(
    docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = PERCENT, least: int = LEAST_WORDS,
    seed: int = SEED, buckets: int = BUCKETS, words: int = WORDS, block: int = BLOCK,
) -> DataFrame:
    """The rows of docs that `resample` draws, all columns as they are.

    The last drawn score and id are one row; every row not behind them is drawn, so texts are not
    shuffled. Rows that repeat the last drawn id and score are drawn with it.
    """
    inner, names, back = aside(docs)
    at, where = names[doc_id], names[text]
    gain = learn(inner, target, where, target_text, buckets, words, block)
    places = resample(inner, target, at, where, target_text, percent, least, seed, buckets, words, block, gain)
    end = places.filter("rank is not null").agg(F.max(F.struct("rank", "score", "doc_id")).alias("end")).first()["end"]
    if end is None:
        return docs.limit(0)
    rows = _scored(inner.withColumn("_text", F.col(where)), gain, at, "_text", seed, words, block).filter(F.col("n_words") >= least)
    before = F.lit(True) if end["doc_id"] is None else F.coalesce(F.col(at) <= end["doc_id"], F.lit(False))
    return back(rows.filter((F.col("score") > end["score"]) | ((F.col("score") == end["score"]) & before)))
