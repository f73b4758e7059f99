"""Language-model scores by deleted interpolation.

The probability of a token mixes maximum-likelihood estimates of n-grams, from the longest down to the
single token, and a uniform share for unknown ones. The mixture weights go by buckets of context
frequency, powers of two. One training text in DELETED is kept apart: its n-grams are the held-out counts
from which expectation-maximisation learns the weights, against estimates from which its own
counts are deducted. Scores then use the counts of all training texts with these weights.

Counts grow with the corpus and are never collected; they stay where Spark shuffles them:

1. Chunks. A task packs its texts into chunks of about CHUNK bytes, those kept apart into chunks of
   their own, and writes them: the vocabulary as hashes, the tokens as numbers into it.
2. Entries. Each chunk lists its distinct n-grams by hash and sends them in cells of equal hash
   ranges, with how often its training texts have them. A cell of a chunk is one row of compressed
   differences; a frequent n-gram is one entry of a chunk, so no key is hot.
3. Totals. The entries of a cell from all chunks meet in a task, which adds them up and answers each
   chunk with the totals, in the order in which it asked. There are more cells where there are more
   tokens, so that a cell stays small.
4. Scores. Each chunk meets its answers; a token finds its counts by its place among the entries.

Hashes of tokens have 64 bits. Those of longer n-grams have SHORT_BITS and as many as number the cells: with
c cells, about c / 16 pairs of n-grams in the whole corpus count as one by chance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import gram_hashes, text_of, word_hashes
from ledgerlark.operators.common import stored

ORDER = 3
#: one training text in so many is kept apart for the mixture weights
DELETED = 20
ROUNDS = 15
#: buckets of context frequency: 0, 1, 2 to 3, 4 to 7 and so on, the last without end
BUCKETS = 24
SMOOTH = 0.1
#: bytes of text in a chunk, one text at least; entries of a cell, as a power of two, that are aimed at
CHUNK, CELL_BITS = 8 << 20, 18
#: tokens, as a power of two, whose entries a task settles
TASK_BITS = 19
LEAST_CELL_BITS, MOST_CELL_BITS, SHORT_BITS = 6, 30, 38
IN_WORD = np.array([b != 0x20 and not 0x09 <= b <= 0x0D for b in range(256)])
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: two bytes that no text has stand for the end of a text and for what is before its first token
END_BYTE, START_BYTE = b"\xff", b"\xfe"
END, START = (word_hashes(b, IN_WORD)[0] for b in (END_BYTE, START_BYTE))
OTHER, TRAIN, APART = 0, 1, 2


# ---- chunks --------------------------------------------------------------------------------


def packed(values: np.ndarray) -> bytes:
    """Numbers with all first bytes first, then all second ones, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes.T).tobytes())


def unpacked(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, len(raw) // size).T).view(kind).ravel()


def rising(values: np.ndarray) -> bytes:
    """Sorted hashes by their differences."""
    return packed(np.diff(values, prepend=np.uint64(0)))


def risen(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, np.uint64), dtype=np.uint64)


def tokens_of(texts: list[bytes]) -> np.ndarray:
    """Hashes of the tokens of lower-case texts, each text with its end."""
    gap = b" " + END_BYTE + b" "
    return word_hashes(gap.join([*texts, b""]), IN_WORD)


_CHUNK = pa.schema([
    ("chunk", pa.int64()), ("apart", pa.bool_()), ("ids", pa.list_(pa.int64())), ("kinds", pa.binary()), ("n_tokens", pa.int64()), ("train_tokens", pa.int64()),
    ("train_docs", pa.int64()), ("words", pa.binary()), ("tokens", pa.binary()),
])
_CHUNK_SQL = "chunk long, apart boolean, ids array<long>, kinds binary, n_tokens long, train_tokens long, train_docs long, words binary, tokens binary"


@dataclass
class Held:
    """Texts that wait for their chunk to fill."""

    apart: bool
    ids: list[int | None] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    texts: list[bytes] = field(default_factory=list)
    amount: int = 0

    def add(self, doc_id: int | None, kind: int, text: bytes) -> None:
        self.ids.append(doc_id)
        self.kinds.append(kind)
        self.texts.append(text)
        self.amount += len(text) + 1

    def chunk(self, name: int) -> pa.RecordBatch:
        hashes = tokens_of(self.texts)
        words, at = np.unique(hashes, return_inverse=True)
        many = np.diff(np.flatnonzero(hashes == END), prepend=-1)
        learns = np.array(self.kinds) != OTHER
        row = [name, self.apart, self.ids, bytes(self.kinds), len(hashes), int(many[learns].sum()), int(learns.sum()), rising(words), packed(at.astype(np.int32))]
        self.ids, self.kinds, self.texts, self.amount = [], [], [], 0
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _CHUNK, strict=True)], schema=_CHUNK)


def chunks(docs: DataFrame, learn: Column, doc_id: str, text: str, deleted: int, size: int) -> DataFrame:
    """The texts of docs as chunks."""
    place = F.pmod(F.xxhash64(F.col(doc_id), F.col(text)), F.lit(deleted))
    kind = F.when(~F.coalesce(learn, F.lit(False)), OTHER).when(place == 0, APART).otherwise(TRAIN)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), kind.alias("kind"), text_of(text).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, name = (Held(False), Held(True)), TaskContext.get().partitionId() << 32
        for batch in batches:
            for i, k, t in zip(*(batch.column(c) for c in ("doc_id", "kind", "text")), strict=True):
                kind = k.as_py()
                into = held[kind == APART]
                into.add(i.as_py(), kind, t.as_py().translate(LOWER))
                if into.amount >= size:
                    yield into.chunk(name)
                    name += 1
        for into in held:
            if into.texts:
                yield into.chunk(name)
                name += 1

    return rows.mapInArrow(run, _CHUNK_SQL)


# ---- n-grams of a chunk --------------------------------------------------------------------


@dataclass
class Grams:
    """The tokens of a chunk, and for each order the sorted distinct hashes and where each token's n-gram is among them."""

    ends: np.ndarray  # the last token of each text
    keys: list[np.ndarray]
    places: list[np.ndarray]


def grams_of(words: bytes, tokens: bytes, order: int, bits: int) -> Grams:
    vocabulary, at = risen(words), unpacked(tokens, np.int32)
    hashes = vocabulary[at]
    ends = np.flatnonzero(hashes == END)
    firsts = np.append(0, ends[:-1] + 1)
    # order - 1 starts before each text, so that no n-gram has tokens of two texts
    wide = np.insert(hashes, np.repeat(firsts, order - 1), START)
    spot = np.arange(len(hashes)) + (order - 1) * (1 + np.searchsorted(ends, np.arange(len(hashes))))
    keys, places = [vocabulary], [at]
    for k in range(2, order + 1):
        short = gram_hashes(wide, k)[spot - k + 1] >> np.uint64(max(0, 64 - SHORT_BITS - bits))
        found, place = np.unique(short, return_inverse=True)
        keys.append(found)
        places.append(place.astype(np.int32))
    return Grams(ends, keys, places)


def width_of(k: int, bits: int) -> int:
    """Bits of the hashes of n-grams of k tokens."""
    return 64 if k == 1 else min(64, SHORT_BITS + bits)


def cells_of(keys: np.ndarray, k: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The cells of sorted keys, and where the keys of each begin and the last ones end."""
    cells = keys >> np.uint64(width_of(k, bits) - bits)
    first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
    return cells[first].astype(np.int32), np.append(first, len(keys))


def entries(packs: DataFrame, order: int, bits: int) -> DataFrame:
    """n, cell, chunk, apart, keys, counts: the n-grams of each chunk by cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                grams = grams_of(row["words"], row["tokens"], order, bits)
                learns = np.repeat(np.frombuffer(row["kinds"], np.uint8) != OTHER, np.diff(grams.ends, prepend=-1))
                for k, (keys, places) in enumerate(zip(grams.keys, grams.places, strict=True), 1):
                    counts = np.bincount(places[learns], minlength=len(keys)).astype(np.int32)
                    some, cut = cells_of(keys, k, bits)
                    spans = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(some), k, np.int32)), pa.array(some), pa.array(np.full(len(some), row["chunk"])), pa.array([row["apart"]] * len(some), pa.bool_()),
                            pa.array([rising(keys[a:b]) for a, b in spans], pa.binary()), pa.array([packed(counts[a:b]) for a, b in spans], pa.binary()),
                        ],
                        ["n", "cell", "chunk", "apart", "keys", "counts"],
                    )

    return packs.select("chunk", "apart", "kinds", "words", "tokens").mapInArrow(run, "n int, cell int, chunk long, apart boolean, keys binary, counts binary")


def answers(sent: DataFrame, tasks: int | None = None) -> DataFrame:
    """n, cell, chunk, totals, deducted: for the entries of a chunk in a cell, how often all training texts and those kept apart have them.

    `deducted` is for chunks of texts kept apart only. One more row of each cell, without a chunk, has the
    number of its n-grams that training texts have in `known`. A task sends its rows to Python in batches as large as
    itself, so it should have few cells: `tasks` says over how many they are spread.
    """

    def settle(rows: list[dict]) -> pa.RecordBatch:
        keys, counts = [risen(r["keys"]) for r in rows], [unpacked(r["counts"], np.int32) for r in rows]
        cut = np.cumsum([0, *map(len, keys)])
        found, at = np.unique(np.concatenate(keys), return_inverse=True)
        amount = np.concatenate(counts).astype(np.float64)  # sums stay below 2**53
        apart = np.repeat([r["apart"] for r in rows], np.diff(cut))
        totals, deducted = (np.bincount(at, x, len(found)).astype(np.int64) for x in (amount, amount * apart))
        out = {"n": [], "cell": [], "chunk": [], "totals": [], "deducted": [], "known": []}
        for r, a, b in zip(rows, cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            out["chunk"].append(r["chunk"])
            out["totals"].append(packed(totals[at[a:b]]))
            out["deducted"].append(packed(deducted[at[a:b]]) if r["apart"] else None)
        out["chunk"].append(None)
        out["totals"].append(None)
        out["deducted"].append(None)
        size = len(rows) + 1
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[0]["n"]] * size, pa.int32()), pa.array([rows[0]["cell"]] * size, pa.int32()), pa.array(out["chunk"], pa.int64()),
                pa.array(out["totals"], pa.binary()), pa.array(out["deducted"], pa.binary()), pa.array([0] * len(rows) + [int((totals > 0).sum())], pa.int64()),
            ],
            list(out),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for at in range(batch.num_rows):
                row = {c: batch.column(c)[at].as_py() for c in ("n", "cell", "chunk", "apart", "keys", "counts")}
                if held and (row["n"], row["cell"]) != (held[0]["n"], held[0]["cell"]):
                    yield settle(held)
                    held = []
                held.append(row)
        if held:
            yield settle(held)

    rows = sent.repartition(*([tasks] if tasks else []), "n", "cell").sortWithinPartitions("n", "cell", "chunk")
    return rows.mapInArrow(run, "n int, cell int, chunk long, totals binary, deducted binary, known long")


# ---- the model -----------------------------------------------------------------------------


@dataclass
class Sizes:
    """Training tokens, training texts and known tokens (distinct); of tokens and texts also those kept apart."""

    tokens: int
    docs: int
    known: int
    apart_tokens: int = 0
    apart_docs: int = 0


@dataclass
class Found:
    """For each token of a chunk: the single token's count, and for each order the maximum-likelihood estimate and the bucket of its context."""

    ends: np.ndarray
    counts: np.ndarray
    estimates: list[tuple[np.ndarray, np.ndarray]]


def bucket_of(contexts: np.ndarray) -> np.ndarray:
    """0 for an unknown context, 1 for one seen once, 2 for two or three times, and so on."""
    return np.minimum(np.frexp(contexts.astype(np.float64))[1], BUCKETS - 1).astype(np.int8)


def found(row: dict, replies: pa.Table, order: int, bits: int, sizes: Sizes, deduct: bool) -> Found:
    """Counts of a chunk from its answers; deduct: without the texts kept apart. Single tokens share one bucket."""
    grams = grams_of(row["words"], row["tokens"], order, bits)
    by: dict[int, list[tuple[int, bytes, bytes]]] = {}
    for reply in replies.select(["n", "cell", "totals", "deducted"]).to_pylist():
        by.setdefault(reply["n"], []).append((reply["cell"], reply["totals"], reply["deducted"]))
    firsts = np.append(0, grams.ends[:-1] + 1)
    docs = sizes.docs - (sizes.apart_docs if deduct else 0)
    tokens = sizes.tokens - (sizes.apart_tokens if deduct else 0)
    single, count, out = None, None, []
    for k, place in enumerate(grams.places, 1):
        parts = sorted(by[k], key=lambda x: x[0])
        total = np.concatenate([unpacked(x, np.int64) for _, x, _ in parts])
        if deduct:
            total = total - np.concatenate([unpacked(x, np.int64) for _, _, x in parts])
        if k == 1:
            context = np.full(len(place), tokens)
        else:
            # the n-gram without its last token is the shorter n-gram of the token before; at first tokens it is made of starts
            context = np.append(docs, count[:-1])
            context[firsts] = docs
        count = total[place]
        single = count if k == 1 else single
        share = np.divide(count, context, out=np.zeros(len(count)), where=context > 0)
        out.append((share, bucket_of(context) if k > 1 else (context > 0).astype(np.int8)))
    return Found(grams.ends, single, out)


def mixed(parts: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, known: int) -> np.ndarray:
    """Probabilities of the tokens. An unknown context (bucket 0) leaves all to the shorter one."""
    p = np.full(len(parts[0][0]), 1 / (known + 1))
    for (share, bucket), weight in zip(parts, weights, strict=True):
        w = weight[bucket]
        p = w * share + (1 - w) * p
    return p


def start_weights(order: int) -> np.ndarray:
    weights = np.full((order, BUCKETS), 0.5)
    weights[:, 0] = 0
    return weights


def expected(parts: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, known: int) -> tuple[np.ndarray, np.ndarray]:
    """By order and bucket: expected tokens that come from the order's estimate, and that come from it or shorter ones."""
    hits, seen = np.zeros(weights.shape), np.zeros(weights.shape)
    lower = [np.full(len(parts[0][0]), 1 / (known + 1))]
    for (share, bucket), weight in zip(parts, weights, strict=True):
        w = weight[bucket]
        lower.append(w * share + (1 - w) * lower[-1])
    reach = np.ones(len(lower[0]))  # the chance that a token comes from this order or a shorter one
    for k in range(len(parts) - 1, -1, -1):
        share, bucket = parts[k]
        mine = weights[k][bucket] * share / lower[k + 1] * reach
        hits[k] = np.bincount(bucket, mine, BUCKETS)
        seen[k] = np.bincount(bucket, reach, BUCKETS)
        reach = reach - mine
    return hits, seen


def improved(hits: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """New weights from expected counts, with half a token for either side, so none is 0 or 1 but those of unknown contexts."""
    weights = (hits + 0.5) / (seen + 1)
    weights[:, 0] = 0
    return weights


def learn_weights(events: DataFrame, order: int, known: int, rounds: int) -> np.ndarray:
    """Expectation-maximisation over the tokens of texts kept apart; each round adds up two small tables over the tasks."""
    weights = start_weights(order)
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], weights=weights) -> Iterator[pa.RecordBatch]:
            hits, seen = np.zeros(weights.shape), np.zeros(weights.shape)
            for batch in batches:
                parts = [(batch.column(f"f{k}").to_numpy(), batch.column(f"b{k}").to_numpy().astype(np.int64)) for k in range(1, order + 1)]
                h, s = expected(parts, weights, known)
                hits, seen = hits + h, seen + s
            cell = np.flatnonzero(seen.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(hits.ravel()[cell]), pa.array(seen.ravel()[cell])], ["cell", "hits", "seen"])

        hits, seen = np.zeros(weights.size), np.zeros(weights.size)
        for row in events.mapInArrow(run, "cell long, hits double, seen double").groupBy("cell").agg(F.sum("hits").alias("hits"), F.sum("seen").alias("seen")).collect():
            hits[row["cell"]], seen[row["cell"]] = row["hits"], row["seen"]
        weights = improved(hits.reshape(weights.shape), seen.reshape(weights.shape))
    return weights


def _together(packs: DataFrame, replies: DataFrame, work, schema: str) -> DataFrame:
    """work(chunk, its answers) for every chunk."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return work(left.to_pylist()[0], right)

    held = packs.select("chunk", "ids", "kinds", "words", "tokens")
    return held.groupBy("chunk").cogroup(replies.select("chunk", "n", "cell", "totals", "deducted").groupBy("chunk")).applyInArrow(run, schema)


def score(
    docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", order: int = ORDER, deleted: int = DELETED, rounds: int = ROUNDS, chunk: int = CHUNK, cell_bits: int = CELL_BITS
) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for every row of docs.

    learn: a condition on docs for the rows to learn from. Scores are log10 probabilities of whole texts,
    their ends included; base_score is that of single tokens with SMOOTH added to each count. Null and
    empty texts are an end alone. Repeated rows score alike and count as often as they stand there; rows
    without id are scored, too. With no row to learn from, every probability is 1 divided by the one
    unknown token. An empty table gives an empty result; other columns are ignored. Memory is
    bounded by a chunk or the longest text.
    """
    packs = stored(chunks(docs, learn, doc_id, text, deleted, chunk), "chunks")
    apart = F.col("apart")
    row = packs.agg(
        F.sum("n_tokens").alias("all"), F.sum("train_tokens").alias("tokens"), F.sum("train_docs").alias("docs"),
        F.sum(F.when(apart, F.col("train_tokens"))).alias("apart_tokens"), F.sum(F.when(apart, F.col("train_docs"))).alias("apart_docs"),
    ).first()
    bits = min(max(math.ceil(math.log2(max(row["all"] or 0, 2))) - cell_bits, LEAST_CELL_BITS), MOST_CELL_BITS)
    replies = stored(answers(entries(packs, order, bits), max(1, (row["all"] or 0) >> TASK_BITS)), "totals")
    known = replies.filter((F.col("n") == 1) & F.col("chunk").isNull()).agg(F.sum("known").alias("n")).first()["n"] or 0
    replies = replies.filter(F.col("chunk").isNotNull())
    sizes = Sizes(row["tokens"] or 0, row["docs"] or 0, known, row["apart_tokens"] or 0, row["apart_docs"] or 0)

    def list_events(pack: dict, its: pa.Table) -> pa.Table:
        parts = found(pack, its, order, bits, sizes, True).estimates
        columns = {f"f{k}": f.astype(np.float32) for k, (f, _) in enumerate(parts, 1)} | {f"b{k}": b for k, (_, b) in enumerate(parts, 1)}
        return pa.table(columns)

    kinds = ", ".join([f"f{k} float" for k in range(1, order + 1)] + [f"b{k} tinyint" for k in range(1, order + 1)])
    weights = start_weights(order)
    if sizes.apart_docs:
        events = stored(_together(packs.filter(apart), replies.filter(F.col("deducted").isNotNull()), list_events, kinds), "events")
        weights = learn_weights(events, order, known, rounds)

    def list_scores(pack: dict, its: pa.Table) -> pa.Table:
        at = found(pack, its, order, bits, sizes, False)
        text = np.repeat(np.arange(len(at.ends)), np.diff(at.ends, prepend=-1))
        count = at.counts
        base = np.log10((count + SMOOTH) / (sizes.tokens + SMOOTH * (known + 1)))
        model = np.log10(mixed(at.estimates, weights, known))
        total = lambda x: np.bincount(text, x, len(at.ends))
        return pa.table({
            "doc_id": pa.array(pack["ids"], pa.int64()), "n_tokens": np.bincount(text, minlength=len(at.ends)), "n_known": total(count > 0).astype(np.int64),
            "train_tokens": np.full(len(at.ends), sizes.tokens, np.int64), "base_score": total(base), "score": total(model),
        })

    return _together(packs, replies, list_scores, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
