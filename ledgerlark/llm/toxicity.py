"""Toxicity: noisy-channel restoration of disguised words, then scores of the restored text.

A character model (two letters and the next, a table of fixed size) is counted over all texts. Pieces of text that
look disguised, with digits or signs beside letters, three spaced letters or a letter three times or
more, become lattices of what each character may stand for; Viterbi decoding finds the most likely
letters under the channel and the character model. The score of the restored text comes from
units, whole words and their first letters, that the labelled texts show to be toxic.

Copies and near copies among the labelled texts would make any of their words look toxic, so
units are counted in families: texts that agree in the least hash of their 3-word runs. The weights
of the evidence come from families that had no part in choosing the units.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import nlargest

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.operators.common import stored

#: letters fold to a-z, all else to a gap
ALPHABET = " abcdefghijklmnopqrstuvwxyz"
LETTERS = len(ALPHABET)
#: what a sign may stand for
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "*": "aeiou", "%": "aeiou", "#": "aeiou",
}
_PLAIN = {"àâäáãå": "a", "ç": "c", "èéêë": "e", "ìíîï": "i", "ñ": "n", "òóôöõø": "o", "ùúûü": "u", "ýÿ": "y", "ß": "s"}
_FOLD = {ord(c): to for group, to in _PLAIN.items() for c in group}
_CODES = np.zeros(256, np.int64)
for _b in range(256):
    _c = chr(_b).lower().translate(_FOLD)
    _CODES[_b] = max(0, ALPHABET.find(_c)) if len(_c) == 1 else 0

#: the labelled sample: about so many rows, chosen by a hash of the id
SAMPLE_ROWS = 20_000
#: units kept: in at least so many toxic families, so much more often than elsewhere, at most so many
LEAST_FAMILIES, LEAST_LIFT, MOST_UNITS = 2, 1.5, 50_000
#: one family in so many has no part in the units and calibrates their weights
CALIBRATE = 4
PREFIXES = (4, 5)
LIMIT = 0.3
#: readings of pieces up to so many characters are kept for the next time
KEPT_CHARS = 200

_WORD = re.compile(r"[^\W\d_]+")
_GAPS = " .-_"
_LETTER = np.array([chr(b).isalpha() for b in range(256)])
_SIGN = np.array([chr(b) in LEET for b in range(256)])
_GAP = np.array([chr(b) in _GAPS + "*" for b in range(256)])
_BLANKS = bytes(b if _LETTER[b] else 32 for b in range(256))


def odd_pieces(data: np.ndarray) -> list[tuple[int, int]]:
    """Where a text (Latin-1 bytes) looks disguised: signs beside letters, a letter three times, spaced letters."""
    if len(data) < 3:
        return []
    letter, sign = _LETTER[data], _SIGN[data]
    starts = np.flatnonzero(np.diff(sign.astype(np.int8), prepend=0) == 1)
    ends = np.flatnonzero(np.diff(sign.astype(np.int8), append=0) == -1) + 1
    after = np.append(letter, False)
    inner = after[ends] | (starts > 0) & letter[starts - 1]
    thrice = np.flatnonzero(letter[2:] & (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]))
    found = []
    shown = letter | sign
    edges = np.flatnonzero(np.diff(np.concatenate([[False], shown, [False]]).astype(np.int8)))
    hits = np.concatenate([starts[inner], thrice])
    if len(hits):
        run = np.unique(np.searchsorted(edges[0::2], hits, side="right") - 1)
        found += list(zip(edges[0::2][run].tolist(), edges[1::2][run].tolist(), strict=True))
    # single characters two apart with a gap between: at least three in a row
    alone = shown & ~np.concatenate([[False], shown[:-1]]) & ~np.concatenate([shown[1:], [False]])
    hop = np.flatnonzero(alone[:-2] & _GAP[data[1:-1]] & alone[2:])
    if len(hop) > 1:
        fresh = np.flatnonzero(np.concatenate([[True], np.diff(hop) != 2]))
        last = np.append(fresh[1:], len(hop)) - 1
        found += [(int(hop[f]), int(hop[t]) + 3) for f, t in zip(fresh, last, strict=True) if t - f >= 1]
    return found


def character_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """How often each letter follows each two letters, over all texts; LETTERS**3 counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LETTERS**3, np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    c = _CODES[np.frombuffer(f" {t} ".encode("latin-1", "replace"), np.uint8)]
                    total += np.bincount((c[:-2] * LETTERS + c[1:-1]) * LETTERS + c[2:], minlength=LETTERS**3)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], ["gram", "n"])

    out = np.zeros(LETTERS**3, np.int64)
    for row in docs.select(F.col(text).alias("text")).mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        out[row["gram"]] = row["n"]
    return out.reshape(LETTERS, LETTERS, LETTERS)


def log_model(counts: np.ndarray) -> list:
    """Log probabilities of the next letter, backing off to fewer letters."""
    one = counts.sum((0, 1)) + 1.0
    one /= one.sum()
    two = counts.sum(0) + 20 * one
    two /= two.sum(1, keepdims=True)
    three = counts + 20 * two
    return np.log(three / three.sum(2, keepdims=True)).tolist()


def decode(piece: str, model: list) -> str:
    """The most likely letters of a disguised piece.

    A state is the last two letters written. A letter is itself; a sign is one of what it may
    stand for; a letter equal to the one before may be dropped, a gap between letters as well. Paths are chains of letters that share their
    beginnings, so memory grows with the piece.
    """
    piece = piece.lower()
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    before = ""
    for c in piece:
        code = int(_CODES[ord(c)]) if ord(c) < 256 else 0
        if code:
            options = [(code, c, -0.05)]
        elif c in LEET:
            options = [(ALPHABET.index(x), x, -1.0 - 0.3 * k) for k, x in enumerate(LEET[c])]
        else:
            options = [(0, c, -3.0)]
        skip = -0.4 if c == before else -1.0 if c in _GAPS else -6.0 if not code else None
        then: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, out) in best.items():
            for code, shown, cost in options:
                x = score + cost + model[a][b][code]
                if x > then.get((b, code), (-math.inf,))[0]:
                    then[b, code] = (x, (out, shown))
            if skip is not None and out is not None:
                x = score + skip
                if x > then.get((a, b), (-math.inf,))[0]:
                    then[a, b] = (x, out)
        best, before = then, c
    ends = [(score + model[a][b][0], out) for (a, b), (score, out) in best.items()]
    most = max(score for score, _ in ends)
    return max(written(out) for score, out in ends if score == most)


def written(out: tuple | None) -> str:
    letters = []
    while out is not None:
        out, shown = out
        letters.append(shown)
    return "".join(reversed(letters))


class Restorer:
    def __init__(self, model: list) -> None:
        self.whole = lambda piece: decode(piece, model)
        self.short = lru_cache(maxsize=100_000)(self.whole)

    def words(self, text: str | None) -> set[str]:
        """The lower-case words of the whole text and of its restored pieces."""
        text = (text or "").lower()
        data = text.encode("latin-1", "replace")
        found = set(data.translate(_BLANKS).decode("latin-1").split()) if len(data) == len(text) and data.decode("latin-1") == text else set(_WORD.findall(text))
        for start, end in odd_pieces(np.frombuffer(data, np.uint8)):
            read = self.short if end - start <= KEPT_CHARS else self.whole
            found.update(_WORD.findall(read(text[start:end])))
        return found


def units(word: str) -> list[str]:
    return [word, *(f"{word[:n]}~" for n in PREFIXES if len(word) >= n)]


def family(text: str | None) -> int:
    """The least hash of the text's 3-word runs."""
    words = (text or "").split()
    runs = {" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))}
    return min(xxhash.xxh64_intdigest(r) for r in runs) - 2**63


class Weights(dict):
    """The weight of a word: the largest of its units'. Words seen are kept, up to a number."""

    def __init__(self, of_units: dict[str, float], most: int = 200_000) -> None:
        self.of_units, self.most = of_units, most

    def __missing__(self, word: str) -> float:
        if len(self) >= self.most:
            self.clear()
        self[word] = weight = max(self.of_units.get(u, 0.0) for u in units(word))
        return weight


def evidence(words: set[str], weights: Weights) -> tuple[float, float]:
    """The strongest word's weight, and the sum of the three strongest distinct words."""
    found = nlargest(3, map(weights.__getitem__, words))
    return (found[0], sum(found)) if found else (0.0, 0.0)


def _learn(sample: DataFrame, model: list) -> tuple[dict[str, float], np.ndarray]:
    """Weights of units, and the logistic weights of the evidence. sample: text, y."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            rows = [sorted(restorer.words(t)) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array([family(t) for t in texts], pa.int64()), pa.array(rows, pa.list_(pa.string())), batch.column(1)], ["family", "words", "y"]
            )

    rows = stored(sample.select("text", "y").mapInArrow(run, "family long, words array<string>, y int"), "toxic_sample")
    calibrates = F.pmod(F.xxhash64("family"), F.lit(CALIBRATE)) == 0
    sizes = rows.filter(~calibrates).groupBy("y").agg(F.count_distinct("family").alias("n")).collect()
    number = {r["y"]: r["n"] for r in sizes}
    if len(number) < 2:
        return {}, np.array([math.log((number.get(1, 0) + 0.5) / (number.get(0, 0) + 0.5)), 0.0, 0.0])
    each = F.array_distinct(F.flatten(F.transform("words", lambda w: F.concat(
        F.array(w), *[F.when(F.length(w) >= n, F.array(F.concat(F.substring(w, 1, n), F.lit("~")))).otherwise(F.array().cast("array<string>")) for n in PREFIXES]))))
    seen = rows.filter(~calibrates).select("family", "y", F.explode(each).alias("unit")).distinct().groupBy("unit").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("f"))
    lift = F.log((F.col("t") + 1) / (number[1] + 2)) - F.log((F.col("f") + 1) / (number[0] + 2))
    kept = seen.filter(F.col("t") >= LEAST_FAMILIES).withColumn("w", lift).filter(F.col("w") >= LEAST_LIFT)
    weights = {r["unit"]: r["w"] for r in kept.orderBy(F.col("t").desc(), "unit").limit(MOST_UNITS).collect()}

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Weights(weights)
        for batch in batches:
            pairs = [evidence(w, known) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.float64()), pa.array([p[1] for p in pairs], pa.float64()), batch.column(1)], ["a", "b", "y"])

    table = rows.filter(calibrates).select("words", "y").mapInArrow(weigh, "a double, b double, y int").toPandas()  # at most about SAMPLE_ROWS rows
    x = np.column_stack([np.ones(len(table)), table["a"], table["b"]])
    y = table["y"].to_numpy(float)
    beta = np.zeros(3)
    for _ in range(30):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (x * (p * (1 - p))[:, None]) + 0.5 * np.eye(3)
        beta = beta + np.linalg.solve(slope, x.T @ (y - p) - 0.5 * beta)
    return weights, beta


def score(docs: DataFrame, labels: DataFrame, learn, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, score, predicted for every row of docs.

    labels: doc_id and a label of 0 or 1; null labels and ids teach nothing. learn: a condition on
    `doc_id` for the rows whose labels may be used, of which about sample_rows are taken by a hash
    of the id. Null and empty texts have no evidence and the score that goes with none. Repeated
    rows score alike; an empty table gives an empty result. Texts are decoded whole.
    """
    model = log_model(character_counts(docs, text))
    known = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter("y in (0, 1)").filter(learn)
    n = known.count()
    share = min(1.0, sample_rows / max(1, n))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    weights, beta = _learn(rows.join(stored(chosen, "toxic_labels"), "doc_id").select("text", "y"), model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, known = Restorer(model), Weights(weights)
        for batch in batches:
            pairs = np.array([evidence(restorer.words(t), known) for t in batch.column(1).to_pylist()]).reshape(-1, 2)
            chance = 1 / (1 + np.exp(-np.clip(beta[0] + pairs @ beta[1:], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chance, pa.float64())], ["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id long, score double").withColumn("predicted", (F.col("score") >= LIMIT).cast("int"))
