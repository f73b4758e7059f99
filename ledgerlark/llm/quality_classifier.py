"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Random Fourier features approximate a Gaussian kernel over a few statistics of each text. Each task
sums its part of the normal equations; the entries are added up over the tasks and solved on the
driver, whose share is bounded by the number of features. Raw scores of a part of the labelled
rows that the equations have not seen are counted in a grid, and pooling adjacent violators turns
the grid into rising probabilities.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.operators.common import stored

FEATURES = 160
RIDGE = 1e-3
GRID = 1000
SEED = 11
#: one labelled row in so many calibrates, the others train
CALIBRATE = 5
LIMIT = 0.3
STATISTICS = (
    "log_words", "word_length", "distinct_words", "top_word", "equal_neighbours", "short_words", "symbols", "upper",
    "digits", "stops", "shouts", "other", "repeated_lines", "line_length", "entropy",
)
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_LATIN = [chr(b) for b in range(256)]
_UPPER = np.array([c.isupper() for c in _LATIN])
_LETTER = np.array([c.isalpha() for c in _LATIN])
_SPACE = np.array([c.isspace() for c in _LATIN])
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def statistics(text: str | None) -> list[float]:
    """The statistics of a whole text; of a text without words all are 0."""
    text = text or ""
    words = _WORD.findall(text)
    if not words:
        return [0.0] * len(STATISTICS)
    n, counts = len(words), Counter(words)
    by = np.bincount(np.frombuffer(text.encode("latin-1", "replace"), np.uint8), minlength=256)
    shown = max(1, n_shown := int(by.sum() - by[_SPACE].sum()))
    share = by[by > 0] / by.sum()
    lines = [x for x in text.split("\n") if x]
    return [
        math.log1p(n), math.log1p(n_shown / n), math.log1p(len(counts)) / math.log1p(n), max(counts.values()) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n, sum(len(w) < 3 for w in words) / n,
        by[_SYMBOLS].sum() / shown, by[_UPPER].sum() / shown, by[48:58].sum() / shown, (by[46] + by[44]) / shown, by[33] / shown,
        1 - by[_LETTER].sum() / shown, 1 - len(set(lines)) / max(1, len(lines)), math.log1p(len(text) / max(1, len(lines))),
        float(-(share * np.log(share)).sum()),
    ]


def measured(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, x: the statistics of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([statistics(t.as_py()) for t in batch.column(1)], pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, x array<double>")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    turn: np.ndarray
    shift: np.ndarray
    weights: np.ndarray
    grid: np.ndarray  # centres of the grid, rising
    chance: np.ndarray  # calibrated probabilities there

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features of rows of statistics, and a constant."""
        z = np.clip((x - self.mean) / self.scale, -5, 5)
        return np.hstack([np.cos(z @ self.turn + self.shift) * math.sqrt(2 / len(self.shift)), np.ones((len(z), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.lift(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.grid, self.chance), 0, 1)


def _rows(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.array(batch.column(name).to_pylist(), float).reshape(batch.num_rows, len(STATISTICS))


def _solve(train: DataFrame, model: Model) -> np.ndarray:
    """Ridge weights from normal equations that the tasks sum."""
    size = len(model.shift) + 1
    upper = np.triu_indices(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            z = model.lift(_rows(batch, "x"))
            left += z.T @ z
            right += z.T @ np.array(batch.column("y").to_pylist(), float)
        values = np.concatenate([left[upper], right])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int32()), pa.array(values)], ["entry", "value"])

    sums = train.mapInArrow(run, "entry int, value double").groupBy("entry").agg(F.sum("value").alias("value")).toPandas()
    values = np.zeros(len(upper[0]) + size)
    values[sums["entry"].to_numpy()] = sums["value"].to_numpy()
    left = np.zeros((size, size))
    left[upper] = values[: len(upper[0])]
    left = left + left.T - np.diag(np.diag(left))
    n = max(1.0, left[-1, -1])
    return np.linalg.solve(left + RIDGE * n / size * np.eye(size), values[len(upper[0]) :])


def rising(counts: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the closest rising rates, each with half a row of either label."""
    blocks: list[list[float]] = []
    for n, y in zip(counts, hits, strict=True):
        blocks.append([n, y, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            n1, y1, k1 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + n1, blocks[-1][1] + y1, blocks[-1][2] + k1]
    return np.concatenate([np.full(int(k), (y + 0.5) / (n + 1)) for n, y, k in blocks]) if blocks else np.empty(0)


def fit(labelled: DataFrame, features: int = FEATURES, seed: int = SEED) -> Model:
    """labelled: part (0 calibrates), x, y as 0 or 1. Without a label every score is a half."""
    train = labelled.filter("part <> 0")
    d = len(STATISTICS)
    moments = train.agg(
        F.count("*").alias("n"),
        *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(d)], *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(d)],
    ).first()
    n = moments["n"]
    mean = np.array([moments[f"m{i}"] or 0.0 for i in range(d)])
    scale = np.array([max(moments[f"s{i}"] or 0.0, 1e-3) for i in range(d)])
    random = np.random.default_rng(seed)
    model = Model(
        mean, scale, random.normal(size=(d, features)) / math.sqrt(d), random.uniform(0, 2 * math.pi, features),
        np.zeros(features + 1), np.array([0.0]), np.array([0.5]),
    )
    if not n:
        return model
    model.weights = _solve(train.select("x", F.col("y").cast("double").alias("y")), model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.clip(np.rint(model.raw(_rows(batch, "x")) * GRID), -GRID, 2 * GRID).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column("y")], ["at", "y"])

    rows = labelled.filter("part = 0").select("x", F.col("y").cast("double").alias("y")).mapInArrow(run, "at int, y double")
    seen = rows.groupBy("at").agg(F.count("*").alias("n"), F.sum("y").alias("y")).orderBy("at").collect()  # at most 3 GRID + 1
    if seen:
        model.grid = np.array([r["at"] for r in seen]) / GRID
        model.chance = rising(np.array([r["n"] for r in seen], float), np.array([r["y"] for r in seen], float))
    else:
        model.grid, model.chance = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def classify(docs: DataFrame, labels: DataFrame, learn, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """doc_id, score, predicted for every row of docs.

    labels: doc_id and a label of 0 or 1; null labels and ids teach nothing. learn: a condition on
    `doc_id` for the rows whose labels may be used. Null and empty texts have the statistics 0 and
    a score like all others; repeated rows score alike, and repeated labelled rows count as often
    as they stand there. An empty table gives an empty result. Texts are measured whole.
    """
    rows = stored(measured(docs, doc_id, text), "statistics")
    known = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter("y in (0, 1)")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(CALIBRATE))
    model = fit(rows.filter(learn).join(known, "doc_id").select(part.alias("part"), "x", "y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(_rows(batch, "x")), pa.float64())], ["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id long, score double").withColumn("predicted", (F.col("score") >= LIMIT).cast("int"))
