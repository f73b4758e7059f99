"""Helpers the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: a word: a run of characters that are not white space
WORD = r"[^\x20\x09-\x0D]+"

_BASE = 0x9E3779B97F4A7C15
_PIECE = 1 << 20
_powers = np.ones(1, np.uint64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(name), F.lit(""))


def fold_of(modulus: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % modulus


def powers(n: int) -> np.ndarray:
    """The first n powers of the hash base, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 1024), _BASE, np.uint64)
        steps[0] = 1
        _powers = np.cumprod(steps, dtype=np.uint64)
    return _powers[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a polynomial hash so that all bits depend on all bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def word_spans(data: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of bytes; in_word: for each byte value, whether words have it."""
    mask = np.empty(len(data) + 2, np.bool_)
    mask[0] = mask[-1] = False
    mask[1:-1] = in_word[data]
    edges = np.flatnonzero(mask[1:] != mask[:-1])
    return edges[0::2], edges[1::2]


def word_hashes(data: bytes, in_word: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word of the text's bytes, in order.

    Works through pieces of about a megabyte that end between words, so that memory is bounded
    by the longest word.
    """
    out, at = [], 0
    whole = np.frombuffer(data, np.uint8)
    while at < len(whole):
        end = min(at + _PIECE, len(whole))
        while end < len(whole) and in_word[whole[end]]:
            end += 1
        piece = whole[at:end]
        starts, ends = word_spans(piece, in_word)
        at = end
        if not len(starts):
            continue
        sizes = ends - starts
        weights = powers(int(sizes.max()) + 1)
        # position of each byte in its own word, for words laid side by side
        first = np.cumsum(sizes) - sizes
        inside = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
        letters = piece[in_word[piece]].astype(np.uint64) + np.uint64(1)
        sums = np.add.reduceat(letters * weights[inside], first)
        out.append(mix(sums + sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def gram_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` consecutive values (uint64)."""
    n = len(values) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    weights = powers(size + 1)
    for i in range(size):
        total += values[i : i + n] * weights[i + 1]
    return mix(total)


def aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str], Callable[[DataFrame], DataFrame]]:
    """docs under column names that no operator uses, their names by the old ones, and the way back.

    So further columns of docs may have any name.
    """
    names = {c: f"_in{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names, lambda rows: rows.select(*[F.col(inner).alias(c) for c, inner in names.items()])
