"""Importance resampling against brute force, and position-table checksums against zlib."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlark.llm import importance
from ledgerlark.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("reach", [4, 9, 64, 512])
def test_checksums_of_any_length(reach):
    r, table = np.random.default_rng(1), importance.PositionTable(reach)
    for n in [*range(40), 511, 512, 513, 515, 516, 517, 1024, 1028, 5000]:
        data = r.integers(0, 256, n).astype(np.uint8)
        assert table.crc(data) == zlib.crc32(data.tobytes())


def words_of(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def features_of(text):
    w = words_of(text)
    return [" ".join(w[i : i + k]).encode("utf-8", "surrogatepass") for k in (1, 2, 3) for i in range(len(w) - k + 1)]


TEXTS = [None, "", " - ", "one", "Two words", "A b,c;d  e\x00f", "é𝔘ß naïve ÄÖ", "x" * 600 + " y " + "z" * 1300 + " q", "the end " * 700, "9 a" * 50, "\x7f\x60{|}~ ok"]


@pytest.mark.parametrize("block", [importance.BLOCK, 40, 7])
def test_features_are_the_runs_of_words(block):
    found = [[] for _ in TEXTS]
    counted = np.zeros(len(TEXTS), int)
    data = [(t or "").encode().translate(importance.LOWER) for t in TEXTS]
    for crc, owner, words in importance.features(data, block=block):
        counted += np.bincount(words, minlength=len(TEXTS))
        for c, o in zip(crc.tolist(), owner.tolist(), strict=True):
            found[o].append(c)
    assert [sorted(f) for f in found] == [sorted(zlib.crc32(x) for x in features_of(t)) for t in TEXTS]
    assert counted.tolist() == [len(words_of(t)) for t in TEXTS]


def by_hand(docs, target, percent=5, least=20):
    s, t = np.zeros(10000, int), np.zeros(10000, int)
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for f in features_of(text):
                counts[zlib.crc32(f) % 10000] += 1
    S, T = int(s.sum()), int(t.sum())
    gain = [math.floor(1000 * math.log((int(t[b]) + 1) * (S + 10000) / ((int(s[b]) + 1) * (T + 10000)))) for b in range(10000)]
    rows, order = {}, []
    for at, (i, text) in enumerate(docs):
        fs = features_of(text)
        weight = sum(gain[zlib.crc32(f) % 10000] for f in fs)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows[at] = [i, len(fs), weight, score, None]
        if len(words_of(text)) >= least:
            order.append((-score, i is None, i or 0, len(words_of(text)), at))
    for rank, x in enumerate(sorted(order)[: percent * len(order) // 100], 1):
        rows[x[-1]][4] = rank
    return sorted(map(tuple, rows.values()), key=str)


def result(df):
    return sorted(map(tuple, df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_whole_tables_against_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    df = QUERIES["op11_importance_resampling"](spark, SF)
    assert df.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {f.dataType.simpleString() for f in df.schema} == {"bigint"}
    got = result(df)
    assert got == by_hand(docs, target)
    ranks = sorted(r[4] for r in got if r[4])
    assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) > 20


def some_rows():
    r = random.Random(4)
    rows = [(i, " ".join(r.choice("alpha Beta gamma delta's é x9".split()) for _ in range(r.choice([0, 3, 19, 20, 21, 60])))) for i in r.sample(range(1000), 200)]
    return [*rows, rows[0], rows[0], (rows[1][0], rows[2][1]), (None, "alpha beta " * 20), (None, "alpha beta " * 20), (None, None), (5000, None), (5001, "w" * 3000 + " alpha" * 30)]


@pytest.mark.parametrize("percent, least, block", [(5, 20, importance.BLOCK), (100, 0, 100), (50, 3, 30)])
def test_odd_rows(spark, percent, least, block):
    rows, target = some_rows(), ["alpha beta", None, "", "é x9 alpha beta", "alpha beta"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    items = spark.createDataFrame([(t,) for t in target], "text string")
    want = by_hand(rows, target, percent, least)
    got = importance.resample(docs, items, percent=percent, least=least, block=block)
    assert result(got) == want
    crowded = docs.select("*", *[F.lit("own").alias(c) for c in ("score", "weight", "rank", "_text", "n_words", "_all", "_place")])
    assert result(importance.resample(crowded, items, percent=percent, least=least, block=block)) == want
    drawn = importance.draw(crowded, items, percent=percent, least=least, block=block)
    assert drawn.columns == crowded.columns
    ids = sorted((str(r.doc_id), r.text) if r.text else (str(r.doc_id), "") for r in drawn.collect() if r.score == "own")
    last = max((w for w in want if w[4]), key=lambda w: w[4])
    chosen = [w for w in want if w[4] or (w[0], w[3]) == (last[0], last[3])]
    assert sorted(str(w[0]) for w in chosen) == [i for i, _ in ids]


def test_empty_tables(spark, odd, none, benchmark):
    assert importance.resample(none, benchmark).collect() == [] and importance.draw(none, benchmark).collect() == []
    alone = importance.resample(odd, benchmark.limit(0)).collect()
    assert len(alone) == odd.count() and sum(r.rank is not None for r in alone) == sum(r.n_words >= 20 for r in alone) * 5 // 100
