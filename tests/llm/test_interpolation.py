"""Deleted interpolation against brute force: counts, base scores, mixture and weights."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlark.llm import interpolation as lm
from ledgerlark.llm.common import fold_of
from ledgerlark.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def tokens_of(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), "\n"]


def grams(tokens, k):
    wide = ["\t"] * (k - 1) + tokens
    return [tuple(wide[i : i + k]) for i in range(len(tokens))]


def counted(texts, order):
    out = [collections.Counter() for _ in range(order + 1)]
    for t in texts:
        tokens = tokens_of(t)
        for k in range(1, order + 1):
            out[k].update(grams(tokens, k))
            out[k - 1].update(g[:-1] for g in grams(tokens, k)) if k == 1 else None
    return out


def context_counts(texts, order):
    out = [collections.Counter() for _ in range(order + 1)]
    for t in texts:
        for k in range(1, order + 1):
            out[k].update(g[:-1] for g in grams(tokens_of(t), k))
    return out


def bucket(n):
    return 0 if not n else min(int(math.log2(n)) + 1, lm.BUCKETS - 1)


def estimates(text, counts, contexts, order):
    """(estimate, bucket) by token and order."""
    tokens = tokens_of(text)
    out = []
    for i in range(len(tokens)):
        row = []
        for k in range(1, order + 1):
            g = grams(tokens, k)[i]
            n = contexts[k][g[:-1]]
            row.append((counts[k][g] / n if n else 0.0, bucket(n) if k > 1 else int(n > 0)))
        out.append(row)
    return out


def probability(row, weights, known):
    p = 1 / (known + 1)
    for (f, b), w in zip(row, weights):
        p = w[b] * f + (1 - w[b]) * p
    return p


def by_hand(docs, learns, apart, order, rounds):
    train = [t for (_, t), y in zip(docs, learns) if y]
    counts, contexts = counted(train, order), context_counts(train, order)
    known, total = len(counts[1]), sum(counts[1].values())
    kept = [t for (_, t), y, a in zip(docs, learns, apart) if y and not a]
    less, less_contexts = counted(kept, order), context_counts(kept, order)
    rows = [r for (_, t), y, a in zip(docs, learns, apart) if y and a for r in estimates(t, less, less_contexts, order)]
    weights = lm.start_weights(order)
    for _ in range(rounds if rows else 0):
        hits, seen = np.zeros(weights.shape), np.zeros(weights.shape)
        for row in rows:
            whole, chance = probability(row, weights, known), 1.0
            for k in range(order - 1, -1, -1):
                f, b = row[k]
                # the share of this token's probability that comes from order k + 1
                mine = weights[k][b] * f * math.prod(1 - weights[j][row[j][1]] for j in range(k + 1, order)) / whole
                hits[k, b] += mine
                seen[k, b] += chance
                chance -= mine
        weights = lm.improved(hits, seen)
    out = []
    for i, t in docs:
        tokens = tokens_of(t)
        base = sum(math.log10((counts[1][(w,)] + 0.1) / (total + 0.1 * (known + 1))) for w in tokens)
        score = sum(math.log10(probability(r, weights, known)) for r in estimates(t, counts, contexts, order))
        out.append((i, len(tokens), sum(counts[1][(w,)] > 0 for w in tokens), total, base, score))
    return out, weights


def kinds(docs):
    """Whether each row is kept apart, as the operator deals them."""
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(lm.DELETED)) == 0
    return {(r.doc_id, r.text): r.a for r in docs.select("doc_id", "text", place.alias("a")).collect()}


def some_rows(n=260, seed=6):
    r = random.Random(seed)
    words = "the a of Quick brown fox, jumps over Lazy dog's é x\x00y".split()
    rows = [(i, " ".join(r.choice(words[: r.choice([4, 12])]) for _ in range(r.choice([0, 1, 2, 9, 40]))) + f" own{i % 90}") for i in range(n)]
    return [*rows, rows[3], rows[3], (rows[4][0], "other text"), (None, "the a of"), (None, None), (9000, None), (9001, ""), (9002, " \n\t "), (9003, "the fox " * 3000)]


def close(got, want):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:4], r[4])
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    for g, w in zip(got, want):
        assert g[4] == pytest.approx(w[4], rel=1e-12) and g[5] == pytest.approx(w[5], rel=2e-6)


@pytest.mark.parametrize("order, chunk, cell_bits", [(3, lm.CHUNK, lm.CELL_BITS), (3, 300, 3), (2, 2000, 5), (1, 2000, 5), (4, 100, 8)])
def test_scores_by_brute_force(spark, order, chunk, cell_bits):
    rows = some_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    learns = [zlib.crc32(str("" if i is None else i).encode()) % 10 != 0 for i, _ in rows]
    apart = kinds(docs)
    want, weights = by_hand(rows, learns, [apart[x] for x in rows], order, 4)
    assert any(apart.values()) and (weights[:, 1:] != 0.5).any()
    got = lm.score(docs, fold_of(10) != 0, order=order, chunk=chunk, cell_bits=cell_bits, rounds=4)
    close([tuple(r) for r in got.collect()], want)


def test_probabilities_add_up_to_one():
    r = random.Random(2)
    texts = [" ".join(r.choice("abcde") for _ in range(r.randrange(8))) for _ in range(40)]
    counts, contexts = counted(texts, 3), context_counts(texts, 3)
    weights = np.random.default_rng(3).uniform(0.1, 0.9, (3, lm.BUCKETS))
    weights[:, 0] = 0
    known = [g[0] for g in counts[1]]
    for before in [("\t", "\t"), ("\t", "a"), ("a", "b"), ("q", "a"), ("q", "q")]:
        total = 0.0
        for w in [*known, "unknown"]:
            row = []
            for k in (1, 2, 3):
                g = (*before, w)[3 - k :]
                n = contexts[k][g[:-1]]
                row.append((counts[k][g] / n if n else 0.0, bucket(n) if k > 1 else 1))
            part = [(np.array([f]), np.array([b])) for f, b in row]
            total += lm.mixed(part, weights, len(known))[0]
        assert total == pytest.approx(1)


def test_rounds_raise_the_likelihood():
    r = np.random.default_rng(5)
    parts = [(r.uniform(0, 0.3, 500), np.ones(500, int)), (r.uniform(0, 1, 500) * (r.random(500) < 0.5), r.integers(0, 5, 500))]
    weights, last = lm.start_weights(2), -np.inf
    for _ in range(8):
        now = np.log(lm.mixed(parts, weights, 50)).sum()
        assert now >= last - 0.5
        last, weights = now, lm.improved(*lm.expected(parts, weights, 50))


def test_packing():
    r = np.random.default_rng(4)
    keys = np.unique(r.integers(0, 2**63, 1000).astype(np.uint64) * np.uint64(2))
    assert np.array_equal(lm.risen(lm.rising(keys)), keys)
    assert np.array_equal(lm.unpacked(lm.packed(np.arange(-5, 900)), np.int64), np.arange(-5, 900))
    for k, bits in ((1, 6), (2, 9), (3, 30)):
        short = np.unique(keys >> np.uint64(64 - lm.width_of(k, bits)))
        cells, cut = lm.cells_of(short, k, bits)
        assert cut[-1] == len(short) and (np.diff(cells) > 0).all() and cells.max() < 1 << bits


def test_odd_rows_and_empty_tables(odd, crowded, none):
    learn = fold_of(10) != 0
    shown = lambda df: sorted(((r.doc_id is not None, r.doc_id or 0), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 4)) for r in df.collect())
    got = shown(lm.score(odd, learn))
    assert got == shown(lm.score(crowded, learn)) and len(got) == odd.count()
    assert lm.score(none, learn).collect() == []
    assert {(r.n_known, r.train_tokens, r.base_score, r.score) for r in lm.score(odd, F.lit(False)).collect()} == {(0, 0, 0.0, 0.0)}
    assert {r.n_tokens for r in lm.score(odd, learn).collect() if r.doc_id in (1, 2, 3)} == {1}


def test_held_out_texts_are_likelier_than_by_single_tokens(spark):
    rows = QUERIES["op13_lm_scoring"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    out = [r for r in rows if r.held_out]
    assert 50 < len(out) < 200 and sum(r.score for r in out) > sum(r.base_score for r in out)
    assert all(r.score < 0 and r.base_score < 0 and 0 < r.n_known <= r.n_tokens for r in out)


def test_entries_are_settled_over_the_tasks_asked_for(spark):
    sent = spark.createDataFrame([], "n int, cell int, chunk long, apart boolean, keys binary, counts binary")
    plan = lm.answers(sent, 7)._jdf.queryExecution().analyzed().toString()
    assert re.search(r"RepartitionByExpression \[n#\d+, cell#\d+\], 7", plan)
