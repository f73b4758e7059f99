"""The learned operators against plain computations: compressed sizes, dense equations, pooled rates, all readings, sums over n-grams."""

import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from ledgerlark.llm import language, quality_classifier, toxicity, urls

SF = "/root/testdata/sf0.01"


# ---- language: sizes under the same dictionaries -------------------------------------------


def test_the_fewest_compressed_bytes_win(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pieces = language.sample(docs.filter("doc_id % 3 = 0"))
    plain = lambda t: re.sub(r"[\W\d_]+", " ", t.lower()).encode()
    books = {}
    for lang, texts in pieces.items():
        book = zstandard.ZstdCompressionDict(b"\n".join(map(plain, texts)), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        book.precompute_compress(level=language.LEVEL)
        books[lang] = zstandard.ZstdCompressor(dict_data=book, write_content_size=False, write_checksum=False)
    got = {r.doc_id: r for r in language.identify(docs, docs.filter("doc_id % 3 = 0")).collect()}
    for r in docs.filter("doc_id % 11 = 0").collect():
        if not re.search(r"[^\W\d_]", r.text or ""):
            assert got[r.doc_id].lang_pred == "und"
            continue
        data = plain(r.text)
        sizes = {lang: sum(len(b.compress(data[i : i + language.CHUNK])) for i in range(0, len(data), language.CHUNK)) for lang, b in books.items()}
        least = min(sizes.values())
        assert got[r.doc_id].lang_pred == min(lang for lang, n in sizes.items() if n == least)
        second = sorted(sizes.values())[1]
        assert got[r.doc_id].rejected == (second / least - 1 < language.NARROW)


def test_pieces_come_from_anywhere_and_copies_count_once(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    long = " ".join(word() for _ in range(4000))
    rows = [(i, "ein und der selbe Text " * 50, "de") for i in range(500)] + [(1000 + i, long, "en") for i in range(20)] + [(2000, " ".join(word() for _ in range(300)), "de"), (2001, "1 2 3", "de"), (2002, None, "fr"), (2003, "ohne", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)
    found = language.sample(docs, pieces=8)
    assert set(found) == {"de", "en"} and len(found["en"]) == 8 == len(set(found["en"]))
    places = [long.index(p) // language.PIECE_CHARS for p in found["en"]]
    assert max(places) > 10 and sum("selbe" in p for p in found["de"]) == 2  # the two different pieces of the copied text
    assert found == language.sample(docs.coalesce(1), pieces=8)


# ---- quality: dense normal equations, rates pooled by their definition ---------------------


def test_weights_solve_the_dense_equations(spark):
    r = np.random.default_rng(2)
    d = len(quality_classifier.STATISTICS)
    x = r.normal(size=(300, d))
    y = (x[:, 0] + 0.3 * r.normal(size=300) > 0).astype(int)
    rows = [(int(i % quality_classifier.CALIBRATE), [float(v) for v in x[i]], int(y[i])) for i in range(300)]
    labelled = spark.createDataFrame(rows, "part int, x array<double>, y int").repartition(4)
    model = quality_classifier.fit(labelled)
    train = np.arange(300) % quality_classifier.CALIBRATE != 0
    mean, scale = x[train].mean(0), x[train].std(0)
    assert model.mean == pytest.approx(mean) and model.scale == pytest.approx(scale)
    z = np.clip((x - mean) / scale, -5, 5)
    lifted = np.hstack([np.sqrt(2 / quality_classifier.FEATURES) * np.cos(z @ model.turn + model.shift), np.ones((300, 1))])
    a, n, size = lifted[train], train.sum(), quality_classifier.FEATURES + 1
    want = np.linalg.solve(a.T @ a + quality_classifier.RIDGE * n / size * np.eye(size), a.T @ y[train])
    assert model.weights == pytest.approx(want, abs=1e-8)
    # the features approximate a Gaussian kernel of the scaled statistics
    far = ((z[:40, None] - z[None, :40]) ** 2).sum(2)
    assert np.abs(lifted[:40, :-1] @ lifted[:40, :-1].T - np.exp(-far / (2 * d))).mean() < 0.1
    raw = np.clip(np.rint(lifted[~train] @ want * quality_classifier.GRID), -1000, 2000)
    cells = sorted(set(raw.tolist()))
    counts, hits = [np.array([f(raw == c, y[~train]) for c in cells], float) for f in (lambda m, _: m.sum(), lambda m, t: t[m].sum())]
    assert model.grid * quality_classifier.GRID == pytest.approx(cells) and model.chance == pytest.approx(pooled(counts, hits))


def pooled(counts, hits):
    """Rising rates by their definition: the largest least mean of the runs that begin at or before and end at or after a cell."""
    n = len(counts)
    rate = [max(min(hits[j : k + 1].sum() / counts[j : k + 1].sum() for k in range(i, n)) for j in range(i + 1)) for i in range(n)]
    out = []
    for value, cells in itertools.groupby(range(n), key=lambda i: round(rate[i], 12)):
        at = list(cells)
        out += [(hits[at].sum() + 0.5) / (counts[at].sum() + 1)] * len(at)
    return np.array(out)


def test_pooling_by_definition():
    r = np.random.default_rng(4)
    for _ in range(30):
        counts = r.integers(1, 6, 12).astype(float)
        hits = np.array([r.integers(0, c + 1) for c in counts], float)
        assert quality_classifier.rising(counts, hits) == pytest.approx(pooled(counts, hits))


# ---- toxicity: every reading of a short piece ----------------------------------------------


def readings(piece, model):
    """(score, text) of every reading of a piece by the channel and the character model."""
    out = [(0.0, "", (0, 0))]
    before = ""
    for c in piece.lower():
        code = int(toxicity._CODES[ord(c)]) if ord(c) < 256 else 0
        if code:
            options = [(code, c, -0.05)]
        elif c in toxicity.LEET:
            options = [(toxicity.ALPHABET.index(x), x, -1.0 - 0.3 * k) for k, x in enumerate(toxicity.LEET[c])]
        else:
            options = [(0, c, -3.0)]
        drop = -0.4 if c == before else -1.0 if c in toxicity._GAPS else -6.0 if not code else None
        then = [(s + cost + model[a][b][k], text + shown, (b, k)) for s, text, (a, b) in out for k, shown, cost in options]
        then += [(s + drop, text, state) for s, text, state in out if drop is not None and text]
        out, before = then, c
    return [(s + model[a][b][0], text) for s, text, (a, b) in out]


def test_decoding_finds_the_best_reading():
    text = "the idiot is a pathetic loser and a moron who may die of it in scum " * 30
    codes = toxicity._CODES[np.frombuffer(f" {text} ".encode("latin-1"), np.uint8)]
    counts = np.bincount((codes[:-2] * toxicity.LETTERS + codes[1:-1]) * toxicity.LETTERS + codes[2:], minlength=toxicity.LETTERS**3)
    model = toxicity.log_model(counts.reshape((toxicity.LETTERS,) * 3))
    r = random.Random(6)
    pieces = ["1d1ot", "m0r0n", "l.o.s.e.r", "di3", "iidiioot", "p@th3t!c", "$cum", "a b c", "***"] + ["".join(r.choice("aidot1!|*. -ée") for _ in range(r.randrange(1, 8))) for _ in range(60)]
    for piece in pieces:
        every = readings(piece, model)
        best = max(s for s, _ in every)
        got = toxicity.decode(piece, model)
        assert max(s for s, t in every if t == got) == pytest.approx(best), piece


# ---- URL scores: a sum over n-grams --------------------------------------------------------


def by_ngrams(url, weights, bias):
    rest = url.split("://", 1)[1]
    host, path = re.match(r"[^/?#]*", rest)[0].lower(), re.match(r"[^/?#]*([^?#]*)", rest)[1]
    grams = {(tag, text[i : i + n]) for tag, text in (("h", f"^{re.sub('[0-9]+', '0', host)}$"), ("p", re.sub("[0-9]+", "0", path) + "$")) for n in (3, 4, 5) for i in range(max(0, len(text) - n + 1))}
    buckets = {zlib.crc32((tag + gram).encode()) % urls.BUCKETS for tag, gram in grams}
    return 1 / (1 + math.exp(-(math.fsum(weights[b] for b in buckets) / math.sqrt(len(buckets)) + bias)))


def test_scores_are_sums_over_ngrams(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    weights, bias = urls.train()
    asked = {r.page_id: r.url for r in pages.select("page_id", "url").collect()}
    found = urls.filter_urls(pages).collect()
    assert len(found) == len(asked) and all(r.score == pytest.approx(by_ngrams(asked[r.page_id], weights, bias), abs=1e-9) for r in found)


def test_training_lowers_the_loss():
    def loss(weights, bias):
        chances = [(by_ngrams(u, weights, bias), y) for u, y in urls.LABELLED]
        return -sum(math.log(p if y else 1 - p) for p, y in chances)

    weights, bias = urls.train()
    assert loss(weights, bias) < 0.5 * loss(np.zeros(urls.BUCKETS), 0.0)
    assert all((by_ngrams(u, weights, bias) >= 0.5) == bool(y) for u, y in urls.LABELLED)
