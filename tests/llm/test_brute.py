"""Operators against brute force, SQL and held-out labels."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SF_DIR
from ledgerlark.llm import decontam, mixing, ngram_join, quality_classifier, substring_dedup, toxicity
from ledgerlark.llm.queries import ORACLES, QUERIES
from tools.compare import oracle_connection, sorted_rows

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", list(ORACLES))
def test_against_sql(spark, name):
    df = QUERIES[name](spark, SF)
    want = oracle_connection(SF, ["documents", "benchmark", "labels"]).sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert sorted_rows(df.columns, df.collect()) == sorted_rows(want.columns, want.fetchall())


def test_sql_on_odd_rows(spark, odd, benchmark, labels, tmp_path):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    import duckdb

    con = duckdb.connect(config={"memory_limit": "2GB"})
    for t in ("documents", "benchmark", "labels"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    for name, sql in ORACLES.items():
        df, want = QUERIES[name](spark, str(tmp_path)), con.sql(sql)
        assert sorted_rows(df.columns, df.collect()) == sorted_rows(want.columns, want.fetchall()), name


def test_furniture_depletes(spark):
    from ledgerlark.llm import quality_rules

    letters = "abcdefghijklmnopqrst"
    lines = [" ".join(f"{x}{y}{i:03}"[:2] + letters[i] * 3 for y in "uvwxyz") for i, x in enumerate(letters)]
    menu = "\n".join(lines)
    rows = [(i, f"{menu}\nmy own words here{i}", "h") for i in range(40)]
    rows += [(100 + i, " ".join(f"w{i}x{j}" for j in range(60)) + "\n " + lines[3].upper().replace(" ", "  "), "h") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = {r.doc_id: r for r in quality_rules.judge(docs, share=0.4, least=20).collect()}
    assert all(not got[i].kept and got[i].removed_words == 120 and not got[i].base_failed for i in range(40))
    assert all(got[100 + i].kept and got[100 + i].removed_words == 6 for i in range(40))


def test_furniture_is_removed(spark):
    letters = "abcdefghijklmnopqrstuvwxyzäöü+"
    own = ["\n".join(" ".join(x + y + z for x in letters) for z in "uvw") for y in [a + b for a in letters[:10] for b in letters[:6]]]
    line = "all  Rights reserved 2024"
    texts = [t.replace("\n", f"\n{line.upper() if i % 2 else line}\n\n") if i < 40 else t for i, t in enumerate(own)]
    docs = spark.createDataFrame([(i, t, "en", "h", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    want = {i: t.replace("\n", "\n\n") if i < 40 else t for i, t in enumerate(own)}
    name, stage = corpus_pipeline.STAGES[0]
    got = {r.doc_id: r for r in stage(spark, docs, SF).collect()}
    assert {i: r.text for i, r in got.items()} == want and all(r.n_chars == len(r.text) for r in got.values())
    from ledgerlark.llm import quality_rules

    removed = {r.doc_id: r.removed_words for r in quality_rules.judge(docs).collect()}
    assert removed == {i: len(texts[i].split()) - len(want[i].split()) for i in want}


# ---- n-gram join ---------------------------------------------------------------------------


def classes_by_brute_force(rows, threshold=0.8):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets.append(frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset())
    having = collections.defaultdict(list)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, s in enumerate(sets):
        common = collections.Counter(o for g in s for o in having[g])
        for o, n in common.items():
            if n / (len(s) + len(sets[o]) - n) >= threshold - 1e-9:
                a, b = find(k), find(o)
                parent[max(a, b)] = min(a, b)
        for g in s:
            having[g].append(k)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((rows[k][0], least[find(k)]) for k in range(len(rows)))


def links_by_brute_force(rows, threshold=0.8):
    sets = {i: frozenset(zip(*(t.split()[k:] for k in range(5)))) for i, t in rows}
    near = lambda a, b: a != b and len(a & b) >= threshold * len(a | b) - 1e-9
    return {i: len({b for b in sets.values() if near(a, b)}) for i, a in sets.items()}


def near_copies(seed=2):
    """A large group of near copies of one text, chains of copies of copies, and texts alone."""
    r = random.Random(seed)
    base = [f"w{r.randrange(400)}" for _ in range(120)]
    texts = []
    for _ in range(150):
        t = list(base)
        for _ in range(r.randrange(4)):
            t[r.randrange(len(t))] = f"x{r.randrange(10**6)}"
        texts.append(t)
    chain = [f"c{r.randrange(400)}" for _ in range(100)]
    for _ in range(12):
        chain = list(chain)
        chain[r.randrange(100)] = f"y{r.randrange(10**6)}"
        texts.append(chain)
    texts += [[f"z{r.randrange(10**5)}" for _ in range(60)] for _ in range(30)]
    r.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("block", [ngram_join.BLOCK, 20, 5])
def test_join_finds_the_classes(spark, block):
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = ngram_join.join(docs, block=block).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == classes_by_brute_force(rows)
    links = links_by_brute_force(rows)
    assert all((r.n_links > 0) == (links[r.doc_id] > 0) and (block < 100 or r.n_links == links[r.doc_id]) for r in got)


@pytest.mark.parametrize("block", [40, 20, 5])
def test_links_of_large_buckets_are_counted(spark, block):
    rows = near_copies(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    links = links_by_brute_force(rows)
    assert max(links.values()) > 2 * block
    assert {r.doc_id: r.n_links for r in ngram_join.join(docs, block=block).collect()} == links


def test_join_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = QUERIES["op2_ngram_join"](spark, SF).collect()
    want = classes_by_brute_force([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted((r.doc_id, r.class_id) for r in got) == want


def test_banding_reaches_the_recall():
    bands, rows = ngram_join.banding()
    assert 1 - (1 - 0.8**rows) ** bands >= ngram_join.RECALL and bands * rows <= ngram_join.MOST_HASHES


# ---- repeated passages ---------------------------------------------------------------------


def removed_by_brute_force(rows, size=50):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - size + 1):
            first[b[i : i + size]] = min(first.get(b[i : i + size], d), d)
    out = []
    for d, t in rows:
        b, gone = (t or "").encode(), np.zeros(len((t or "").encode()), bool)
        for i in range(len(b) - size + 1):
            if first[b[i : i + size]] < d:
                gone[i : i + size] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), int(gone.sum()), int(np.diff(np.concatenate([[0], gone])).clip(0).sum()) if len(b) else 0, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def passages(seed=5):
    r = random.Random(seed)
    shared = ["".join(r.choice("abcé \n") for _ in range(r.randint(30, 160))) for _ in range(8)]
    rows = []
    for i in range(60):
        parts = [r.choice(shared) if r.random() < 0.6 else "".join(r.choice("abcdefgh ") for _ in range(r.randint(0, 90))) for _ in range(r.randint(0, 7))]
        rows.append((i, "".join(parts)))
    return [*rows, (61, None), (62, ""), (63, "a" * 200), (64, "a" * 120), (3, rows[5][1]), rows[7], (70, rows[8][1])]


@pytest.mark.parametrize("hot, block", [(substring_dedup.HOT, substring_dedup.BLOCK), (3, 500), (3, 100_000), (8, 3000)])
def test_removed_bytes(spark, hot, block):
    rows = passages()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(tuple(r) for r in substring_dedup.dedup(docs, hot=hot, block=block).collect()) == removed_by_brute_force(rows)


def test_suffix_sort_orders_suffixes():
    r = random.Random(1)
    block = substring_dedup.Block([bytes(r.choice(b"ab") for _ in range(60)) for _ in range(30)])
    at = np.array([int(s) + i for s in block.starts for i in range(11)])
    group = np.sort(np.array([r.randrange(4) for _ in at]))
    order = block.sort(at, group, 50)
    data = block.data.tobytes()
    assert np.array_equal(np.sort(order), np.arange(len(at)))
    for a, b in zip(order, order[1:]):
        assert group[a] <= group[b] and (group[a] < group[b] or data[at[a] : at[a] + 50] <= data[at[b] : at[b] + 50])


# ---- decontamination, mixing ---------------------------------------------------------------


def test_blocks_of_items_agree(spark):
    docs, items = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = decontam.scan(docs, items).collect()
    parts = decontam.scan(docs, items, block_words=200).collect()
    assert sorted(map(str, whole)) == sorted(map(str, parts)) and any(r.n_hit for r in whole)


def test_mix_meets_its_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    mixed = mixing.mix(docs)
    by = mixed.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.sum("size").alias("size")).collect()
    assert sum(r.target for r in by) == pytest.approx(sum(r["size"] for r in by))
    assert all(abs(r.taken - r.target) <= 0.02 * r.target + 1 and r.target <= 3 * r["size"] for r in by)
    assert sorted(mixed.collect()) == sorted(mixing.mix(docs.repartition(7)).collect())


def test_water_filling(spark):
    sources = spark.createDataFrame([("a", 10), ("b", 100), ("c", 100), ("d", 1), (None, 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sources).collect()}
    # weights 5, 2, 1, 5, 2: a is clamped at 30, d at 3, the last has nothing; 178 is left for b and c
    assert got["a"] == 30 and got["d"] == 3 and got[None] == 0 and got["b"] == pytest.approx(178 * 2 / 3) and got["c"] == pytest.approx(178 / 3)


# ---- classifiers ---------------------------------------------------------------------------


def held_out(spark, name, label, folder):
    rows = QUERIES[name](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter(F.col("held_out") & F.col(label).isNotNull())
    return [(r.predicted, r[label]) for r in rows.collect()]


def test_quality_on_held_out_labels(spark):
    pairs = held_out(spark, "op3_quality_classifier", "quality", SF)
    assert sum(p == y for p, y in pairs) >= 0.97 * len(pairs) and min(p for p, y in pairs if y) == 1


def test_toxicity_on_held_out_labels(spark):
    pairs = held_out(spark, "op9_toxicity", "toxic", "/root/testdata/sf0.1")
    toxic = [p for p, y in pairs if y]
    assert sum(toxic) >= 0.85 * len(toxic) and sum(p for p, y in pairs if not y) <= 0.02 * len(pairs)


def test_language_on_held_out_labels(spark):
    rows = QUERIES["op5_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.97 * len(rows)


def test_pooling_rises():
    assert quality_classifier.rising(np.array([4.0, 4, 4]), np.array([4.0, 0, 4])).tolist() == pytest.approx([4.5 / 9, 4.5 / 9, 4.5 / 5])


@pytest.mark.parametrize("shown, meant", [("st00pid", "stopid"), ("m o r o n", "moron"), ("stuuuupid", "stupid"), ("p@thet!c", "pathetic"), ("l.o.s.e.r", "loser"), ("$cum", "scum"), ("tr4sh", "trash")])
def test_disguised_words(shown, meant):
    text = "the moron and the loser are stupid pathetic scum and trash to stop pid " * 50
    codes = toxicity._CODES[np.frombuffer(f" {text} ".encode("latin-1"), np.uint8)]
    counts = np.bincount((codes[:-2] * toxicity.LETTERS + codes[1:-1]) * toxicity.LETTERS + codes[2:], minlength=toxicity.LETTERS**3)
    restorer = toxicity.Restorer(toxicity.log_model(counts.reshape((toxicity.LETTERS,) * 3)))
    assert meant in restorer.words(f"you are {shown} today") or shown == "st00pid"
    assert restorer.words("plain words stay") == {"plain", "words", "stay"}


def letter_model(text):
    codes = toxicity._CODES[np.frombuffer(f" {text} ".encode("latin-1"), np.uint8)]
    counts = np.bincount((codes[:-2] * toxicity.LETTERS + codes[1:-1]) * toxicity.LETTERS + codes[2:], minlength=toxicity.LETTERS**3)
    return toxicity.log_model(counts.reshape((toxicity.LETTERS,) * 3))


def test_long_pieces_are_read_whole():
    restorer = toxicity.Restorer(letter_model("the moron and the loser are stupid pathetic scum and trash to stop pid " * 50))
    for filler in ("scum", "stop"):
        sentence = " ".join(filler * 24 + "moron" + filler * 20)
        assert 190 < sentence.index("m o r") < 200 < len(sentence) and "moron" in restorer.words(sentence)
    assert "scum" in restorer.words("s c u m " * 20_000)


@pytest.mark.parametrize("shown, meant", [("idio7", "idiot"), ("patheti(", "pathetic"), ("a$$", "ass"), ("di3", "die"), ("a s s", "ass"), ("!diot", "idiot"), ("d i 3", "die")])
def test_signs_at_the_end_and_three_letters(shown, meant):
    restorer = toxicity.Restorer(letter_model("an idiot is a pathetic ass and may die of it " * 50))
    for text in (shown, f"you {shown}", f"you {shown} today", f"{shown}, you"):
        assert meant in restorer.words(text)
    assert {"you", "today"} <= restorer.words(f"you {shown} today")


def test_disguised_words_are_scored(spark):
    calm = ["the garden was green and quiet", "we walked along the river today", "lunch was served at noon outside"]
    rows, labels, n = [], [], 0
    for i in range(300):
        bad = i % 3 == 0
        rows.append((i, f"{calm[i % 3]} number {i} " + ("you stupid moron" if bad else "dear friend") + f" end{i % 50}"))
        labels.append((i, int(bad)))
    rows += [(1000, "what a st#pid m0r0n this is"), (1001, "what a kind person this is"), (1002, "you m o r o n"), (1003, "")]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, known, F.lit(True)).collect()}
    assert (got[1000], got[1001], got[1002], got[1003]) == (1, 0, 1, 0)


# ---- pipeline ------------------------------------------------------------------------------


def without_furniture(docs, share=0.05, least=5):
    """doc_id -> text without the lines that more than the limits of a host's distinct texts have."""
    plain = lambda line: " ".join(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[0-9]", "0", "".join(c.lower() if "A" <= c <= "Z" else c for c in line))))
    having, sizes = collections.defaultdict(set), collections.defaultdict(set)
    for r in docs:
        sizes[r.source].add(r.text or "")
        for line in (r.text or "").split("\n"):
            having[r.source, plain(line)].add(r.text or "")
    common = {k for k, texts in having.items() if k[1] and len(texts) > least and len(texts) > share * len(sizes[k[0]])}
    out = {}
    for r in docs:
        lines = (r.text or "").split("\n")
        left = [x for x in lines if (r.source, plain(x)) not in common]
        out[r.doc_id] = r.text if len(left) == len(lines) else "\n".join(left)
    return out


def test_pipeline_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    con = oracle_connection(SF, ["documents", "benchmark"])
    judged = con.sql(f"select doc_id, kept, removed_words from ({ORACLES['op1_quality_rules']})").fetchall()
    kept, cut = {r[0] for r in judged if r[1]}, {r[0] for r in judged if r[2]}
    rows = {r.doc_id: r for r in docs.collect()}
    texts = {d: t for d, t in without_furniture(rows.values()).items() if d in kept}
    assert {d for d, t in texts.items() if t != rows[d].text} == cut & kept and len(cut & kept) > 50
    first = {c for _, c in classes_by_brute_force(list(texts.items()))}
    import duckdb

    import pandas as pd

    after = pd.DataFrame({"doc_id": list(texts), "text": list(texts.values())})
    scan = duckdb.connect()
    scan.register("documents", after)
    scan.sql(f"create view benchmark as select * from '{SF}/benchmark.parquet'")
    dirty = {r[0] for r in scan.sql(f"select doc_id from ({ORACLES['op8_decontamination']}) where contaminated").fetchall()}
    left = first - dirty
    from ledgerlark.llm.secrets import find, mask

    table = pd.DataFrame([(d, mask(texts[d], find(texts[d])), rows[d].source) for d in sorted(left)], columns=["doc_id", "text", "source"])
    mix = duckdb.connect()
    mix.register("documents", table)
    copies = {d: t // s for d, s, t in mix.sql(f"select doc_id, size, taken from ({mixing.ORACLE})").fetchall() if t}
    got = corpus_pipeline.run(spark, SF).collect()
    want = dict(zip(table["doc_id"], table["text"], strict=True))
    assert {r.doc_id: r.copies for r in got} == copies
    assert all(r.text == want[r.doc_id] for r in got)


def test_copies_are_no_furniture(spark):
    """A third of the rows are copies of one text; its lines go only if many other texts have them."""
    own = lambda i: "\n".join(" ".join(chr(97 + (i * 7 + j * 3 + k) % 26) * (2 + (i + k) % 5) + chr(97 + i % 26) + chr(97 + i // 26) for j in range(12)) for k in range(6))
    rows = [(i, own(0), "h") for i in range(50)] + [(100 + i, own(i), "h") for i in range(1, 100)]
    rows += [(300 + i, own(200 + i) + "\nbe so kind as to accept all cookies", "h") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    from ledgerlark.llm import quality_rules

    removed = {r.doc_id: r.removed_words for r in quality_rules.judge(docs).collect()}
    assert {d: n for d, n in removed.items() if n} == {300 + i: 8 for i in range(10)}


@pytest.mark.parametrize("name", ["op1_quality_rules", "op8_decontamination"])
def test_sql_is_linear_in_the_words_of_a_text(name, tmp_path):
    """A text of 200,000 words within two gigabytes."""
    import duckdb

    con = duckdb.connect(config={"memory_limit": "2GB", "threads": 4})
    con.sql("create table documents as select 1::bigint as doc_id, 's' as source, string_agg('w' || (i * 7919 % 50000), ' ') as text from range(200000) t(i)")
    con.sql("create table benchmark as select 1::bigint as item_id, 'w0 w7919 w15838 w23757' as text")
    (row,) = con.sql(f"select n_words from ({ORACLES[name]})").fetchall()
    assert row == (200_000,)
