"""Filter audit: against brute force over documents, SQL on odd rows, and packed sums near their limit."""

import random
import re
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlark.llm import interactions
from ledgerlark.llm.queries import QUERIES
from tools.compare import sorted_rows

COLUMNS = ["part", "filter_order", "step", *interactions.COUNTS]


def conditions(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    upper = sum("A" <= c <= "Z" for c in text)
    return [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * upper > 2 * len(text), any(c in "#$%&*|" for c in text)]


def by_hand(docs, labels):
    """One document after the other, through every order."""
    big = 2**63 - 1
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    rows = [(big if i is None else i, s or "", t or "") for i, t, s in docs]
    first = {}
    for i, _, t in rows:
        first[t] = min(i, first.get(t, big))
    fails = {(i, t): dict(zip("ABCDE", [*conditions(t), i > first[t]], strict=True)) for i, _, t in rows}
    out, shapley = [], {}
    for part in {s for _, s, _ in rows}:
        mine = [(i, t) for i, s, t in rows if s == part]
        for order in map("".join, permutations("ABCDE")):
            left = list(mine)
            for step, letter in enumerate(order, 1):
                hit = [d for d in left if fails[d][letter]]
                left = [d for d in left if not fails[d][letter]]
                all_failing = sum(fails[d][letter] for d in mine)
                alone = sum(fails[d][letter] and sum(fails[d].values()) == 1 for d in mine)
                out.append([part, order, step, len(left), len(hit), all_failing - len(hit), alone, sum(i in good and i != big for i, _ in hit), sum(i in toxic and i != big for i, _ in hit)])
                shapley[part, letter] = shapley.get((part, letter), 0) + len(hit)
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def some_documents(seed=3):
    r = random.Random(seed)
    texts = [" ".join(r.choice(["w", "Word", "x#", "y"]) + str(r.randrange(r.choice([20, 3000]))) for _ in range(r.choice([0, 5, 199, 200, 260]))) for _ in range(40)]
    docs = [(i, r.choice(texts), r.choice(["a", "b", None, ""])) for i in r.sample(range(500), 150)]
    docs += [(None, texts[0], "a"), (None, texts[0], "b"), (None, None, None), (None, "ÄÖ Ü\n" * 80, "c"), docs[0], docs[0], (docs[1][0], docs[1][1], "c"), (docs[2][0], "other", "a")]
    labels = [(d[0], r.choice([0, 1, None]), r.choice([0, 1])) for d in docs[:120]] + [(docs[0][0], 1, 1), (docs[0][0], 0, 0), (None, 1, 1), (999, 1, 1)]
    return docs, labels


def test_against_every_document(spark):
    docs, labels = some_documents()
    table = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = interactions.audit(table, known)
    assert got.columns == COLUMNS
    assert sorted(tuple(r) for r in got.collect()) == by_hand(docs, labels)
    extra = table.select("*", *[F.lit("own").alias(c) for c in ("mask", "digest", "part", "n", "good", "cells", "kept")])
    assert sorted(tuple(r) for r in interactions.audit(extra, known).collect()) == by_hand(docs, labels)


def test_sql_on_the_same_rows(spark, tmp_path):
    docs, labels = some_documents(8)
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    df, want = QUERIES["op12_filter_audit"](spark, str(tmp_path)), con.sql(interactions.ORACLE)
    assert sorted_rows(df.columns, df.collect()) == sorted_rows(want.columns, want.fetchall())


def test_odd_and_empty_rows(odd, crowded, none, labels):
    got = sorted(tuple(r) for r in interactions.audit(odd, labels).collect())
    assert got == sorted(tuple(r) for r in interactions.audit(crowded, labels).collect())
    assert len(got) == 600 * 4 and {r[0] for r in got} == {"", "a", "b", "c"}
    assert interactions.audit(none, labels).collect() == []
    bare = interactions.audit(odd, labels.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost")).first()
    assert tuple(bare) == (0, 0)


@pytest.mark.parametrize("filters", ["AB", "ABCDE"])
def test_fields_do_not_run_over(filters):
    wide = interactions.Wide(filters)
    most = (2**63 - 1) // len(wide.of_mask)
    held = [(mask, most, 0, most) for mask in range(len(wide.of_mask))]
    kept, removed, redundant, alone, good, toxic, shapley = wide.outcomes(held)
    whole = most * len(held)
    assert (kept[:, -1] == most).all() and (removed[:, 0] == whole // 2).all() and (removed[:, 1] == whole // 4).all()
    assert (removed + redundant == whole // 2).all() and (alone == most).all() and not good.any() and (toxic == removed).all()
    assert (shapley.sum(1) == (whole - most) * len(wide.orders)).all() if whole * len(wide.orders) < 2**63 else True


def test_orders_are_all_there():
    wide = interactions.Wide()
    assert len(set(wide.orders)) == 120 and wide.steps == 600 and len(wide.of_mask) == 32
    removed, n = wide.unpack(wide.of_mask[0b10010])
    assert n == 1 and np.array_equal(removed.sum(1), np.ones(120))
