"""Components in few rounds, and the choice of creators along chains against the rule applied one by one."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from ledgerlark.operators import outreach
from ledgerlark.operators.components import components


def by_hand(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return sorted((x, find(x)) for x in parent)


def chain(n, order):
    names = list(range(n))
    if order == "mixed":
        random.Random(3).shuffle(names)
    if order == "zigzag":
        names = [x for pair in zip(names[: n // 2], reversed(names[n // 2 :])) for x in pair]
    return list(zip(names, names[1:]))


@pytest.mark.parametrize("order", ["rising", "mixed", "zigzag"])
def test_a_long_chain_takes_few_rounds(spark, order):
    edges = chain(2000, order)
    found, rounds = components(spark.createDataFrame(edges, "a long, b long").repartition(4))
    assert rounds <= 12 and sorted(tuple(r) for r in found.collect()) == by_hand(edges)


def test_components_of_many_shapes(spark):
    r = random.Random(8)
    edges = [(-5, -5), (7, 100), *[(0, x) for x in range(200, 260)], *[(x, x + 1) for x in range(300, 330)], *[(r.randrange(400, 480), r.randrange(400, 480)) for _ in range(50)], (9, 7)]
    found, _ = components(spark.createDataFrame(edges, "a long, b long").repartition(3))
    assert sorted(tuple(x) for x in found.collect()) == by_hand(edges)
    assert components(spark.createDataFrame([], "a long, b long"))[0].collect() == []


def one_by_one(rows):
    """Creators: taken by id, a candidate creates unless an earlier creator has one of its keys."""
    taken, out = set(), []
    for org, name, keys in sorted(rows):
        if not any((org, k) in taken for k in keys):
            out.append((org, name))
            taken |= {(org, k) for k in keys}
    return sorted(out)


def candidates(seed):
    r = random.Random(seed)
    rows = [("a", f"q{i:05}", [f"u{(i + 1) // 2}", f"d{i // 2}"]) for i in range(2000)]  # each shares a key with the one before
    rows += [("b", f"z{i:03}", [f"k{r.randrange(60)}" for _ in range(r.choice([0, 1, 2, 3]))]) for i in range(150)]
    rows += [("c", f"s{i:03}", ["one", f"own{i % 40}"]) for i in range(200)] + [("d", "q00001", ["u1"]), ("d", "q00000", ["u1"])]
    r.shuffle(rows)
    return [(o, n, sorted(set(k))) for o, n, k in rows]


@pytest.mark.parametrize("rounds", [outreach.SETTLING_ROUNDS, 0])
def test_creators_along_chains(spark, monkeypatch, rounds):
    monkeypatch.setattr(outreach, "SETTLING_ROUNDS", rounds)
    rows = candidates(5)
    df = spark.createDataFrame(rows, "organization_id string, candidate_id string, keys array<string>").repartition(4)
    assert sorted(tuple(x) for x in outreach._creators(df).collect()) == one_by_one(rows)


def test_marking_a_chain(spark):
    companies = spark.createDataFrame([], "id string, organization_id string, profile_url string, name string, domain string, used_for_outreach boolean, first_outreach_date timestamp, last_outreach_date timestamp, outreach_count int, outreach_campaigns array<string>, created_at timestamp")
    asked = spark.createDataFrame([(f"q{i:03}", "a", f"u{(i + 1) // 2}", None, f"d{i // 2}.com") for i in range(101)], "candidate_id string, organization_id string, profile_url string, name string, domain string")
    after, result = outreach.mark_companies(companies, asked, "Spring", "2026-01-01")
    # every other candidate creates; the one behind it shares a key with it, and the one after that
    assert rows_of(after, "id") == [(f"new:q{i:03}",) for i in range(0, 101, 2)]
    assert result.count() == 101 and result.filter("was_already_used").count() == 50 and after.agg(F.sum("outreach_count")).first()[0] == 101
