"""One-by-one admission without a round for each link of a chain."""

import random

import pytest

from stratalens.operators import dedup

KEYS = "seq long, url string, content_hash string"


def sequential(rows):
    urls, hashes, kept = set(), set(), []
    for seq, u, h in sorted(rows):
        if (u is None or u not in urls) and (h is None or h not in hashes):
            kept.append(seq)
            urls.add(u)
            hashes.add(h)
    return kept


@pytest.fixture
def counted(monkeypatch):
    """How many tables are stored."""
    calls, real = [], dedup.store

    def store(df):
        calls.append(1)
        return real(df)

    monkeypatch.setattr(dedup, "store", store)
    return calls


def chain(n, order):
    """Row i shares its url with one neighbour and its hash with the other."""
    return [(order[i], f"u{(i + 1) // 2}", f"h{i // 2}") for i in range(n)]


@pytest.mark.parametrize("shuffled", [False, True])
def test_a_long_chain_takes_few_rounds(spark, counted, shuffled):
    order = list(range(10_000))
    if shuffled:
        random.Random(4).shuffle(order)
    rows = chain(10_000, order)
    got = sorted(r["seq"] for r in dedup.admit(spark.createDataFrame(rows, KEYS)).collect())
    assert got == sequential(rows)
    assert len(counted) < 70  # not thousands


def test_components(spark):
    order = list(range(3000))
    random.Random(5).shuffle(order)
    rows = chain(3000, order)[:1000] + [(s, f"v{i}", f"g{i // 7}") for i, s in enumerate(order[1000:])]
    frame = spark.createDataFrame(rows, KEYS).selectExpr("seq", "concat('u', url) AS _u", "concat('h', content_hash) AS _h")
    got = {r["seq"]: r["_c"] for r in dedup.components(frame, "seq").collect()}
    want = {s: min(order[:1000]) for s in order[:1000]}
    for i in range(0, 2000, 7):
        group = order[1000 + i : min(1000 + i + 7, 3000)]
        want |= {s: min(group) for s in group}
    assert got == want


@pytest.mark.parametrize("component_rows", [2_000_000, 5])
def test_hot_keys_and_large_components(spark, component_rows):
    """A third of the rows under one url, a third under one hash, chains, and components that are too large for a task."""
    rnd = random.Random(6)
    rows = [(i, "", f"h{i}") for i in range(300)] + [(300 + i, f"w{i}", "same") for i in range(300)]
    rows += [(s + 600, u, h) for s, u, h in chain(60, rnd.sample(range(60), 60))] + [(700 + i, rnd.choice([None, f"u{i % 40}"]), rnd.choice([None, f"h{i % 30}"])) for i in range(300)]
    rows += [(2000 + i, "x", "y") for i in range(50)]
    got = sorted(r["seq"] for r in dedup.admit(spark.createDataFrame(rows, KEYS), component_rows=component_rows).collect())
    assert got == sequential(rows)


def test_null_keys_are_grouped_in_the_same_pass(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "a"), (4, None)], "seq long, name string")
    out = dedup.first_by(rows, "name", "seq")
    assert sorted(r["seq"] for r in out.collect()) == [1, 2, 4]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
