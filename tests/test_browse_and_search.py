"""Trigram search against a scan, and many queries against all products."""

import random

import numpy as np
import pytest

from stratalens.operators import browse, monitors, search


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(8)
    parts = ["alpha", "Beta", "gam", "ma", " ", "\n", "É", "ß", "delta", "%", "a+b", "😀", "_"]
    rows = [(i, rnd.choice([None, "", "T" + rnd.choice(parts)]), rnd.choice([None, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))]), rnd.choice(["X", "Y", None])) for i in range(300)]
    rows += [(1000, "long", "z" * 200_000 + "needle" + "z" * 1000, "X"), (1001, "no", "ab", "Y")]
    return spark.createDataFrame(rows, "id long, title string, clean_text string, topic string")


def test_the_index_finds_what_a_scan_finds(spark, docs, tmp_path):
    path = str(tmp_path / "index")
    browse.build(docs, path)
    for query, topic in (("alpha", None), ("GAMMA", None), ("beta", "X"), ("a+b", None), ("%", None), ("é", None), ("ß😀", None), ("needle", None), ("zzneedlezz", "X"), ("nothing like it", None), ("", None), ("ab", "Y"), ("a\nb", None), ("\ndelta", None)):
        want = [r["id"] for r in monitors.keyword_browser(docs, query, topic, 50).collect()]
        assert [r["id"] for r in browse.search(spark, path, query, topic, 50).collect()] == want, query


def test_only_candidates_are_read(spark, docs, tmp_path):
    path = str(tmp_path / "index")
    browse.build(docs, path)
    assert [r["id"] for r in browse.candidates(spark, path, "Needle").collect()] == [1000]
    assert browse.candidates(spark, path, "qqqqq").count() == 0 and browse.candidates(spark, path, "no") is None
    plan = browse.search(spark, path, "needle")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "folder" in plan


@pytest.mark.parametrize("block", [4096, 7])
def test_many_queries(spark, block):
    rng = np.random.default_rng(3)
    vectors = rng.integers(-3, 4, (700, 5)).astype(float)  # many ties
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(900, [1.0]), (901, None), (902, [1.0, None, 1.0, 1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    asked = [(f"q{i}", rng.integers(-3, 4, 5).astype(float).tolist()) for i in range(40)]
    queries = spark.createDataFrame([*asked, ("odd", [1.0, 2.0]), ("none", None)], "query_id string, embedding array<float>")
    got = search.search_many(frame, queries, 6, block=block)
    want = set()
    for name, q in asked:
        scores = vectors @ np.array(q)
        for rank, i in enumerate(np.lexsort((np.arange(700), -scores))[:6]):
            want.add((name, rank + 1, int(i), float(scores[i])))
    assert {tuple(r) for r in got.collect()} == want
    assert search.search_many(frame, queries.filter("false"), 6).count() == 0
    assert search.search_many(frame.filter("false"), queries, 6).count() == 0
    assert search.search_many(frame.limit(2), queries.filter("query_id = 'q1'"), 6).count() == 2


def test_a_thousand_queries_in_one_scan(spark):
    rng = np.random.default_rng(4)
    vectors = rng.random((3000, 16))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors[:1000])], "query_id long, embedding array<double>")
    got = {}
    for r in search.search_many(frame, queries, 3).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    scores = vectors[:1000] @ vectors.T
    best = np.argsort(-scores, axis=1)[:, :3]
    assert all([got[i][k] for k in (1, 2, 3)] == best[i].tolist() for i in range(1000))
