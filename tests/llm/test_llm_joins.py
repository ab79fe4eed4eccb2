"""The n-gram join's pairs, links and what its prefixes spare."""

import random
from collections import Counter

import llm_brute as brute
from pyspark.sql import functions as F

from stratalens.llm import ngram_join

DOCS = "doc_id long, text string"


def near_the_bound(seed, n=170):
    """Texts of some bases, cut and changed by about as much as a link bears, with copies, nulls and an id that comes twice."""
    rnd = random.Random(seed)
    bases = [[f"w{rnd.randrange(900)}" for _ in range(rnd.choice([3, 5, 9, 40, 130, 400]))] for _ in range(7)]
    rows = []
    for i in range(n):
        w = list(rnd.choice(bases))
        w = w[: max(1, int(len(w) * rnd.uniform(0.72, 1)))] if rnd.random() < 0.6 else w
        for _ in range(rnd.choice([0, 0, 0, 1, 1, 2]) * max(1, len(w) // 90)):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(9)}"
        rows.append((i, " ".join(w)))
    return [*rows, rows[3], (7, rows[8][1]), (None, rows[9][1]), (None, rows[9][1]), (200, None), (201, ""), (202, " \n"), (203, "A b"), (204, "a B")]


def links(rows):
    """(id, set size, links) of each row, and the pairs of different sets, by looking at all pairs."""
    sets = [frozenset(brute.shingles(t)) for _, t in rows]
    copies, beside, pairs = Counter(sets), Counter(), 0
    kinds = sorted((s for s in copies if s), key=len)
    for i, a in enumerate(kinds):
        for b in kinds[:i]:
            if 100 * len(a & b) >= 75 * len(a | b):
                pairs += 1
                beside[a] += copies[b]
                beside[b] += copies[a]
    return [(k, len(s), beside[s] + copies[s] - 1 if s else 0) for (k, _), s in zip(rows, sets, strict=True)], pairs


def test_all_links_between_different_texts(spark):
    rows = near_the_bound(1)
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("set", "a", "b", "n", "rows", "chunk", "band")})
    want, pairs = links(rows)
    assert pairs > 100
    assert Counter(map(tuple, ngram_join.count_links(docs).collect())) == Counter(want)
    assert Counter(map(tuple, ngram_join.near_duplicates(docs).collect())) == Counter(brute.near_components(rows))


def test_pairs_of_different_sets(spark):
    rows = near_the_bound(2)
    members, found = ngram_join.similar_sets(spark.createDataFrame(rows, DOCS))
    found = found.collect()
    assert len({(r["a"], r["b"]) for r in found}) == len(found) == links(rows)[1] > 100 and all(r["a"] < r["b"] for r in found)
    named = {(r["doc_id"], r["set"]) for r in members.collect()}
    assert {s for k, s in named if k in (200, 201, 202)} == {None} and len({s for k, s in named if k in (203, 204)}) == 1
    none = spark.createDataFrame([], DOCS)
    assert ngram_join.count_links(none).count() == 0


def test_a_template_costs_no_pairs(spark):
    """A fifth of own words: all share prefix shingles, none are linked, and none meet."""
    rows = [(i, " ".join([f"own{i}x{j}" for j in range(24 + i % 3)] + [f"all{j}" for j in range(100)])) for i in range(120)]
    docs = spark.createDataFrame(rows, DOCS)
    _, _, postings = ngram_join.sets_and_postings(docs, ngram_join.WIDTH)
    assert postings.groupBy("token").count().agg(F.max("count")).first()[0] == 120
    assert ngram_join.index_postings(postings).count() == 0
    assert {tuple(r) for r in ngram_join.count_links(docs).collect()} == {(i, 120 + i % 3, 0) for i in range(120)}
