"""Bounds and places that hold whatever the tables."""

import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratalens.llm import quality, suffix_repeats
from stratalens.session import shared_folder


def test_a_repeated_id_keeps_to_the_bound(spark, monkeypatch):
    """60,000 different texts of one labelled id, and as many equal rows of another."""
    many = spark.range(60_000).select(F.lit(1).alias("doc_id"), F.concat(F.lit("Some words, number "), F.col("id").cast("string")).alias("text"))
    same = spark.range(60_000).select(F.lit(2).alias("doc_id"), F.lit("Equal words.").alias("text"))
    few = spark.createDataFrame([(i, f"text {i}" if i % 3 else None) for i in range(3, 300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    seen = []
    fit = quality.fit
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append(len(x)) or fit(x, y))
    docs = many.union(same).union(few)
    for most in (20_000, 500):
        quality.train(docs, labels, most)
    held = {r["doc_id"] for r in labels.filter(quality.held_out(F.col("doc_id"))).collect()}
    assert 0 < seen[0] <= 20_000 and 0 < seen[1] <= 500
    quality.train(same.union(few), labels)
    assert seen[2] == len({2, *range(3, 300)} - held)  # equal rows count once


def test_stored_texts_are_in_the_shared_folder(spark):
    """Wherever the warehouse is: that may be a folder of each machine's own."""
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string")
    table = suffix_repeats.distinct_texts(docs)
    assert table.count() == 2
    files = table.inputFiles()
    assert files and all(f.removeprefix("file:").lstrip("/").startswith(shared_folder(spark).removeprefix("file:").lstrip("/")) for f in files)
    assert not any("warehouse" in f for f in files)


def near_copies(rnd, n):
    """Sides of one suffix in ``n`` near copies, sorted: each has a few places of its own, so that repeats nest."""
    base, made = bytes(rnd.choice(b"abc d") for _ in range(704)), []
    for _ in range(n):
        text = bytearray(base)
        for p in rnd.sample([*range(304), *range(400, 704)], rnd.randint(0, 2)):
            text[p] = rnd.choice(b"xyz ")
        made.append((bytes(text[304 : rnd.choice([704, 450])]), bytes(text[rnd.choice([0, 250]) : 304])[::-1]))
    return sorted(made)


def cover_of(rows, words):
    right, left = suffix_repeats.matrix(pa.array([r for r, _ in rows]), 400), suffix_repeats.matrix(pa.array([b for _, b in rows]), 304)
    return suffix_repeats.group_cover(*right, *left, words)


@pytest.mark.parametrize("n", [2, 3, 30])
def test_reaches_of_near_copies_by_pairs(n):
    """Every pair shares the bytes up to where it first differs; an end that isn't a word's end in both moves in."""
    rnd = random.Random(n)
    for _ in range(5):
        rows, long, short = near_copies(rnd, n), {}, set()
        for i, mine in enumerate(rows):
            for j, other in enumerate(rows):
                reach = [next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))) for a, b in zip(mine, other, strict=True)]
                if i == j or reach[0] + reach[1] < 101:
                    continue
                if sum(reach) >= 400:
                    long[i] = [max(x, y) for x, y in zip(long.get(i, reach), reach, strict=True)]
                    continue
                edges = [all(k == len(t[s]) or t[s][k] == 32 for t in (mine, other)) for s, k in enumerate(reach)]
                short.add((i, *[k - (not edge) for k, edge in zip(reach, edges, strict=True)]))
        got = [tuple(x) for x in cover_of(rows, 51).tolist()]
        assert {x for x in got if not x[3]} == {(i, back, ahead, 0) for i, (ahead, back) in long.items()}
        # what lies within the reach of 400-byte strings may be there or not
        within = lambda i, back, ahead: i in long and back <= long[i][1] and ahead <= long[i][0]
        best = {(i, back, ahead) for i, ahead, back in short if not any(y != (i, ahead, back) and y[0] == i and y[1] >= ahead and y[2] >= back for y in short)}
        assert {x[:3] for x in got if x[3] and not within(*x[:3])} == {x for x in best if not within(*x)}


def test_nested_repeats_of_near_copies_take_little_memory():
    rows = near_copies(random.Random(1), 400)
    tracemalloc.start()
    try:
        found = cover_of(rows, 51)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(found) > 1000 and most < 10_000 * len(rows)  # a few cells for each suffix and byte of reach, however many repeats nest
