"""Spelling variants against all pairs."""

import os
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stratalens.llm import registry, spelling

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LETTERS = "abcdefghijklmnopqrstuvwxyzàéßÿ×"


def plain_counts(docs, least=7):
    n = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: k for w, k in n.items() if len(w) >= least and k >= 2}


def edits(w, letters):
    for i in range(len(w) + 1):
        yield w[:i] + w[i + 1 :]
        for c in letters:
            yield w[:i] + c + w[i:]
            yield w[:i] + c + w[i + 1 :] if i < len(w) else w


def plain(counts):
    letters = {c for w in counts for c in w}
    near = {w: {v for v in edits(w, letters) if v != w and v in counts} for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), None if form[w] is None else counts[form[w]]))
    return out


def lexicon(seed, n=120):
    rnd = random.Random(seed)
    words = set()
    while len(words) < n:
        base = "".join(rnd.choice("abé") for _ in range(rnd.randint(7, 11)))
        words.add(base)
        for _ in range(rnd.randint(0, 6)):
            words.add(rnd.choice([*edits(rnd.choice(sorted(words)), "abzé")]))
    return {w: rnd.choice([2, 3, 25, 30, 300, 4000]) for w in words if len(w) >= 7}


@pytest.mark.parametrize(("seed", "group_words"), [(1, 20_000), (2, 20_000), (3, 4), (4, 1)])
def test_all_pairs(spark, seed, group_words):
    """Few letters, so words are near many others; small bounds split groups down to single places."""
    counts = lexicon(seed)
    counts |= {"aaaaaaa": 2, "aaaaaaaa": 25, "aaaaaaaaa": 400, "aaaaaaaaaa": 5000}  # a chain, and added characters that could stand anywhere
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert {tuple(r) for r in spelling.variants(frame, group_words=group_words).collect()} == plain(counts)


def test_automaton_numbers():
    words = sorted(lexicon(7))
    a = spelling.Automaton(words)
    for i, w in enumerate(words):
        node, number = a.walk(a.start, 0, w)
        assert number == i and a.nodes[node][0]
    assert a.walk(a.start, 0, "zzzz") is None and a.sizes[a.start] == len(words)
    assert len(a.nodes) < sum(map(len, words)) / 3  # equal ends are one node
    assert list(spelling.Automaton([]).one_error("", "abc")) == []


def test_counts(spark):
    rnd = random.Random(9)
    pool = list(lexicon(11, 40)) + ["short", "Abcdefg", "ABCDEFG", "ÀÉabcde", "àéabcde", "x×y÷zabcd"]
    docs = [(i, " ".join(rnd.choice(pool) + rnd.choice(["", ",", "1", "_"]) for _ in range(rnd.randint(0, 200)))) for i in range(60)]
    docs += [(None, "Abcdefg abcdefg"), (3, None), (3, ""), docs[7], docs[7], (99, "q" * 50_000 + " " + "q" * 50_000 + " " + "q" * 50_001), (98, "q" * 50_000 + " " + "q" * 50_001)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"word": F.lit("clash"), "n": F.lit(1)})
    counts = plain_counts(docs)
    got = spelling.word_counts(frame)
    assert {r["word"]: r["n"] for r in got.collect()} == counts
    assert {tuple(r) for r in spelling.variants(got).collect()} == plain({w: n for w, n in counts.items() if len(w) < 1000}) | {
        (w, None, w, counts[w], 1, None) for w in counts if len(w) > 1000
    }
    assert spelling.variants(spelling.word_counts(frame.filter("false"))).count() == 0


def test_few_words_are_held(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD_WORDS", 3)
    docs = [(i, "wordone wordtwo wordthree wordfour wordfive wordsix") for i in range(20)]
    assert {r["word"]: r["n"] for r in spelling.word_counts(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == plain_counts(docs)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables")
def test_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    assert {tuple(r) for r in registry.QUERIES["op13_spelling_variants"](spark, SF_DIR).collect()} == plain(plain_counts(docs))
