"""Periodic texts: few suffixes are sampled, and nothing that repeats is lost."""

import hashlib
import random

import numpy as np
import pytest
from test_llm_operators import words
from test_llm_passages import brute_cut, results

from stratalens.llm import ngram_join, packing, phrase_index, quality, simhash, suffix_repeats, textnum


def periodic(rnd):
    unit = rnd.choice(["Is onhe. ", "a ", "z", "tho ren ing sha ", "é", " ".join(words(rnd, 6)) + "\n", "ab"])
    return unit * rnd.randint(1, 900 // len(unit) + 2)


def made(seed, n):
    rnd = random.Random(seed)
    fixed = [" ".join(words(rnd, k)) for k in (3, 20, 60)]
    texts = []
    for _ in range(n):
        parts = [rnd.choice([periodic(rnd), rnd.choice(fixed), " ".join(words(rnd, 12)), periodic(rnd)]) for _ in range(rnd.randint(1, 4))]
        texts.append(rnd.choice(["", " ", "\n"]).join(parts))
    return texts


@pytest.mark.parametrize(("hot", "n_words"), [(suffix_repeats.HOT, None), (suffix_repeats.HOT, 51), (6, 51), (1, 30)])
def test_against_brute_force(spark, hot, n_words):
    texts = made(11, 70)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {hashlib.md5(t.encode()).digest(): cut for t, cut in zip(texts, brute_cut(texts, n_words or 10**9), strict=True)}
    assert results(suffix_repeats.remove_repeats(rows, hot, n_words)) == want


def test_a_long_period_needs_few_samples():
    text = b"start of it " + b"Is onhe. " * 3000 + b"and the end of it"
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    for n_words in (None, 51):
        pos, _, own = suffix_repeats.seeds(data, offsets, words=n_words)
        assert len(pos) < 12
        assert own[:, 2].tolist() == ([0, 1] if n_words else [0])


def test_strings_only_counts_passages(spark):
    rnd = random.Random(5)
    passage = " ".join(words(rnd, 52))
    texts = [" ".join(words(rnd, 30)) + " " + passage + "\n" + " ".join(words(rnd, 30)) for _ in range(2)] + [" ".join(words(rnd, 200))]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {bytes(r["digest"]): r for r in suffix_repeats.remove_repeats(rows, words=51, strings_only=True).collect()}
    for t in texts:
        r = got[hashlib.md5(t.encode()).digest()]
        has = passage in t
        assert (r["n_removed"], r["n_spans"], bytes(r["kept"]), r["n_passages"], r["n_repeated"]) == (0, 0, t.encode(), int(has), len(passage.encode()) * has)


def test_very_long_texts_in_pieces(monkeypatch):
    """Pieces of a text sample at least what its windows need, at the same places, and words hash alike."""
    rnd = random.Random(9)
    text = " ".join([*words(rnd, 400), *["Is onhe."] * 200, *words(rnd, 500), "z" * 900, *words(rnd, 300)]).encode()
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    start, end, _ = textnum.words(data, offsets, textnum.SPACE)
    whole = textnum.word_hashes(data, start, end)
    for n_words in (None, 51):
        pos, hashes, _ = suffix_repeats.seeds(data, offsets, words=n_words)
        monkeypatch.setattr(suffix_repeats, "PIECE_BYTES", 1000)
        got, same, own = suffix_repeats.seeds_of_long(data, n_words)
        assert set(zip(pos.tolist(), hashes.tolist(), strict=True)) <= set(zip(got.tolist(), same.tolist(), strict=True)) and len(set(got.tolist())) == len(got)
        assert all(text[a:b] in text[:a] + text[a + 1 :] or b - a > 400 for a, b, _ in own.tolist())
    for size in (1, 50, 900, 5000):
        monkeypatch.setattr(textnum, "LONG", size)
        assert (textnum.word_hashes(data, start, end) == whole).all()


def test_a_text_of_megabytes_through_the_operators(spark):
    rnd = random.Random(6)
    vocabulary = words(rnd, 5000)
    passage = " ".join(words(rnd, 60))
    long = " ".join(rnd.choice(vocabulary) for _ in range(900_000))
    rows = spark.createDataFrame([(1, long + " " + passage), (2, passage + " " + " ".join(words(rnd, 80))), (3, long)], "doc_id long, text string")
    cut = {r["n_bytes"]: r for r in suffix_repeats.remove_repeats(rows, words=51).drop("kept").collect()}
    assert len(cut) == 3 and all(r["n_passages"] >= 1 for r in cut.values())
    assert sorted(r["n_removed"] for r in cut.values())== [len(passage.encode()), len(long.encode()), len(long.encode()) + len(passage.encode())]
    assert ngram_join.near_duplicates(rows).count() == 3
    found = {r["doc_id"]: r for r in phrase_index.contamination(rows, spark.createDataFrame([(7, passage)], "item_id long, text string")).collect()}
    assert found[1]["n_hit"] >= 60 and found[2]["contaminated"] and not found[1]["contaminated"]
    assert simhash.with_next(rows).count() == 3
    model = quality.Model(np.zeros(51), np.ones(51), np.zeros(51), 0.0)
    assert quality.score_documents(rows, model).count() == 3
    assert packing.pack_documents(rows.filter("doc_id < 3")).count() > 900
