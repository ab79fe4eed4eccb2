"""Repeated passages of over 50 words that have fewer than 400 bytes."""

import hashlib
import random
import re
from collections import Counter

import corpus_pipeline
import pytest
from test_llm_operators import DOCS, ROWS, words

from stratalens.llm import suffix_repeats


def brute_cut(texts, n_words, length=400):
    """Plain version: (bytes gone, spans, what is kept) of each text."""
    raw = [(t or "").encode() for t in texts]
    strings = [[(i, i + length) for i in range(len(b) - length + 1)] for b in raw]
    for b, spans in zip(raw, strings, strict=True):
        at = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)]
        spans += [(at[i][0], at[i + n_words - 1][1]) for i in range(len(at) - n_words + 1)]
        if len(at) >= n_words:
            spans.append((0, len(b)))  # a whole text with a copy goes whole
    count = Counter(b[x:y] for b, spans in zip(raw, strings, strict=True) for x, y in set(spans))
    out = []
    for b, spans in zip(raw, strings, strict=True):
        gone = bytearray(len(b))
        for x, y in spans:
            if count[b[x:y]] > 1:
                gone[x:y] = b"\1" * (y - x)
        out.append((sum(gone), len(re.findall(b"\x01+", bytes(gone))), bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    return out


def results(df):
    return {bytes(r["digest"]): (r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in df.collect()}


def test_stage_cuts_a_passage_of_51_words(spark):
    rnd = random.Random(4)
    short, shorter = (" ".join(words(rnd, n)) for n in (51, 50))
    assert len(short.encode()) < 400
    own = [" ".join(f"{w}{i}" for w in words(rnd, 90)) for i in range(4)]
    texts = [f"{own[0]} {short} {own[1]}", f"{own[2]}\n{short}\t{own[3]}", f"{own[1][:200]} {shorter} x", f"{own[3][-200:]} {shorter} y"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.cut_repeats(spark, docs, "").collect()}
    want = [f"{own[0]}  {own[1]}", f"{own[2]}\n\t{own[3]}", texts[2], texts[3]]
    assert got == {i: (t, len(t)) for i, t in enumerate(want)}


@pytest.mark.parametrize(("hot", "n_words"), [(suffix_repeats.HOT, 51), (12, 25), (2, 51)])
def test_passages_against_brute_force(spark, hot, n_words):
    rnd = random.Random(6)
    parts = [" ".join(words(rnd, n)) for n in (n_words, n_words + 1, n_words - 1, n_words + 5)]
    made = [f"{' '.join(words(rnd, 9))}{rnd.choice([' ', chr(10), '  '])}{rnd.choice(parts)} {rnd.choice(parts)}{rnd.choice(['', ' end'])}" for _ in range(40)]
    # one break in the white space only, copies below and above the bounds, a passage twice in a text
    made += [parts[3].replace(" ", "  ", 1), parts[1] + " " * 3, "a " * 60, "", "", "b c", "b c", parts[0] + " and " + parts[0]]
    texts = [r[1] for r in ROWS] + made
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {hashlib.md5((t or "").encode()).digest(): cut for t, cut in zip(texts, brute_cut(texts, n_words), strict=True)}
    assert results(suffix_repeats.remove_repeats(rows, hot, words=n_words)) == want
