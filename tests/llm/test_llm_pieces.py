"""The piece codec against the library whose vocabulary it reads."""

import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalens.llm import piece_codec, registry, tokens

PATH = tokens.vocabulary("piece_bpe_32k.model")
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def codec():
    return piece_codec.PieceModel(PATH)


def test_ids_equal_the_library(codec):
    rnd = random.Random(5)
    parts = [*"abcdething  \n\t\r\x00﻿é▁ß中文字ゼ梦😀�́", "tion", "the", " of", "<s>", "<0x41>", "ing", "###"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(2500)]
    texts += [h + " " * n + t for n in range(1, 70) for h in ("", "x", "\n") for t in ("", "the", "\n")]  # runs of spaces have equal scores
    texts += ["a" * 5000, "".join(rnd.choice("abcdefgh") for _ in range(20000)), "中" * 3000, ""]
    for t in texts:
        ids = codec.ids(t).tolist()
        assert ids == codec.library.encode(t)
        assert codec.text(np.array(ids, np.int32)) == codec.library.decode(ids)


def test_texts_of_any_ids_equal_the_library(codec):
    rnd = random.Random(6)
    for _ in range(3000):
        ids = [rnd.choice([rnd.randrange(32000), rnd.randrange(259), 0, 1, 2, 28705, 259, rnd.randrange(100, 260)]) for _ in range(rnd.randint(0, 12))]
        assert codec.text(np.array(ids, np.int32)) == codec.library.decode(ids)


def test_small_caches_change_nothing(monkeypatch):
    monkeypatch.setattr(piece_codec, "CACHE_WORDS", 5)
    monkeypatch.setattr(piece_codec, "CACHE_PAIRS", 5)
    codec = piece_codec.PieceModel(PATH)
    text = " ".join(f"word{i % 13} other{i % 7}" for i in range(200))
    assert codec.ids(text).tolist() == codec.library.encode(text)


def test_places_fail_once(codec):
    """Where the longest pieces don't fit, shorter ones are found: merging 'ab' first can forbid the longest piece."""
    tiny = codec.fits.merged
    for word in ("▁unfortunately", "▁incompatibilities", "▁thethethe", "▁aabbaabb"):
        assert codec.lay(word) == tiny(word)


def test_rows(spark):
    rows = [(1, None), (2, ""), (3, "the cat"), (3, "the cat"), (None, " x"), (5, "word " * 30000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit("clash"), "n_tokens": F.lit(1)})
    coded = piece_codec.encode_pieces(docs, PATH)
    lib = piece_codec.PieceModel(PATH).library
    want = [(i, [1, *lib.encode(t or ""), 2]) for i, t in rows]
    assert sorted(((r["doc_id"], r["ids"]) for r in coded.collect()), key=repr) == sorted(want, key=repr)
    back = piece_codec.decode_pieces(coded, PATH).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in back), key=repr) == sorted(((i, t or "") for i, t in rows), key=repr)
    assert [r["ids"] for r in piece_codec.encode_pieces(docs.filter("doc_id = 3"), PATH, begin=False, end=False).collect()] == [lib.encode("the cat")] * 2
    none = docs.filter("false")
    assert piece_codec.digests(piece_codec.encode_pieces(none, PATH), PATH).count() == 0 and piece_codec.decode_pieces(piece_codec.encode_pieces(none, PATH), PATH).count() == 0
    lost = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert piece_codec.decode_pieces(lost, PATH).first()["text"] == "" and piece_codec.digests(lost, PATH).first()["n_tokens"] == 0


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables")
def test_query(spark):
    lib = piece_codec.PieceModel(PATH).library
    digest = lambda b: hashlib.sha256(b).hexdigest()
    want = set()
    for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect():
        ids = lib.encode(r["text"] or "", add_bos=True, add_eos=True)
        want.add((r["doc_id"], len(ids), digest(np.array(ids, "<u4").tobytes()), digest(lib.decode(ids).encode())))
    assert {tuple(r) for r in registry.QUERIES["op11_piece_backtracking"](spark, SF_DIR).collect()} == want
