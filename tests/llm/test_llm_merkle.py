"""Manifests against a plain tree."""

import hashlib
import os
import zlib

import pytest
from pyspark.sql import functions as F

from stratalens.llm import merkle, registry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(nodes, fanout):
    """The root, and each leaf's (before, after) by level."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            low = k // fanout * fanout
            proofs[i].append(("".join(nodes[low:k]), "".join(nodes[k + 1 : low + fanout])))
        at = [k // fanout for k in at]
        nodes = [h(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
    return nodes[0], proofs


def leaf(row):
    return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def plain(rows, fanout=16):
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([x[2] for x in sorted(by_source[s], key=lambda x: x[:3])], fanout) for s in names}
    root, tops = plain_tree([trees[s][0] for s in names], fanout)
    out = []
    for s, top in zip(names, tops):
        for (_, _, made, r), proof in zip(sorted(by_source[s], key=lambda x: x[:3]), trees[s][1]):
            steps = proof + top
            node = made
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                node = leaf((*r[:4], r[4] if r[4] is None else r[4].encode().lower().decode()))
            for before, after in steps:
                node = h(before, node, after)
            out.append((r[0], made, trees[s][0], root, h(*(a + b for a, b in steps)), node, node == root))
    return sorted(out, key=repr)


def got(frame, fanout=16, levels=2):
    rows = merkle.manifest(merkle.document_leaves(frame), ["doc_id"], fanout, levels)
    rows = rows.withColumn("folded", merkle.folded(F.coalesce("changed", "digest"), F.col("proof")))
    return sorted((tuple(r) for r in rows.select("doc_id", "digest", "subroot", "root", merkle.siblings(F.col("proof")), "folded", F.col("folded") == F.col("root")).collect()), key=repr)


@pytest.mark.parametrize(("fanout", "levels"), [(16, 2), (2, 1)])
def test_trees_of_all_sizes(spark, fanout, levels):
    """Sources of 1 to 40 rows, one of many; missing values; rows that are fully repeated."""
    rows = [(1000 * n + i, f"s{n}", "en", i, f"Text {i} of {n}") for n in (1, 2, 3, 4, 8, 9, 15, 16, 17, 40) for i in range(n)]
    rows += [(i, "hot", None, None, None if i % 7 == 0 else "É A" * (i % 5)) for i in range(0, 610, 2)]
    rows += [(None, None, "de", 3, "No Id"), (None, None, "de", 3, "No Id"), (5, None, "de", 3, ""), (7, "", "de", 3, "UPPER"), (2**60 + 1, "é", "x", 1, "L"), (7, "", "de", 3, "UPPER"), (9, "big", "x", 1, "Z" * 300_000)]
    frame = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in ("tree", "idx", "size", "digest", "proof", "root", "block")})
    assert got(frame, fanout, levels) == plain(rows, fanout)


def test_more_blocks_than_one(spark):
    rows = [(i, "one", "en", i, f"Text {i}") for i in range(700)] + [(i, f"many {i}", "en", i, "x") for i in range(300)]
    assert got(spark.createDataFrame(rows, DOCS)) == plain(rows)


def test_no_rows_and_one(spark):
    assert got(spark.createDataFrame([], DOCS)) == []
    rows = [(0, "s", "l", 1, "T")]
    assert got(spark.createDataFrame(rows, DOCS)) == plain(rows)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables")
def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    out = registry.QUERIES["op12_merkle_manifest"](spark, SF_DIR)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    found = [tuple(r) for r in out.collect()]
    assert sorted(found, key=repr) == plain(rows)
    assert any(not r[-1] for r in found) and sum(r[-1] for r in found) > len(found) / 2
