"""A Merkle manifest of a table: a tree of digests for each group of rows, and one over the groups.

Nodes are numbered within their tree.  A superblock is what a fixed number of levels
collapses into one node; blocks are the nodes' numbers divided by the fanout to that
power.  Going up, each block of each tree is collapsed in its own group, and the block
roots are the next round's nodes, until every tree has one.  Going down, each block
meets its root's proof, and the proofs within the block are put before it.  A round
holds a small part of the rows of the round before, a group holds one block, and
rounds are stored.
"""

from __future__ import annotations

import functools
import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

FANOUT = 16
#: Levels that one group collapses: 256 nodes to one.
LEVELS = 2
PROOF = "array<struct<before: string, after: string>>"


def digest(*parts: Column) -> Column:
    """Hex SHA-256 of strings put together."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(x: Column) -> Column:
    """A value with its length in bytes before it, and '-' for null."""
    s = x.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def _h(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def collapse(nodes: list[str], count: int, fanout: int = FANOUT, levels: int = LEVELS) -> list[list[str]]:
    """The levels above a block's nodes, of a tree of ``count`` nodes; a tree that fits the block ends with its single node."""
    out, whole = [nodes], count <= fanout**levels
    while len(out[-1]) > 1 if whole else len(out) <= levels:
        out.append([_h(out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``idx``, each row's number within its ``tree``, and ``size``, the tree's rows.

    Rows are dealt into sorted ranges of all trees together and stored, so that a tree
    of any size is spread; small tables say where each tree's part of a range begins.
    """
    keys = [F.col(c).asc_nulls_first() for c in ("tree", *order)]
    ranges = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    ranges = common.materialise(ranges, "merkle-sorted").withColumn("_range", F.shiftright("_id", 33))
    parts = ranges.groupBy("tree", "_range").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    every = Window.partitionBy("tree")
    before = every.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("tree", "_range", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(every).alias("size"))
    return ranges.join(starts, ["tree", "_range"]).withColumn("idx", F.col("_id") + F.col("_shift")).drop("_id", "_range", "_shift")


def reduce_trees(nodes: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> list[DataFrame]:
    """All rounds of nodes (tree, idx, size, digest), the given ones first; in the last, every tree has one node.

    A tree of a single node stays as it is and isn't in later rounds.
    """
    width = fanout**levels

    def run(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        tree, number, size = key
        block = block.sort_values("idx")
        top = collapse(block["digest"].tolist(), size, fanout, levels)[-1][0]
        return pd.DataFrame({"tree": [tree], "idx": [number], "size": [-(-size // width)], "digest": [top]})

    rounds = [nodes]
    while True:
        live = rounds[-1].filter("size > 1")
        if live.isEmpty():
            return rounds
        blocks = live.select("tree", F.floor(F.col("idx") / width).alias("block"), "size", "idx", "digest").groupBy("tree", "block", "size")
        rounds.append(common.materialise(blocks.applyInPandas(run, "tree string, idx long, size long, digest string"), "merkle-round"))


def roots(rounds: list[DataFrame]) -> DataFrame:
    """(tree, digest) of every tree's last node."""
    return functools.reduce(DataFrame.unionByName, [r.filter("size = 1").select("tree", "digest") for r in rounds])


def proofs(rounds: list[DataFrame], above: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """The first round's nodes with all their columns, their siblings as ``proof``, and what ``above`` has of their tree.

    A proof goes level by level, with what stands before and after the path, and ends with
    that of the tree.  ``above`` (tree, proof, and others) is joined to the trees' roots alone
    and handed down from there.
    """
    width = fanout**levels
    handed = [f for f in above.schema if f.name not in ("tree", "proof")]
    kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))

    def run(block: pa.Table, parent: pa.Table) -> pa.Table:
        block, top = block.sort_by("idx").drop_columns("block"), parent.to_pylist()[0]
        rows = collapse(block["digest"].to_pylist(), block["size"][0].as_py(), fanout, levels)
        out = []
        for k in range(len(block)):
            steps = []
            for level in rows[:-1]:
                low = k // fanout * fanout
                steps.append({"before": "".join(level[low:k]), "after": "".join(level[k + 1 : low + fanout])})
                k //= fanout
            out.append(steps + top["proof"])
        block = block.append_column("proof", pa.array(out, kind))
        for f in handed:
            block = block.append_column(f.name, pa.repeat(parent[f.name][0], len(block)))
        return block

    known = None  # proofs of the nodes of the round above
    for depth in range(len(rounds) - 1, -1, -1):
        found = rounds[depth].filter("size = 1").join(above, "tree")
        if known is not None:
            blocks = rounds[depth].filter("size > 1").withColumn("block", F.floor(F.col("idx") / width))
            parents = known.select("tree", F.col("idx").alias("block"), "proof", *[f.name for f in handed])
            schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*rounds[depth].schema, above.schema["proof"], *handed])
            found = found.unionByName(blocks.groupBy("tree", "block").cogroup(parents.groupBy("tree", "block")).applyInArrow(run, schema))
        known = common.materialise(found, "merkle-proofs") if depth else found
    return known


def manifest(leaves: DataFrame, order: list[str], fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """Add ``subroot``, ``root`` and ``proof`` to leaves (tree, digest, the columns of ``order`` and others).

    A tree for each value of ``tree``, its leaves in ``order`` (nulls first, then by
    digest, so repeated rows have neighbouring places); the trees' roots, ordered by
    ``tree``, are the leaves of one more tree.  A lone leaf is its tree's root.  An empty
    table gives no rows.
    """
    below = reduce_trees(common.materialise(numbered(leaves, [*order, "digest"]), "merkle-leaves"), fanout, levels)
    tops = common.materialise(roots(below), "merkle-subroots")
    names = numbered(tops.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), ["name"])
    upper = reduce_trees(common.materialise(names, "merkle-trees"), fanout, levels)
    whole = roots(upper).select("tree", F.lit([]).cast(PROOF).alias("proof"), F.col("digest").alias("root"))
    above = proofs(upper, whole, fanout, levels).select(F.col("name").alias("tree"), "proof", F.col("digest").alias("subroot"), "root")
    return proofs(below, common.materialise(above, "merkle-above"), fanout, levels).drop("size", "idx")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(proof, leaf, lambda node, step: digest(step["before"], node, step["after"]))


def siblings(proof: Column) -> Column:
    """Digest of all siblings of a proof, from the leaf up and from left to right."""
    return digest(F.array_join(F.transform(proof, lambda step: F.concat(step["before"], step["after"])), ""))


LOW = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def document_leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, tree, digest, changed): a leaf for each row, and the leaf that it would have if its text were tampered with.

    Where 5 divides the CRC of the id, the tampered text has its A-Z in lower case;
    rows without an id aren't tampered with.  Null and empty texts have different
    leaves.  Columns other than those of documents aren't read, whatever their names.
    """
    fixed = [field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")]
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    leaf = digest(*fixed, field(F.col("text")))
    changed = F.when(hit, digest(*fixed, field(F.translate("text", *LOW))))
    tree = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))  # null comes before all others
    return docs.select("doc_id", tree.alias("tree"), leaf.alias("digest"), changed.alias("changed"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, roots and proofs of all documents, and whether each still leads to the root after tampering."""
    common.ship(spark)
    leaves = common.materialise(document_leaves(common.table(spark, sf_dir, "documents")), "merkle-documents")
    rows = manifest(leaves, ["doc_id"])
    rows = rows.withColumn("folded_root", folded(F.coalesce("changed", "digest"), F.col("proof")))
    return rows.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root", siblings(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )
