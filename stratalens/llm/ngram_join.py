"""Jaccard self-join of documents on word n-grams, by rare-first prefix filtering.

Every document is the set of its five-word shingles.  Shingles are ordered by
document frequency, so a document's prefix holds its rarest; two documents of
Jaccard similarity 0.75 or more share a prefix shingle.  A prefix made of
shingles that occur nowhere else rules a document out at once.  The rest are
paired under length, positional and suffix filters and verified once per pair.
Pairs meet by shingle and length band; the smaller set comes to each band with
the shorter prefix that sets of that length ask of it.
Links are found first from each document to a central neighbour; pairs already
connected need no further look, so a group of n copies costs about n pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, components, textnum

WIDTH = 5
#: Similarity times 100.
PERCENT = 75
#: Text in a chunk, and shingles in a counting bucket: what one task holds.
CHUNK_BYTES = 8_000_000
BUCKET_SHINGLES = 2_000_000
#: Classes of shingle hashes in a suffix filter.
CLASSES = 64
#: Length bands to a doubling of the size.
BANDS = 8

FRAGMENT = "bucket long, chunk long, hashes binary, counts binary"
KNOWN = "chunk long, bucket long, hashes binary, rank binary"
SETS = "doc_id long, n long, sig binary, shingles binary, tokens array<long>, places array<int>, classes binary"


def least_common(a: Column, b: Column) -> Column:
    """The smallest intersection that links sets of these sizes: 100 i >= 75 (a + b - i)."""
    return F.ceil((a + b) * PERCENT / (100 + PERCENT))


def prefix_length(n: np.ndarray) -> np.ndarray:
    return n - (n * PERCENT + 99) // 100 + 1


def sets_of(texts: pa.ChunkedArray | pa.Array, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first row, shingles, row within block, rows) of blocks of texts; distinct and ascending within each row."""
    done = 0
    batch = pa.Table.from_arrays([texts], ["text"]).to_batches()
    for rows, data, offsets in textnum.blocks(iter(batch)):
        start, end, row = textnum.words(data, offsets, textnum.SPACE)
        hashes = textnum.word_hashes(data, start, end)
        values, owner = textnum.distinct_per_row(*textnum.shingle_hashes(hashes, row, width, rows.num_rows))
        yield done, values, owner, rows.num_rows
        done += rows.num_rows


def split(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where a shingle is counted: bucket number and 32 bits, as one number."""
    return ((hashes >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | (hashes & np.uint64(0xFFFFFFFF))


def count_fragments(docs: DataFrame, buckets: int, width: int) -> DataFrame:
    """Each chunk's shingles with the number of its documents that have them, by counting bucket."""

    def run(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py()
        parts = [split(values, buckets) for _, values, _, _ in sets_of(table.column("text"), width)]
        keys, counts = np.unique(np.concatenate(parts), return_counts=True)
        bucket = keys >> np.uint64(32)
        heads = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(keys) else np.zeros(0, int)
        ends = np.append(heads[1:], len(keys))
        low, n = keys.astype("<u4"), np.minimum(counts, 65_535).astype("<u2")
        return pa.Table.from_arrays(
            [
                pa.array(bucket[heads].astype(np.int64)),
                pa.array(np.full(len(heads), chunk), pa.int64()),
                pa.array([low[a:b].tobytes() for a, b in zip(heads, ends, strict=True)], pa.binary()),
                pa.array([n[a:b].tobytes() for a, b in zip(heads, ends, strict=True)], pa.binary()),
            ],
            ["bucket", "chunk", "hashes", "counts"],
        )

    return docs.groupBy("chunk").applyInArrow(run, FRAGMENT)


def frequent(fragments: DataFrame) -> DataFrame:
    """For each chunk, its shingles that two documents or more have, with a rank that grows with their number."""

    def run(table: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(x, "<u4") for x in table.column("hashes").to_pylist()]
        sizes = np.array([len(x) for x in hashes])
        values = np.concatenate(hashes)
        counts = np.concatenate([np.frombuffer(x, "<u2") for x in table.column("counts").to_pylist()]).astype(np.int64)
        order = np.argsort(values, kind="stable")
        heads = np.flatnonzero(np.append(True, values[order][1:] != values[order][:-1]))
        total = np.empty(len(values), np.int64)
        total[order] = np.repeat(np.add.reduceat(counts[order], heads), np.diff(np.append(heads, len(values))))
        rank = np.clip(np.rint(8 * np.log2(total)), 0, 255).astype(np.uint8)
        edges = np.append(0, np.cumsum(sizes))
        chunks, lists, ranks = [], [], []
        for chunk, a, b in zip(table.column("chunk").to_pylist(), edges[:-1], edges[1:], strict=True):
            keep = rank[a:b] > 0
            if keep.any():
                chunks.append(chunk)
                lists.append(values[a:b][keep].tobytes())
                ranks.append(rank[a:b][keep].tobytes())
        del hashes, values, counts, order, total
        textnum.tidy()
        bucket = pa.array(np.full(len(chunks), table.column("bucket")[0].as_py()), pa.int64())
        return pa.Table.from_arrays([pa.array(chunks, pa.int64()), bucket, pa.array(lists, pa.binary()), pa.array(ranks, pa.binary())], ["chunk", "bucket", "hashes", "rank"])

    return fragments.groupBy("bucket").applyInArrow(run, KNOWN)


def signature(values: np.ndarray, owner: np.ndarray, n_rows: int) -> list[bytes]:
    """128 bits of each row's set."""
    out = np.zeros((n_rows, 2), np.uint64)
    if len(values):
        heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        for k, salt in enumerate((0x243F6A8885A308D3, 0x13198A2E03707344)):
            out[owner[heads], k] = np.add.reduceat(textnum.mix(values ^ np.uint64(salt)), heads)
    return [x.tobytes() for x in out]


def prefixed_sets(docs: DataFrame, known: DataFrame, buckets: int, width: int) -> DataFrame:
    """Sizes and signatures of all documents; for those that may have a partner, the set and its shared prefix shingles.

    Of a chunk's equal sets, only the first carries its shingles.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        where = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(h, "<u4").astype(np.uint64) | np.uint64(b << 32) for b, h in zip(right.column("bucket").to_pylist(), right.column("hashes").to_pylist(), strict=True))])
        ranks = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(x, np.uint8) for x in right.column("rank").to_pylist())])
        order = np.argsort(where, kind="stable")
        where, ranks = where[order], ranks[order]
        sizes, sigs, held = [], [], {}
        columns: dict[str, list] = {"shingles": [], "tokens": [], "places": [], "classes": []}
        for _, values, owner, rows in sets_of(left.column("text"), width):
            n = np.bincount(owner, minlength=rows)
            rank = np.zeros(len(values), np.uint8)
            if len(where) and len(values):
                keys = split(values, buckets)
                at = np.minimum(np.searchsorted(where, keys), len(where) - 1)
                rank = np.where(where[at] == keys, ranks[at], 0)
            shared = np.bincount(owner, weights=rank > 0, minlength=rows).astype(int)
            prefix = prefix_length(n)
            able = (n > 0) & (n - shared < prefix)
            heads = np.append(0, np.cumsum(n))
            block_sigs = signature(values, owner, rows)
            for i in range(rows):
                new = able[i] and block_sigs[i] not in held
                if new:
                    held[block_sigs[i]] = True
                    v, r = values[heads[i] : heads[i + 1]], rank[heads[i] : heads[i + 1]]
                    first = np.lexsort((v, r))[: prefix[i]]
                    place = np.flatnonzero(r[first] > 0)
                    columns["shingles"].append(v.astype("<u8").tobytes())
                    columns["tokens"].append(v[first[place]].view(np.int64))
                    columns["places"].append(place.astype(np.int32))
                    columns["classes"].append(np.minimum(np.bincount((v >> np.uint64(58)).astype(int), minlength=CLASSES), 255).astype(np.uint8).tobytes())
                else:
                    for c in columns.values():
                        c.append(None)
            sizes.append(n)
            sigs += block_sigs
        kinds = {"shingles": pa.binary(), "tokens": pa.list_(pa.int64()), "places": pa.list_(pa.int32()), "classes": pa.binary()}
        return pa.Table.from_arrays(
            [left.column("doc_id"), pa.array(np.concatenate([np.zeros(0, int), *sizes]), pa.int64()), pa.array(sigs, pa.binary()), *(pa.array(columns[c], k) for c, k in kinds.items())],
            [x.split()[0] for x in SETS.split(", ")],
        )

    return docs.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(run, SETS)


def verify(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sets are similar enough: a suffix filter on shingle classes, then the exact intersection."""
    light = classes.select("id", "n", "classes")
    pairs = pairs.join(light.toDF("a", "n_a", "c_a"), "a").join(light.toDF("b", "n_b", "c_b"), "b")

    def suffix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, CLASSES) for c in ("c_a", "c_b"))
            total = np.array(batch.column("n_a")) + np.array(batch.column("n_b"))
            least = np.where((a == 255) | (b == 255), 1 << 30, np.minimum(a, b)).sum(axis=1)  # a full class bounds nothing
            keep = pa.array(least >= -(-total * PERCENT // (100 + PERCENT)))
            yield batch.select(["a", "b"]).filter(keep)

    pairs = pairs.mapInArrow(suffix, "a long, b long")
    sets = classes.select("id", "shingles")
    pairs = pairs.join(sets.toDF("a", "s_a"), "a").join(sets.toDF("b", "s_b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("s_a"), batch.column("s_b"), strict=True):
                p, q = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                both = int((q[at] == p).sum())
                keep.append(100 * both >= PERCENT * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(run, "a long, b long")


def to_centres(postings: DataFrame) -> DataFrame:
    """One candidate pair for each set: with the central set it shares most prefix shingles with.

    A set is central if its prefix shingles are widely shared; each shingle names
    the most central of its sets.
    """
    sizes = postings.groupBy("token").count().withColumnRenamed("count", "size")
    weight = postings.join(sizes, "token").groupBy("id").agg(F.sum("size").alias("weight"))
    weighed = postings.join(weight, "id")
    centre = weighed.groupBy("token").agg(F.max(F.struct("weight", -F.col("id"))).alias("c"))
    centre = centre.select("token", (-F.col("c.col2")).alias("b"), F.col("c.weight").alias("w"))
    near = postings.select("token", F.col("id").alias("a")).join(centre, "token").filter("a <> b")
    best = near.groupBy("a", "b", "w").count().groupBy("a").agg(F.max(F.struct("count", "w", "b")).alias("m"))
    return best.select("a", F.col("m.b").alias("b"))


def band(n: Column) -> Column:
    return F.floor(F.log2(n) * BANDS)


def index_postings(postings: DataFrame) -> DataFrame:
    """Each set's postings for the bands of sets as large as it or larger, where they may be a pair's first shared shingle.

    With a larger set of at least ``low`` shingles, that has the least intersection of
    the two sizes before the end of the smaller one.  Sets of one template and a fifth
    of their own shingles have only their own in such a prefix, so they meet nowhere.
    """
    n = F.col("n")
    bands = F.explode(F.sequence(band(n), band(F.floor(n * 100 / PERCENT))))
    low = F.floor(F.pow(F.lit(2.0), F.col("band") / BANDS))
    return postings.withColumn("band", bands).filter(n - F.col("place") >= least_common(n, F.greatest(n, low)))


def candidates(postings: DataFrame) -> DataFrame:
    """Every pair of sets that may be similar, the smaller first; with a ``root`` column, only those of different roots.

    Matches pass the length filter and a positional one: from a pair's first
    shared shingle on, either set must have room for the whole intersection.  Then,
    over all such matches of a pair, those so far and what can follow the last.
    """
    x, y = index_postings(postings).alias("x"), postings.withColumn("band", band(F.col("n"))).alias("y")
    n_x, n_y = F.col("x.n"), F.col("y.n")
    room = F.least(n_x - F.col("x.place"), n_y - F.col("y.place"))
    same = (F.col("x.token") == F.col("y.token")) & (F.col("x.band") == F.col("y.band"))
    first = (n_x < n_y) | ((n_x == n_y) & (F.col("x.id") < F.col("y.id")))
    meet = same & first & (n_x * 100 >= n_y * PERCENT) & (room >= least_common(n_x, n_y))
    if "root" in postings.columns:
        meet &= F.col("x.root") != F.col("y.root")
    pairs = x.join(y, meet).groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b"), n_x.alias("n_x"), n_y.alias("n_y")).agg(
        F.count("*").alias("c"), F.max("x.place").alias("p"), F.max("y.place").alias("q")
    )
    bound = F.col("c") + F.least(F.col("n_x") - F.col("p"), F.col("n_y") - F.col("q")) - 1
    return pairs.filter(bound >= least_common(F.col("n_x"), F.col("n_y"))).select("a", "b")


def across(postings: DataFrame, roots: DataFrame) -> DataFrame:
    """Every pair that may be similar and isn't connected yet."""
    at = postings.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    mixed = at.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("token")
    return candidates(common.materialise(at.join(mixed, "token"), "open-postings"))


def sets_and_postings(docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All documents with their sets' signatures, the different sets that may have a partner, and their prefix postings."""
    size = int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    chunks = max(12, size // CHUNK_BYTES)
    buckets = max(12, size // 6 // BUCKET_SHINGLES)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)))
    known = frequent(count_fragments(rows, buckets, width))
    found = common.materialise(prefixed_sets(rows, known, buckets, width), "ngram-sets")

    classes = found.filter("shingles is not null").dropDuplicates(["sig"]).withColumn("id", F.monotonically_increasing_id())
    classes = common.materialise(classes.drop("doc_id"), "ngram-classes")
    zipped = F.explode(F.arrays_zip("tokens", "places"))
    postings = classes.select("id", "n", zipped.alias("z")).select("id", "n", F.col("z.tokens").alias("token"), F.col("z.places").alias("place"))
    twice = postings.groupBy("token").count().filter("count > 1").select("token")
    return found, classes, common.materialise(postings.join(twice, "token"), "ngram-postings")


def similar_sets(docs: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, set) of every row, and (a, b) of all pairs of different sets of similarity 0.75 or more.

    ``set`` is the hex signature of a row's shingles, null for a text without words;
    equal sets have one signature, so copies aren't expanded.  Each pair comes once.
    Unlike ``near_duplicates``, this looks at connected sets too: the work grows with
    the links between different sets.  Null ids, null, empty and very long texts, empty
    tables and other columns are dealt with as there.
    """
    found, classes, postings = sets_and_postings(docs, width)
    pairs = verify(candidates(postings), classes)
    names = classes.select("id", F.lower(F.hex("sig")).alias("name"))
    pairs = pairs.join(names.toDF("a", "x"), "a").join(names.toDF("b", "y"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    name = F.when(F.col("n") > 0, F.lower(F.hex("sig")))
    return found.select("doc_id", F.col("n").alias("n_shingles"), name.alias("set")), pairs


def count_links(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, n_links) of every row: how many other rows it is linked with, copies included.

    Copies are counted by set, never paired.  Texts without words have no links;
    all else as in ``similar_sets``.
    """
    members, pairs = similar_sets(docs, width)
    members, pairs = common.materialise(members, "ngram-members"), common.materialise(pairs, "ngram-pairs")
    sizes = members.filter("set is not null").groupBy("set").agg(F.count("*").alias("rows"))
    both = pairs.union(pairs.select("b", "a"))
    beside = both.join(sizes.toDF("b", "rows"), "b").groupBy(F.col("a").alias("set")).agg(F.sum("rows").alias("beside"))
    links = sizes.join(beside, "set", "left").select("set", (F.col("rows") - 1 + F.coalesce("beside", F.lit(0))).alias("n_links"))
    linked = members.filter("set is not null").join(common.materialise(links, "ngram-counts"), "set").select("doc_id", "n_shingles", "n_links")
    return linked.unionByName(members.filter("set is null").select("doc_id", "n_shingles", F.lit(0).cast("long").alias("n_links")))


def near_duplicates(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``.

    Components are those of the graph that links documents of Jaccard similarity
    0.75 or more; ``component_id`` is the smallest doc_id in reach.  A text with
    fewer than ``width`` words is one shingle; null, empty or blank texts have none
    and are alone.  Equal sets are one node, so copies cost no pairs; null ids
    take part and get the component of the others.  An empty table gives an empty
    result; a very long text is a chunk of its own; other columns aren't read.
    """
    found, classes, postings = sets_and_postings(docs, width)
    links = common.materialise(verify(to_centres(postings), classes), "ngram-links")
    roots = components.connected(links).withColumnRenamed("node", "id")
    more = common.materialise(verify(across(postings, roots), classes), "ngram-links")
    roots = components.connected(links.unionByName(more)).withColumnRenamed("node", "id")

    # components are settled for each set; documents join that table once, on a key that adaptive execution can split
    sets = found.filter("n > 0").groupBy("sig").agg(F.min("doc_id").alias("least"))
    ids = classes.select("sig", "id").join(roots, "id", "left").select("sig", F.coalesce("root", "id").alias("root"))
    sets = common.materialise(sets.join(ids, "sig", "left"), "ngram-roots")
    least = sets.filter("root is not null").groupBy("root").agg(F.min("least").alias("component_id"))
    sets = sets.join(least, "root", "left").select("sig", F.coalesce("component_id", "least").alias("component_id"))
    linked = found.filter("n > 0").join(common.materialise(sets, "ngram-components"), "sig").select("doc_id", "n", "component_id")
    alone = found.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumnRenamed("n", "n_shingles")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(common.table(spark, sf_dir, "documents"))
