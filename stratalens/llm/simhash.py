"""SimHash fingerprints, and all pairs of them within a Hamming radius.

A text's terms are its pairs of neighbouring words; each votes on 128 signed
bits with its length as weight, so long (rare) words count for more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common, textnum

BITS = 128
MAX_WEIGHT = 24
#: Documents in one run of the ordered corpus, about.
RUN_ROWS = 400
#: Fingerprints that share a block and are compared pair by pair, at most.
HOT_BLOCK = 200

_SIGNS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64) * 2 - 1


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, 16) bytes.  A text without words has all bits clear; a tied vote gives 0."""
    n = len(offsets) - 1
    start, end, row = textnum.words(data, offsets, textnum.SPACE)
    hashes = textnum.word_hashes(data, start, end)
    terms, owner = textnum.shingle_hashes(hashes, row, 2, n)
    size = np.minimum(end - start, MAX_WEIGHT // 2)
    pair = size[:-1] + size[1:] if len(size) else size
    same = row[:-1] == row[1:]
    weight = np.concatenate([pair[same], np.full(len(terms) - int(same.sum()), MAX_WEIGHT)]) if len(size) else np.zeros(0)
    both = np.stack([terms, textnum.mix(terms ^ np.uint64(0x5851F42D4C957F2D))], axis=1).astype("<u8").view(np.uint8).reshape(-1, BITS // 8)
    votes = np.empty((n, BITS))
    place = owner * 256
    for j in range(BITS // 8):
        tally = np.bincount(place + both[:, j], weights=weight, minlength=n * 256).reshape(n, 256)
        votes[:, 8 * j : 8 * j + 8] = tally @ _SIGNS
    return np.packbits(votes > 0, axis=1)


def _fingerprint_column(text: pa.Array) -> pa.Array:
    batch = pa.RecordBatch.from_arrays([text], ["text"])
    rows = [fp for _, data, offsets in textnum.blocks(iter([batch])) for fp in fingerprints(data, offsets)]
    return pa.array([fp.tobytes() for fp in rows], pa.binary())


def simhash(text: Column) -> Column:
    """16 bytes of SimHash for a text column; null counts as empty."""
    from pyspark.sql.pandas.functions import arrow_udf

    return arrow_udf(_fingerprint_column, "binary")(text)


def half(fp: Column, i: int) -> Column:
    """One 64-bit half of a fingerprint as a long."""
    hexed = F.substring(F.hex(fp), 1 + 16 * i, 16)
    high, low = (F.conv(F.substring(hexed, 1 + 8 * k, 8), 16, 10).cast("long") for k in (0, 1))
    return F.shiftleft(high, 32).bitwiseOR(low)


def distance(a: Column, b: Column) -> Column:
    """Differing bits of two fingerprints."""
    return F.bit_count(half(a, 0).bitwiseXOR(half(b, 0))) + F.bit_count(half(a, 1).bitwiseXOR(half(b, 1)))


def likeness(a: Column, b: Column) -> Column:
    return 1 - distance(a, b) / F.lit(float(BITS))


def near_pairs(fps: DataFrame, radius: int = 3, hot: int = HOT_BLOCK) -> DataFrame:
    """All pairs of distinct fingerprints at most ``radius`` bits apart: (a, b, bits), a < b.

    ``fps`` has a binary column ``fingerprint``; equal ones are one class and nulls
    are left out, so members are found by joining back on the fingerprint.  Bits are
    dealt into ``radius + 1`` blocks; two fingerprints within the radius agree on one
    of them, so one table for each block, keyed by it, finds every pair.  Fingerprints
    of a block value that more than ``hot`` share are dealt again by the blocks of
    their other bits, until no key is hot.  An empty table gives no pairs.
    """
    base = fps.select("fingerprint").filter(F.col("fingerprint").isNotNull()).distinct().withColumn("id", F.monotonically_increasing_id())
    bits = F.concat(*[F.lpad(F.conv(F.substring(F.hex("fingerprint"), 1 + 8 * i, 8), 16, 2), 32, "0") for i in range(BITS // 32)])
    base = common.materialise(base.select("id", "fingerprint", half(F.col("fingerprint"), 0).alias("h0"), half(F.col("fingerprint"), 1).alias("h1"), bits.alias("rest")), "fingerprints")
    rows, pairs, width = base.select("id", "h0", "h1", "rest", F.lit("").alias("key")), None, BITS
    while True:
        last = width <= 2 * (radius + 1)  # of so few bits there are few different values
        edges = [width * i // (radius + 1) for i in range(radius + 2)]
        parts = []
        for t, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            own = F.substring("rest", a + 1, b - a)
            others = F.concat(F.substring("rest", 1, a), F.substring("rest", b + 1, width - b))
            parts.append(F.struct(F.concat("key", F.lit(f"{t}:"), own, F.lit(" ")).alias("key"), others.alias("rest")))
        made = rows.select("id", "h0", "h1", F.explode(F.array(*parts)).alias("p")).select("id", "h0", "h1", "p.*")
        made = common.materialise(made, "fingerprint-blocks")
        sizes = common.materialise(made.groupBy("key").count().filter("count > 1"), "block-sizes")
        made = made.join(sizes, "key")
        few = made.filter((F.col("count") <= hot) | F.lit(last)).select("key", "id", "h0", "h1")
        x, y = few.toDF("key", "a", "a0", "a1"), few.toDF("key", "b", "b0", "b1")
        apart = F.bit_count(F.col("a0").bitwiseXOR(F.col("b0"))) + F.bit_count(F.col("a1").bitwiseXOR(F.col("b1")))
        found = x.join(y, "key").filter((F.col("a") < F.col("b")) & (apart <= radius)).select("a", "b", apart.alias("bits"))
        pairs = found if pairs is None else pairs.unionByName(found)
        # blocks differ in size by a bit at most: what is left is cut to the shortest rest
        width -= max(b - a for a, b in zip(edges[:-1], edges[1:], strict=True))
        rows = made.filter(F.col("count") > hot).select("id", "h0", "h1", "rest", "key")
        if last or rows.isEmpty():
            break
    named = base.select("id", "fingerprint")
    pairs = pairs.distinct().join(named.toDF("a", "fa"), "a").join(named.toDF("b", "fb"), "b")
    return pairs.select(F.least("fa", "fb").alias("a"), F.greatest("fa", "fb").alias("b"), "bits")


def run_bounds(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys (id, text hash) at which the corpus, in their order, is cut into runs: each the largest of its run.

    Only keys are sorted; every so many of a sorted range, one comes to the driver: at
    most about a million of them, 16 bytes each.
    """
    n = docs.count()
    step = max(RUN_ROWS, n >> 20)
    ranges = docs.select("_k", "_h").repartitionByRange("_k", "_h").sortWithinPartitions("_k", "_h").withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    got = ranges.filter(F.col("_i") % step == step - 1).select("_k", "_h").unionByName(docs.agg(F.max(F.struct("_k", "_h")).alias("m")).select("m.*").filter("_k is not null"))
    got = got.distinct().toArrow().sort_by([("_k", "ascending"), ("_h", "ascending")])
    return got.column("_k").to_numpy(), got.column("_h").to_numpy()


def places_of(keys: np.ndarray, hashes: np.ndarray, bounds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The run of each key: that of the first bound not below it."""
    low, high = np.searchsorted(bounds[0], keys), np.searchsorted(bounds[0], keys, side="right")
    for i in np.flatnonzero(low < high):  # keys that bounds have too, mostly one each
        low[i] += np.searchsorted(bounds[1][low[i] : high[i]], hashes[i])
    return low


def with_next(docs: DataFrame) -> DataFrame:
    """Add ``fingerprint`` and the following document's ``next_text`` and ``next_fingerprint``.

    Documents follow one another by descending doc_id, the first after the last;
    rows of one id are ordered by a hash of their text, ids that are null come last.
    The corpus is cut into runs of keys, so that repeated or missing ids are spread
    too; the head of each run also travels to the run before it, so no window is
    larger than a run.  A single document follows itself.  An empty table gives no rows;
    a very long text is a block of its own; other columns aren't read.
    """
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.withColumns({"_k": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "_h": F.xxhash64("text")})
    bounds = run_bounds(common.materialise(keyed.select("_k", "_h"), "document-keys"))  # texts are read once for their keys, and once more below

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in textnum.blocks(batches):
            fp = pa.array([x.tobytes() for x in fingerprints(data, offsets)], pa.binary())
            keys, hashes = np.array(rows.column("_k")), np.array(rows.column("_h"))
            place = places_of(keys, hashes, bounds)
            names = ["doc_id", "text", "_k", "_h", "fingerprint", "run", "ghost"]
            kept = [rows.column(c) for c in names[:4]]
            out = pa.RecordBatch.from_arrays([*kept, fp, pa.array(place, pa.int32()), pa.array(np.zeros(len(place), np.int32))], names)
            yield out
            heads = np.flatnonzero((bounds[0][place] == keys) & (bounds[1][place] == hashes))
            if len(heads):
                ghosts = out.take(pa.array(heads))
                moved = pa.array((place[heads] + 1) % len(bounds[0]), pa.int32())
                yield pa.RecordBatch.from_arrays([*ghosts.columns[:5], moved, pa.array(np.ones(len(heads), np.int32))], names)

    placed = keyed.mapInArrow(run, "doc_id long, text string, _k long, _h long, fingerprint binary, run int, ghost int")
    order = Window.partitionBy("run").orderBy("ghost", F.desc("_k"), F.desc("_h"), "text")
    out = placed.withColumns({"next_text": F.lead("text").over(order), "next_fingerprint": F.lead("fingerprint").over(order)})
    return out.filter("ghost = 0").select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they and the next document's are."""
    rows = with_next(common.table(spark, sf_dir, "documents"))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (n - third).cast("int")), F.substring(F.col("next_text"), F.lit(1), third))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", "next_fingerprint")
    rows = rows.withColumn("edited_fingerprint", simhash(F.col("edited")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.lower(F.hex("fingerprint")).alias("fingerprint"),
        F.lower(F.hex("edited_fingerprint")).alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def neighbours(docs: DataFrame, radius: int = 3) -> DataFrame:
    """(doc_id, class_id, near): each document's class of equal fingerprints and the classes within ``radius`` bits of it.

    A radius of 3 is for texts that differ in form or in a word or so: texts whose
    five-word shingles have a likeness of 0.75 are mostly 8 to 18 bits apart, and
    finding those is the work of the n-gram join.  Null and empty texts share a class, an
    empty table gives no rows, a very long text has one fingerprint like any other, and columns
    other than doc_id and text aren't read.
    ``class_id`` is the smallest doc_id with that fingerprint; ``near`` lists class ids,
    ascending.  Rows without a doc_id belong to a class but don't name one.
    """
    fps = common.materialise(docs.select("doc_id", simhash(F.col("text")).alias("fingerprint")), "fingerprints")
    classes = common.materialise(fps.groupBy("fingerprint").agg(F.min("doc_id").alias("class_id")), "fingerprint-classes")
    pairs = near_pairs(classes, radius)
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    names = classes.select(F.col("fingerprint").alias("b"), F.col("class_id").alias("n"))
    lists = both.join(names, "b").groupBy(F.col("a").alias("fingerprint")).agg(F.array_sort(F.collect_list("n")).alias("near"))
    named = classes.join(lists, "fingerprint", "left").withColumn("near", F.coalesce("near", F.array().cast("array<long>")))
    return fps.join(named, "fingerprint").select("doc_id", "class_id", "near")


def neighbours_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint classes of all documents and their neighbours within 3 bits."""
    return neighbours(common.table(spark, sf_dir, "documents"))
