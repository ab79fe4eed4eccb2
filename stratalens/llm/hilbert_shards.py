"""Hilbert-curve sharding: rows close in several metadata dimensions share a file.

Each row's metadata is quantised to a small grid, cells are visited in the
order of a Hilbert curve, and the curve is cut into runs of equal row counts.
A reader that knows each file's range in every dimension skips the files that
a filter cannot touch.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BITS = 5
SHARDS = 24


def with_hilbert(df: DataFrame, coords: list[Column], bits: int) -> DataFrame:
    """Add ``hilbert``: position on the Hilbert curve of a grid point (Skilling's transpose form).

    ``coords`` are integers below ``2**bits``; the index is a long below
    ``2**(bits*len(coords))``.  The steps are columns of their own, so that
    Catalyst evaluates each once.
    """
    n = len(coords)
    steps = [(1 << b, i) for b in range(bits - 1, 0, -1) for i in range(n)]

    def undo(x: Column, s: Column) -> Column:
        low = s["q"] - 1
        first, mine = F.get(x, F.lit(0)), F.get(x, s["i"])
        hit = mine.bitwiseAND(s["q"]) != 0
        swap = first.bitwiseXOR(mine).bitwiseAND(low)
        head = F.when(hit, first.bitwiseXOR(low)).otherwise(first.bitwiseXOR(swap))
        return F.transform(x, lambda v, j: F.when(j == 0, head).when((j == s["i"]) & ~hit, v.bitwiseXOR(swap)).otherwise(v))

    start = F.array(*[c.cast("int") for c in coords])
    if steps:
        start = F.aggregate(F.array(*[F.struct(F.lit(q).alias("q"), F.lit(i).alias("i")) for q, i in steps]), start, undo)
    df = df.withColumn("_h", start)
    # Gray code: a running xor, then the last axis folds back into all of them
    axes = [F.get("_h", F.lit(i)) for i in range(n)]
    gray = [axes[0]]
    for axis in axes[1:]:
        gray.append(gray[-1].bitwiseXOR(axis))
    df = df.withColumn("_h", F.array(*gray))
    last, fold = F.get("_h", F.lit(n - 1)), F.lit(0)
    for b in range(1, bits):
        fold = fold.bitwiseXOR(F.when(last.bitwiseAND(F.lit(1 << b)) != 0, F.lit((1 << b) - 1)).otherwise(0))
    df = df.withColumn("_f", fold)
    df = df.withColumn("_h", F.transform("_h", lambda v: v.bitwiseXOR(F.col("_f"))))
    index = F.lit(0).cast("long")
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            index = index * 2 + F.shiftright(F.get("_h", F.lit(i)), b).bitwiseAND(F.lit(1))
    return df.withColumn("hilbert", index.cast("long")).drop("_h", "_f")


def grid(source: Column, lang: Column, length: Column) -> list[Column]:
    """The default dimensions: origin and language by hash class, length by half powers of two; nulls count as empty or 0."""
    side = 1 << BITS
    return [
        F.pmod(F.xxhash64(F.coalesce(source, F.lit(""))), F.lit(side)).cast("int"),
        F.pmod(F.xxhash64(F.coalesce(lang, F.lit(""))), F.lit(side)).cast("int"),
        F.least(F.lit(side - 1), F.floor(1.5 * F.log2(F.coalesce(length, F.lit(0)) + 1))).cast("int"),
    ]


def hilbert_shards(df: DataFrame, coords: list[Column], order: list[str], n_shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """Add ``hilbert``, ``shard`` (0 to n_shards-1) and ``slot`` (gapless from 0) to every row.

    Row counts of shards differ by one at most, whatever the skew: a cell that
    holds a third of all rows is split by a hash of ``order`` into buckets of
    bounded size.  The only broadcast is the table of grid cells, of at most
    ``2**(bits*len(coords))`` rows (16 bits or fewer are accepted).  An empty
    input gives an empty result; nulls in ``coords`` must be replaced by the caller.
    """
    if bits * len(coords) > 16:
        raise ValueError("at most 16 bits of grid: the cell table is broadcast")
    names = [f"_x{i}" for i in range(len(coords))]
    rows = df.withColumns(dict(zip(names, coords, strict=True)))
    cells = rows.groupBy(*names).agg(F.count("*").alias("_n"))
    cells = common.materialise(with_hilbert(cells, [F.col(c) for c in names], bits), "shard-cells")
    rows = rows.join(F.broadcast(cells.drop("_n")), names).drop(*names)
    # cells in curve order, and how many rows come before each
    lane = common.Window.partitionBy(F.lit(0))
    cells = cells.select(
        "hilbert",
        F.coalesce(F.sum("_n").over(lane.orderBy("hilbert").rowsBetween(common.Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"),
        F.sum("_n").over(lane).alias("_all"),
    )
    out = common.ranked(rows, "hilbert", order).join(F.broadcast(cells), "hilbert")
    place = F.col("_start") + F.col("rank")
    out = out.withColumn("shard", F.floor(place * n_shards / F.col("_all")).cast("int"))
    first = F.ceil(F.col("shard") * F.col("_all") / n_shards).cast("long")
    return out.withColumn("slot", (place - first).cast("long")).drop("rank", "_start", "_all")


def write_shards(df: DataFrame, path: str) -> None:
    """One folder per shard, rows in slot order."""
    df.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def manifest(sharded: DataFrame, dims: list[str]) -> DataFrame:
    """Rows and the range of each dimension per shard: what a reader prunes by."""
    ranges = [f(c).alias(f"{n}_{c}") for c in dims for n, f in (("min", F.min), ("max", F.max))]
    return sharded.groupBy("shard").agg(F.count("*").alias("rows"), *ranges)


def prune(shards: DataFrame, bounds: dict[str, tuple]) -> DataFrame:
    """Shards of a manifest that can hold rows within all ``bounds`` (low, high, both included)."""
    for c, (low, high) in bounds.items():
        shards = shards.filter((F.col(f"max_{c}") >= low) & (F.col(f"min_{c}") <= high))
    return shards.select("shard")


def cells_of(spark: SparkSession, source: str | None = None, lang: str | None = None, chars: tuple[int, int] | None = None) -> dict[str, tuple[int, int]]:
    """A filter on real columns as bounds for ``prune``: the grid's classes of a source, a language and a range of text lengths."""
    low, high = chars or (0, 0)
    made = [grid(F.lit(source or ""), F.lit(lang or ""), F.lit(n)) for n in (low, high)]
    row = spark.range(1).select(made[0][0].alias("s"), made[0][1].alias("g"), made[0][2].alias("a"), made[1][2].alias("b")).first()
    asked = {"dim0": (source, (row["s"], row["s"])), "dim1": (lang, (row["g"], row["g"])), "dim2": (chars, (row["a"], row["b"]))}
    return {c: bounds for c, (value, bounds) in asked.items() if value is not None}


def shard_documents(docs: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    """Documents' keys, sizes and metadata with ``hilbert``, ``shard`` and ``slot``, without their texts.

    Null texts count as empty, null metadata as a class of their own, equal rows get
    distinct slots; an empty table gives an empty result; columns of other names than
    doc_id, text, source and lang aren't read.
    """
    text = common.text_bytes(F.col("text"))
    small = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("bytes"),
        F.crc32(text).cast("long").alias("text_crc32"),
        "source",
        "lang",
        F.length("text").alias("chars"),
        *[c.alias(f"dim{i}") for i, c in enumerate(grid(F.col("source"), F.col("lang"), F.length("text")))],
    )
    small = common.materialise(small, "shard-keys")  # texts are read once
    out = hilbert_shards(small, [F.col(f"dim{i}") for i in range(3)], ["doc_id", "text_crc32", "bytes"], n_shards)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of equal row counts, cut from a Hilbert curve over source, language and length.

    Null texts count as empty; a null doc_id sorts first; equal rows get distinct slots.
    """
    out = shard_documents(common.table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        F.col("bytes").alias("size"),
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "hilbert",
        "source",
        "lang",
        "chars",
        *[f"dim{i}" for i in range(3)],
    )
