"""Packing token sequences by cutting-stock column generation.

Documents become ids; full sequences are cut off, and the rest of each document
is one item of 1 to 1023 ids.  A linear program over the histogram of item
lengths chooses patterns of lengths that fill a sequence; a knapsack dynamic
program prices new patterns.  Pattern counts are rounded down, what is left is
packed first-fit, and items, ranked within their length, take the slots.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, textnum, tokens

SEQUENCE = 1024
#: The linear program may stop this close to its bound.
GAP = 0.002
MAX_ROUNDS = 250
END_ID = np.array([0], "<u4").tobytes()

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces_of(docs: DataFrame, path: str, ranks_path: str, capacity: int = SEQUENCE) -> DataFrame:
    """Cut every document's ids, with the end id, into full sequences and a rest.

    A null or empty text is the end id alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(path, ranks_path).ids
        step = 4 * capacity
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = encode(text.as_py() or "") + END_ID
                view, n = memoryview(ids), len(ids) // 4
                rows += [(doc, k // 4, min(capacity, n - k // 4), zlib.crc32(view[k : k + step]), n) for k in range(0, len(ids), step)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], [x.split()[0] for x in PIECES.split(", ")])
        textnum.tidy()

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def price(lengths: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, dict[int, int]]:
    """The pattern of greatest value that fits: unbounded knapsack by dynamic programming."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(lengths)
    sizes, worth = lengths[order], values[order]
    for c in range(1, capacity + 1):
        k = np.searchsorted(sizes, c, side="right")
        best[c] = best[c - 1]
        if k:
            gain = best[c - sizes[:k]] + worth[:k]
            i = int(gain.argmax())
            if gain[i] > best[c] + 1e-12:
                best[c], pick[c] = gain[i], order[i]
    pattern: dict[int, int] = {}
    c = capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            pattern[int(pick[c])] = pattern.get(int(pick[c]), 0) + 1
            c -= int(lengths[pick[c]])
    return float(best[capacity]), pattern


def fill(sizes: np.ndarray, left: np.ndarray, capacity: int) -> Iterator[tuple[dict[int, int], int]]:
    """Longest first, each sequence topped up with the longest items that fit: (pattern, times) until ``left`` is used up."""
    i = len(sizes) - 1
    while i >= 0:
        if not left[i]:
            i -= 1
            continue
        room, pattern, k = capacity, {}, i
        while k >= 0 and room > 0:
            copies = min(int(left[k]), room // int(sizes[k]))
            if copies:
                pattern[k] = copies
                room -= copies * int(sizes[k])
            k = min(k - 1, int(np.searchsorted(sizes, room, side="right")) - 1)
        times = min(int(left[j]) // c for j, c in pattern.items())
        for j, c in pattern.items():
            left[j] -= c * times
        yield pattern, times


def cutting_stock(lengths: np.ndarray, counts: np.ndarray, capacity: int, gap: float = GAP, rounds: int = MAX_ROUNDS) -> tuple[list[dict[int, int]], np.ndarray]:
    """Patterns (item index -> copies) and how often to use each, as the linear program has it.

    Minimises the number of sequences that cover ``counts`` (ascending ``lengths``),
    by revised simplex with columns made on demand.  The first basis is the
    greedy filling in fractions: each of its patterns exhausts a length of its
    own, so the basis is triangular.  It stops within ``gap`` of the lower bound (the objective
    over the best price) or after ``rounds`` columns; either way the patterns
    cover the counts.
    """
    m = len(lengths)
    patterns: list[dict[int, int]] = [{i: 1} for i in range(m)]
    left, spent = counts.astype(float), []
    for i in range(m - 1, -1, -1):
        while left[i] > 0:
            room, pattern, k = capacity, {}, i
            while k >= 0:
                if left[k] > 0:
                    pattern[k] = room // int(lengths[k])
                    room -= pattern[k] * int(lengths[k])
                k = min(k - 1, int(np.searchsorted(lengths, room, side="right")) - 1)
            out = min(pattern, key=lambda j: left[j] / pattern[j])
            times = left[out] / pattern[out]
            for j, c in pattern.items():
                left[j] -= c * times
            left[out] = 0.0
            patterns[out] = pattern
            spent.append(out)
    # Element-wise algebra throughout: matrices are small, and a threaded BLAS can stall beside a JVM.
    inverse = np.eye(m)
    for i in spent:  # a pattern holds only lengths that run out with it or later
        inverse[i] /= patterns[i][i]
        for j, copies in patterns[i].items():
            if j != i:
                inverse[j] -= copies * inverse[i]
    x = np.maximum((inverse * counts).sum(axis=1), 0)
    for _ in range(rounds):
        duals = inverse.sum(axis=0)
        value, pattern = price(lengths, np.maximum(duals, 0), capacity)
        if value <= 1 + gap:
            break
        column = np.zeros(m)
        for i, copies in pattern.items():
            column[i] = copies
        d = (inverse * column).sum(axis=1)
        rise = d > 1e-9
        ratio = np.where(rise, x / np.where(rise, d, 1), np.inf)
        leave = int(ratio.argmin())
        theta = max(ratio[leave], 0.0)
        x -= theta * d
        x[leave] = theta
        row = inverse[leave] / d[leave]
        inverse -= np.outer(d, row)
        inverse[leave] = row
        patterns[leave] = pattern
    return patterns, np.maximum(x, 0)


@dataclass
class Plan:
    """Runs of slots: items ``first`` to ``first + items - 1`` of a length, ``copies`` to a sequence."""

    runs: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0


def plan(histogram: dict[int, int], capacity: int = SEQUENCE) -> Plan:
    """Turn a length histogram into runs (length, first, items, copies, sequence, offset)."""
    out, taken = Plan(), dict.fromkeys(histogram, 0)

    def use(pattern: dict[int, int], times: int) -> None:
        offset = 0
        for length in sorted(pattern, reverse=True):
            copies = pattern[length]
            out.runs.append((length, taken[length], copies * times, copies, out.sequences, offset))
            taken[length] += copies * times
            offset += copies * length
        out.sequences += times

    whole = histogram.get(capacity, 0)
    if whole:
        use({capacity: 1}, whole)
    sizes = np.array(sorted(k for k in histogram if k < capacity), int)
    if len(sizes):
        counts = np.array([histogram[int(k)] for k in sizes])
        left = counts.copy()
        patterns, x = cutting_stock(sizes, counts, capacity)
        for pattern, times in zip(patterns, np.floor(x + 1e-9).astype(int), strict=True):
            times = min([int(times), *(int(left[i]) // c for i, c in pattern.items())])
            if times > 0:
                use({int(sizes[i]): c for i, c in pattern.items()}, times)
                for i, c in pattern.items():
                    left[i] -= c * times
        # what rounding left
        for pattern, times in fill(sizes, left, capacity):
            use({int(sizes[i]): c for i, c in pattern.items()}, times)
    return out


RUNS = "length long, first long, items long, copies long, seq long, off long"


def pack(pieces: DataFrame, capacity: int = SEQUENCE) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces of 1 to ``capacity`` ids.

    ``pieces`` is read several times, so give a stored table.  Only its length
    histogram, of at most ``capacity`` rows, reaches the driver, and only the
    slot runs, a few for each length, are broadcast.
    """
    histogram = {int(r["length"]): int(r["count"]) for r in pieces.groupBy("length").count().collect()}
    made = plan(histogram, capacity)
    runs = pieces.sparkSession.createDataFrame(made.runs, RUNS)
    items = common.ranked(pieces, "length", ["doc_id", "start", "ids_crc32"])
    at = F.col("rank") - F.col("first")
    joined = items.join(F.broadcast(runs), (items["length"] == runs["length"]) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("items")))
    return joined.select(
        *[items[c] for c in pieces.columns],
        (F.col("seq") + F.floor(at / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("off") + F.pmod(at, F.col("copies")) * items["length"]).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """Every document's ids in sequences of at most 1024; one row per piece.

    Equal rows are packed separately.  An empty table gives no rows.
    """
    path = path or tokens.vocabulary("byte_bpe_50k.json")
    ranks_path = ranks_path or tokens.vocabulary("byte_bpe_50k.tiktoken")
    return pack(common.materialise(pieces_of(docs, path, ranks_path), "pieces"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 ids."""
    return pack_documents(common.table(spark, sf_dir, "documents"))
