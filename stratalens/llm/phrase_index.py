"""A positional inverted index over the corpus, searched for benchmark phrases.

The index is a stored table of shards of whole documents: the sorted terms of a
shard, and for each the positions of its occurrences.  A phrase is found by
taking the postings of the term that is rarest in the shard, shifted by the
term's place in the phrase, and keeping those that the next rarest terms'
postings confirm.  Tasks cut test items into phrases and store them in blocks of
bounded size; each block is sent to all shards, so neither postings nor pairs are
ever shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, textnum

WINDOW = 13
#: Words of test items searched for at once: the bound on what is sent to every task.
BLOCK_WORDS = 200_000

INDEX = "doc_ids array<long>, starts array<int>, terms array<long>, counts array<int>, postings binary"
MATCHES = "shard long, doc int, item_id long, first int, past int"


def _array(values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values))


def build_index(docs: DataFrame) -> DataFrame:
    """Index whole texts; a null or empty text has no words.  One row per shard of about a megabyte of text.

    ``starts`` has the first word of each document in the shard's numbering and,
    last, the number of words; ``postings`` holds 32-bit word numbers, ascending
    within each term, terms in the order of ``terms`` (64-bit hashes).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in textnum.blocks(batches):
            start, end, row = textnum.words(data, offsets, textnum.NOT_ALNUM)
            tokens = textnum.word_hashes(data, start, end).view(np.int64)
            order = np.argsort(tokens, kind="stable")
            terms, counts = np.unique(tokens, return_counts=True)
            starts = np.searchsorted(row, np.arange(rows.num_rows + 1)).astype(np.int32)
            ids = rows.column("doc_id").cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                    _array(starts),
                    _array(terms),
                    _array(counts.astype(np.int32)),
                    pa.array([order.astype("<u4").tobytes()], pa.binary()),
                ],
                ["doc_ids", "starts", "terms", "counts", "postings"],
            )

    made = docs.select("doc_id", "text").mapInArrow(run, INDEX)
    return common.materialise(made.withColumn("shard", F.monotonically_increasing_id()), "phrase-index")


@dataclass(frozen=True)
class Windows:
    """Phrases of one block: term numbers (into ``vocabulary``), -1 to fill short ones up, their lengths and items."""

    vocabulary: np.ndarray
    terms: np.ndarray
    lengths: np.ndarray
    items: np.ndarray


def item_words(text: str | None) -> np.ndarray:
    data = np.frombuffer((text or "").encode(), np.uint8)
    start, end, _ = textnum.words(data, np.array([0, len(data)]), textnum.NOT_ALNUM)
    return textnum.word_hashes(data, start, end).view(np.int64)


def windows_of(items: list[tuple[int, np.ndarray]], width: int) -> Windows:
    """Every run of ``width`` words of each item; an item of fewer, but not none, is one run."""
    rows, lengths, owners = [], [], []
    for item, words in items:
        for i in range(max(1, len(words) - width + 1) if len(words) else 0):
            run = words[i : i + width]
            rows.append(np.pad(run, (0, width - len(run))))
            lengths.append(len(run))
            owners.append(item)
    table = np.array(rows, np.int64).reshape(-1, width)
    length = np.array(lengths, np.int64)
    inside = np.arange(width) < length[:, None]
    vocabulary = np.unique(table[inside])
    terms = np.where(inside, np.searchsorted(vocabulary, table), -1).astype(np.int32)
    return Windows(vocabulary, terms, length, np.array(owners, np.int64))


class Shard:
    """One index row, ready to be searched."""

    def __init__(self, starts: np.ndarray, terms: np.ndarray, counts: np.ndarray, postings: bytes):
        self.starts, self.terms = starts, terms
        self.size = int(starts[-1])
        self.heads = np.concatenate([[0], np.cumsum(counts)])
        self.positions = np.frombuffer(postings, "<u4").astype(np.int64)
        # one ascending list of term and position: a look-up tells whether a term stands somewhere
        self.keys = np.repeat(np.arange(len(terms)), counts) * self.size + self.positions

    def local(self, vocabulary: np.ndarray) -> np.ndarray:
        """Each term's number in this shard, or -1."""
        if not len(self.terms):
            return np.full(len(vocabulary), -1)
        at = np.minimum(np.searchsorted(self.terms, vocabulary), len(self.terms) - 1)
        return np.where(self.terms[at] == vocabulary, at, -1)

    def stands(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        want = term * self.size + position
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return (position >= 0) & (position < self.size) & (self.keys[at] == want)

    def occurrences(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into ``term``, position) of every posting of each."""
        n = self.heads[term + 1] - self.heads[term]
        owner = np.repeat(np.arange(len(term)), n)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        return owner, self.positions[self.heads[term][owner] + within]

    def doc(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, position, side="right") - 1

    def phrases(self, w: Windows) -> tuple[np.ndarray, np.ndarray]:
        """(window, first word) of every occurrence."""
        local = self.local(w.vocabulary)
        terms = np.where(w.terms >= 0, local[w.terms], 0)
        able = np.flatnonzero((terms >= 0).all(axis=1)) if len(terms) else np.zeros(0, int)
        if not len(able):
            return able, able
        terms, used = terms[able], w.terms[able] >= 0
        # each phrase's terms from the rarest here; what fills short ones up comes last
        weight = np.where(used, self.heads[terms + 1] - self.heads[terms], np.iinfo(np.int64).max)
        places = np.argsort(weight, axis=1, kind="stable")
        terms, used = np.take_along_axis(terms, places, 1), np.take_along_axis(used, places, 1)
        which, position = self.occurrences(terms[:, 0])
        start = position - places[which, 0]
        for k in range(1, terms.shape[1]):
            if not len(which):
                break
            keep = ~used[which, k] | self.stands(terms[which, k], start + places[which, k])
            which, start = which[keep], start[keep]
        which = able[which]
        whole = (start >= 0) & (self.doc(start) == self.doc(start + w.lengths[which] - 1)) if len(which) else np.zeros(0, bool)
        return which[whole], start[whole]

    def near(self, query: np.ndarray, slop: int) -> np.ndarray:
        """Positions of the first term of ``query`` with every other term at most ``slop`` words away in the same document."""
        local = self.local(query)
        if (local < 0).any():
            return np.zeros(0, np.int64)
        _, position = self.occurrences(local[:1])
        doc = self.doc(position)
        low = np.maximum(position - slop, self.starts[doc])
        high = np.minimum(position + slop, self.starts[doc + 1] - 1)
        keep = np.ones(len(position), bool)
        for term in local[1:]:
            keep &= np.searchsorted(self.keys, term * self.size + low) < np.searchsorted(self.keys, term * self.size + high, side="right")
        return position[keep]


def shards(batch: pa.RecordBatch) -> Iterator[tuple[int, list, Shard]]:
    for i in range(batch.num_rows):
        get = lambda c: batch.column(c)[i]  # noqa: E731, B023
        arrays = [get(c).values.to_numpy(zero_copy_only=False) for c in ("starts", "terms", "counts")]
        yield get("shard").as_py(), get("doc_ids").values, Shard(*arrays, get("postings").as_py())


def frequencies(index: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """Occurrences of each term in the whole corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, counts in zip(batch.column("terms"), batch.column("counts"), strict=True):
                t, c = terms.values.to_numpy(zero_copy_only=False), counts.values.to_numpy(zero_copy_only=False)
                _, here, there = np.intersect1d(vocabulary, t, assume_unique=True, return_indices=True)
                yield pa.RecordBatch.from_arrays([pa.array(here, pa.int32()), pa.array(c[there], pa.int64())], ["term", "n"])

    out = np.zeros(len(vocabulary), np.int64)
    for r in index.select("terms", "counts").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]
    return out


BLOCKS = "vocabulary binary, terms binary, lengths binary, items binary"


def item_blocks(items: DataFrame, block_words: int, width: int) -> DataFrame:
    """Phrases of items with some words in stored blocks of ``block_words`` words or little more.

    Tasks make them; a long item's parts overlap by all but one word of a window.
    Items without an id are left out.
    """
    kept = items.select("item_id", "text").filter("item_id is not null")
    size = kept.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    step = max(1, block_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple[int, np.ndarray]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            w = windows_of(block, width)
            block.clear()
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (w.vocabulary, w.terms, w.lengths, w.items)], ["vocabulary", "terms", "lengths", "items"])

        for batch in batches:
            for item, text in zip(batch.column("item_id"), batch.column("text"), strict=True):
                words = item_words(text.as_py())
                for at in range(0, max(len(words) - width + 1, min(len(words), 1)), step):
                    part = words[at : at + step + width - 1]
                    if block and held + len(part) > block_words:
                        yield flush()
                        held = 0
                    block.append((item.as_py(), part))
                    held += len(part)
        if block:
            yield flush()

    # about as many tasks as blocks, at six bytes a word
    return common.materialise(kept.repartition(max(1, min(size // (6 * step), 10_000))).mapInArrow(run, BLOCKS), "phrase-blocks")


def find_phrases(index: DataFrame, items: DataFrame, width: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Runs of document words (``first`` to ``past`` in the shard's numbering) that windows of an item cover.

    Test items are a stated set of queries: their blocks are stored, and one after the
    other is broadcast, at most ``block_words`` words with their windows; a block takes one
    scan of the index.  Items without an id are left out.
    """
    found, spark = None, index.sparkSession
    for r in item_blocks(items, block_words, width).toLocalIterator():
        terms = np.frombuffer(r["terms"], np.int32).reshape(-1, width)
        vocabulary, lengths, owners = (np.frombuffer(r[c], np.int64) for c in ("vocabulary", "lengths", "items"))
        sent = spark.sparkContext.broadcast(Windows(vocabulary, terms, lengths, owners))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            windows = sent.value
            for batch in batches:
                for number, _, shard in shards(batch):
                    which, start = shard.phrases(windows)
                    if not len(which):
                        continue
                    doc, item, past = shard.doc(start), windows.items[which], start + windows.lengths[which]
                    order = np.lexsort((start, item, doc))
                    doc, item, start, past = doc[order], item[order], start[order], past[order]
                    # windows of an item overlap: one row for each run they cover
                    new = np.ones(len(doc), bool)
                    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (start[1:] > past[:-1])
                    first = np.flatnonzero(new)
                    columns = [np.full(len(first), number), doc[first], item[first], start[first], np.maximum.reduceat(past, first)]
                    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["shard", "doc", "item_id", "first", "past"])

        part = index.mapInArrow(run, MATCHES)
        found = part if found is None else found.unionByName(part)
    return index.sparkSession.createDataFrame([], MATCHES) if found is None else found


def find_near(index: DataFrame, query: list[str], slop: int) -> DataFrame:
    """Documents where every word of ``query`` stands within ``slop`` words of its rarest: (doc_id, matches)."""
    words = np.unique(item_words(" ".join(query)))
    words = words[np.argsort(frequencies(index, words), kind="stable")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, ids, shard in shards(batch):
                doc, n = np.unique(shard.doc(shard.near(words, slop)), return_counts=True)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), pa.array(n, pa.int64())], ["doc_id", "matches"])

    return index.mapInArrow(run, "doc_id long, matches long") if len(words) else index.sparkSession.createDataFrame([], "doc_id long, matches long")


def contamination(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """One row per document row: its words, those inside a test phrase, and the items found.

    Contaminated: some word is hit, and hit words are a twentieth or more.
    Rows that are equal, or that share an id, are judged each on its own text.  Items
    without an id or without words find nothing; an item id may have several rows.
    Empty tables give an empty result, or no hits; a very long text is a shard of its
    own; other columns of either table aren't read.
    """
    index = build_index(docs)
    spans = find_phrases(index, items, width).groupBy("shard", "doc").agg(
        F.array_sort(F.collect_list(F.struct("first", "past"))).alias("spans"),
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
    )
    zero = F.struct(F.lit(0).alias("hit"), F.lit(-1).alias("past"))
    covered = F.aggregate(
        "spans",
        zero,
        lambda a, s: F.struct(
            (a["hit"] + F.greatest(F.lit(0), s["past"] - F.greatest(s["first"], a["past"]))).alias("hit"), F.greatest(a["past"], s["past"]).alias("past")
        ),
        lambda a: a["hit"].cast("long"),
    )
    spans = spans.select("shard", "doc", covered.alias("n_hit"), "items")
    each = index.select("shard", "starts", F.posexplode("doc_ids").alias("doc", "doc_id"))
    each = each.select("shard", "doc", "doc_id", (F.get("starts", F.col("doc") + 1) - F.get("starts", F.col("doc"))).cast("long").alias("n_words"))
    out = each.join(spans, ["shard", "doc"], "left")
    hit, names = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"),
        ((hit > 0) & (hit * 20 >= F.col("n_words"))).alias("contaminated"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in all documents."""
    return contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
