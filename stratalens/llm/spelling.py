"""Spelling variants: words one edit apart, found with minimal automata of both directions.

Two words that differ by one inserted, deleted or replaced character have the same
beginning up to some place of the shorter, and the same end after it.  Either that place
is in the second half of the shorter word, and its first half is whole, or the other way
round.  So words meet in groups: by the shorter length and the first half, and by that
length and the second half.  A task makes a minimal acyclic automaton of some groups'
words (of the words backwards, where second halves are whole) whose nodes know how many
words they lead to, so that a path gives its word's number.  A word walks its half
exactly and completes it with one error.  A group with too many words is split by
halves of the range where the error may be, until groups are small.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LEAST_CHARS, LEAST_COUNT, RATIO = 7, 2, 10
#: One in so many runs has a character deleted, by the checksum of document and run.
TYPO_EVERY = 31
#: Different words that a task holds while it counts.
HELD_WORDS = 200_000
#: Words of a group above which it is split, and of an automaton above which the next one begins.
GROUP_WORDS = 20_000


def runs_of(doc: str, text: str, run: re.Pattern) -> Iterator[tuple[str, int]]:
    """(word, times) of a text; the checksum may delete a character of a run."""
    for word, n in Counter(run.findall(text.translate(LOW))).items():
        h = zlib.crc32(f"{doc}:{word}".encode())
        if h % TYPO_EVERY == 0:
            k = h % len(word)
            word = word[:k] + word[k + 1 :]
        yield word, n


def word_counts(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of all words of the documents, counted in tasks first.

    Null and empty texts have no words; a null id stands as an empty string in
    checksums; repeated rows count again; an empty table gives no words; a very long text
    is one task's linear work.  Other columns aren't read, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        long = re.compile(f"[A-Za-zÀ-ÿ]{{{least_chars},}}")  # a shorter run makes no word

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                for word, n in runs_of(doc.as_py(), text.as_py() or "", long):
                    if len(word) >= least_chars:
                        held[word] += n
                if len(held) > HELD_WORDS:
                    yield flush()
        yield flush()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


class Automaton:
    """A minimal acyclic automaton of sorted, distinct words: nodes are (word ends here, characters, nodes, words before each edge)."""

    def __init__(self, words: list[str]):
        self.known: dict[tuple, int] = {}
        self.nodes: list[tuple[bool, dict[str, tuple[int, int]]]] = []
        self.sizes: list[int] = []
        # the last word's path, whose nodes may still grow
        path: list[list] = [[False, []]]
        last = ""
        for word in words:
            same = 0
            for a, b in zip(last, word):
                if a != b:
                    break
                same += 1
            self._close(path, last, same)
            path += [[False, []] for _ in range(len(word) - same)]
            path[-1][0] = True
            last = word
        self._close(path, last, 0)
        self.start = self._node(path[0])
        self.known.clear()  # only needed while it is built

    def _close(self, path: list[list], word: str, keep: int) -> None:
        while len(path) > keep + 1:
            node = path.pop()
            path[-1][1].append((word[len(path) - 1], self._node(node)))

    def _node(self, open_node: list) -> int:
        """The one node with these edges."""
        key = (open_node[0], *open_node[1])
        found = self.known.get(key)
        if found is None:
            found = self.known[key] = len(self.nodes)
            edges, before = {}, int(open_node[0])
            for c, target in open_node[1]:
                edges[c] = (target, before)
                before += self.sizes[target]
            self.nodes.append((open_node[0], edges))
            self.sizes.append(before)
        return found

    def walk(self, node: int, number: int, rest: str) -> tuple[int, int] | None:
        """Where ``rest`` leads to, and how many words come before what follows; None if nowhere."""
        nodes = self.nodes
        for c in rest:
            step = nodes[node][1].get(c)
            if step is None:
                return None
            node, more = step
            number += more
        return node, number

    def one_error(self, exact: str, rest: str) -> Iterator[int]:
        """Numbers of the words that begin with ``exact`` and go on with ``rest`` in which one character is replaced or one is added."""
        found = self.walk(self.start, 0, exact)
        if found is None:
            return
        node, number = found
        nodes = self.nodes
        for i in range(len(rest) + 1):
            c = rest[i : i + 1]
            edges = nodes[node][1]
            for other, (target, more) in edges.items():
                if other == c:
                    continue  # an added character that equals the next one is found after it
                if c and (end := self.walk(target, number + more, rest[i + 1 :])) and nodes[end[0]][0]:
                    yield end[1]
                if (end := self.walk(target, number + more, rest[i:])) and nodes[end[0]][0]:
                    yield end[1]
            if not c or c not in edges:
                return
            node, more = edges[c]
            number += more


def common_start(a: str, b: str) -> int:
    for i, (x, y) in enumerate(zip(a, b)):
        if x != y:
            return i
    return min(len(a), len(b))


Row = tuple[str, int, int, int, int]


def near_within(rows: list[Row], back: bool) -> Iterator[tuple[str, int, int, int | None, str | None]]:
    """(word, n, near words, n of the most frequent of them, that word) for the words of some whole groups.

    ``rows`` are (word, n, shorter length, low, high).  A pair is only looked for in the
    group whose range from low to high holds the first place where the words differ.
    """
    counts = {r[0]: r[1] for r in rows}
    words = sorted(w[::-1] for w in counts) if back else sorted(counts)
    automaton = Automaton(words)
    number, best = Counter(), {}

    def meet(a: str, b: str) -> None:
        number[a] += 1
        if a not in best or (-counts[b], b) < best[a]:
            best[a] = (-counts[b], b)

    for word, _, length, low, high in rows:
        if len(word) != length:
            continue  # the shorter word looks for the longer one
        read, whole = (word[::-1], length - high) if back else (word, low)
        for k in automaton.one_error(read[:whole], read[whole:]):
            other = words[k][::-1] if back else words[k]
            place = common_start(word, other)
            if low <= place < high or place == high == length:
                meet(word, other)
                if len(other) > length:
                    meet(other, word)
    for w, n in counts.items():
        least, form = best.get(w, (None, None))
        yield w, n, number[w], None if least is None else -least, form


def _keyed(parts: DataFrame) -> DataFrame:
    """Add ``key``: the same for words that are alike outside the range."""
    after = F.col("length") - F.col("high")
    return parts.withColumn("key", F.xxhash64("length", "low", "high", F.substring("word", F.lit(1), F.col("low")), F.substring("word", F.length("word") - after + 1, after)))


def groups(words: DataFrame, least_chars: int = LEAST_CHARS, group_words: int = GROUP_WORDS) -> DataFrame:
    """(word, n, length, low, high, key): every word in its groups, as the shorter or equal one and as the longer one of a pair.

    Groups of more than ``group_words`` are split while their range has two places or more.
    """
    size = F.length("word")
    lengths = F.explode(F.filter(F.array(size, size - 1), lambda m: m >= least_chars))
    parts = words.select("word", "n", lengths.alias("length"))
    half = F.floor(F.col("length") / 2).cast("int")
    pair = lambda low, high: F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"))
    parts = parts.select("word", "n", "length", F.explode(F.array(pair(half, F.col("length")), pair(F.lit(0), half))).alias("r")).select("word", "n", "length", "r.low", "r.high")
    parts = _keyed(parts)
    while True:
        large = parts.groupBy("key").agg(F.count("*").alias("_n"), F.max(F.col("high") - F.col("low")).alias("_w")).filter((F.col("_n") > group_words) & (F.col("_w") > 1))
        large = common.materialise(large.select("key", F.lit(True).alias("_large")), "spelling-large")
        if large.isEmpty():
            return parts
        middle = F.col("low") + F.floor((F.col("high") - F.col("low")) / 2)
        ranges = F.when(F.col("_large") & (F.col("high") - F.col("low") > 1), F.array(pair(F.col("low"), middle), pair(middle, F.col("high")))).otherwise(F.array(pair(F.col("low"), F.col("high"))))
        parts = parts.join(large, "key", "left").select("word", "n", "length", F.explode(ranges).alias("r")).select("word", "n", "length", "r.low", "r.high")
        parts = common.materialise(_keyed(parts), "spelling-parts")


def near_words(words: DataFrame, least_chars: int = LEAST_CHARS, group_words: int = GROUP_WORDS) -> DataFrame:
    """(word, n, n_near, best_n, best): how many near words each of the words (word, n) has, and the most frequent one, the smallest of equals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list[Row], list[Row]] = ([], [])  # where the first half is whole, where the second is
        last, many = None, 0

        def flush() -> pa.RecordBatch:
            out = [row for back, rows in enumerate(held) for row in near_within(rows, bool(back))]
            for rows in held:
                rows.clear()
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["word", "n", "n_near", "best_n", "best"])

        for batch in batches:
            for key, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "word", "n", "length", "low", "high")), strict=True):
                if key != last and many > group_words:
                    yield flush()
                    many = 0
                last = key
                many += 1 + len(row[0]) // 64  # long words count more
                held[row[3] < row[2] // 2].append(tuple(row))
        yield flush()

    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = groups(words, least_chars, group_words).repartition(tasks, "key").sortWithinPartitions("key")
    found = parts.select("key", "word", "n", "length", "low", "high").mapInArrow(run, "word string, n long, n_near long, best_n long, best string")
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("least"), "best"))).alias("b")
    return found.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best).select("word", "n", "n_near", (-F.col("b.least")).alias("best_n"), "b.best")


def variants(words: DataFrame, ratio: int = RATIO, least_chars: int = LEAST_CHARS, group_words: int = GROUP_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words (word, n): the near word that is ``ratio`` times as frequent or more, and where forms lead to.

    Frequencies rise along forms, so there are no rings, and a chain is as long as
    the logarithm of the largest frequency; each round doubles how far a word sees.
    An empty table gives no rows.
    """
    common.ship(words.sparkSession)
    near = near_words(words, least_chars, group_words)
    right = F.col("best_n") >= ratio * F.col("n")
    rows = near.select("word", F.when(right, F.col("best")).alias("form"), "n", "n_near", F.when(right, F.col("best_n")).alias("form_n"))
    rows = common.materialise(rows, "spelling-rows")
    seen = rows.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        further = seen.select(F.col("word").alias("root"), F.col("root").alias("_far"))
        seen = common.materialise(seen.join(further, "root", "left").select("word", F.coalesce("_far", "root").alias("root"), F.col("_far").isNotNull().alias("_moved")), "spelling-roots")
        moved, seen = seen.filter("_moved"), seen.drop("_moved")
        if moved.isEmpty():
            break
    return rows.join(seen, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants among all words of all documents."""
    words = word_counts(common.table(spark, sf_dir, "documents"))
    return variants(common.materialise(words, "spelling-words"))
