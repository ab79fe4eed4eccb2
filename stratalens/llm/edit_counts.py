"""Token counts that follow edits: a segment tree of words per document.

Leaves hold the characters and token counts of a few words each; inner nodes hold
their sums.  An edit finds its leaves by the character sums, and only the words
it touches, with one word of context before and as many after as it takes to
meet an old word boundary, are encoded again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

#: Words of a leaf when it is made; a leaf of more than four times as many is split.
LEAF = 32


class CountTree:
    """Words of one text with sums of characters and tokens.

    ``lengths`` and ``counts``, if given, are those of the text's words from an earlier
    time: then nothing of it is encoded.  Words follow the vocabulary's own rule, which
    looks some characters past a word at most, so a word that ends that far before an
    edit is not changed by it.
    """

    def __init__(self, encode: tokens.WordIds, text: str, lengths: np.ndarray | None = None, counts: np.ndarray | None = None, special: bool = True):
        self.encode, self.encoded, self.special, self.text = encode, 0, special, text
        self.look = tokens.LOOK if special else 1
        if lengths is None:
            cut = encode.cut(text)
            lengths, counts = [len(w) for w in cut], [len(encode[w]) // 4 for w in cut]
        # characters and tokens before each old word
        self.place, self.before = ([0, *np.cumsum(x, dtype=np.int64).tolist()] for x in (lengths, counts))
        # a leaf is a range of old words until an edit comes to it, and then a list of (word, tokens)
        n = len(self.place) - 1
        self.leaves: list[range | list[tuple[str, int]]] = [range(i, min(i + LEAF, n)) for i in range(0, n, LEAF)] or [[]]
        self._grow()

    def _words(self, leaf: int) -> list[tuple[str, int]]:
        held = self.leaves[leaf]
        if isinstance(held, range):
            held = [(self.text[self.place[i] : self.place[i + 1]], self.before[i + 1] - self.before[i]) for i in held]
            self.leaves[leaf] = held
        return held

    def words(self) -> list[tuple[str, int]]:
        return [w for i in range(len(self.leaves)) for w in self._words(i)]

    def _count(self, held: range | list[tuple[str, int]]) -> tuple[int, int]:
        if isinstance(held, range):
            return self.place[held.stop] - self.place[held.start], self.before[held.stop] - self.before[held.start]
        return sum(len(w) for w, _ in held), sum(n for _, n in held)

    def _grow(self) -> None:
        """Build the sums over all leaves."""
        self.base = 1 << max(0, (len(self.leaves) - 1).bit_length())
        self.chars, self.tokens = [0] * (2 * self.base), [0] * (2 * self.base)
        for i, leaf in enumerate(self.leaves):
            self.chars[self.base + i], self.tokens[self.base + i] = self._count(leaf)
        for i in range(self.base - 1, 0, -1):
            self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    def _set(self, leaf: int, words: list[tuple[str, int]]) -> None:
        self.leaves[leaf] = words
        i = self.base + leaf
        self.chars[i], self.tokens[i] = self._count(words)
        while i > 1:
            i //= 2
            self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    def _leaf(self, place: int) -> tuple[int, int]:
        """The leaf that holds character ``place`` (the last one, at the end), and where it begins."""
        i, before = 1, 0
        while i < self.base:
            i *= 2
            if place >= before + self.chars[i] and i + 1 < 2 * self.base and self.chars[i + 1]:
                before += self.chars[i]
                i += 1
        return min(i - self.base, len(self.leaves) - 1), before

    @property
    def total(self) -> int:
        return self.tokens[1]

    def _context(self, words: list[tuple[str, int]], at: int, start: int) -> tuple[int, int]:
        """The first word that an edit at ``start`` can change, and its place.

        That is the first to end within reach of it; a run of white space before it
        counts as one, since how it is cut depends on what follows it.
        """
        edges, k = [at], 0
        for w, _ in words:
            edges.append(edges[-1] + len(w))
        while k < len(words) and edges[k + 1] + self.look <= start:
            k += 1
        while k > 0 and not words[k - 1][0].strip():
            k -= 1
        return k, edges[k]

    def replace(self, start: int, removed: int, inserted: str) -> None:
        """Put ``inserted`` in place of ``removed`` characters at ``start``."""
        size = self.chars[1]
        start = min(max(start, 0), size)
        removed = min(max(removed, 0), size - start)
        low, at = self._leaf(max(start - 1, 0))
        high = max(low, self._leaf(min(start + removed, max(size - 1, 0)))[0])
        words = [w for i in range(low, high + 1) for w in self._words(i)]
        k, begin = self._context(words, at, start)
        while k == 0 and low > 0:
            low -= 1
            words = self._words(low) + words
            at -= self.chars[self.base + low]
            k, begin = self._context(words, at, start)
        shift = len(inserted) - removed
        settled = start + len(inserted) - begin  # what follows is old text
        while True:
            old = "".join(w for w, _ in words[k:])
            new = old[: start - begin] + inserted + old[start - begin + removed :]
            bounds, place = set(), 0
            for w, _ in words[k:]:
                bounds.add(place + shift)
                place += len(w)
            fresh, done = [], 0
            for a, b in self.encode.spans(new + self._peek(high + 1), self.special):
                if a >= settled and a in bounds or b > len(new):
                    break
                fresh.append(new[a:b])
                done = b
            # scanning from an old word's beginning gives the old words again
            if done == len(new) or done >= settled and done in bounds:
                break
            high += 1
            words += self._words(high)
        self.encoded += sum(map(len, fresh))
        kept, place = [], shift
        for w in words[k:]:
            if place >= done and place >= settled:
                kept.append(w)
            place += len(w[0])
        merged = words[:k] + [(w, len(self.encode[w]) // 4) for w in fresh] + kept
        if len(merged) > 4 * LEAF * (high - low + 1):
            self.leaves[low : high + 1] = [merged[i : i + LEAF] for i in range(0, len(merged), LEAF)]
            self._grow()  # sums are laid out anew; words and their counts stay as they are
        else:
            share = -(-len(merged) // (high - low + 1))
            for i in range(high - low + 1):
                self._set(low + i, merged[i * share : (i + 1) * share])

    def _peek(self, leaf: int) -> str:
        """Enough of what follows to see whether a word goes on."""
        out = ""
        while leaf < len(self.leaves) and len(out) <= self.look:
            out += "".join(w for w, _ in self._words(leaf))
            leaf += 1
        return out


TREES = "doc_id long, text string, lengths array<int>, counts array<int>"
COUNTS = "doc_id long, n_chars long, n_tokens long, edited_chars long, edited_tokens long, encoded_chars long"


def _vocabulary(path: str | None, ranks_path: str | None) -> tuple[str, str]:
    return path or tokens.vocabulary("byte_bpe_50k.json"), ranks_path or tokens.vocabulary("byte_bpe_50k.tiktoken")


def build_trees(docs: DataFrame, path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """The words of each text with their tokens: (doc_id, text, lengths, counts), which can be stored.

    Null texts count as empty.  An empty table gives no trees; a very long text is one
    list of words.  Other columns than doc_id and text stay, whatever their names.
    """
    paths = _vocabulary(path, ranks_path)
    added = [f for f in docs.schema if f.name not in ("doc_id", "text", "lengths", "counts")]
    names = [f.name for f in added]
    schema = f"{TREES}{''.join(f', `{f.name}` {f.dataType.simpleString()}' for f in added)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(*paths)
        for batch in batches:
            lengths, counts = [], []
            for raw in batch.column("text"):
                cut = encode.cut(raw.as_py() or "")
                lengths.append(np.fromiter(map(len, cut), np.int32, len(cut)))
                counts.append(np.fromiter(map(len, map(encode.__getitem__, cut)), np.int32, len(cut)) // 4)
            lists = [pa.array(x, pa.list_(pa.int32())) for x in (lengths, counts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("text").fill_null(""), *lists, *(batch.column(c) for c in names)], ["doc_id", "text", "lengths", "counts", *names])

    return docs.select("doc_id", "text", *names).mapInArrow(run, schema)


def _steps(edits: pa.Scalar) -> list[tuple[int, int, str]]:
    return [(e["start"] or 0, e["removed"] or 0, e["inserted"] or "") for e in edits.as_py() or [] if e]


def apply_edits(trees: DataFrame, path: str | None = None, ranks_path: str | None = None, keep: bool = False) -> DataFrame:
    """Tokens of each tree's text before and after its ``edits`` (array of (start, removed, inserted), applied in turn).

    Old words aren't encoded again: their counts come from the tree.  Null edits count
    as none; edits beyond a text's end are cut to it.  ``encoded_chars`` is what the
    edits caused to be encoded.  With ``keep``, the edited trees' columns follow.
    """
    paths = _vocabulary(path, ranks_path)
    schema = COUNTS + (", " + TREES.removeprefix("doc_id long, ") if keep else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(*paths)
        for batch in batches:
            rows: list[list] = []
            for doc, raw, lengths, counts, edits in zip(*(batch.column(c) for c in ("doc_id", "text", "lengths", "counts", "edits")), strict=True):
                text, steps = raw.as_py(), _steps(edits)
                special = "<" in text or any("<" in s[2] for s in steps)  # else the special token's string can't come up
                tree = CountTree(encode, text, lengths.values.to_numpy(), counts.values.to_numpy(), special)
                before = tree.total
                for step in steps:
                    tree.replace(*step)
                row = [doc.as_py(), len(text), before, tree.chars[1], tree.total, tree.encoded]
                if keep:
                    words = tree.words()
                    row += ["".join(w for w, _ in words), [len(w) for w, _ in words], [n for _, n in words]]
                rows.append(row)
            kinds = [*[pa.int64()] * 6, *([pa.string(), *[pa.list_(pa.int32())] * 2] if keep else [])]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [x.split()[0] for x in schema.split(", ")])

    return trees.select("doc_id", "text", "lengths", "counts", "edits").mapInArrow(run, schema)


def count_edits(docs: DataFrame, path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """Trees of texts (doc_id, text, edits) built and edited in one go; any text and any character goes through its tree."""
    return apply_edits(build_trees(docs.select("doc_id", "text", "edits"), path, ranks_path), path, ranks_path)


def with_edits(docs: DataFrame) -> DataFrame:
    """Three edits for each text: its middle 16 characters go, its first 24 are repeated a third of the way in, and a line is added."""
    n = F.length(F.coalesce("text", F.lit("")))
    edit = lambda start, removed, inserted: F.struct(start.cast("long").alias("start"), F.lit(removed).cast("long").alias("removed"), inserted.alias("inserted"))
    steps = F.array(
        edit(F.floor(n / 2), 16, F.lit("")),
        edit(F.floor(n / 3), 0, F.substring(F.coalesce("text", F.lit("")), 1, 24)),
        edit(n + 24, 0, F.lit("\nReviewed.")),
    )
    return docs.withColumn("edits", steps)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents before and after three edits each."""
    return count_edits(with_edits(common.table(spark, sf_dir, "documents").select("doc_id", "text")))
