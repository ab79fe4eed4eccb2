"""Ids of a merge-type (BPE) SentencePiece vocabulary by backtracking, and texts from ids.

Merging takes the neighbours whose joint piece has the highest score first, the
leftmost of equal ones.  A sequence of pieces is what merging makes of a text exactly
if each two neighbours stay as they are when they alone are merged again.  So pieces
are laid from left to right, the longest first (one automaton finds the longest piece
at every place), each checked against its neighbour; where none fits, the place is
marked as failed in a bitfield and the piece before it is shortened.  No place fails
twice, so time is linear in the text.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common, tokens

#: Distinct words that a worker remembers in each of two generations, and pairs of pieces before it starts anew; longer words aren't kept.
CACHE_WORDS, CACHE_PAIRS, LONG_WORD = 250_000, 400_000, 48
SPACE = "▁"


def _one_each(error: UnicodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("one-each", _one_each)


class Pairs(dict):
    """(piece, next piece) -> whether merging them alone leaves them; ('', piece) asks that of one piece."""

    def __init__(self, ranks: dict[str, int]):
        super().__init__()
        self.ranks = ranks

    def merged(self, text: str) -> list[str]:
        """What merging makes of a short text."""
        parts, rank, none = list(text), self.ranks.get, len(self.ranks)
        joint = [rank(a + b, none) for a, b in zip(parts, parts[1:])]
        while joint and (best := min(joint)) != none:
            i = joint.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del joint[i]
            if i:
                joint[i - 1] = rank(parts[i - 1] + parts[i], none)
            if i < len(joint):
                joint[i] = rank(parts[i] + parts[i + 1], none)
        return parts

    def __missing__(self, pair: tuple[str, str]) -> bool:
        if len(self) >= CACHE_PAIRS:
            self.clear()
        self[pair] = fits = self.merged(pair[0] + pair[1]) == [p for p in pair if p]
        return fits


class Shorter(dict):
    """Piece -> the longest other piece that it begins with; '' for a single character."""

    def __init__(self, pieces: dict[str, bytes]):
        super().__init__()
        self.pieces = pieces

    def __missing__(self, piece: str) -> str:
        self[piece] = found = next((piece[:k] for k in range(len(piece) - 1, 0, -1) if piece[:k] in self.pieces), "")
        return found


class PieceModel(dict):
    """A vocabulary file.  As a mapping: a word of normalised text -> its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        super().__init__()
        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, size = [], lib.vocab_size()
        self.control = np.array([lib.is_control(i) for i in range(size)])
        self.bytes_of, self.byte_ids = [], {}
        for i in range(size):
            text = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.byte_ids[int(text[1:-1], 16)] = i
                self.bytes_of.append(bytes([int(text[1:-1], 16)]))
            elif lib.is_unknown(i):
                self.bytes_of.append(" ⁇ ".encode())
            elif lib.is_control(i):
                self.bytes_of.append(b"")
            else:
                self.bytes_of.append(text.replace(SPACE, " ").encode())
                pieces.append((text, i))
        if len(self.byte_ids) < 256 or any(lib.is_unused(i) for i in range(size)):
            raise ValueError("the vocabulary needs a piece for every byte, and none that is unused")
        self.spaced = {i for p, i in pieces if p[0] == SPACE}
        order = sorted({lib.get_score(i) for _, i in pieces}, reverse=True)
        rank = {s: k for k, s in enumerate(order)}  # equal scores stay equal: the leftmost goes first
        self.fits = Pairs({p: rank[lib.get_score(i)] for p, i in pieces})
        self.packed = {p: np.uint32(i).tobytes() for p, i in pieces}
        # characters that are only found inside longer pieces stand for their bytes
        self.known = {c for p, _ in pieces for c in p}
        self.packed |= {c: self._raw(c) for c in self.known if c not in self.packed}
        self.starts = ahocorasick.Automaton()
        for p in self.packed:
            if len(p) > 1:
                self.starts.add_word(p, len(p) - 1)
        self.starts.make_automaton()
        self.shorter = Shorter(self.packed)
        self.older: dict[str, bytes] = {}  # words of the generation before
        # no piece goes on with a space after something else, or over a line's end: words can be looked at alone
        self.parts = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p, _ in pieces)
        apart = "".join(c for c in "\n\r\t" if c not in self.known)
        self.words = re.compile(f"{SPACE}*[^{SPACE}{apart}]+|{SPACE}+" + (f"|[{apart}]" if apart else ""))
        self.prefixed = lib.normalize("a").startswith(SPACE)
        self.begin, self.end = ([i] if i >= 0 else [] for i in (lib.bos_id(), lib.eos_id()))

    def _raw(self, text: str) -> bytes:
        return np.array([self.byte_ids[b] for b in text.encode()], "<u4").tobytes()

    def lay(self, text: str) -> list[str]:
        """The pieces of a text all of whose characters are known."""
        n = len(text)
        # matches come by rising ends, so the last one at a start is its longest; a place without one starts a single character
        until: dict[int, int] | np.ndarray
        if n <= LONG_WORD:
            until = {end - more: end + 1 for end, more in self.starts.iter(text)}
        else:
            until = np.arange(1, n + 1, dtype=np.int32)
            for end, more in self.starts.iter(text):
                until[end - more] = end + 1
        longest = until.get if isinstance(until, dict) else lambda at, _: int(until[at])
        failed = bytearray((n >> 3) + 1)
        out: list[str] = []
        at, last, fits, shorter = 0, "", self.fits, self.shorter
        piece = text[: longest(0, 1)] if n else ""
        while at < n:
            end = at + len(piece)
            if not failed[end >> 3] >> (end & 7) & 1 and fits[last, piece]:
                out.append(piece)
                at, last = end, piece
                if at < n:
                    piece = text[at : longest(at, at + 1)]
                continue
            piece = shorter[piece]
            while not piece:
                failed[at >> 3] |= 1 << (at & 7)
                whole = out.pop()
                at -= len(whole)
                last = out[-1] if out else ""
                piece = shorter[whole]
        return out

    def _encode(self, word: str) -> bytes:
        packed = self.packed.__getitem__
        if self.known.issuperset(word):
            return b"".join(map(packed, self.lay(word)))
        out, start = [], 0
        for i, c in enumerate(word):
            if c not in self.known:
                out += map(packed, self.lay(word[start:i]))
                out.append(self._raw(c))
                start = i + 1
        return b"".join([*out, *map(packed, self.lay(word[start:]))])

    def __missing__(self, word: str) -> bytes:
        if len(word) > LONG_WORD:
            return self._encode(word)
        if len(self) >= CACHE_WORDS:
            self.older = dict(self)
            self.clear()
        self[word] = found = self.older.get(word) or self._encode(word)
        return found

    def ids(self, text: str) -> np.ndarray:
        """Ids of a text without begin and end."""
        text = self.library.normalize(text)
        packed = b"".join(map(self.__getitem__, self.words.findall(text))) if self.parts else self[text] if text else b""
        return np.frombuffer(packed, "<u4")

    def text(self, ids: np.ndarray) -> str:
        """The text of ids: control ids are nothing, the space put before a text goes, bytes that aren't UTF-8 are U+FFFD each."""
        breaks = np.flatnonzero(self.control[ids])
        if len(breaks) and breaks[0] == 0:
            ids, breaks = ids[1:], breaks[1:] - 1
        if len(breaks) and breaks[-1] == len(ids) - 1:
            ids, breaks = ids[:-1], breaks[:-1]
        parts = list(map(self.bytes_of.__getitem__, ids.tolist()))
        first = next((i for i, p in enumerate(parts) if p), None)
        if self.prefixed and first is not None and int(ids[first]) in self.spaced:
            parts[first] = parts[first][1:]
        if not len(breaks):
            return b"".join(parts).decode("utf-8", "one-each")
        # bytes on both sides of a control id don't make a character
        edges = [-1, *breaks.tolist(), len(parts)]
        return "".join(b"".join(parts[a + 1 : b]).decode("utf-8", "one-each") for a, b in zip(edges, edges[1:]))


@functools.cache
def model(path: str) -> PieceModel:
    return PieceModel(path)


def encode_pieces(docs: DataFrame, path: str, begin: bool = True, end: bool = True) -> DataFrame:
    """(doc_id, ids array<int>) of every text.

    Null and empty texts are the begin and end ids alone; equal texts and repeated rows
    are encoded one by one, an empty table gives no rows, and a very long text is
    linear work in its task.  Other columns aren't read, whatever their names.
    """
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        first, last = (np.array(x, "<u4") for x in (m.begin * begin, m.end * end))
        for batch in batches:
            found = [np.concatenate((first, m.ids(t.as_py() or ""), last)) for t in batch.column("text")]
            ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found or [first]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], ["doc_id", "ids"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_pieces(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows with ids; null ids are an empty text, and an id outside the vocabulary is an error."""
    common.ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            texts = [m.text(np.array(x.as_py() or [], np.int32)) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = rows.select("doc_id", "ids")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def digests(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of rows with ids, as they are decoded."""
    common.ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            counts, packed, decoded = [], [], []
            for x in batch.column("ids"):
                ids = np.array(x.as_py() or [], np.int32) if x.values is None else x.values.to_numpy()
                counts.append(len(ids))
                packed.append(hashlib.sha256(ids.astype("<u4")).hexdigest())
                decoded.append(hashlib.sha256(m.text(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(packed, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = rows.select("doc_id", "ids")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with begin and end ids and decoded again."""
    path = tokens.vocabulary("piece_bpe_32k.model")
    return digests(encode_pieces(common.table(spark, sf_dir, "documents"), path), path)
