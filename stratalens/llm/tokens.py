"""Token ids of a public byte-level BPE vocabulary, with a cache of words.

Texts are cut by the vocabulary's own word rule and each distinct word is encoded
once per worker.  Which characters are letters, digits or white space is asked of the
``tokenizers`` library, once for each character outside a plain range; ids equal that
library's.
"""

from __future__ import annotations

import base64
import functools
import re

import numpy as np

#: Distinct words kept per worker before the cache starts anew.
CACHE_WORDS = 150_000

SPECIAL = "<|endoftext|>"
#: How far past a word its end may depend on what follows.
LOOK = len(SPECIAL)
# The word rule over a plain range; letters and digits beyond ASCII are spelled out.
_L = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_N = "0-9²³¹¼-¾"
WORDS = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")
#: The same where the special token's string stands: it is a word, and texts end and begin at it.
WORDS_AND_SPECIAL = re.compile(
    rf"{re.escape(SPECIAL)}|'(?:s|t|re|ve|m|ll|d)| ?[{_L}]+| ?[{_N}]+| ?(?:(?!{re.escape(SPECIAL)})[^\s{_L}{_N}])+|\s+(?={re.escape(SPECIAL)})|\s+(?!\S)|\s+"
)
_ODD_CHARACTER = re.compile("[^\\t\\n\\r -~¡-¬®-ɏ‐-‧€]")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordIds(dict):
    """Word -> its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, ranks_path: str):
        import tiktoken

        super().__init__()
        self.path = path
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.one = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        known = [self.whole.token_to_id(SPECIAL)] if word == SPECIAL else self.one(word)
        self[word] = ids = np.array(known, "<u4").tobytes()
        return ids

    @functools.cached_property
    def whole(self):
        """The library's own tokenizer, loaded once a text needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @functools.cached_property
    def plain_twins(self) -> Twins:
        return Twins(self.whole.pre_tokenizer.pre_tokenize_str)

    def spans(self, text: str, special: bool | None = None) -> list[tuple[int, int]]:
        """(start, end) of the words of a text, which leave nothing out."""
        if special is None:
            special = SPECIAL in text
        if _ODD_CHARACTER.search(text):
            text = text.translate(self.plain_twins)
        return [m.span() for m in (WORDS_AND_SPECIAL if special else WORDS).finditer(text)]

    def cut(self, text: str, special: bool | None = None) -> list[str]:
        if special is None:
            special = SPECIAL in text
        if _ODD_CHARACTER.search(text):
            return [text[a:b] for a, b in self.spans(text, special)]
        return (WORDS_AND_SPECIAL if special else WORDS).findall(text)

    def ids(self, text: str) -> bytes:
        """All ids of a text, packed."""
        return b"".join(map(self.__getitem__, self.cut(text)))


class Twins(dict):
    """For each character a plain one of the same kind: letter, digit, white space or other, as the library has it."""

    def __init__(self, pieces):
        super().__init__({ord(c): ord(c) for c in map(chr, range(0x250)) if not _ODD_CHARACTER.match(c)})
        self.pieces = pieces

    def __missing__(self, code: int) -> int:
        c = chr(code)
        kinds = [twin for twin in "a1!" if len(self.pieces(twin + c + twin)) == 1]
        self[code] = ord(kinds[0] if kinds else "\t")
        return self[code]


@functools.cache
def encoder(path: str, ranks_path: str) -> WordIds:
    return WordIds(path, ranks_path)
