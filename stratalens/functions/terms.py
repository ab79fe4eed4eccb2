"""Which of many terms a text holds, found in one walk.

Testing each term is a scan of the text of its own.  An automaton of all terms finds
them together, and leaves a bitmap beside the text from which rules, labels and scores are
read as ordinary column expressions.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

#: Terms of one number of a bitmap.
BITS = 62


class Terms:
    """A fixed set of terms, whatever their case."""

    def __init__(self, terms: Iterable[str]):
        self.terms = sorted({t.lower() for t in terms if t})
        self.place = {t: i for i, t in enumerate(self.terms)}

    def walk(self, lowered: Column) -> Column:
        """The bitmap of a text in lower case, to be kept in a column; null for a null text."""
        terms, width = self.terms, -(-len(self.terms) // BITS)

        @arrow_udf("array<long>")
        def run(texts: pa.Array) -> pa.Array:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for i, t in enumerate(terms):
                automaton.add_word(t, i)
            automaton.make_automaton()
            found = np.zeros((len(texts), width), np.int64)
            for row, text in enumerate(texts):
                s = text.as_py()
                for i in {i for _, i in automaton.iter(s)} if s and terms else ():
                    found[row, i // BITS] |= 1 << (i % BITS)
            ends = pa.array(np.arange(0, found.size + 1, width) if width else np.zeros(len(texts) + 1), pa.int32())
            return pa.ListArray.from_arrays(ends, pa.array(found.ravel()), mask=texts.is_null() if texts.null_count else None)

        return run(lowered)


class Walked:
    """A text whose bitmap stands in a column: takes the place of the text where terms are tested."""

    def __init__(self, bitmap: Column, terms: Terms):
        self.bitmap, self.terms = bitmap, terms

    def has(self, term: str) -> Column:
        i = self.terms.place[term.lower()]
        return F.getbit(F.get(self.bitmap, F.lit(i // BITS)), F.lit(i % BITS)) == 1


def has(text: Column | Walked, term: str) -> Column:
    """Whether a text in lower case, or one that has been walked, holds a term."""
    return text.has(term) if isinstance(text, Walked) else F.contains(text, F.lit(term.lower()))
