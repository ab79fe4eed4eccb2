"""Labels by ordered keyword rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules.pack import Rule
from .terms import Walked, has
from .text import contains_any, count_terms


def first_match(lowered: Column | Walked, rules: Sequence[Rule], default: str | None) -> Column:
    """The first rule's label with any keyword in the text."""
    out = F
    for rule in rules:
        out = out.when(contains_any(lowered, rule.keywords), rule.label)
    return F.lit(default) if out is F else out.otherwise(F.lit(default))


def all_matches(lowered: Column | Walked, rules: Sequence[Rule]) -> Column:
    """Labels of all rules that match, in order."""
    return F.array_compact(F.array(*[F.when(contains_any(lowered, r.keywords), F.lit(r.label)) for r in rules]))


def first_value(lowered: Column, table: Sequence[tuple[str, str]], default: str) -> Column:
    """A decimal looked up by the first keyword found."""
    out = F
    for keyword, value in table:
        out = out.when(F.contains(lowered, F.lit(keyword)), F.lit(value).cast("decimal(6,4)"))
    return out.otherwise(F.lit(default).cast("decimal(6,4)")) if out is not F else F.lit(default).cast("decimal(6,4)")


def entities(text: Column | Walked, names: Sequence[str]) -> Column:
    """Names found in the text whatever their case, sorted."""
    low = text if isinstance(text, Walked) else F.lower(text)
    return F.array_sort(F.array_compact(F.array(*[F.when(has(low, n), F.lit(n)) for n in names])))


def sentiment(text: Column | Walked, positive: Sequence[str], negative: Sequence[str]) -> Column:
    """Whether more positive or more negative terms occur."""
    low = text if isinstance(text, Walked) else F.lower(F.coalesce(text, F.lit("")))
    score = count_terms(low, positive) - count_terms(low, negative)
    return F.when(score > 0, "Positive").when(score < 0, "Negative").otherwise("Neutral")


def priority_rank(priority: Column) -> Column:
    return F.when(priority == "High", 1).when(priority == "Medium", 2).otherwise(3)
