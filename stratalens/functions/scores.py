"""Scores in exact decimals, given as doubles at the end.

Binary fractions round differently in every engine; these do not.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules.pack import Pack
from .terms import Walked
from .text import count_terms


def dec(x: str | Column) -> Column:
    return (F.lit(Decimal(x)) if isinstance(x, str) else x).cast("decimal(9,4)")


def clamp(x: Column) -> Column:
    """Into 0 to 1; null stays null."""
    return F.when(x.isNotNull(), F.greatest(dec("0"), F.least(dec("1"), dec(x))))


def rounded(x: Column, places: int = 3) -> Column:
    return F.round(x, places).cast("double")


# Ages in days and their scores.
RECENCY = ((30, "1.0"), (90, "0.85"), (180, "0.70"), (365, "0.55"))
OLDER, UNDATED = "0.40", "0.55"


def recency(published: Column, as_of: Column) -> Column:
    """By whole days before ``as_of``; dates to come count as today's, an unknown date has a score of its own."""
    days = F.greatest(F.lit(0), F.floor((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(published.cast("timestamp"))) / F.lit(86_400_000_000)))
    out = F.when(published.isNull(), dec(UNDATED))
    for limit, score in RECENCY:
        out = out.when(days <= limit, dec(score))
    return out.otherwise(dec(OLDER))


def feed_date(text: Column) -> Column:
    """The local time of an RFC-2822 date, its zone left out; null if it isn't one."""
    local = F.regexp_extract(text, r"^\s*(?:[A-Za-z]{3},\s*)?(\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2})", 1)
    return F.try_to_timestamp(local, F.lit("d MMM yyyy HH:mm:ss"))


def trust_or_default(trust: Column) -> Column:
    """An unknown trust, and one of 0, count as a half."""
    return F.when(trust.isNull() | (trust == 0), dec("0.5")).otherwise(dec(trust))


def confidence(trust: Column, recent: Column, strength: Column, source_type: Column, pack: Pack) -> Column:
    bonus = F
    for kind, value in pack.source_bonus.items():
        bonus = bonus.when(source_type == kind, dec(value))
    bonus = bonus.otherwise(dec("0"))
    total = dec("0.40") * clamp(trust) + dec("0.25") * recent + dec("0.25") * clamp(strength) + bonus
    return F.round(clamp(total), 3)


def impact(topic: Column, kind: Column, lowered: Column | Walked, pack: Pack) -> Column:
    base = F
    for name, value in pack.impact_base.items():
        base = base.when(topic == name, dec(value))
    base = base.otherwise(dec(pack.impact_default))
    extra = F.when(kind.isin("opportunity", "risk"), dec("0.03")).otherwise(dec("0"))
    return F.round(clamp(base + dec("0.02") * count_terms(lowered, pack.impact_terms) + extra), 3)


def urgency(lowered: Column | Walked, recent: Column, pack: Pack) -> Column:
    return F.round(clamp(dec("0.45") + dec("0.04") * count_terms(lowered, pack.urgency_terms) + dec("0.20") * recent), 3)


def evidence_strength(conf: Column, imp: Column, urg: Column) -> Column:
    return F.round(dec("0.45") * dec(conf) + dec("0.35") * dec(imp) + dec("0.20") * dec(urg), 3)


def partner_relevance(mentions: Column) -> Column:
    return F.least(dec("1"), dec("0.55") + dec("0.07") * mentions)


def band(confidence_score: Column) -> Column:
    return F.when(confidence_score >= 0.75, "High").when(confidence_score >= 0.50, "Medium").otherwise("Low")


def needs_guardrail(evidence: Column, confidence_score: Column) -> Column:
    return (evidence < 2) | (confidence_score < 0.45)
