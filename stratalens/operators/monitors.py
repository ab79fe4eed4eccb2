"""Mentions, monitors and unit profiles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels, scores, text
from ..rules.pack import Pack, Unit
from .audit import mean


def mentions(docs: DataFrame, names: list[str]) -> DataFrame:
    """(name, mentions): documents whose title or text has each name, whatever the case, from one scan.

    A document with a null title or text mentions nothing.
    """
    low = F.lower(F.concat("title", F.lit(" "), "clean_text"))
    hits = docs.agg(*[F.count_if(F.contains(low, F.lit(n.lower()))).alias(f"m{i}") for i, n in enumerate(names)])
    rows = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(n).alias("name"), F.col(f"m{i}").alias("mentions")) for i, n in enumerate(names)])
    return hits.select(F.explode(rows).alias("r")).select("r.*")


def radar(docs: DataFrame, pack: Pack) -> DataFrame:
    band = F.when(F.col("mentions") >= 10, "High relevance").when(F.col("mentions") >= 3, "Moderate relevance").otherwise("Low current signal")
    some = docs.withColumns({"title": F.coalesce("title", F.lit("")), "clean_text": F.coalesce("clean_text", F.lit(""))})
    return mentions(some, list(pack.radar)).select(F.col("name").alias("entity"), "mentions", band.alias("reading"))


def partner_mentions(docs: DataFrame, pack: Pack, cap: int = 8) -> DataFrame:
    """Partners by relevance, ties by mentions and then the pack's order."""
    country = F.element_at(F.array(*[F.lit(c) for _, c in pack.partners]), F.col("ord") + 1)
    rows = mentions(docs, [n for n, _ in pack.partners]).withColumn("country", country)
    rows = rows.withColumn("relevance", scores.partner_relevance(F.col("mentions")).cast("double"))
    return rows.orderBy(F.desc("relevance"), F.desc("mentions"), "ord").limit(cap)


def sentiment_by_topic(docs: DataFrame, pack: Pack) -> DataFrame:
    tone = labels.sentiment(F.concat_ws(" ", "title", "clean_text"), pack.positive, pack.negative)
    return docs.filter("topic is not null").groupBy("topic", tone.alias("sentiment")).count().withColumnRenamed("count", "documents")


def monitor(signals: DataFrame, kind: str) -> DataFrame:
    rows = signals.filter((F.col("signal_type") == kind) & F.col("topic").isNotNull()).groupBy("title", "topic")
    return rows.agg(F.count("*").alias("signals"), *[mean(f"{c}_score").alias(f"avg_{c}") for c in ("confidence", "impact", "urgency")])


def alert_level(signals: DataFrame) -> DataFrame:
    """High-confidence risks and opportunities, and the alert they make."""
    sure = F.col("confidence_score") >= 0.75
    risks = F.count_if(sure & (F.col("signal_type") == "risk"))
    return signals.agg(
        F.count_if(sure & (F.col("signal_type") == "opportunity")).alias("opportunities"), risks.alias("risks"), F.when(risks >= 5, "Elevated").otherwise("Moderate").alias("alert")
    )


def find_unit(pack: Pack, name: str) -> Unit:
    for unit in pack.units:
        if unit.name == name:
            return unit
    raise ValueError(f"unknown unit: {name}")


def in_unit(unit: Unit, topic: Column, columns: list[Column]) -> Column:
    """A topic of the unit, or any of its keywords in the joined columns."""
    return F.coalesce(topic.isin(list(unit.topics)), F.lit(False)) | text.contains_any(text.blob(columns), unit.keywords)


def signal_summary(signals: DataFrame) -> DataFrame:
    return signals.groupBy("signal_type").agg(F.count("*").alias("signals"), *[mean(f"{c}_score").alias(f"avg_{c}") for c in ("confidence", "impact", "urgency")])


def source_summary(docs: DataFrame) -> DataFrame:
    return docs.filter("source_type is not null").groupBy("source_type").agg(F.count("*").alias("documents"), mean("trust_score").alias("avg_trust"))


@dataclass
class Profile:
    """A unit's lazy frames."""

    unit: Unit
    documents: DataFrame
    signals: DataFrame
    recommendations: DataFrame
    signal_summary: DataFrame
    source_summary: DataFrame

    def of_kind(self, kind: str) -> DataFrame:
        return self.signals.filter(F.col("signal_type") == kind)


def related_to_unit(recs: DataFrame, unit: Unit, columns: list[str], fallback: int = 3) -> DataFrame:
    """Recommendations that name a keyword or topic of the unit; the first few if none does."""
    hit = text.contains_any(text.blob([F.col(c) for c in columns]), [*unit.keywords, *(t.lower() for t in unit.topics)])
    order = [labels.priority_rank(F.col("priority")), F.desc("confidence_score"), F.col("recommendation_id")]
    # recommendations are a pack's few: the windows over all of them read them once
    every = Window.partitionBy(F.lit(0))
    marked = recs.withColumn("hit", F.coalesce(hit, F.lit(False))).withColumns({"some": F.max("hit").over(every), "place": F.row_number().over(every.orderBy(*order))})
    return marked.filter(F.col("hit") | (~F.col("some") & (F.col("place") <= fallback))).drop("hit", "some", "place").orderBy(*order)


def profile(pack: Pack, name: str, docs: DataFrame, signals: DataFrame, recs: DataFrame) -> Profile:
    unit = find_unit(pack, name)
    own = docs.filter(in_unit(unit, F.col("topic"), [F.col(c) for c in ("title", "clean_text", "source_name")]))
    mine = signals.filter(in_unit(unit, F.col("topic"), [F.col(c) for c in ("title", "evidence_text")]))
    return Profile(unit, own.drop("clean_text"), mine, related_to_unit(recs, unit, ["recommendation"]), signal_summary(mine), source_summary(own))


def keyword_browser(docs: DataFrame, query: str, topic: str | None = None, limit: int = 100) -> DataFrame:
    """The first documents with a literal keyword in title or text."""
    has = lambda c: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(query.lower()))
    found = docs.filter(has("title") | has("clean_text"))
    if topic:
        found = found.filter(F.col("topic") == topic)
    return found.orderBy("id").limit(limit)
