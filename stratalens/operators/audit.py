"""Coverage, gaps and readiness of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# The evaluation's thresholds and grade bands.
MIN_DOCUMENTS, MIN_SOURCES, MIN_RECOMMENDATIONS, MIN_EVIDENCE, MIN_SIGNALS = 100, 3, 3, 3, 50
GRADES = ((0.90, "Production-demo ready"), (0.75, "Strong prototype"), (0.60, "Needs improvement"))
LOWEST_GRADE = "Not ready"


def mean(c: str, places: int = 6) -> Column:
    return F.round(F.avg(F.col(c).cast("double")), places)


def source_type_summary(docs: DataFrame) -> DataFrame:
    """Documents, mean trust and sources of each source type; rows of no type are left out."""
    known = docs.filter("source_type is not null").groupBy("source_type")
    return known.agg(F.count("id").alias("documents"), mean("trust_score").alias("avg_trust"), F.countDistinct("source_name").alias("sources"))


def topic_coverage(docs: DataFrame, signals: DataFrame) -> DataFrame:
    """Documents and signals of each topic; topics without signals have zeros."""
    left = docs.filter("topic is not null").groupBy("topic").agg(
        F.count("id").alias("documents"), mean("trust_score").alias("avg_trust"), F.array_join(F.array_sort(F.collect_set("source_type")), ", ").alias("source_types")
    )
    right = signals.filter("topic is not null").groupBy("topic").agg(
        F.count("*").alias("signals"), mean("confidence_score").alias("avg_confidence"), mean("impact_score").alias("avg_impact")
    )
    return left.join(right, "topic", "left").na.fill(0, ["signals", "avg_confidence", "avg_impact"])


def evidence_audit(recs: DataFrame, evidence: DataFrame) -> DataFrame:
    links = evidence.groupBy("recommendation_id").agg(F.count("document_id").alias("links"), mean("evidence_strength").alias("avg_strength"))
    return recs.join(links, "recommendation_id", "left").na.fill(0, ["links", "avg_strength"])


def data_gaps(docs: DataFrame) -> DataFrame:
    """Counts of five gaps.  A null url or topic counts twice: once as missing and once as empty."""
    twice = lambda c: F.count_if(F.col(c).isNull()) + F.count_if(F.coalesce(F.col(c), F.lit("")) == "")
    return docs.agg(
        twice("url").alias("without_url"),
        twice("topic").alias("without_topic"),
        F.count_if(F.length(F.coalesce("clean_text", F.lit(""))) < 250).alias("short_text"),
        F.count_if(F.col("trust_score").isNull()).alias("without_trust"),
        (F.count("*") - F.count_distinct(F.coalesce("content_hash", F.lit("")))).alias("duplicates"),
    )


def one_row(*parts: DataFrame) -> DataFrame:
    """One-row frames side by side, as one row."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole.agg(*[F.first(c, ignorenulls=True).alias(c) for c in whole.columns])


def quality_scorecard(facts: DataFrame) -> DataFrame:
    """One row of capped ratios and their weighted total.

    ``facts`` is one row with documents, sources, chunks, signals, recommendations,
    evidence, trust (a mean) and topics.
    """
    n = F.greatest(F.col("documents"), F.lit(1))
    per_rec = F.col("evidence") / F.greatest(F.col("recommendations"), F.lit(1))
    capped = lambda x: F.least(x, F.lit(1.0))
    total = (
        0.18 * capped(F.col("sources") / 25)
        + 0.18 * capped(F.col("documents") / 100)
        + 0.14 * capped(F.col("chunks") / n)
        + 0.16 * capped(F.col("signals") / n)
        + 0.18 * capped(per_rec / 5)
        + 0.08 * capped(F.coalesce("trust", F.lit(0.5)))
        + 0.08 * capped(F.col("topics") / 8)
    )
    return facts.select(
        "documents", *[F.col(c).cast("int").alias(c) for c in ("sources", "chunks", "signals")],
        F.round(per_rec, 2).alias("evidence_per_recommendation"), F.round("trust", 3).alias("avg_trust"), "topics", F.round(total.cast("decimal(18,9)"), 3).cast("double").alias("quality_score"),
    )


def evidence_per_recommendation(evidence: Column, recs: Column) -> Column:
    return F.coalesce(F.try_divide(evidence, recs), F.lit(0.0))


def checks(counts: DataFrame) -> DataFrame:
    """(name, passed, value, threshold) of each check.

    ``counts`` is one row with documents, sources, chunks, signals,
    recommendations, evidence, unsupported, answers and weak_answers.
    """
    ratio = evidence_per_recommendation(F.col("evidence"), F.col("recommendations"))
    rows = [
        ("documents", F.col("documents"), F.lit(MIN_DOCUMENTS), ">="),
        ("sources", F.col("sources"), F.lit(MIN_SOURCES), ">="),
        ("chunks", F.col("chunks"), F.col("documents"), ">="),
        ("signals", F.col("signals"), F.lit(MIN_SIGNALS), ">="),
        ("recommendations", F.col("recommendations"), F.lit(MIN_RECOMMENDATIONS), ">="),
        ("evidence_per_recommendation", ratio, F.lit(MIN_EVIDENCE), ">="),
        ("unsupported_recommendations", F.col("unsupported"), F.lit(0), "="),
        ("answers", F.col("answers"), F.lit(1), ">="),
        ("weak_answers", F.col("weak_answers"), F.lit(0), "="),
    ]
    made = [
        F.struct(F.lit(n).alias("name"), (v.cast("double") >= t if op == ">=" else v == t).alias("passed"), v.cast("double").alias("value"), t.cast("double").alias("threshold"))
        for n, v, t, op in rows
    ]
    return counts.select(F.explode(F.array(*made)).alias("c")).select("c.*")


def grade(score: Column) -> Column:
    out = F
    for least, name in GRADES:
        out = out.when(score >= least, name)
    return out.otherwise(LOWEST_GRADE)


def evaluation_summary(check_rows: DataFrame) -> DataFrame:
    score = F.coalesce(F.try_divide(F.count_if("passed"), F.count("*")), F.lit(0.0))
    return check_rows.agg(
        F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.round(score, 3).alias("score"), grade(score).alias("grade")
    )


def readiness(flags: Column) -> Column:
    """A label from an array of eight yes-or-no checks."""
    good = F.size(F.filter(flags, lambda x: x))
    return F.when(good == F.size(flags), "Demo ready").when(good >= 6, "Mostly ready").when(good >= 4, "Needs rebuild").otherwise("Not ready")


