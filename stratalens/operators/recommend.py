"""Recommendations rolled up from signals, with their evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import labels, scores
from ..rules.pack import Pack
from ..sources.store import Generation
from .dedup import top_per

#: Signals a recommendation is scored on, those kept as evidence, and the fewest it needs.
TOP_SIGNALS, EVIDENCE, MIN_SIGNALS = 14, 8, 2


def blueprint_rows(spark: SparkSession, pack: Pack) -> DataFrame:
    rows = [(i, b.title, b.priority, s) for i, b in enumerate(pack.blueprints) for s in b.signals]
    return spark.createDataFrame(rows, "recommendation_id int, recommendation string, priority string, title string")


def supporting(signals: DataFrame, pack: Pack) -> DataFrame:
    """The best signals of each blueprint: by confidence, impact and urgency, then document and rule.

    A signal may serve several blueprints.  Blueprints are a fixed few rows.
    """
    joined = signals.join(F.broadcast(blueprint_rows(signals.sparkSession, pack)), "title")
    order = [F.desc("confidence_score"), F.desc("impact_score"), F.desc("urgency_score"), F.asc("document_id"), F.asc("rule")]
    return top_per(joined, "recommendation_id", TOP_SIGNALS, *order)


def score_recommendation(distinct_source: Column, distinct_topic: Column) -> Column:
    """From mean confidence and impact and the breadth of sources and topics."""
    total = (
        scores.dec("0.35") * F.avg("confidence_score")
        + scores.dec("0.25") * F.avg("impact_score")
        + scores.dec("0.25") * F.least(distinct_source / F.lit(5).cast("decimal(9,4)"), scores.dec("1"))
        + scores.dec("0.15") * F.least(distinct_topic / F.lit(4).cast("decimal(9,4)"), scores.dec("1"))
    )
    return F.least(total, F.lit(1.0))


def recommendations(signals: DataFrame, pack: Pack) -> DataFrame:
    """One row per blueprint with two signals or more, in order of priority and confidence."""
    known = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown"))
    rows = supporting(signals, pack).groupBy("recommendation_id", "recommendation", "priority").agg(
        F.count("*").alias("evidence_count"),
        F.round(score_recommendation(F.countDistinct(known("source_name")), F.countDistinct(known("topic"))), 3).cast("double").alias("confidence_score"),
    )
    return rows.filter(F.col("evidence_count") >= MIN_SIGNALS).orderBy(labels.priority_rank(F.col("priority")), F.desc("confidence_score"), "recommendation_id")


def evidence(signals: DataFrame, pack: Pack) -> DataFrame:
    """The first signals of each recommendation as evidence rows; chunk_id is never set."""
    rows = supporting(signals, pack).withColumn("_n", F.count("*").over(Window.partitionBy("recommendation_id")))
    strength = scores.evidence_strength(F.col("confidence_score"), F.col("impact_score"), F.col("urgency_score"))
    out = rows.filter((F.col("rank") <= EVIDENCE) & (F.col("_n") >= MIN_SIGNALS))
    return out.select("recommendation_id", "rank", "document_id", F.lit(None).cast("long").alias("chunk_id"), strength.cast("double").alias("evidence_strength"))


def store(tables: Generation, recs: DataFrame, evidence_rows: DataFrame, batch: str) -> None:
    """Append recommendations and their evidence under a batch's name; evidence then names its recommendation by the stored id.

    A recommendation's title stands for its text too where there is none.  Run again,
    it adds nothing; a recommendation that is stored already keeps its id.
    """
    titled = recs.withColumn("title", F.col("recommendation"))
    ids = tables.append("recommendations", titled, batch)
    numbers = titled.select("recommendation_id", "title").join(ids, "title").select("recommendation_id", "id")
    tables.append("recommendation_evidence", evidence_rows, batch, {"recommendation_id": numbers})


def top_evidence(evidence_rows: DataFrame, n: int = 5) -> DataFrame:
    """The strongest evidence of each recommendation."""
    return top_per(evidence_rows.withColumnRenamed("rank", "signal_rank"), "recommendation_id", n, F.desc("evidence_strength"), "signal_rank")


def unsupported(recs: DataFrame, evidence_rows: DataFrame) -> DataFrame:
    """Evidence links of every recommendation, 0 where there are none."""
    links = evidence_rows.groupBy("recommendation_id").agg(F.count("document_id").alias("links"))
    return recs.join(links, "recommendation_id", "left").withColumn("links", F.coalesce("links", F.lit(0)))


def related(recs: DataFrame, topic: str | None, question: str, limit: int = 6) -> DataFrame:
    """Recommendations that share words with a question; all of them if none does.

    Three points for the topic, one for each word of five characters or more
    (repeated words count again).  ``recs`` has title, recommendation, priority,
    confidence_score and recommendation_id.
    """
    from ..functions.text import blob

    low = blob([F.col(c) for c in ("title", "recommendation", "expected_impact", "risk_assessment") if c in recs.columns])
    score = F.lit(0)
    if topic:
        score = score + F.contains(low, F.lit(topic.lower())).cast("int") * 3
    for word in question.lower().split():
        if len(word) >= 5:
            score = score + F.contains(low, F.lit(word)).cast("int")
    # recommendations are a pack's few: the window over all of them reads them once
    ranked = recs.withColumn("match", score).withColumn("best", F.max("match").over(Window.partitionBy(F.lit(0))))
    ranked = ranked.filter((F.col("match") > 0) | (F.col("best") == 0)).drop("best")
    return ranked.orderBy(F.desc("match"), F.desc("confidence_score"), labels.priority_rank(F.col("priority")), "recommendation_id").limit(limit)
