"""Documents, signals and evidence with their sources.

The ``sources`` table grows slowly, so joins leave it to Spark's size threshold whether
it is broadcast.  A document without a source row keeps null source columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dedup import top_per


def with_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Add ``source_name`` by ``source_id``: a left join."""
    return rows.join(sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name")), "source_id", "left")


def signals_with_sources(signals: DataFrame, docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Signals with document and source columns, null where a document or source row is missing."""
    about = docs.select(F.col("id").alias("document_id"), F.col("title").alias("document_title"), "url", "source_type", "source_id")
    return with_source(signals.join(about, "document_id", "left"), sources)


def supporting_signals(signals: DataFrame, docs: DataFrame, sources: DataFrame, titles: list[str], n: int = 14) -> DataFrame:
    """The best ``n`` signals of some titles, each with its document (which must be there) and source."""
    about = docs.select(F.col("id").alias("document_id"), "url", "source_type", "source_id")
    order = [*map(F.desc, ("confidence_score", "impact_score", "urgency_score")), "document_id", "rule"]
    best = signals.filter(F.col("title").isin(titles)).join(about, "document_id")
    return with_source(best.orderBy(*order).limit(n), sources)


def evidence_explorer(evidence: DataFrame, recs: DataFrame, docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Evidence rows with recommendation, document and source."""
    about = docs.select(F.col("id").alias("document_id"), F.col("title").alias("document_title"), "url", "topic", "source_type", "source_id")
    named = recs.select("recommendation_id", F.col("recommendation").alias("recommendation_title"))
    return with_source(evidence.join(named, "recommendation_id").join(about, "document_id"), sources)


def top_evidence_documents(evidence: DataFrame, docs: DataFrame, sources: DataFrame, n: int = 5) -> DataFrame:
    """The strongest evidence of each recommendation with its document and source."""
    about = docs.select(F.col("id").alias("document_id"), "url", "topic", "source_id")
    best = top_per(evidence.withColumnRenamed("rank", "signal_rank").join(about, "document_id"), "recommendation_id", n, F.desc("evidence_strength"), "signal_rank")
    return with_source(best, sources)


def largest_sources(docs: DataFrame, sources: DataFrame, n: int = 12) -> DataFrame:
    """Sources by their documents: counted by id first, then named."""
    counts = docs.groupBy("source_id").agg(F.count("*").alias("documents"))
    return counts.join(sources.select(F.col("id").alias("source_id"), "name"), "source_id").groupBy("name").agg(F.sum("documents").alias("documents")).orderBy(F.desc("documents"), "name").limit(n)


def source_audit(sources: DataFrame) -> DataFrame:
    """Sources by trust, the most trusted first and unknown trust last."""
    return sources.orderBy(F.desc_nulls_last("trust_score"), "name")


def latest_update(docs: DataFrame, column: str = "collected_at") -> DataFrame:
    """The last time of collection, to the second; null without any."""
    return docs.agg(iso(F.max(F.col(column).cast("timestamp"))).alias("latest_update"))


def iso(time: Column) -> Column:
    """A time as text, to the second."""
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss")


def by_id(rows: DataFrame, value: int, column: str = "id") -> DataFrame:
    return rows.filter(F.col(column) == value)
