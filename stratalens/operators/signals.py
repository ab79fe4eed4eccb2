"""Chunks and signals of documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels, scores, text
from ..functions.terms import Walked
from ..rules.pack import Pack
from ..session import stored


def chunk_documents(docs: DataFrame, min_chars: int = 40) -> DataFrame:
    """(document_id, chunk_index, chunk_text, token_count); short chunks go but keep their index."""
    eligible = docs.filter(F.length("clean_text") > 50)
    out = eligible.select(F.col("id").alias("document_id"), F.posexplode(text.chunks(F.col("clean_text"))).alias("chunk_index", "chunk_text"))
    return out.filter(F.length("chunk_text") >= min_chars).withColumn("token_count", text.token_count(F.col("chunk_text")))


def chunk_count(clean_text: Column, min_chars: int = 40) -> Column:
    """How many chunks ``chunk_documents`` makes of a text."""
    kept = F.filter(text.chunks(clean_text), lambda c: F.length(c) >= min_chars)
    return F.when(F.length(clean_text) > 50, F.size(kept)).otherwise(0)


def dense_ids(rows: DataFrame, name: str = "faiss_id", order: Sequence[str] = ("document_id", "chunk_index"), first: int = 0) -> DataFrame:
    """Number rows gaplessly in an order, from ``first``.

    Rows are dealt into sorted ranges of about equal size and stored; a row's number
    within its range is in its partition's running id, and only the few ranges' counts
    are summed in one place.
    """
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranges = stored(ranges.withColumn("_id", F.monotonically_increasing_id()))
    place, within = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = ranges.groupBy(place.alias("_range")).agg(F.count("*").alias("_n"))
    starts = counts.select("_range", (F.lit(first) + F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_start"))
    numbered = ranges.withColumn("_range", place).join(F.broadcast(starts), "_range")  # a row per partition
    return numbered.withColumn(name, F.col("_start") + within).drop("_range", "_start", "_id")


def detect(docs: DataFrame, pack: Pack, as_of: str) -> DataFrame:
    """One row per document and matching signal rule, with its scores.

    ``docs`` has id, title, clean_text, topic, trust_score, source_type and
    published (timestamp).  One walk over a text finds the terms of all rules, names and
    scores; rules are tested in one projection and the matches exploded: no join is needed.
    """
    whole = F.concat_ws(". ", F.coalesce("title", F.lit("")), F.coalesce("clean_text", F.lit("")))
    rows = docs.filter(F.length("clean_text") > 40).withColumn("whole", whole)
    rows = rows.withColumns(
        {
            "terms": pack.terms.walk(F.lower("whole")),
            "line": text.flat(F.col("whole")),
            "topic": F.coalesce("topic", F.lit(pack.default_topic)),
            "source_type": F.coalesce("source_type", F.lit("unknown")),
            "trust": scores.trust_or_default(F.col("trust_score")),
            "recent": scores.recency(F.col("published"), F.lit(as_of).cast("timestamp")),
        }
    )
    rows = rows.withColumn("line_low", F.lower("line"))  # prepared once, read by every rule
    held = Walked(F.col("terms"), pack.terms)
    matches = []
    for ord_, rule in enumerate(pack.signals):
        hit = F.col("topic").isin(list(rule.topics)) | text.contains_any(held, rule.keywords)
        found = F.struct(
            F.lit(ord_).alias("rule"),
            F.lit(rule.kind).alias("signal_type"),
            F.lit(rule.title).alias("title"),
            F.lit(rule.description or rule.title).alias("description"),
            scores.dec(rule.strength).alias("strength"),
            text.snippet_of(F.col("line"), F.col("line_low"), rule.keywords).alias("evidence_text"),
        )
        matches.append(F.when(hit, found))
    rows = rows.withColumn("m", F.explode(F.array_compact(F.array(*matches))))
    return rows.select(
        F.col("id").alias("document_id"),
        "m.rule",
        "m.signal_type",
        "topic",
        "m.title",
        "m.description",
        labels.entities(held, pack.entities).alias("entities"),
        scores.impact(F.col("topic"), F.col("m.signal_type"), held, pack).alias("impact_score"),
        scores.urgency(held, F.col("recent"), pack).alias("urgency_score"),
        scores.confidence(F.col("trust"), F.col("recent"), F.col("m.strength"), F.col("source_type"), pack).alias("confidence_score"),
        "m.evidence_text",
        *[c for c in ("source_name",) if c in docs.columns],
    )
