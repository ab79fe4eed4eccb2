"""Summaries of a growing corpus, kept batch by batch and merged when they are read.

A batch leaves three small tables of its own: counts and sums by topic, source type and
source; counts and sums of its signals, with the best few of each title; and the
digests of its texts that no earlier batch has.  Sums of sums are exact decimals, the
best of the best are the best, and key sets are merged by adding what is new.  So
merging any batches gives what one pass over all their documents gives, and reads no text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores
from ..rules.pack import Pack
from ..session import stored
from . import audit, recommend
from .dedup import top_per
from .signals import chunk_count, detect

#: Folders of digests, so that a batch reads only those of its own.
BUCKETS = 64
RANKED = ("confidence_score", "impact_score", "urgency_score")


def _read(spark: SparkSession, path: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{table}")


def _batches(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/texts")
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def update(path: str, docs: DataFrame, pack: Pack, as_of: str, batch: int) -> None:
    """Add a batch of documents (as ``detect`` takes them, with url and content_hash) under its number.

    Batches come in order of their numbers; one that is run again writes its tables
    anew and ends as before.  A document belongs to one batch.
    """
    spark = docs.sparkSession
    docs = stored(docs)
    found = stored(detect(docs, pack, as_of).drop("evidence_text", "entities"))
    digests = docs.select(F.coalesce("content_hash", F.lit("")).alias("digest")).distinct().withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(BUCKETS)).cast("int"))
    if _batches(spark, path):
        wanted = [r["bucket"] for r in digests.select("bucket").distinct().collect()]  # BUCKETS numbers at most
        digests = digests.join(_read(spark, path, "texts").filter((F.col("batch") < batch) & F.col("bucket").isin(wanted)).select("digest"), "digest", "left_anti")
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    trust = F.col("trust_score").cast("decimal(9,4)")
    cells = docs.groupBy("topic", "source_type", "source_name").agg(
        F.count("*").alias("documents"), F.count("id").alias("ids"), F.sum(trust).alias("trust_sum"), F.count(trust).alias("trust_n"),
        F.sum(F.coalesce(trust, scores.dec("0.5"))).alias("trust_filled"), (F.count_if(F.col("url").isNull()) + F.count_if(empty("url"))).alias("without_url"),
        (F.count_if(F.col("topic").isNull()) + F.count_if(empty("topic"))).alias("without_topic"), F.count_if(F.length(F.coalesce("clean_text", F.lit(""))) < 250).alias("short_text"),
        F.sum(chunk_count(F.coalesce("clean_text", F.lit("")))).alias("chunks"),
    )
    tallies = found.groupBy("topic", "signal_type", "title").agg(F.count("*").alias("signals"), *[F.sum(F.col(c).cast("decimal(9,4)")).alias(c) for c in RANKED])
    best = top_per(found, "title", recommend.TOP_SIGNALS, *map(F.desc, RANKED), "document_id", "rule").drop("rank")
    for name, rows in (("cells", cells), ("signals", tallies), ("best", best)):
        rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")
    digests.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/texts/batch={batch}")


def _mean(total: str, count: str):
    """As ``audit.mean`` has it, from sums."""
    return F.round(F.sum(total).cast("double") / F.nullif(F.sum(count), F.lit(0)), 6)


def source_type_summary(spark: SparkSession, path: str) -> DataFrame:
    rows = _read(spark, path, "cells").filter("source_type is not null").groupBy("source_type")
    return rows.agg(F.sum("ids").alias("documents"), _mean("trust_sum", "trust_n").alias("avg_trust"), F.countDistinct("source_name").alias("sources"))


def topic_coverage(spark: SparkSession, path: str) -> DataFrame:
    left = _read(spark, path, "cells").filter("topic is not null").groupBy("topic").agg(
        F.sum("ids").alias("documents"), _mean("trust_sum", "trust_n").alias("avg_trust"), F.array_join(F.array_sort(F.collect_set("source_type")), ", ").alias("source_types")
    )
    right = _read(spark, path, "signals").filter("topic is not null").groupBy("topic").agg(
        F.sum("signals").alias("signals"), _mean("confidence_score", "signals").alias("avg_confidence"), _mean("impact_score", "signals").alias("avg_impact")
    )
    return left.join(right, "topic", "left").na.fill(0, ["signals", "avg_confidence", "avg_impact"])


def data_gaps(spark: SparkSession, path: str) -> DataFrame:
    some = lambda c: F.coalesce(F.sum(c), F.lit(0))
    sums = _read(spark, path, "cells").agg(
        *[some(c).alias(c) for c in ("without_url", "without_topic", "short_text")], (some("documents") - some("trust_n")).alias("without_trust"), some("documents").alias("documents")
    )
    texts = _read(spark, path, "texts").agg(F.count("*").alias("texts"))
    return audit.one_row(sums, texts).select("without_url", "without_topic", "short_text", "without_trust", (F.col("documents") - F.col("texts")).alias("duplicates"))


def best_signals(spark: SparkSession, path: str) -> DataFrame:
    """The best signals of each title so far: enough for every recommendation and its evidence."""
    return _read(spark, path, "best").drop("batch")


def quality_scorecard(spark: SparkSession, path: str, pack: Pack, recs: DataFrame) -> DataFrame:
    """The scorecard from what is kept; ``recs`` are the pack's recommendations by id."""
    docs = _read(spark, path, "cells").agg(
        F.sum("documents").alias("documents"), F.countDistinct("source_name").alias("sources"), F.sum("chunks").alias("chunks"),
        (F.sum("trust_filled") / F.sum("documents")).cast("double").alias("trust"), F.count_distinct(F.coalesce("topic", F.lit("Unknown"))).alias("topics"),
    )
    links = recommend.unsupported(recs, recommend.evidence(best_signals(spark, path), pack))
    return audit.quality_scorecard(audit.one_row(
        docs, _read(spark, path, "signals").agg(F.coalesce(F.sum("signals"), F.lit(0)).alias("signals")), links.agg(F.sum("links").alias("evidence"), F.count("*").alias("recommendations"))
    ))
