"""Summaries kept over batches against one pass over everything."""

from pyspark.sql import functions as F

from stratalens.functions import text
from stratalens.operators import audit, recommend, signals, summaries
from stratalens.rules import SAMPLE

AS_OF = "2024-02-15 00:00:00"


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_three_batches_equal_one_pass(spark, tmp_path):
    words = ["license and token ", "the nation is able ", " und der ung ", "contact me@x.org ", " que les ment ", "plain "]
    rows = [(i, "", words[i % 6] * (1 + i % 40), f"src{i % 9}" if i % 10 else None, ["en", "de", None][i % 3], None if i % 7 == 0 else f"u{i % 50}", [None, "0.9", "0"][i % 3]) for i in range(240)]
    docs = spark.createDataFrame(rows, "id long, title string, clean_text string, source_name string, source_type string, url string, trust string")
    docs = docs.withColumns({"trust_score": F.col("trust").cast("decimal(9,4)"), "published": F.lit("2024-01-30 00:00:00").cast("timestamp"), "topic": F.when(F.col("id") % 11 != 0, F.element_at(F.array(*map(F.lit, ("Licensing", "English", "German"))), (F.col("id") % 3 + 1).cast("int")))})
    docs = docs.withColumn("content_hash", F.when(F.col("id") % 13 != 0, text.content_hash(F.col("clean_text"))))
    path = f"file://{tmp_path}/kept"
    for n in (0, 1, 1, 2):  # the second batch runs twice
        summaries.update(path, docs.filter(F.col("id") % 3 == n), SAMPLE, AS_OF, n)
    summaries.update(path, docs.filter("false"), SAMPLE, AS_OF, 3)
    found = signals.detect(docs, SAMPLE, AS_OF)
    assert rows_of(summaries.source_type_summary(spark, path)) == rows_of(audit.source_type_summary(docs))
    columns = ["topic", "documents", "avg_trust", "source_types", "signals", "avg_confidence", "avg_impact"]
    assert rows_of(summaries.topic_coverage(spark, path).select(columns)) == rows_of(audit.topic_coverage(docs, found).select(columns))
    assert rows_of(summaries.data_gaps(spark, path)) == rows_of(audit.data_gaps(docs))
    best = summaries.best_signals(spark, path)
    assert rows_of(recommend.evidence(best, SAMPLE)) == rows_of(recommend.evidence(found, SAMPLE))
    assert rows_of(recommend.recommendations(best, SAMPLE)) == rows_of(recommend.recommendations(found, SAMPLE))
