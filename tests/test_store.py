"""Tables appended to in batches and rebuilt in generations."""

import pytest
from pyspark.sql import functions as F

from stratalens.operators import recommend
from stratalens.sources.store import Store

CHUNK = "document_id long, chunk_index int, chunk_text string, token_count int"


def chunk_rows(spark, *rows):
    return spark.createDataFrame([(*r, "t", 1) for r in rows], CHUNK)


def ids(frame, *key):
    return {tuple(r[k] for k in key): r["id"] for r in frame.collect()}


def test_a_batch_is_stored_once_and_keys_keep_their_ids(spark, tmp_path):
    tables = Store(spark, f"file://{tmp_path}/s").current()
    first = tables.append("document_chunks", chunk_rows(spark, (2, 0), (1, 1), (1, 0), (1, 0)), "one")
    assert ids(first, "document_id", "chunk_index") == {(1, 0): 1, (1, 1): 2, (2, 0): 3}
    again = tables.append("document_chunks", chunk_rows(spark, (9, 9)), "one")  # the batch is known: nothing is added
    assert again.count() == 0 and tables.read("document_chunks").count() == 3
    more = tables.append("document_chunks", chunk_rows(spark, (1, 1), (0, 0), (None, 5)), "two")
    assert ids(more, "document_id", "chunk_index") == {(1, 1): 2, (None, 5): 4, (0, 0): 5}
    assert ids(tables.append("document_chunks", chunk_rows(spark, (None, 5)), "three"), "document_id", "chunk_index") == {(None, 5): 4}
    assert tables.read("document_chunks").count() == 5 and tables.batches("document_chunks") != []
    assert tables.append("document_chunks", chunk_rows(spark).filter("false"), "none").count() == 0


def test_evidence_names_stored_recommendations(spark, tmp_path):
    tables = Store(spark, f"file://{tmp_path}/s").current()
    recs = spark.createDataFrame([(0, "Zeta", "High", 0.5, 2), (1, "Alpha", "Low", 0.7, 3)], "recommendation_id int, recommendation string, priority string, confidence_score double, evidence_count long")
    links = spark.createDataFrame([(0, 1, 10, None, 0.9), (0, 2, 10, None, 0.9), (1, 1, 20, None, 0.8)], "recommendation_id int, rank int, document_id long, chunk_id long, evidence_strength double")
    for batch in ("a", "a"):
        recommend.store(tables, recs, links, batch)
    joined = tables.read("recommendation_evidence").join(tables.read("recommendations").select(F.col("id").alias("recommendation_id"), "title"), "recommendation_id")
    assert sorted((r["title"], r["document_id"], r["evidence_strength"]) for r in joined.collect()) == [("Alpha", 20, 0.8), ("Zeta", 10, 0.9), ("Zeta", 10, 0.9)]
    assert {r["created_at"] is not None for r in tables.read("recommendations").collect()} == {True}
    with pytest.raises(Exception, match="names no stored row: 5"):
        tables.append("recommendation_evidence", links.withColumn("recommendation_id", F.lit(5)), "b", {"recommendation_id": spark.createDataFrame([(0, 1)], "recommendation_id int, id long")})
    with pytest.raises(Exception, match="recommendations.title is null"):
        tables.append("recommendations", recs, "b")
    assert tables.read("recommendation_evidence").count() == 3 and tables.read("recommendations").count() == 2
    tables.clean("recommendations")
    assert tables.read("recommendations").count() == 2


def test_an_append_that_fails_leaves_nothing(spark, tmp_path):
    tables = Store(spark, f"file://{tmp_path}/s").current()
    broken = chunk_rows(spark, *[(i, 0) for i in range(50)]).withColumn("token_count", F.when(F.col("document_id") == 49, F.raise_error(F.lit("lost"))).otherwise(1).cast("int"))
    with pytest.raises(Exception, match="lost"):
        tables.append("document_chunks", broken, "one")
    assert tables.read("document_chunks").count() == 0
    assert tables.append("document_chunks", chunk_rows(spark, (4, 0)), "one").count() == 1


def test_a_failed_rebuild_leaves_the_old_tables(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.current().append("document_chunks", chunk_rows(spark, (1, 0)), "one")
    store.current().append("sources", spark.createDataFrame([("S", "news")], "name string, source_type string"), "one")
    with pytest.raises(RuntimeError), store.rebuild() as fresh:
        fresh.append("document_chunks", chunk_rows(spark, (2, 0), (3, 0)), "one")
        raise RuntimeError("half way")
    assert [r["document_id"] for r in store.current().read("document_chunks").collect()] == [1]
    with store.rebuild(keep=["sources"]) as fresh:
        fresh.append("document_chunks", chunk_rows(spark, (2, 0), (3, 0)), "one")
        assert store.current().read("document_chunks").count() == 1  # readers see the old ones until the end
    assert store.current().read("document_chunks").count() == 2 and store.current().read("sources").count() == 1
    store.reset("document_chunks")
    assert store.current().read("document_chunks").count() == 0
    store.reset("document_chunks")
    assert store.current().read("sources").first()["name"] == "S"  # kept twice over
