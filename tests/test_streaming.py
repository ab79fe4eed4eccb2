"""Streams of landed documents: repeated, late and restarted batches."""

import pytest
from pyspark.sql import functions as F

from stratalens.streaming import ingest

SCHEMA = "seq long, url string, text string, collected_at string"


@pytest.fixture
def stream(spark, tmp_path):
    landed, store, point = (str(tmp_path / x) for x in ("landed", "store", "point"))

    def land(*rows):
        frame = spark.createDataFrame(list(rows), SCHEMA).withColumn("collected_at", F.to_timestamp("collected_at"))
        frame.coalesce(1).write.mode("append").parquet(landed)

    def run(**kw):
        ingest.ingest(spark, landed, store, point, **kw).awaitTermination()
        return sorted(r["seq"] for r in ingest.ingested(spark, store).collect())

    land.folder, land.store = landed, store
    return land, run


DAY = "2024-01-{:02d} 00:00:00"


def test_of_equal_texts_or_urls_the_first_stays(stream):
    land, run = stream
    land((1, "u1", "same text", DAY.format(1)), (2, "u2", "same  text", DAY.format(1)), (3, "u1", "other", DAY.format(1)))
    assert run() == [1]
    land((4, "u9", "new text", DAY.format(2)), (5, "u1", "yet another", DAY.format(2)), (6, "u10", "SAME text", DAY.format(2)), (7, None, "no address", DAY.format(2)), (8, None, "none again", DAY.format(2)))
    assert run() == [1, 4, 7, 8]
    assert run() == [1, 4, 7, 8]  # nothing has landed


def test_repeated_and_late_rows(stream):
    land, run = stream
    land((1, "u1", "one", DAY.format(10)))
    assert run() == [1]
    land((1, "u1", "one", DAY.format(10)), (2, "u2", "two", DAY.format(10)))  # delivered again, beside a new one
    assert run() == [1, 2]
    land((3, "u3", "three", DAY.format(20)))  # now the watermark is the 19th
    run()
    land((4, "u4", "four", DAY.format(12)), (5, "u5", "five", DAY.format(20)))
    assert run() == [1, 2, 3, 5]


def test_a_batch_that_failed_half_way_is_made_anew(stream, monkeypatch):
    land, run = stream
    land((1, "u1", "one", DAY.format(1)), (2, "u2", "two", DAY.format(1)))
    keys, calls = ingest._keys, []

    def fails(rows):
        calls.append(1)
        if len(calls) == 1:  # documents are written, keys aren't
            raise RuntimeError("lost")
        return keys(rows)

    monkeypatch.setattr(ingest, "_keys", fails)
    with pytest.raises(Exception, match="lost"):
        run()
    assert run() == [1, 2]
    land((3, "u1", "three", DAY.format(1)), (4, "u4", "four", DAY.format(1)))
    assert run() == [1, 2, 4]


def test_only_the_folders_of_a_batchs_keys_are_read(spark, stream):
    land, run = stream
    land(*[(i, f"u{i}", f"text {i}", DAY.format(1)) for i in range(200)])
    assert run() == list(range(200))
    batch = spark.createDataFrame([("u7", "-")], "url string, content_hash string")
    known = ingest.known_keys(spark, land.store, batch, 99)
    files = known._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in files and "bucket" in files
    assert 0 < known.count() < 60  # of 400 keys
    assert [r["url"] for r in known.filter("url = 'u7'").collect()] == ["u7"]
    assert ingest.known_keys(spark, land.store, batch, 0).count() == 0


def test_arrivals_come_once_their_window_is_over(spark, stream, tmp_path):
    land, _ = stream
    land((1, "a", "x", "2024-01-01 00:10:00"), (2, "b", "x", "2024-01-01 00:20:00"), (3, "c", "y", "2024-01-01 01:10:00"))
    land((4, "d", "z", "2024-01-01 05:00:00"))
    rows = ingest.arrivals(ingest.landed(spark, land.folder, 1))
    rows.writeStream.format("memory").queryName("arrivals").option("checkpointLocation", str(tmp_path / "p")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert sorted((str(r["start"]), r["documents"], r["texts"]) for r in spark.table("arrivals").collect()) == [("2024-01-01 00:00:00", 2, 1), ("2024-01-01 01:00:00", 1, 1)]
