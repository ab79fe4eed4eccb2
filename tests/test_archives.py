"""Pages through archives and back."""

import json
import os

import pytest
from pyspark.sql import functions as F

from stratalens.sources import archives

ROWS = [(1, "u1", "<p>é\n </p>"), (2, None, None), (None, "u3", ""), (4, "u4", "x" * 200_000), (4, "u4", "x")]


def test_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumn("other", F.lit(1)).repartition(3)
    archives.write(pages, path)
    back = archives.read(spark, path)
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(ROWS, key=repr)
    assert back.rdd.getNumPartitions() == len(json.loads((tmp_path / "a" / "manifest.json").read_text())["archives"])
    narrow = archives.read(spark, path, "url")
    assert narrow.columns == ["url"] and sorted(r["url"] or "" for r in narrow.collect()) == ["", "u1", "u3", "u4", "u4"]
    archives.write(pages, path)
    assert archives.read(spark, path).count() == 10
    archives.write(pages.filter("page_id = 1"), path, "overwrite")
    assert archives.read(spark, path).count() == 1
    archives.write(pages.filter("false"), path, "overwrite")
    assert archives.read(spark, path).count() == 0
    with pytest.raises(Exception, match="pages have no"):
        archives.read(spark, path, "body").count()


def test_a_failed_write_shows_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    archives.write(pages, path)
    broken = spark.range(0, 40, 1, 4).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") == 39, F.raise_error(F.lit("lost"))).otherwise(F.lit("h")).cast("string").alias("html"))
    with pytest.raises(Exception, match="lost"):
        archives.write(broken, path)
    assert archives.read(spark, path).count() == len(ROWS)
    assert os.path.exists(tmp_path / "a" / "manifest.json")
