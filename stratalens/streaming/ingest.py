"""Incremental ingestion of landed documents (an addition: batches work without it)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import clean, content_hash
from ..operators.dedup import admit
from ..session import stored

LANDED = "seq long, url string, text string, collected_at timestamp"
#: Folders that the keys of a batch are dealt into, so that a later batch reads only those of its own keys.
BUCKETS = 64
KEYS = "kind string, key string, batch long, bucket int"


def landed(spark: SparkSession, folder: str, files: int | None = None) -> DataFrame:
    """Documents landed as Parquet, cleaned and hashed; ``files`` bounds what one batch takes."""
    source = spark.readStream.schema(LANDED)
    rows = (source.option("maxFilesPerTrigger", files) if files else source).parquet(folder)
    return rows.withColumns({"clean_text": clean(F.col("text")), "content_hash": content_hash(F.col("text"))}).drop("text")


def delivered_once(rows: DataFrame, delay: str) -> DataFrame:
    """Each row once, however often it is delivered within ``delay``; rows later than that are refused.

    The state holds the ids of the rows within the delay, not of all time.
    """
    return rows.withWatermark("collected_at", delay).dropDuplicatesWithinWatermark(["seq"])


def _bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _keys(rows: DataFrame) -> DataFrame:
    pairs = F.array(F.struct(F.lit("url").alias("kind"), F.col("url").alias("key")), F.struct(F.lit("hash").alias("kind"), F.col("content_hash").alias("key")))
    return rows.select(F.explode(pairs).alias("k")).select("k.*").filter("key is not null").withColumn("bucket", _bucket(F.col("key")))


def known_keys(spark: SparkSession, store: str, batch: DataFrame, before: int) -> DataFrame:
    """(url, content_hash) that batches before this one have stored, from the folders that this one's keys fall into."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/keys")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "url string, content_hash string")
    wanted = [r["bucket"] for r in _keys(batch).select("bucket").distinct().collect()]  # BUCKETS numbers at most
    rows = spark.read.schema(KEYS).parquet(f"{store}/keys").filter((F.col("batch") < before) & F.col("bucket").isin(wanted))
    own = lambda kind: F.when(F.col("kind") == kind, F.col("key"))
    return rows.select(own("url").alias("url"), own("hash").alias("content_hash"))


def ingest(spark: SparkSession, folder: str, store: str, checkpoint: str, delay: str = "1 day", files: int | None = None) -> StreamingQuery:
    """Append what isn't in ``store`` yet, batch by batch; of equal texts or urls in a batch the least ``seq`` stays.

    A batch is a folder of its own under ``documents`` and ``keys``: when it is run again after
    a failure it looks at earlier batches only and writes its folders anew, so it ends as
    if it had run once.  Of the stored keys only the folders that the batch's keys fall
    into are read.  A row delivered again within ``delay`` is dropped by the stream's state,
    and one that comes later than that by its watermark.
    """
    rows = delivered_once(landed(spark, folder, files), delay)

    def write(batch: DataFrame, number: int) -> None:
        new = stored(batch)
        accepted = stored(admit(new, known_keys(spark, store, new, number)))
        accepted.write.mode("overwrite").parquet(f"{store}/documents/batch={number}")
        _keys(accepted).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/keys/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingested(spark: SparkSession, store: str) -> DataFrame:
    """What has been accepted, with the number of its batch."""
    return spark.read.parquet(f"{store}/documents")


def arrivals(rows: DataFrame, delay: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Documents and distinct-text estimate of each window of arrival, given out once it can't change any more."""
    seen = rows.withWatermark("collected_at", delay).groupBy(F.window("collected_at", width).alias("w"))
    out = seen.agg(F.count("*").alias("documents"), F.approx_count_distinct("content_hash").alias("texts"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "documents", "texts")
