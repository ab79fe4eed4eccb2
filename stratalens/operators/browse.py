"""Substring search by an index of trigrams, for stored corpora that are searched again and again.

A text's postings are its distinct trigrams, in lower case.  A document that holds a keyword
holds all its trigrams, so the postings of the rarest few leave the only documents that
are read and looked through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of postings, by hash of the trigram, and folders of documents, by id.
BUCKETS = 32
#: Trigrams of a keyword whose postings are met with one another.
RAREST = 6
#: Candidates above which a search reads all folders of documents rather than naming some.
NAMED_FOLDERS = 16


def _lowered() -> Column:
    return F.lower(F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("clean_text", F.lit(""))))


def _bucket(x: Column) -> Column:
    return F.pmod(F.xxhash64(x), F.lit(BUCKETS)).cast("int")


def build(docs: DataFrame, path: str) -> None:
    """Store documents (id, title, clean_text, topic) and their postings (trigram, id), each in folders.

    Null titles and texts are empty; a text of under three characters has no postings.
    A trigram of every document has its postings dealt into files of bounded size.
    """
    rows = docs.select("id", "title", "clean_text", "topic").withColumn("folder", _bucket(F.col("id")))
    rows.repartition("folder").write.partitionBy("folder").parquet(f"{path}/documents")
    rows = docs.sparkSession.read.parquet(f"{path}/documents").select("id", _lowered().alias("low"))
    grams = F.array_distinct(F.regexp_extract_all("low", F.lit("(?s)(?=(...))"), F.lit(1)))  # overlapping, in one walk
    postings = rows.select("id", F.explode(grams).alias("gram")).withColumn("bucket", _bucket(F.col("gram")))
    postings = postings.repartition("bucket", F.pmod("id", F.lit(8))).sortWithinPartitions("bucket", "gram", "id")
    postings.write.partitionBy("bucket").option("maxRecordsPerFile", 20_000_000).parquet(f"{path}/postings")
    counts = docs.sparkSession.read.parquet(f"{path}/postings").groupBy("bucket", "gram").agg(F.count("*").alias("n"))
    counts.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/counts")


def candidates(spark: SparkSession, path: str, query: str) -> DataFrame | None:
    """Ids of the documents that hold the keyword's rarest trigrams; None where the keyword has no trigram."""
    low = query.lower()
    grams = sorted({low[i : i + 3] for i in range(len(low) - 2)})
    if not grams:
        return None
    hashed = spark.createDataFrame([(g,) for g in grams], "gram string").select("gram", _bucket(F.col("gram")).alias("bucket")).collect()  # a keyword's few
    bucket = {r["gram"]: r["bucket"] for r in hashed}
    held = spark.read.parquet(f"{path}/counts").filter(F.col("bucket").isin([*set(bucket.values())]) & F.col("gram").isin(grams)).collect()
    rarest = sorted(((r["n"], r["gram"]) for r in held))[:RAREST]
    if len(held) < len(grams):
        return spark.createDataFrame([], "id long")  # a trigram that no document has
    wanted = [g for _, g in rarest]
    postings = spark.read.parquet(f"{path}/postings").filter(F.col("bucket").isin([*{bucket[g] for g in wanted}]) & F.col("gram").isin(wanted))
    return postings.groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") == len(wanted)).select("id")


def search(spark: SparkSession, path: str, query: str, topic: str | None = None, limit: int = 100) -> DataFrame:
    """The first documents by id with a literal keyword in title or text, whatever the case: as a scan finds them.

    Keywords of under three characters are looked for in all documents.  Only folders
    that hold candidates are read, if they are few.
    """
    docs = spark.read.parquet(f"{path}/documents")
    found = candidates(spark, path, query)
    if found is not None:
        folders = [r["folder"] for r in found.select(_bucket(F.col("id")).alias("folder")).distinct().collect()]  # BUCKETS numbers at most
        if len(folders) <= NAMED_FOLDERS:
            docs = docs.filter(F.col("folder").isin(folders))
        docs = docs.join(found, "id", "left_semi")
    has = lambda c: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(query.lower()))
    hits = docs.filter(has("title") | has("clean_text"))
    if topic:
        hits = hits.filter(F.col("topic") == topic)
    return hits.drop("folder").orderBy("id").limit(limit)


def new_path(folder: str) -> str:
    return f"{folder}/trigrams-{uuid.uuid4().hex}"
