"""Exact vector search."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from .dedup import top_per
from .signals import dense_ids


def inner_product(vector: Column, query: Sequence[float]) -> Column:
    """In doubles; null for vectors of another length or with a null."""
    other = F.array(*[F.lit(float(x)) for x in query])
    product = F.aggregate(F.zip_with(vector, other, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(vector) == len(query), product)


def overfetch(k: int) -> int:
    return max(5 * k, 25)


def search(vectors: DataFrame, query: Sequence[float], k: int = 8, where: Column | None = None, min_score: float | None = None, key: str = "vec_id") -> DataFrame:
    """The ``k`` nearest by inner product, ties by key, with ``rank`` from 1.

    Filters apply to the over-fetched candidates, so fewer than ``k`` may be left.
    """
    scored = vectors.withColumn("score", inner_product(F.col("embedding"), query)).filter("score is not null")
    found = scored.drop("embedding").orderBy(F.desc("score"), key).limit(overfetch(k))
    if where is not None:
        found = found.filter(where)
    found = found.orderBy(F.desc("score"), key).limit(k)
    return found.filter(F.col("score") >= min_score) if min_score is not None else found


VECTORS = "vec_id long, embedding array<float>"


def load_vectors(spark: SparkSession, path: str, schema: str = VECTORS) -> DataFrame:
    """A stored vector table; no rows where there is none, so that nothing is found in it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def with_metadata(hits: DataFrame, chunks: DataFrame, docs: DataFrame, key: str = "vec_id") -> DataFrame:
    """Hits with the chunk they stand for (its ``faiss_id`` is the hit's key) and its document's columns.

    Hits are a few rows for each question: they are what is broadcast, if anything.
    """
    about = docs.select(F.col("id").alias("document_id"), "title", "url", "topic", "source_type", "source_name")
    return hits.join(chunks.select(F.col("faiss_id").alias(key), "document_id", "chunk_index", "chunk_text"), key).join(about, "document_id")


def retrieve(vectors: DataFrame, chunks: DataFrame, docs: DataFrame, query: Sequence[float], k: int = 8, topic: str | None = None, source_type: str | None = None) -> DataFrame:
    """The ``k`` best chunks of some topic and type among the over-fetched candidates."""
    found = with_metadata(search(vectors, query, overfetch(k)), chunks, docs)
    for column, value in (("topic", topic), ("source_type", source_type)):
        if value:
            found = found.filter(F.col(column) == value)
    return found.orderBy(F.desc("score"), "vec_id").limit(k)


def probe(vectors: DataFrame, chunks: DataFrame, docs: DataFrame, probes: Sequence[tuple[Sequence[float], Sequence[str]]], k: int = 5) -> DataFrame:
    """How each probe (a vector and expected terms) fares: results, mean score, terms found, passed.

    All probes are scored in one scan of the vectors; a window keeps each one's best
    before the shuffle.
    """
    scored = F.array(*[F.struct(F.lit(i).alias("probe"), inner_product(F.col("embedding"), q).alias("score")) for i, (q, _) in enumerate(probes)])
    rows = vectors.select("vec_id", F.explode(scored).alias("s")).select("vec_id", "s.*").filter("score is not null")
    best = with_metadata(top_per(rows, "probe", k, F.desc("score"), "vec_id"), chunks, docs)
    low = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), "chunk_text"))
    rows = vectors.sparkSession.createDataFrame([(i, list(terms)) for i, (_, terms) in enumerate(probes)], "probe int, terms array<string>")
    hits = best.join(F.broadcast(rows), "probe").withColumn("found", F.filter("terms", lambda t: F.contains(low, F.lower(t))))
    each = hits.groupBy("probe").agg(F.count("*").alias("results"), F.round(F.avg("score"), 3).alias("mean_score"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))).alias("found"))
    out = rows.select("probe").join(each, "probe", "left")
    return out.select(
        "probe", F.coalesce("results", F.lit(0)).alias("results"), F.coalesce("mean_score", F.lit(0.0)).alias("mean_score"),
        F.coalesce(F.array_join("found", ", "), F.lit("")).alias("matched"), (F.coalesce(F.size("found"), F.lit(0)) > 0).alias("passed"),
    )


#: Queries of one scan: their matrix, and as many heaps of k, are what a task holds beside a batch of vectors.
QUERY_BLOCK = 4096


def search_many(vectors: DataFrame, queries: DataFrame, k: int = 8, key: str = "vec_id", block: int = QUERY_BLOCK) -> DataFrame:
    """The ``k`` nearest vectors by inner product for each query (query_id, embedding): (query_id, rank, key, score), ties by key.

    Queries go in blocks, each a matrix that is sent to the tasks: a batch of vectors times
    a block is one product, of which a task keeps k for each query, so a block takes one
    scan and shuffles k rows of each query and task.  Vectors or queries of another
    length than most queries, or with a null, are near nothing; without queries or vectors there are
    no rows.  Query ids are unique.
    """
    spark = vectors.sparkSession
    usable = lambda c, n: (F.size(c) == n) & ~F.exists(c, lambda x: x.isNull())
    sizes = queries.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    empty = spark.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, rank int, `{key}` {vectors.schema[key].dataType.simpleString()}, score double")
    if sizes is None or sizes["n"] is None or sizes["n"] < 1:
        return empty
    size = sizes["n"]
    numbered = stored(dense_ids(queries.filter(usable("embedding", size)).select("query_id", "embedding"), "_n", ["query_id"]))
    rows, out = vectors.filter(usable("embedding", size)).select(F.col(key).alias("_key"), "embedding"), []
    for start in range(0, numbered.count(), block):
        part = numbered.filter(F.col("_n").between(start, start + block - 1)).orderBy("_n").toArrow()  # one block
        asked = np.array(part.column("embedding").combine_chunks().flatten(), np.float64).reshape(-1, size)
        found = rows.mapInArrow(_scan(spark.sparkContext.broadcast(asked), k), f"_q int, _key {vectors.schema[key].dataType.simpleString()}, score double")
        best = top_per(found, "_q", k, F.desc("score"), "_key")
        named = numbered.filter(F.col("_n").between(start, start + block - 1)).select((F.col("_n") - start).cast("int").alias("_q"), "query_id")
        out.append(best.join(named, "_q").select("query_id", "rank", F.col("_key").alias(key), "score"))
    return functools.reduce(DataFrame.unionByName, out) if out else empty


def _scan(asked: Broadcast, k: int):
    """What a task does with its vectors: the best k of each query so far are kept from batch to batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = asked.value
        held = None  # (keys, scores), k columns for each query
        for batch in batches:
            keys = batch.column("_key").to_numpy(zero_copy_only=False)
            x = np.asarray(batch.column("embedding").flatten(), np.float64).reshape(len(keys), -1)
            for at in range(0, len(keys), 1024):
                # einsum, as a threaded BLAS can stall beside a JVM
                scores, own = np.einsum("qd,nd->qn", q, x[at : at + 1024]), np.broadcast_to(keys[at : at + 1024], (len(q), len(keys[at : at + 1024])))
                if held is not None:
                    own, scores = np.concatenate((held[0], own), axis=1), np.concatenate((held[1], scores), axis=1)
                order = np.lexsort((own, -scores), axis=1)[:, :k]
                held = np.take_along_axis(own, order, 1), np.take_along_axis(scores, order, 1)
        if held is not None:
            number = np.repeat(np.arange(len(q), dtype=np.int32), held[0].shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(held[0].ravel()), pa.array(held[1].ravel())], ["_q", "_key", "score"])

    return run


def encode(text: Column, encoder, returns: str = "array<float>") -> Column:
    """Vectors from a pluggable encoder: a function of a list of texts that gives a list of vectors."""
    @F.pandas_udf(returns)
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(encoder(texts.fillna("").tolist())))

    return run(text)
