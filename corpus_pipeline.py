"""The corpus pipeline: documents to packed sequences in five stages.

Counted as part of ``stratalens.llm``.  Each stage takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and read again for the next one;
all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.llm import common, ngram_join, packing, phrase_index, quality, suffix_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose quality score is below the cut; the model learns from labelled rows of the given documents.

    With no labelled document at all, everything is kept.  Null and empty texts are scored
    like others, rows of one id each on its own text, and equal texts alike; an empty
    table stays empty.  Columns beyond those of documents go, whatever their names.
    """
    common.ship(spark)
    model = quality.train(docs, common.table(spark, sf_dir, "labels"))
    return quality.score_documents(docs.select(*COLUMNS), model).filter("predicted = 1").select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of every near-duplicate component.

    Rows that share that id stay together, and rows without an id stay.  Only the
    ids to drop are joined.  Null and empty texts are near nothing and stay; an empty
    table stays empty; columns beyond those of documents go.
    """
    found = ngram_join.near_duplicates(docs.select("doc_id", "text"))
    gone = common.materialise(found.filter("component_id < doc_id").select("doc_id").distinct(), "near-duplicates")
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti")


def _readable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [b.decode("utf-8", "ignore") for b in batch.column("kept").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(texts, pa.string())], ["digest", "left"])


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated 400-byte strings, and repeated passages of over 50 words, out of texts.  Every row stays, with n_chars of what is left.

    Texts without repeats, and null texts, are passed on as they are; a character
    of which a cut leaves only some bytes goes too.  Equal texts of two rows count as
    repeats of each other; an empty table stays empty; columns beyond those of documents go.
    """
    common.ship(spark)
    cut = suffix_repeats.remove_repeats(docs.select("doc_id", "text"), words=suffix_repeats.PASSAGE_WORDS).filter("n_removed > 0")
    cut = cut.select("digest", "kept").mapInArrow(_readable, "digest binary, left string")
    rows = docs.select(*COLUMNS).withColumn("digest", F.unhex(F.md5(common.text_bytes(F.col("text")))))
    out = rows.join(cut.hint("merge"), "digest", "left").withColumn("n_chars", F.when(F.col("left").isNull(), F.col("n_chars")).otherwise(F.length("left")))
    return out.withColumn("text", F.coalesce("left", "text")).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which benchmark phrases cover a twentieth of the words or more.

    Null and empty texts stay, as do rows without an id; if one of several rows of an id
    is contaminated, all of them go.  An empty table stays empty, and an empty benchmark
    drops nothing; columns beyond those of documents go.
    """
    found = phrase_index.contamination(docs.select("doc_id", "text"), common.table(spark, sf_dir, "benchmark"))
    bad = common.materialise(found.filter("contaminated").select("doc_id").distinct(), "contaminated")
    return docs.select(*COLUMNS).join(bad, "doc_id", "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all that is left into sequences of 1024 ids.

    A null or empty text is the closing id alone; equal rows, and rows of one id, are
    packed separately; an empty table gives no rows; other columns aren't read.
    """
    common.ship(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("repeats", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Fitted scores, tokenizers and cutting stock are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
