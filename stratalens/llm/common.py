"""Small helpers that several corpus operators share."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import read_table, shared_folder

#: Rows of a batch that goes to Python, where the session has the default of 10,000: texts are long.
BATCH_ROWS = 2000


def ship(spark: SparkSession) -> None:
    """Ready a session: smaller Arrow batches, and this package for executors unless PYTHONPATH has it."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    root = Path(__file__).resolve().parents[2]
    sc = spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(":") or getattr(sc, "_shipped", False):
        return
    made = Path(tempfile.mkdtemp(prefix="spark-package-")) / "corpus_operators.zip"
    with zipfile.ZipFile(made, "w") as z:
        for f in sorted((root / "stratalens").rglob("*.py")):
            z.write(f, f.relative_to(root))
    here = list(sys.path)
    sc.addPyFile(str(made))
    sys.path[:] = here
    sc._shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet into the shared folder and read it back."""
    ship(df.sparkSession)
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text, null counting as empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def ranked(df: DataFrame, group: str, order: list[str], amount: str | None = None, target: int = 20_000) -> DataFrame:
    """Add ``rank``: how many rows (or how much of ``amount``) come before each row in its group.

    A group of any size is spread over many tasks.  Rows get a hash bucket within
    their group, as many buckets as the group's size asks for; a window over the
    small table of bucket totals gives each bucket's start, and a window within a
    bucket gives the rest.  The order is fixed by the data: bucket, then ``order``.
    ``group`` must be an integer column.  Null ``order`` values sort first.
    """
    weight = F.coalesce(F.col(amount), F.lit(0)).cast("long") if amount else F.lit(1).cast("long")
    salt = F.pmod(F.xxhash64(*order), F.lit(1 << 20))
    # the finest split a group may need is found from 1024 coarse cells, counted with map-side combine
    coarse = df.groupBy(F.col(group), F.pmod(salt, F.lit(1024)).alias("_c")).agg(F.count("*").alias("_n"))
    sizes = coarse.groupBy(group).agg(F.sum("_n").alias("_n"))
    total = F.sum("_n").over(Window.partitionBy(F.lit(0)))
    sizes = sizes.withColumn("_all", total)
    goal = F.greatest(F.lit(64), F.least(F.lit(target), F.ceil(F.col("_all") / 1024)))
    sizes = sizes.select(F.col(group), F.ceil(F.col("_n") / goal).cast("long").alias("_k"))
    rows = df.join(F.broadcast(sizes), group).withColumn("_b", F.pmod(salt, F.col("_k")))
    starts = rows.groupBy(group, "_b").agg(F.sum(weight).alias("_w"))
    before = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("_s", F.coalesce(F.sum("_w").over(before), F.lit(0))).drop("_w")
    inside = Window.partitionBy(group, "_b").orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(starts, [group, "_b"])
    out = out.withColumn("rank", F.col("_s") + F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    return out.drop("_b", "_k", "_s")
