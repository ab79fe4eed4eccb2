"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Bytes for each core up to which a table may be dealt out anew.
SMALL_BYTES = 32 << 20


#: Catalog tables whose files are in the shared folder.
_TABLES: set[str] = set()
#: Folders of local sessions that have none set, by application.
_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """This application's folder in ``spark.checkpoint.dir``, which driver and executors share.

    Only a session on this machine alone (as in tests) gets a local folder where none is set.
    """
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all machines of {master} share")
        own = spark.sparkContext.applicationId
        path = _LOCAL[own] = _LOCAL.get(own) or f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
    return f"{path.rstrip('/')}/{spark.sparkContext.applicationId}"


def shared_table(spark: SparkSession, name: str) -> str:
    """Where the files of a catalog table go that ``clean`` will drop."""
    _TABLES.add(name)
    return f"{shared_folder(spark)}/{name}"


def clean(spark: SparkSession) -> None:
    """Delete what this application has stored, once its results are written: frames that read it can't be computed any more."""
    for name in sorted(_TABLES):
        spark.sql(f"DROP TABLE IF EXISTS `{name}`")
    _TABLES.clear()
    folder = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back: computed once, and columns can be pruned."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table; one that comes in fewer files than there are cores, and is small, is dealt to all of them.

    A file with a single row group is one task otherwise, whatever is computed from it.
    """
    df, cores = spark.read.parquet(path), spark.sparkContext.defaultParallelism
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    summary = folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder)
    small = summary.getFileCount() < cores and summary.getLength() < cores * SMALL_BYTES
    return df.repartition(cores) if small else df


def read_df(spark: SparkSession, query: str, *params) -> DataFrame:
    """A parametrised SQL query."""
    return spark.sql(query, args=list(params)) if params else spark.sql(query)


def metric_value(spark: SparkSession, query: str):
    """The first value of a query's first row; None without rows."""
    row = spark.sql(query).first()
    return None if row is None else row[0]


def count_table(spark: SparkSession, name: str) -> int:
    """Rows of a table, 0 if there is none."""
    return spark.table(name).count() if spark.catalog.tableExists(name) else 0
