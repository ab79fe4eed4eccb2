"""Stored tables that are appended to in named batches and rebuilt in generations.

A batch is a folder of Parquet files and, once they are all there, an entry in the
table's manifest; only batches with an entry are read.  So an append that failed leaves
nothing that shows, and one that is run again under its name adds nothing.  Rows have a
natural key: a key that is stored already keeps its id, new keys get the ids that
follow the largest.  A generation is a set of such tables; the highest pointer names the
one that is read, and a rebuild fills a new one and writes its pointer last.

One writer at a time.  The driver only handles manifests, a line for each batch.
"""

from __future__ import annotations

import contextlib
import functools
import json
import uuid
from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.signals import dense_ids
from .schemas import SCHEMAS

#: Natural keys of the stored tables; evidence and answers have none, so all rows of a batch are stored.
KEYS: Mapping[str, tuple[str, ...]] = {
    "sources": ("name",),
    "documents": ("url", "content_hash"),
    "document_chunks": ("document_id", "chunk_index"),
    "signals": ("document_id", "signal_type", "title"),
    "recommendations": ("title",),
    "recommendation_evidence": (),
    "ceo_queries": (),
}


class Folder:
    """A folder in any file system that Spark can write to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, inner: str) -> list[str]:
        at = self._path(f"{self.path}/{inner}")
        return sorted(s.getPath().getName() for s in self.files.listStatus(at)) if self.files.exists(at) else []

    def write(self, name: str, text: str) -> None:
        """A file that is there as a whole or not at all."""
        part, whole = self._path(f"{self.path}/{name}.{uuid.uuid4().hex}.part"), self._path(f"{self.path}/{name}")
        out = self.files.create(part, False)
        out.write(bytearray(text.encode()))
        out.close()
        if not self.files.rename(part, whole):
            raise FileExistsError(f"{self.path}/{name}")

    def read(self, name: str) -> str:
        with contextlib.closing(self.files.open(self._path(f"{self.path}/{name}"))) as f:
            return bytes(f.readAllBytes()).decode()

    def delete(self, name: str) -> None:
        self.files.delete(self._path(f"{self.path}/{name}"), True)


def checked(rows: DataFrame, schema: StructType, table: str) -> list[Column]:
    """The columns of a stored table; a null where the schema has none is an error when rows are written."""
    out = []
    for f in schema:
        c = (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType)
        if not f.nullable:
            c = F.coalesce(c, F.raise_error(F.lit(f"{table}.{f.name} is null")).cast(f.dataType))
        out.append(c.alias(f.name))
    return out


class Generation:
    """The tables of one generation."""

    def __init__(self, folder: Folder, name: str):
        self.folder, self.name, self.spark = folder, name, folder.spark

    def _entries(self, table: str) -> list[dict]:
        at = f"{self.name}/{table}/manifest"
        return [json.loads(self.folder.read(f"{at}/{n}")) for n in self.folder.names(at) if n.endswith(".json")]

    def batches(self, table: str) -> list[str]:
        return [e["batch"] for e in self._entries(table)]

    def read(self, table: str) -> DataFrame:
        """All committed rows of a table; none where nothing was appended."""
        schema = self.spark.createDataFrame([], SCHEMAS[table]).schema
        paths = [f"{self.folder.path}/{self.name}/{table}/{e['data']}" for e in self._entries(table)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def append(self, table: str, rows: DataFrame, batch: str, refs: Mapping[str, DataFrame] | None = None, key: Sequence[str] | None = None) -> DataFrame:
        """Append rows under a batch's name; gives the stored ids of their keys, as (key columns, id), or no rows for a table without a key.

        ``refs`` has, for columns that name rows of another table, what appending those
        gave, as (natural, id): the natural values are replaced by ids, and one that has
        no id is an error.  Of rows with equal keys the least is stored; null key
        values equal one another.  Ids are gapless within a batch, in order of the key.
        """
        key, schema = list(KEYS[table] if key is None else key), self.spark.createDataFrame([], SCHEMAS[table]).schema
        for column, ids in (refs or {}).items():
            natural = next(c for c in ids.columns if c != "id")
            named = ids.select(F.col(natural).alias(column), F.col("id").alias("_ref"))
            found = F.coalesce("_ref", F.raise_error(F.concat(F.lit(f"{table}.{column} names no stored row: "), F.col(column).cast("string"))).cast("long"))
            rows = rows.join(named, column, "left").withColumn(column, found).drop("_ref")
        made = rows.select(*checked(rows, schema, table))
        if batch not in self.batches(table):
            self._write(table, made, batch, key)
        stored = self.read(table)
        return stored.join(made, same(stored, made, key), "left_semi").select(*key, "id") if key else stored.select("id").filter("false")

    def _write(self, table: str, made: DataFrame, batch: str, key: list[str]) -> None:
        stored = self.read(table).select(*key, "id")
        largest = stored.agg(F.max("id")).first()[0] or 0
        others = [c for c in made.columns if c not in (*key, "id", "created_at")]
        new = made.select(*key, *others)
        if key:
            new = new.groupBy(*key).agg(F.min(F.struct(F.lit(0), *others)).alias("_row")).select(*key, *[f"_row.{c}" for c in others])
            new = new.join(stored, same(new, stored, key), "left_anti")
        new = dense_ids(new, "id", key or others, largest + 1)
        if "created_at" in made.columns:
            new = new.withColumn("created_at", F.current_timestamp())
        data = f"data-{uuid.uuid4().hex}"
        new.select(*made.columns).write.parquet(f"{self.folder.path}/{self.name}/{table}/{data}")
        self.folder.write(f"{self.name}/{table}/manifest/{uuid.uuid5(uuid.NAMESPACE_URL, batch)}.json", json.dumps({"batch": batch, "data": data, "first": largest + 1}))

    def clean(self, table: str) -> None:
        """Delete what failed appends have left."""
        known = {e["data"] for e in self._entries(table)}
        for name in self.folder.names(f"{self.name}/{table}"):
            if name.startswith("data-") and name not in known:
                self.folder.delete(f"{self.name}/{table}/{name}")


def same(a: DataFrame, b: DataFrame, key: Sequence[str]) -> Column:
    return functools.reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in key])


class Store:
    """Generations of tables in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.folder = Folder(spark, path)

    def _pointers(self) -> list[str]:
        return [n for n in self.folder.names("pointers") if n.endswith(".json")]

    def current(self) -> Generation:
        """The generation that the highest pointer names; the first one is made where there is none."""
        pointers = self._pointers()
        if not pointers:
            self._point("generation-first")
            pointers = self._pointers()
        return Generation(self.folder, json.loads(self.folder.read(f"pointers/{pointers[-1]}"))["generation"])

    def _point(self, generation: str) -> None:
        last = self._pointers()
        number = int(last[-1].removesuffix(".json")) + 1 if last else 0
        self.folder.write(f"pointers/{number:012d}.json", json.dumps({"generation": generation}))

    @contextlib.contextmanager
    def rebuild(self, keep: Sequence[str] = ()) -> Iterator[Generation]:
        """A new generation to fill, read by others once the block ends well; if it fails, the old tables stay.

        Tables in ``keep`` go over as they are: their manifests are copied and name the old files.
        """
        old, fresh = self.current(), Generation(self.folder, f"generation-{uuid.uuid4().hex}")
        for table in keep:
            for e in old._entries(table):
                e["data"] = e["data"] if e["data"].startswith("../") else f"../../{old.name}/{table}/{e['data']}"
                self.folder.write(f"{fresh.name}/{table}/manifest/{uuid.uuid5(uuid.NAMESPACE_URL, e['batch'])}.json", json.dumps(e))
        yield fresh
        self._point(fresh.name)

    def reset(self, *tables: str) -> None:
        """Empty some tables; the others stay."""
        with self.rebuild([t for t in SCHEMAS if t not in tables]):
            pass
