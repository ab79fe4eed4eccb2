"""Landed pages in archives, as a data source and sink: one partition for each archive.

An archive is a gzip file with a JSON line for each page.  Archives count once the
manifest that a whole write leaves last names them, so a failed write, or a task that
ran twice, leaves nothing that is read.  Archives are opened in tasks through Arrow's file
systems, so a path may be in any store that Arrow knows.
"""

from __future__ import annotations

import gzip
import io
import json
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import LongType, StringType, StructField, StructType

FORMAT, MANIFEST = "page_archives", "manifest.json"
KINDS = {"page_id": LongType(), "url": StringType(), "html": StringType()}
ARROW = {"page_id": pa.int64(), "url": pa.string(), "html": pa.string()}
#: Pages of one batch.
BATCH = 500


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


@dataclass
class Archive(InputPartition):
    name: str

    def __init__(self, name: str):
        super().__init__(name)
        self.name = name


@dataclass
class Written(WriterCommitMessage):
    name: str
    pages: int


class Reader(DataSourceReader):
    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns = path, columns

    def partitions(self) -> list[Archive]:
        files, root = opened(self.path)
        with files.open_input_stream(f"{root}/{MANIFEST}") as f:
            return [Archive(a["name"]) for a in json.loads(f.readall())["archives"]] or [Archive("")]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        files, root = opened(self.path)
        with files.open_input_stream(f"{root}/{partition.name}", compression="gzip") as raw, io.TextIOWrapper(raw, "utf-8", newline="\n") as lines:
            held: list[dict] = []
            for line in lines:
                held.append(json.loads(line))
                if len(held) == BATCH:
                    yield self._batch(held)
                    held = []
            if held:
                yield self._batch(held)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], ARROW[c]) for c in self.columns], self.columns)


class Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[Row]) -> Written:
        files, root = opened(self.path)
        files.create_dir(root, recursive=True)
        name, count = f"pages-{uuid.uuid4().hex}.json.gz", 0
        with files.open_output_stream(f"{root}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=raw, mode="wb", mtime=0) as out:
            for row in iterator:
                out.write(json.dumps({c: row[c] for c in KINDS}).encode() + b"\n")
                count += 1
        return Written(name, count)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = opened(self.path)
        made = [{"name": m.name, "pages": m.pages} for m in messages if m and m.pages]
        if not self.overwrite and files.get_file_info(f"{root}/{MANIFEST}").type != fs.FileType.NotFound:
            with files.open_input_stream(f"{root}/{MANIFEST}") as f:
                made = json.loads(f.readall())["archives"] + made
        with files.open_output_stream(f"{root}/{MANIFEST}.part") as f:
            f.write(json.dumps({"archives": made}).encode())
        files.move(f"{root}/{MANIFEST}.part", f"{root}/{MANIFEST}")

    def abort(self, messages: list[Written | None]) -> None:
        files, root = opened(self.path)
        for m in messages:
            if m:
                files.delete_file(f"{root}/{m.name}")


class PageArchives(DataSource):
    """``spark.read.format("page_archives")``, with the option ``columns`` to read only some of page_id, url and html."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _columns(self) -> list[str]:
        wanted = self.options.get("columns")
        columns = [c.strip() for c in wanted.split(",")] if wanted else list(KINDS)
        if unknown := set(columns) - set(KINDS):
            raise ValueError(f"pages have no {sorted(unknown)}")
        return columns

    def schema(self) -> StructType:
        return StructType([StructField(c, KINDS[c]) for c in self._columns()])

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], [f.name for f in schema])

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        if missing := set(KINDS) - set(schema.names):
            raise ValueError(f"pages need {sorted(missing)}")
        return Writer(self.options["path"], overwrite)


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the file system that Spark takes it to be in."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def register(spark: SparkSession) -> None:
    """Make the format known to a session; tasks get this module with it."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(PageArchives)


def write(pages: DataFrame, path: str, mode: str = "append") -> None:
    """Pages (page_id, url, html) as archives, one for each partition that has rows."""
    register(pages.sparkSession)
    pages.select(*KINDS).write.format(FORMAT).option("path", qualified(pages.sparkSession, path)).mode(mode).save()


def read(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    register(spark)
    rows = spark.read.format(FORMAT).option("path", qualified(spark, path))
    return (rows.option("columns", ",".join(columns)) if columns else rows).load()
