"""WARC records in ZIP packages: written by tasks, read back by byte ranges.

A package holds, stored, ``archive/data.warc.gz`` (each record a gzip member of
its own) and ``indexes/index.cdxj`` (one line per record with its range).  The
reader goes from the ZIP directory to the index to the records.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, zip_reader

#: Payloads shorter than this are never deduplicated.
MIN_REVISIT = 1000
#: Compressed bytes after which a task starts its next package.
PACKAGE_BYTES = 8_000_000
#: Neighbouring records are fetched together up to this many bytes.
RANGE_BYTES = 4_000_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"

RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def plan_records(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): which pages revisit which.

    Null html is an empty payload.  Of equal payloads of ``min_bytes`` or more, the
    row with the largest page_id is kept as a response (a null id is less than any;
    rows that share the largest id are all responses) and the others refer to it.
    Only digests that occur twice take part in the join; they are stored first, so a
    hot one is a skewed key of a plain join, which adaptive execution splits.  An empty
    table gives no records; a very long page is one record; other columns aren't read.
    """
    rows = pages.select("page_id", "url", common.text_bytes(F.col("html")).alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "long": F.octet_length("payload") >= min_bytes})
    counted = rows.filter("long").groupBy("digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("n"))
    twice = common.materialise(counted.filter("n > 1 and kept is not null").select("digest", "kept", F.lit(True).alias("long")), "equal-payloads")
    rows = rows.join(twice, ["digest", "long"], "left")
    return rows.select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("kept")), F.col("kept")).alias("refers_to"))


def record_name(page_id: int | None) -> str:
    return f"<urn:corpus:page:{'none' if page_id is None else page_id}>"


def page_of(name: str) -> int | None:
    found = name.strip("<>").rpartition(":")[2]
    return None if found == "none" else int(found)


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit without."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_name(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    fields.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()))
    if refers_to is not None:
        fields += [("WARC-Refers-To", record_name(refers_to)), ("WARC-Profile", PROFILE)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Header fields (lower case), HTTP header fields and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    web = {k.lower(): v for k, _, v in (x.partition(": ") for x in http.decode().split("\r\n")[1:])}
    return {"fields": fields, "http": web, "payload": payload}


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class Package:
    """Collects records and writes one ZIP package under a name that no other attempt uses."""

    def __init__(self, folder: str):
        self.folder, self.data, self.lines = folder, io.BytesIO(), []

    def add(self, record: bytes, url: str | None, kind: str) -> None:
        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
        packed = packer.compress(record) + packer.flush()
        self.lines.append(json.dumps({"url": url, "mime": "warc/revisit" if kind == "revisit" else "text/html", "offset": self.data.tell(), "length": len(packed)}))
        self.data.write(packed)

    def write(self) -> tuple[str, int, int]:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for name, content in ((DATA, self.data.getbuffer()), (INDEX, "\n".join(self.lines).encode())):
                with z.open(zipfile.ZipInfo(name), "w", force_zip64=True) as f:
                    f.write(content)
        path = f"{self.folder}/{uuid.uuid4().hex}.wacz"
        fs, place = _open(path)
        with fs.open_output_stream(place) as f:
            f.write(out.getbuffer())
        return path, out.getbuffer().nbytes, len(self.lines)


MANIFEST = "path string, bytes long, records long"


def write_packages(records: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write packages under ``folder`` (a URI that all tasks share); the stored manifest names those that count.

    A task that is tried again writes new files; its earlier ones are in no manifest.
    """
    fs, place = _open(folder)
    fs.create_dir(place, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package = Package(folder)
        done = []
        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, payload, digest, refers_to = (batch.column(c)[i].as_py() for c in range(5))
                record = make_record(page_id, url, payload, digest, refers_to)
                package.add(record, url, "response" if refers_to is None else "revisit")
                if package.data.tell() >= package_bytes:
                    done.append(package.write())
                    package = Package(folder)
        if package.lines:
            done.append(package.write())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["path", "bytes", "records"])

    columns = records.select("page_id", "url", "payload", "digest", "refers_to")
    return common.materialise(columns.mapInArrow(run, MANIFEST), "warc-manifest")


def ranges(lines: list[dict], most: int = RANGE_BYTES) -> Iterator[list[dict]]:
    """Neighbouring records in groups of at most ``most`` bytes (one larger record is a group)."""
    group: list[dict] = []
    for x in sorted(lines, key=lambda x: x["offset"]):
        if group and x["offset"] + x["length"] - group[0]["offset"] > most:
            yield group
            group = []
        group.append(x)
    if group:
        yield group


def read_package(uri: str) -> Iterator[bytes]:
    """Every record of a package, by ranges."""
    fs, place = _open(uri)
    with fs.open_input_file(place) as f:
        read = lambda at, n: f.read_at(n, at)
        found = {m.name: m for m in zip_reader.members(read, f.size())}
        index, data = found[INDEX], zip_reader.data_place(read, found[DATA])
        text = read(zip_reader.data_place(read, index), index.size).decode()
        for group in ranges([json.loads(x) for x in text.splitlines()]):
            first = group[0]["offset"]
            raw = read(data + first, group[-1]["offset"] + group[-1]["length"] - first)
            for x in group:
                yield zlib.decompress(raw[x["offset"] - first : x["offset"] - first + x["length"]], 31)


def read_packages(manifest: DataFrame) -> DataFrame:
    """The records of all packages; response payloads are checked against their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                for raw in read_package(path):
                    r = parse_record(raw)
                    fields = r["fields"]
                    kind = fields["warc-type"]
                    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                    if kind == "response" and hashlib.sha1(r["payload"]).hexdigest() != digest:
                        raise ValueError(f"payload of {fields['warc-record-id']} differs from its digest")
                    size = len(r["payload"]) if kind == "response" else int(r["http"]["content-length"])
                    refers = page_of(fields["warc-refers-to"]) if kind == "revisit" else None
                    rows.append((page_of(fields["warc-record-id"]), size, digest, kind, refers))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in RECORDS.split(", ")])

    slots = max(1, manifest.sparkSession.sparkContext.defaultParallelism)
    return manifest.select("path").repartition(slots).mapInArrow(run, RECORDS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through a written and re-read archive."""
    records = plan_records(common.table(spark, sf_dir, "pages"))
    folder = f"{common.shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    return read_packages(write_packages(records, folder))
