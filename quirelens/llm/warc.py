"""WARC archives: a Python data source that reads them, and their writing from a table of pages."""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith

from quirelens.llm.common import ship
from quirelens.plans.lineage import scratch_path

# Fixed values of the format.
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEAST_SHARED = 100  # payloads of fewer bytes are never replaced by a revisit
ID_PREFIX = "urn:page:"
BATCH_BYTES = 8 << 20

FIELDS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
    "payload_length": "WARC-Payload-Length",
    "content_type": "Content-Type",
}
SCHEMA = ", ".join(f"{name} string" for name in FIELDS) + ", payload binary"


# ---- writing -------------------------------------------------------------------


def _header(name: str, value) -> F.Column:
    """``name: value`` and a line end; nothing for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def records(pages: DataFrame, date: str) -> DataFrame:
    """One text ``value`` per page: a WARC record without its closing line ends."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256)).withColumn("bytes", F.octet_length("html").cast("bigint"))
    # Shared payloads only, so that most pages meet nothing in the join below.
    shared = (
        rows.filter(F.col("bytes") >= LEAST_SHARED).groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first_id is not null")
        .select(F.col("digest").alias("_digest"), "first_id")
    )
    rows = rows.join(shared, (F.col("digest") == F.col("_digest")) & (F.col("bytes") >= LEAST_SHARED), "left")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    uri = F.regexp_replace("url", "[\\x00-\\x20\\x7F]", "%20")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.when(again, F.lit("")).otherwise(F.concat(http, F.col("html")))
    record_id = lambda c: F.concat(F.lit(f"<{ID_PREFIX}"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _header("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        _header("WARC-Record-ID", record_id("page_id")),
        _header("WARC-Date", F.lit(date)),
        _header("WARC-Target-URI", uri),
        _header("WARC-Profile", F.when(again, F.lit(PROFILE))),
        _header("WARC-Refers-To", F.when(again, record_id("first_id"))),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _header("WARC-Payload-Length", F.col("bytes").cast("string")),
        _header("Content-Type", F.lit("application/http;msgtype=response")),
        _header("Content-Length", F.octet_length("_block").cast("string")),
        F.lit("\r\n"),
    )
    return rows.withColumn("_block", block).select(F.concat(head, F.col("_block")).alias("value"))


def write_warc(pages: DataFrame, path: str, date: str = "2025-01-01T00:00:00Z", compression: str | None = "gzip") -> None:
    """Write a record per page (page_id, url, html) to the folder ``path``.

    Of payloads that are equal and at least 100 bytes long the smallest page_id gets
    the response, the others revisit records that refer to it. Spark's text writer
    writes the files, with a record's closing line ends as the line separator, so any
    file system Spark knows will do and a task that runs again replaces its file.

    A null html is an empty payload, a null url leaves its header out, white space in
    a url is escaped. Rows that repeat the smallest page_id are all responses. A null
    page_id is written as an empty number and never referred to.
    """
    writer = records(pages, date).write.option("lineSep", END)
    if compression:
        writer = writer.option("compression", compression)
    writer.text(path)


# ---- reading -------------------------------------------------------------------


def _open(path: str):
    filesystem, inner = fs.FileSystem.from_uri(path)
    raw = filesystem.open_input_file(inner)
    return gzip.GzipFile(fileobj=raw, mode="rb") if path.endswith(".gz") else io.BufferedReader(raw, 1 << 20)


def _skip(stream, count: int) -> None:
    if isinstance(stream, gzip.GzipFile):
        while count > 0 and (got := len(stream.read(min(count, 1 << 20)))):
            count -= got
    else:
        stream.seek(count, io.SEEK_CUR)


def _headers(stream) -> dict[str, str] | None:
    """Headers of the next record by lower-case name, None at the end of the file."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"No WARC record starts with {line[:40]!r}")
    out, last = {}, None
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in " \t" and last:
            out[last] += " " + text.strip()
        else:
            name, _, value = text.partition(":")
            out[last := name.strip().lower()] = value.strip()
    return out


def _payload(block: bytes, content_type: str) -> bytes:
    """The block, without its HTTP head if it is an HTTP message."""
    if content_type.startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(0)
        self.paths = paths


class WarcReader(DataSourceReader):
    """Plans partitions of whole files and reads headers before anything else."""

    def __init__(self, options):
        self.path = options["path"]
        self.payload = options.get("payload", "true") == "true"
        self.bytes = int(options.get("partitionbytes", 64 << 20))
        self.tests: list[Filter] = []

    def pushFilters(self, filters):
        names = set(FIELDS)
        for f in filters:
            if isinstance(f, (EqualTo, In, IsNotNull, StringStartsWith)) and f.attribute[0] in names:
                self.tests.append(f)
            else:
                yield f

    def wanted(self, row: dict) -> bool:
        for f in self.tests:
            value = row[f.attribute[0]]
            if value is None:
                return False
            if isinstance(f, EqualTo) and value != f.value:
                return False
            if isinstance(f, In) and value not in f.value:
                return False
            if isinstance(f, StringStartsWith) and not value.startswith(f.value):
                return False
        return True

    def partitions(self):
        """Files in order of name, put together up to ``partitionBytes``; a file is never split."""
        filesystem, inner = fs.FileSystem.from_uri(self.path)
        prefix = self.path[: len(self.path) - len(inner)] if self.path.endswith(inner) else ""
        found = filesystem.get_file_info(fs.FileSelector(inner, recursive=True))
        files = sorted((i.path, i.size) for i in found if i.type == fs.FileType.File and i.base_name[:1] not in "._")
        out, size = [], 0
        for name, length in files:
            if not out or size + length > self.bytes:
                out.append([])
                size = 0
            out[-1].append(prefix + name)
            size += length
        return [Files(names) for names in out] or [Files([])]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*[(n, pa.string()) for n in FIELDS], ("payload", pa.binary())])
        rows, held = [], 0
        for path in partition.paths:
            with _open(path) as stream:
                while (head := _headers(stream)) is not None:
                    length = int(head.get("content-length", 0))
                    row = {name: head.get(field.lower()) for name, field in FIELDS.items()}
                    if not self.wanted(row):
                        _skip(stream, length)
                        continue
                    if self.payload:
                        block = stream.read(length)
                        if len(block) < length:
                            raise ValueError(f"{path} ends inside a record")
                        row["payload"] = _payload(block, row["content_type"] or "")
                        held += length
                    else:
                        _skip(stream, length)
                        row["payload"] = None
                    rows.append(row)
                    held += 500
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class WarcSource(DataSource):
    """``spark.read.format("warc").load(path)``; option ``payload=false`` reads headers only."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of the archives below ``path``.

    Filters on header columns (record_type and the others: equal, in, not null, starts
    with) are decided on the headers, before a payload is read. That needs Spark's
    switch for filters in Python sources, which is turned on here. Paths are those
    pyarrow opens (file, s3, gs, hdfs).
    """
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def page_number(column: str) -> F.Column:
    return F.nullif(F.regexp_extract(column, f"{ID_PREFIX}(-?[0-9]*)>", 1), F.lit("")).cast("bigint")


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to as read back from the archives.

    Responses are measured on the payload that was read; revisits hold no payload and
    state its length and digest in their headers.
    """
    spark = pages.sparkSession
    path = scratch_path(spark)
    write_warc(pages, path)
    uri = path if "://" in path or path.startswith("file:") else f"file://{path}"
    uri = uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file:///") else uri
    columns = lambda size, digest: ["page_id", size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to"]
    full = read_warc(spark, uri).filter("record_type = 'response'").withColumn("page_id", page_number("record_id"))
    again = read_warc(spark, uri, payload=False).filter("record_type = 'revisit'").withColumn("page_id", page_number("record_id"))
    full = full.select(*columns(F.octet_length("payload").cast("bigint"), F.sha2("payload", 256))).withColumn("refers_to", F.lit(None).cast("bigint"))
    again = again.withColumn("refers_to", page_number("refers_to")).select(
        *columns(F.col("payload_length").cast("bigint"), F.substring_index("payload_digest", ":", -1))
    )
    return full.unionByName(again)
