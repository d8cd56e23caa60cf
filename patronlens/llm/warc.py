"""WARC archives of web pages: written by Spark, read back by a Python data source.

Writing: pages with equal payloads are found by digest; the one with the largest id is
stored as a response, the others as revisit records that name it and have no payload.
Each row of the text sink is one record and the row separator is the record separator,
so any file system that Spark reaches can hold the archives.

Reading: the data source plans one partition for each archive file. Filters on record
type and header columns are pushed down to the reader: headers are parsed first, records
that fail are passed over by their length, and payloads are decoded only if that column
is asked for.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from patronlens.llm.common import arrow_pass, read
from patronlens.sources.storage import scratch_path

GAP = "\r\n\r\n"
RECORDS_PER_FILE = 20_000
# column and header of what a record's header holds
HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
    "payload_length": "X-Payload-Length",
}
SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", content_length long, payload binary"


def _digests(batch: pa.RecordBatch):
    pages = [p.encode() for p in pc.fill_null(batch.column("html"), "").to_pylist()]
    yield {
        "page_id": batch.column("page_id"),
        "mark": batch.column("mark"),
        "digest": pa.array([base64.b32encode(hashlib.sha1(p).digest()).decode() for p in pages], pa.string()),
        "bytes": pa.array([len(p) for p in pages], pa.int64()),
    }


def records(pages: DataFrame) -> DataFrame:
    """One record text for each row of ``pages`` (page_id, url, html).

    Null html is an empty payload; null urls have no target header. Rows with equal
    payloads refer to the one with the largest id; of rows that share that id all are
    responses. Rows without an id are named by an empty id, and are responses only if no
    row with an id has their payload.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumn("mark", F.xxhash64("html"))
    known = arrow_pass(
        rows.select("page_id", "mark", "html"), _digests, "page_id long, mark long, digest string, bytes long"
    )
    largest = known.groupBy("digest", "bytes").agg(F.max("page_id").alias("original"))
    facts = known.join(largest, ["digest", "bytes"]).select(
        F.col("page_id").alias("of_page"), F.col("mark").alias("of_mark"), "digest", "bytes", "original"
    ).distinct()
    same = F.col("page_id").eqNullSafe(F.col("of_page")) & (F.col("mark") == F.col("of_mark"))
    joined = rows.join(facts, same)
    revisit = F.coalesce(F.col("original") != F.coalesce("page_id", F.col("original") - 1), F.lit(False))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    uri = F.regexp_replace("url", r"[\r\n]+", " ")
    header = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("page_id"))),
        F.lit("WARC-Date: 2024-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name(F.col("original")))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.concat(F.lit("X-Payload-Length: "), F.col("bytes").cast("string")),
        F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
    )
    return joined.select(F.concat(header, F.lit(GAP), F.when(revisit, "").otherwise(F.col("html"))).alias("value"))


def write_archives(pages: DataFrame, path: str) -> str:
    """Compressed archive files below ``path`` with a record for each row of ``pages``."""
    writer = records(pages).write.option("lineSep", GAP).option("compression", "gzip")
    writer.option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)
    return path


@dataclass
class ArchiveFile(InputPartition):
    path: str


class WarcReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str], payloads: bool):
        self.path, self.columns, self.payloads = path, columns, payloads
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take equality filters on header columns; the others stay with Spark."""
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column in HEADERS:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[column] = self.wanted.get(column, values) & values
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        files, root = _file_system(self.path)
        found = files.get_file_info(fs.FileSelector(root, recursive=True))
        names = sorted(f.path for f in found if f.is_file and not f.base_name.startswith(("_", ".")))
        return [ArchiveFile(n) for n in names]

    def read(self, partition: ArchiveFile) -> Iterator[tuple]:
        files, _ = _file_system(self.path)
        with files.open_input_stream(partition.path, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
            yield from self._records(stream)

    def _records(self, stream) -> Iterator[tuple]:
        while line := stream.readline():
            if line != b"WARC/1.1\r\n":
                raise ValueError(f"not a record: {line[:60]!r}")
            header = {}
            while (line := stream.readline()) != b"\r\n":
                key, _, value = line.decode().rstrip("\r\n").partition(": ")
                header[key.lower()] = value
            length = int(header["content-length"])
            fields = {c: header.get(h.lower()) for c, h in HEADERS.items()}
            wanted = all(fields[c] in values for c, values in self.wanted.items())
            payload = stream.read(length) if wanted and self.payloads else _skip(stream, length)
            if stream.read(4) != GAP.encode():
                raise ValueError("a record does not end where its length says")
            if wanted:
                values = fields | {"content_length": length, "payload": payload}
                yield tuple(values[c] for c in self.columns)


def _skip(stream, length: int) -> None:
    while length > 0:
        length -= len(stream.read(min(length, 1 << 16))) or length


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class WarcSource(DataSource):
    """``spark.read.format("warc").load(path)``; option ``payloads`` = false leaves payloads out."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        payloads = self.options.get("payloads", "true") != "false"
        return SCHEMA if payloads else SCHEMA.removesuffix(", payload binary")

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], schema.names, "payload" in schema.names)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payloads", str(payloads).lower()).load(path)


def _page_of(name):
    return F.regexp_extract(name, r"^<urn:page:(.*)>$", 1).try_cast("long")


def _measured(batch: pa.RecordBatch):
    bodies = batch.column("payload").to_pylist()
    yield {
        "page_id": batch.column("page_id"),
        "payload_bytes": pa.array([len(b) for b in bodies], pa.int64()),
        "payload_digest": pa.array([base64.b32encode(hashlib.sha1(b).digest()).decode() for b in bodies], pa.string()),
        "record_type": batch.column("record_type"),
        "refers_to": pa.nulls(len(bodies), pa.int64()),
    }


def op9(spark: SparkSession, folder: str) -> DataFrame:
    path = write_archives(read(spark, folder, "pages"), scratch_path(spark, "warc"))
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    # responses are measured, revisits are known from their headers alone
    bodies = read_archives(spark, path).filter("record_type = 'response'")
    responses = arrow_pass(
        bodies.select(_page_of("record_id").alias("page_id"), "record_type", "payload"), _measured, schema
    )
    revisits = (
        read_archives(spark, path, payloads=False)
        .filter("record_type = 'revisit'")
        .select(
            _page_of("record_id").alias("page_id"),
            F.col("payload_length").cast("long").alias("payload_bytes"),
            F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"),
            "record_type",
            _page_of("refers_to").alias("refers_to"),
        )
    )
    return responses.unionByName(revisits)
