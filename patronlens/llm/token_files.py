"""Token files: parquet with one row per document, in id order, made for selective reads.

Columns are ``doc_id`` and ``n_tokens`` (delta encoded, so ids and lengths are read without
tokens) and ``ids`` (dictionary encoded: the vocabulary fits one dictionary page, so an id
takes 16 bits). Row groups and pages are small and have page indexes, so a filter on
``doc_id`` reads few pages. Files are range partitions of the id order, each sorted.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from patronlens.llm.common import arrow_pass, read, text_rows
from patronlens.llm.tokens import encoded_slices, standard_tokenizer
from patronlens.sources.storage import scratch_path

ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 32 << 20, 256 << 10, 2_000
OPTIONS = {
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "parquet.block.size": str(ROW_GROUP_BYTES),
    "parquet.page.size": str(PAGE_BYTES),
    "parquet.page.row.count.limit": str(PAGE_ROWS),
    "compression": "zstd",
}


def _encode(tokenizer: str):
    def build(batch: pa.RecordBatch):
        for first, ids, bounds in encoded_slices(batch.column("text"), tokenizer):
            yield {
                "doc_id": batch.column("doc_id").slice(first, len(bounds) - 1),
                "n_tokens": np.diff(bounds).astype(np.int64),
                "ids": pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32))),
            }

    return build


def write_tokens(docs: DataFrame, path: str, tokenizer: str) -> str:
    """Encode every whole text (null: empty), end each with the end id and write in id order.

    Rows without an id come first; rows that repeat an id are ordered by a hash of the
    text. An empty table gives files without rows.
    """
    ordered = (
        text_rows(docs)
        .withColumn("mark", F.xxhash64("text"))
        .repartitionByRange("doc_id", "mark")
        .sortWithinPartitions("doc_id", "mark")
    )
    encoded = arrow_pass(
        ordered.select("doc_id", "text"), _encode(tokenizer), "doc_id long, n_tokens long, ids array<int>", encodes=True
    )
    encoded.write.options(**OPTIONS).parquet(path)
    return path


def token_counts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, ``n_tokens`` and ``start`` (ids of all documents before) of a token file; reads no tokens.

    Lengths are summed within each file; files are numbered in id order, one row each, and
    their totals summed.
    """
    rows = (
        spark.read.schema("doc_id long, n_tokens long").parquet(path)
        .select("doc_id", "n_tokens", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    )
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("held"))
    before = Window.orderBy(F.length("file"), "file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(files, "file")
        .select("file", "row", "doc_id", "n_tokens", (F.col("base") + F.col("inside")).alias("start"))
    )


def read_tokens(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """doc_id and ids, of ids from ``low`` to ``high`` only if given; others' pages are not read."""
    rows = spark.read.schema("doc_id long, ids array<int>").parquet(path)
    if low is not None:
        rows = rows.filter(F.col("doc_id") >= low)
    return rows if high is None else rows.filter(F.col("doc_id") <= high)


def _checks(batch: pa.RecordBatch):
    lists = batch.column("ids")
    raw = memoryview(np.asarray(lists.values).astype("<u4").tobytes())
    bounds = (4 * np.asarray(lists.offsets, dtype=np.int64)).tolist()
    yield {
        "file": batch.column("file"),
        "row": batch.column("row"),
        "ids_crc32": np.array([zlib.crc32(raw[a:b]) for a, b in zip(bounds[:-1], bounds[1:])], dtype=np.int64),
    }


def op5(spark: SparkSession, folder: str) -> DataFrame:
    path = write_tokens(read(spark, folder, "documents"), scratch_path(spark, "tokens"), standard_tokenizer())
    stored = spark.read.schema("doc_id long, n_tokens long, ids array<int>").parquet(path)
    located = stored.select("ids", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    checks = arrow_pass(located, _checks, "file string, row long, ids_crc32 long")
    return token_counts(spark, path).join(checks, ["file", "row"]).select("doc_id", "start", "n_tokens", "ids_crc32")
