"""What the operators share: table reads, Arrow passes and connected components."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patronlens.sources.storage import stash

__all__ = ["arrow_pass", "components", "give_back", "in_small_batches", "read", "stash", "text_rows"]

BATCH_BYTES, BATCH_ROWS = 8 << 20, 2_000


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")


def text_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, named ``doc_id`` and ``text``; other columns never clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session from now on sends Python at most BATCH_BYTES and BATCH_ROWS at a time.

    Texts vary from nothing to megabytes, and the standard 10,000 rows of 64 MB are copied
    several times on their way; a single longer text is still sent whole.
    """
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return df


def give_back() -> None:
    """Return the free memory that Arrow's and C's allocators keep to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim:
        trim(0)


def arrow_pass(
    df: DataFrame, build: Callable[[pa.RecordBatch], Iterator[dict[str, np.ndarray]]], schema: str, encodes: bool = False
) -> DataFrame:
    """``mapInArrow`` of a function that yields columns by name for each batch.

    Unless it ``encodes`` tokens itself, a worker first drops what it remembers of encoding.
    """

    def run(batches):
        tokens = sys.modules.get("patronlens.llm.tokens")
        if tokens and not encodes:
            tokens.forget_encoders()
        for batch in batches:
            for columns in build(batch):
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns)
                )
        # workers are used again by later tasks: give back what this one needed
        give_back()

    return in_small_batches(df).mapInArrow(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """Nodes ``node`` of the undirected ``edges`` (a, b) with ``component_id``, the least node reachable.

    Alternating large-star and small-star steps: every node links its neighbours to the
    least node it sees, so a path of n links shrinks in about log n rounds. A node's
    neighbours are never gathered: the least one comes from a combined aggregate and goes
    back by a join that splits a hot node. Each round is a stored table, so lost executors
    cost one round at most. Edges to itself and null ends are ignored; no edges, no rows.
    """
    current = _stored_edges(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b"))
    seen = _checksum(current)
    while seen[0]:
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(least.select("a", F.col("m").alias("b"))).filter("a <> b")
        current = _stored_edges(small)
        now = _checksum(current)
        if now == seen:
            break
        seen = now
    roots = current.select(F.col("b").alias("node")).distinct()
    leaves = current.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component_id"))
    return leaves.union(roots.select("node", F.col("node").alias("component_id")))


def _stored_edges(edges: DataFrame) -> DataFrame:
    ordered = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return stash(ordered.distinct(), "edges")


def _checksum(edges: DataFrame) -> tuple:
    digest = F.xxhash64("a", "b").cast("decimal(38,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(digest)).first())
