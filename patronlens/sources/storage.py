"""Table reads and writes, layered publishing and shared intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronlens.fixed_values import LANDING_KEYS
from patronlens.schemas import INTERVENTIONS, PREDICTIONS
from patronlens.sources import versions

VIEW_LAYERS = ("stg", "features")
TABLE_LAYERS = ("core", "marts", "analytics")
LOOKUP_GROUP_BYTES, LOOKUP_PAGE_ROWS = 8 << 20, 2_000
CONCURRENT_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
# small files, and no shuffle of an earlier write beside those of the next one
SPARE_DISK = {
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


# --- parquet ---------------------------------------------------------------------------------

def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def land_raw(df: DataFrame, base_uri: str, table: str) -> str:
    """Write a raw table below ``base_uri`` (any Hadoop URI) under its fixed key."""
    return write_parquet(df, f"{base_uri.rstrip('/')}/{LANDING_KEYS[table]}")


# --- layers ----------------------------------------------------------------------------------

def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Reorder and cast to the declared schema; a missing or extra column is an error."""
    if set(df.columns) != set(schema.names):
        raise ValueError(f"expected columns {sorted(schema.names)}, got {sorted(df.columns)}")
    return df.to(schema)


def publish(
    df: DataFrame,
    layer: str,
    name: str,
    partition_by: list[str] | None = None,
    cluster_by: tuple[int, list[str]] | None = None,
    verify: Callable[[], None] | None = None,
    options: dict[str, str] | None = None,
) -> str:
    """Publish to a layer: a session view for cheap layers, a replaced table for the others.

    Views are named ``<layer>_<name>``; tables live in database ``<layer>`` and are
    switched to their new rows when these are written and, with ``verify``, checked.
    """
    if layer in VIEW_LAYERS:
        df.createOrReplaceTempView(f"{layer}_{name}")
        return f"{layer}_{name}"
    if layer not in TABLE_LAYERS:
        raise ValueError(f"unknown layer {layer!r}")
    return versions.replace_table(df, layer, name, partition_by, cluster_by, verify, options)


def read_published(spark: SparkSession, layer: str, name: str) -> DataFrame:
    return spark.table(f"{layer}_{name}" if layer in VIEW_LAYERS else f"{layer}.{name}")


def clustered(df: DataFrame, buckets: int, column: str = "customer_id") -> tuple[DataFrame, tuple[int, list[str]]]:
    """``df`` dealt out so that each bucket is one file, and the buckets to store it in."""
    return df.repartition(buckets, column), (buckets, [column])


def lookup_options(column: str) -> dict[str, str]:
    """Small pages with indexes and a Bloom filter: a file sorted by ``column`` is read a few pages per value.

    The filter gets the size its values need; without that it takes 1 MB in every file.
    """
    return {
        f"parquet.bloom.filter.enabled#{column}": "true",
        "parquet.bloom.filter.adaptive.enabled": "true",
        f"parquet.bloom.filter.candidates.number#{column}": "12",
        "parquet.block.size": str(LOOKUP_GROUP_BYTES),
        "parquet.page.row.count.limit": str(LOOKUP_PAGE_ROWS),
    }


def write_predictions(scored: DataFrame, name: str = "churn_predictions", buckets: int | None = None) -> str:
    """Replace all rows of the predictions table, with its declared schema.

    The table is bucketed and sorted by customer (``buckets`` files, by default as many as
    the session's shuffle partitions), so a lookup of a few customers reads a few pages of
    their buckets, and joins with other tables by customer move no rows.
    """
    buckets = buckets or int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows, by = clustered(conform(scored, PREDICTIONS), buckets)
    return publish(rows, "analytics", name, cluster_by=by, options=lookup_options("customer_id"))


def lookup(spark: SparkSession, name: str, customers: list[int]) -> DataFrame:
    """The rows of a few customers from a table stored by customer."""
    return spark.table(name).filter(F.col("customer_id").isin(customers))


def create_interventions(spark: SparkSession, path: str, reset: bool = False) -> None:
    """Create the empty interventions if they are absent; ``reset`` empties them."""
    versions.create_ledger(spark, path, reset)


def append_interventions(offers: DataFrame, path: str, batch: str) -> bool:
    """Append the offers of one run once, however often it is repeated; whether they were written now.

    ``generated_at`` defaults to the current time.
    """
    if "generated_at" not in offers.columns:
        offers = offers.withColumn("generated_at", F.current_timestamp().cast("timestamp_ntz"))
    return versions.append_batch(conform(offers, INTERVENTIONS), path, batch)


def read_interventions(spark: SparkSession, path: str) -> DataFrame:
    return versions.read_batches(spark, path, INTERVENTIONS)


# --- shared intermediate tables --------------------------------------------------------------

def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: that of ``spark.checkpoint.dir``, else one below the warehouse."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    folder = (configured or f"{spark.conf.get('spark.sql.warehouse.dir')}/intermediate").rstrip("/")
    if not configured and folder.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{folder} is a folder of one machine: set spark.checkpoint.dir to a shared one")
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/patronlens/{app}/{label}-{uuid.uuid4().hex}"


def stash(df: DataFrame, label: str, by: tuple[int, list[str]] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of it.

    Used where a result feeds several branches or jobs: the branches read the same
    rows, column pruning applies per branch, and a lost executor costs one re-read.
    Rows that are dealt out to a number of tasks by columns already keep that with ``by``:
    they are stored in as many buckets, and groupings on these columns shuffle nothing.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    if by is None:
        df.write.parquet(path)
        stored = spark.read.schema(df.schema).parquet(path)
        stored.stash_path = path
        return stored
    number, columns = by
    name = f"{label}_{uuid.uuid4().hex}".replace("-", "_")
    # a task has one bucket: no sort by bucket before the write
    with settings(spark, {CONCURRENT_WRITERS: "2"}):
        df.write.format("parquet").bucketBy(number, *columns).option("path", path).saveAsTable(name)
    stored = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # its entry only; the files stay, and the scan knows their buckets
    stored.stash_path = path
    return stored


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session has these settings inside, and those of before afterwards."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def discard(stored: DataFrame) -> None:
    """Delete a table that ``stash`` returned and that nothing reads any more."""
    _delete(stored.sparkSession, stored.stash_path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete this application's intermediate tables."""
    _delete(spark, f"{shared_dir(spark)}/patronlens/{spark.sparkContext.applicationId}")
