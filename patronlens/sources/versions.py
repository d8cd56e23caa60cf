"""Tables that are replaced as a whole, and appends that may be repeated.

A replaced table is a view over the newest of its versions, each a table of its own. New
rows are written beside the current ones; replacing the view is one change of the catalog.
So a reader sees the old rows or the new ones, and a write that fails, or whose rows fail
their checks, leaves the old ones.

An appended batch has an id. Its rows go to a folder of their own and count once the batch
stands in the ledger; a batch that stands there isn't written again, and should two writers
commit it, the first one counts.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEPT_VERSIONS = 2  # the current one, and the one before for readers that have begun
_VERSION = re.compile(r"(.+)__v(\d{8})_[0-9a-f]{8}")
_LEDGER = "batch string, attempt string, reset boolean, committed_at timestamp"


# --- replaced tables -------------------------------------------------------------------------

def versions(spark: SparkSession, database: str, name: str) -> list[str]:
    """The tables that hold the versions of a name, oldest first."""
    found = [r["tableName"] for r in spark.sql(f"SHOW TABLES IN {database}").collect()]
    return sorted(t for t in found if (m := _VERSION.fullmatch(t)) and m[1] == name)


def replace_table(
    df: DataFrame,
    database: str,
    name: str,
    partition_by: list[str] | None = None,
    cluster_by: tuple[int, list[str]] | None = None,
    verify: Callable[[], None] | None = None,
    options: dict[str, str] | None = None,
) -> str:
    """Write ``df`` as the next version and switch ``database.name`` to it.

    ``cluster_by`` (buckets, columns) stores the rows bucketed and sorted by the columns, so
    that joins of equally bucketed tables need no shuffle. ``verify`` runs after the write
    and before the switch; if it raises, the version is dropped. ``options`` are those of
    the writer.
    """
    spark = df.sparkSession
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    held = versions(spark, database, name)
    number = int(_VERSION.fullmatch(held[-1])[2]) + 1 if held else 1
    version = f"{name}__v{number:08d}_{uuid.uuid4().hex[:8]}"
    writer = df.write.format("parquet").options(**(options or {}))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if cluster_by:
        buckets, columns = cluster_by
        writer = writer.bucketBy(buckets, *columns).sortBy(*columns)
    try:
        writer.saveAsTable(f"{database}.{version}")
        if verify:
            verify()
        spark.sql(f"CREATE OR REPLACE VIEW {database}.{name} AS SELECT * FROM {database}.{version}")
    except Exception:
        spark.sql(f"DROP TABLE IF EXISTS {database}.{version}")
        raise
    for old in [*held, version][:-KEPT_VERSIONS]:
        spark.sql(f"DROP TABLE IF EXISTS {database}.{old}")
    return f"{database}.{name}"


# --- repeatable appends ----------------------------------------------------------------------

def _ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_LEDGER).parquet(f"{path}/ledger")


def _enter(spark: SparkSession, path: str, batch: str | None, attempt: str | None, reset: bool = False) -> None:
    row = spark.range(1).select(
        F.lit(batch).cast("string").alias("batch"),
        F.lit(attempt).cast("string").alias("attempt"),
        F.lit(reset).alias("reset"),
        F.current_timestamp().alias("committed_at"),
    )
    row.coalesce(1).write.mode("append").parquet(f"{path}/ledger")


def create_ledger(spark: SparkSession, path: str, reset: bool = False) -> None:
    """An empty table of batches below ``path``; an existing one stays, or with ``reset`` starts anew."""
    spark.createDataFrame([], _LEDGER).write.mode("ignore").parquet(f"{path}/ledger")
    if reset:
        _enter(spark, path, None, None, reset=True)


def committed(spark: SparkSession, path: str) -> DataFrame:
    """batch and attempt of every batch since the last reset; the first commit of a batch counts."""
    entries = _ledger(spark, path)
    since = entries.filter("reset").agg(F.coalesce(F.max("committed_at"), F.lit("1970-01-01").cast("timestamp"))).scalar()
    return (
        entries.filter((~F.col("reset")) & (F.col("committed_at") >= since))
        .groupBy("batch")
        .agg(F.min_by("attempt", F.struct("committed_at", "attempt")).alias("attempt"))
    )


def append_batch(df: DataFrame, path: str, batch: str) -> bool:
    """Append the rows of a batch; False, and nothing written, if it has been committed."""
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
        raise ValueError(f"batch id {batch!r}: letters, digits, '_', '.' and '-' only")
    spark = df.sparkSession
    if not committed(spark, path).filter(F.col("batch") == batch).isEmpty():
        return False
    attempt = uuid.uuid4().hex
    df.write.parquet(f"{path}/rows/batch={batch}/attempt={attempt}")
    _enter(spark, path, batch, attempt)
    return True


def read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of all committed batches; folders of attempts that never committed are skipped."""
    chosen = committed(spark, path)
    if chosen.isEmpty():
        return spark.createDataFrame([], schema)
    parts = T.StructType([*schema.fields, T.StructField("batch", T.StringType()), T.StructField("attempt", T.StringType())])
    rows = spark.read.schema(parts).parquet(f"{path}/rows")
    return rows.join(chosen, ["batch", "attempt"], "left_semi").select(schema.names)
