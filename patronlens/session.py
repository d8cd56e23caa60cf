"""Session settings that the jobs rely on."""

from __future__ import annotations

from math import ceil

from pyspark.sql import SparkSession

# Rows take about so many times the bytes of their parquet file. Spark judges by the file
# whether a table is small enough to be sent to every task.
FILE_COMPRESSION = "8.0"
# Shuffle partitions are cut for so many bytes of decoded input, and merged up to so many
# shuffled ones, which take some 20 times as much in sorts and hash maps.
INPUT_PER_PARTITION, SHUFFLED_PER_TASK = 32 << 20, 16 << 20
FILE_PER_TASK = 32 << 20  # bytes of files that one task scans, as scans feed hash maps too


def get_session(app_name: str = "patronlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs are tuned for.

    On a cluster leave ``master`` unset and call ``size_shuffles`` before a job; AQE merges
    small partitions and splits skewed join partitions.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.sources.fileCompressionFactor", FILE_COMPRESSION)
        .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(SHUFFLED_PER_TASK))
        .config("spark.sql.files.maxPartitionBytes", str(FILE_PER_TASK))
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def size_shuffles(spark: SparkSession, paths: list[str]) -> int:
    """Let the shuffle partitions follow the files in ``paths``, which a job is about to read.

    With a fixed number a task's sorts and hash maps grow with the tables. There are never
    fewer than ``spark.sql.shuffle.partitions``; AQE merges those that turn out small.
    """
    hadoop, total = spark.sparkContext._jsc.hadoopConfiguration(), 0
    for name in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        files = path.getFileSystem(hadoop)
        total += files.getContentSummary(path).getLength() if files.exists(path) else 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    partitions = max(least, ceil(total * float(FILE_COMPRESSION) / INPUT_PER_PARTITION))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", partitions)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", SHUFFLED_PER_TASK)
    spark.conf.set("spark.sql.files.maxPartitionBytes", FILE_PER_TASK)
    return partitions


def shuffle_partitions(spark: SparkSession) -> int:
    """Into how many parts a shuffle deals its rows before AQE merges any."""
    least = spark.conf.get("spark.sql.shuffle.partitions")
    return int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", least))
