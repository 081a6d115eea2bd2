"""Shared folder, tables written there, and partition counts."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where that is unset (tests on one machine) a new temporary folder takes its place.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Writes df as a table in the shared folder and reads it: cuts lineage, survives lost executors.

    Once it is written nothing reads the shuffles of its plan again, so their files go at once, not when the driver collects garbage.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    writer = df.write.partitionBy(*by) if by else df.write
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def n_partitions(df: DataFrame, column: str, mb: int) -> int:
    """How many partitions of about mb MB the bytes of a text column fill."""
    total = df.agg(F.sum(F.octet_length(column).cast("long"))).first()[0] or 0
    return max(1, -(-total // (mb << 20)))


def give_back() -> None:
    """Hands free memory back to the system. Python workers live on after a task, beside the next stage's tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(scan):
    """A function on the batches of a task that gives memory back when the task is done."""

    @functools.wraps(scan)
    def run(batches):
        try:
            yield from scan(batches)
        finally:
            give_back()

    return run


def lower_ascii(text):
    """Lower-cases A-Z only; the JVM's lower() serves texts that are all ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
