"""Tables in the folder that the cluster names; a temporary one only where none is named."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows that one task sorts or keeps in hash tables, where a step has almost as many keys as rows.
ROWS_PER_TASK = 250_000


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", named)
    return f"{named.rstrip('/')}/{name}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it: cuts lineage, survives lost executors, runs the plan once."""
    path = shared_path(df.sparkSession, f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks_for(rows: int) -> int:
    """Tasks for so many rows: their number grows with the table, so the memory of one of them doesn't."""
    return max(1, -(-rows // ROWS_PER_TASK))


def spread(rows: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """Rows dealt out by keys to so many tasks; what is grouped, joined or ranked by these keys or more needs no other shuffle then.

    Small tables, and rows of unknown number (None), stay as they are."""
    return rows.repartition(tasks, *keys) if tasks and tasks > rows.sparkSession.sparkContext.defaultParallelism else rows
