"""Streaming queries over the given tables, run to their end; the SQL states the batch result."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import views as v
from ..sources.shared import shared_path
from ..streaming import ingest


def drained(stream: DataFrame, mode: str, at: str) -> DataFrame:
    """Runs a stream over what there is and reads what it wrote."""
    spark = stream.sparkSession
    out = shared_path(spark, f"stream-{uuid.uuid4().hex[:12]}")
    writer = stream.writeStream.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", f"{out}/rows").outputMode("append").start().awaitTermination()
    else:
        def save(batch: DataFrame, n: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/rows")
        writer.outputMode("complete").foreachBatch(save).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = v.table(spark, sf_dir, "events")
    rows = spark.readStream.schema(table.schema).option("pathGlobFilter", "*.parquet").parquet(stream_folder(sf_dir, "events"))
    return rows.select(F.col("event_id").alias("id"), F.col("ts").alias("at"), F.col("event_type").alias("kind"), F.col("user_id").alias("job"), "value")


def stream_folder(sf_dir: str, name: str) -> str:
    """A glob that names the table alone, whether it is a file or a folder."""
    return f"{sf_dir}/{name}.parquet*"


def stream_event_windows(spark, sf_dir):
    """Counts by kind and hour, as a complete-mode aggregation."""
    rows = event_stream(spark, sf_dir).groupBy(F.window("at", "1 hour").alias("w"), "kind").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value")).select(F.col("w.start").alias("start"), "kind", "n", "value")
    return drained(rows, "complete", "start")


def stream_run_status(spark, sf_dir):
    """Days as runs: errors as failures, purchases as done portals, a sign-up as the end."""
    kind = F.when(F.col("kind") == "error", "failed").when(F.col("kind") == "purchase", "done").when(F.col("kind") == "signup", "finished").otherwise("other")
    rows = event_stream(spark, sf_dir).select(F.to_date("at").alias("run"), kind.alias("type"), F.lit(1).cast("long").alias("rows_read"), (F.col("value") > 50).cast("long").alias("ingested"))
    return drained(ingest.run_status(rows), "complete", "run")


def stream_ingest_dedup(spark, sf_dir):
    """The first event of each job and kind, within the watermark."""
    rows = event_stream(spark, sf_dir).withColumn("at", F.col("at").cast("timestamp")).withColumn("fingerprint", F.sha2(F.concat_ws("|", "job", "kind"), 256))
    return drained(ingest.fresh_postings(rows, at="at", late="60 days").select("fingerprint", "job", "kind"), "append", "at")


def stream_posting_state(spark, sf_dir):
    """Changes of each user's value band over time."""
    rows = event_stream(spark, sf_dir).select(F.col("job").cast("string").alias("posting"), F.col("at").alias("observed_at"), F.when(F.col("value") < 50, "low").otherwise("high").alias("body"))
    return drained(ingest.body_changes(rows), "append", "at")


QUERIES = {
    "stream_event_windows": (stream_event_windows, "SELECT date_trunc('hour', ts) AS start, event_type AS kind, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL"),
    "stream_run_status": (stream_run_status, """WITH r AS (SELECT CAST(ts AS DATE) AS run, count(*) FILTER (event_type = 'purchase') AS done, count(*) FILTER (event_type = 'error') AS failed, count(*) AS rows_read,
count(*) FILTER (value > 50) AS ingested, max(event_type = 'signup') AS ended FROM events GROUP BY 1) SELECT run, done, failed, rows_read, ingested, CASE WHEN NOT ended THEN 'running' WHEN failed > 0 THEN 'partial' ELSE 'finished' END AS state FROM r"""),
    "stream_ingest_dedup": (stream_ingest_dedup, "SELECT DISTINCT sha256(CAST(user_id AS VARCHAR) || '|' || event_type) AS fingerprint, user_id AS job, event_type AS kind FROM events"),
    "stream_posting_state": (stream_posting_state, """WITH b AS (SELECT CAST(user_id AS VARCHAR) AS posting, ts, md5(CASE WHEN value < 50 THEN 'low' ELSE 'high' END) AS body_hash FROM events),
l AS (SELECT *, lag(body_hash) OVER (PARTITION BY posting ORDER BY ts, body_hash) AS before FROM b)
SELECT posting, body_hash, row_number() OVER (PARTITION BY posting ORDER BY ts, body_hash) AS version FROM l WHERE before IS NULL OR before <> body_hash"""),
}
