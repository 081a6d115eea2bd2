"""Market views: boards, heat, feeds, review and pulse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def heat(requirements: DataFrame) -> DataFrame:
    """Percentage of jobs that ask for each skill, half to even."""
    jobs = requirements.agg(F.countDistinct("job").alias("jobs"))
    n = requirements.groupBy("skill").agg(F.countDistinct("job").alias("n"))
    return n.join(F.broadcast(jobs)).select("skill", "n", F.bround(100 * F.col("n") / F.col("jobs")).cast("long").alias("percent"))  # one row


def feed_groups(events: DataFrame, first: int = 6) -> DataFrame:
    """Events by day, job and review: how many, and the first kinds by id."""
    w = Window.partitionBy(F.to_date("at"), "job", "review").orderBy("id")
    rows = events.withColumn("day", F.to_date("at")).withColumn("nth", F.row_number().over(w))
    head = F.when(F.col("nth") <= first, F.struct("nth", "kind"))
    out = rows.groupBy("day", "job", "review").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(head)).alias("head"))
    return out.select("day", "job", "review", "n", F.array_join(F.col("head.kind"), ",").alias("kinds"))


def feed_totals(events: DataFrame) -> DataFrame:
    count = lambda r: F.sum((F.col("review") == r).cast("long")).alias(r)
    return events.groupBy("kind").agg(*[count(r) for r in ("pending", "approved", "auto_passed", "rejected")], F.count("*").alias("total"))


def review_stats(events: DataFrame, midnight: Column) -> DataFrame:
    """Decisions by review, all and since midnight, and the share approved of those approved or rejected by hand."""
    own = events.filter(F.col("review") != "pending")
    by = own.groupBy("review").agg(F.count("*").alias("total"), F.sum((F.col("at") >= midnight).cast("long")).alias("today"))
    rate = own.agg((F.sum((F.col("review") == "approved").cast("double")) / F.sum(F.col("review").isin("approved", "rejected").cast("double"))).alias("pass_rate"))
    return by.join(F.broadcast(rate)).select("review", "total", "today", F.round("pass_rate", 6).alias("pass_rate"))  # one row


def pulse(events: DataFrame, n: int = 40) -> DataFrame:
    """The newest events, one line each."""
    return events.orderBy(F.desc("at"), F.desc("id")).limit(n)


def quiet_runs(pages: DataFrame) -> DataFrame:
    """Runs of consecutive pages without a new row (pages: source, page, n_new): source, run length, first page."""
    w = Window.partitionBy("source").orderBy("page")
    rows = pages.withColumn("run", F.sum((F.col("n_new") > 0).cast("int")).over(w)).filter("n_new = 0")
    return rows.groupBy("source", "run").agg(F.count("*").alias("length"), F.min("page").alias("first_page")).drop("run")
