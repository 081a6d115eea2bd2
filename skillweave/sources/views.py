"""Projections of the given tables into the roles that the operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import saved, spread, tasks_for

REQUIRED_CAP, FORMAL_CAP = 12, 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def level(quantity):
    return F.when(quantity >= 34, 3).when(quantity >= 17, 2).otherwise(1)


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("id"), F.col("text").alias("body"), F.col("source").alias("company"), F.col("lang").alias("domain"), F.date_add(F.lit("2023-01-01").cast("date"), (F.col("doc_id") * 37 % 500).cast("int")).alias("observed_on"))


def tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks for as many rows as there are line items (from the files' footers)."""
    return tasks_for(table(spark, sf_dir, "lineitem").count())


def retracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence that its seventh line retracts."""
    gone = table(spark, sf_dir, "lineitem").filter("l_linenumber = 7").select(F.col("l_orderkey").alias("evidence"))
    return spread(gone, tasks(spark, sf_dir), "evidence").distinct()


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their order's customer and date: mentions of a skill (part) by a source (customer) for a job (supplier)."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    n = tasks(spark, sf_dir)
    return spread(table(spark, sf_dir, "lineitem"), n, "l_orderkey").join(spread(orders, n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_suppkey").alias("job"), F.col("l_partkey").alias("skill"), F.col("o_custkey").alias("source"), F.col("l_orderkey").alias("evidence"), F.col("l_linenumber").alias("line"),
        F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.to_date("o_orderdate").alias("observed_on"), F.to_date("l_shipdate").alias("shipped_on"),
    )


def requirement_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(lines(spark, sf_dir), tasks(spark, sf_dir), "job", "skill").groupBy("job", "skill").agg(
        F.countDistinct("source").alias("n_sources"), F.max(level(F.col("quantity"))).alias("level"), F.sum((F.col("flag") == "N").cast("int")).alias("explicit"), F.count("*").alias("mentions"), F.max("quantity").alias("top_quantity"),
    )


def requirements(spark: SparkSession, sf_dir: str, stats: DataFrame | None = None) -> DataFrame:
    """job, skill, kind, level, n_sources, group_id, min_required: the ranked, capped and grouped requirement table, written once (FORMAL_CAP rows a job). stats: requirement_stats, where a caller has them."""
    stats = spread(requirement_stats(spark, sf_dir) if stats is None else stats, tasks(spark, sf_dir), "job")
    wants = F.col("explicit") * 2 >= F.col("mentions")
    order = [F.desc("n_sources"), F.desc("explicit"), F.desc("top_quantity"), "skill"]
    ranked = stats.withColumn("wants", wants.cast("int")).withColumn("rank", F.row_number().over(Window.partitionBy("job").orderBy(*order)))
    ranked = ranked.filter(F.col("rank") <= FORMAL_CAP).withColumn("nth", F.sum("wants").over(Window.partitionBy("job").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))
    kind = F.when((F.col("wants") == 1) & (F.col("nth") <= REQUIRED_CAP), "required").otherwise("bonus")
    rows = ranked.select("job", "skill", kind.alias("kind"), "level", "n_sources", "rank")
    brand = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("skill"), F.col("p_brand").alias("brand"))
    rows = rows.join(brand, "skill").withColumn("members", F.count("*").over(Window.partitionBy("job", "kind", "brand")))
    return saved(rows.select("job", "skill", "kind", "level", "n_sources", "rank", F.when(F.col("members") > 1, F.col("brand")).alias("group_id"), F.lit(1).alias("min_required")), "requirements")


REQUIREMENTS_SQL = """
ln AS (SELECT l_suppkey AS job, l_partkey AS skill, o_custkey AS source, l_orderkey AS evidence, l_linenumber AS line, l_quantity AS quantity,
              l_returnflag AS flag, l_linestatus AS status, CAST(o_orderdate AS DATE) AS observed_on, CAST(l_shipdate AS DATE) AS shipped_on
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
stats AS (SELECT job, skill, count(DISTINCT source) AS n_sources, max(CASE WHEN quantity >= 34 THEN 3 WHEN quantity >= 17 THEN 2 ELSE 1 END) AS level,
                 sum(CASE WHEN flag = 'N' THEN 1 ELSE 0 END) AS explicit, count(*) AS mentions, max(quantity) AS top_quantity FROM ln GROUP BY job, skill),
rk AS (SELECT *, CASE WHEN explicit * 2 >= mentions THEN 1 ELSE 0 END AS wants,
              row_number() OVER (PARTITION BY job ORDER BY n_sources DESC, explicit DESC, top_quantity DESC, skill) AS rank FROM stats),
nt AS (SELECT *, sum(wants) OVER (PARTITION BY job ORDER BY rank ROWS UNBOUNDED PRECEDING) AS nth FROM rk WHERE rank <= 24),
kd AS (SELECT job, skill, CASE WHEN wants = 1 AND nth <= 12 THEN 'required' ELSE 'bonus' END AS kind, level, n_sources, rank FROM nt),
req AS (SELECT job, skill, kind, level, n_sources, rank,
               CASE WHEN count(*) OVER (PARTITION BY job, kind, p_brand) > 1 THEN p_brand END AS group_id, 1 AS min_required
        FROM kd JOIN part ON p_partkey = skill)
"""


def resume_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(lines(spark, sf_dir).withColumnRenamed("source", "resume"), tasks(spark, sf_dir), "resume", "skill")
    return rows.groupBy("resume", "skill").agg(F.max(level(F.col("quantity"))).alias("held"))


RESUME_SQL = "rs AS (SELECT source AS resume, skill, max(CASE WHEN quantity >= 34 THEN 3 WHEN quantity >= 17 THEN 2 ELSE 1 END) AS held FROM ln GROUP BY source, skill)"


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirement versions with validity intervals. At most one version per job, skill and start."""
    item = table(spark, sf_dir, "lineitem")
    start = F.to_date("l_shipdate")
    end = F.when(F.col("l_linestatus") != "O", F.date_add(start, F.col("l_quantity").cast("int")))
    rows = item.select(F.col("l_suppkey").alias("job"), F.col("l_partkey").alias("skill"), start.alias("valid_from"), end.alias("valid_to"), (F.col("l_returnflag") == "R").alias("curation"), (F.col("l_linenumber") == 7).alias("retracted"), "l_orderkey", "l_linenumber")
    rows = spread(rows, tasks(spark, sf_dir), "job", "skill")
    first = F.row_number().over(Window.partitionBy("job", "skill", "valid_from").orderBy("l_orderkey", "l_linenumber"))
    return rows.withColumn("nth", first).filter("nth = 1").drop("nth", "l_orderkey", "l_linenumber")


HISTORY_SQL = """
hist AS (SELECT job, skill, valid_from, valid_to, curation, retracted FROM (
  SELECT l_suppkey AS job, l_partkey AS skill, CAST(l_shipdate AS DATE) AS valid_from,
         CASE WHEN l_linestatus <> 'O' THEN CAST(l_shipdate AS DATE) + CAST(l_quantity AS INTEGER) END AS valid_to,
         l_returnflag = 'R' AS curation, l_linenumber = 7 AS retracted,
         row_number() OVER (PARTITION BY l_suppkey, l_partkey, CAST(l_shipdate AS DATE) ORDER BY l_orderkey, l_linenumber) AS nth
  FROM lineitem) WHERE nth = 1)
"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    review = F.when(F.col("value") < 20, "pending").when(F.col("value") < 60, "approved").when(F.col("value") < 90, "auto_passed").otherwise("rejected")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("at"), F.col("event_type").alias("kind"), F.col("user_id").alias("job"), "value", F.col("props").alias("payload"), review.alias("review"))


EVENTS_SQL = """
ev AS (SELECT event_id AS id, ts AS ats, event_type AS kind, user_id AS job, value, props AS payload,
              CASE WHEN value < 20 THEN 'pending' WHEN value < 60 THEN 'approved' WHEN value < 90 THEN 'auto_passed' ELSE 'rejected' END AS review FROM events)
"""
