"""Evaluation runs: a frozen configuration whose hash the result carries, tasks scored in one table, and the summary of a run.

A run reads its threshold from the frozen file alone. predicted and gold are (task, item, element), items is (task, item); all tasks are scored in one pass, whose
counts combine before they shuffle. Defined results: null and blank elements count for nothing, repeated ones once; sets of items that ``items`` lacks are left
out; two empty sets agree, an empty and a full one don't at all; a task without items, and one of another mode (trial or real), has no figures and is ``missing``.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

TASKS, LEAST = ("extraction", "profile", "match"), 0.90
SETTINGS = "align_threshold double, model string, date string"


def freeze(spark: SparkSession, settings: dict, path: str) -> None:
    """Writes the settings as one line of JSON, keys in order. A path that exists is an error: what is frozen isn't written again."""
    spark.range(1).select(F.lit(json.dumps(settings, sort_keys=True, ensure_ascii=False)).alias("value")).coalesce(1).write.mode("error").text(path)


def frozen(spark: SparkSession, path: str) -> Row:
    """align_threshold, model, date and the hash of the file's bytes. Fails unless path holds one file with a threshold from 0 to 1."""
    told = F.from_json(F.col("content").cast("string"), SETTINGS)
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").load(path).filter("length > 0").select(told.alias("c"), F.sha2("content", 256).alias("hash")).select("c.*", "hash").limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"a frozen configuration is one file: {path}")
    if rows[0].align_threshold is None or not 0 <= rows[0].align_threshold <= 1:
        raise ValueError(f"no threshold from 0 to 1 in {path}")
    return rows[0]


def borne_out(predicted: DataFrame, mentions: DataFrame, task: str) -> DataFrame:
    """Predictions, of ``task`` only those that mentions(item, element) of the item's own text bear out."""
    own = mentions.select(F.lit(task).alias("task"), "item", "element").distinct()
    return predicted.filter(F.col("task") != task).unionByName(predicted.filter(F.col("task") == task).join(own, ["task", "item", "element"], "left_semi"))


def scores(items: DataFrame, predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """task, item, n_pred, n_gold, common, precision, recall, f1."""
    side = lambda df, p: df.filter(F.trim("element") != "").select("task", "item", "element", F.lit(p).alias("p"), F.lit(1 - p).alias("g"))
    each = side(predicted, 1).unionByName(side(gold, 0)).groupBy("task", "item", "element").agg(F.max("p").alias("p"), F.max("g").alias("g"))
    counts = each.groupBy("task", "item").agg(F.sum("p").alias("n_pred"), F.sum("g").alias("n_gold"), F.sum(F.col("p") * F.col("g")).alias("common"))
    rows = items.select("task", "item").distinct().join(counts, ["task", "item"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    rows = rows.select("task", "item", zero("n_pred"), zero("n_gold"), zero("common"))
    neither = (F.col("n_pred") == 0) & (F.col("n_gold") == 0)
    share = lambda of: F.when(neither, 1.0).when(of == 0, 0.0).otherwise(F.col("common") / of)
    return rows.withColumn("precision", share(F.col("n_pred"))).withColumn("recall", share(F.col("n_gold"))).withColumn("f1", share((F.col("n_pred") + F.col("n_gold")) / 2))


def task_means(rows: DataFrame, mock: bool = False) -> DataFrame:
    """task, precision, recall, f1, n, mock: unweighted means over a task's items."""
    return rows.groupBy("task").agg(*(F.avg(c).alias(c) for c in ("precision", "recall", "f1")), F.count("*").alias("n")).withColumn("mock", F.lit(mock))


def figure(value: Column, n: Column, state: Column) -> Column:
    return F.when(state == "missing", "no figures").otherwise(F.concat(F.format_number(value, 3), F.lit(" of "), n.cast("string")))


def summary(means: DataFrame, path: DataFrame, config: Row, tasks: tuple[str, ...] = TASKS, least: float = LEAST, mock: bool = False) -> DataFrame:
    """place, name, precision, recall, f1, n, state, line, hash: a row per task of ``tasks`` and a last one, path: of path(valid) the share with an address.

    A task's state is passed (f1 at least ``least``), low or missing; that of path is whole, partial or missing (no rows). Every row carries the hash of the configuration."""
    spark = means.sparkSession
    wanted = spark.range(len(tasks)).select((F.col("id") + 1).alias("place"), F.element_at(F.array(*map(F.lit, tasks)), (F.col("id") + 1).cast("int")).alias("task"))
    rows = wanted.join(means.filter(F.col("mock") == mock), "task", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rows = rows.withColumn("state", F.when(F.col("n") == 0, "missing").when(F.col("f1") >= least, "passed").otherwise("low"))
    of = path.agg(F.count("*").alias("n"), F.avg(F.coalesce("valid", F.lit(False)).cast("int")).alias("f1"))
    none, state = F.lit(None).cast("double"), F.when(F.col("n") == 0, "missing").when(F.col("f1") == 1, "whole").otherwise("partial")
    last = of.select(F.lit(len(tasks) + 1).cast("long").alias("place"), F.lit("path").alias("task"), none.alias("precision"), none.alias("recall"), "f1", "n", state.alias("state"))
    columns = ["place", "task", "precision", "recall", "f1", "n", "state"]
    both = rows.select(*columns).unionByName(last.select(*columns))
    rounded = [F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")]
    line = F.concat_ws(" ", "task", figure(F.col("f1"), F.col("n"), F.col("state")), "state")
    return both.select("place", F.col("task").alias("name"), *rounded, "n", "state", line.alias("line"), F.lit(config.hash).alias("hash"))
