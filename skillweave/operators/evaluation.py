"""Set-based evaluation, stratified gold samples, adjudication."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def set_f1(predicted: DataFrame, gold: DataFrame, items: DataFrame) -> DataFrame:
    """Precision, recall and F1 per item of items(item), from sets (item, element). Two empty sets agree, an empty and a full one don't at all."""
    p, g = predicted.select("item", "element").distinct().withColumn("p", F.lit(1)), gold.select("item", "element").distinct().withColumn("g", F.lit(1))
    counts = p.join(g, ["item", "element"], "full").groupBy("item").agg(F.count("p").alias("n_pred"), F.count("g").alias("n_gold"), F.sum((F.col("p") + F.col("g")) / 2).alias("common"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    both, n_pred, n_gold = z("common"), z("n_pred"), z("n_gold")
    f1 = F.when((n_pred == 0) & (n_gold == 0), 1.0).when((n_pred == 0) | (n_gold == 0), 0.0).otherwise(2 * both / (n_pred + n_gold))
    return items.select("item").distinct().join(counts, "item", "left").select("item", n_pred.cast("long").alias("n_pred"), n_gold.cast("long").alias("n_gold"), both.cast("long").alias("common"), F.round(f1, 6).alias("f1"))


def macro(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.round(F.avg("f1"), 6).alias("macro_f1"), F.count("*").alias("n"))


def stratified(rows: DataFrame, quotas: dict[str, int], per_name: int, total: int) -> DataFrame:
    """A gold sample of rows(id, name, domain, ord): the first per_name of each name, the first of each domain to its quota, then
    others in order until total."""
    quota = F.lit(0)
    for domain, n in quotas.items():
        quota = F.when(F.col("domain") == domain, n).otherwise(quota)
    named = rows.withColumn("nth", F.row_number().over(Window.partitionBy("name").orderBy("ord"))).filter(F.col("nth") <= per_name)
    chosen = named.withColumn("nth", F.row_number().over(Window.partitionBy("domain").orderBy("ord"))).filter(F.col("nth") <= quota).select("id", F.lit("quota").alias("why"), "ord")
    rest = rows.join(chosen, "id", "left_anti").select("id", F.lit("fill").alias("why"), "ord")
    both = chosen.unionByName(rest).orderBy(F.when(F.col("why") == "quota", 0).otherwise(1), "ord").limit(total)
    return both.select("id", "why")


def adjudicate(gold: DataFrame, draft: DataFrame, mentioned: DataFrame) -> DataFrame:
    """What to look at, per (item, element): gold that the text bears out is kept, other gold is suspect, drafts that gold lacks are proposals."""
    g, d, m = (x.select("item", "element").distinct().withColumn(n, F.lit(1)) for x, n in ((gold, "g"), (draft, "d"), (mentioned, "m")))
    both = g.join(d, ["item", "element"], "full").join(m, ["item", "element"], "left")
    state = F.when(F.col("g").isNotNull() & F.col("m").isNotNull(), "kept").when(F.col("g").isNotNull(), "suspect").otherwise("proposal")
    return both.select("item", "element", state.alias("state"))
