"""Evidence, votes and status: when a mention becomes a requirement, and a cluster an occupation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import spread

#: Fixed values of the rules.
WINDOW_DAYS, LONG_SPAN_DAYS = 90, 180
EMERGING_SOURCES, FORMED_SOURCES = 3, 10
POOL_SHARE, VOTE_SHARE, VOTE_SOURCES = 0.30, 0.60, 2


def source_stats(evidence: DataFrame) -> DataFrame:
    """job, n_window, n_total, span_days of evidence(job, source, observed_on): sources within 90 days of the job's own latest date, all, and the span."""
    latest = evidence.groupBy("job").agg(F.max("observed_on").alias("latest"))
    rows = evidence.join(latest, "job")
    recent = F.when(F.col("observed_on") >= F.date_sub("latest", WINDOW_DAYS), F.col("source"))
    return rows.groupBy("job").agg(F.countDistinct(recent).alias("n_window"), F.countDistinct("source").alias("n_total"), F.datediff(F.max("observed_on"), F.min("observed_on")).alias("span_days"))


def status(n_window: Column, n_total: Column, span: Column, judged: Column, defined: Column, alias: Column) -> Column:
    formed = defined & ((n_total >= FORMED_SOURCES) | (span >= LONG_SPAN_DAYS))
    return F.when(alias | ~judged, "candidate").when(formed, "formed").when(n_window >= EMERGING_SOURCES, "emerging").otherwise("candidate")


def roll_up(mentions: DataFrame, tasks: int | None = None) -> DataFrame:
    """Per (job, skill): evidence, sources, best confidence, the last excerpt by date, of mentions(job, skill, evidence, source, confidence, excerpt, observed_on, line)."""
    rows = spread(mentions.select("job", "skill", "evidence", "source", "confidence", "excerpt", "observed_on", "line"), tasks, "job", "skill")
    return rows.groupBy("job", "skill").agg(F.countDistinct("evidence").alias("n_evidence"), F.countDistinct("source").alias("n_sources"), F.max("confidence").alias("confidence"), F.max_by("excerpt", F.struct("observed_on", "evidence", "line")).alias("excerpt"))


def evidence_sizes(mentions: DataFrame, *by: str) -> DataFrame:
    """by, size: the distinct evidence of each group. Equal rows go before the groups are counted, so no group is one task's work."""
    return mentions.select(*by, "evidence").distinct().groupBy(*by).agg(F.count("evidence").alias("size"))


def pooled(rolled: DataFrame, sizes: DataFrame) -> DataFrame:
    """Coverage of each skill in its job's cluster (sizes: job, size), and whether that pools it."""
    share = F.col("n_evidence") / F.col("size")
    return rolled.join(sizes, "job").withColumn("coverage", F.round(share, 6)).withColumn("pooled", share >= POOL_SHARE)


def vote_counts(votes: DataFrame, tasks: int | None, counted: dict[str, Column]) -> DataFrame:
    """Per (job, skill) a struct of counts and kind for each set of votes (its name and a condition on r, source, gone): one vote per evidence, the strongest.

    Sources are counted by grouping twice, so no row is copied once per count."""
    rank = F.when(F.col("vote") == "required", 2).when(F.col("vote") == "bonus", 1).otherwise(0)
    marks = [F.max("gone").alias("gone")] if "gone" in votes.columns else []
    rows = spread(votes.select("job", "skill", "evidence", "source", rank.alias("r"), *(["gone"] if marks else [])), tasks, "job", "skill")
    best = rows.groupBy("job", "skill", "evidence").agg(F.max("r").alias("r"), F.min("source").alias("source"), *marks)
    n = lambda name, k: F.sum((counted[name] & (F.col("r") == k)).cast("int")).alias(f"{name}_{k}")
    each = best.groupBy("job", "skill", "source").agg(*[n(name, k) for name in counted for k in (0, 1, 2)])
    srcs = lambda c: F.sum(((F.col(c) > 0) & F.col("source").isNotNull()).cast("int")).alias(f"s_{c}")
    out = each.groupBy("job", "skill").agg(*[f for name in counted for k in (0, 1, 2) for f in (F.sum(f"{name}_{k}").alias(f"{name}_{k}"), srcs(f"{name}_{k}"))])

    def kind(name: str) -> Column:
        total = F.col(f"{name}_2") + F.col(f"{name}_1")
        wins = lambda k: (total > 0) & (F.col(f"{name}_{k}") >= VOTE_SHARE * total) & (F.col(f"s_{name}_{k}") >= VOTE_SOURCES)
        return F.when(wins(2), "required").when(wins(1), "bonus")

    parts = lambda name: F.struct(F.col(f"{name}_2").alias("required"), F.col(f"{name}_1").alias("bonus"), F.col(f"{name}_0").alias("unmarked"), F.col(f"s_{name}_2").alias("s_required"), F.col(f"s_{name}_1").alias("s_bonus"), kind(name).alias("kind"))
    return out.select("job", "skill", *[parts(name).alias(name) for name in counted])


def vote_summary(votes: DataFrame, tasks: int | None = None) -> DataFrame:
    """The kind that votes (job, skill, evidence, source, vote) give: one vote per evidence, the strongest; then 60 % of the classified and two sources."""
    return vote_counts(votes.select("job", "skill", "evidence", "source", "vote"), tasks, {"every": F.lit(True)}).select("job", "skill", "every.*")


def layer(excerpt: Column, n_sources: Column, confidence: Column) -> Column:
    """Confidence layer; without an excerpt it is low."""
    return F.when(F.coalesce(excerpt, F.lit("")) == "", "low").when((n_sources >= 3) & (confidence >= 0.8), "high").when((n_sources >= 2) & (confidence >= 0.5), "mid").otherwise("low")


def majority(rows: DataFrame, by: str, value: str, order: str) -> DataFrame:
    """The most common non-empty value per key; of equals the one seen first."""
    counts = rows.filter(F.coalesce(F.col(value), F.lit("")) != "").groupBy(by, value).agg(F.count("*").alias("n"), F.min(order).alias("seen"))
    return counts.groupBy(by).agg(F.max_by(value, F.struct("n", -F.col("seen"))).alias(value), F.max("n").alias("n"))


def revote(votes: DataFrame, retracted: DataFrame, tasks: int | None = None) -> DataFrame:
    """Facts whose kind changes when retracted evidence no longer votes. Both votes are counted in one pass over the rows."""
    gone = retracted.select("evidence").distinct().withColumn("gone", F.lit(True))
    marked = votes.join(gone, "evidence", "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
    both = vote_counts(marked, tasks, {"before": F.lit(True), "after": ~F.col("gone")})
    known = F.col("job").isNotNull() & F.col("skill").isNotNull()
    rows = both.select("job", "skill", F.col("before.kind").alias("kind_before"), F.when(known, F.col("after.kind")).alias("kind_after"))
    return rows.filter(~F.col("kind_before").eqNullSafe(F.col("kind_after")))


def review_effects(proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """The effective review of proposals(id, layer, kind, n_sources, excerpt) under decisions(id, review, decided_at): the last decision wins; without
    one, a high layer with an excerpt and three sources passes by itself, unless its vote is unresolved."""
    last = decisions.groupBy("id").agg(F.max_by("review", "decided_at").alias("decided"))
    own = (F.col("layer") == "high") & (F.coalesce("excerpt", F.lit("")) != "") & (F.col("n_sources") >= 3) & F.col("kind").isNotNull()
    return proposals.join(last, "id", "left").withColumn("review", F.coalesce("decided", F.when(own, "auto_passed").otherwise("pending"))).drop("decided")


def first_per_source(rows: DataFrame, order: list[str]) -> DataFrame:
    w = Window.partitionBy("job", "source").orderBy(*order)
    return rows.withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth")


def alternative_pairs(mentions: DataFrame, least_share: float = 0.3, most_meet: float = 0.1) -> DataFrame:
    """Pairs of skills of a job in mentions(job, skill, evidence) that rarely meet in one evidence but together cover much: candidates for one group."""
    n = mentions.groupBy("job", "skill").agg(F.count("*").alias("n"))
    size = evidence_sizes(mentions, "job")
    one, two = (mentions.select("job", F.col("skill").alias(f"skill_{s}"), "evidence") for s in (1, 2))
    both = one.join(two, ["job", "evidence"]).filter("skill_1 < skill_2").groupBy("job", "skill_1", "skill_2").agg(F.count("*").alias("meet"))
    a, b = (n.select("job", F.col("skill").alias(f"skill_{s}"), F.col("n").alias(f"n_{s}")) for s in (1, 2))
    pairs = a.join(b, "job").filter("skill_1 < skill_2").join(both, ["job", "skill_1", "skill_2"], "left").join(size, "job")
    meet = F.coalesce("meet", F.lit(0))
    share = (F.col("n_1") + F.col("n_2") - meet) / F.col("size")
    return pairs.filter((share >= least_share) & (meet <= most_meet * F.least("n_1", "n_2"))).select("job", "skill_1", "skill_2", meet.alias("meet"), F.round(share, 6).alias("coverage"))
