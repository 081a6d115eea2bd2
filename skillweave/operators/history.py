"""Versioned requirement facts: SCD-2 application, expiry, chains, deltas, slices.

A version row is (job, skill, valid_from, valid_to, curation, retracted, ...); valid_to null means open.
Writers give whole new states; a caller writes them to a new folder and moves a pointer, so readers never see half a state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import spread
from .votes import evidence_sizes

KEY = ["job", "skill"]


def signature(columns: list[str]) -> Column:
    """Content identity of a version: the hash of its business columns."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256), 1, 24)


def apply_versions(current: DataFrame, proposed: DataFrame, business: list[str]) -> DataFrame:
    """SCD-2: current open rows and proposals (KEY, business columns, valid_from) to the next state with an ``op``:
    kept, closed (a change: valid_to is the later of both starts), opened (new or changed), same (proposal repeats the current row).
    """
    cur = current.withColumn("sig", signature(business))
    new = proposed.withColumn("sig", signature(business))
    left = cur.select(*KEY, *[F.col(c).alias(f"c_{c}") for c in (*business, "sig", "valid_from")])
    right = new.select(*KEY, *[F.col(c).alias(f"n_{c}") for c in (*business, "sig", "valid_from")])
    both = left.join(right, KEY, "full")
    change = F.col("c_sig").isNotNull() & F.col("n_sig").isNotNull() & (F.col("c_sig") != F.col("n_sig"))
    old = both.filter("c_sig is not null").select(*KEY, *[F.col(f"c_{c}").alias(c) for c in business], F.col("c_valid_from").alias("valid_from"), F.when(change, F.greatest("c_valid_from", "n_valid_from")).alias("valid_to"), F.when(change, "closed").when(F.col("n_sig").isNotNull(), "same").otherwise("kept").alias("op"))
    opened = both.filter(F.col("n_sig").isNotNull() & (F.col("c_sig").isNull() | change)).select(*KEY, *[F.col(f"n_{c}").alias(c) for c in business], F.col("n_valid_from").alias("valid_from"), F.lit(None).cast(dict(current.dtypes)["valid_from"]).alias("valid_to"), F.lit("opened").alias("op"))
    return old.unionByName(opened)


def expire_absent(current: DataFrame, keep: DataFrame, at: DataFrame) -> DataFrame:
    """Closes open rows whose (job, skill) isn't in keep, at the job's date (at: job, at), if they began by then. A job without any kept row loses nothing."""
    having = keep.select("job").distinct().withColumn("any_kept", F.lit(True))
    marked = current.join(keep.select(*KEY).distinct().withColumn("is_kept", F.lit(True)), KEY, "left").join(having, "job", "left").join(at, "job", "left")
    close = F.col("valid_to").isNull() & F.col("is_kept").isNull() & F.coalesce("any_kept", F.lit(False)) & (F.col("valid_from") <= F.col("at"))
    return marked.withColumn("expired", F.coalesce(close, F.lit(False))).withColumn("valid_to", F.when(F.col("expired"), F.col("at")).otherwise(F.col("valid_to"))).drop("is_kept", "any_kept", "at")


def chains(versions: DataFrame) -> DataFrame:
    """Numbers each skill's chains: a version continues one if it starts by the previous version's end, or that is open."""
    w = Window.partitionBy(*KEY).orderBy("valid_from")
    previous = F.lag("valid_to").over(w)
    fresh = F.when(F.lag("valid_from").over(w).isNull(), 1).when(previous.isNull() | (F.col("valid_from") <= previous), 0).otherwise(1)
    return versions.withColumn("fresh", fresh).withColumn("chain", F.sum("fresh").over(w)).drop("fresh")


def chain_spans(versions: DataFrame) -> DataFrame:
    """One row per chain: its first start, the end of its last version, whether it is curation alone, and whether its tail was closed by curation."""
    last = F.max_by(F.struct("valid_to", "curation"), "valid_from")
    out = chains(versions).groupBy(*KEY, "chain").agg(F.min("valid_from").alias("start"), last.alias("last"), F.min("curation").alias("curated"), F.count("*").alias("versions"))
    return out.select(*KEY, "chain", "start", F.col("last.valid_to").alias("stop"), "curated", F.col("last.curation").alias("tail_curated"), "versions")


def period_delta(versions: DataFrame) -> DataFrame:
    """Skills added to and expired from each job in the natural quarter of its latest date. Only a skill's newest chain
    counts; chains of curation alone, curated tails and retracted versions don't."""
    spans = chain_spans(versions.filter(~F.col("retracted")))
    newest = spans.withColumn("top", F.max("chain").over(Window.partitionBy(*KEY))).filter("chain = top and not curated")
    stamps = newest.withColumn("stamp", F.greatest("start", "stop"))
    quarter = F.trunc(F.max("stamp").over(Window.partitionBy("job")), "quarter")
    rows = stamps.withColumn("quarter", quarter)
    inside = lambda c: (F.col(c) >= F.col("quarter")) & (F.col(c) < F.add_months("quarter", 3))
    change = F.when(F.col("stop").isNotNull() & inside("stop") & ~F.col("tail_curated"), "expired").when(F.col("stop").isNull() & inside("start"), "added")
    return rows.withColumn("change", change).filter("change is not null").select("job", "quarter", "skill", "change")


def as_of(versions: DataFrame, day: Column) -> DataFrame:
    """Versions valid on a day."""
    return versions.filter((F.col("valid_from") <= day) & (F.col("valid_to").isNull() | (day < F.col("valid_to"))))


def assemble(versions: DataFrame, evidence: DataFrame, retracted: DataFrame, tasks: int | None = None) -> DataFrame:
    """Open versions with evidence(job, skill, evidence) that isn't among retracted(evidence); one retracted source takes the version out."""
    bad = spread(evidence.join(retracted, "evidence", "left_semi").select(*KEY), tasks, *KEY).distinct()
    sources = spread(evidence, tasks, *KEY).groupBy(*KEY).agg(F.countDistinct("evidence").alias("n_evidence"))
    return versions.filter("valid_to is null and not retracted").join(bad, KEY, "left_anti").join(sources, KEY, "left").withColumn("n_evidence", F.coalesce("n_evidence", F.lit(0)))


def coverage_shift(mentions: DataFrame, low: float = 0.15, high: float = 0.30, tasks: int | None = None) -> DataFrame:
    """Coverage of each (job, skill) per quarter (mentions: job, skill, evidence, observed_on), its change, and whether it crosses low to high."""
    rows = mentions.withColumn("quarter", F.trunc("observed_on", "quarter"))
    size = spread(evidence_sizes(rows, "job", "quarter"), tasks, "job", "quarter")
    each = spread(rows.select(*KEY, "quarter", "evidence"), tasks, *KEY).groupBy(*KEY, "quarter").agg(F.countDistinct("evidence").alias("n"))
    each = spread(spread(each, tasks, "job", "quarter").join(size, ["job", "quarter"]).withColumn("coverage", F.col("n") / F.col("size")), tasks, *KEY)
    before = F.coalesce(F.lag("coverage").over(Window.partitionBy(*KEY).orderBy("quarter")), F.lit(0.0))
    out = each.withColumn("before", before)
    return out.select(*KEY, "quarter", F.round("coverage", 6).alias("coverage"), F.round(F.col("coverage") - F.col("before"), 6).alias("shift"), ((F.col("before") < low) & (F.col("coverage") >= high)).alias("crossed"))


def merge_skills(rows: DataFrame, merged: DataFrame) -> DataFrame:
    """Rows with merged(old, canonical) skills under their canonical name."""
    return rows.join(merged.select(F.col("old").alias("skill"), "canonical"), "skill", "left").withColumn("skill", F.coalesce("canonical", "skill")).drop("canonical")


def latest_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Upsert by key: of several rows the last by order."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth")
