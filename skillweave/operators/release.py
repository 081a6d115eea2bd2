"""Release gates, ranking under caps, immutable releases."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

REQUIRED_CAP, FORMAL_CAP = 12, 24


def equivalent_count(rows: DataFrame, kinds: list[str]) -> DataFrame:
    """Per job: distinct standalone skills plus the groups' minima."""
    own = rows.filter(F.col("kind").isin(kinds))
    alone = own.filter("group_id is null").groupBy("job").agg(F.countDistinct("skill").alias("n"))
    groups = own.filter("group_id is not null").groupBy("job", "kind", "group_id").agg(F.max("min_required").alias("n")).groupBy("job").agg(F.sum("n").alias("n"))
    return alone.unionByName(groups).groupBy("job").agg(F.sum("n").alias("n"))


def gate_errors(rows: DataFrame, previous: DataFrame, overrides: DataFrame) -> DataFrame:
    """job, code, detail of every failed check. Overrides (job) clear growth anomalies alone, never the caps."""
    required, formal = equivalent_count(rows, ["required"]), equivalent_count(rows, ["required", "bonus"])
    out = [
        required.filter(F.col("n") > REQUIRED_CAP).select("job", F.lit("required_over_cap").alias("code"), F.col("n").cast("long").alias("detail")),
        formal.filter(F.col("n") > FORMAL_CAP).select("job", F.lit("formal_over_cap").alias("code"), F.col("n").cast("long").alias("detail")),
        rows.groupBy("job", "skill").count().filter("count > 1").groupBy("job").agg(F.count("*").alias("detail")).select("job", F.lit("duplicate_requirement").alias("code"), "detail"),
        inconsistent_groups(rows).groupBy("job").agg(F.count("*").alias("detail")).select("job", F.lit("inconsistent_group").alias("code"), "detail"),
    ]
    for kinds, name, floor in ((["required"], "required_growth", 3), (["required", "bonus"], "formal_growth", 5)):
        now, was = equivalent_count(rows, kinds), equivalent_count(previous, kinds).withColumnRenamed("n", "was")
        grown = now.join(was, "job").withColumn("detail", (F.col("n") - F.col("was")).cast("long")).filter(F.col("detail") > F.greatest(F.lit(floor), F.col("was") * 0.5))
        out.append(grown.join(overrides, "job", "left_anti").select("job", F.lit(name).alias("code"), "detail"))
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return whole


def inconsistent_groups(rows: DataFrame) -> DataFrame:
    """Groups with more than one kind or minimum, or a minimum outside 1 and their size."""
    g = rows.filter("group_id is not null").groupBy("job", "group_id").agg(F.countDistinct("kind").alias("kinds"), F.min("min_required").alias("low"), F.max("min_required").alias("high"), F.countDistinct("skill").alias("size"))
    return g.filter("kinds > 1 or low <> high or low < 1 or high > size")


def rank_within_caps(stats: DataFrame, order: list, required_cap: int = REQUIRED_CAP, formal_cap: int = FORMAL_CAP) -> DataFrame:
    """Of stats(job, skill, wants 0/1, ...) the best formal_cap rows per job; wanted ones past the required cap become bonus."""
    ranked = stats.withColumn("rank", F.row_number().over(Window.partitionBy("job").orderBy(*order))).filter(F.col("rank") <= formal_cap)
    nth = F.sum("wants").over(Window.partitionBy("job").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("kind", F.when((F.col("wants") == 1) & (nth <= required_cap), "required").otherwise("bonus"))


def select_within_budget(units: DataFrame, required_cap: int = REQUIRED_CAP, formal_cap: int = FORMAL_CAP) -> DataFrame:
    """Greedy selection of units(job, unit, place, cost, wants) in order of place: one that does not fit is skipped, a wanted one that
    only fits as bonus is demoted. A job has at most some hundreds of units, so one job is one group."""
    import pandas as pd

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        required = formal = 0
        out = []
        for r in rows.sort_values(["place", "unit"], kind="stable").itertuples():
            if formal + r.cost > formal_cap:
                continue
            as_required = r.wants == 1 and required + r.cost <= required_cap
            required += r.cost if as_required else 0
            formal += r.cost
            out.append((r.job, r.unit, "required" if as_required else "bonus", formal))
        return pd.DataFrame(out, columns=["job", "unit", "kind", "formal"])

    return units.select("job", "unit", "place", "cost", "wants").groupBy("job").applyInPandas(pick, "job long, unit string, kind string, formal long")


def repair_groups(rows: DataFrame, action: str, least: int = 1, kind: str = "required") -> DataFrame:
    """Groups of rows(job, skill, kind, group_id, min_required) repaired: split_by_kind, set_kind, set_min_required or dissolve."""
    grouped = F.col("group_id").isNotNull()
    if action == "split_by_kind":
        return rows.withColumn("group_id", F.when(grouped, F.concat_ws(":", "group_id", "kind")))
    if action == "set_kind":
        return rows.withColumn("kind", F.when(grouped, F.lit(kind)).otherwise(F.col("kind")))
    if action == "set_min_required":
        size = F.count("*").over(Window.partitionBy("job", "group_id"))
        return rows.withColumn("min_required", F.when(grouped, F.least(F.lit(least), size).cast("int")).otherwise(F.col("min_required")))
    if action == "dissolve":
        return rows.withColumn("group_id", F.lit(None).cast("string")).withColumn("min_required", F.lit(1))
    raise ValueError(action)


def definition_passed(claims: DataFrame) -> DataFrame:
    """Whether a job has claims(job, claim, type, n_sources) and each has two sources, a scenario one."""
    need = F.when(F.col("type") == "scenario", 1).otherwise(2)
    return claims.groupBy("job").agg(F.count("*").alias("n_claims"), F.min(F.col("n_sources") >= need).alias("passed"))


def missing_endpoints(edges: DataFrame, column: str, nodes: DataFrame, key: str) -> DataFrame:
    """Edges whose end is no node."""
    return edges.join(nodes.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def publish(spark: SparkSession, tables: dict[str, DataFrame], root: str, period: str, expected: int | None = None) -> str:
    """Writes the tables as an immutable release named by its content, then appends it to the release log. The same content gives the same release, which is never
    written twice: a reader of it is not disturbed."""
    parts = []
    for name, rows in sorted(tables.items()):
        h = rows.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*rows.columns)).alias("h")).first()
        parts.append(f"{name}:{h['n']}:{h['h']}")
    release = spark.range(1).select(F.substring(F.sha2(F.lit(f"{period}|{'|'.join(parts)}"), 256), 1, 16).alias("id")).first()["id"]
    for name, rows in tables.items():
        at = f"{root}/release_id={release}/{name}"
        if not _exists(spark, f"{at}/_SUCCESS"):
            rows.write.mode("overwrite").parquet(at)
    point(spark, root, release, expected=expected)
    return release


class ReleaseConflict(RuntimeError):
    """Another writer has moved the log on."""


def _path(spark: SparkSession, uri: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, uri: str) -> bool:
    path, fs = _path(spark, uri)
    return fs.exists(path)


LOG = "seq long, release_id string, action string"


def release_log(spark: SparkSession, root: str) -> DataFrame:
    """seq, release_id, action: every publication and rollback, an entry each."""
    if not _exists(spark, f"{root}/pointer"):
        return spark.createDataFrame([], LOG)
    return spark.read.schema(LOG).json(f"{root}/pointer").filter("seq is not null")


def point(spark: SparkSession, root: str, release: str, action: str = "publish", expected: int | None = None) -> int:
    """Appends an entry to the log and returns its number; nothing is overwritten, so a reader always finds a release.

    expected: the last entry that the caller knows of; if the log has moved on, or another writer takes the same number, ReleaseConflict is raised. That a number is taken
    once rests on the file system, which creates a file that must not exist in one step (local ones and HDFS do). An entry whose writer died before its line was
    written is empty: it holds its number and counts for nothing.
    """
    path, fs = _path(spark, f"{root}/pointer")
    taken = [int(f.getPath().getName()) for f in fs.listStatus(path) if f.getPath().getName().isdigit()] if fs.exists(path) else []
    last = max(taken, default=0)
    if expected is not None and last != expected:
        raise ReleaseConflict(f"the log is at {last}, not at {expected}")
    entry, _ = _path(spark, f"{root}/pointer/{last + 1:012d}")
    try:
        out = fs.create(entry, False)
    except Exception as error:
        if fs.exists(entry):
            raise ReleaseConflict(f"entry {last + 1} is taken") from error
        raise
    try:
        out.write(bytearray((json.dumps({"seq": last + 1, "release_id": release, "action": action}) + "\n").encode()))
    finally:
        out.close()
    return last + 1


def rollback(spark: SparkSession, root: str, release: str, expected: int | None = None) -> int:
    """Makes an earlier release the public one: an entry like any other."""
    if not release_log(spark, root).filter(F.col("release_id") == release).take(1):
        raise ValueError(f"no release {release}")
    return point(spark, root, release, "rollback", expected)


def current_release(spark: SparkSession, root: str) -> str | None:
    return release_log(spark, root).agg(F.max_by("release_id", "seq")).first()[0]


def read_release(spark: SparkSession, root: str, name: str, release: str | None = None) -> DataFrame:
    """A table of a release, by default of the public one: the caller's pinned name stays readable whatever is published meanwhile."""
    release = release or current_release(spark, root)
    return spark.read.parquet(f"{root}/release_id={release}/{name}")
