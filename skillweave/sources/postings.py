"""Readers and writers of postings, landed portal answers, releases of whole stores, and run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import fingerprint, normalise_company, parse_day

#: The columns of a posting snapshot; all are text.
POSTING = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "path", "source", "company", "company_raw", "title", "body", "city", "published_at", "observed_at", "channel", "job_id", "fingerprint", "simhash", "domain", "url")])


def read_postings(spark: SparkSession, path: str, *, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(postings, quarantine) of JSON files, one object per file or per line. Files that don't parse go to quarantine with their text."""
    schema = T.StructType([*POSTING.fields, T.StructField("_corrupt", T.StringType())])
    rows = spark.read.schema(schema).option("multiLine", not lines).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("ignoreCorruptFiles", "true").json(path)
    rows = rows.withColumn("file", F.col("_metadata.file_path"))
    good = rows.filter("_corrupt is null and id is not null").drop("_corrupt")
    return typed(good), rows.filter("_corrupt is not null or id is null").select("file", F.col("_corrupt").alias("text"))


def typed(rows: DataFrame) -> DataFrame:
    """With the observation as a timestamp (years before 1990 are unknown) and the hash as a signed number."""
    at = F.try_to_timestamp("observed_at")
    return rows.withColumn("observed_at", F.when(F.year(at) >= 1990, at)).withColumn("simhash", F.conv("simhash", 16, -10).cast("long"))


def landed(rows: DataFrame, payload: str, items: str, fields: dict[str, list[str]], source: str) -> DataFrame:
    """Postings from landed portal answers: the array at the JSON path ``items`` exploded, each field the first non-empty of some JSON paths."""
    array = F.from_json(F.get_json_object(payload, items), "array<string>")
    each = rows.select(F.explode(array).alias("item"))
    pick = lambda paths: F.coalesce(*[F.nullif(F.get_json_object("item", p), F.lit("")) for p in paths])
    out = each.select(F.lit(source).alias("source"), *[pick(paths).alias(name) for name, paths in fields.items()])
    for name in ("company", "title", "city", "job_id"):
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast("string"))
    return out.withColumn("company", normalise_company(F.col("company"))).withColumn("fingerprint", fingerprint(F.col("source"), F.col("job_id"), F.col("company"), F.coalesce("title", F.lit("")), F.coalesce("city", F.lit(""))))


def portal_time(value: Column) -> Column:
    """A time from seconds or milliseconds since 1970, or from text."""
    number = value.try_cast("double")
    return F.coalesce(F.timestamp_seconds(F.when(number > 1e12, number / 1000).otherwise(number)), parse_day(value))


def write_postings(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Snapshots by domain; rows of a domain are gathered so that files are few."""
    rows.repartition("domain").write.partitionBy("domain").mode(mode).parquet(path)


def unseen(rows: DataFrame, seen: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is not among those seen: resumed runs, cached extractions, known fingerprints."""
    return rows.join(seen.select(*key).distinct(), key, "left_anti")


def run_log(rows: DataFrame) -> DataFrame:
    """Of rows(run, portal, status, at) the portals still to do: all whose last status isn't done."""
    last = rows.groupBy("run", "portal").agg(F.max_by("status", "at").alias("status"))
    return last.filter("status <> 'done'")


def valid_portals(rows: DataFrame, most: int = 60) -> DataFrame:
    """Errors of a portal table(portal, host, enabled): bad hosts, repeated hosts, too many enabled ones."""
    bad = rows.filter(~F.coalesce(F.col("host").rlike(r"^[a-z0-9-]+(\.[a-z0-9-]+)+$"), F.lit(False))).select("portal", F.lit("bad_host").alias("error"))
    twice = rows.groupBy("host").agg(F.count("*").alias("n"), F.max("portal").alias("portal")).filter("n > 1").select("portal", F.lit("repeated_host").alias("error"))
    many = rows.filter("enabled").agg(F.count("*").alias("n")).filter(F.col("n") > most).select(F.lit(None).cast("string").alias("portal"), F.lit("too_many_enabled").alias("error"))
    return bad.unionByName(twice).unionByName(many)


def export_store(spark: SparkSession, tables: dict[str, DataFrame], root: str) -> None:
    """Every table below root and a manifest of counts and content hashes, written last."""
    rows = []
    for name, table in sorted(tables.items()):
        table.write.parquet(f"{root}/table={name}")
        saved = spark.read.parquet(f"{root}/table={name}")
        found = saved.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*sorted(saved.columns))).alias("h")).first()
        rows.append((name, found["n"], found["h"]))
    spark.createDataFrame(rows, "name string, n long, h long").coalesce(1).write.parquet(f"{root}/manifest")


def import_store(spark: SparkSession, root: str, keys: dict[str, str], edges: list[tuple[str, str, str]]) -> dict[str, DataFrame]:
    """The exported tables, if counts and hashes agree and every edge (table, column, target table) ends at a row of its target."""
    out = {}
    for row in spark.read.parquet(f"{root}/manifest").collect():  # a row per table
        table = spark.read.parquet(f"{root}/table={row['name']}")
        found = table.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*sorted(table.columns))).alias("h")).first()
        if (found["n"], found["h"]) != (row["n"], row["h"]):
            raise ValueError(f"{row['name']}: not what was exported")
        out[row["name"]] = table
    for name, column, target in edges:
        lost = out[name].filter(F.col(column).isNotNull()).join(out[target].select(F.col(keys[target]).alias(column)), column, "left_anti")
        if not lost.isEmpty():
            raise ValueError(f"{name}.{column}: ends that {target} lacks")
    return out


def nested(rows: DataFrame, by: str, fields: list[str], name: str = "items") -> DataFrame:
    """One document per key with its rows as a sorted array: the deliverable's form."""
    return rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))


def stale(log: DataFrame, now: Column, hours: int = 48) -> DataFrame:
    """Per kind whether its last run failed or its last success is too old (log: kind, ok, at)."""
    out = log.groupBy("kind").agg(F.max_by("ok", "at").alias("last_ok"), F.max(F.when(F.col("ok"), F.col("at"))).alias("success"))
    return out.select("kind", "success", (~F.col("last_ok") | F.col("success").isNull() | (F.col("success") < now - F.expr(f"interval {hours} hours"))).alias("stale"))
