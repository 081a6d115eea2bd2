"""A training corpus from the documents table: drop toxic texts, keep one of each group of near
duplicates, drop benchmark leaks, mix to target weights, write token ids.

Each stage gets the rows that its predecessor kept, as (spark, docs, sf_dir), and returns a DataFrame that is
written as Parquet and read again as the next one's docs. All but the last return the columns of documents.
Null and empty texts are not toxic, near duplicates of nothing, and free of leaks, so they stay. Every row is decided by itself: rows that
share a doc_id, or have none, each go or stay by their own text; extra columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillweave.llm import decontaminate, mixing, ngramjoin, tokenbin, toxicity
from skillweave.llm.common import fresh_path, saved

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier does not call toxic. It learns from the labels of the given rows."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    machine = toxicity.train_machine(docs, labels)
    return toxicity.toxicity_scores(docs, machine, COLUMNS).filter("predicted = 0").select(*COLUMNS)


def keyed(docs: DataFrame) -> DataFrame:
    """The rows with a key of their own, row_key, as doc_id may be null or repeat: a hash of file and place in it (two of N rows share one with
    probability N*N/2**65). Rows that are in no file are written once with a number."""
    try:
        return docs.select(*COLUMNS, F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("row_key"))
    except AnalysisException:
        return saved(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row_key")), "pipeline-keyed")


def by_key(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("row_key").alias("doc_id"), "text")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of the Jaccard join, one row: that with the smallest doc_id, null ids last."""
    rows = keyed(docs)
    placed = ngramjoin.jaccard_components(by_key(rows)).select(F.col("doc_id").alias("row_key"), "component_id").join(rows.select("row_key", F.col("doc_id").alias("id")), "row_key")
    kept = placed.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "row_key")).alias("first")).select("first.row_key")
    return rows.join(kept, "row_key", "left_semi").select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without an occurrence of any benchmark window."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = keyed(docs)
    leaks = decontaminate.decontaminate(by_key(rows), benchmark).filter("contaminated").select(F.col("doc_id").alias("row_key"))
    return rows.join(leaks, "row_key", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as their rates say. Rates are 1 at least, so no clean document is lost and what is short is repeated. Each row is drawn by its own key;
    the shares that the mix reaches stay beside its rows, as the table pipeline-mix-shares(domain, target, reached)."""
    labels = mixing.quality_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows, reached = mixing.mix(keyed(docs), labels, mixing.TARGETS, [*COLUMNS, "row_key"], low=1.0, budget=None)
    shares = [(domain, float(mixing.TARGETS.get(domain, 0.0)), float(share)) for domain, share in reached.items()]
    saved(spark.createDataFrame(shares, "domain string, target double, reached double"), "pipeline-mix-shares")
    return mixing.sampled(rows, COLUMNS, "row_key")


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row, in ascending doc_id order, what the token files hold of it."""
    return tokenbin.read_token_ids(tokenbin.write_token_ids(docs, fresh_path(spark, "pipeline-token-ids"))).drop("shard")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("token_ids", write_tokens),
]

ORACLE_SQL = None  # a trained classifier, a solver and a tokenizer: tests hold each stage against a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{k}-{name}")
    return docs
