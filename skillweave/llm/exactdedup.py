"""Exact deduplication over a log-structured merge index, in DataFrame operations alone.

``flush`` turns each memtable (MEMTABLE_ROWS rows or less, set by a hash of doc_id) into one run: a Parquet
folder with one row per text digest, sorted by digest. ``compact`` merges runs, ``fan_in`` at a time and
level by level, until one remains; a merged row keeps the smallest and
the largest identifier and the sum of the counts. Digests that occur more than once are hits; the index
has a filter of them, a bit per hash in at most FILTER_BITS bits, which is broadcast as rows of 64 bits. A ``probe``
tests each row against the filter in place, so texts that are alone never move; what passes joins the hits by
shuffle, and each hit's bytes are compared with those of the
digest's representative; a difference (two texts with one SHA-256 digest) stops the job.

Aggregations combine before they shuffle. The representative's text is dealt to as many salts as the
group's size asks for, so no task gets more than SALT_ROWS rows of one group, however hot. A full
filter lets more rows through and changes no result.

Defined results: a null text is an empty one; a null doc_id is the smallest; rows that repeat the kept
doc_id all count as kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, lower_ascii, saved

SALT_ROWS = 20_000
MEMTABLE_ROWS = 4_000_000
FILTER_BITS = 1 << 24


def keyed(docs: DataFrame) -> DataFrame:
    norm = lower_ascii(F.coalesce("text", F.lit("")))
    return docs.select("doc_id", norm.alias("norm")).withColumn("digest", F.unhex(F.sha2("norm", 256)))


class DigestIndex:
    """Runs of digests in a folder. More rows can be flushed to it at any time; compact() then merges all."""

    def __init__(self, spark, path: str, fan_in: int = 4):
        self.spark, self.path, self.fan_in, self.runs = spark, path, fan_in, []

    def _write(self, rows: DataFrame, name: str) -> str:
        at = f"{self.path}/{name}"
        rows.sortWithinPartitions("digest").write.parquet(at)
        return at

    def flush(self, rows: DataFrame, memtables: int | None = None) -> None:
        """Adds rows(doc_id, digest) as sorted runs of at most about MEMTABLE_ROWS rows each, in one job over the rows."""
        memtables = memtables or -(-max(1, rows.count()) // MEMTABLE_ROWS)
        name = f"l0-{len(self.runs)}"
        runs = (
            rows.groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(memtables)).alias("memtable"), "digest")
            .agg(F.min("doc_id").alias("min_id"), F.max("doc_id").alias("max_id"), F.count("*").alias("n"))
            .sortWithinPartitions("memtable", "digest")
        )
        runs.write.partitionBy("memtable").parquet(f"{self.path}/{name}")
        self.runs += [f"{self.path}/{name}/memtable={k}" for k in range(memtables)]
        self.schema = runs.drop("memtable").schema

    def read(self, run: list[str]) -> DataFrame:
        found = [r for r in run if self._exists(r)]
        return self.spark.read.schema(self.schema).parquet(*found) if found else self.spark.createDataFrame([], self.schema)

    def _exists(self, run: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(run)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def compact(self) -> DataFrame:
        """Merges until one run is left, and returns it."""
        level = 0
        while len(self.runs) > 1 or level == 0:
            level += 1
            merged = []
            for k in range(0, len(self.runs), self.fan_in):
                rows = self.read(self.runs[k : k + self.fan_in]).groupBy("digest").agg(F.min("min_id").alias("min_id"), F.max("max_id").alias("max_id"), F.sum("n").alias("n"))
                merged.append(self._write(rows, f"l{level}-{k}"))
            self.runs = merged
        return self.read(self.runs)


def bit_of(digest: str) -> tuple[Column, Column]:
    """The word of the filter and the bit in it that a digest sets."""
    place = f"pmod(xxhash64({digest}), {FILTER_BITS})"
    return F.expr(f"cast(shiftright({place}, 6) as int)"), F.expr(f"shiftleft(1L, cast({place} & 63 as int))")


def filter_of(hits: DataFrame) -> DataFrame:
    """word, bits: a row per 64 bits that are not all 0, FILTER_BITS / 64 rows at most."""
    word, bit = bit_of("digest")
    return hits.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))


def marked(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows with ``maybe``: false only where the filter shows that the digest is no hit."""
    word, bit = bit_of("digest")
    return rows.join(F.broadcast(known), word == F.col("word"), "left").withColumn("maybe", F.coalesce(F.col("bits").bitwiseAND(bit) != 0, F.lit(False))).drop("word", "bits")


def exact_dedup(docs: DataFrame, *, keep: str = "max", memtables: int | None = None) -> DataFrame:
    """One row per row of documents(doc_id, text): doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    rows = keyed(docs)
    digests = saved(rows.select("doc_id", "digest"), "digests")
    index = DigestIndex(spark, fresh_path(spark, "digest-index"))
    index.flush(digests, memtables)
    merged = index.compact()
    chosen = F.col("max_id" if keep == "max" else "min_id")
    hits = merged.filter("n > 1").select("digest", chosen.alias("keep_id"), F.col("n").alias("group_size"), F.greatest(F.lit(1), F.ceil(F.col("n") / SALT_ROWS)).cast("int").alias("salts"))
    known = saved(filter_of(hits), "digest-filter")

    # rows that are alone need no text: most leave by the filter, the rest by the anti-join; hits move with their text
    narrow = marked(digests, known)
    single = lambda df: df.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "digest")
    alone = single(narrow.filter("not maybe")).unionByName(single(narrow.filter("maybe").join(hits, "digest", "left_anti")))
    wide = marked(rows, known).filter("maybe").drop("maybe")
    found = saved(wide.join(hits, "digest").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int")), "digest-hits")
    heads = (
        found.filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .groupBy("digest")
        .agg(F.min("norm").alias("head"), F.first("salts").alias("salts"))
        .select("digest", "head", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    )
    same = F.when(F.col("norm") == F.col("head"), F.col("keep_id")).otherwise(F.raise_error(F.lit("two texts share a SHA-256 digest")).cast("long"))
    equal = found.join(heads, ["digest", "salt"]).select("doc_id", same.alias("keep_id"), "group_size", "digest")
    out = alone.unionByName(equal)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
