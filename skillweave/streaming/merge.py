"""Near-duplicate postings by micro-batch: a table of snapshots with an index of keys, so a batch meets only the postings near to it.

Everything that batch n adds lies in folders of its own name, written anew if the batch is run again, and counts once the batch's entry in ``done``
is there. Batch n reads what earlier batches added, so running it twice changes nothing.

    rows/batch=n  snapshots that n keeps (id, posting, body, observed_on, simhash)
    gone/batch=n  ids of earlier ones that n drops
    keys/batch=n  simhash, blocks, bits of the classes of the rows, by bucket
    done/batch=n  counts
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.text import hamming, simhash_tokens
from ..operators.dedup import DISTANCE, class_keys, keep_earliest, token_votes
from ..operators.release import _exists
from ..sources.shared import saved

ROWS = "id string, posting string, body string, observed_on date, simhash long"
KEYS = "simhash long, blocks int, bits long"
COUNTS = "n_rows long, n_known long, n_near long, n_added long, n_dropped long"
BUCKETS = 64


def part(spark: SparkSession, root: str, name: str, schema: str, before: int | None = None) -> DataFrame:
    """What committed batches, or those before one, added to a table of the store."""
    if not _exists(spark, f"{root}/done") or not _exists(spark, f"{root}/{name}"):
        return spark.createDataFrame([], f"{schema}, batch long")
    done = spark.read.schema(f"{COUNTS}, batch long").parquet(f"{root}/done").select("batch").distinct()
    rows = spark.read.schema(f"{schema}, batch long").parquet(f"{root}/{name}").join(done, "batch", "left_semi")
    return rows if before is None else rows.filter(F.col("batch") < before)


def snapshots(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """The table of snapshots: added and not dropped since."""
    gone = part(spark, root, "gone", "id string", before).withColumnRenamed("batch", "gone_in")
    rows = part(spark, root, "rows", ROWS, before).alias("r")
    return rows.join(gone.alias("g"), F.expr("r.id = g.id and g.gone_in > r.batch"), "left_anti").drop("batch")


def metrics(spark: SparkSession, root: str) -> DataFrame:
    """Per committed batch its counts: rows read, already known, near to others, added, and earlier ones dropped."""
    return part(spark, root, "done", COUNTS)


def bucket(keys: DataFrame) -> DataFrame:
    return keys.withColumn("bucket", F.pmod(F.xxhash64("blocks", "bits"), F.lit(BUCKETS)).cast("int"))


def apply_batch(batch: DataFrame, n: int, root: str) -> None:
    """Merges batch(id, posting, body, observed_on) as number n. The table is then what ``keep_earliest`` makes of the table before and the new rows.

    Rows of the table are not near to each other unless they are of one posting, so only those near to a new row can go, and no other decides on
    a new row: these and the new rows are all that the rule looks at. Ids of the table are known and left out; of a repeated id in a batch
    the least row by (observed_on, posting, body) is taken; rows without id or observed_on are left out.
    """
    spark = batch.sparkSession
    if _exists(spark, f"{root}/done/batch={n}/_SUCCESS"):
        return
    whole = F.when(F.col("observed_on").isNotNull(), F.struct("observed_on", "posting", "body"))
    typed = batch.select(F.col("id").cast("string").alias("id"), F.col("posting").cast("string").alias("posting"), F.col("body"), F.col("observed_on").cast("date").alias("observed_on"))
    once = typed.groupBy("id").agg(F.count("*").alias("copies"), F.min(whole).alias("m")).select("id", "copies", "m.posting", "m.body", "m.observed_on")
    table = snapshots(spark, root, n)
    hashed = once.withColumn("simhash", F.arrow_udf(token_votes, "long")(simhash_tokens(F.col("body"))))
    every = saved(hashed.join(table.select("id", F.lit(True).alias("known")), "id", "left"), "batch-rows")
    usable = every.filter("id is not null and observed_on is not null")
    new = usable.filter("known is null").drop("known")
    keys = bucket(class_keys(new.select("simhash").distinct())).withColumnRenamed("simhash", "own")
    stored = part(spark, root, "keys", f"{KEYS}, bucket int", n).drop("batch")
    near = stored.join(keys, ["bucket", "blocks", "bits"]).filter(hamming(F.col("simhash"), F.col("own")) <= DISTANCE).select("simhash").distinct()
    narrow = ["id", "posting", "simhash", "observed_on"]
    met = saved(table.select(*narrow).join(near, "simhash", "left_semi").select(*narrow), "near-rows")
    kept = saved(keep_earliest(new.select(*narrow).unionByName(met)).select("id"), "kept-ids")
    new.join(kept, "id", "left_semi").select("id", "posting", "body", "observed_on", "simhash").write.mode("overwrite").parquet(f"{root}/rows/batch={n}")
    met.select("id").join(kept, "id", "left_anti").write.mode("overwrite").parquet(f"{root}/gone/batch={n}")
    own = spark.read.schema(ROWS).parquet(f"{root}/rows/batch={n}").select("simhash").distinct()
    bucket(class_keys(own)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/keys/batch={n}")
    size = lambda name, schema: spark.read.schema(schema).parquet(f"{root}/{name}/batch={n}").count()
    total = every.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n")).first()["n"]
    known, fresh, added = usable.filter("known").count(), new.count(), size("rows", ROWS)
    counts = [(total, known, fresh - added, added, size("gone", "id string"))]
    spark.createDataFrame(counts, COUNTS).coalesce(1).write.mode("overwrite").parquet(f"{root}/done/batch={n}")


def merge_stream(stream: DataFrame, root: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Merges a stream of postings into the store at root, a micro-batch at a time."""
    return stream.writeStream.foreachBatch(lambda batch, n: apply_batch(batch, n, root)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
