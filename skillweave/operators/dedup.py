"""Near-duplicate postings by 64-bit simhash, and the rule which of them stays.

Postings with one hash are one class, so copies make no pairs. A hash is cut into six blocks; two hashes within three
bits agree in three of them at least, so classes join on (three blocks, their bits), some 32 bits of a key, and the distance is
checked on each pair.
"""

from __future__ import annotations

import hashlib
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import hamming, simhash_tokens
from ..sources.shared import saved, spread, tasks_for

DISTANCE = 3
WIDTHS = (11, 11, 11, 11, 10, 10)


def token_votes(tokens: pa.Array) -> pa.Array:
    """Per row of token lists the 64 signs of the votes of the first 64 bits of the tokens' MD5 digests."""
    out = np.zeros(len(tokens), np.uint64)
    for a in range(0, len(tokens), 500):
        part = tokens.slice(a, 500)
        coded = part.flatten().dictionary_encode()
        bits = np.frombuffer(b"".join(hashlib.md5(t.encode()).digest()[:8] for t in coded.dictionary.to_pylist()), np.uint8).reshape(-1, 8)
        votes = np.unpackbits(bits, axis=1).astype(np.int8) * 2 - 1
        n = np.array(part.value_lengths().fill_null(0))
        filled = np.flatnonzero(n)
        if not len(filled):
            continue
        sums = np.add.reduceat(votes[np.array(coded.indices)], (np.cumsum(n) - n)[filled], axis=0, dtype=np.int32)
        out[a + filled] = np.packbits(sums > 0, axis=1).view(">u8").ravel()
    return pa.array(out.view(np.int64))


def simhash(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key and simhash of each row: per bit the sign of its tokens' votes; 0 without tokens. Row by row, so nothing is shuffled."""
    return rows.select(key, F.arrow_udf(token_votes, "long")(simhash_tokens(F.col(text))).alias("simhash"))


def class_keys(classes: DataFrame) -> DataFrame:
    """simhash, blocks, bits: the keys of each class, of which near classes share one at least, and a class all with itself."""
    ends = np.cumsum(WIDTHS)
    blocks = [((1 << w) - 1) << int(e - w) for w, e in zip(WIDTHS, ends, strict=True)]
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    masks = [signed(sum(c)) for c in combinations(blocks, 3)]
    key = F.explode(F.array(*[F.struct(F.lit(k).alias("blocks"), F.col("simhash").bitwiseAND(m).alias("bits")) for k, m in enumerate(masks)]))
    return classes.select("simhash", key.alias("key")).select("simhash", "key.*")


def near_classes(classes: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of distinct hashes at most DISTANCE bits apart. The keys of the classes, which are best a table, go to tasks of bounded size."""
    keys = class_keys(classes)
    keys = spread(keys, tasks_for(classes.count() * comb(len(WIDTHS), 3)), "blocks", "bits")
    other = keys.withColumnRenamed("simhash", "b")
    pairs = keys.withColumnRenamed("simhash", "a").join(other, ["blocks", "bits"]).filter("a < b").filter(hamming(F.col("a"), F.col("b")) <= DISTANCE)
    return pairs.select("a", "b").distinct()


def keep_earliest(rows: DataFrame) -> DataFrame:
    """Of rows(id, posting, simhash, observed_on) those that no kept earlier row is near to; rows of one posting never exclude each other.

    Earlier is by (observed_on, id). The kept rows of a class (one hash) are all of one posting, and the first of them drops
    whatever a later one would; and of a class's rows of one posting the first stands for all. So one row per class and posting is looked at, and pairs
    are of near classes alone: a class's head is its first row not dropped yet; a head earlier than those of all near
    undecided classes is kept; where a kept head of posting p drops a near class's head, that class's first row of p is the only one that can follow.
    The result is that of one pass in order; rounds go on until no class is undecided.
    """
    spark = rows.sparkSession
    at = F.struct("observed_on", "id")
    first = saved(rows.groupBy("simhash", "posting").agg(F.min(at).alias("at")), "first-rows")
    heads = saved(first.groupBy("simhash").agg(F.min(F.struct("at", "posting")).alias("h")).select("simhash", "h.at", "h.posting"), "heads")
    pairs = near_classes(first.select("simhash").distinct())
    near = saved(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), "near-classes")
    kept = spark.createDataFrame([], heads.schema)
    other = lambda df: df.select(F.col("simhash").alias("b"), F.col("at").alias("b_at"), F.col("posting").alias("b_posting"))
    while not heads.isEmpty():  # each round drops a head or keeps the earliest of all
        hits = heads.join(near, F.col("simhash") == F.col("a")).join(other(kept), "b").filter("b_at < at and not (b_posting <=> posting)")
        hits = saved(hits.groupBy("simhash").agg(F.min("at").alias("was"), F.min(F.struct("b_posting")).alias("p"), F.max(F.struct("b_posting")).alias("q")), "dropped-heads")
        follows = hits.filter("p <=> q").select("simhash", "was", F.col("p.b_posting").alias("next")).join(first.select(F.col("simhash").alias("s"), "posting", F.col("at").alias("then")), F.expr("simhash = s and next <=> posting")).filter("then > was")
        alive = heads.join(hits, "simhash", "left_anti").withColumn("tried", F.lit(True))
        pool = saved(alive.unionByName(follows.select("simhash", F.col("then").alias("at"), "posting", F.lit(False).alias("tried"))), "heads")
        blocked = pool.join(near, F.col("simhash") == F.col("a")).join(other(pool), "b").filter("b_at < at").select("simhash").distinct()
        new = saved(pool.filter("tried").join(blocked, "simhash", "left_anti").drop("tried"), "kept-heads")
        kept = saved(kept.unionByName(new), "kept-heads")
        heads = saved(pool.drop("tried").join(new, "simhash", "left_anti"), "heads")
    # what drops rows of a class: the first kept head near it, and the first of another posting
    droppers = kept.join(near, F.col("simhash") == F.col("a")).select(F.col("b").alias("simhash"), "at", "posting").unionByName(kept)
    one = saved(droppers.groupBy("simhash").agg(F.min(F.struct("at", "posting")).alias("one")), "droppers")
    two = droppers.join(one, "simhash").filter("not (posting <=> one.posting)").groupBy("simhash").agg(F.min("at").alias("two"))
    limits = one.join(two, "simhash", "left").withColumnRenamed("simhash", "of")
    gone = F.coalesce(F.when(F.col("one.posting").eqNullSafe(F.col("posting")), F.col("two") < at).otherwise(F.col("one.at") < at), F.lit(False))
    return rows.join(limits, F.col("simhash") == F.col("of"), "left").filter(~gone).drop("of", "one", "two")
