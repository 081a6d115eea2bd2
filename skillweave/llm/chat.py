"""Chat formatting with collapse of cumulative snapshots, in DataFrame operations alone.

Logs often hold a conversation again and again, each time with one more exchange. Every turn gets two
64-bit hashes of its position, role and text; their running exclusive-or is the hash of the prefix
that ends with it. A conversation that equals a proper prefix of another one, by length and
hash, is dropped by an anti-join, and of equal conversations the one with the smallest id stays. The rest
is rendered turn by turn between role marks.

Positions count a conversation's turns in the order of (turn, role, text). Running values are worked out in two
levels, blocks of BLOCK turn numbers and then turns inside a block, so that no task needs more than one block of a
conversation in a window, and the blocks' own totals are few. A conversation is rendered in segments of at
most BLOCK turns: nearly all have one, and no row grows without bound.

Defined results: a null text is an empty one and a null role is "unknown"; turns with null conv_id belong to none and
are left out; a null turn comes first; marks inside a text stay as they are; rows that repeat a turn are turns of their own; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

BLOCK = 4096
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, block, pos, n_turns, role, text and the hashes p, q of the prefix that ends with the turn."""
    rows = turns.filter("conv_id is not null").select("conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 40))).alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("block", F.floor(F.col("turn") / BLOCK))
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    rows = rows.withColumn("place", F.row_number().over(inside))
    # positions before each block, from the blocks' sizes
    blocks = rows.groupBy("conv_id", "block").agg(F.count("*").alias("size"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "block", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"), F.sum("size").over(Window.partitionBy("conv_id")).alias("n_turns"))
    rows = rows.join(blocks, ["conv_id", "block"]).withColumn("pos", F.col("before") + F.col("place"))
    rows = rows.withColumn("p", F.xxhash64("pos", "role", "text")).withColumn("q", F.xxhash64("text", F.lit(7), "role", "pos"))
    totals = rows.groupBy("conv_id", "block").agg(F.bit_xor("p").alias("tp"), F.bit_xor("q").alias("tq"))
    zero = F.lit(0).cast("long")
    totals = totals.select("conv_id", "block", F.coalesce(F.bit_xor("tp").over(earlier), zero).alias("bp"), F.coalesce(F.bit_xor("tq").over(earlier), zero).alias("bq"))
    running = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("p", F.bit_xor("p").over(running)).withColumn("q", F.bit_xor("q").over(running)).join(totals, ["conv_id", "block"])
    return rows.select("conv_id", "block", "pos", "n_turns", "role", "text", F.col("p").bitwiseXOR(F.col("bp")).alias("p"), F.col("q").bitwiseXOR(F.col("bq")).alias("q"))


def maximal(prefixes: DataFrame) -> DataFrame:
    """conv_id, copies of the conversations that no longer one begins with; of equal ones that with the smallest id."""
    same = prefixes.filter("pos = n_turns").groupBy("pos", "p", "q").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    proper = prefixes.filter("pos < n_turns").select("pos", "p", "q").distinct()  # a first turn that many share is one row
    return same.join(proper, ["pos", "p", "q"], "left_anti").select("conv_id", "copies")


def collapse(turns: DataFrame) -> DataFrame:
    """The turns (conv_id, block, pos, n_turns, role, text, copies) of maximal conversations."""
    prefixes = saved(prefix_hashes(turns), "turn-prefixes")
    return prefixes.drop("p", "q").join(maximal(prefixes), "conv_id")


def render(turns: DataFrame) -> DataFrame:
    """conv_id, segment, n_turns, copies, text: the rendered turns, BLOCK of them at most in a row."""
    rows = turns.withColumn("segment", F.floor((F.col("pos") - 1) / BLOCK))
    piece = F.concat(F.lit(OPEN), "role", F.lit(MIDDLE), "text", F.lit(CLOSE))
    out = rows.groupBy("conv_id", "segment", "n_turns", "copies").agg(F.array_sort(F.collect_list(F.struct("pos", piece.alias("piece")))).alias("pieces"))
    return out.select("conv_id", "segment", "n_turns", "copies", F.array_join(F.col("pieces.piece"), "").alias("text"))


def op4_chat_collapse(spark, sf_dir: str) -> DataFrame:
    return render(collapse(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


OP4_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), pre AS (
  SELECT conv_id, pos, count(*) OVER (PARTITION BY conv_id) AS n_turns,
         string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '') OVER (PARTITION BY conv_id ORDER BY pos) AS body
  FROM t
), ends AS (SELECT conv_id, n_turns, body FROM pre WHERE pos = n_turns),
proper AS (SELECT DISTINCT body FROM pre WHERE pos < n_turns)
SELECT min(conv_id) AS conv_id, CAST(0 AS BIGINT) AS segment, n_turns, count(*) AS copies, body AS text
FROM ends WHERE body NOT IN (SELECT body FROM proper) GROUP BY n_turns, body
"""
