"""Conflicts of stated date ranges, by a sweep instead of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import month_ranges


def stated(texts: DataFrame) -> DataFrame:
    """id, place, text, first, last (months) of the ranges that texts(id, text) state."""
    return texts.select("id", F.posexplode(month_ranges(F.col("text"))).alias("place", "r")).select("id", "place", "r.text", "r.first", "r.last")


def conflicts(ranges: DataFrame) -> DataFrame:
    """id, place, text, reason, n, other of ranges(id, place, text, first, last) that end before they start, or overlap ones that start earlier.

    Ends and starts of an id are passed once in order of time, an end before the starts of the next month; the running count of open ranges is the
    number ``n`` that a range overlaps among those before it (by start, then place), so the sum over an id counts its overlapping pairs.
    ``other`` is the text of the one of them that lasts longest. A range with a null bound conflicts with nothing.
    """
    turned = ranges.filter("last < first").select("id", "place", "text", F.lit("reversed").alias("reason"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("string").alias("other"))
    right = ranges.filter("last >= first")
    starts = right.select("id", F.col("first").alias("at"), F.lit(1).alias("step"), "place", "text", "last")
    ends = right.select("id", (F.col("last") + 1).alias("at"), F.lit(-1).alias("step"), "place", "text", "last")
    before = Window.partitionBy("id").orderBy("at", "step", "place").rowsBetween(Window.unboundedPreceding, -1)
    longest = F.max(F.when(F.col("step") == 1, F.struct("last", (-F.col("place")).alias("back"), "text"))).over(before)
    swept = starts.unionByName(ends).withColumn("n", F.coalesce(F.sum("step").over(before), F.lit(0))).withColumn("longest", longest)
    over = swept.filter("step = 1 and n > 0").select("id", "place", "text", F.lit("overlap").alias("reason"), "n", F.col("longest.text").alias("other"))
    return turned.unionByName(over)
