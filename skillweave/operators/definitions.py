"""Definitions of jobs, assembled from the fragments of approved events.

The rule is an ordered fold per job: events are taken in order, each gives a fragment and the sources whose body holds it word for word, until
two fragments and two different sources are there. As sources before the stop are all one and the same, the stop is the later of two places: the
second usable event, and the first one with a source other than the first event's smallest. Both are grouped minima, so no
task walks over a job's events, however many there are.

Defined results: events without excerpt, without a source that is known and not retracted, or with a fragment in none of their bodies are passed over;
where no body of an event's sources can be read, its fragment counts with all of them; ties in time go by id; a job with fewer than two
sources gets no definition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import saved
from .gate import BLANKS, JOINT, PREFIX, present, stripped

#: Letters of a fragment and of a definition, fragments in one.
FRAGMENT_LENGTH, DEFINITION_LENGTH, FRAGMENTS = 120, 360, 3
APPROVED = ["approved", "auto_passed"]


def usable_fragments(events: DataFrame, evidence: DataFrame) -> DataFrame:
    """job, at, id, fragment, sources of approved events(job, id, at, review, excerpt, sources) with a fragment that evidence(job, id, body, retracted) supports."""
    raw = stripped(F.col("excerpt"))
    rows = events.filter(F.col("review").isin(APPROVED)).select("job", "id", "at", raw.alias("raw"), F.regexp_replace(raw, f"{BLANKS}+", " ").alias("squashed"), F.explode(present(F.col("sources"))).alias("source")).filter("raw <> ''")
    open_ = evidence.filter(~F.coalesce("retracted", F.lit(False))).select("job", F.col("id").alias("source"), F.coalesce("body", F.lit("")).alias("body"))
    held = rows.join(open_, ["job", "source"]).select("job", "id", "at", "raw", "squashed", "source", (F.col("body") != "").alias("readable"), F.contains("body", "raw").alias("has_raw"), F.contains("body", "squashed").alias("has_squashed"))
    where = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("source"))))
    told = held.groupBy("job", "id", "at", "raw", "squashed").agg(F.max("readable").alias("readable"), where(F.lit(True)).alias("every"), where(F.col("has_raw")).alias("raw_in"), where(F.col("has_squashed")).alias("squashed_in"))
    fragment = F.when(~F.col("readable"), F.col("squashed")).when(F.size("raw_in") > 0, F.col("raw")).when(F.size("squashed_in") > 0, F.col("squashed"))
    sources = F.when(~F.col("readable"), F.col("every")).when(F.size("raw_in") > 0, F.col("raw_in")).otherwise(F.col("squashed_in"))
    return told.select("job", "id", "at", F.substring(fragment, 1, FRAGMENT_LENGTH).alias("fragment"), sources.alias("sources")).filter("fragment is not null")


def assemble_definitions(jobs: DataFrame, events: DataFrame, evidence: DataFrame) -> DataFrame:
    """job, claim, text, excerpt, sources: a claim for each of jobs(job, title) that has two sources."""
    rows = saved(usable_fragments(events, evidence).withColumn("ord", F.struct("at", "id")), "fragments")
    first = Window.partitionBy("job").orderBy("ord")
    heads = rows.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= FRAGMENTS)
    start = heads.groupBy("job").agg(
        F.array_min(F.min_by("sources", "nth")).alias("single"), F.max(F.when(F.col("nth") == 2, F.col("ord"))).alias("second"), F.min("ord").alias("begin"),
    )
    other = F.exists("sources", lambda s: s != F.col("single"))
    spread = rows.join(start.select("job", "single"), "job").filter(other).groupBy("job").agg(F.min("ord").alias("spread"))
    stop = start.join(spread, "job").select("job", F.coalesce(F.greatest("second", "spread"), F.col("spread")).alias("stop"), "single")
    # up to the stop only its own row, the first two and the first with another source hold more than the single source
    sources = rows.join(stop, "job").filter((F.col("ord") <= F.col("stop")) & other).select("job", F.explode("sources").alias("s")).unionByName(stop.select("job", F.col("single").alias("s")))
    sources = sources.groupBy("job").agg(F.array_sort(F.collect_set("s")).alias("sources"))
    text = heads.join(stop, "job").filter(F.col("ord") <= F.col("stop")).groupBy("job").agg(F.array_sort(F.collect_list(F.struct("nth", "fragment"))).alias("parts"))
    parts = F.array_distinct(F.transform("parts", lambda x: x["fragment"]))
    whole = F.substring(F.concat(F.coalesce("title", F.lit("")), F.lit(PREFIX), F.array_join(parts, JOINT)), 1, DEFINITION_LENGTH)
    out = jobs.select("job", "title").join(text, "job").join(sources, "job")
    return out.select("job", F.concat(F.lit("definition-"), F.col("job").cast("string")).alias("claim"), whole.alias("text"), F.lit(None).cast("string").alias("excerpt"), "sources")


def replaceable(current: DataFrame, checked: DataFrame) -> DataFrame:
    """Of jobs with current(job, claim, corrected) claims, those whose definition curation may replace: none was corrected by hand, and not all are supported by checked(job, claim, supported) fragments."""
    whole = checked.groupBy("job", "claim").agg(F.min("supported").alias("whole"))
    told = current.join(whole, ["job", "claim"], "left").groupBy("job").agg(F.max(F.coalesce("corrected", F.lit(False))).alias("by_hand"), F.min(F.coalesce("whole", F.lit(False))).alias("sound"))
    return told.filter("not by_hand and not sound").select("job")
