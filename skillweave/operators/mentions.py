"""Extracted mentions: coercion of model output to the schema, typing, rules, votes and groups. Model output enters as a JSON column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import spread
from .votes import evidence_sizes

SKILL = "name string, kind string, proficiency string, confidence string, excerpt string, section string, category string, raw_name string, action string, context string, candidate_type string, vote string, group_id string, min_required string"
PAYLOAD = f"job_name string, domain string, target string, skills array<struct<{SKILL.replace(' string', ':string')}>>"


def unwrapped(c: Column) -> Column:
    """The JSON object in a model's answer: code fences off, from the first brace on."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?s)^\s*```[a-z]*\s*|\s*```\s*$", "")
    return F.when(F.locate("{", bare) > 0, F.substring(bare, F.locate("{", bare), F.length(bare)))


def confidence(c: Column) -> Column:
    """A number in 0 to 1; percentages are divided, what is no number is 0.5."""
    x = c.try_cast("double")
    return F.when(x.isNull() | F.isnan(x), 0.5).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(x > 1, x / 100).otherwise(x))))


def positive(c: Column) -> Column:
    n = c.try_cast("int")
    return F.when(n >= 1, n).otherwise(1)


def alias(c: Column, table: dict[str, str], default: str | None) -> Column:
    """The canonical value of a spelling; unknown spellings give the default."""
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(F.trim(c))), F.lit(default))


def extracted(rows: DataFrame, answer: str, sections: dict[str, str], kinds: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(mentions, failures) of rows(posting_id, answer): one row per extracted skill with a name; answers that are no object fail."""
    parsed = rows.withColumn("p", F.from_json(unwrapped(F.col(answer)), PAYLOAD))
    good = parsed.filter("p is not null").select("posting_id", "p.job_name", "p.domain", "p.target", F.posexplode_outer("p.skills").alias("ord", "s"))
    out = good.filter("s is not null and coalesce(trim(s.name), '') <> ''").select(
        "posting_id", "ord", "job_name", "domain", "target", F.trim("s.name").alias("name"), confidence(F.col("s.confidence")).alias("confidence"), alias(F.col("s.section"), sections, "requirement").alias("section"),
        alias(F.col("s.kind"), kinds, "required").alias("kind"), F.coalesce("s.excerpt", F.lit("")).alias("excerpt"), F.col("s.action").alias("action"), F.col("s.context").alias("context"), F.col("s.vote").alias("vote"), F.col("s.group_id").alias("group_id"), positive(F.col("s.min_required")).alias("min_required"),
    )
    return out, parsed.filter("p is null").select("posting_id", F.lit("extract_failed").alias("kind"), F.col(answer).alias("payload"))


def candidate_type(mentions: DataFrame, types: DataFrame) -> DataFrame:
    """mentions(name, ...) with the type of types(name, type, priority); generic before brand before broad domain, else a skill."""
    first = types.groupBy(F.lower("name").alias("low")).agg(F.min_by("type", "priority").alias("type"))
    return mentions.withColumn("low", F.lower("name")).join(first, "low", "left").withColumn("type", F.coalesce("type", F.lit("skill"))).drop("low")


def admissible() -> Column:
    """Mentions that may become requirements: no benefits or introductions, nothing generic, broad domains only as duties or with an action."""
    acted = (F.coalesce("action", F.lit("")) != "") | (F.coalesce("context", F.lit("")) != "")
    return ~F.col("section").isin("benefit", "intro") & (F.col("type") != "generic") & ((F.col("type") != "broad_domain") | (F.col("section") == "duty") | acted) & ((F.col("type") != "brand") | acted)


def requirement_vote(vote: Column, excerpt: Column, section: Column, marks: str) -> Column:
    """A vote for required that stands outside the requirement section needs a marking word."""
    return F.when((vote == "required") & (section != "requirement") & ~excerpt.rlike(marks), "unmarked").otherwise(F.coalesce(vote, F.lit("unmarked")))


def infer_group(excerpt: Column) -> Column:
    """(group_id, min_required) where the excerpt offers a choice, else null."""
    least = F.regexp_extract(excerpt, r"至少\s*(\d+)", 1).try_cast("int")
    group = F.concat(F.lit("group-"), F.substring(F.sha2(excerpt, 256), 1, 12))
    return F.when(excerpt.rlike("或|任选|至少|任一"), F.struct(group.alias("group_id"), F.coalesce(least, F.lit(1)).alias("min_required")))


def invented_numbers(text: Column, source: Column) -> Column:
    """Numbers of a text that its source lacks."""
    numbers = lambda c: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1))
    return F.array_except(numbers(text), numbers(source))


def grounded(suggestion: Column, source: Column) -> Column:
    """Whether a rewrite adds no number."""
    return F.size(invented_numbers(suggestion, source)) == 0


def augment(mentions: DataFrame, hits: DataFrame) -> DataFrame:
    """Adds vocabulary hits(posting_id, name) that were not extracted, with confidence 0.65 and no vote."""
    new = hits.select("posting_id", "name").distinct().join(mentions.select("posting_id", "name"), ["posting_id", "name"], "left_anti")
    return mentions.select("posting_id", "name", "confidence", "vote").unionByName(new.select("posting_id", "name", F.lit(0.65).alias("confidence"), F.lit("unmarked").alias("vote")))


def supported(claims: DataFrame, bodies: DataFrame) -> DataFrame:
    """claims(claim, excerpt, sources array) with whether one of its sources' bodies(source, body) holds the excerpt; claims without sources pass."""
    each = claims.select("claim", "excerpt", F.explode("sources").alias("source")).join(bodies, "source", "left")
    found = each.groupBy("claim").agg(F.max(F.coalesce(F.contains("body", "excerpt"), F.lit(False))).alias("found"))
    return claims.join(found, "claim", "left").select("claim", F.coalesce("found", F.lit(True)).alias("supported"))


def group_coverage(mentions: DataFrame, groups: DataFrame, tasks: int | None = None) -> DataFrame:
    """Share of a job's evidence in which enough members of a group (job, skill, group_id, min_required) occur."""
    hits = spread(mentions.select("job", "skill", "evidence"), tasks, "job", "skill").distinct().join(groups, ["job", "skill"]).groupBy("job", "group_id", "evidence").agg(F.count("*").alias("n"), F.max("min_required").alias("least"))
    size = evidence_sizes(mentions, "job")
    met = hits.filter("n >= least").groupBy("job", "group_id").agg(F.count("*").alias("n"))
    return met.join(size, "job").select("job", "group_id", "n", F.round(F.col("n") / F.col("size"), 6).alias("coverage"))


def spread_dates(rows: DataFrame, by: str, day: str, key: str, days: int = 90) -> DataFrame:
    """Where all rows of a source share one date, that is a load date: keys spread them over the days before it."""
    one = rows.groupBy(by).agg((F.countDistinct(day) == 1).alias("single"), F.count("*").alias("n"))
    spread = F.date_sub(F.col(day), F.pmod(F.xxhash64(key), F.lit(days)).cast("int"))
    return rows.join(one, by).withColumn(day, F.when(F.col("single") & (F.col("n") > 1), spread).otherwise(F.col(day))).drop("single", "n")
