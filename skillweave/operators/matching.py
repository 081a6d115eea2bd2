"""Profiles against requirement tables: coverage, score, band, gaps, the next band, ranking.

Pairs of a job and a profile arise from shared skills only; what a profile does not hold follows from the job's
totals, so no row exists for a pair without overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import spread

#: Lower ends of the bands, and the weight of bonus units.
BANDS = {"high": 85, "basic": 60, "gap": 35}
BONUS_WEIGHT = 0.3
TOLERANCE = 1e-9


def band(score: Column) -> Column:
    return F.when(score >= BANDS["high"], "high").when(score >= BANDS["basic"], "basic").when(score >= BANDS["gap"], "gap").otherwise("none")


def next_cut(score: Column) -> Column:
    """The lower end of the band above, null in the highest."""
    return F.when(score < BANDS["gap"], BANDS["gap"]).when(score < BANDS["basic"], BANDS["basic"]).when(score < BANDS["high"], BANDS["high"])


def cover(kind: Column, level: Column, held: Column) -> Column:
    """1 where the level is reached or unknown, a half where it is held below, presence alone for bonus skills."""
    return F.when(kind == "bonus", 1.0).when(level.isNull() | held.isNull() | (held >= level), 1.0).otherwise(0.5)


def score(cov_req: Column, cov_bonus: Column, full_req: Column, full_bonus: Column) -> Column:
    whole = full_req + BONUS_WEIGHT * full_bonus
    return F.when(whole > 0, 100 * (cov_req + BONUS_WEIGHT * cov_bonus) / whole).otherwise(0.0)


def units(requirements: DataFrame) -> DataFrame:
    """Requirements with their unit: the group, or else the skill; a skill that is also in a group is no unit of its own."""
    grouped = requirements.filter("group_id is not null").select("job", "skill").distinct()
    alone = requirements.filter("group_id is null").join(grouped, ["job", "skill"], "left_anti")
    both = requirements.filter("group_id is not null").unionByName(alone)
    kind = F.when(F.col("kind") == "bonus", "bonus").otherwise("required")
    return both.withColumn("kind", kind).withColumn("unit", F.coalesce(F.concat(F.lit("g:"), "group_id"), F.concat(F.lit("s:"), F.col("skill").cast("string"))))


def unit_totals(of_units: DataFrame) -> DataFrame:
    """full_req and full_bonus per job: the units' minima summed."""
    each = of_units.groupBy("job", "kind", "unit").agg(F.max("min_required").alias("least"))
    need = lambda k: F.sum(F.when(F.col("kind") == k, F.col("least")).otherwise(0))
    return each.groupBy("job").agg(need("required").alias("full_req"), need("bonus").alias("full_bonus"))


def covered_units(of_units: DataFrame, skills: DataFrame, tasks: int | None = None, by: tuple[str, ...] = ("job", "resume"), carry: tuple[str, ...] = ()) -> DataFrame:
    """job, resume, kind, unit, cover, least: of each unit the best ``min_required`` members that the profile holds. Covers are whole or half, so counts tell which are best.

    Rows go to so many tasks by the keys ``by`` once. Columns in carry are properties of the job or unit that ride along, so that no pair is joined for them."""
    held = of_units.join(skills, "skill").select("job", "resume", "kind", "unit", "min_required", cover(F.col("kind"), F.col("level"), F.col("held")).alias("cover"), *carry)
    n = spread(held, tasks, *by).groupBy("job", "resume", "kind", "unit").agg(F.sum((F.col("cover") == 1).cast("int")).alias("whole"), F.sum((F.col("cover") == 0.5).cast("int")).alias("half"), F.max("min_required").alias("least"), *[F.max(c).alias(c) for c in carry])
    return n.select("job", "resume", "kind", "unit", (F.least("whole", "least") + 0.5 * F.least(F.col("half"), F.greatest(F.lit(0), F.col("least") - F.col("whole")))).alias("cover"), "least", *carry)


def unit_key() -> Column:
    return F.concat_ws("|", "kind", "unit")


def pair_parts(of_units: DataFrame, skills: DataFrame, tasks: int | None = None) -> DataFrame:
    """One row per pair that shares a skill: job, resume, cov_req, cov_bonus, keys (the units of which the profile holds something), part (those it holds in part).

    A job has at most as many units as the caps allow, so both lists are short; what a pair lacks follows from the job's units, row by row."""
    got = lambda k: F.sum(F.when(F.col("kind") == k, F.col("cover")).otherwise(0.0))
    part = F.collect_list(F.when(F.col("cover") < F.col("least"), F.struct("kind", "unit", "least", "cover")))
    return covered_units(of_units, skills, tasks, by=("job",)).groupBy("job", "resume").agg(got("required").alias("cov_req"), got("bonus").alias("cov_bonus"), F.collect_list(unit_key()).alias("keys"), part.alias("part"))


def absent() -> Column:
    """Of a job's units those of which a pair holds nothing."""
    return F.filter("units", lambda u: ~F.array_contains("keys", u["key"]))


def compare(requirements: DataFrame, skills: DataFrame, tasks: int | None = None) -> DataFrame:
    """job, resume, cov_req, cov_bonus, full_req, full_bonus, score, band of each pair that shares a skill."""
    own = units(requirements)
    totals = ("full_req", "full_bonus")
    own = own.join(unit_totals(own), "job")
    got = lambda k: F.sum(F.when(F.col("kind") == k, F.col("cover")).otherwise(0.0))
    out = covered_units(own, skills, tasks, carry=totals).groupBy("job", "resume").agg(got("required").alias("cov_req"), got("bonus").alias("cov_bonus"), *[F.max(c).alias(c) for c in totals])
    out = out.withColumn("score", F.round(score(*(F.col(c) for c in ("cov_req", "cov_bonus", "full_req", "full_bonus"))), 6))
    return out.withColumn("band", band(F.col("score")))


def recommend(pairs: DataFrame, freshness: DataFrame, k: int = 3) -> DataFrame:
    """The k best jobs of each profile by score, required coverage, freshness and number of sources (freshness: job, latest, n_sources)."""
    order = [F.desc("score"), F.desc("cov_req"), F.desc("latest"), F.desc("n_sources"), "job"]
    return pairs.join(freshness, "job").withColumn("place", F.row_number().over(Window.partitionBy("resume").orderBy(*order))).filter(F.col("place") <= k)


def gaps(requirements: DataFrame, skills: DataFrame) -> DataFrame:
    """resume, job, unit, kind, cover, missing for each unit that a profile covers in part or not at all, of pairs that share a skill."""
    own = units(requirements)
    each = own.groupBy("job", "kind", "unit").agg(F.max("min_required").alias("least"))
    arrays = each.groupBy("job").agg(F.collect_list(F.struct("kind", "unit", "least", unit_key().alias("key"))).alias("units"))
    none = F.transform(absent(), lambda u: F.struct(u["kind"].alias("kind"), u["unit"].alias("unit"), u["least"].alias("least"), F.lit(0.0).alias("cover")))
    rows = pair_parts(own, skills).select("job", "resume", "keys", "part").join(arrays, "job").select("resume", "job", F.explode_outer(F.concat(none, "part")).alias("g")).filter("g is not null")
    return rows.select("resume", "job", "g.kind", "g.unit", (F.col("g.cover") / F.col("g.least")).alias("cover"), F.ceil(F.col("g.least") - F.col("g.cover")).alias("missing"))


def gap_totals(requirements: DataFrame, skills: DataFrame, tasks: int | None = None) -> DataFrame:
    """resume, kind, n_gaps, missing, half_covered: the rows of gaps() counted and summed per profile without making them.

    Of a pair and kind the gaps are all units of the job less those held in whole, and what they miss is the job's sum of minima less the minima of
    the units that the profile holds anything of, plus what these lack; so a pair is a few numbers."""
    own = units(requirements)
    least = F.max("min_required").over(Window.partitionBy("job", "kind", "unit")).alias("of_unit")
    each = own.groupBy("job", "kind", "unit").agg(F.max("min_required").alias("least"))
    kinds = ("required", "bonus")
    sums = [f for k in kinds for f in (F.count(F.when(F.col("kind") == k, 1)).alias(f"units_{k}"), F.sum(F.when(F.col("kind") == k, F.col("least")).otherwise(0)).alias(f"least_{k}"))]
    carry = tuple(f"{c}_{k}" for k in kinds for c in ("units", "least"))
    rich = own.select("job", "kind", "unit", "skill", "level", "min_required", least).join(each.groupBy("job").agg(*sums), "job")
    held = covered_units(rich, skills, tasks, carry=("of_unit", *carry))
    part = F.col("cover") < F.col("least")

    def of(kind: str) -> list[Column]:
        mine = lambda x: F.sum(F.when(F.col("kind") == kind, x).otherwise(0))
        lacks = F.when(part, F.ceil(F.col("least") - F.col("cover"))).otherwise(0)
        n = F.max(f"units_{kind}") - mine(F.when(part, 0).otherwise(1))
        return [n.alias(f"n_{kind}"), (F.max(f"least_{kind}") + mine(lacks - F.col("of_unit"))).alias(f"missing_{kind}"), mine(F.when(part, F.col("cover") / F.col("least")).otherwise(0.0)).alias(f"half_{kind}")]

    names = [f"{c}_{k}" for k in kinds for c in ("n", "missing", "half")]
    pairs = held.groupBy("job", "resume").agg(*[f for k in kinds for f in of(k)])
    sums = pairs.groupBy("resume").agg(*[F.sum(c).alias(c) for c in names])
    row = lambda k: F.struct(F.lit(k).alias("kind"), F.col(f"n_{k}").alias("n_gaps"), F.col(f"missing_{k}").alias("missing"), F.col(f"half_{k}").alias("half_covered"))
    return sums.select("resume", F.explode(F.array(*map(row, kinds))).alias("g")).select("resume", "g.*").filter("n_gaps > 0")


def shift_set(requirements: DataFrame, skills: DataFrame, tasks: int | None = None) -> DataFrame:
    """The shortest run of gap units, largest gain first, that lifts a pair to the next band: resume, job, unit, kind, step, reached.

    What a unit adds when nothing of it is held is a property of the job, so a job's units are sorted once; a pair leaves out what it covers and
    sorts anew only if it covers a unit in part. One fold counts the steps, another follows these alone."""
    own = units(requirements)
    pairs = pair_parts(own, skills, tasks)
    whole = F.col("full_req") + BONUS_WEIGHT * F.col("full_bonus")
    loss = lambda open_, kind: -F.round(open_ * F.when(kind == "bonus", BONUS_WEIGHT).otherwise(1.0) * 100 / whole, 6)
    totals = unit_totals(own)
    each = own.groupBy("job", "kind", "unit").agg(F.max("min_required").alias("least")).join(totals, "job")
    arrays = each.groupBy("job").agg(F.array_sort(F.collect_list(F.struct(loss(F.col("least"), F.col("kind")).alias("loss"), "unit", "kind", unit_key().alias("key")))).alias("units"))
    rows = pairs.join(spread(totals.join(arrays, "job"), tasks, "job"), "job")
    rows = rows.withColumn("score", F.round(score(*(F.col(c) for c in ("cov_req", "cov_bonus", "full_req", "full_bonus"))), 6)).withColumn("cut", next_cut(F.col("score"))).filter("cut is not null")
    partly = F.transform("part", lambda p: F.struct(loss(p["least"] - p["cover"], p["kind"]).alias("loss"), p["unit"].alias("unit"), p["kind"].alias("kind"), F.concat_ws("|", p["kind"], p["unit"]).alias("key")))
    rows = rows.select("resume", "job", "score", "cut", F.when(F.size("part") == 0, absent()).otherwise(F.array_sort(F.concat(absent(), partly))).alias("ordered"))
    short = lambda at: at < F.col("cut") - 1e-5
    count = F.aggregate("ordered", F.struct(F.col("score").alias("at"), F.lit(0).alias("n")), lambda run, g: F.when(short(run["at"]), F.struct((run["at"] - g["loss"]).alias("at"), (run["n"] + 1).alias("n"))).otherwise(run))
    done = F.when(short(F.col("run.at")), 0).otherwise(F.col("run.n"))
    rows = rows.withColumn("run", count).withColumn("path", F.slice("ordered", F.lit(1), done))
    reached = F.slice(F.aggregate("path", F.array("score"), lambda run, g: F.array_append(run, F.element_at(run, -1) - g["loss"])), F.lit(2), F.greatest(F.lit(1), F.size("path")))
    zipped = F.arrays_zip(F.col("path.unit").alias("unit"), F.col("path.kind").alias("kind"), reached.alias("reached"))
    rows = rows.select("resume", "job", F.posexplode_outer(zipped).alias("pos", "p")).filter("pos is not null")  # a filter before it would work all folds out twice
    return rows.select("resume", "job", "p.unit", "p.kind", (F.col("pos") + 1).alias("step"), F.round("p.reached", 4).alias("reached"))


def simulate(requirements: DataFrame, skills: DataFrame, assumed: DataFrame, tasks: int | None = None) -> DataFrame:
    """Scores before and after profiles(resume, skill) are taken to hold assumed skills at the highest level."""
    kept = skills.join(assumed, ["resume", "skill"], "left_anti")
    after = kept.unionByName(assumed.select("resume", "skill", F.lit(3).alias("held")))
    a, b = compare(requirements, skills, tasks), compare(requirements, after, tasks)
    now, then = (x.select("job", "resume", F.col("score").alias(n)) for x, n in ((a, "score_before"), (b, "score_after")))
    return then.join(now, ["job", "resume"], "left").select("job", "resume", F.coalesce("score_before", F.lit(0.0)).alias("score_before"), "score_after")


def direction(pairs: DataFrame, choices: DataFrame, tasks: int | None = None) -> DataFrame:
    """Of two jobs (choices: resume, first, second) the better by band, score, required coverage and bonus coverage; a tie stays undecided. Pairs are read twice, so they are best a table."""
    key = F.struct(F.when(F.col("band") == "high", 3).when(F.col("band") == "basic", 2).when(F.col("band") == "gap", 1).otherwise(0).alias("b"), "score", "cov_req", "cov_bonus")
    keys = pairs.select("resume", "job", key.alias("key"))
    x = keys.select("resume", F.col("job").alias("first"), F.col("key").alias("key_1"))
    y = keys.select("resume", F.col("job").alias("second"), F.col("key").alias("key_2"))
    verdict = F.when(F.col("key_1") > F.col("key_2"), F.col("first")).when(F.col("key_1") < F.col("key_2"), F.col("second"))
    x, y = spread(x, tasks, "resume", "first"), spread(y, tasks, "resume", "second")
    both = spread(spread(choices, tasks, "resume", "second").join(y, ["resume", "second"]), tasks, "resume", "first").join(x, ["resume", "first"])
    return both.select("resume", "first", "second", verdict.alias("better"))


def migration(requirements: DataFrame) -> DataFrame:
    """For jobs that share skills: shared, only in the first, only in the second, from counts and one join on the skill."""
    own = requirements.select("job", "skill").distinct()
    sizes = own.groupBy("job").agg(F.count("*").alias("n"))
    pairs = own.select("skill", F.col("job").alias("job_1")).join(own.select("skill", F.col("job").alias("job_2")), "skill").filter("job_1 < job_2").groupBy("job_1", "job_2").agg(F.count("*").alias("shared"))
    a, b = (sizes.select(F.col("job").alias(f"job_{s}"), F.col("n").alias(f"n_{s}")) for s in (1, 2))
    return pairs.join(a, "job_1").join(b, "job_2").select("job_1", "job_2", "shared", (F.col("n_1") - F.col("shared")).alias("only_1"), (F.col("n_2") - F.col("shared")).alias("only_2"))
