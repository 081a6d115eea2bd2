"""The whole release gate on requirements and definition claims, and the repair of claims.

Inputs: jobs(job); requires(job, skill, name, kind, group_id, min_required, sources array<string>, excerpt); claims(job, claim, text,
excerpt, sources); evidence(job, id, body, retracted), one row per job and id. A source's body moves to its citations once, in a
join on (job, id) whose output is the answer of a containment test, never the body itself. All counts are grouped sums that
combine before they shuffle; what fails is a row of its own, so nothing is gathered per job.

Defined results: null and blank texts, sources, groups and kinds are missing ones; a job without any requirement or claim still gets its
row; a claim without sources isn't held against evidence; a group's minimum is that of its first skill (the least one, if that repeats); repeated requirement rows
are reported as duplicates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import saved
from .release import FORMAL_CAP, REQUIRED_CAP

#: What joins a job's name to its fragments, and fragments to each other; white space as the rules strip it.
PREFIX, JOINT = "的招聘信息主要围绕：", "；"
BLANKS = r"[\x09-\x0D\x1C-\x20\x85\p{Z}]"
#: The codes in their order, and what a reader is told.
LABELS = {
    "definition_missing": "岗位定义尚未生成",
    "required_group_missing": "没有有效必备要求",
    "invalid_requirement_group": "要求组不完整",
    "evidence_missing": "要求缺少有效证据",
    "evidence_retracted": "要求引用了已撤回证据",
    "duplicate_requirement": "要求存在重复技能",
    "required_count_exceeded": "必备要求超过 12 个等价项",
    "formal_count_exceeded": "正式要求超过 24 个等价项",
    "required_delta_anomaly": "必备要求增量异常",
    "formal_delta_anomaly": "正式要求增量异常",
}
ANOMALIES = ["required_delta_anomaly", "formal_delta_anomaly"]


def stripped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"^{BLANKS}+|{BLANKS}+$", "")


def present(sources: Column) -> Column:
    """The sources that have a name, each once."""
    return F.array_distinct(F.filter(F.coalesce(sources, F.array().cast("array<string>")), lambda s: s.isNotNull() & (s != "")))


def fragments(claims: DataFrame) -> DataFrame:
    """claims with the ``prefix`` and the ``fragments`` of their excerpt, or of their text where that is missing."""
    said = stripped(F.coalesce(F.nullif("excerpt", F.lit("")), F.col("text")))
    rows = claims.withColumn("said", said).withColumn("cut", F.instr(F.col("said"), PREFIX))
    head = F.when(F.col("cut") > 0, F.expr(f"substring(said, 1, cut + {len(PREFIX) - 1})")).otherwise("")
    rest = F.when(F.col("cut") > 0, F.expr(f"substring(said, cut + {len(PREFIX)})")).otherwise(F.col("said"))
    parts = F.filter(F.transform(F.split(rest, JOINT), stripped), lambda x: x != "")
    return rows.withColumn("prefix", head).withColumn("fragments", parts).drop("said", "cut")


def _bodies(evidence: DataFrame) -> DataFrame:
    return evidence.select("job", "id", F.coalesce("body", F.lit("")).alias("body"), F.coalesce("retracted", F.lit(False)).alias("retracted"))


def requirement_issues(requires: DataFrame, evidence: DataFrame) -> DataFrame:
    """job, skill, kind, excerpt, reasons, retracted of each different requirement that has any."""
    rows = requires.select("job", F.coalesce(F.col("skill"), F.col("name"), F.lit("")).alias("skill"), "kind", stripped(F.col("excerpt")).alias("excerpt"), present(F.col("sources")).alias("sources")).distinct()
    cited = rows.withColumn("id", F.explode_outer("sources")).join(_bodies(evidence), ["job", "id"], "left")
    known, own = F.col("retracted").isNotNull(), ["job", "skill", "kind", "excerpt", "sources"]
    told = cited.select(*own, (F.col("id").isNotNull() & ~known).alias("unknown"), (known & (F.col("body") != "")).alias("readable"), F.coalesce(F.contains("body", "excerpt"), F.lit(False)).alias("held"), F.when(F.col("retracted"), F.col("id")).alias("withdrawn"))
    of = told.groupBy(*own).agg(F.max("unknown").alias("unknown"), F.max("readable").alias("readable"), F.max("held").alias("held"), F.array_sort(F.collect_set("withdrawn")).alias("retracted"))
    blank = F.col("excerpt") == ""
    reasons = F.array_compact(F.array(
        F.when(blank, "excerpt_missing"), F.when(~blank & F.col("readable") & ~F.col("held"), "excerpt_not_in_evidence"), F.when(F.size("sources") == 0, "no_sources"), F.when(F.col("unknown"), "source_unknown"),
    ))
    return of.select("job", "skill", "kind", "excerpt", reasons.alias("reasons"), "retracted").filter("size(reasons) > 0 or size(retracted) > 0")


def checked_fragments(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """job, claim, place, fragment, supported, sources (those whose body holds the fragment word for word) of each claim's fragments."""
    rows = fragments(claims).select("job", "claim", "fragments", present(F.col("sources")).alias("cited"))
    asked = rows.select("job", "claim", "fragments", F.explode("cited").alias("id")).join(_bodies(evidence), ["job", "id"])
    held = asked.select("job", "claim", "id", F.posexplode(F.transform("fragments", lambda f: F.contains(F.col("body"), f))).alias("place", "held")).filter("held")
    found = held.groupBy("job", "claim", "place").agg(F.array_sort(F.collect_set("id")).alias("found"))
    every = rows.select("job", "claim", F.posexplode("fragments").alias("place", "fragment"))
    joined = every.join(found, ["job", "claim", "place"], "left")
    return joined.select("job", "claim", "place", "fragment", F.col("found").isNotNull().alias("supported"), F.coalesce("found", F.array().cast("array<string>")).alias("sources"))


def live(claims: DataFrame) -> DataFrame:
    return claims.filter(stripped(F.col("text")) != "")


def claim_issues(claims: DataFrame, evidence: DataFrame, checked: DataFrame | None = None) -> DataFrame:
    """job, claim, reason of the claims that cite evidence and fail: a source is unknown or retracted, or a fragment is in no cited body."""
    checked = checked_fragments(claims, evidence) if checked is None else checked
    rows = live(claims).select("job", "claim", present(F.col("sources")).alias("cited")).filter("size(cited) > 0")
    known = evidence.select("job", "id", F.coalesce("retracted", F.lit(False)).alias("retracted"))
    gone = rows.select("job", "claim", F.explode("cited").alias("id")).join(known, ["job", "id"], "left").groupBy("job", "claim").agg(F.max(F.coalesce("retracted", F.lit(True))).alias("gone"))
    whole = checked.groupBy("job", "claim").agg(F.min("supported").alias("whole"))
    told = gone.join(whole, ["job", "claim"], "left")
    reason = F.when(F.col("gone"), "source_unavailable").when(~F.coalesce("whole", F.lit(False)), "fragment_not_in_evidence")
    return told.select("job", "claim", reason.alias("reason")).filter("reason is not null")


def units(requires: DataFrame) -> DataFrame:
    """job, unit, and what each counts: a standalone skill 1, a group the minimum of its first skill. Also what tells an invalid group."""
    group = F.nullif("group_id", F.lit(""))
    rows = requires.select("job", "skill", "kind", group.alias("group_id"), F.coalesce(F.nullif("min_required", F.lit(0)), F.lit(1)).alias("least"))
    rows = rows.filter("group_id is not null or skill is not null").withColumn("unit", F.when(F.col("group_id").isNotNull(), F.concat(F.lit("g:"), F.col("group_id"))).otherwise(F.concat(F.lit("s:"), F.col("skill").cast("string"))))
    first = lambda kinds: F.min(F.when(F.col("kind").isin(kinds), F.struct("skill", "least")))["least"]
    out = rows.groupBy("job", "unit").agg(
        F.first("group_id").alias("group_id"), first(["required"]).alias("required"), first(["required", "bonus"]).alias("formal"),
        F.countDistinct(F.coalesce("kind", F.lit(""))).alias("kinds"), F.min("least").alias("low"), F.max("least").alias("high"), F.count("*").alias("size"),
    )
    cost = lambda c: F.when(F.col(c).isNull(), 0).when(F.col("group_id").isNull(), 1).otherwise(F.greatest(F.lit(1), F.col(c))).cast("long")
    return out.withColumn("required", cost("required")).withColumn("formal", cost("formal"))


def counts(of_units: DataFrame) -> DataFrame:
    return of_units.groupBy("job").agg(F.sum("required").alias("required"), F.sum("formal").alias("formal"))


def gate(jobs: DataFrame, requires: DataFrame, claims: DataFrame, evidence: DataFrame, previous: DataFrame, overrides: DataFrame) -> DataFrame:
    """job, code, item, reasons: everything that keeps a job from release. overrides(job) clear the two anomalies of growth alone."""
    text = lambda c: F.col(c).cast("string")
    row = lambda df, code, item, reasons="": df.select("job", F.lit(code).alias("code"), item.alias("item"), (F.lit(reasons) if isinstance(reasons, str) else reasons).alias("reasons"))
    own = saved(units(requires), "gate-units")
    issues = saved(requirement_issues(requires, evidence), "gate-issues")
    was = counts(units(previous)).select("job", F.col("required").alias("was_required"), F.col("formal").alias("was_formal"))
    now = jobs.select("job").distinct().join(counts(own), "job", "left").join(was, "job", "left").join(overrides.select("job", F.lit(True).alias("overridden")).distinct(), "job", "left")
    for c in ("required", "formal"):
        now = now.withColumn(c, F.coalesce(c, F.lit(0)))
    now = saved(now, "gate-counts")
    grown = lambda c, floor: now.filter(F.col(f"was_{c}").isNotNull() & F.col("overridden").isNull() & (F.col(c) - F.col(f"was_{c}") > F.greatest(F.lit(float(floor)), F.col(f"was_{c}") * 0.5)))
    bad = F.array_compact(F.array(F.when(F.col("low").isNull() | (F.col("low") != F.col("high")) | (F.col("low") < 1) | (F.col("low") > F.col("size")), "min_required_out_of_range"), F.when(F.col("kinds") != 1, "mixed_kind")))
    groups = own.filter("group_id is not null").withColumn("bad", bad).filter("size(bad) > 0")
    found = [
        row(jobs.select("job").distinct().join(live(claims).select("job").distinct(), "job", "left_anti"), "definition_missing", F.lit("")),
        row(now.filter("required = 0"), "required_group_missing", F.lit("")),
        row(groups, "invalid_requirement_group", text("group_id"), F.array_join("bad", ",")),
        row(issues.filter("size(reasons) > 0").select("job", "skill", F.array_join("reasons", ",").alias("why")).distinct(), "evidence_missing", text("skill"), F.col("why")),
        row(claim_issues(claims, evidence), "evidence_missing", text("claim"), F.col("reason")),
        row(issues.select("job", F.explode("retracted").alias("id")).distinct(), "evidence_retracted", text("id")),
        row(requires.filter("skill is not null").groupBy("job", "skill").agg(F.count("*").alias("n")).filter("n > 1"), "duplicate_requirement", text("skill")),
        row(now.filter(F.col("required") > REQUIRED_CAP), "required_count_exceeded", text("required")),
        row(now.filter(F.col("formal") > FORMAL_CAP), "formal_count_exceeded", text("formal")),
        row(grown("required", 3), ANOMALIES[0], (F.col("required") - F.col("was_required")).cast("string")),
        row(grown("formal", 5), ANOMALIES[1], (F.col("formal") - F.col("was_formal")).cast("string")),
    ]
    whole = found[0]
    for part in found[1:]:
        whole = whole.unionByName(part)
    return whole


def verdicts(jobs: DataFrame, findings: DataFrame) -> DataFrame:
    """job, ok, codes (in their order), reason: what the first two codes tell a reader. One grouped pass over the findings."""
    told = findings.groupBy("job").agg(*(F.max(F.col("code") == c).alias(c) for c in LABELS))
    rows = jobs.select("job").distinct().join(told, "job", "left")
    codes = F.array_compact(F.array(*(F.when(F.col(c), c) for c in LABELS)))
    labels = F.array_compact(F.array(*(F.when(F.col(c), label) for c, label in LABELS.items())))
    return rows.select("job", (F.size(codes) == 0).alias("ok"), F.array_join(codes, ",").alias("codes"), F.array_join(F.slice(labels, 1, 2), JOINT).alias("reason"))


def repair_claims(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """claims without the fragments that no cited body holds. status: sound (nothing to drop), repaired, or lost (nothing is left, and the claim stays as it was)."""
    rows = saved(checked_fragments(live(claims), evidence), "claim-fragments")
    ordered = F.array_sort(F.collect_list(F.when(F.col("supported"), F.struct("place", "fragment"))))
    of = rows.groupBy("job", "claim").agg(F.count("*").alias("n_fragments"), F.sum((~F.col("supported")).cast("long")).alias("n_dropped"), ordered.alias("kept"))
    out = fragments(live(claims)).join(of, ["job", "claim"], "left")
    kept = F.array_distinct(F.transform("kept", lambda x: x["fragment"]))
    cited = F.size(present(F.col("sources"))) > 0
    status = F.when(~cited | (F.col("n_dropped") == 0), "sound").when(F.size(F.coalesce("kept", F.array())) > 0, "repaired").otherwise("lost")
    out = out.withColumn("status", status).withColumn("text", F.when(F.col("status") == "repaired", F.concat("prefix", F.array_join(kept, JOINT))).otherwise(F.col("text")))
    excerpt = F.when(F.col("status") != "repaired", F.col("excerpt"))
    return out.select("job", "claim", "text", excerpt.alias("excerpt"), "sources", "status", F.coalesce("n_fragments", F.lit(0)).alias("n_fragments"), F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"))


def repair_and_check(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """The repaired claims, and whether each passes the gate's check then: dropping fragments heals no source that is gone."""
    repaired = saved(repair_claims(claims, evidence), "claims-repaired")
    failing = claim_issues(repaired, evidence).select("job", "claim", F.col("reason").alias("left_over"))
    return repaired.join(failing, ["job", "claim"], "left").withColumn("passes", F.col("left_over").isNull())


def edit_claims(claims: DataFrame, edits: DataFrame, evidence: DataFrame) -> DataFrame:
    """What becomes of edits(job, claim, new_text): job, claim, text, accepted, unsupported. The old prefix is put before a new text without one; an edit
    is accepted if it isn't blank and each of its fragments is in a cited body."""
    old = fragments(claims).select("job", "claim", "prefix", "sources").join(edits, ["job", "claim"])
    new = stripped(F.col("new_text"))
    text = F.when((new != "") & ~F.contains(new, F.lit(PREFIX)), F.concat("prefix", new)).otherwise(new)
    rows = old.select("job", "claim", text.alias("text"), F.lit(None).cast("string").alias("excerpt"), "sources")
    told = checked_fragments(rows, evidence).groupBy("job", "claim").agg(F.min("supported").alias("whole"), F.array_sort(F.collect_list(F.when(~F.col("supported"), F.col("fragment")))).alias("unsupported"))
    out = rows.join(told, ["job", "claim"], "left")
    return out.select("job", "claim", "text", F.coalesce("whole", F.lit(False)).alias("accepted"), F.coalesce("unsupported", F.array().cast("array<string>")).alias("unsupported"))
