"""Queries on history, votes, status and release, with the SQL that states their results."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import history as h
from ..operators import release as r
from ..operators import votes as vt
from ..sources import views as v
from ..sources.shared import saved

W = "WITH "
R = v.REQUIREMENTS_SQL
H = v.HISTORY_SQL


def version_chains(spark, sf_dir):
    return h.chain_spans(v.history(spark, sf_dir))


CHAINS_SQL = """
lg AS (SELECT *, lag(valid_to) OVER w AS pt, lag(valid_from) OVER w AS pf FROM {src} WINDOW w AS (PARTITION BY job, skill ORDER BY valid_from)),
ch AS (SELECT *, sum(CASE WHEN pf IS NULL THEN 1 WHEN pt IS NULL OR valid_from <= pt THEN 0 ELSE 1 END) OVER (PARTITION BY job, skill ORDER BY valid_from) AS chain FROM lg),
sp AS (SELECT job, skill, chain, min(valid_from) AS start, arg_max(struct_pack(t := valid_to, c := curation), valid_from) AS l, bool_and(curation) AS curated, count(*) AS versions FROM ch GROUP BY job, skill, chain)"""


def period_delta(spark, sf_dir):
    return h.period_delta(v.history(spark, sf_dir))


def asof_slice(spark, sf_dir):
    return h.as_of(v.history(spark, sf_dir), F.lit("1995-06-17").cast("date")).groupBy("job").agg(F.count("*").alias("n_versions"), F.countDistinct("skill").alias("n_skills"))


def scd2_apply(spark, sf_dir):
    """Current: each pair's state by orders before 1995; proposed: its state by those since."""
    rows = v.lines(spark, sf_dir)
    state = lambda x: x.groupBy("job", "skill").agg(F.max(v.level(F.col("quantity"))).alias("level"), F.max("flag").alias("flag"), F.max("observed_on").alias("valid_from"))
    day = F.lit("1995-01-01").cast("date")
    return h.apply_versions(state(rows.filter(F.col("observed_on") < day)), state(rows.filter(F.col("observed_on") >= day)), ["level", "flag"])


def expire_absent(spark, sf_dir):
    """Open versions of skills that the ranked requirements no longer hold, closed at the job's latest start."""
    rows = v.history(spark, sf_dir)
    at = rows.groupBy("job").agg(F.max("valid_from").alias("at"))
    return h.expire_absent(rows, v.requirements(spark, sf_dir), at).filter("expired").select("job", "skill", "valid_from", "valid_to")


def requirement_assembly(spark, sf_dir):
    rows = v.lines(spark, sf_dir)
    evidence = rows.select("job", "skill", "evidence")
    return h.assemble(v.history(spark, sf_dir), evidence, v.retracted(spark, sf_dir), v.tasks(spark, sf_dir)).select("job", "skill", "valid_from", "n_evidence")


def coverage_shift(spark, sf_dir):
    return h.coverage_shift(v.lines(spark, sf_dir), tasks=v.tasks(spark, sf_dir))


def source_stats(spark, sf_dir):
    return vt.source_stats(v.lines(spark, sf_dir))


def job_status(spark, sf_dir):
    """A job is an alias if its number is a multiple of 11, not judged if of 7, and defined if even."""
    stats = vt.source_stats(v.lines(spark, sf_dir))
    state = vt.status(F.col("n_window"), F.col("n_total"), F.col("span_days"), F.col("job") % 7 != 0, F.col("job") % 2 == 0, F.col("job") % 11 == 0)
    return stats.select("job", "n_window", "n_total", "span_days", state.alias("status"))


def votes(spark, sf_dir):
    vote = F.when(F.col("flag") == "N", "required").when(F.col("flag") == "R", "bonus").otherwise("unmarked")
    return v.lines(spark, sf_dir).withColumn("vote", vote)


def vote_summary(spark, sf_dir):
    return vt.vote_summary(votes(spark, sf_dir), v.tasks(spark, sf_dir))


def revote(spark, sf_dir):
    return vt.revote(votes(spark, sf_dir), v.retracted(spark, sf_dir), v.tasks(spark, sf_dir))


def mentions(spark, sf_dir):
    return v.lines(spark, sf_dir).withColumn("confidence", F.col("quantity") / 50).withColumn("excerpt", F.concat(F.col("flag"), F.col("status")))


def mention_rollup(spark, sf_dir):
    return vt.roll_up(mentions(spark, sf_dir), v.tasks(spark, sf_dir))


def coverage_pool(spark, sf_dir):
    """Coverage of a skill over the whole cluster of its job's evidence."""
    rows = mentions(spark, sf_dir)
    return vt.pooled(vt.roll_up(rows, v.tasks(spark, sf_dir)), vt.evidence_sizes(rows, "job")).select("job", "skill", "n_evidence", "coverage", "pooled")


def confidence_layer(spark, sf_dir):
    rolled = vt.roll_up(mentions(spark, sf_dir), v.tasks(spark, sf_dir))
    return rolled.groupBy("job", vt.layer(F.col("excerpt"), F.col("n_sources"), F.col("confidence")).alias("layer")).agg(F.count("*").alias("n"))


def category_majority(spark, sf_dir):
    """The most common order priority of each part, first seen on ties, as its category."""
    orders = v.table(spark, sf_dir, "orders").select("o_orderkey", F.substring("o_orderpriority", 1, 1).alias("category"))
    rows = v.lines(spark, sf_dir).join(orders, F.col("evidence") == F.col("o_orderkey")).withColumn("seen", F.col("evidence") * 10 + F.col("line"))
    return vt.majority(rows, "skill", "category", "seen")


def equivalent_count(spark, sf_dir, rows=None):
    rows = v.requirements(spark, sf_dir) if rows is None else rows
    a = r.equivalent_count(rows, ["required"]).withColumnRenamed("n", "n_required")
    b = r.equivalent_count(rows, ["required", "bonus"]).withColumnRenamed("n", "n_formal")
    return b.join(a, "job", "left").select("job", F.coalesce("n_required", F.lit(0)).alias("n_required"), "n_formal")


def gate_errors(spark, sf_dir, stats=None, ranked=None):
    """All pairs with three mentions, ungrouped, against the ranked table as the previous release; jobs that are multiples of 5 are overridden."""
    stats = saved(v.requirement_stats(spark, sf_dir), "stats") if stats is None else stats
    ranked = v.requirements(spark, sf_dir, stats) if ranked is None else ranked
    stats = stats.filter("n_sources >= 2")
    rows = stats.select("job", "skill", F.when(F.col("explicit") * 2 >= F.col("mentions"), "required").otherwise("bonus").alias("kind"), F.lit(None).cast("string").alias("group_id"), F.lit(1).alias("min_required"))
    overrides = rows.filter("job % 5 = 0").select("job").distinct()
    return r.gate_errors(rows, ranked.filter("rank <= 8"), overrides)


def rank_requirements(spark, sf_dir):
    return v.requirements(spark, sf_dir).select("job", "skill", "kind", "level", "n_sources", "rank", "group_id")


def curation_run(spark, sf_dir):
    """What a curation run changes: ranked requirements against the open versions, per job."""
    ranked = v.requirements(spark, sf_dir).select("job", "skill")
    open_rows = v.history(spark, sf_dir).filter("valid_to is null").select("job", "skill").distinct()
    both = ranked.withColumn("a", F.lit(1)).join(open_rows.withColumn("b", F.lit(1)), ["job", "skill"], "full")
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).alias
    a, b = F.col("a").isNotNull(), F.col("b").isNotNull()
    return both.groupBy("job").agg(n(a & b)("kept"), n(a & ~b)("opened"), n(~a & b)("expired"))


def alternative_groups(spark, sf_dir):
    """Pairs of ranked skills; the given mentions are spread over so many skills that a twentieth of a job's evidence counts as much."""
    rows = v.lines(spark, sf_dir).join(v.requirements(spark, sf_dir).select("job", "skill"), ["job", "skill"]).select("job", "skill", "evidence").distinct()
    return vt.alternative_pairs(rows, least_share=0.05)


def audit(spark, sf_dir):
    """One row per job: counts, period delta, gate. All are read from the same statistics and the same ranked table."""
    stats = saved(v.requirement_stats(spark, sf_dir), "stats")
    ranked = v.requirements(spark, sf_dir, stats)
    counts = equivalent_count(spark, sf_dir, ranked)
    delta = h.period_delta(v.history(spark, sf_dir)).groupBy("job").agg(F.sum((F.col("change") == "added").cast("int")).alias("n_added"), F.sum((F.col("change") == "expired").cast("int")).alias("n_expired"))
    errors = gate_errors(spark, sf_dir, stats, ranked).groupBy("job").agg(F.count("*").alias("n_errors"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return counts.join(delta, "job", "left").join(errors, "job", "left").select("job", "n_required", "n_formal", zero("n_added"), zero("n_expired"), zero("n_errors"))


def two_slices(spark, sf_dir):
    """First and last sources of the older and newer half of each job's evidence, eight each."""
    first = vt.first_per_source(v.lines(spark, sf_dir), ["observed_on", "evidence", "line"])
    w = Window.partitionBy("job")
    rows = first.withColumn("pos", F.row_number().over(w.orderBy("observed_on", "evidence", "line"))).withColumn("size", F.count("*").over(w))
    half = F.when(F.col("pos") * 2 <= F.col("size"), "older").otherwise("newer")
    place = F.when(half == "older", F.col("pos")).otherwise(F.col("size") - F.col("pos") + 1)
    return rows.filter((F.col("size") <= 30) | (place <= 8)).groupBy("job", half.alias("half")).agg(F.count("*").alias("n"), F.min("observed_on").alias("first"), F.max("observed_on").alias("last"))


EQUIV = """
al AS (SELECT job, kind, count(DISTINCT skill) AS n FROM {src} WHERE group_id IS NULL GROUP BY job, kind),
gr AS (SELECT job, kind, sum(m) AS n FROM (SELECT job, kind, group_id, max(min_required) AS m FROM {src} WHERE group_id IS NOT NULL GROUP BY job, kind, group_id) GROUP BY job, kind),
eq AS (SELECT job, CAST(sum(CASE WHEN kind = 'required' THEN n ELSE 0 END) AS BIGINT) AS n_required, CAST(sum(n) AS BIGINT) AS n_formal FROM (SELECT * FROM al UNION ALL SELECT * FROM gr) GROUP BY job)"""
GATE = R + """,
cand AS (SELECT job, skill, CASE WHEN explicit * 2 >= mentions THEN 'required' ELSE 'bonus' END AS kind FROM stats WHERE n_sources >= 2),
now AS (SELECT job, count(DISTINCT CASE WHEN kind = 'required' THEN skill END) AS nr, count(DISTINCT skill) AS nf FROM cand GROUP BY job),
prev AS (SELECT * FROM req WHERE rank <= 8),""" + EQUIV.format(src="prev") + """,
ge AS (
  SELECT job, 'required_over_cap' AS code, nr AS detail FROM now WHERE nr > 12
  UNION ALL SELECT job, 'formal_over_cap', nf FROM now WHERE nf > 24
  UNION ALL SELECT job, 'required_growth', nr - n_required FROM now JOIN eq USING (job) WHERE nr > 0 AND n_required > 0 AND nr - n_required > greatest(3, n_required * 0.5) AND job % 5 <> 0
  UNION ALL SELECT job, 'formal_growth', nf - n_formal FROM now JOIN eq USING (job) WHERE nf - n_formal > greatest(5, n_formal * 0.5) AND job % 5 <> 0)"""
DELTA = "lv AS (SELECT * FROM hist WHERE NOT retracted)," + CHAINS_SQL.format(src="lv") + """,
nw AS (SELECT * FROM (SELECT *, max(chain) OVER (PARTITION BY job, skill) AS top FROM sp) WHERE chain = top AND NOT curated),
qt AS (SELECT *, CAST(date_trunc('quarter', max(greatest(start, l.t)) OVER (PARTITION BY job)) AS DATE) AS quarter FROM nw),
dl AS (SELECT job, quarter, skill, CASE WHEN l.t IS NOT NULL AND l.t >= quarter AND l.t < quarter + INTERVAL 3 MONTH AND NOT l.c THEN 'expired'
              WHEN l.t IS NULL AND start >= quarter AND start < quarter + INTERVAL 3 MONTH THEN 'added' END AS change FROM qt)"""
VOTES = """
vr AS (SELECT job, skill, evidence, max(CASE flag WHEN 'N' THEN 2 WHEN 'R' THEN 1 ELSE 0 END) AS r, min(source) AS source FROM {src} GROUP BY job, skill, evidence),
vs AS (SELECT job, skill, sum(CASE WHEN r = 2 THEN 1 ELSE 0 END) AS required, sum(CASE WHEN r = 1 THEN 1 ELSE 0 END) AS bonus, sum(CASE WHEN r = 0 THEN 1 ELSE 0 END) AS unmarked,
              count(DISTINCT CASE WHEN r = 2 THEN source END) AS s_required, count(DISTINCT CASE WHEN r = 1 THEN source END) AS s_bonus FROM vr GROUP BY job, skill),
vk AS (SELECT *, CASE WHEN required + bonus > 0 AND required >= 0.6 * (required + bonus) AND s_required >= 2 THEN 'required'
                      WHEN required + bonus > 0 AND bonus >= 0.6 * (required + bonus) AND s_bonus >= 2 THEN 'bonus' END AS kind FROM vs)"""
ROLL = "ro AS (SELECT job, skill, count(DISTINCT evidence) AS n_evidence, count(DISTINCT source) AS n_sources, max(quantity / 50) AS confidence, arg_max(flag || status, (observed_on, evidence, line)) AS excerpt FROM {src} GROUP BY job, skill)"

QUERIES = {
    "version_chains": (version_chains, W + H + "," + CHAINS_SQL.format(src="hist") + " SELECT job, skill, chain, start, l.t AS stop, curated, l.c AS tail_curated, versions FROM sp"),
    "period_delta": (period_delta, W + H + "," + DELTA + " SELECT * FROM dl WHERE change IS NOT NULL"),
    "asof_slice": (asof_slice, W + H + " SELECT job, count(*) AS n_versions, count(DISTINCT skill) AS n_skills FROM hist WHERE valid_from <= DATE '1995-06-17' AND (valid_to IS NULL OR DATE '1995-06-17' < valid_to) GROUP BY job"),
    "scd2_apply": (scd2_apply, W + R + """,
c AS (SELECT job, skill, max(CASE WHEN quantity >= 34 THEN 3 WHEN quantity >= 17 THEN 2 ELSE 1 END) AS level, max(flag) AS flag, max(observed_on) AS valid_from FROM ln WHERE observed_on < DATE '1995-01-01' GROUP BY job, skill),
n AS (SELECT job, skill, max(CASE WHEN quantity >= 34 THEN 3 WHEN quantity >= 17 THEN 2 ELSE 1 END) AS level, max(flag) AS flag, max(observed_on) AS valid_from FROM ln WHERE observed_on >= DATE '1995-01-01' GROUP BY job, skill)
SELECT c.job, c.skill, c.level, c.flag, c.valid_from, CASE WHEN (c.level, c.flag) <> (n.level, n.flag) THEN greatest(c.valid_from, n.valid_from) END AS valid_to,
       CASE WHEN n.job IS NULL THEN 'kept' WHEN (c.level, c.flag) <> (n.level, n.flag) THEN 'closed' ELSE 'same' END AS op FROM c LEFT JOIN n ON n.job = c.job AND n.skill = c.skill
UNION ALL SELECT n.job, n.skill, n.level, n.flag, n.valid_from, NULL, 'opened' FROM n LEFT JOIN c ON n.job = c.job AND n.skill = c.skill WHERE c.job IS NULL OR (c.level, c.flag) <> (n.level, n.flag)"""),
    "expire_absent": (expire_absent, W + H + "," + R + """, mx AS (SELECT job, max(valid_from) AS day FROM hist GROUP BY job)
SELECT h.job, h.skill, h.valid_from, day AS valid_to FROM hist h JOIN mx USING (job) WHERE h.valid_to IS NULL AND h.valid_from <= day AND h.job IN (SELECT job FROM req)
AND NOT EXISTS (SELECT 1 FROM req WHERE req.job = h.job AND req.skill = h.skill)"""),
    "requirement_assembly": (requirement_assembly, W + H + "," + R + """, bad AS (SELECT DISTINCT job, skill FROM ln WHERE evidence IN (SELECT evidence FROM ln WHERE line = 7)),
ec AS (SELECT job, skill, count(DISTINCT evidence) AS n_evidence FROM ln GROUP BY job, skill)
SELECT h.job, h.skill, valid_from, coalesce(n_evidence, 0) AS n_evidence FROM hist h LEFT JOIN ec ON ec.job = h.job AND ec.skill = h.skill
WHERE valid_to IS NULL AND NOT retracted AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.job = h.job AND bad.skill = h.skill)"""),
    "coverage_shift": (coverage_shift, W + R + """, q AS (SELECT *, CAST(date_trunc('quarter', observed_on) AS DATE) AS quarter FROM ln),
sz AS (SELECT job, quarter, count(DISTINCT evidence) AS size FROM q GROUP BY job, quarter),
cg AS (SELECT job, skill, quarter, count(DISTINCT evidence) / max(size) AS coverage FROM q JOIN sz USING (job, quarter) GROUP BY job, skill, quarter),
bf AS (SELECT *, coalesce(lag(coverage) OVER (PARTITION BY job, skill ORDER BY quarter), 0) AS before FROM cg)
SELECT job, skill, quarter, round(coverage, 6) AS coverage, round(coverage - before, 6) AS shift, before < 0.15 AND coverage >= 0.3 AS crossed FROM bf"""),
    "source_stats": (source_stats, W + R + """, lt AS (SELECT job, max(observed_on) AS latest FROM ln GROUP BY job)
SELECT job, count(DISTINCT CASE WHEN observed_on >= latest - 90 THEN source END) AS n_window, count(DISTINCT source) AS n_total, max(observed_on) - min(observed_on) AS span_days FROM ln JOIN lt USING (job) GROUP BY job"""),
    "job_status": (job_status, W + R + """, lt AS (SELECT job, max(observed_on) AS latest FROM ln GROUP BY job),
st AS (SELECT job, count(DISTINCT CASE WHEN observed_on >= latest - 90 THEN source END) AS n_window, count(DISTINCT source) AS n_total, max(observed_on) - min(observed_on) AS span_days FROM ln JOIN lt USING (job) GROUP BY job)
SELECT *, CASE WHEN job % 11 = 0 OR job % 7 = 0 THEN 'candidate' WHEN job % 2 = 0 AND (n_total >= 10 OR span_days >= 180) THEN 'formed' WHEN n_window >= 3 THEN 'emerging' ELSE 'candidate' END AS status FROM st"""),
    "vote_summary": (vote_summary, W + R + "," + VOTES.format(src="ln") + " SELECT * FROM vk"),
    "revote": (revote, W + R + ", gd AS (SELECT * FROM ln WHERE evidence NOT IN (SELECT evidence FROM ln WHERE line = 7))," + VOTES.format(src="ln") + "," + VOTES.format(src="gd").replace("vr ", "vr2 ").replace("FROM vr ", "FROM vr2 ").replace("vs AS", "vs2 AS").replace("FROM vr2 GROUP", "FROM vr2 GROUP").replace("vk AS", "vk2 AS").replace("FROM vs)", "FROM vs2)") + """
SELECT a.job, a.skill, a.kind AS kind_before, b.kind AS kind_after FROM vk a LEFT JOIN vk2 b ON a.job = b.job AND a.skill = b.skill WHERE a.kind IS DISTINCT FROM b.kind"""),
    "mention_rollup": (mention_rollup, W + R + "," + ROLL.format(src="ln") + " SELECT * FROM ro"),
    "coverage_pool": (coverage_pool, W + R + ", sz AS (SELECT job, count(DISTINCT evidence) AS size FROM ln GROUP BY job)," + ROLL.format(src="ln") + """
SELECT job, skill, n_evidence, round(n_evidence / size, 6) AS coverage, n_evidence / size >= 0.3 AS pooled FROM ro JOIN sz USING (job)"""),
    "confidence_layer": (confidence_layer, W + R + "," + ROLL.format(src="ln") + """
SELECT job, CASE WHEN excerpt = '' THEN 'low' WHEN n_sources >= 3 AND confidence >= 0.8 THEN 'high' WHEN n_sources >= 2 AND confidence >= 0.5 THEN 'mid' ELSE 'low' END AS layer, count(*) AS n FROM ro GROUP BY ALL"""),
    "category_majority": (category_majority, W + R + """, ct AS (SELECT skill, substr(o_orderpriority, 1, 1) AS category, count(*) AS n, min(evidence * 10 + line) AS seen FROM ln JOIN orders ON o_orderkey = evidence GROUP BY ALL)
SELECT skill, arg_max(category, (n, -seen)) AS category, max(n) AS n FROM ct GROUP BY skill"""),
    "equivalent_count": (equivalent_count, W + R + "," + EQUIV.format(src="req") + " SELECT * FROM eq"),
    "gate_errors": (gate_errors, W + GATE + " SELECT * FROM ge"),
    "rank_requirements": (rank_requirements, W + R + " SELECT job, skill, kind, level, n_sources, rank, group_id FROM req"),
    "curation_run": (curation_run, W + R + "," + H + """, op AS (SELECT DISTINCT job, skill FROM hist WHERE valid_to IS NULL),
bo AS (SELECT coalesce(a.job, b.job) AS job, a.job IS NOT NULL AS a, b.job IS NOT NULL AS b FROM req a FULL JOIN op b ON a.job = b.job AND a.skill = b.skill)
SELECT job, sum(CASE WHEN a AND b THEN 1 ELSE 0 END) AS kept, sum(CASE WHEN a AND NOT b THEN 1 ELSE 0 END) AS opened, sum(CASE WHEN b AND NOT a THEN 1 ELSE 0 END) AS expired FROM bo GROUP BY job"""),
    "alternative_groups": (alternative_groups, W + R + """, m AS (SELECT DISTINCT ln.job, ln.skill, evidence FROM ln JOIN req ON ln.job = req.job AND ln.skill = req.skill),
n AS (SELECT job, skill, count(*) AS n FROM m GROUP BY job, skill), sz AS (SELECT job, count(DISTINCT evidence) AS size FROM m GROUP BY job),
bo AS (SELECT a.job, a.skill AS s1, b.skill AS s2, count(*) AS meet FROM m a JOIN m b ON a.job = b.job AND a.evidence = b.evidence AND a.skill < b.skill GROUP BY ALL),
pa AS (SELECT a.job, a.skill AS skill_1, b.skill AS skill_2, coalesce(meet, 0) AS meet, a.n AS n1, b.n AS n2, size FROM n a JOIN n b ON a.job = b.job AND a.skill < b.skill JOIN sz ON sz.job = a.job LEFT JOIN bo ON bo.job = a.job AND s1 = a.skill AND s2 = b.skill)
SELECT job, skill_1, skill_2, meet, round((n1 + n2 - meet) / size, 6) AS coverage FROM pa WHERE (n1 + n2 - meet) / size >= 0.05 AND meet <= 0.1 * least(n1, n2)"""),
    "audit": (audit, W + GATE.replace("\neq AS", "\neqp AS").replace("JOIN eq ", "JOIN eqp ").replace("\nal AS", "\nalp AS").replace("\ngr AS", "\ngrp AS").replace("FROM al ", "FROM alp ").replace("FROM gr)", "FROM grp)") + "," + EQUIV.format(src="req") + "," + H + "," + DELTA + """,
d2 AS (SELECT job, sum(CASE WHEN change = 'added' THEN 1 ELSE 0 END) AS n_added, sum(CASE WHEN change = 'expired' THEN 1 ELSE 0 END) AS n_expired FROM dl WHERE change IS NOT NULL GROUP BY job),
e2 AS (SELECT job, count(*) AS n_errors FROM ge GROUP BY job)
SELECT job, n_required, n_formal, coalesce(n_added, 0) AS n_added, coalesce(n_expired, 0) AS n_expired, coalesce(n_errors, 0) AS n_errors FROM eq LEFT JOIN d2 USING (job) LEFT JOIN e2 USING (job)"""),
    "two_slices": (two_slices, W + R + """, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job, source ORDER BY observed_on, evidence, line) AS nth FROM ln) WHERE nth = 1),
p AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY observed_on, evidence, line) AS pos, count(*) OVER (PARTITION BY job) AS size FROM f),
g AS (SELECT *, CASE WHEN pos * 2 <= size THEN 'older' ELSE 'newer' END AS half, CASE WHEN pos * 2 <= size THEN pos ELSE size - pos + 1 END AS place FROM p)
SELECT job, half, count(*) AS n, min(observed_on) AS first, max(observed_on) AS last FROM g WHERE size <= 30 OR place <= 8 GROUP BY job, half"""),
}
