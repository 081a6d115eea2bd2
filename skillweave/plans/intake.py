"""Queries on intake, proposals and review, with the SQL that states their results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history, mentions, release, votes
from ..sources import postings
from ..sources import views as v
from ..sources.shared import saved
from . import facts

W, R = "WITH ", v.REQUIREMENTS_SQL


def payload_coerce(spark, sf_dir):
    """Payloads of events as model answers in code fences: their number as a confidence."""
    answer = F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    number = F.get_json_object(mentions.unwrapped(answer), "$.k")
    return v.table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg(mentions.confidence(number)), 6).alias("confidence"), F.sum(mentions.positive(number).cast("long")).alias("total"))


def proposals(spark, sf_dir):
    """A proposal per rolled-up pair with three sources, under its content's name."""
    tasks = v.tasks(spark, sf_dir)
    rolled = votes.roll_up(facts.mentions(spark, sf_dir), tasks).filter("n_sources >= 2")
    kinds = votes.vote_summary(facts.votes(spark, sf_dir), tasks).select("job", "skill", "kind")
    rows = rolled.join(kinds, ["job", "skill"], "left").withColumn("layer", votes.layer(F.col("excerpt"), F.col("n_sources"), F.col("confidence")))
    name = F.concat(F.lit("evt-"), F.substring(F.sha2(F.concat_ws("|", "job", "skill", F.coalesce("kind", F.lit("")), "layer"), 256), 1, 20))
    return rows.select(name.alias("id"), "job", "skill", "kind", "layer", "n_sources", "excerpt")


def review_effects(spark, sf_dir):
    """Decisions: all approvals and rejections among the events of the job's number; the job's last one holds for each of its proposals."""
    own = saved(proposals(spark, sf_dir), "proposals")
    made = v.events(spark, sf_dir).filter("review in ('approved', 'rejected')")
    last = made.groupBy("job").agg(F.max_by("review", "id").alias("review"), F.max("id").alias("decided_at"))
    decisions = own.select("id", "job").join(last, "job").select("id", "review", "decided_at")
    return votes.review_effects(own, decisions).groupBy("layer", "review").agg(F.count("*").alias("n"))


def definition_passed(spark, sf_dir):
    """Ranked skills as claims; bonus ones are scenarios."""
    rows = v.requirements(spark, sf_dir).filter("rank <= 10")
    claims = rows.select("job", F.col("skill").alias("claim"), F.when(F.col("kind") == "bonus", "scenario").otherwise("responsibility").alias("type"), "n_sources")
    return release.definition_passed(claims)


def budget_selection(spark, sf_dir):
    """Units of the requirement table under the caps; a group costs its size."""
    rows = v.requirements(spark, sf_dir)
    unit = F.coalesce("group_id", F.col("skill").cast("string"))
    units = rows.groupBy("job", unit.alias("unit")).agg(F.min("rank").alias("place"), F.count("*").alias("cost"), F.max((F.col("kind") == "required").cast("int")).alias("wants"))
    return release.select_within_budget(units, 6, 14)


def group_repair(spark, sf_dir):
    rows = release.repair_groups(release.repair_groups(v.requirements(spark, sf_dir), "split_by_kind"), "set_min_required", 2)
    return release.equivalent_count(rows, ["required", "bonus"]).withColumnRenamed("n", "n_formal")


def group_coverage(spark, sf_dir):
    groups = v.requirements(spark, sf_dir).filter("group_id is not null").select("job", "skill", F.concat_ws(":", "kind", "group_id").alias("group_id"), "min_required")
    return mentions.group_coverage(v.lines(spark, sf_dir), groups, v.tasks(spark, sf_dir))


def skill_merge(spark, sf_dir):
    """Every seventh skill is merged into the next one."""
    skills = v.table(spark, sf_dir, "part").filter("p_partkey % 7 = 0").select(F.col("p_partkey").alias("old"), (F.col("p_partkey") + 1).alias("canonical"))
    return history.merge_skills(v.lines(spark, sf_dir), skills).groupBy("skill").agg(F.count("*").alias("n"), F.countDistinct("job").alias("n_jobs"))


def evidence_upsert(spark, sf_dir):
    """The latest order of each customer."""
    orders = v.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey", F.to_date("o_orderdate").alias("day"), "o_orderstatus")
    return history.latest_wins(orders, ["id"], ["day", "o_orderkey"])


def referential_check(spark, sf_dir):
    """Rows of edge tables whose end is missing: orders of customers, lines of the first half of the orders."""
    orders, customers, item = (v.table(spark, sf_dir, t) for t in ("orders", "customer", "lineitem"))
    half = orders.filter("o_orderkey % 2 = 0")
    a = release.missing_endpoints(orders, "o_custkey", customers.filter("c_custkey % 10 <> 0"), "c_custkey").agg(F.count("*").alias("n")).select(F.lit("orders").alias("edge"), "n")
    b = release.missing_endpoints(item, "l_orderkey", half, "o_orderkey").agg(F.count("*").alias("n")).select(F.lit("lineitem").alias("edge"), "n")
    return a.unionByName(b)


def staleness(spark, sf_dir):
    log = v.events(spark, sf_dir).select("kind", (F.col("value") > 30).alias("ok"), F.struct("at", "id").alias("key"), "at")
    last = log.groupBy("kind").agg(F.max_by("ok", "key").alias("ok"), F.max("at").alias("at"))
    good = log.filter("ok").groupBy("kind").agg(F.max("at").alias("at")).withColumn("ok", F.lit(True))
    return postings.stale(last.unionByName(good), F.lit("2024-02-01 12:00:00").cast("timestamp")).select("kind", "stale")


def invented_numbers(spark, sf_dir):
    """Turns with a number that the conversation's first turn lacks."""
    rows = v.table(spark, sf_dir, "conversations")
    first = rows.groupBy("conv_id").agg(F.min_by("text", "turn").alias("source"))
    return rows.join(first, "conv_id").groupBy("role", mentions.grounded(F.col("text"), F.col("source")).alias("grounded")).agg(F.count("*").alias("n"))


ROLLED = facts.VOTES.format(src="ln") + "," + facts.ROLL.format(src="ln") + """,
pp AS (SELECT ro.job, ro.skill, kind, CASE WHEN excerpt = '' THEN 'low' WHEN n_sources >= 3 AND confidence >= 0.8 THEN 'high' WHEN n_sources >= 2 AND confidence >= 0.5 THEN 'mid' ELSE 'low' END AS layer, n_sources, excerpt
       FROM ro LEFT JOIN vk ON vk.job = ro.job AND vk.skill = ro.skill WHERE n_sources >= 2),
pq AS (SELECT 'evt-' || substr(sha256(job || '|' || skill || '|' || coalesce(kind, '') || '|' || layer), 1, 20) AS id, * FROM pp)"""

QUERIES = {
    "payload_coerce": (payload_coerce, "WITH e AS (SELECT event_type, TRY_CAST(props ->> '$.k' AS DOUBLE) AS k FROM events) SELECT event_type, round(avg(CASE WHEN k IS NULL THEN 0.5 ELSE least(1.0, greatest(0.0, CASE WHEN k > 1 THEN k / 100 ELSE k END)) END), 6) AS confidence, CAST(sum(CASE WHEN k >= 1 THEN floor(k) ELSE 1 END) AS BIGINT) AS total FROM e GROUP BY event_type"),
    "proposals": (proposals, W + R + "," + ROLLED + " SELECT id, job, skill, kind, layer, n_sources, excerpt FROM pq"),
    "review_effects": (review_effects, W + R + "," + ROLLED + "," + v.EVENTS_SQL + """, dc AS (SELECT job, arg_max(review, id) AS review FROM ev WHERE review IN ('approved', 'rejected') GROUP BY job)
SELECT layer, coalesce(dc.review, CASE WHEN layer = 'high' AND excerpt <> '' AND n_sources >= 3 AND kind IS NOT NULL THEN 'auto_passed' ELSE 'pending' END) AS review, count(*) AS n FROM pq LEFT JOIN dc ON dc.job = pq.job GROUP BY ALL"""),
    "definition_passed": (definition_passed, W + R + " SELECT job, count(*) AS n_claims, bool_and(n_sources >= CASE WHEN kind = 'bonus' THEN 1 ELSE 2 END) AS passed FROM req WHERE rank <= 10 GROUP BY job"),
    "budget_selection": (budget_selection, None),
    "group_repair": (group_repair, W + R + """, rg AS (SELECT job, skill, CASE WHEN group_id IS NOT NULL THEN group_id || ':' || kind END AS g FROM req), gs AS (SELECT job, g, least(2, count(*)) AS n FROM rg WHERE g IS NOT NULL GROUP BY job, g)
SELECT job, CAST(sum(n) AS BIGINT) AS n_formal FROM (SELECT job, count(DISTINCT skill) AS n FROM rg WHERE g IS NULL GROUP BY job UNION ALL SELECT job, n FROM gs) GROUP BY job"""),
    "group_coverage": (group_coverage, W + R + """, g AS (SELECT job, skill, kind || ':' || group_id AS group_id, min_required FROM req WHERE group_id IS NOT NULL), m AS (SELECT DISTINCT job, skill, evidence FROM ln),
h AS (SELECT m.job, group_id, evidence FROM m JOIN g ON g.job = m.job AND g.skill = m.skill GROUP BY m.job, group_id, evidence HAVING count(*) >= max(min_required)), s AS (SELECT job, count(DISTINCT evidence) AS size FROM ln GROUP BY job)
SELECT job, group_id, count(*) AS n, round(count(*) / max(size), 6) AS coverage FROM h JOIN s USING (job) GROUP BY job, group_id"""),
    "skill_merge": (skill_merge, W + R + " SELECT CASE WHEN skill % 7 = 0 THEN skill + 1 ELSE skill END AS skill, count(*) AS n, count(DISTINCT job) AS n_jobs FROM ln GROUP BY 1"),
    "evidence_upsert": (evidence_upsert, "SELECT id, o_orderkey, day, o_orderstatus FROM (SELECT o_custkey AS id, o_orderkey, CAST(o_orderdate AS DATE) AS day, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey DESC) AS nth FROM orders) WHERE nth = 1"),
    "referential_check": (referential_check, "SELECT 'orders' AS edge, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0) UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0)"),
    "staleness": (staleness, W + v.EVENTS_SQL + " SELECT kind, NOT arg_max(value > 30, (ats, id)) OR max(CASE WHEN value > 30 THEN ats END) < TIMESTAMP '2024-01-30 12:00:00' AS stale FROM ev GROUP BY kind"),
    "invented_numbers": (invented_numbers, r"""WITH f AS (SELECT conv_id, arg_min(text, turn) AS source FROM conversations GROUP BY conv_id)
SELECT role, len(list_filter(regexp_extract_all(text, '\d+(?:\.\d+)?'), lambda x: NOT list_contains(regexp_extract_all(source, '\d+(?:\.\d+)?'), x))) = 0 AS grounded, count(*) AS n FROM conversations JOIN f USING (conv_id) GROUP BY ALL"""),
}
