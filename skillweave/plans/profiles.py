"""Queries on profile texts, intake, curation and reports, with the SQL that states their results."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import curation as c
from ..operators import dedup, history, matching
from ..operators import profiles as p
from ..sources import views as v
from ..sources.shared import spread
from . import facts, texts
from .matching import COMPARE_SQL, freshness

W, R, H = "WITH ", v.REQUIREMENTS_SQL, v.HISTORY_SQL
RESULT, USE = "tion|ung", "ment|heit|thing"


def vocabulary(spark, sf_dir):
    """Words of five letters or more, and pairs of neighbouring ones, that two benchmark texts hold."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{5,})"), F.lit(1))
    pairs = F.regexp_extract_all(F.lower("text"), F.lit(r"(?=\b([a-z]{5,} [a-z]{5,})\b)[a-z]+"), F.lit(1))
    rows = v.table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(F.concat(words, F.filter(pairs, lambda x: x != "")))).alias("name"))
    return rows.groupBy("name").agg(F.count("*").alias("n")).filter("n >= 2").select(F.col("name").alias("skill"), "name", F.array().cast("array<string>").alias("synonyms"), (-F.col("n")).alias("ord"))


def named(spark, sf_dir):
    docs = v.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return p.named_sentences(docs, vocabulary(spark, sf_dir))


def name_mentions(spark, sf_dir):
    return named(spark, sf_dir).groupBy("skill").agg(F.count_distinct("id").alias("n_docs"), F.count("*").alias("n_sentences"))


def best_sentence(spark, sf_dir):
    rows = p.fragments(named(spark, sf_dir), RESULT, USE)
    return rows.select("id", "skill", "level", "section", F.md5("text").alias("text_md5"), "fragment")


def profile_fields(spark, sf_dir):
    """Fields of the texts; the given words stand for degrees and years too, so that some are found."""
    docs = v.table(spark, sf_dir, "documents")
    years = F.concat("text", F.lit(" "), F.col("doc_id") % 9, F.when(F.col("doc_id") % 3 == 0, " years").otherwise(" 年经验 Master"))
    return docs.select("doc_id", p.fields(years).alias("f")).select("doc_id", F.col("f.experience").alias("experience"), F.col("f.education").alias("education"))


def profile_skills(spark, sf_dir):
    """Skills by their single-word names first, then by pairs of words; grounded in a sentence; marked where 'able' or another mark of level stands before."""
    rows = named(spark, sf_dir)
    part = lambda x: rows.filter(x).select("id", "skill", "name", F.col("pos").alias("ord")).distinct()
    one, two = part("not contains(name, ' ')"), part("contains(name, ' ')").withColumn("skill", F.substring_index("skill", " ", 1))
    merged = p.merged_skills(one, two)
    marked = rows.groupBy("id", "skill").agg(F.max(p.marks_level(F.col("sentence"), F.col("name")).cast("int")).alias("marked"))
    return p.grounded(merged, p.fragments(rows, RESULT, USE)).join(marked, ["id", "skill"]).groupBy("skill", "turn").agg(F.count("*").alias("n_profiles"), F.sum("marked").alias("n_marked"))


def intake_decisions(spark, sf_dir):
    """Pages as postings: the title from the markup; a known domain if the address names one; equal bodies are one posting."""
    pages = v.table(spark, sf_dir, "pages")
    title = F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<title>(.*?)</title>", 1)
    body = t.strip_html(F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>", " "))
    rows = pages.select(F.col("page_id").alias("id"), F.col("page_id").alias("ord"), c.keep_title(title, F.col("url").rlike("^https?://"), "[A-Za-z]", 2).alias("title_ok"), body.alias("body"), F.sha2(body, 256).alias("fingerprint"))
    return c.intake(rows).groupBy("decision").agg(F.count("*").alias("n"))


def snapshot_listing(spark, sf_dir):
    """Fifty postings a source, each with the bodies that its documents show."""
    docs = v.postings(spark, sf_dir)
    rows = docs.select("id", F.col("company").alias("source"), (F.col("id") % 50).alias("posting"), "observed_on").join(dedup.simhash(docs, "id", "body"), "id")
    return c.snapshots(rows).groupBy("source").agg(F.count("*").alias("n_snapshots"), F.sum("n").alias("n_rows"), F.min("first").alias("first"), F.max("last").alias("last"))


def source_counts(spark, sf_dir):
    return v.lines(spark, sf_dir).groupBy("source").agg(F.count_distinct("evidence").alias("n_evidence"), F.count_distinct("job").alias("n_jobs"))


def watch_ranking(spark, sf_dir):
    """Jobs by the number of events under watch."""
    n = v.events(spark, sf_dir).filter("kind = 'view'").groupBy("job").agg(F.count("*").alias("n"), F.max("at").alias("latest"))
    return n.groupBy("n").agg(F.count("*").alias("n_jobs"), F.max("latest").alias("latest"))


def history_assembly(spark, sf_dir):
    """Versions with the skill's category and the group that the ranked table gives it."""
    part = v.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("skill"), F.col("p_type").alias("category"))
    groups = v.requirements(spark, sf_dir).select("job", "skill", "group_id", "kind")
    return v.history(spark, sf_dir).filter("not retracted").join(part, "skill", "left").join(groups, ["job", "skill"], "left").select("job", "skill", "valid_from", "valid_to", "category", "group_id", "kind")


def job_bodies(spark, sf_dir):
    """Evidence per job that is not retracted (line 7 retracts its order)."""
    rows = v.lines(spark, sf_dir)
    each = rows.join(v.retracted(spark, sf_dir), "evidence", "left_anti").groupBy("job", "evidence").agg(F.max("observed_on").alias("latest"))
    return each.groupBy("job").agg(F.count("evidence").alias("n_bodies"), F.max("latest").alias("latest"))


def manual_expiry(spark, sf_dir):
    """Orders to expire: every third skill of every tenth job, at the start of 1996."""
    rows = v.history(spark, sf_dir)
    orders = rows.filter("job % 10 = 0 and skill % 3 = 0").select("job", "skill").distinct().withColumn("at", F.lit("1996-01-01").cast("date"))
    return c.expire(rows, orders).groupBy("job").agg(F.count("*").alias("n"), F.sum(F.col("closed").cast("int")).alias("n_closed"), F.sum(F.col("valid_to").isNull().cast("int")).alias("n_open"))


def cluster_merge(spark, sf_dir):
    """Parts by type as unmatched rows; labels by the type's length: an alias of its first word, noise, or new."""
    part = v.table(spark, sf_dir, "part")
    rows = part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("title"))
    size = F.length("title") % 3
    labels = rows.select("title").distinct().select("title", F.when(size == 0, "alias").when(size == 1, "noise").otherwise("new").alias("label"), F.when(size == 0, F.substring_index("title", " ", 1)).alias("target"))
    return c.merge_clusters(rows, labels).groupBy("job").agg(F.count("*").alias("n"), F.count_distinct("title").alias("n_titles"))


def bulk_approval(spark, sf_dir):
    pending = v.events(spark, sf_dir).filter("review = 'pending'").select("job", "id")
    votes = facts.vote_summary(spark, sf_dir).groupBy("job").agg((F.sum(F.col("kind").isNull().cast("int")) * 10 > F.count("*") * 9).alias("open")).filter("open").select("job")
    failed = facts.gate_errors(spark, sf_dir).filter("code = 'required_over_cap'").select("job")
    return c.bulk_approval(pending, votes, failed)


def decision_log(spark, sf_dir):
    """Events on one job and kind as a log of decisions: the last is in force."""
    log = v.events(spark, sf_dir).select(F.concat_ws("-", "job", "kind").alias("event"), F.col("id").alias("seq"), "review")
    return c.last_decisions(log).groupBy("review").agg(F.count("*").alias("n_events"), F.sum("n_decisions").alias("n_decisions"))


def correction_diff(spark, sf_dir):
    """Each profile claims its skills, and the next one, at the second level."""
    own = v.resume_skills(spark, sf_dir).select(F.col("resume").alias("id"), "skill", (F.col("held") - 1).alias("level"))
    edits = own.select("id", F.explode(F.array(F.col("skill"), F.col("skill") + 1)).alias("skill")).distinct().withColumn("level", F.lit(1))
    return p.corrections(edits, own).groupBy("verdict").agg(F.count("*").alias("n"))


def gold_apply(spark, sf_dir):
    """Decisions from the rule's own predictions: what only gold has goes for long texts, what only the rule has is added for short ones."""
    pred, gold, _ = texts.gold_sets(spark, sf_dir)
    long = v.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), (F.col("n_chars") > 1000).alias("long"))
    gone = gold.join(pred, ["item", "element"], "left_anti").join(long, "item").filter("long").select("item", "element", F.lit("delete").alias("action"))
    new = pred.join(gold, ["item", "element"], "left_anti").join(long, "item").filter("not long").select("item", "element", F.lit("add").alias("action"))
    return c.apply_gold(gold, gone.unionByName(new)).groupBy("element").agg(F.count("*").alias("n"))


def adjudication_queue(spark, sf_dir):
    """Per language the next document without a label."""
    docs = v.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), F.col("doc_id").alias("ord"), "lang")
    return c.adjudication_queue(docs, v.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item")), "lang")


def dossier(spark, sf_dir):
    """One row per job: status, sources, requirements, categories, evidence, change, and what they say."""
    status = facts.job_status(spark, sf_dir)
    part = v.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("skill"), "p_type")
    need = v.requirements(spark, sf_dir).join(part, "skill").groupBy("job").agg(F.sum((F.col("kind") == "required").cast("int")).alias("n_required"), F.count("*").alias("n_formal"), F.count_distinct("p_type").alias("n_categories"))
    delta = facts.period_delta(spark, sf_dir).groupBy("job").agg(F.sum((F.col("change") == "added").cast("int")).alias("added"), F.sum((F.col("change") == "expired").cast("int")).alias("expired"))
    zero = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    alias = F.when(F.col("job") % 11 == 0, F.col("job") - 1)
    out = status.join(need, "job", "left").join(delta, "job", "left").join(job_bodies(spark, sf_dir), "job", "left")
    return out.select("job", "status", "n_total", zero("n_required"), zero("n_formal"), zero("n_categories"), zero("n_bodies"), zero("added"), zero("expired"), c.verdict(alias, F.col("status"), F.col("n_total")).alias("verdict"))


def stories(spark, sf_dir):
    """Jobs per status by change; multiples of 13 are the named ones."""
    rows = dossier(spark, sf_dir).select("status", "job", (F.col("job") % 13 == 0).cast("int").alias("named"), (F.col("added") + F.col("expired")).alias("n_changes"))
    return c.ranked_stories(rows, 3)


def current_definitions(spark, sf_dir):
    """Definitions: a job's orders; the pointer of every third job names its oldest one."""
    rows = v.lines(spark, sf_dir).groupBy("job", F.col("evidence").alias("version")).agg(F.max("observed_on").alias("created_at"))
    pointer = rows.filter("job % 3 = 0").groupBy("job").agg(F.min(F.struct("created_at", "version"))["version"].alias("version"))
    return c.current_definitions(rows, pointer)


def path_urls(spark, sf_dir):
    """Open requirements with the page of the skill's number: the share that has a valid address, by job."""
    pages = v.table(spark, sf_dir, "pages").select(F.col("page_id").alias("skill"), c.valid_url(F.col("url")).alias("valid"))
    return v.requirements(spark, sf_dir).join(pages, "skill", "left").groupBy("job").agg(F.count("*").alias("n"), F.sum(F.coalesce("valid", F.lit(False)).cast("int")).alias("n_valid"))


def rank_six(spark, sf_dir):
    """The flagship's pairs by all six levels: skills of the second level or more are evidence in the field, bonus ones transfer."""
    own, skills = v.requirements(spark, sf_dir), v.resume_skills(spark, sf_dir)
    held = own.join(skills, "skill").groupBy("job", "resume").agg(F.sum(((F.col("kind") == "required") & (F.col("held") >= 2)).cast("int")).alias("specific"), F.sum((F.col("kind") == "bonus").cast("int")).alias("transferable"))
    pairs = matching.compare(own, skills).join(held, ["job", "resume"]).join(freshness(spark, sf_dir), "job")
    pairs = pairs.withColumn("req_share", F.when(F.col("full_req") > 0, F.round(F.col("cov_req") / F.col("full_req"), 6)).otherwise(0.0))
    return c.rank_jobs(pairs).select("resume", "place", "job", "band", "req_share", "specific", "transferable")


def report_rewrites(spark, sf_dir):
    """Sentences to rewrite of each text, for the job of its number: a skill is required if its name has an even length."""
    found = p.fragments(named(spark, sf_dir), RESULT, USE)
    level = F.array_position(F.array(*map(F.lit, p.LEVELS)), F.col("level")).cast("int") - 1
    rows = found.select(F.col("id").alias("resume"), (F.col("id") % 10).alias("job"), "skill", "text", level.alias("level"), (F.length("skill") % 2 == 0).alias("required"))
    return p.rewrites(rows).select("resume", "place", "skill", "level", F.md5("text").alias("text_md5"))


def report_lists(spark, sf_dir):
    """Per pair with a shared skill: of the three first strengths and risks by rank, their number and smallest and largest rank."""
    own, skills = v.requirements(spark, sf_dir), v.resume_skills(spark, sf_dir)
    got = own.join(skills, "skill").select("job", "resume", "rank", (F.col("held") >= F.col("level")).alias("ok")).filter("ok is not null")
    w = Window.partitionBy("job", "resume", "ok").orderBy("rank")
    few = spread(got, v.tasks(spark, sf_dir), "job", "resume").withColumn("nth", F.row_number().over(w)).filter("nth <= 3")
    n = lambda x: F.count(F.when(x, 1))
    return few.groupBy("job", "resume").agg(n(F.col("ok")).alias("n_strengths"), F.min(F.when(F.col("ok"), F.col("rank"))).alias("best_strength"), n(~F.col("ok")).alias("n_risks"), F.max(F.when(~F.col("ok"), F.col("rank"))).alias("last_risk"))


NAMED = r"""bw AS (SELECT item_id, lower(text) AS x FROM benchmark),
ws AS (SELECT item_id, list_filter(string_split(regexp_replace(x, '[^a-z]', ' ', 'g'), ' '), lambda z: length(z) >= 5) AS w,
              list_transform(string_split(x, ' '), lambda z: z) AS q FROM bw),
bg AS (SELECT item_id, unnest(list_transform(range(1, len(q)), lambda i: regexp_extract(q[i], '(^|[^a-z0-9_])([a-z]{5,})$', 2) || ' ' || regexp_extract(q[i + 1], '^([a-z]{5,})($|[^a-z0-9_])', 1))) AS name FROM ws WHERE len(q) > 1),
nm AS (SELECT name FROM (SELECT DISTINCT item_id, unnest(w) AS name FROM ws UNION SELECT DISTINCT item_id, name FROM bg WHERE regexp_full_match(name, '[a-z]{5,} [a-z]{5,}')) GROUP BY name HAVING count(*) >= 2),
st AS (SELECT doc_id AS id, place, trim(replace(s, chr(1), '.'), chr(32)) AS sentence FROM (
  SELECT doc_id, unnest(l) AS s, unnest(range(len(l))) AS place FROM (SELECT doc_id, regexp_split_to_array(regexp_replace(regexp_replace(text, '(\d)\.', '\1' || chr(1), 'g'), '\.(\d)', chr(1) || '\1', 'g'), '[\n。！!]+|\.') AS l FROM documents)) WHERE trim(replace(s, chr(1), '.'), chr(32)) <> ''),
sx AS (SELECT *, '#' || regexp_replace(lower(sentence), '[^a-z0-9_ ]', '#', 'g') || '#' AS x FROM st),
nd AS (SELECT id, place, sentence, name AS skill FROM sx JOIN nm ON contains(x, name) AND (contains(x, '#' || name || '#') OR contains(x, ' ' || name || ' ') OR contains(x, '#' || name || ' ') OR contains(x, ' ' || name || '#'))),
lv AS (SELECT *, CASE WHEN regexp_matches(sentence, '\d') AND regexp_matches(sentence, '(?i)tion|ung') THEN 2 WHEN regexp_matches(sentence, '(?i)ment|heit|thing') THEN 1 ELSE 0 END AS lev FROM nd),
fr AS (SELECT id, skill, sentence AS text, lev FROM (SELECT *, row_number() OVER (PARTITION BY id, skill ORDER BY lev DESC, length(sentence) DESC, place) AS nth FROM lv) WHERE nth = 1)"""
STATUS = facts.QUERIES["job_status"][1].removeprefix(W + R).replace("SELECT *, CASE", "js AS (SELECT *, CASE").strip().removeprefix(",").replace("AS span_days FROM ln JOIN lt USING (job) GROUP BY job)\njs", "AS span_days FROM ln JOIN lt USING (job) GROUP BY job),\njs") + ")"
DOSSIER = W + R + "," + H + "," + STATUS + "," + facts.DELTA + """,
nq AS (SELECT job, sum(CASE WHEN kind = 'required' THEN 1 ELSE 0 END) AS n_required, count(*) AS n_formal, count(DISTINCT p_type) AS n_categories FROM req JOIN part ON p_partkey = skill GROUP BY job),
dd AS (SELECT job, sum(CASE WHEN change = 'added' THEN 1 ELSE 0 END) AS added, sum(CASE WHEN change = 'expired' THEN 1 ELSE 0 END) AS expired FROM dl WHERE change IS NOT NULL GROUP BY job),
jb AS (SELECT job, count(DISTINCT evidence) AS n_bodies FROM ln WHERE evidence NOT IN (SELECT evidence FROM ln WHERE line = 7) GROUP BY job),
ds AS (SELECT js.job, status, n_total, coalesce(n_required, 0) AS n_required, coalesce(n_formal, 0) AS n_formal, coalesce(n_categories, 0) AS n_categories, coalesce(n_bodies, 0) AS n_bodies, coalesce(added, 0) AS added, coalesce(expired, 0) AS expired,
  CASE WHEN js.job % 11 = 0 THEN 'merged' WHEN status = 'formed' THEN 'compare' WHEN status = 'emerging' THEN 'watch' WHEN n_total <= 1 THEN 'too_few' ELSE 'in_review' END AS verdict
  FROM js LEFT JOIN nq USING (job) LEFT JOIN dd USING (job) LEFT JOIN jb USING (job))"""
E_ = v.EVENTS_SQL

QUERIES = {
    "name_mentions": (name_mentions, W + NAMED + " SELECT skill, count(DISTINCT id) AS n_docs, count(*) AS n_sentences FROM nd GROUP BY skill"),
    "best_sentence": (best_sentence, W + NAMED + " SELECT id, skill, ['mention', 'use', 'result'][lev + 1] AS level, CASE WHEN regexp_matches(text, '(?i)project') THEN 'project' ELSE 'experience' END AS section, md5(text) AS text_md5, 'resume-evidence-' || substr(sha256(skill || ':' || text), 1, 16) AS fragment FROM fr"),
    "profile_fields": (profile_fields, r"""WITH d AS (SELECT doc_id, text || ' ' || (doc_id % 9) || CASE WHEN doc_id % 3 = 0 THEN ' years' ELSE ' 年经验 Master' END AS x FROM documents)
SELECT doc_id, coalesce(nullif(regexp_extract(x, '(?i)(?:^|[^\p{L}\p{N}_])(\d+)[\s\p{Z}]*(?:年|years?)', 1), '') || '年', '') AS experience, regexp_extract(x, '(?i)(?:^|[^\p{L}\p{N}_])(Bachelor|Master|PhD)(?:$|[^\p{L}\p{N}_])|((?:博士|硕士|本科|大专)(?:学历|学位)?)', 1) || regexp_extract(x, '(?i)(?:^|[^\p{L}\p{N}_])(Bachelor|Master|PhD)(?:$|[^\p{L}\p{N}_])|((?:博士|硕士|本科|大专)(?:学历|学位)?)', 2) AS education FROM d"""),
    "profile_skills": (profile_skills, W + NAMED + r""", mk AS (SELECT id, skill, max(CASE WHEN regexp_matches(sentence, '(?i)(了解|熟练|精通|aware|able|expert|proficient)[\s\p{Z}]*(掌握|使用|过)?[^\p{L}\p{N}_]{0,12}' || skill) THEN 1 ELSE 0 END) AS marked FROM nd GROUP BY id, skill),
al AS (SELECT id, skill AS s, 0 AS turn FROM nd WHERE NOT contains(skill, ' ') UNION ALL SELECT id, split_part(skill, ' ', 1), 1 FROM nd WHERE contains(skill, ' ')),
mg AS (SELECT id, s AS skill, min(turn) AS turn FROM al GROUP BY id, s) SELECT mg.skill, turn, count(*) AS n_profiles, sum(marked) AS n_marked FROM mg JOIN mk ON mg.id = mk.id AND mg.skill = mk.skill GROUP BY mg.skill, turn"""),
    "intake_decisions": (intake_decisions, r"""WITH g AS (SELECT page_id AS id, url, regexp_extract(coalesce(html, ''), '(?is)<title>(.*?)</title>', 1) AS title,
  trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS body FROM pages),
k AS (SELECT *, title <> '' AND NOT regexp_matches(title, '(?i)实习|intern') AND length(regexp_replace(title, '[^A-Za-z]', '', 'g')) >= 2 AND coalesce(regexp_matches(url, '^https?://'), false) AS ok FROM g),
f AS (SELECT body, min(id) AS first FROM k WHERE ok AND body <> '' GROUP BY body)
SELECT CASE WHEN k.body = '' THEN 'empty' WHEN NOT ok THEN 'title' WHEN id <> first THEN 'repeat' ELSE 'ingested' END AS decision, count(*) AS n FROM k LEFT JOIN f USING (body) GROUP BY 1"""),
    "snapshot_listing": (snapshot_listing, W + texts.SIM + """, pp AS (SELECT source, documents.doc_id % 50 AS posting, h, DATE '2023-01-01' + CAST(documents.doc_id * 37 % 500 AS INTEGER) AS day FROM documents JOIN al USING (doc_id))
SELECT source, count(DISTINCT (posting, h)) AS n_snapshots, count(*) AS n_rows, min(day) AS first, max(day) AS last FROM pp GROUP BY source"""),
    "source_counts": (source_counts, W + R + " SELECT source, count(DISTINCT evidence) AS n_evidence, count(DISTINCT job) AS n_jobs FROM ln GROUP BY source"),
    "watch_ranking": (watch_ranking, W + E_ + ", w AS (SELECT job, count(*) AS n, max(ats) AS latest FROM ev WHERE kind = 'view' GROUP BY job) SELECT n, count(*) AS n_jobs, max(latest) AS latest FROM w GROUP BY n"),
    "history_assembly": (history_assembly, W + R + "," + H + " SELECT h.job, h.skill, valid_from, valid_to, p_type AS category, group_id, kind FROM hist h LEFT JOIN part ON p_partkey = h.skill LEFT JOIN req ON req.job = h.job AND req.skill = h.skill WHERE NOT retracted"),
    "job_bodies": (job_bodies, W + R + " SELECT job, count(DISTINCT evidence) AS n_bodies, max(observed_on) AS latest FROM ln WHERE evidence NOT IN (SELECT evidence FROM ln WHERE line = 7) GROUP BY job"),
    "manual_expiry": (manual_expiry, W + H + """, x AS (SELECT *, job % 10 = 0 AND skill % 3 = 0 AND valid_to IS NULL AND valid_from <= DATE '1996-01-01' AS closed FROM hist)
SELECT job, count(*) AS n, sum(CASE WHEN closed THEN 1 ELSE 0 END) AS n_closed, sum(CASE WHEN valid_to IS NULL AND NOT closed THEN 1 ELSE 0 END) AS n_open FROM x GROUP BY job"""),
    "cluster_merge": (cluster_merge, """WITH s AS (SELECT p_type, count(*) AS n, CASE length(p_type) % 3 WHEN 0 THEN split_part(p_type, ' ', 1) WHEN 2 THEN p_type END AS job FROM part GROUP BY p_type)
SELECT job, sum(n) AS n, count(*) AS n_titles FROM s WHERE n >= 3 AND job IS NOT NULL GROUP BY job"""),
    "bulk_approval": (bulk_approval, W + facts.GATE + "," + E_ + "," + facts.VOTES.format(src="ln") + """, un AS (SELECT job FROM vk GROUP BY job HAVING sum(CASE WHEN kind IS NULL THEN 1 ELSE 0 END) * 10 > count(*) * 9),
pe AS (SELECT job, count(*) AS n_pending, sha256(string_agg(CAST(id AS VARCHAR), ',' ORDER BY CAST(id AS VARCHAR))) AS batch FROM ev WHERE review = 'pending' GROUP BY job)
SELECT job, n_pending, batch, CASE WHEN job IN (SELECT job FROM un) THEN 'unresolved vote' WHEN job IN (SELECT job FROM ge WHERE code = 'required_over_cap') THEN 'gate failed' ELSE 'approved' END AS outcome FROM pe"""),
    "decision_log": (decision_log, W + E_ + ", l AS (SELECT job, kind, arg_max(review, id) AS review, count(*) AS n FROM ev GROUP BY job, kind) SELECT review, count(*) AS n_events, sum(n) AS n_decisions FROM l GROUP BY review"),
    "correction_diff": (correction_diff, W + R + "," + v.RESUME_SQL + """, e AS (SELECT resume, skill FROM rs UNION SELECT resume, skill + 1 FROM rs)
SELECT CASE WHEN held IS NULL THEN 'not in the text' WHEN held < 2 THEN 'above what is shown' ELSE 'accepted' END AS verdict, count(*) AS n FROM e LEFT JOIN rs USING (resume, skill) GROUP BY 1"""),
    "gold_apply": (gold_apply, W + texts.GOLD + """, l AS (SELECT doc_id AS item, n_chars > 1000 AS long FROM documents),
g2 AS (SELECT gs.item, gs.element FROM gs JOIN l USING (item) WHERE NOT long OR (gs.item, gs.element) IN (SELECT item, element FROM ps)
  UNION SELECT gs.item, gs.element FROM gs WHERE gs.item NOT IN (SELECT item FROM l) UNION SELECT ps.item, ps.element FROM ps JOIN l USING (item) WHERE NOT long)
SELECT element, count(*) AS n FROM g2 GROUP BY element"""),
    "adjudication_queue": (adjudication_queue, """SELECT lang, min(CASE WHEN NOT d THEN doc_id END) AS next_item, sum(CASE WHEN d THEN 1 ELSE 0 END) AS n_done, count(*) AS n_items
FROM (SELECT doc_id, lang, doc_id IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) AS d FROM documents) GROUP BY lang"""),
    "dossier": (dossier, DOSSIER + " SELECT * FROM ds"),
    "stories": (stories, DOSSIER + """, so AS (SELECT status, job, CASE WHEN job % 13 = 0 THEN 1 ELSE 0 END AS named, added + expired AS n_changes FROM ds)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY status ORDER BY named DESC, n_changes DESC, job) AS place FROM so) WHERE place <= 3"""),
    "current_definitions": (current_definitions, W + R + """, d AS (SELECT job, evidence AS version, max(observed_on) AS created_at FROM ln GROUP BY job, evidence)
SELECT job, CASE WHEN job % 3 = 0 THEN arg_min(version, (created_at, version)) ELSE arg_max(version, (created_at, version)) END AS version, job % 3 = 0 AS by_pointer FROM d GROUP BY job"""),
    "path_urls": (path_urls, W + R + r" SELECT job, count(*) AS n, sum(CASE WHEN regexp_matches(url, '^https?://[^/\s?#]+') THEN 1 ELSE 0 END) AS n_valid FROM req LEFT JOIN pages ON page_id = skill GROUP BY job"),
    "rank_six": (rank_six, COMPARE_SQL + """, hd AS (SELECT job, resume, sum(CASE WHEN kind = 'required' AND held >= 2 THEN 1 ELSE 0 END) AS specific, sum(CASE WHEN kind = 'bonus' THEN 1 ELSE 0 END) AS transferable FROM req JOIN rs USING (skill) GROUP BY job, resume),
fs AS (SELECT job, max(observed_on) AS latest, count(DISTINCT source) AS n_sources FROM ln GROUP BY job),
al AS (SELECT resume, job, band, CASE WHEN full_req > 0 THEN round(cov_req / full_req, 6) ELSE 0 END AS req_share, specific, transferable, latest, n_sources FROM bd JOIN hd USING (job, resume) JOIN fs USING (job))
SELECT resume, place, job, band, req_share, specific, transferable FROM (SELECT *, row_number() OVER (PARTITION BY resume ORDER BY CASE band WHEN 'high' THEN 3 WHEN 'basic' THEN 2 WHEN 'gap' THEN 1 ELSE 0 END DESC, req_share DESC, specific DESC, transferable DESC, latest DESC, n_sources DESC, job) AS place FROM al) WHERE place <= 3"""),
    "report_rewrites": (report_rewrites, W + NAMED + """, o AS (SELECT id, text, min((length(skill) % 2, lev, skill)) AS m FROM fr GROUP BY id, text)
SELECT id AS resume, place, m[3] AS skill, m[2] AS level, md5(text) AS text_md5 FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY m, text) AS place FROM o) WHERE place <= 5"""),
    "report_lists": (report_lists, W + R + "," + v.RESUME_SQL + """, g AS (SELECT job, resume, rank, held >= level AS ok, row_number() OVER (PARTITION BY job, resume, held >= level ORDER BY rank) AS nth FROM req JOIN rs USING (skill))
SELECT job, resume, count(*) FILTER (ok) AS n_strengths, min(rank) FILTER (ok) AS best_strength, count(*) FILTER (NOT ok) AS n_risks, max(rank) FILTER (NOT ok) AS last_risk FROM g WHERE nth <= 3 GROUP BY job, resume"""),
}
