"""Queries on evaluation runs: three tasks against gold under a frozen configuration, and the SQL that states their results."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from ..operators import curation, evalrun, matching, taxonomy
from ..sources import views as v
from ..sources.shared import saved, shared_path
from . import texts, vocab

SETTINGS = {"align_threshold": vocab.LIKE, "model": "rules", "date": "2026-09-01"}


def configuration(spark):
    path = shared_path(spark, f"freeze-{uuid.uuid4().hex[:12]}")
    evalrun.freeze(spark, SETTINGS, path)
    return evalrun.frozen(spark, path)


def _told(df, task, item, element):
    return df.select(F.lit(task).alias("task"), F.expr(f"cast({item} as string)").alias("item"), F.expr(f"cast({element} as string)").alias("element"))


def pair_gaps(requirements, skills):
    """job, skill of what the profile of number 3 * job + 1 covers in part or not at all."""
    asked = requirements.select("job", (F.col("job") * 3 + 1).alias("resume"), "skill", "kind", "level")
    held = asked.join(skills, ["resume", "skill"], "left")
    return held.filter(F.col("held").isNull() | (matching.cover(F.col("kind"), F.col("level"), F.col("held")) < 1)).select("job", "skill")


def tasks(spark, sf_dir, config):
    """(items, predicted, gold, path) of the three tasks.

    extraction: names of some lengths out of a document and, as guesses, those of the document before it, held against all its longer names; what its own
    text doesn't mention goes. profile: what vectors align with at the frozen threshold, against their labels. match: gaps of one profile per job, against what orders before 1998 leave open.
    """
    docs = v.table(spark, sf_dir, "documents").filter("doc_id is not null").select(F.col("doc_id").alias("id"), "text")
    mentions = saved(taxonomy.mentions_of(docs, texts.vocabulary(spark, sf_dir)).select("id", "skill"), "eval-mentions")
    some = mentions.filter(F.length("skill") % 4 != 3)
    guessed = some.select((F.col("id") + 1).alias("id"), "skill").join(docs.select("id"), "id", "left_semi")
    extracted = _told(some.unionByName(guessed), "extraction", "id", "skill")
    rows, _ = vocab.labelled(spark, sf_dir)
    rows = rows.join(v.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label"), "id")
    aligned = vocab.aligned(spark, sf_dir, config.align_threshold).filter("skill is not null")
    own = v.requirements(spark, sf_dir)
    early = v.lines(spark, sf_dir).filter(F.col("observed_on") < F.lit("1998-01-01").cast("date")).groupBy(F.col("source").alias("resume"), "skill").agg(F.max(v.level(F.col("quantity"))).alias("held"))
    gaps = saved(pair_gaps(own, v.resume_skills(spark, sf_dir)), "eval-gaps")
    predicted = extracted.unionByName(_told(aligned, "profile", "id", "skill")).unionByName(_told(gaps, "match", "job", "skill"))
    predicted = evalrun.borne_out(predicted, mentions.select(F.col("id").cast("string").alias("item"), F.col("skill").alias("element")), "extraction")
    gold = _told(mentions.filter("length(skill) >= 6"), "extraction", "id", "skill").unionByName(_told(rows, "profile", "id", "label")).unionByName(_told(pair_gaps(own, early), "match", "job", "skill"))
    item = lambda df, task, c: _told(df, task, c, "null").select("task", "item")
    items = item(docs, "extraction", "id").unionByName(item(rows, "profile", "id")).unionByName(item(own.select("job").distinct(), "match", "job"))
    pages = v.table(spark, sf_dir, "pages").select(F.col("page_id").alias("skill"), curation.valid_url(F.col("url")).alias("valid"))
    return items, predicted, gold, gaps.join(pages, "skill", "left").select("valid")


def evaluation_items(spark, sf_dir):
    items, predicted, gold, _ = tasks(spark, sf_dir, configuration(spark))
    rounded = [F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")]
    return evalrun.scores(items, predicted, gold).select("task", "item", "n_pred", "n_gold", "common", *rounded)


def evaluation_summary(spark, sf_dir):
    config = configuration(spark)
    items, predicted, gold, path = tasks(spark, sf_dir, config)
    return evalrun.summary(evalrun.task_means(evalrun.scores(items, predicted, gold)), path, config)


GAPS = "SELECT req.job, req.skill FROM req LEFT JOIN {held} h ON h.resume = req.job * 3 + 1 AND h.skill = req.skill WHERE h.held IS NULL OR (kind <> 'bonus' AND h.held < level)"
SCORES = f"""{texts.VOCAB},
tx AS (SELECT doc_id, unnest(list_distinct({texts.TOK})) AS name FROM documents WHERE doc_id IS NOT NULL), mn AS (SELECT doc_id, name FROM tx JOIN vc USING (name)),
{vocab.ALIGN}, {v.REQUIREMENTS_SQL}, {v.RESUME_SQL},
early AS (SELECT source AS resume, skill, max(CASE WHEN quantity >= 34 THEN 3 WHEN quantity >= 17 THEN 2 ELSE 1 END) AS held FROM ln WHERE observed_on < DATE '1998-01-01' GROUP BY source, skill),
gaps AS ({GAPS.format(held="rs")}),
extr AS (SELECT doc_id, name FROM mn WHERE length(name) % 4 <> 3 UNION SELECT doc_id + 1, name FROM mn WHERE length(name) % 4 <> 3),
pd AS (SELECT 'extraction' AS task, CAST(doc_id AS VARCHAR) AS item, name AS element FROM extr WHERE (doc_id, name) IN (SELECT (doc_id, name) FROM mn)
  UNION SELECT 'profile', CAST(id AS VARCHAR), CAST(skill AS VARCHAR) FROM ar WHERE skill IS NOT NULL UNION SELECT 'match', CAST(job AS VARCHAR), CAST(skill AS VARCHAR) FROM gaps),
gd AS (SELECT 'extraction' AS task, CAST(doc_id AS VARCHAR) AS item, name AS element FROM mn WHERE length(name) >= 6
  UNION SELECT 'profile', CAST(vec_id AS VARCHAR), CAST(label AS VARCHAR) FROM embeddings WHERE label IS NOT NULL UNION SELECT 'match', CAST(job AS VARCHAR), CAST(skill AS VARCHAR) FROM ({GAPS.format(held="early")})),
it AS (SELECT DISTINCT 'extraction' AS task, CAST(doc_id AS VARCHAR) AS item FROM documents WHERE doc_id IS NOT NULL UNION SELECT 'profile', CAST(vec_id AS VARCHAR) FROM embeddings WHERE label IS NOT NULL UNION SELECT 'match', CAST(job AS VARCHAR) FROM req),
sc AS (SELECT it.task, it.item, coalesce(p.n, 0) AS n_pred, coalesce(g.n, 0) AS n_gold, coalesce(b.n, 0) AS common FROM it
  LEFT JOIN (SELECT task, item, count(*) AS n FROM pd GROUP BY ALL) p ON p.task = it.task AND p.item = it.item LEFT JOIN (SELECT task, item, count(*) AS n FROM gd GROUP BY ALL) g ON g.task = it.task AND g.item = it.item
  LEFT JOIN (SELECT task, item, count(*) AS n FROM pd JOIN gd USING (task, item, element) GROUP BY ALL) b ON b.task = it.task AND b.item = it.item),
fs AS (SELECT *, CASE WHEN n_pred + n_gold = 0 THEN 1 WHEN n_pred = 0 THEN 0 ELSE common / n_pred END AS precision, CASE WHEN n_pred + n_gold = 0 THEN 1 WHEN n_gold = 0 THEN 0 ELSE common / n_gold END AS recall,
  CASE WHEN n_pred + n_gold = 0 THEN 1 ELSE 2 * common / (n_pred + n_gold) END AS f1 FROM sc)"""
_HASH = f"sha256('{json.dumps(SETTINGS, sort_keys=True)}' || chr(10)) AS hash"
SUMMARY = f"""
, mean AS (SELECT task, avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1, count(*) AS n FROM fs GROUP BY task),
rows AS (SELECT place, w.task AS name, precision, recall, f1, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'missing' WHEN f1 >= 0.9 THEN 'passed' ELSE 'low' END AS state FROM (VALUES (1, 'extraction'), (2, 'profile'), (3, 'match')) w(place, task) LEFT JOIN mean ON mean.task = w.task
  UNION ALL SELECT 4, 'path', NULL, NULL, f1, n, CASE WHEN n = 0 THEN 'missing' WHEN f1 = 1 THEN 'whole' ELSE 'partial' END FROM (SELECT count(*) AS n, avg(CASE WHEN regexp_matches(url, '^https?://[^/\\s?#]+') THEN 1 ELSE 0 END) AS f1 FROM gaps LEFT JOIN pages ON page_id = skill))
SELECT place, name, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, n, state, name || ' ' || CASE WHEN state = 'missing' THEN 'no figures' ELSE printf('%.3f', f1) || ' of ' || n END || ' ' || state AS line, {_HASH} FROM rows"""

QUERIES = {
    "evaluation_items": (evaluation_items, "WITH " + SCORES + " SELECT task, item, n_pred, n_gold, common, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM fs"),
    "evaluation_summary": (evaluation_summary, "WITH " + SCORES + SUMMARY),
}
