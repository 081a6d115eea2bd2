"""Queries on vocabularies: phrases in whole texts, alignment of rows, leader clusters, conflicts of stated dates; and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import phrases, timeline, vectors
from ..sources import views as v
from . import texts

LIKE = 0.3  # the given vectors are spread widely: few pairs are nearer


def phrase_names(spark, sf_dir):
    """Words of five letters or more in two benchmark texts; pairs of words around the end of a sentence, which hold a full stop and a blank, as
    skills; their upper-case forms as synonyms."""
    items = v.table(spark, sf_dir, "benchmark").select("text")
    words = texts.vocabulary(spark, sf_dir).select("name")
    stops = items.select(F.explode(F.regexp_extract_all("text", F.lit(r"([a-z]+\. [A-Z][a-z]+)"), F.lit(1))).alias("name"))
    rows = words.unionByName(stops).distinct()
    return rows.select(F.lower("name").alias("skill"), "name", F.array(F.upper("name")).alias("synonyms"))


def vocab_phrases(spark, sf_dir):
    """Names with full stops and blanks among them, found in whole documents across the ends of sentences."""
    docs = v.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    rows = phrases.mentions(docs, phrase_names(spark, sf_dir))
    return rows.groupBy("skill").agg(F.count("*").alias("n_docs"), F.min("id").alias("first_doc"), F.max("id").alias("last_doc"))


def target_containment(spark, sf_dir):
    """The longest vocabulary word that a document contains, also inside other words; the first by name of equals."""
    titles = v.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("title"))
    return phrases.longest_contained(titles, texts.vocabulary(spark, sf_dir).select("name", F.col("name").alias("ord")))


def labelled(spark, sf_dir):
    """The first vector of every label as a vocabulary, and all vectors as rows: a fourth with the label's name in full-width letters, some of
    them with a synonym, a seventh as alias candidates, the rest with names that the vocabulary lacks."""
    rows = v.table(spark, sf_dir, "embeddings").filter("label is not null")
    vocab = rows.groupBy("label").agg(F.min("vec_id").alias("ord"), F.min_by("embedding", "vec_id").alias("skill_vector"))
    vocab = vocab.select(F.col("label").alias("skill"), F.concat(F.lit("label "), "label").alias("name"), F.array(F.concat(F.lit("L/"), "label")).alias("synonyms"), "ord", "skill_vector")
    k = F.col("vec_id") % 4
    name = F.when(k == 0, F.concat(F.lit("ＬＡＢＥＬ　 "), "label")).when(k == 1, F.concat(F.lit(" l／"), "label")).otherwise(F.concat(F.lit("like "), "label"))
    return rows.select(F.col("vec_id").alias("id"), name.alias("name"), F.col("embedding").alias("vector"), (F.col("vec_id") % 7 == 0).alias("candidate")), vocab


def aligned(spark, sf_dir, threshold=LIKE):
    rows, vocab = labelled(spark, sf_dir)
    return vectors.align_rows(rows, vocab, threshold, [("like 1", "label 2"), ("label 4", "like 3")])


def align_rows(spark, sf_dir):
    return aligned(spark, sf_dir).select("id", "skill", "how", F.round("sim", 4).alias("sim"))


def leader_clusters(spark, sf_dir):
    rows = v.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("ord"), F.col("embedding").alias("vector"))
    return vectors.leader_clusters(rows, LIKE)


def unmatched_clusters(spark, sf_dir):
    """Clusters of three rows or more among the rows that align with nothing."""
    rows, _ = labelled(spark, sf_dir)
    rest = aligned(spark, sf_dir).filter("skill is null").select("id")
    return vectors.clusters_of(rows.join(rest, "id").select("id", F.col("id").alias("ord"), "vector"), 3, LIKE)


def stated_conflicts(spark, sf_dir):
    """Orders of a customer as a text of month ranges, of which some end before they start: ranges in conflict, and overlapping pairs."""
    months = F.col("o_orderkey") % 7 - 1
    span = F.concat_ws(" - ", *[F.date_format(F.add_months(F.add_months("o_orderdate", F.lit(120)), m), "yyyy.MM") for m in (F.lit(0), months.cast("int"))])
    own = v.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.concat_ws("; ", F.array_sort(F.collect_list(span))).alias("text"))
    rows = timeline.conflicts(timeline.stated(own.select(F.col("o_custkey").alias("id"), "text")))
    turned = F.col("reason") == "reversed"
    return rows.groupBy("id").agg(F.sum(turned.cast("long")).alias("n_reversed"), F.sum((~turned).cast("long")).alias("n_overlapping"), F.sum("n").alias("n_pairs"))


LEADERS = """pairs AS (SELECT a.id AS a, b.id AS b FROM {rows} a JOIN {rows} b ON a.id < b.id WHERE list_cosine_similarity(a.e, b.e) >= 0.3),
nb AS (SELECT r.id, row_number() OVER (ORDER BY r.id) AS nth, coalesce(p.before, CAST([] AS BIGINT[])) AS before FROM {rows} r LEFT JOIN (SELECT b, list(a) AS before FROM pairs GROUP BY b) p ON p.b = r.id),
st AS (SELECT CAST(0 AS BIGINT) AS nth, CAST([] AS BIGINT[]) AS leaders UNION ALL SELECT nb.nth, CASE WHEN list_has_any(before, leaders) THEN leaders ELSE list_append(leaders, nb.id) END FROM st JOIN nb ON nb.nth = st.nth + 1),
ld AS (SELECT unnest(leaders) AS leader FROM (SELECT leaders FROM st ORDER BY nth DESC LIMIT 1)),
lc AS (SELECT nb.id, coalesce(min(CASE WHEN nb.id = ld.leader THEN ld.leader WHEN list_contains(nb.before, ld.leader) THEN ld.leader END), -1) AS leader FROM nb, ld GROUP BY nb.id)"""
ALIGN = """vb AS (SELECT label, min(vec_id) AS ord, CAST(arg_min(embedding, vec_id) AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL GROUP BY label),
pr AS (SELECT vec_id, vb.label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), e) AS sim, ord FROM embeddings x, vb WHERE vec_id % 7 <> 0 AND vec_id % 4 > 1 AND NOT (x.label = 1 AND vb.label = 2) AND NOT (x.label = 3 AND vb.label = 4)),
tp AS (SELECT vec_id, arg_max(label, (sim, -ord)) AS label, max(sim) AS sim FROM pr GROUP BY vec_id HAVING max(sim) >= 0.3),
ar AS (SELECT e.vec_id AS id, CASE WHEN e.vec_id % 7 = 0 THEN NULL WHEN e.vec_id % 4 < 2 THEN e.label ELSE tp.label END AS skill, CASE WHEN e.vec_id % 7 = 0 THEN NULL WHEN e.vec_id % 4 < 2 THEN 'exact' WHEN tp.label IS NOT NULL THEN 'similar' END AS how, round(tp.sim, 4) AS sim
FROM embeddings e LEFT JOIN tp ON tp.vec_id = e.vec_id WHERE e.label IS NOT NULL)"""

QUERIES = {
    "vocab_phrases": (vocab_phrases, "WITH " + texts.VOCAB + r""", nm AS (SELECT DISTINCT lower(name) AS skill FROM (SELECT name FROM vc UNION ALL SELECT unnest(regexp_extract_all(text, '[a-z]+\. [A-Z][a-z]+')) FROM benchmark)),
tx AS (SELECT doc_id, replace(lower(text), 'ß', 'ss') AS x FROM documents)
SELECT skill, count(*) AS n_docs, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM tx JOIN nm ON contains(x, replace(skill, 'ß', 'ss')) AND regexp_matches(x, '(^|[^a-z0-9_])' || replace(replace(skill, 'ß', 'ss'), '.', '\.') || '($|[^a-z0-9_])') GROUP BY skill"""),
    "target_containment": (target_containment, "WITH " + texts.VOCAB + """, tx AS (SELECT doc_id, replace(lower(text), 'ß', 'ss') AS x FROM documents)
SELECT doc_id AS id, arg_min(name, (-length(name), name)) AS target FROM tx JOIN vc ON contains(x, replace(name, 'ß', 'ss')) GROUP BY doc_id"""),
    "align_rows": (align_rows, "WITH " + ALIGN + " SELECT id, skill, how, sim FROM ar"),
    "leader_clusters": (leader_clusters, "WITH RECURSIVE em AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), " + LEADERS.format(rows="em") + " SELECT id, leader FROM lc"),
    "unmatched_clusters": (unmatched_clusters, "WITH RECURSIVE " + ALIGN + ", un AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IN (SELECT id FROM ar WHERE skill IS NULL)), " + LEADERS.format(rows="un") + " SELECT leader, count(*) AS n FROM lc GROUP BY leader HAVING count(*) >= 3"),
    "stated_conflicts": (stated_conflicts, """WITH o AS (SELECT o_custkey AS id, o_orderkey, year(o_orderdate) * 12 + month(o_orderdate) + 120 AS a, o_orderkey % 7 - 1 AS k FROM orders),
r AS (SELECT id, o_orderkey, a, a + k AS b FROM o), g AS (SELECT * FROM r WHERE b >= a),
p AS (SELECT y.id, y.o_orderkey, count(*) AS n FROM g x JOIN g y ON x.id = y.id AND (x.a, x.b, x.o_orderkey) < (y.a, y.b, y.o_orderkey) AND x.b >= y.a GROUP BY ALL)
SELECT id, count(*) FILTER (b < a) AS n_reversed, count(n) AS n_overlapping, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_pairs FROM r LEFT JOIN p USING (id, o_orderkey) WHERE b < a OR n IS NOT NULL GROUP BY id"""),
}
