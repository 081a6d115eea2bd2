"""Queries on texts, vocabularies, near duplicates, markets and evaluation, with the SQL that states their results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import dedup, evaluation, market, taxonomy
from ..sources import views as v
from ..sources.shared import saved
from . import facts

W, R = "WITH ", v.REQUIREMENTS_SQL
#: Keywords by priority, and heads, that occur in the given texts.
KEYWORDS = [("the", "system"), ("der", "data"), ("que", "iot"), ("ción", "ai")]
HEADS = {"benefit": [" the ", " la "], "intro": [" of ", " de "], "duty": [" and ", " und "], "requirement": [" in ", " en "]}


def html_strip(spark, sf_dir):
    text = t.strip_html(F.col("html"))
    return v.table(spark, sf_dir, "pages").select("page_id", F.length(text).alias("n_chars"), F.md5(text).alias("text_md5"))


def company_normalise(spark, sf_dir):
    name = F.concat(F.col("source"), F.lit(" （west） "), F.when(F.col("doc_id") % 2 == 0, "股份有限公司").otherwise("有限公司"))
    return v.table(spark, sf_dir, "documents").groupBy(t.normalise_company(name).alias("company")).agg(F.count("*").alias("n"))


def date_parse(spark, sf_dir):
    k = F.col("o_orderkey") % 5
    f = lambda p: F.date_format("o_orderdate", p)
    raw = F.when(k == 0, f("yyyy-MM-dd HH:mm:ss")).when(k == 1, f("yyyy/MM/dd")).when(k == 2, F.concat(F.lit("on "), f("yyyy.MM.dd"), F.lit(" at noon"))).when(k == 3, F.concat(f("MM-dd"), F.lit("发布"))).otherwise("none")
    return v.table(spark, sf_dir, "orders").select("o_orderkey", F.to_date(t.parse_day(raw, F.lit(2001))).alias("day"))


def section_split(spark, sf_dir):
    rows = v.table(spark, sf_dir, "documents").select("doc_id", F.explode(t.sections(F.col("text"), HEADS)).alias("s"))
    return rows.select("doc_id", F.col("s.section").alias("section"), F.length("s.text").alias("n_chars"), F.md5("s.text").alias("text_md5"))


def domain_classify(spark, sf_dir):
    return v.table(spark, sf_dir, "documents").groupBy("lang", t.classify(F.col("text"), KEYWORDS, "none").alias("domain")).agg(F.count("*").alias("n"))


def simhash(spark, sf_dir):
    rows = dedup.simhash(v.table(spark, sf_dir, "documents"), "doc_id", "text")
    return rows.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("simhash"))


def near_dup_pairs(spark, sf_dir):
    """Pairs of distinct hashes at most three bits apart, with the number of texts of each."""
    sizes = dedup.simhash(v.table(spark, sf_dir, "documents"), "doc_id", "text").groupBy("simhash").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"))
    sizes = saved(sizes, "classes")  # read four times; the texts are hashed once
    a, b = (sizes.select(F.col("simhash").alias(s), F.col("n").alias(f"n_{s}"), F.col("doc_id").alias(f"doc_{s}")) for s in "ab")
    rows = dedup.near_classes(sizes.select("simhash")).join(a, "a").join(b, "b")
    swap = F.col("doc_a") > F.col("doc_b")
    pick = lambda x, y, n: F.when(swap, F.col(y)).otherwise(F.col(x)).alias(n)
    return rows.select(pick("doc_a", "doc_b", "doc_1"), pick("doc_b", "doc_a", "doc_2"), pick("n_a", "n_b", "n_1"), pick("n_b", "n_a", "n_2"), t.hamming(F.col("a"), F.col("b")).alias("distance"))


def dedup_keep_earliest(spark, sf_dir):
    docs = v.postings(spark, sf_dir)
    rows = docs.select("id", F.col("id").alias("posting"), "observed_on").join(dedup.simhash(docs, "id", "body"), "id")
    return dedup.keep_earliest(rows).select("id", "observed_on")


def evidence_level(spark, sf_dir):
    level = t.evidence_level(F.col("text"), "tion|ung", "ment|heit|thing")
    return v.table(spark, sf_dir, "conversations").groupBy("role", level.alias("level")).agg(F.count("*").alias("n"))


def best_fragment(spark, sf_dir):
    """The strongest turn of each conversation: by level, then length, then place."""
    level = t.evidence_level(F.col("text"), "tion|ung", "ment|heit|thing")
    rows = v.table(spark, sf_dir, "conversations").withColumn("level", F.when(level == "result", 2).when(level == "use", 1).otherwise(0))
    best = F.max(F.struct("level", F.length("text").alias("size"), (-F.col("turn")).alias("back")))
    return rows.groupBy("conv_id").agg(best.alias("b")).select("conv_id", F.col("b.level").alias("level"), F.col("b.size").alias("size"), (-F.col("b.back")).alias("turn"))


def date_conflicts(spark, sf_dir):
    """Overlapping validity intervals of one job and skill: a range condition inside an equi-join."""
    rows = v.history(spark, sf_dir).filter("valid_to is not null").select("job", "skill", F.col("valid_from").alias("a"), F.col("valid_to").alias("b"))
    other = rows.withColumnRenamed("a", "c").withColumnRenamed("b", "d")
    return rows.join(other, ["job", "skill"]).filter("a < c and c <= b").groupBy("job").agg(F.count("*").alias("n_overlaps"), F.sum(F.datediff(F.least("b", "d"), "c")).alias("days"))


def vocabulary(spark, sf_dir):
    """Words of five letters or more that occur in two benchmark texts, most frequent first."""
    words = v.table(spark, sf_dir, "benchmark").select("item_id", F.explode(taxonomy.tokens(F.col("text"))).alias("name")).filter(F.length("name") >= 5)
    counts = words.groupBy("name").agg(F.count("*").alias("n")).filter("n >= 2")
    return counts.select(F.col("name").alias("skill"), "name", F.array(F.upper("name")).alias("synonyms"), (-F.col("n")).alias("ord"))


def vocab_mentions(spark, sf_dir):
    texts = v.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return taxonomy.mentions_of(texts, vocabulary(spark, sf_dir)).groupBy("skill").agg(F.count("*").alias("n_docs"))


def target_match(spark, sf_dir):
    titles = v.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("title"))
    names = vocabulary(spark, sf_dir).select("name", F.xxhash64("name").alias("ord"))
    longest = taxonomy.longest_contained(titles, names)
    return longest.groupBy(F.length("target").alias("length")).agg(F.count("*").alias("n"))


def align_exact(spark, sf_dir):
    names = v.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("mention"), F.concat(F.lit("  "), F.lower("c_mktsegment"), F.when(F.col("c_custkey") % 3 == 0, "x").otherwise("　")).alias("name"))
    vocab = v.table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.min("c_custkey").alias("ord")).select(F.col("c_mktsegment").alias("skill"), F.col("c_mktsegment").alias("name"), F.array().cast("array<string>").alias("synonyms"), "ord")
    return taxonomy.align_exact(names, vocab).groupBy("skill").agg(F.count("*").alias("n"))


def align_similarity(spark, sf_dir):
    """Each vector against the first vector of every label."""
    rows = v.table(spark, sf_dir, "embeddings")
    vocab = rows.groupBy("label").agg(F.min("vec_id").alias("ord"), F.min_by("embedding", "vec_id").alias("skill_vector")).withColumnRenamed("label", "skill")
    return taxonomy.align_similar(rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), vocab).select("id", "skill", F.round("sim", 4).alias("sim"))


def composite_split(spark, sf_dir):
    part = v.table(spark, sf_dir, "part")
    names = part.select(F.col("p_partkey").alias("mention"), F.concat("p_brand", F.lit("/"), F.when(F.col("p_partkey") % 3 == 0, "unknown").otherwise(F.upper("p_brand"))).alias("name"))
    vocab = part.select("p_brand").distinct().select(F.col("p_brand").alias("skill"), F.col("p_brand").alias("name"), F.array().cast("array<string>").alias("synonyms"), F.lit(0).alias("ord"))
    return taxonomy.split_composite(names, vocab)


def surface_clusters(spark, sf_dir):
    name = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_type")).otherwise(F.concat(F.lower("p_type"), F.lit("  ")))
    return taxonomy.surface_clusters(v.table(spark, sf_dir, "part").select(name.alias("name"), F.col("p_partkey").alias("ord")))


def evidence_map(spark, sf_dir):
    """Requirements of each job with the states of the evidence that profiles have: at level, below, none."""
    own = v.requirements(spark, sf_dir)
    held = own.join(v.resume_skills(spark, sf_dir), "skill").groupBy("job", "skill").agg(F.sum((F.col("held") >= F.col("level")).cast("long")).alias("at_level"), F.sum((F.col("held") < F.col("level")).cast("long")).alias("below"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return own.join(held, ["job", "skill"], "left").select("job", "skill", "kind", zero("at_level"), zero("below"))


def content_states(spark, sf_dir):
    """Per pair that shares a skill: requirements held at level, below it, missing."""
    own, skills = v.requirements(spark, sf_dir), v.resume_skills(spark, sf_dir)
    n = own.groupBy("job").agg(F.count("*").alias("n"))
    got = own.join(skills, "skill").groupBy("job", "resume").agg(F.sum((F.col("held") >= F.col("level")).cast("long")).alias("result"), F.sum((F.col("held") < F.col("level")).cast("long")).alias("mention"))
    return got.join(n, "job").select("job", "resume", "result", "mention", (F.col("n") - F.col("result") - F.col("mention")).alias("missing"))


def board(spark, sf_dir):
    """Jobs with their sources, without aliases (multiples of 11)."""
    rows = v.lines(spark, sf_dir)
    alias = rows.filter("job % 11 = 0").select("job").distinct()
    return rows.join(alias, "job", "left_anti").groupBy("job").agg(F.countDistinct("source").alias("n_sources"), F.countDistinct("evidence").alias("n_evidence"), F.max("observed_on").alias("latest"))


def heat(spark, sf_dir):
    return market.heat(v.requirements(spark, sf_dir))


def rise_fall(spark, sf_dir):
    """Jobs in which a skill was added or expired, counted per skill."""
    return facts.period_delta(spark, sf_dir).groupBy("skill", "change").agg(F.count("*").alias("n_jobs"), F.min("job").alias("first_job"))


def feed_groups(spark, sf_dir):
    return market.feed_groups(v.events(spark, sf_dir))


def feed_totals(spark, sf_dir):
    return market.feed_totals(v.events(spark, sf_dir))


def review_stats(spark, sf_dir):
    return market.review_stats(v.events(spark, sf_dir), F.lit("2024-01-20").cast("timestamp"))


def pulse_latest(spark, sf_dir):
    line = F.concat_ws(" ", "kind", F.get_json_object("payload", "$.k"))
    return market.pulse(v.events(spark, sf_dir)).select("id", line.alias("line"), "review")


def quiet_runs(spark, sf_dir):
    """Days of events by kind as pages; a page is new where a job shows up for the first time."""
    rows = v.events(spark, sf_dir)
    first = rows.groupBy("job").agg(F.min("at").alias("first"))
    days = rows.join(first, "job").groupBy(F.col("kind").alias("source"), F.to_date("at").alias("page")).agg(F.sum((F.col("at") == F.col("first")).cast("long")).alias("n_new"))
    return market.quiet_runs(days)


def gold_sets(spark, sf_dir):
    """Gold: a label's flags per document; prediction: flags by a rule on the text; elements are flag names."""
    labels = v.table(spark, sf_dir, "labels")
    docs = v.table(spark, sf_dir, "documents").join(labels, "doc_id")
    flags = lambda rows, pairs: rows.select(F.col("doc_id").alias("item"), F.explode(F.array_compact(F.array(*[F.when(c, n) for n, c in pairs]))).alias("element"))
    gold = flags(labels, [("quality", F.col("quality") == 1), ("toxic", F.col("toxic") == 1)])
    pred = flags(docs, [("quality", F.col("n_chars") > 400), ("toxic", F.lower("text").rlike("idiot|stupid|moron"))])
    return pred, gold, docs.select(F.col("doc_id").alias("item"), "lang")


def set_f1(spark, sf_dir):
    pred, gold, items = gold_sets(spark, sf_dir)
    return evaluation.set_f1(pred, gold, items)


def macro_f1(spark, sf_dir):
    pred, gold, items = gold_sets(spark, sf_dir)
    return evaluation.macro(evaluation.set_f1(pred, gold, items).join(items, "item"), ["lang"])


def adjudication(spark, sf_dir):
    pred, gold, items = gold_sets(spark, sf_dir)
    long = v.table(spark, sf_dir, "documents").filter("n_chars > 1000").select(F.col("doc_id").alias("item"), F.explode(F.array(F.lit("quality"), F.lit("toxic"))).alias("element"))
    return evaluation.adjudicate(gold, pred, long).groupBy("element", "state").agg(F.count("*").alias("n"))


def gold_sample(spark, sf_dir):
    rows = v.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("name"), F.col("lang").alias("domain"), F.col("doc_id").alias("ord"))
    return evaluation.stratified(rows, {"en": 40, "de": 12, "fr": 12, "es": 12}, 8, 100)


TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
VOCAB = rf"vc AS (SELECT w AS name, count(*) AS n FROM (SELECT item_id, unnest(list_distinct({TOK})) AS w FROM benchmark) WHERE length(w) >= 5 GROUP BY w HAVING count(*) >= 2)"
LEVEL = "CASE WHEN regexp_matches(text, '\\d') AND regexp_matches(text, '(?i)tion|ung') THEN {a} WHEN regexp_matches(text, '(?i)ment|heit|thing') THEN {b} ELSE {c} END"
SIM = r"""tk AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x))) AS w FROM documents) GROUP BY doc_id, w),
bt AS (SELECT doc_id, k, sum(CASE WHEN (CAST('0x' || substr(md5(w), 1, 16) AS UBIGINT) >> CAST(k AS UBIGINT)) & 1 = 1 THEN n ELSE -n END) AS s FROM tk, (SELECT unnest(range(64)) AS k) GROUP BY doc_id, k),
sh AS (SELECT doc_id, CAST(sum(CASE WHEN s > 0 THEN CAST(1 AS HUGEINT) << CAST(k AS INTEGER) ELSE 0 END) AS UBIGINT) AS h FROM bt GROUP BY doc_id),
al AS (SELECT d.doc_id, coalesce(h, 0) AS h FROM documents d LEFT JOIN sh USING (doc_id))"""
GOLD = """lb AS (SELECT labels.*, n_chars, lower(text) AS lt, lang FROM labels JOIN documents USING (doc_id)),
gs AS (SELECT DISTINCT doc_id AS item, 'quality' AS element FROM labels WHERE quality = 1 UNION SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1),
ps AS (SELECT DISTINCT doc_id AS item, 'quality' AS element FROM lb WHERE n_chars > 400 UNION SELECT doc_id, 'toxic' FROM lb WHERE regexp_matches(lt, 'idiot|stupid|moron')),
fc AS (SELECT i.item, coalesce(p, 0) AS n_pred, coalesce(g, 0) AS n_gold, coalesce(b, 0) AS common FROM (SELECT DISTINCT doc_id AS item FROM lb) i
  LEFT JOIN (SELECT item, count(*) AS p FROM ps GROUP BY item) USING (item) LEFT JOIN (SELECT item, count(*) AS g FROM gs GROUP BY item) USING (item)
  LEFT JOIN (SELECT item, count(*) AS b FROM ps JOIN gs USING (item, element) GROUP BY item) USING (item)),
ff AS (SELECT *, round(CASE WHEN n_pred = 0 AND n_gold = 0 THEN 1.0 WHEN n_pred = 0 OR n_gold = 0 THEN 0.0 ELSE 2 * common / (n_pred + n_gold) END, 6) AS f1 FROM fc)"""
HEAD_AT = ", ".join("coalesce(" + ", ".join(f"nullif(instr(text, '{w}'), 0)" for w in ws) + f") AS p_{s}" for s, ws in HEADS.items())

QUERIES = {
    "html_strip": (html_strip, r"SELECT page_id, length(x) AS n_chars, md5(x) AS text_md5 FROM (SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS x FROM pages)"),
    "company_normalise": (company_normalise, "SELECT source AS company, count(*) AS n FROM documents GROUP BY source"),
    "date_parse": (date_parse, """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 4 THEN NULL WHEN 3 THEN make_date(2001, month(o_orderdate), CASE WHEN month(o_orderdate) = 2 AND day(o_orderdate) = 29 THEN NULL ELSE day(o_orderdate) END) ELSE CAST(o_orderdate AS DATE) END AS day FROM orders"""),
    "section_split": (section_split, f"""WITH p AS (SELECT doc_id, text, {HEAD_AT} FROM documents),
m AS (SELECT doc_id, text, section, ats FROM (SELECT doc_id, text, unnest(['benefit', 'intro', 'duty', 'requirement']) AS section, unnest([p_benefit, p_intro, p_duty, p_requirement]) AS ats FROM p) WHERE ats IS NOT NULL),
l AS (SELECT * FROM m UNION ALL SELECT doc_id, text, 'requirement', 1 FROM documents WHERE coalesce((SELECT min(ats) FROM m WHERE m.doc_id = documents.doc_id), 2) > 1),
e AS (SELECT *, lead(ats, 1, length(text) + 1) OVER (PARTITION BY doc_id ORDER BY ats, section) AS stop FROM l)
SELECT doc_id, section, length(substr(text, ats, stop - ats)) AS n_chars, md5(substr(text, ats, stop - ats)) AS text_md5 FROM e"""),
    "domain_classify": (domain_classify, r"""SELECT lang, CASE WHEN regexp_matches(x, '(^|[^a-z0-9])the($|[^a-z0-9])') THEN 'system' WHEN regexp_matches(x, '(^|[^a-z0-9])der($|[^a-z0-9])') THEN 'data'
WHEN regexp_matches(x, '(^|[^a-z0-9])que($|[^a-z0-9])') THEN 'iot' WHEN contains(x, 'ción') THEN 'ai' ELSE 'none' END AS domain, count(*) AS n FROM (SELECT lang, lower(text) AS x FROM documents) GROUP BY ALL"""),
    "simhash": (simhash, W + SIM + " SELECT doc_id, lpad(lower(to_hex(h)), 16, '0') AS simhash FROM al"),
    "near_dup_pairs": (near_dup_pairs, W + SIM + """, cl AS (SELECT h, count(*) AS n, min(doc_id) AS doc FROM al GROUP BY h)
SELECT a.doc AS doc_1, b.doc AS doc_2, a.n AS n_1, b.n AS n_2, bit_count(xor(a.h, b.h)) AS distance FROM cl a JOIN cl b ON a.doc < b.doc WHERE bit_count(xor(a.h, b.h)) <= 3"""),
    "dedup_keep_earliest": (dedup_keep_earliest, ""),
    "evidence_level": (evidence_level, "SELECT role, " + LEVEL.format(a="'result'", b="'use'", c="'mention'") + " AS level, count(*) AS n FROM conversations GROUP BY ALL"),
    "best_fragment": (best_fragment, "SELECT conv_id, level, size, turn FROM (SELECT conv_id, turn, level, size, row_number() OVER (PARTITION BY conv_id ORDER BY level DESC, size DESC, turn) AS nth FROM (SELECT conv_id, turn, length(text) AS size, " + LEVEL.format(a=2, b=1, c=0) + " AS level FROM conversations)) WHERE nth = 1"),
    "date_conflicts": (date_conflicts, W + v.HISTORY_SQL + """, h AS (SELECT * FROM hist WHERE valid_to IS NOT NULL)
SELECT x.job, count(*) AS n_overlaps, CAST(sum(least(x.valid_to, y.valid_to) - y.valid_from) AS BIGINT) AS days FROM h x JOIN h y ON x.job = y.job AND x.skill = y.skill AND x.valid_from < y.valid_from AND y.valid_from <= x.valid_to GROUP BY x.job"""),
    "vocab_mentions": (vocab_mentions, W + VOCAB + f", tx AS (SELECT doc_id, unnest(list_distinct({TOK})) AS name FROM documents) SELECT name AS skill, count(*) AS n_docs FROM tx JOIN vc USING (name) GROUP BY name"),
    "target_match": (target_match, W + VOCAB + f", tx AS (SELECT doc_id, unnest({TOK}) AS name FROM documents), mx AS (SELECT doc_id, max(length(name)) AS length FROM tx JOIN vc USING (name) GROUP BY doc_id) SELECT length, count(*) AS n FROM mx GROUP BY length"),
    "align_exact": (align_exact, "SELECT CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS skill, count(*) AS n FROM customer GROUP BY ALL"),
    "align_similarity": (align_similarity, """WITH vb AS (SELECT label, min(vec_id) AS ord, arg_min(embedding, vec_id) AS e FROM embeddings GROUP BY label),
pr AS (SELECT vec_id, vb.label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])) AS sim, ord FROM embeddings, vb),
tp AS (SELECT vec_id, arg_max(label, (sim, -ord)) AS label, max(sim) AS sim FROM pr GROUP BY vec_id) SELECT vec_id AS id, CASE WHEN sim >= 0.7 THEN label END AS skill, round(sim, 4) AS sim FROM tp"""),
    "composite_split": (composite_split, "SELECT p_partkey AS mention, 0 AS pos, p_brand || '/unknown' AS name FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, 0, p_brand FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT p_partkey, 1, upper(p_brand) FROM part WHERE p_partkey % 3 <> 0"),
    "surface_clusters": (surface_clusters, """WITH n AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN upper(p_type) ELSE lower(p_type) || '  ' END AS name, p_partkey AS ord FROM part)
SELECT lower(trim(name)) AS surface, arg_max(name, (length(name), -ord)) AS centre, count(DISTINCT name) AS n_names, count(*) AS n FROM n GROUP BY lower(trim(name))"""),
    "evidence_map": (evidence_map, f"{W}{R}, {v.RESUME_SQL}, hd AS (SELECT req.job, req.skill, sum(CASE WHEN held >= level THEN 1 ELSE 0 END) AS a, sum(CASE WHEN held < level THEN 1 ELSE 0 END) AS b FROM req JOIN rs USING (skill) GROUP BY req.job, req.skill) SELECT req.job, req.skill, kind, coalesce(a, 0) AS at_level, coalesce(b, 0) AS below FROM req LEFT JOIN hd ON hd.job = req.job AND hd.skill = req.skill"),
    "content_states": (content_states, f"{W}{R}, {v.RESUME_SQL}, sz AS (SELECT job, count(*) AS n FROM req GROUP BY job) SELECT job, resume, sum(CASE WHEN held >= level THEN 1 ELSE 0 END) AS result, sum(CASE WHEN held < level THEN 1 ELSE 0 END) AS mention, max(n) - count(*) AS missing FROM req JOIN rs USING (skill) JOIN sz USING (job) GROUP BY job, resume"),
    "board": (board, f"{W}{R} SELECT job, count(DISTINCT source) AS n_sources, count(DISTINCT evidence) AS n_evidence, max(observed_on) AS latest FROM ln WHERE job % 11 <> 0 GROUP BY job"),
    "heat": (heat, f"{W}{R} SELECT skill, count(DISTINCT job) AS n, CAST(round_even(100 * count(DISTINCT job) / (SELECT count(DISTINCT job) FROM req), 0) AS BIGINT) AS percent FROM req GROUP BY skill"),
    "feed_groups": (feed_groups, W + v.EVENTS_SQL + ", f AS (SELECT CAST(ats AS DATE) AS day, job, review, kind, row_number() OVER (PARTITION BY CAST(ats AS DATE), job, review ORDER BY id) AS nth FROM ev) SELECT day, job, review, count(*) AS n, string_agg(CASE WHEN nth <= 6 THEN kind END, ',' ORDER BY nth) AS kinds FROM f GROUP BY day, job, review"),
    "feed_totals": (feed_totals, W + v.EVENTS_SQL + " SELECT kind, count(*) FILTER (review = 'pending') AS pending, count(*) FILTER (review = 'approved') AS approved, count(*) FILTER (review = 'auto_passed') AS auto_passed, count(*) FILTER (review = 'rejected') AS rejected, count(*) AS total FROM ev GROUP BY kind"),
    "review_stats": (review_stats, W + v.EVENTS_SQL + " SELECT review, count(*) AS total, count(*) FILTER (ats >= TIMESTAMP '2024-01-20') AS today, round((SELECT count(*) FILTER (review = 'approved') / count(*) FROM ev WHERE review IN ('approved', 'rejected')), 6) AS pass_rate FROM ev WHERE review <> 'pending' GROUP BY review"),
    "pulse_latest": (pulse_latest, W + v.EVENTS_SQL + " SELECT id, kind || coalesce(' ' || (payload ->> '$.k'), '') AS line, review FROM ev ORDER BY ats DESC, id DESC LIMIT 40"),
    "quiet_runs": (quiet_runs, W + v.EVENTS_SQL + """, fs AS (SELECT job, min(ats) AS first FROM ev GROUP BY job), dy AS (SELECT kind AS source, CAST(ats AS DATE) AS page, sum(CASE WHEN ats = first THEN 1 ELSE 0 END) AS n_new FROM ev JOIN fs USING (job) GROUP BY ALL),
rn AS (SELECT *, sum(CASE WHEN n_new > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY page) AS run FROM dy) SELECT source, count(*) AS length, min(page) AS first_page FROM rn WHERE n_new = 0 GROUP BY source, run"""),
    "set_f1": (set_f1, W + GOLD + " SELECT item, n_pred, n_gold, common, f1 FROM ff"),
    "macro_f1": (macro_f1, W + GOLD + ", li AS (SELECT DISTINCT doc_id AS item, lang FROM lb) SELECT lang, round(avg(f1), 6) AS macro_f1, count(*) AS n FROM ff JOIN li USING (item) GROUP BY lang"),
    "adjudication_prep": (adjudication, W + GOLD + """, bo AS (SELECT coalesce(g.item, p.item) AS item, coalesce(g.element, p.element) AS element, g.item IS NOT NULL AS g FROM gs g FULL JOIN ps p ON g.item = p.item AND g.element = p.element)
SELECT element, CASE WHEN g AND n_chars > 1000 THEN 'kept' WHEN g THEN 'suspect' ELSE 'proposal' END AS state, count(*) AS n FROM bo JOIN documents ON doc_id = item GROUP BY ALL"""),
    "gold_sample": (gold_sample, """WITH n AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS a FROM documents),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS b FROM n WHERE a <= 8), c AS (SELECT doc_id FROM q WHERE b <= CASE lang WHEN 'en' THEN 40 ELSE 12 END),
u AS (SELECT doc_id, 'quota' AS why FROM c UNION ALL SELECT doc_id, 'fill' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM c))
SELECT doc_id AS id, why FROM u ORDER BY why DESC, doc_id LIMIT 100"""),
    "rise_fall": (rise_fall, facts.QUERIES["period_delta"][1].replace("SELECT * FROM dl WHERE change IS NOT NULL", "SELECT skill, change, count(*) AS n_jobs, min(job) AS first_job FROM dl WHERE change IS NOT NULL GROUP BY skill, change")),
}
