"""Intake rules, state changes and views on jobs: counters, snapshots, expiry, clusters, approvals, gold decisions, verdicts, dossiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .gate import stripped

MIN_CLUSTER = 3
#: An intern's title, a title in ideographs.
INTERN, IDEOGRAPHS = "(?i)实习|intern", "[一-鿿]"


def keep_title(title: Column, known: Column, least_letters: str = IDEOGRAPHS, n: int = 2) -> Column:
    """No internship, at least n letters of the script, and a known domain, target or search hit."""
    text = F.coalesce(title, F.lit(""))
    return (text != "") & ~text.rlike(INTERN) & (F.regexp_count(text, F.lit(least_letters)) >= n) & known


def intake(rows: DataFrame) -> DataFrame:
    """rows(id, fingerprint, title_ok, body, ord) with what becomes of each: empty, title, repeat (a row with its fingerprint came before) or ingested."""
    blank = stripped(F.col("body")) == ""
    open_ = ~blank & F.coalesce("title_ok", F.lit(False))
    first = rows.filter(open_).groupBy("fingerprint").agg(F.min(F.struct("ord", "id"))["id"].alias("first"))
    out = rows.join(first, "fingerprint", "left")
    return out.withColumn("decision", F.when(blank, "empty").when(~open_, "title").when(F.col("id") != F.col("first"), "repeat").otherwise("ingested")).drop("first")


def snapshots(rows: DataFrame) -> DataFrame:
    """A snapshot per posting and body: rows(source, posting, simhash, observed_on) by the name of their content, first and last seen."""
    name = F.sha2(F.concat_ws("|", "source", F.col("posting").cast("string"), F.hex("simhash")), 256)
    return rows.groupBy("source", "posting", "simhash").agg(F.count("*").alias("n"), F.min("observed_on").alias("first"), F.max("observed_on").alias("last")).withColumn("snapshot", name)


def expire(versions: DataFrame, orders: DataFrame) -> DataFrame:
    """versions with those of orders(job, skill, at) closed at that day, where they are open and began before; ``closed`` tells which."""
    at = orders.groupBy("job", "skill").agg(F.min("at").alias("at"))
    hit = F.col("valid_to").isNull() & F.col("at").isNotNull() & (F.col("valid_from") <= F.col("at"))
    rows = versions.join(at, ["job", "skill"], "left").withColumn("closed", F.coalesce(hit, F.lit(False)))
    return rows.withColumn("valid_to", F.when(F.col("closed"), F.col("at")).otherwise(F.col("valid_to"))).drop("at")


def merge_clusters(rows: DataFrame, labels: DataFrame, least: int = MIN_CLUSTER) -> DataFrame:
    """rows(id, title) of titles with ``least`` rows or more, under the job that labels(title, label, target) give: an alias's target, the title itself if new; noise goes."""
    sizes = rows.groupBy("title").agg(F.count("*").alias("size")).filter(F.col("size") >= least)
    out = rows.join(sizes, "title").join(labels, "title").filter("label <> 'noise'")
    return out.select("id", "title", "size", F.when((F.col("label") == "alias") & F.col("target").isNotNull(), F.col("target")).otherwise(F.col("title")).alias("job"))


def bulk_approval(pending: DataFrame, unresolved: DataFrame, failed: DataFrame) -> DataFrame:
    """Per job of pending(job, id): the number of events, the batch's name, and whether it may be approved: no vote unresolved(job), no gate failed(job)."""
    batch = F.sha2(F.array_join(F.array_sort(F.collect_list(F.col("id").cast("string"))), ","), 256)  # a job's open events
    rows = pending.groupBy("job").agg(F.count("*").alias("n_pending"), batch.alias("batch"))
    for table, name in ((unresolved, "unresolved"), (failed, "failed")):
        rows = rows.join(table.select("job").distinct().withColumn(name, F.lit(True)), "job", "left")
    return rows.select("job", "n_pending", "batch", F.when(F.col("unresolved"), "unresolved vote").when(F.col("failed"), "gate failed").otherwise("approved").alias("outcome"))


def last_decisions(log: DataFrame) -> DataFrame:
    """From an append-only log(event, seq, review) the decision in force and how many there were."""
    return log.groupBy("event").agg(F.max_by("review", "seq").alias("review"), F.count("*").alias("n_decisions"))


def apply_gold(gold: DataFrame, decisions: DataFrame) -> DataFrame:
    """gold(item, element) after decisions(item, element, action: delete or add)."""
    gone = decisions.filter("action = 'delete'").select("item", "element")
    new = decisions.filter("action = 'add'").select("item", "element")
    return gold.join(gone, ["item", "element"], "left_anti").unionByName(new).distinct()


def adjudication_queue(items: DataFrame, done: DataFrame, by: str) -> DataFrame:
    """Per ``by`` of items(item, ord): the next row without a decision in done(item), and how many have one."""
    rows = items.join(done.select("item").distinct().withColumn("done", F.lit(1)), "item", "left")
    open_ = F.col("done").isNull()
    return rows.groupBy(by).agg(F.min_by(F.when(open_, F.col("item")), F.when(open_, F.col("ord"))).alias("next_item"), F.count("done").alias("n_done"), F.count("*").alias("n_items"))


def verdict(alias_of: Column, status: Column, n_sources: Column) -> Column:
    """What a job's dossier says: merged, compare, keep watching, too few sources, in review."""
    return F.when(alias_of.isNotNull(), "merged").when(status == "formed", "compare").when(status == "emerging", "watch").when(n_sources <= 1, "too_few").otherwise("in_review")


def current_definitions(versions: DataFrame, pointer: DataFrame) -> DataFrame:
    """Of versions(job, version, created_at) the one that pointer(job, version) names, else the newest."""
    rows = versions.join(pointer.select("job", F.col("version").alias("pointed")), "job", "left")
    key = F.struct((F.col("version") == F.coalesce("pointed", F.lit(None))).cast("int").alias("is_pointed"), "created_at", "version")
    return rows.groupBy("job").agg(F.max(F.struct(F.coalesce(key["is_pointed"], F.lit(0)).alias("pointed"), "created_at", "version")).alias("m")).select("job", "m.version", (F.col("m.pointed") == 1).alias("by_pointer"))


def ranked_stories(stories: DataFrame, k: int) -> DataFrame:
    """Of stories(status, job, named, n_changes) the first k per status: named ones first, then by volume of change."""
    w = Window.partitionBy("status").orderBy(F.desc("named"), F.desc("n_changes"), "job")
    return stories.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def valid_url(url: Column) -> Column:
    """An http(s) address with a host."""
    return F.coalesce(url.rlike(r"^https?://[^/\s?#]+"), F.lit(False))


def rank_jobs(pairs: DataFrame, k: int = 3) -> DataFrame:
    """The k best jobs of each profile by band, share of required units, evidence in the job's field, transferable skills, freshness, sources; then by job.

    pairs: resume, job, band, req_share, specific, transferable, latest, n_sources.
    """
    place = F.when(F.col("band") == "high", 3).when(F.col("band") == "basic", 2).when(F.col("band") == "gap", 1).otherwise(0)
    order = [F.desc(place), F.desc("req_share"), F.desc("specific"), F.desc("transferable"), F.desc("latest"), F.desc("n_sources"), "job"]
    return pairs.withColumn("place", F.row_number().over(Window.partitionBy("resume").orderBy(*order))).filter(F.col("place") <= k)
