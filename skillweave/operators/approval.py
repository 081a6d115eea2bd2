"""Approval of all open proposals of a job at once: the gate on a state that does not exist yet.

pending(job, id, event, skill, name, proposed_kind, group_id, min_required, sources, excerpt): open events; those of event ``requires_add`` propose a
requirement, others only wait for their review. decided(batch): the log of decisions taken. The other inputs are the gate's; only rows of jobs with open
events reach it. A batch is named by its job, the number of its events and two sums of hashes of their ids, which combine before the shuffle:
a busy job's ids are gathered nowhere.

Defined results: equal rows are one event; a null id counts as an empty one, events without a job take no part; a job without open events has no row;
a kind that is neither required nor bonus (null, blank) is an unresolved vote. Null and blank reasons are none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import saved
from . import gate

ADD, KINDS = "requires_add", ["required", "bonus"]
OUTCOMES = ("repeated", "unresolved", "blocked", "reason_needed", "approved")


def _open(pending: DataFrame) -> DataFrame:
    return pending.filter("job is not null").withColumn("id", F.coalesce(F.col("id").cast("string"), F.lit(""))).distinct()


def resolved() -> Column:
    return F.coalesce(F.col("proposed_kind").isin(KINDS), F.lit(False))


def batches(pending: DataFrame, version: str = "pending") -> DataFrame:
    """job, n_pending, batch: the name is a function of the set of a job's open events alone."""
    hashed = lambda start: F.conv(F.substring(F.md5("id"), start, 15), 16, 10).cast("long")
    rows = _open(pending).select("job", "id").distinct()
    of = rows.groupBy("job").agg(F.count("*").alias("n_pending"), F.bit_xor(hashed(1)).alias("x"), F.sum(hashed(16).cast("decimal(20,0)")).alias("s"))
    told = F.concat_ws("|", F.col("job").cast("string"), F.lit(version), *(F.col(c).cast("string") for c in ("n_pending", "x", "s")))
    return of.select("job", "n_pending", F.concat(F.lit("bulk-"), F.substring(F.sha2(told, 256), 1, 24)).alias("batch"))


def proposals(pending: DataFrame) -> DataFrame:
    """The requirements that open events with a resolved kind would add."""
    rows = _open(pending).filter((F.col("event") == ADD) & resolved())
    return rows.select("job", "skill", "name", F.col("proposed_kind").alias("kind"), "group_id", F.coalesce("min_required", F.lit(1)).alias("min_required"), "sources", "excerpt")


def what_if(pending: DataFrame, requires: DataFrame, claims: DataFrame, evidence: DataFrame, previous: DataFrame, overrides: DataFrame, decided: DataFrame, version: str = "pending") -> DataFrame:
    """job, n_pending, batch, n_unresolved, codes, outcome of each job with open events. The first that holds:

    repeated (the log has the batch: a retry), unresolved (a proposal without a kind), reason_needed (the gate on what is in force and the proposals finds
    growth alone, and overrides(job, reason) has no reason), blocked (the gate finds more), approved. ``codes`` are the gate's, in its order, whatever the outcome."""
    own = saved(batches(pending, version), "approval-batches")
    asked = own.select("job")
    of = lambda df: df.join(asked, "job", "left_semi")
    shape = ["job", "skill", "name", "kind", "group_id", "min_required", "sources", "excerpt"]
    state = of(requires).select(*shape).unionByName(proposals(pending).select(*shape))
    reasons = overrides.filter(gate.stripped(F.col("reason")) != "").select("job").distinct()
    verdicts = gate.verdicts(asked, gate.gate(asked, saved(state, "approval-state"), of(claims), of(evidence), of(previous), reasons))
    open_votes = _open(pending).filter((F.col("event") == ADD) & ~resolved()).groupBy("job").agg(F.count("*").alias("n_unresolved"))
    told = own.join(verdicts.select("job", "codes"), "job").join(open_votes, "job", "left").join(decided.select("batch", F.lit(True).alias("decided")).distinct(), "batch", "left")
    growth = F.size(F.array_except(F.split("codes", ","), F.array(*map(F.lit, gate.ANOMALIES)))) == 0
    outcome = (
        F.when(F.col("decided"), "repeated").when(F.col("n_unresolved") > 0, "unresolved").when(F.col("codes") == "", "approved").when(growth, "reason_needed").otherwise("blocked")
    )
    return told.select("job", "n_pending", "batch", F.coalesce("n_unresolved", F.lit(0)).alias("n_unresolved"), "codes", outcome.alias("outcome"))


def reviewed(pending: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The open events after the batch: review, and approved_kind where a resolved kind was proposed. A repeated batch approves again what it approved."""
    rows = _open(pending).join(outcomes.select("job", "batch", F.col("outcome").isin("approved", "repeated").alias("passed")), "job")
    kind = F.when(F.col("passed") & resolved(), F.col("proposed_kind"))
    return rows.select("job", "id", F.when(F.col("passed"), "approved").otherwise("pending").alias("review"), kind.alias("approved_kind"), "batch")


def recorded(outcomes: DataFrame, overrides: DataFrame, decided: DataFrame, actor: str) -> DataFrame:
    """batch, job, n_pending, actor, reason: what to append to the log; nothing for a batch that it has."""
    reasons = overrides.groupBy("job").agg(F.min(gate.stripped(F.col("reason"))).alias("reason"))
    new = outcomes.filter("outcome = 'approved'").join(decided.select("batch"), "batch", "left_anti").join(reasons, "job", "left")
    return new.select("batch", "job", "n_pending", F.lit(actor).alias("actor"), F.coalesce("reason", F.lit("")).alias("reason"))
