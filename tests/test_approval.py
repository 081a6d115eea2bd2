"""Approval of all open proposals: stated cases of every outcome, retries, odd rows."""

from pyspark.sql import functions as F

from skillweave.operators import approval

PENDING = "job long, id string, event string, skill string, name string, proposed_kind string, group_id string, min_required int, sources array<string>, excerpt string"
REQUIRES = "job long, skill string, name string, kind string, group_id string, min_required int, sources array<string>, excerpt string"
CLAIMS = "job long, claim string, text string, excerpt string, sources array<string>"
EVIDENCE = "job long, id string, body string, retracted boolean"


def adds(job, n, kind="required", event="requires_add", start=0):
    return [(job, f"ev{job}-{i}", event, f"p{i}", None, kind, None, None, ["e"], f"need p{i}") for i in range(start, start + n)]


def has(job, n):
    return [(job, f"s{i}", None, "required", None, None, ["e"], f"need s{i}") for i in range(n)]


def inputs(spark, pending, base, previous=(), overrides=(), decided=()):
    jobs = sorted({r[0] for r in [*pending, *base] if r[0] is not None})
    body = " ".join(f"need {c}{i};" for c in "ps" for i in range(30))
    frame = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    return (
        frame(pending, PENDING), frame(base, REQUIRES), frame([(j, f"c{j}", "does it", None, []) for j in jobs], CLAIMS), frame([(j, "e", body, False) for j in jobs], EVIDENCE),
        frame(previous, REQUIRES), frame(overrides, "job long, reason string"), frame(decided, "batch string"),
    )


def told(rows):
    return {r.job: (r.outcome, r.n_pending, r.n_unresolved, r.codes) for r in rows.collect()}


def test_every_outcome(spark):
    pending = [
        *adds(1, 2), *adds(2, 2), *adds(2, 1, kind=None, start=5), *adds(3, 9), *adds(4, 6), *adds(5, 6),
        *adds(6, 1, kind="other"), *adds(7, 1, kind="", event="note"), (None, "x", "note", None, None, None, None, None, None, None),
        (8, "a", "requires_add", "s0", None, "bonus", None, None, ["gone"], "need s0"),
    ]
    base = [r for j in range(1, 10) for r in has(j, 4)]
    previous = [r for j in (4, 5) for r in has(j, 3)]
    got = told(approval.what_if(*inputs(spark, pending, base, previous, [(5, "grown"), (4, " \t")])))
    growth = "required_delta_anomaly,formal_delta_anomaly"
    assert got == {
        1: ("approved", 2, 0, ""), 2: ("unresolved", 3, 1, ""), 3: ("blocked", 9, 0, "required_count_exceeded"), 4: ("reason_needed", 6, 0, growth), 5: ("approved", 6, 0, ""),
        6: ("unresolved", 1, 1, ""), 7: ("approved", 1, 0, ""), 8: ("blocked", 1, 0, "evidence_missing,duplicate_requirement"),
    }


def test_a_retry_decides_nothing_anew_and_approves_the_same(spark):
    pending = [*adds(1, 3), *adds(1, 1, event="note", start=7), *adds(2, 1, kind=None)]
    base = [*has(1, 2), *has(2, 2)]
    first = inputs(spark, pending, base)
    once = approval.what_if(*first)
    log = approval.recorded(once, spark.createDataFrame([(1, " why ")], "job long, reason string"), first[-1], "admin")
    rows = log.collect()
    assert [(r.job, r.n_pending, r.actor, r.reason) for r in rows] == [(1, 4, "admin", "why")]
    again = inputs(spark, [*pending, pending[0]], base, decided=[(rows[0].batch,)])  # a repeated row changes no batch
    twice = approval.what_if(*again)
    assert told(twice)[1][0] == "repeated" and told(twice)[2][0] == "unresolved"
    assert approval.recorded(twice, again[5], again[-1], "admin").count() == 0
    reviews = lambda rows: sorted((r.job, r.id, r.review, r.approved_kind) for r in rows.collect())
    assert reviews(approval.reviewed(first[0], once)) == reviews(approval.reviewed(again[0], twice))
    assert {r[2:] for r in reviews(approval.reviewed(first[0], once)) if r[0] == 2} == {("pending", None)}


def test_a_batch_is_the_set_of_its_events(spark):
    rows = spark.createDataFrame(adds(1, 5), PENDING)
    name = lambda df, **k: [r.batch for r in approval.batches(df, **k).collect()]
    assert name(rows) == name(rows.orderBy(F.desc("id")).repartition(3)) and len(name(rows)[0]) == 29
    assert name(rows) != name(rows.filter("id <> 'ev1-2'")) != name(rows, version="latest")


def test_nothing_open(spark):
    assert approval.what_if(*inputs(spark, [], has(1, 2))).count() == 0
