"""Steps that are dealt out to as many tasks as the rows need: same results, and no task's share grows with the table."""

import pytest
from conftest import DATA, table
from pyspark.sql import functions as F

from skillweave.operators import matching, votes
from skillweave.plans import registry
from skillweave.sources import shared, views

QUERIES = [
    "revote", "proposals", "bulk_approval", "review_effects", "vote_summary", "coverage_shift", "coverage_pool", "shift_set", "match_gaps", "curation_state", "curation_selected", "near_dup_pairs",
    "job_bodies", "requirement_assembly", "group_coverage", "report_lists", "direction_compare", "audit", "simulate_assumed",
]


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(shared, "ROWS_PER_TASK", 1000)


@pytest.mark.parametrize("name", QUERIES)
def test_dealt_out_query_equals_sql(spark, duck, small, name):
    got = registry.QUERIES[name](spark, DATA)
    assert table(got.toPandas()) == table(duck.execute(registry.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", ["vote_summary", "revote", "proposals", "coverage_pool", "coverage_shift", "requirement_assembly", "job_bodies"])
def test_tasks_grow_with_the_rows(spark, small, name):
    n = views.tasks(spark, DATA)
    assert n > 4
    plan = registry.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert f", {n}), REPARTITION_BY_NUM" in plan


def test_dedup_keep_earliest_dealt_out(spark, monkeypatch):
    rows = lambda: sorted(registry.QUERIES["dedup_keep_earliest"](spark, DATA).select("id").toPandas()["id"])
    whole = rows()
    monkeypatch.setattr(shared, "ROWS_PER_TASK", 500)
    assert rows() == whole


def test_gap_totals_are_the_gaps_summed(spark):
    """Members of one unit may ask for different minima, and a profile may hold any of them."""
    rows = spark.createDataFrame(
        [(1, s, k, 2, g, m) for s, k, g, m in [(1, "required", "a", 1), (2, "required", "a", 3), (3, "required", "a", 2), (4, "bonus", None, 1), (5, "required", None, 1), (6, "bonus", "b", 2), (7, "bonus", "b", 2)]] + [(2, 5, "required", 1, None, 1)],
        "job long, skill long, kind string, level int, group_id string, min_required int",
    )
    skills = spark.createDataFrame([(10, 1, 1), (10, 4, 1), (11, 2, 3), (11, 3, 1), (12, 5, 1), (12, 6, 1), (13, 5, 3), (None, 5, 1)], "resume long, skill long, held int")
    want = matching.gaps(rows, skills).groupBy("resume", "kind").agg(F.count("*").alias("n_gaps"), F.sum("missing").alias("missing"), F.sum("cover").alias("half_covered"))
    got = matching.gap_totals(rows, skills)
    assert table(got.toPandas()) == table(want.toPandas())


def test_revote_in_one_pass_is_two_votes(spark):
    rows = spark.createDataFrame([(1, 1, 1, 1, "required"), (1, 1, 2, 2, "required"), (1, 1, 3, 3, "bonus"), (1, 2, 2, 2, "bonus"), (1, 2, 4, 5, "bonus"), (1, 3, 5, None, "required"), (1, 3, 6, 7, "required"), (1, 4, 2, 1, None), (None, 4, 1, 1, "bonus"), (None, 4, 9, 2, "bonus")], "job long, skill long, evidence long, source long, vote string")
    gone = spark.createDataFrame([(2,), (2,), (6,), (None,)], "evidence long")
    a = votes.vote_summary(rows).selectExpr("job", "skill", "kind as kind_before")
    b = votes.vote_summary(rows.join(gone, "evidence", "left_anti")).selectExpr("job", "skill", "kind as kind_after")
    want = a.join(b, ["job", "skill"], "left").filter("not (kind_before <=> kind_after)")
    got = votes.revote(rows, gone)
    assert table(got.toPandas()) == table(want.toPandas()) and got.count() == 3
