"""Evaluation runs: frozen configurations, scores against sets, states of a summary."""

import random

import pytest

from skillweave.operators import evalrun
from skillweave.plans import evalruns

SETS = "task string, item string, element string"


def test_frozen_configuration(spark, tmp_path):
    one, two, again = (f"file://{tmp_path}/{n}" for n in ("one", "two", "again"))
    evalrun.freeze(spark, {"model": "m", "align_threshold": 0.7}, one)
    evalrun.freeze(spark, {"model": "m", "align_threshold": 0.71}, two)
    evalrun.freeze(spark, {"align_threshold": 0.7, "model": "m"}, again)
    a, b, c = (evalrun.frozen(spark, p) for p in (one, two, again))
    assert (a.align_threshold, a.model, a.date) == (0.7, "m", None) and b.align_threshold == 0.71
    assert a.hash == c.hash != b.hash and len(a.hash) == 64
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        evalrun.freeze(spark, {"align_threshold": 0.9}, one)
    assert evalrun.frozen(spark, one).hash == a.hash
    for name, settings in (("none", {"model": "m"}), ("high", {"align_threshold": 7}), ("text", {"align_threshold": "x"})):
        evalrun.freeze(spark, settings, f"file://{tmp_path}/{name}")
        with pytest.raises(ValueError):
            evalrun.frozen(spark, f"file://{tmp_path}/{name}")


def f1(p, g):
    if not p and not g:
        return 1.0, 1.0, 1.0
    if not p or not g:
        return 0.0, 0.0, 0.0
    a, b = len(p & g) / len(p), len(p & g) / len(g)
    return a, b, 0.0 if a + b == 0 else 2 * a * b / (a + b)


def test_scores_equal_sets(spark):
    draw = random.Random(5)
    items = [(t, str(i)) for t in "abc" for i in range(12)]
    some = lambda: [(t, i, draw.choice(["u", "v", "w", "x", "", " ", None])) for t, i in [*items, ("a", "99")] for _ in range(draw.randrange(5))]
    predicted, gold = some(), some()
    frame = lambda rows: spark.createDataFrame(rows, SETS)
    rows = evalrun.scores(spark.createDataFrame([*items, items[0]], "task string, item string"), frame(predicted), frame(gold))
    got = {(r.task, r.item): (r.precision, r.recall, r.f1) for r in rows.collect()}
    of = lambda rows, k: {e for t, i, e in rows if (t, i) == k and (e or "").strip()}
    assert got.keys() == set(items)
    for k in items:
        assert got[k] == pytest.approx(f1(of(predicted, k), of(gold, k)))


def test_predictions_without_a_mention_go(spark):
    predicted = spark.createDataFrame([("x", "1", "a"), ("x", "1", "b"), ("x", "2", "a"), ("y", "1", "b"), ("x", None, "a")], SETS)
    mentions = spark.createDataFrame([("1", "a"), ("1", "a"), ("2", "b")], "item string, element string")
    assert sorted(map(tuple, evalrun.borne_out(predicted, mentions, "x").collect())) == [("x", "1", "a"), ("y", "1", "b")]


def test_summary_states(spark, tmp_path):
    evalrun.freeze(spark, {"align_threshold": 0.5}, f"file://{tmp_path}/c")
    config = evalrun.frozen(spark, f"file://{tmp_path}/c")
    means = lambda rows: spark.createDataFrame(rows, "task string, precision double, recall double, f1 double, n long, mock boolean")
    rows = [("extraction", 1.0, 0.9, 0.9, 3, False), ("profile", 0.5, 0.5, 0.5, 2, False), ("match", 1.0, 1.0, 1.0, 9, True)]
    path = spark.createDataFrame([(True,), (None,), (False,), (True,)], "valid boolean")
    told = lambda df: [(r.name, r.f1, r.n, r.state, r.line) for r in df.orderBy("place").collect()]
    got = evalrun.summary(means(rows), path, config)
    assert told(got) == [
        ("extraction", 0.9, 3, "passed", "extraction 0.900 of 3 passed"), ("profile", 0.5, 2, "low", "profile 0.500 of 2 low"),
        ("match", None, 0, "missing", "match no figures missing"), ("path", 0.5, 4, "partial", "path 0.500 of 4 partial"),
    ]
    assert {r.hash for r in got.collect()} == {config.hash}
    nothing = evalrun.summary(means([]), path.limit(0), config)
    assert [r[3] for r in told(nothing)] == ["missing"] * 4
    assert [r[3] for r in told(evalrun.summary(means(rows), path.filter("valid"), config, mock=True))] == ["missing", "missing", "passed", "whole"]


def test_the_threshold_decides(spark):
    """Another frozen threshold gives other predictions in the one task that aligns by similarity."""
    from conftest import DATA

    n = []
    for cut in (0.3, 1.0):
        config = type("Config", (), {"align_threshold": cut})
        n.append({r.task: r["count"] for r in evalruns.tasks(spark, DATA, config)[1].groupBy("task").count().collect()})
    assert n[0]["profile"] > n[1]["profile"] and n[0]["extraction"] == n[1]["extraction"] and n[0]["match"] == n[1]["match"]
