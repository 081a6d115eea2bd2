"""Sources, stores, model output and budgets on tiny tables."""

import json

import pytest
from conftest import DATA, table
from pyspark.sql import functions as F

from skillweave.operators import mentions, release
from skillweave.plans import registry
from skillweave.sources import postings


def test_tolerant_read_and_quarantine(spark, tmp_path):
    row = {"id": "jd-1", "company": "x", "title": "t", "body": "b", "observed_at": "0001-01-01T00:00:00", "simhash": "ffffffffffffffff", "domain": "ai"}
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(json.dumps(row))
    (tmp_path / "in/b.json").write_text('{"id": "jd-2", broken')
    good, bad = postings.read_postings(spark, f"{tmp_path}/in")
    assert good.select("id", "simhash", F.col("observed_at").isNull().alias("unknown")).first()[:] == ("jd-1", -1, True)
    assert bad.count() == 1
    postings.write_postings(good.drop("file"), f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").filter("domain = 'ai'").count() == 1


def test_landed_answers(spark):
    body = json.dumps({"data": {"list": [{"jobId": "7", "name": "Engineer", "corp": "某某有限公司"}, {"id": "8", "name": ""}]}})
    rows = spark.createDataFrame([(body,)], "payload string")
    got = postings.landed(rows, "payload", "$.data.list", {"job_id": ["$.jobId", "$.id"], "title": ["$.name"], "company": ["$.corp"]}, "portal").orderBy("job_id").collect()
    assert [(r["job_id"], r["title"], r["company"]) for r in got] == [("7", "Engineer", "某某"), ("8", None, "")]
    assert got[0]["fingerprint"] != got[1]["fingerprint"]


def test_store_round_trip_and_lost_ends(spark, tmp_path):
    nodes, edges = spark.createDataFrame([("a",), ("b",)], "id string"), spark.createDataFrame([("a", "b")], "src string, dst string")
    postings.export_store(spark, {"nodes": nodes, "edges": edges}, f"{tmp_path}/good")
    got = postings.import_store(spark, f"{tmp_path}/good", {"nodes": "id"}, [("edges", "dst", "nodes")])
    assert got["edges"].count() == 1
    postings.export_store(spark, {"nodes": nodes.filter("id = 'a'"), "edges": edges}, f"{tmp_path}/bad")
    with pytest.raises(ValueError, match=r"edges\.dst"):
        postings.import_store(spark, f"{tmp_path}/bad", {"nodes": "id"}, [("edges", "dst", "nodes")])


def test_runs_and_portals(spark):
    log = spark.createDataFrame([("r", "a", "failed", 1), ("r", "a", "done", 2), ("r", "b", "failed", 3)], "run string, portal string, status string, at long")
    assert [r["portal"] for r in postings.run_log(log).collect()] == ["b"]
    table = spark.createDataFrame([("a", "x.example.com", True), ("b", "x.example.com", True), ("c", "bad host", True)], "portal string, host string, enabled boolean")
    assert {(r["portal"], r["error"]) for r in postings.valid_portals(table).collect()} == {("c", "bad_host"), ("b", "repeated_host")}


def test_model_answers(spark):
    answer = '```json\n{"job_name": "J", "skills": [{"name": " Spark ", "confidence": "85", "section": "DUTY", "min_required": "0"}, {"name": ""}]}\n```'
    rows = spark.createDataFrame([(1, answer), (2, "no object")], "posting_id long, answer string")
    good, bad = mentions.extracted(rows, "answer", {"duty": "duty"}, {})
    r = good.first()
    assert (good.count(), r["name"], r["confidence"], r["section"], r["min_required"]) == (1, "Spark", 0.85, "duty", 1)
    assert bad.first()["posting_id"] == 2


def test_groups_votes_and_numbers(spark):
    one = lambda e: spark.range(1).select(e.alias("x")).first()["x"]
    assert one(mentions.infer_group(F.lit("至少 2 种语言")))["min_required"] == 2
    assert one(mentions.infer_group(F.lit("熟悉语言"))) is None
    assert one(mentions.requirement_vote(F.lit("required"), F.lit("plain"), F.lit("duty"), "must")) == "unmarked"
    assert one(mentions.invented_numbers(F.lit("up 30% in 2 years"), F.lit("2 years"))) == ["30"]


def test_budget_skips_and_demotes(spark):
    units = [(1, "a", 1, 2, 1), (1, "b", 2, 5, 1), (1, "c", 3, 1, 1), (1, "d", 4, 1, 0)]  # caps 3 and 4: b does not fit at all
    got = release.select_within_budget(spark.createDataFrame(units, "job long, unit string, place long, cost long, wants long"), 2, 4).orderBy("unit").collect()
    assert [(r["unit"], r["kind"]) for r in got] == [("a", "required"), ("c", "bonus"), ("d", "bonus")]


def test_group_repairs(spark):
    rows = spark.createDataFrame([(1, 1, "required", "g", 5), (1, 2, "bonus", "g", 5)], "job long, skill long, kind string, group_id string, min_required int")
    assert release.inconsistent_groups(rows).count() == 1
    assert release.inconsistent_groups(release.repair_groups(release.repair_groups(rows, "set_kind"), "set_min_required", 2)).count() == 0
    assert release.repair_groups(rows, "dissolve").filter("group_id is not null").count() == 0


def test_claims_need_their_excerpt(spark):
    claims = spark.createDataFrame([(1, "abc", ["x", "y"]), (2, "zzz", ["x"]), (3, "q", [])], "claim long, excerpt string, sources array<string>")
    bodies = spark.createDataFrame([("x", "no"), ("y", "1 abc 2")], "source string, body string")
    assert {r["claim"]: r["supported"] for r in mentions.supported(claims, bodies).collect()} == {1: True, 2: False, 3: True}


def test_every_approval_and_rejection_decides(spark, duck, tmp_path):
    """Approvals of any value count, the job's last decision wins; events that only wait or pass by themselves are none."""
    for name in ("lineitem", "orders"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{DATA}/{name}.parquet")
    rows = [(1, 1, 20.0), (2, 2, 95.0), (3, 2, 58.9), (4, 3, 25.0), (5, 3, 90.0), (6, 4, 95.0), (7, 4, 59.0), (8, 4, 10.0), (9, 4, 70.0), (10, 5, 19.9), (11, 5, 89.0), (12, 77, 30.0)]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").selectExpr("event_id", "timestamp '2024-01-01' as ts", "user_id", "'view' as event_type", "value", "'{}' as props").write.parquet(f"{tmp_path}/events.parquet")
    decided = {1: "approved", 2: "approved", 3: "rejected", 4: "approved"}
    own = registry.QUERIES["proposals"](spark, DATA).toPandas()
    passes = (own["layer"] == "high") & (own["n_sources"] >= 3) & own["kind"].notna()
    own["review"] = own["job"].map(decided).fillna(passes.map({True: "auto_passed", False: "pending"}))
    want = table(own.groupby(["layer", "review"]).size().reset_index(name="n"))
    assert table(registry.QUERIES["review_effects"](spark, str(tmp_path)).toPandas()) == want
    with duck.cursor() as other:
        other.execute(f"CREATE TEMP VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
        assert table(other.execute(registry.ORACLE_SQL["review_effects"]).df()) == want
