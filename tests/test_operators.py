"""Single operators on tiny tables, with the values that their rules give."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from skillweave.functions import text as t
from skillweave.operators import dedup, evaluation, history, matching, release, taxonomy, votes
from skillweave.streaming import ingest


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(("score", "band"), [(85.0, "high"), (60.0, "basic"), (35.0, "gap"), (34.9, "none"), (0.0, "none")])
def test_bands(spark, score, band):
    assert one(spark, matching.band(F.lit(score))) == band


@pytest.mark.parametrize(("parts", "want"), [((2, 0, 2, 0), 100), ((1, 0, 2, 0), 50), ((0, 0, 0, 0), 0)])
def test_score(spark, parts, want):
    assert one(spark, matching.score(*[F.lit(float(p)) for p in parts])) == want


@pytest.mark.parametrize(("held", "level", "want"), [(None, 3, 1.0), (2, 3, 0.5), (3, 2, 1.0), (2, None, 1.0)])
def test_cover(spark, held, level, want):
    assert one(spark, matching.cover(F.lit("required"), F.lit(level).cast("int"), F.lit(held).cast("int"))) == want


REQ = "job long, skill long, kind string, level int, n_sources long, group_id string, min_required int"


def requirement(job, skill, kind="required", level=None, group=None, least=1):
    return (job, skill, kind, level, 1, group, least)


def test_group_minimum_and_gaps(spark):
    rows = spark.createDataFrame([requirement(1, s, group="g", least=2) for s in (1, 2, 3)], REQ)
    skills = spark.createDataFrame([(7, 1, 3)], "resume long, skill long, held int")
    pair = matching.compare(rows, skills).first()
    assert (pair["full_req"], pair["cov_req"]) == (2, 1)
    assert [tuple(r) for r in matching.gaps(rows, skills).collect()] == [(7, 1, "required", "g:g", 0.5, 1)]


def test_skill_of_a_group_is_no_unit_of_its_own(spark):
    rows = spark.createDataFrame([requirement(1, 1, group="g"), requirement(1, 1)], REQ)
    assert matching.unit_totals(matching.units(rows)).first()["full_req"] == 1


def test_shift_set_is_shortest_prefix(spark):
    rows = spark.createDataFrame([requirement(1, s) for s in range(1, 10)], REQ)
    skills = spark.createDataFrame([(7, 9, 3)], "resume long, skill long, held int")
    got = matching.shift_set(rows, skills).orderBy("step").collect()  # 1 of 9 held: 11.1, the next band at 35
    assert len(got) == 3 and got[-1]["reached"] >= 35


def test_shift_set_of_a_unit_held_in_part(spark):
    """One member of a group of two is held: the other one is still a gain, and lifts the pair."""
    rows = spark.createDataFrame([*(requirement(1, s, group="g", least=2) for s in (1, 2, 3)), requirement(1, 9, "bonus")], REQ)
    skills = spark.createDataFrame([(7, 1, 3)], "resume long, skill long, held int")
    got = [tuple(r) for r in matching.shift_set(rows, skills).collect()]  # 1 of 2.3: 43.48
    assert got == [(7, 1, "g:g", "required", 1, pytest.approx(100 * 2 / 2.3, abs=1e-3))]


def test_shift_set_equals_a_loop(spark):
    draw = random.Random(3)
    rows = [requirement(j, s, draw.choice(["required", "bonus"]), draw.choice([None, 1, 2, 3])) for j in range(6) for s in draw.sample(range(20), draw.randrange(1, 14))]
    skills = [(p, s, draw.randrange(1, 4)) for p in range(8) for s in draw.sample(range(20), draw.randrange(8))]
    want, held = [], {(p, s): h for p, s, h in skills}
    for j in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == j]
        whole = sum(1.0 if r[2] == "required" else 0.3 for r in own)
        for p in range(8):
            left, at, shared = [], 0.0, False
            for _, s, kind, level, *_ in own:
                h, w = held.get((p, s)), 1.0 if kind == "required" else 0.3
                shared |= h is not None
                cover = 0.0 if h is None else 1.0 if kind == "bonus" or level is None or h >= level else 0.5
                at += 100 * w * cover / whole
                if cover < 1:
                    left.append((-round((1 - cover) * w * 100 / whole, 6), f"s:{s}", kind))
            cut = next((c for c in (35, 60, 85) if round(at, 6) < c), None)
            for step, (loss, unit, kind) in enumerate(sorted(left) if cut and shared else [], 1):
                if at >= cut - 1e-5:
                    break
                at -= loss
                want.append((p, j, unit, kind, step, round(at, 2)))
    got = matching.shift_set(spark.createDataFrame(rows, REQ), spark.createDataFrame(skills, "resume long, skill long, held int")).collect()
    assert want and sorted((*r[:5], round(r[5], 2)) for r in got) == sorted(want)


def test_status(spark):
    rows = [(2, 2, 10, True, False, "candidate"), (3, 3, 10, True, False, "emerging"), (3, 10, 10, True, True, "formed"), (3, 3, 200, True, True, "formed"), (3, 10, 10, False, True, "candidate")]
    df = spark.createDataFrame(rows, "w long, t long, s long, j boolean, d boolean, want string")
    got = df.select(votes.status(F.col("w"), F.col("t"), F.col("s"), F.col("j"), F.col("d"), F.lit(False)).alias("x"), "want").collect()
    assert all(r["x"] == r["want"] for r in got)


def test_votes(spark):
    many = [(1, 1, e, e % 2, "required") for e in range(16)] + [(1, 1, 20 + e, 0, "bonus") for e in range(4)] + [(1, 1, 40 + e, 0, "unmarked") for e in range(5)] + [(1, 2, 1, 1, "required")]
    got = {r["skill"]: r["kind"] for r in votes.vote_summary(spark.createDataFrame(many, "job long, skill long, evidence long, source long, vote string")).collect()}
    assert got == {1: "required", 2: None}


def test_layers(spark):
    cases = [("", 9, 0.99, "low"), ("x", 3, 0.8, "high"), ("x", 2, 0.5, "mid"), ("x", 1, 0.4, "low")]
    assert all(one(spark, votes.layer(F.lit(e), F.lit(n), F.lit(c))) == want for e, n, c, want in cases)


D = dt.date
VERSIONS = "job long, skill long, valid_from date, valid_to date, curation boolean, retracted boolean"


def test_chains_look_at_the_previous_row_only(spark):
    rows = [(1, 1, D(2024, 1, 1), D(2024, 6, 1), False, False), (1, 1, D(2024, 2, 1), D(2024, 3, 1), False, False), (1, 1, D(2024, 4, 1), None, False, False), (1, 1, D(2024, 8, 1), None, False, False)]
    got = history.chain_spans(spark.createDataFrame(rows, VERSIONS)).orderBy("chain").collect()
    assert [(r["start"], r["stop"], r["versions"]) for r in got] == [(D(2024, 1, 1), D(2024, 3, 1), 2), (D(2024, 4, 1), None, 2)]


def test_period_delta(spark):
    rows = [
        (1, 1, D(2024, 1, 1), D(2024, 8, 1), False, False),  # ends in the quarter of the latest date
        (1, 2, D(2024, 7, 5), None, False, False),  # begins in it
        (1, 3, D(2024, 7, 6), None, True, False),  # curation alone
        (1, 4, D(2024, 7, 7), None, False, True),  # retracted
        (1, 5, D(2024, 1, 1), None, False, False),
    ]
    got = {(r["skill"], r["change"]) for r in history.period_delta(spark.createDataFrame(rows, VERSIONS)).collect()}
    assert got == {(1, "expired"), (2, "added")}


def test_scd2_is_idempotent(spark):
    schema = "job long, skill long, level int, valid_from date"
    now = spark.createDataFrame([(1, 1, 2, D(2024, 1, 1)), (1, 2, 1, D(2024, 1, 1))], schema)
    new = spark.createDataFrame([(1, 1, 3, D(2023, 6, 1)), (1, 3, 1, D(2024, 2, 1))], schema)
    first = history.apply_versions(now, new, ["level"])
    assert sorted((r["skill"], r["op"], r["valid_to"]) for r in first.collect() if r["op"] != "opened") == [(1, "closed", D(2024, 1, 1)), (2, "kept", None)]
    again = history.apply_versions(first.filter("valid_to is null").select("job", "skill", "level", "valid_from"), new, ["level"])
    assert {r["op"] for r in again.collect()} == {"kept", "same"}


def test_empty_keep_expires_nothing(spark):
    rows = spark.createDataFrame([(1, 1, D(2024, 1, 1), None, False, False)], VERSIONS)
    none = spark.createDataFrame([], "job long, skill long")
    at = spark.createDataFrame([(1, D(2024, 5, 1))], "job long, at date")
    assert history.expire_absent(rows, none, at).filter("expired").count() == 0


def test_gate_override_clears_growth_alone(spark):
    rows = spark.createDataFrame([requirement(1, s) for s in range(25)], REQ)
    before = spark.createDataFrame([requirement(1, s) for s in range(5)], REQ)
    override = spark.createDataFrame([(1,)], "job long")
    codes = lambda o: {r["code"] for r in release.gate_errors(rows, before, o).collect()}
    assert codes(override) == {"required_over_cap", "formal_over_cap"}
    assert codes(override.limit(0)) >= {"required_growth", "formal_growth"}


def test_release_names_follow_content(spark, tmp_path):
    rows = spark.range(5).withColumn("x", F.col("id") * 2)
    a = release.publish(spark, {"t": rows}, str(tmp_path), "2024Q1")
    b = release.publish(spark, {"t": rows.withColumn("x", F.col("x") + 1)}, str(tmp_path), "2024Q1")
    assert release.publish(spark, {"t": rows}, str(tmp_path), "2024Q1") == a != b
    release.point(spark, str(tmp_path), b)
    assert release.read_release(spark, str(tmp_path), "t").agg(F.sum("x")).first()[0] == 25


def test_texts(spark):
    assert one(spark, t.normalise_company(F.lit(" 某某（北京）科技 有限公司股份有限公司"))) == "某某科技"
    assert one(spark, t.normalise_company(F.lit("有限公司"))) == "有限公司"
    assert one(spark, t.strip_html(F.lit("<p>a<b> b</b>\n c</p>"))) == "a b c"
    assert str(one(spark, t.parse_day(F.lit("发布于 2024/03/05 12:00")))) == "2024-03-05 00:00:00"
    assert one(spark, t.parse_day(F.lit("never"))) is None
    parts = one(spark, t.sections(F.lit("前言岗位职责做事任职要求会写")))
    assert [(p["section"], p["text"]) for p in parts] == [("requirement", "前言"), ("duty", "岗位职责做事"), ("requirement", "任职要求会写")]
    assert one(spark, t.evidence_level(F.lit("led team, cut cost 30%"))) == "result"
    assert one(spark, t.mask_personal(F.lit("a@b.com 13812345678"))) == "[email] [phone]"
    assert one(spark, t.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0


def test_composites_and_alignment(spark):
    vocab = spark.createDataFrame([("c", "C", ["c lang"], 1), ("cpp", "C++", [], 2)], "skill string, name string, synonyms array<string>, ord long")
    names = spark.createDataFrame([(1, "C/C++"), (2, "C/unknown")], "mention long, name string")
    assert sorted((r["mention"], r["name"]) for r in taxonomy.split_composite(names, vocab).collect()) == [(1, "C"), (1, "C++"), (2, "C/unknown")]
    wide = spark.createDataFrame([(1, "　C　LANG ")], "mention long, name string")
    assert taxonomy.align_exact(wide, vocab).first()["skill"] == "c"


def sequential(rows):
    kept = []
    for r in sorted(rows, key=lambda r: (r[3], r[0])):
        if all(k[1] == r[1] or bin((k[2] ^ r[2]) & (2**64 - 1)).count("1") > 3 for k in kept):
            kept.append(r)
    return {r[0] for r in kept}


def test_keep_earliest_equals_one_pass(spark):
    rng = random.Random(5)
    rows = []
    for i in range(120):
        h = rng.choice([0b1011 << 20, 0b1000 << 40]) ^ (1 << rng.randrange(12)) ^ (1 << rng.randrange(12))
        rows.append((i, rng.randrange(60), h, D(2024, 1, 1 + rng.randrange(20))))
    df = spark.createDataFrame(rows, "id long, posting long, simhash long, observed_on date")
    assert {r["id"] for r in dedup.keep_earliest(df).collect()} == sequential(rows)


def test_keep_earliest_of_many_equal_texts(spark):
    """20,000 rows of one hash make no pairs: the first posting's rows stay."""
    df = spark.range(20_000).select("id", (F.col("id") % 5000).alias("posting"), F.lit(0).cast("long").alias("simhash"), F.lit("2024-01-01").cast("date").alias("observed_on"))
    assert {r["id"] for r in dedup.keep_earliest(df).collect()} == {0, 5000, 10_000, 15_000}


@pytest.mark.parametrize("seed", range(3))
def test_keep_earliest_of_near_classes_with_few_postings(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(4), rng.choice([0, 1, 3, 7, 15, 31, 63, 127, 1 << 40, 5 << 40]), D(2024, 1, 1 + rng.randrange(9))) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, posting long, simhash long, observed_on date")
    assert {r["id"] for r in dedup.keep_earliest(df).collect()} == sequential(rows)


def test_keep_earliest_follows_a_long_chain(spark):
    rows, h = [], 0
    for i in range(63):
        rows.append((i, i, h - (1 << 64) if h >> 63 else h, D(2024, 1, 1)))
        h ^= 3 << 2 * i % 64
    df = spark.createDataFrame(rows, "id long, posting long, simhash long, observed_on date")
    assert {r["id"] for r in dedup.keep_earliest(df).collect()} == set(range(0, 63, 2))


def test_f1_of_empty_sets(spark):
    items = spark.createDataFrame([(1,), (2,), (3,)], "item long")
    pred = spark.createDataFrame([(2, "a"), (3, "a"), (3, "b")], "item long, element string")
    gold = spark.createDataFrame([(3, "a")], "item long, element string")
    got = {r["item"]: r["f1"] for r in evaluation.set_f1(pred, gold, items).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: pytest.approx(2 / 3, abs=1e-6)}


def test_late_older_posting_replaces(spark):
    schema = "id long, posting long, body string, observed_on date"
    body = " ".join(f"word{i}" for i in range(60))
    known = spark.createDataFrame([(1, 1, body, D(2024, 2, 1))], schema)
    batch = spark.createDataFrame([(2, 2, body, D(2024, 1, 1)), (3, 3, "something else", D(2024, 1, 1))], schema)
    after = ingest.merge_batch(batch, known)
    assert sorted((r["id"], r["op"]) for r in ingest.emit_changes(known, after).collect()) == [(1, "remove"), (2, "add"), (3, "add")]
