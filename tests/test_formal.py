"""Release gate, claim repair, definitions and curation: stated cases and sequential versions on random tables."""

import random

import pytest
from pyspark.sql import functions as F

from skillweave.operators import curate, definitions, gate, release

REQUIRES = "job long, skill string, name string, kind string, group_id string, min_required int, sources array<string>, excerpt string"
CLAIMS = "job long, claim string, text string, excerpt string, sources array<string>"
EVIDENCE = "job long, id string, body string, retracted boolean"
ROWS = "job long, skill string, name string, kind string, group_id string, min_required int, confidence double, sources array<string>"
EVENTS = "job long, id long, at long, review string, excerpt string, sources array<string>"
P, J = gate.PREFIX, gate.JOINT


def needs(job, n, kind="required"):
    return [(job, f"s{i}", None, kind, None, None, [f"e{i}"], f"need s{i}") for i in range(n)]


def gated(spark, jobs, requires, claims, evidence, previous=(), overrides=()):
    frame = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    ids = frame([(j,) for j in jobs], "job long")
    found = gate.gate(ids, frame(requires, REQUIRES), frame(claims, CLAIMS), frame(evidence, EVIDENCE), frame(previous, REQUIRES), frame([(j,) for j in overrides], "job long"))
    rows = sorted((r.job, r.code, r.item, r.reasons) for r in found.collect())
    told = {r.job: (r.ok, r.codes, r.reason) for r in gate.verdicts(ids, found).collect()}
    return rows, told


def test_gate_cases(spark):
    plain = lambda job: (job, f"c{job}", "does the work", None, [])
    bodies = lambda job, n: [(job, f"e{i}", f"we need s{i} here", False) for i in range(n)]
    requires = [
        (1, "s1", None, "required", None, None, [], ""),  # no definition, no source, no excerpt
        *needs(2, 25),
        *needs(3, 10), *needs(4, 10),  # growth, without and with an override
        (5, "py", None, "required", "g1", 1, ["e1"], "Python"), (5, "go", None, "bonus", "g1", 1, ["e1"], "Go"),
        (6, "a", None, "required", "g1", 3, ["e1"], "Python"), (6, "b", None, "required", "g1", 3, ["e1", None, ""], "Go"),
        (7, "a", None, "required", None, None, ["e1", "gone"], "Python"), (7, "a", None, "bonus", None, None, ["e2"], "not there"),
        (8, "a", None, "bonus", "", None, ["e1"], "　Python\n"),
        (9, "a", None, "required", None, None, ["e1"], "anything"),  # no body can be read
    ]
    evidence = [*bodies(2, 25), *bodies(3, 10), *bodies(4, 10), *((j, "e1", "good at Python or Go", False) for j in (5, 6, 7, 8)), (7, "e2", "retracted text", True), (9, "e1", None, False)]
    claims = [*map(plain, range(2, 9)), (9, "c9", f"x{P}one{J} two {J}", None, ["e1"]), (1, "c1", " 　\n", None, [])]
    previous = [*needs(3, 3), *needs(4, 3)]
    rows, told = gated(spark, range(1, 11), requires, claims, evidence, previous, [4])
    by = {j: sorted(x[1:] for x in rows if x[0] == j) for j in range(1, 11)}
    assert by[1] == [("definition_missing", "", ""), ("evidence_missing", "s1", "excerpt_missing,no_sources")]
    assert by[2] == [("formal_count_exceeded", "25", ""), ("required_count_exceeded", "25", "")]
    assert by[3] == [("formal_delta_anomaly", "7", ""), ("required_delta_anomaly", "7", "")] and by[4] == []
    assert by[5] == [("invalid_requirement_group", "g1", "mixed_kind")]
    assert by[6] == [("invalid_requirement_group", "g1", "min_required_out_of_range")]
    assert by[7] == [("duplicate_requirement", "a", ""), ("evidence_missing", "a", "excerpt_not_in_evidence"), ("evidence_missing", "a", "source_unknown"), ("evidence_retracted", "e2", "")]
    assert by[8] == [("required_group_missing", "", "")]
    assert by[9] == [("evidence_missing", "c9", "fragment_not_in_evidence")]
    assert by[10] == [("definition_missing", "", ""), ("required_group_missing", "", "")]
    assert told[4] == (True, "", "") and told[10][2] == J.join(list(gate.LABELS.values())[:2])
    assert told[7] == (False, "evidence_missing,evidence_retracted,duplicate_requirement", "要求缺少有效证据；要求引用了已撤回证据")


def test_gate_of_empty_tables(spark):
    assert gated(spark, [], [], [], []) == ([], {})


def test_fragments_repair_and_edits(spark):
    claims = spark.createDataFrame(
        [
            (1, "c", f"感知岗{P}熟悉C/C++软件开发与调试{J}参与预测模块的设计与开发{J}熟悉C/C++软件开发与调试", None, ["e1"]),
            (2, "c", f"岗{P}负责一切", None, ["e1"]), (3, "c", "plain", None, None), (4, "c", f"x{P}one", f"y{P}two {J} ", ["e1", "e2"]), (5, "c", f"x{P}one", None, ["e1", "nowhere"]),
        ],
        CLAIMS,
    )
    evidence = spark.createDataFrame([(1, "e1", "2、熟悉C/C++软件开发与调试，熟悉MATLAB；3、拆解和参与预测模块（行为预测）、决策规划模块的设计与开发", False), (2, "e1", "别的", False), (4, "e1", "one", False), (4, "e2", "two", True), (5, "e1", "one", False)], EVIDENCE)
    parts = {(r.job, r.place): (r.fragment, r.supported, r.sources) for r in gate.checked_fragments(claims, evidence).collect()}
    assert parts[1, 0] == ("熟悉C/C++软件开发与调试", True, ["e1"]) and parts[1, 1] == ("参与预测模块的设计与开发", False, []) and parts[4, 0] == ("two", True, ["e2"]) and (4, 1) not in parts
    issues = {r.job: r.reason for r in gate.claim_issues(claims, evidence).collect()}
    assert issues == {1: "fragment_not_in_evidence", 2: "fragment_not_in_evidence", 4: "source_unavailable", 5: "source_unavailable"}
    fixed = {r.job: (r.text, r.status, r.passes) for r in gate.repair_and_check(claims, evidence).collect()}
    assert fixed[1] == (f"感知岗{P}熟悉C/C++软件开发与调试", "repaired", True)
    assert fixed[2] == (f"岗{P}负责一切", "lost", False) and fixed[3] == ("plain", "sound", True) and fixed[4][1:] == ("sound", False) and fixed[5][1:] == ("sound", False)
    edits = spark.createDataFrame([(1, "c", "熟悉MATLAB"), (2, "c", f"岗{P}别的{J}负责一切"), (4, "c", " ")], "job long, claim string, new_text string")
    told = {r.job: (r.text, r.accepted, r.unsupported) for r in gate.edit_claims(claims, edits, evidence).collect()}
    assert told == {1: (f"感知岗{P}熟悉MATLAB", True, []), 2: (f"岗{P}别的{J}负责一切", False, ["负责一切"]), 4: ("", False, [])}


def sequential_definition(title, events, bodies):
    """The rule, one event after the other. bodies: id to body of evidence that isn't retracted."""
    snippets, sources = [], set()
    for _, _, _, review, excerpt, cited in sorted(events, key=lambda e: (e[2], e[1])):
        raw = (excerpt or "").strip()
        cited = [s for s in cited or [] if s in bodies]
        if review not in definitions.APPROVED or not raw or not cited:
            continue
        chosen, found = "", set()
        if not any(bodies[s] for s in cited):
            chosen, found = " ".join(raw.split()), set(cited)
        for text in (raw, " ".join(raw.split())):
            if not chosen and any(text in bodies[s] for s in cited):
                chosen, found = text, {s for s in cited if text in bodies[s]}
        if chosen:
            snippets.append(chosen[:120])
            sources |= found
        if len(sources) >= 2 and len(snippets) >= 2:
            break
    return (f"{title}{P}{J.join(dict.fromkeys(snippets[:3]))}"[:360], sorted(sources)) if len(sources) >= 2 else None


def test_definitions_equal_the_sequential_rule(spark):
    draw = random.Random(4)
    pieces = ["alpha beta", "gamma", "delta  epsilon", "zeta　eta", "theta " * 30]
    jobs, events, evidence, want = [], [], [], {}
    for job in range(120):
        bodies = {f"e{k}": " | ".join(draw.sample(pieces, 3)) if draw.random() < 0.8 else "" for k in range(draw.randint(2, 4))}
        gone = {k for k in bodies if draw.random() < 0.1}
        own = []
        for i in range(draw.randint(0, 14)):
            text = draw.choice([*pieces, " gamma\n", "alpha   beta", "paraphrase", None, " "])
            cited = [draw.choice(["e0", "e1", "e2", "e3", "nowhere"]) for _ in range(draw.randint(0, 4))]
            own.append((job, i, draw.randint(0, 3), draw.choice(["approved", "auto_passed", "pending", "rejected"]) if draw.random() < 0.5 else "approved", text, cited))
        jobs.append((job, f"job {job}"))
        events += own
        evidence += [(job, k, b, k in gone) for k, b in bodies.items()]
        found = sequential_definition(f"job {job}", own, {k: b for k, b in bodies.items() if k not in gone})
        if found:
            want[job] = found
    frames = [spark.createDataFrame(x, s) for x, s in ((jobs, "job long, title string"), (events, EVENTS), (evidence, EVIDENCE))]
    got = definitions.assemble_definitions(*frames).collect()
    assert {r.job: (r.text, r.sources) for r in got} == want and len(want) > 15
    assert definitions.assemble_definitions(*(f.limit(0) for f in frames)).collect() == []


def test_definitions_pass_the_gate_and_spare_corrected_ones(spark):
    bodies = [(1, "e1", "2、熟悉C/C++软件开发与调试，熟悉MATLAB", False), (1, "e2", "3、预测模块（行为预测、轨迹预测等）、决策规划模块的设计与开发；熟悉C/C++软件开发与调试", False)]
    events = [(1, 1, 1, "approved", "参与预测模块（行为预测、轨迹预测等）的设计与开发", ["e1", "e2"]), (1, 2, 2, "approved", "熟悉C/C++软件开发与调试", ["e1", "e2"]), (1, 3, 3, "approved", "熟悉MATLAB", ["e1", "e2"])]
    evidence, jobs = spark.createDataFrame(bodies, EVIDENCE), spark.createDataFrame([(1, "感知岗")], "job long, title string")
    claims = definitions.assemble_definitions(jobs, spark.createDataFrame(events, EVENTS), evidence)
    assert [(r.text, r.sources) for r in claims.collect()] == [(f"感知岗{P}熟悉C/C++软件开发与调试{J}熟悉MATLAB", ["e1", "e2"])]
    assert gate.claim_issues(claims, evidence).collect() == []
    assert definitions.assemble_definitions(jobs, spark.createDataFrame(events[:1], EVENTS), evidence).collect() == []
    current = spark.createDataFrame([(1, "a", False), (2, "a", True), (3, "a", None), (3, "b", None)], "job long, claim string, corrected boolean")
    checked = spark.createDataFrame([(1, "a", True), (1, "a", False), (2, "a", False), (3, "a", True), (3, "b", True)], "job long, claim string, supported boolean")
    assert [r.job for r in definitions.replaceable(current, checked).collect()] == [1]


def formal(spark, rows, known, **caps):
    evidence = spark.createDataFrame([(r[0], s) for r in rows for s in known], "job long, id string")
    got = curate.formal_requirements(spark.createDataFrame(rows, ROWS), evidence, **caps).collect()
    return {(r.job, r.skill): (r.name, r.kind, r.group_id, r.min_required) for r in got}


def test_curation_cases(spark):
    rows = [
        (1, "python", "Python", "required", None, None, 0.9, ["a", "b"]), (1, "prompt-en", "Prompt  Engineering", "required", None, None, 0.9, ["a", "b", "c"]), (1, "prompt-zh", "提示词工程", "required", None, None, 0.8, ["a"]),
        (1, "gpt", "GPT", "required", None, None, 1.0, ["a", "b"]), (1, "team", "团队协作", "required", None, None, 1.0, ["a", "b"]), (1, "cv", "CV", "required", None, None, 0.7, ["a", "b"]), (1, "stale", "Rust", "required", None, None, 1.0, ["missing"]),
        (2, "bonus", "FastAPI", "bonus", None, None, 1.0, ["a", "b"]), (2, "required", "Python", "required", None, None, 0.5, ["a"]),
        (3, "python", "Python", "required", "g1", 2, 1.0, ["a"]), (3, "gpt", "GPT", "required", "g1", 2, 1.0, ["a"]),
    ]
    got = formal(spark, rows, "abc", required_cap=1, formal_cap=2)
    assert got[1, "prompt-en"] == ("提示词工程", "required", None, None) and got[1, "python"][1] == "bonus" and {k for k in got if k[0] == 1} == {(1, "prompt-en"), (1, "python")}
    assert got[2, "required"][1] == "required" and got[2, "bonus"][1] == "bonus" and got[3, "python"] == ("Python", "required", None, None)
    group = [(1, s, s, "required", "g1", 1, 1.0, list(n)) for s, n in (("python", "abcd"), ("ts", "ab"), ("go", "ab"))] + [(1, f"s{i}", f"skill {i}", "required", None, None, 1.0, list("abc")) for i in range(12)]
    got = formal(spark, group, "abcd")
    assert {k[1] for k, x in got.items() if x[2] == "g1"} == {"python", "ts", "go"} and {x[1] for x in got.values() if x[2]} == {"required"} and sum(x[1] == "bonus" for x in got.values()) == 1
    told = spark.createDataFrame([("GPT", "调用", ""), ("gpt", None, "fine-tune it"), ("GPT", "", ""), ("Rust", "部署", None), (None, None, None)], "name string, action string, context string")
    assert [r.x for r in told.select(curate.brand_action(F.col("name"), F.col("action"), F.col("context")).alias("x")).collect()] == ["API 集成", "模型微调", None, None, None]


def sequential_greedy(units, required_cap, formal_cap):
    """units: (unit, wants, cost) in order."""
    taken, left = {}, required_cap
    for unit, wants, cost in units:
        if wants and cost <= left:
            taken[unit], left = "required", left - cost
    left = formal_cap - (required_cap - left)
    for unit, _, cost in units:
        if unit not in taken and cost <= left:
            taken[unit], left = "bonus", left - cost
    return taken


@pytest.mark.parametrize(("required_cap", "formal_cap"), [(12, 24), (3, 5), (1, 2), (12, 12)])
def test_greedy_equals_the_walk_over_all_units(spark, required_cap, formal_cap):
    draw = random.Random(required_cap)
    by = {job: [(f"u{k}", int(draw.random() < 0.4), draw.choice([1, 1, 2, 3, 5, 9, 30])) for k in range(draw.choice([0, 3, 40, 400]))] for job in range(25)}
    rows = [(job, u, w, c, (-k, u)) for job, units in by.items() for k, (u, w, c) in enumerate(units)]
    units = spark.createDataFrame(rows, "job long, unit string, wants int, cost int, score struct<n: int, u: string>")
    got = {(r.job, r.unit): r.taken_as for r in curate.greedy(units, required_cap, formal_cap).collect()}
    assert got == {(job, u): x for job, units in by.items() for u, x in sequential_greedy(units, required_cap, formal_cap).items()}


def test_curating_twice_changes_nothing(spark):
    draw = random.Random(8)
    rows = [
        (job, f"s{k}", f"name {draw.randint(0, 60)}", draw.choice(["required", "bonus", None]), draw.choice([None, None, "g1", "g2", ""]), draw.choice([None, 1, 2, 9]), draw.choice([0.1, 0.5, None]), [f"e{draw.randint(0, 9)}" for _ in range(draw.randint(0, 4))])
        for job in range(6) for k in range(50)
    ]
    table = spark.createDataFrame(rows, ROWS)
    evidence = spark.createDataFrame([(job, f"e{k}") for job in range(6) for k in range(9)], "job long, id string")
    at = lambda day: spark.createDataFrame([(job, day) for job in range(6)], "job long, at string").withColumn("at", F.to_date("at"))
    chosen = curate.formal_requirements(table, evidence)
    start = table.limit(40).select("job", "skill", *curate.BUSINESS, F.to_date(F.lit("2024-01-01")).alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    state = curate.next_state(start, chosen, at("2024-02-01"))
    open_rows = state.filter("valid_to is null").drop("change")
    again = curate.formal_requirements(open_rows.join(table.select("job", "skill", "name", "confidence", "sources"), ["job", "skill"]).select(*table.columns), evidence)
    second = curate.next_state(state.drop("change"), again, at("2024-03-01"))
    assert {r.change for r in second.collect()} == {"kept", "past"}
    assert sorted(map(str, second.drop("change").collect())) == sorted(map(str, state.drop("change").collect()))
    assert {r.change for r in state.collect()} >= {"opened", "expired"}


def test_release_log_is_appended_and_detects_conflicts(spark, tmp_path):
    root = str(tmp_path / "releases")
    assert release.current_release(spark, root) is None and release.release_log(spark, root).collect() == []
    first = release.publish(spark, {"t": spark.range(3)}, root, "p1", expected=0)
    pinned = release.read_release(spark, root, "t")
    second = release.publish(spark, {"t": spark.range(5)}, root, "p2")
    assert first != second and pinned.count() == 3 and release.read_release(spark, root, "t").count() == 5
    with pytest.raises(release.ReleaseConflict):
        release.publish(spark, {"t": spark.range(6)}, root, "p3", expected=1)
    assert release.current_release(spark, root) == second
    assert release.rollback(spark, root, first, expected=2) == 3 and release.read_release(spark, root, "t").count() == 3
    assert release.publish(spark, {"t": spark.range(5)}, root, "p2") == second and release.current_release(spark, root) == second
    assert [(r.seq, r.release_id, r.action) for r in release.release_log(spark, root).orderBy("seq").collect()] == [(1, first, "publish"), (2, second, "publish"), (3, first, "rollback"), (4, second, "publish")]
    # a writer that died before it wrote its line leaves an empty entry: readers still find a release, the next number is free
    (tmp_path / "releases" / "pointer" / f"{5:012d}").touch()
    assert release.current_release(spark, root) == second and release.point(spark, root, first) == 6 and release.current_release(spark, root) == first
    with pytest.raises(ValueError, match="no release"):
        release.rollback(spark, root, "unknown")


def test_two_writers_cannot_take_one_entry(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "releases")
    release.point(spark, root, "a")
    real = release._path

    def late(s, uri):
        if uri.endswith(f"{2:012d}"):  # another writer takes the number between the listing and the entry
            (tmp_path / "releases" / "pointer" / f"{2:012d}").write_text('{"seq": 2, "release_id": "b", "action": "publish"}\n')
        return real(s, uri)

    monkeypatch.setattr(release, "_path", late)
    with pytest.raises(release.ReleaseConflict):
        release.point(spark, root, "c")
    assert release.current_release(spark, root) == "b"
