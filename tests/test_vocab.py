"""Vocabulary phrases, alignment, leader clusters and stated dates against sequential versions and known values."""

import itertools
import random

import numpy as np
import pytest

from skillweave.functions import text as t
from skillweave.operators import phrases, timeline, vectors

TEXTS = [
    (1, "Built on Node.js and .NET. Modern C++ and C#"), (2, "熟悉AI算法设计，使用Ｐｙｔｈｏｎ与向量数据库"), (3, "nodexjs, go_lang, JavaScript and aC++"),
    (4, None), (5, ""), (6, "prompt\nengineering; PROMPT ENGINEERING, prompt engineering"), (7, "STRASSE, Straße"),
]
VOCAB = [
    ("node", "Node.js", None), ("net", ".NET", []), ("cpp", "C++", None), ("py", "Python", ["snake"]), ("algo", "算法", []), ("vec", "Vector DB", ["向量数据库"]),
    ("java", "Java", None), ("go", "Go", None), ("pe", "Prompt Engineering", ["prompt engineering"]), ("st", "Straße", None), ("none", None, ["", " "]),
]


def found(spark, **options):
    texts = spark.createDataFrame(TEXTS, "id long, text string")
    vocab = spark.createDataFrame(VOCAB, "skill string, name string, synonyms array<string>")
    return {(r["id"], r["skill"]): (r["n"], r["first"]) for r in phrases.mentions(texts, vocab, **options).collect()}


def test_names_in_whole_texts(spark):
    want = {(1, "node"): (1, 9), (1, "net"): (1, 21), (1, "cpp"): (1, 34), (2, "algo"): (1, 4), (2, "py"): (1, 11), (2, "vec"): (1, 18), (6, "pe"): (2, 20), (7, "st"): (2, 0)}
    assert found(spark) == want
    assert found(spark, bound=2) == want


def test_empty_texts_and_vocabularies(spark):
    none = spark.createDataFrame([], "skill string, name string, synonyms array<string>")
    texts = spark.createDataFrame(TEXTS, "id long, text string")
    assert phrases.mentions(texts, none).count() == 0
    assert phrases.mentions(texts.limit(0), spark.createDataFrame(VOCAB, none.schema)).count() == 0


def test_longest_contained_name(spark):
    titles = spark.createDataFrame([(1, "Senior AI算法工程师"), (2, "dataengineer"), (3, "cook"), (4, None)], "id long, title string")
    names = spark.createDataFrame([("算法", 1), ("算法工程师", 2), ("Data", 4), ("Engine", 3), ("gineer", 2)], "name string, ord int")
    assert {tuple(r) for r in phrases.longest_contained(titles, names).collect()} == {(1, "算法工程师"), (2, "gineer")}


def test_surfaces_compose_compatibility_forms(spark):
    rows = spark.createDataFrame([("  Ｃ＋＋　（New）：ｘ ",), (None,), ("ﬁne\t\nTUNE",)], "name string")
    assert [r[0] for r in rows.select(phrases.surface("name")).collect()] == ["c++ (new):x", "", "fine tune"]


def sequential(rows, threshold):
    """Leaders as one pass over the rows finds them."""
    leaders, out = [], {}
    for id, _, vector in sorted(rows, key=lambda r: (r[1], r[0])):
        x = None if vector is None else np.array([np.nan if c is None else c for c in vector])
        if x is None or not np.isfinite(x).all() or not x.any():
            out[id] = id
            continue
        x = x / np.linalg.norm(x)
        hit = next((k for k, y in leaders if y @ x >= threshold), None)
        if hit is None:
            leaders.append((id, x))
        out[id] = id if hit is None else hit
    return out


@pytest.mark.parametrize(("block", "threshold"), [(4, 0.8), (7, 0.95), (1000, 0.8), (5, 1.0)])
def test_leaders_equal_one_pass(spark, block, threshold):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(9, 6))
    rows = [(k, int(rng.integers(0, 40)), (centres[k % 9] + rng.normal(size=6) * 0.35).tolist()) for k in range(70)]
    rows += [(100 + k, int(rng.integers(0, 40)), rows[3][2]) for k in range(30)]
    rows += [(200, 1, None), (201, 2, [0.0] * 6), (202, 3, [float("nan")] * 6), (203, 4, [None] * 6), (204, 5, [0.0] * 6)]
    got = vectors.leader_clusters(spark.createDataFrame(rows, "id long, ord long, vector array<double>"), threshold, block)
    if threshold < 1:
        assert {r["id"]: r["leader"] for r in got.collect()} == sequential(rows, threshold)
    else:
        assert got.select("id").distinct().count() == got.count() == len(rows)
    assert vectors.leader_clusters(got.selectExpr("id", "id ord", "array(1.0D) vector").limit(0), threshold, block).count() == 0


def test_nearest_in_a_grid_equals_one_block(spark):
    rng = np.random.default_rng(6)
    known = [(f"s{k}", k, rng.normal(size=5).tolist(), f"n{k % 7}") for k in range(40)]
    known += [("twin", 99, known[3][2], "twin"), ("void", 100, None, "void")]
    rows = [(k, rng.normal(size=5).tolist(), f"m{k % 5}") for k in range(60)] + [(98, known[3][2], "x"), (99, None, "x")]
    vocab = spark.createDataFrame(known, "skill string, ord long, skill_vector array<double>, name string")
    queries = spark.createDataFrame(rows, "id long, vector array<double>, name string")
    bans = [("m1", "n2"), ("n3", "m1"), ("m4", "n0")]
    pick = lambda block: {r["id"]: (r["skill"], round(r["sim"], 9)) for r in vectors.nearest(queries, vocab, bans, block).collect()}
    unit = lambda x: np.array(x) / np.linalg.norm(x)
    want = {}
    for id, x, name in rows[:-1]:
        open_to = [(float(unit(y) @ unit(x)), -o, s) for s, o, y, other in known if y and (name, other) not in bans and (other, name) not in bans]
        best = max((round(a, 9), b, c) for a, b, c in open_to)
        want[id] = (best[2], best[0])
    got = pick(vectors.BLOCK)
    assert {k: v for k, v in got.items() if k != 99} == want
    assert got[98][0] == "s3" and got[99] == ("s0", 0.0)
    assert pick(9) == got
    assert {(r["skill"], r["sim"]) for r in vectors.nearest(queries, vocab.limit(0)).collect()} == {(None, None)}
    every = [("x", f"n{k}") for k in range(7)] + [("x", "twin"), ("x", "void")]
    assert [r["skill"] for r in vectors.nearest(queries.filter("name = 'x'"), vocab, every, 9).collect()] == [None, None]


def test_rows_align_by_name_then_by_vector(spark):
    vocab = spark.createDataFrame(
        [("lc", "LangChain", [], 1, [1.0, 0.0]), ("lg", "LangGraph", None, 2, [0.8, 0.6]), ("pe", "提示词工程", None, 3, [0.0, 1.0])],
        "skill string, name string, synonyms array<string>, ord int, skill_vector array<double>",
    )
    rows = [
        (1, "ｌａｎｇchain ", [0.0, 1.0], False), (2, "Prompt  Engineering", [1.0, 0.0], None), (3, "chains", [1.0, 0.1], False), (4, "chains", [-1.0, 0.0], False),
        (5, "LangChain", [1.0, 0.0], True), (6, " ", [1.0, 0.0], False), (7, None, [1.0, 0.0], False), (8, "graphs", None, False),
    ]
    got = vectors.align_rows(spark.createDataFrame(rows, "id long, name string, vector array<double>, candidate boolean"), vocab)
    assert {r["id"]: (r["skill"], r["how"]) for r in got.collect()} == {1: ("lc", "exact"), 2: ("pe", "exact"), 3: ("lc", "similar"), 4: (None, None), 5: (None, None), 6: (None, None), 7: (None, None), 8: (None, None)}
    less = vocab.filter("skill <> 'lc'")
    alone = vectors.align_rows(spark.createDataFrame([(1, "langchain", [0.8, 0.6], False)], "id long, name string, vector array<double>, candidate boolean"), less)
    assert [(r["skill"], r["how"]) for r in alone.collect()] == [(None, None)]


def test_conflicts_equal_pairs(spark):
    rng = random.Random(7)
    rows = [(g, k, f"r{g}.{k}", a, a + rng.randint(-2, 6)) for g in range(5) for k, a in enumerate(rng.randint(0, 30) for _ in range(g * 6))]
    rows += [(9, 0, "x", None, 5), (9, 1, "y", 3, None)]
    got = {(r["id"], r["place"]): (r["reason"], r["n"], r["other"]) for r in timeline.conflicts(spark.createDataFrame(rows, "id long, place int, text string, first int, last int")).collect()}
    want = {}
    whole = [r for r in rows if None not in r]
    for g, k, _, a, b in whole:
        if b < a:
            want[g, k] = ("reversed", 0, None)
        elif over := [o for o in whole if o[0] == g and o[4] >= o[3] and (o[3], o[1]) < (a, k) and o[4] >= a]:
            want[g, k] = ("overlap", len(over), max(over, key=lambda o: (o[4], -o[1]))[2])
    assert got == want
    pairs = [1 for x, y in itertools.combinations([r for r in whole if r[4] >= r[3]], 2) if x[0] == y[0] and max(x[3], y[3]) <= min(x[4], y[4])]
    assert sum(n for _, n, _ in got.values()) == len(pairs)


def test_ranges_stated_in_a_text(spark):
    texts = spark.createDataFrame([(1, "2020.01 - 2021.03 A, 2021/02-2022/01 B, 2023-05~2022-01"), (2, None), (3, "no dates 1999.01 - 1999.02")], "id long, text string")
    got = timeline.conflicts(timeline.stated(texts)).orderBy("place").collect()
    assert [(r["text"], r["reason"], r["n"], r["other"]) for r in got] == [("2021/02-2022/01", "overlap", 1, "2020.01 - 2021.03"), ("2023-05~2022-01", "reversed", 0, None)]
    assert texts.select(t.month_ranges("text")).count() == 3
