"""Rules on profile texts, intake and curation, with the values that they give."""

import pytest
from pyspark.sql import functions as F

from skillweave.operators import curation as c
from skillweave.operators import profiles as p


def test_names_in_texts(spark):
    rows = [("Python", "I know PYTHON well", True), ("Java", "JavaScript only", False), ("C++", "modern c++ code", True), ("C", "modern c++ code", True), ("算法", "熟悉AI算法设计", True), ("", "x", False), ("node.js", "nodexjs", False), ("go", "go_lang", False)]
    got = spark.createDataFrame(rows, "name string, text string, want boolean").select("name", "want", p.name_in_text(F.col("name"), F.col("text")).alias("got")).collect()
    assert [(r["name"], r["got"]) for r in got] == [(n, w) for n, _, w in rows]


def test_surfaces_marks_and_fields(spark):
    row = spark.createDataFrame([("精通Python, able Java", "5 年经验，硕士学历", "3 years, PhD")], "a string, b string, c string")
    got = row.select(
        *[p.usable_surface(F.lit(x)).alias(f"u{i}") for i, x in enumerate(["C", "C+", "Go", "算法", "机器学习"])],
        p.marks_level(F.col("a"), F.lit("Python")).alias("m1"), p.marks_level(F.col("a"), F.lit("Java")).alias("m2"), p.marks_level(F.col("b"), F.lit("Java")).alias("m3"), p.fields(F.col("b")).alias("f"), p.fields(F.col("c")).alias("g"),
    ).first()
    assert [got[f"u{i}"] for i in range(5)] == [False, True, True, False, True]
    assert (got["m1"], got["m2"], got["m3"]) == (True, True, False)
    assert tuple(got["f"]) == ("5年", "硕士学历") and tuple(got["g"]) == ("3年", "PhD")


def test_strongest_sentence_merge_and_grounding(spark):
    texts = spark.createDataFrame([(1, "Knows Python. Built a Python project, cut cost 30%\nPython again"), (2, None), (3, "nothing here")], "id long, text string")
    vocab = spark.createDataFrame([("py", "Python", ["snake"], 1), ("c", "C", [], 2)], "skill string, name string, synonyms array<string>, ord long")
    found = p.fragments(p.named_sentences(texts, vocab))
    assert [(r["id"], r["skill"], r["text"], r["level"], r["section"]) for r in found.collect()] == [(1, "py", "Built a Python project, cut cost 30%", "result", "project")]
    make = lambda rows: spark.createDataFrame(rows, "id long, skill string, name string, ord int")
    merged = p.merged_skills(make([(1, "py", "Python", 0)]), make([(1, "py", "snake", 0), (1, "go", "Go", 1)]))
    assert {(r["skill"], r["name"], r["turn"]) for r in merged.collect()} == {("py", "Python", 0), ("go", "Go", 1)}
    assert [r["skill"] for r in p.grounded(merged, found).collect()] == ["py"]
    edits = spark.createDataFrame([(1, "py", 2), (1, "py", 1), (1, "go", 0)], "id long, skill string, level int")
    shown = spark.createDataFrame([(1, "py", 1)], "id long, skill string, level int")
    assert {(r["skill"], r["level"], r["verdict"]) for r in p.corrections(edits, shown).collect()} == {("py", 2, "above what is shown"), ("py", 1, "accepted"), ("go", 0, "not in the text")}


def test_rewrites_put_required_and_weak_ones_first(spark):
    rows = [(1, 1, "a", "s1", 2, True), (1, 1, "b", "s2", 0, False), (1, 1, "c", "s3", 0, True), (1, 1, "d", "s3", 1, True), (1, 1, "e", " ", 0, True)]
    df = spark.createDataFrame(rows, "resume long, job long, skill string, text string, level int, required boolean")
    assert [r["text"] for r in p.rewrites(df, 2).orderBy("place").collect()] == ["s3", "s1"]


@pytest.mark.parametrize(("title", "keep"), [("算法工程师", True), ("算法实习生", False), ("AI", False), (None, False)])
def test_titles(spark, title, keep):
    assert spark.createDataFrame([(title,)], "t string").select(c.keep_title(F.col("t"), F.lit(True)).alias("x")).first()["x"] is keep


def test_intake_expiry_and_clusters(spark):
    rows = [(1, "f", True, "b", 2), (2, "f", True, "b", 1), (3, "g", False, "b", 3), (4, "g", True, " ", 4), (5, "h", None, "b", 5)]
    got = c.intake(spark.createDataFrame(rows, "id long, fingerprint string, title_ok boolean, body string, ord long"))
    assert {r["id"]: r["decision"] for r in got.collect()} == {1: "repeat", 2: "ingested", 3: "title", 4: "empty", 5: "title"}
    day = lambda s: F.to_date(F.lit(s))
    versions = spark.createDataFrame([(1, 1), (1, 2)], "job long, skill long").select("job", "skill", day("2024-01-01").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    orders = spark.createDataFrame([(1, 1)], "job long, skill long").withColumn("at", day("2024-02-01"))
    assert {(r["skill"], r["closed"], str(r["valid_to"])) for r in c.expire(versions, orders).collect()} == {(1, True, "2024-02-01"), (2, False, "None")}
    titles = spark.createDataFrame([(i, t) for i, t in enumerate("aaabbbccd")], "id long, title string")
    labels = spark.createDataFrame([("a", "alias", "z"), ("b", "noise", None), ("c", "new", None), ("d", "new", None)], "title string, label string, target string")
    assert {(r["job"], r["size"]) for r in c.merge_clusters(titles, labels).collect()} == {("z", 3)}


def test_words_of_any_script_bound_marks_and_fields(spark):
    """An ideograph is a letter: it neither bounds a number nor lies in the gap between a mark and a name."""
    rows = spark.createDataFrame([("熟练掌握数据分析和Python",), ("了解业务，负责SQL",), ("熟练掌握　Python",), ("精通 (Python)",), ("able to use Python",), ("proficient: Python",)], "t string")
    assert [r.m for r in rows.select(p.marks_level(F.col("t"), F.when(F.contains("t", F.lit("SQL")), "SQL").otherwise("Python")).alias("m")).collect()] == [False, False, True, True, False, True]
    told = spark.createDataFrame([("经验3年",), ("经验 3　年",), ("5 years experience, PhD",), ("xMaster",), ("硕士学位",), ("他是Master",), (None,)], "t string")
    assert [tuple(r.f) for r in told.select(p.fields(F.col("t")).alias("f")).collect()] == [("", ""), ("3年", ""), ("5年", "PhD"), ("", ""), ("", "硕士学位"), ("", ""), ("", "")]


def test_white_space_of_any_kind_is_blank(spark):
    from skillweave.functions import text
    from skillweave.operators import curation

    rows = spark.createDataFrame([(1, "a", True, " \n\t\r　\xa0", 1), (2, "b", True, "　x\n", 2)], "id int, fingerprint string, title_ok boolean, body string, ord int")
    assert {r.id: r.decision for r in curation.intake(rows).collect()} == {1: "empty", 2: "ingested"}
    assert rows.select(text.squash(F.lit("公 司　甲\xa0")).alias("x")).first().x == "公司甲"
