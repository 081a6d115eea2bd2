"""From the text of a profile to its skills: names in texts, levels, the strongest sentence per skill, fields, merging, grounding.

Names are found by one automaton that runs over each sentence in its place, so only sentences that hold a name become rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import evidence_level, sentences
from . import phrases

# Marks of proficiency, units of experience, degrees, what a project sentence says.
LEVEL_MARKS = "了解|熟练|精通|aware|able|expert|proficient"
# Words are letters, digits and the low line of any script, so an ideograph is no bound of a word.
NO_WORD, GAP = r"[^\p{L}\p{N}_]", r"[\s\p{Z}]*"
EXPERIENCE = rf"(?i)(?<![\p{{L}}\p{{N}}_])(\d+){GAP}(?:年|years?){GAP}(?:工作|经验|experience)?"
EDUCATION = r"(?i)(?<![\p{L}\p{N}_])(?:Bachelor|Master|PhD)(?![\p{L}\p{N}_])|(?:博士|硕士|本科|大专)(?:学历|学位)?"
PROJECT = "(?i)项目|project"
LEVELS = ("mention", "use", "result")


def quoted(name: Column) -> Column:
    """A pattern that the name alone matches."""
    return F.regexp_replace(name, r"([^\p{L}\p{N}_\s])", r"\\$1")


def name_in_text(name: Column, text: Column) -> Column:
    """Names with ideographs as a part of the text, others between word bounds; case doesn't count."""
    needle, low = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(text, F.lit("")))
    bounded = F.regexp_like(low, F.concat(F.lit("(?<![a-z0-9_])"), quoted(needle), F.lit("(?![a-z0-9_])")))
    return F.when(needle == "", False).when(needle.rlike("[一-鿿]"), F.contains(low, needle)).otherwise(bounded)


def usable_surface(name: Column) -> Column:
    """Two Latin letters in a row, a plus sign, or three characters."""
    text = F.trim(F.coalesce(name, F.lit("")))
    return latin_surface(text) | (F.length(text) >= 3)


def latin_surface(name: Column) -> Column:
    return name.rlike(r"[A-Za-z]{2,}|\+")


def marks_level(text: Column, name: Column) -> Column:
    """Whether a mark of proficiency stands right before the name."""
    return F.regexp_like(F.coalesce(text, F.lit("")), F.concat(F.lit(rf"(?i)(?:{LEVEL_MARKS}){GAP}(?:掌握|使用|过)?{NO_WORD}{{0,12}}"), quoted(name)))


def fields(text: Column) -> Column:
    """experience (years) and education as a text states them, else empty."""
    blob = F.coalesce(text, F.lit(""))
    years = F.regexp_extract(blob, EXPERIENCE, 1)
    return F.struct(F.when(years != "", F.concat(years, F.lit("年"))).otherwise("").alias("experience"), F.regexp_extract(blob, EDUCATION, 0).alias("education"))


def surfaces(vocabulary: DataFrame) -> DataFrame:
    """skill, pos, name of the usable names and synonyms of vocabulary(skill, name, synonyms, ord)."""
    return vocabulary.select("skill", F.posexplode(F.concat(F.array("name"), F.coalesce("synonyms", F.array().cast("array<string>")))).alias("pos", "name")).filter(usable_surface(F.col("name")))


def named_sentences(texts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """id, skill, pos, name, place, sentence: each sentence of texts(id, text) that holds a usable name.

    Sentences end at full stops, so names that hold one are found in whole texts alone (``phrases.mentions``)."""
    parts = texts.select("id", F.posexplode(sentences(F.col("text"))).alias("place", "text"))
    found = phrases.find(parts, surfaces(vocabulary), fold=phrases.lowered, keep=("id", "place", "text"))
    return found.select("id", "skill", "pos", "name", "place", F.col("text").alias("sentence"))


def fragments(named: DataFrame, result: str | None = None, use: str | None = None) -> DataFrame:
    """The strongest sentence per (id, skill): by level, then length, then place; with its level, section and a name that follows from its content."""
    options = {k: x for k, x in (("result", result), ("use", use)) if x}
    level = evidence_level(F.col("sentence"), **options)
    rank = F.when(level == "result", 2).when(level == "use", 1).otherwise(0)
    best = F.max(F.struct(rank.alias("rank"), F.length("sentence").alias("size"), (-F.col("place")).alias("back"), "sentence"))
    rows = named.groupBy("id", "skill").agg(best.alias("b"))
    text = F.col("b.sentence")
    return rows.select(
        "id", "skill", text.alias("text"), F.element_at(F.array(*map(F.lit, LEVELS)), F.col("b.rank") + 1).alias("level"),
        F.when(text.rlike(PROJECT), "project").otherwise("experience").alias("section"),
        F.concat(F.lit("resume-evidence-"), F.substring(F.sha2(F.concat_ws(":", F.col("skill").cast("string"), text), 256), 1, 16)).alias("fragment"),
    )


def merged_skills(primary: DataFrame, extra: DataFrame) -> DataFrame:
    """Of two tables (id, skill, name, ord) one row per id and skill: the primary one, else the first of extra."""
    both = primary.withColumn("turn", F.lit(0)).unionByName(extra.withColumn("turn", F.lit(1))).filter("skill is not null")
    return both.groupBy("id", "skill").agg(F.min(F.struct("turn", "ord", "name")).alias("m")).select("id", "skill", F.col("m.name").alias("name"), F.col("m.turn").alias("turn"))


def grounded(skills: DataFrame, found: DataFrame) -> DataFrame:
    """Skills that some fragment of the profile shows."""
    return skills.join(found.select("id", "skill").distinct(), ["id", "skill"], "left_semi")


def corrections(edits: DataFrame, shown: DataFrame) -> DataFrame:
    """edits(id, skill, level 0-2) with ``accepted``: the text shows the skill, and no lower than the edit says (shown: id, skill, level 0-2)."""
    own = shown.groupBy("id", "skill").agg(F.max("level").alias("shown"))
    reason = F.when(F.col("shown").isNull(), "not in the text").when(F.col("level") > F.col("shown"), "above what is shown").otherwise("accepted")
    return edits.join(own, ["id", "skill"], "left").withColumn("verdict", reason)


def rewrites(found: DataFrame, most: int = 5) -> DataFrame:
    """Of fragments(resume, job, skill, text, level 0-2, required) the sentences to rewrite: required first, then the weakest, distinct by text."""
    from pyspark.sql import Window

    once = found.filter("trim(text) <> ''").groupBy("resume", "job", "text").agg(F.min(F.struct((~F.col("required")).cast("int").alias("late"), "level", "skill")).alias("m"))
    w = Window.partitionBy("resume", "job").orderBy("m", "text")
    return once.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).select("resume", "job", "place", F.col("m.skill").alias("skill"), F.col("m.level").alias("level"), "text")
