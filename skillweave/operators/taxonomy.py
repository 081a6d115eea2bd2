"""Vocabulary: alignment of names to skills, mentions in texts, clusters of surfaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import vectors

# Full-width and typographic signs and what they stand for.
MARKS_FROM, MARKS_TO = "（）【】，。：；！？、“”‘’／　", "()[],.:;!?,\"\"''/ "


def surface(c: Column) -> Column:
    """A name's form for comparison: marks mapped, spaces collapsed, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), MARKS_FROM, MARKS_TO), r"\s+", " ")))


def forms(vocabulary: DataFrame) -> DataFrame:
    """surface, skill, ord of names and synonyms of vocabulary(skill, name, synonyms, ord)."""
    names = F.explode(F.concat(F.array("name"), F.coalesce("synonyms", F.array().cast("array<string>"))))
    return vocabulary.select("skill", "ord", names.alias("form")).select(surface(F.col("form")).alias("surface"), "skill", "ord")


def align_exact(mentions: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """mentions(mention, name) with the skill whose name or synonym it is; the first in vocabulary order wins."""
    first = forms(vocabulary).groupBy("surface").agg(F.min_by("skill", "ord").alias("skill"))
    return mentions.withColumn("surface", surface(F.col("name"))).join(first, "surface", "left")


def align_similar(queries: DataFrame, vocabulary: DataFrame, threshold: float = 0.70) -> DataFrame:
    """The most similar vocabulary vector (skill, vector, ord) of each query(id, vector) at or over the threshold; the earliest of equals.

    The vocabulary is a stated table (one row per skill) that every query is held against, in blocks of matrix products.
    """
    best = vectors.nearest(queries, vocabulary)
    return best.select("id", F.when(F.col("sim") >= threshold, F.col("skill")).alias("skill"), "sim")


def tokens(text: Column) -> Column:
    """Distinct lower-case words of letters and digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))


def mentions_of(texts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """id, skill of single-word vocabulary names in texts(id, text): an equi-join on tokens."""
    return texts.select("id", F.explode(tokens(F.col("text"))).alias("surface")).join(forms(vocabulary).select("surface", "skill").distinct(), "surface").select("id", "skill").distinct()


def split_composite(names: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Parts of names(mention, name) with a slash, if each part is an exact vocabulary hit; else the whole name."""
    known = forms(vocabulary).select("surface").distinct().withColumn("hit", F.lit(1))
    parts = names.select("mention", "name", F.posexplode(F.split("name", "/")).alias("pos", "part")).withColumn("surface", surface(F.col("part"))).join(known, "surface", "left")
    w = Window.partitionBy("mention")
    whole = F.min(F.coalesce("hit", F.lit(0))).over(w)
    rows = parts.withColumn("whole", whole).filter((F.col("whole") == 1) | (F.col("pos") == 0))
    return rows.select("mention", "pos", F.when(F.col("whole") == 1, F.trim("part")).otherwise(F.col("name")).alias("name"))


def surface_clusters(rows: DataFrame) -> DataFrame:
    """Names (name, ord) of one surface as a cluster, its longest as the centre, the first of equals."""
    return rows.groupBy(surface(F.col("name")).alias("surface")).agg(F.max_by("name", F.struct(F.length("name"), -F.col("ord"))).alias("centre"), F.countDistinct("name").alias("n_names"), F.count("*").alias("n"))


def longest_contained(titles: DataFrame, names: DataFrame) -> DataFrame:
    """The longest of names(name, ord), single words, that a title(id, title) contains."""
    words = titles.select("id", F.explode(tokens(F.col("title"))).alias("name"))
    return words.join(names, "name").groupBy("id").agg(F.max_by("name", F.struct(F.length("name"), -F.col("ord"))).alias("target"))
