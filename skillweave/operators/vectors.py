"""Vectors held against a stated set in blocks: the nearest of a vocabulary, alignment exact before similar, leaders and their clusters.

No table of pairs exists. A block of rows meets a block of the set as one matrix product inside a task, and each row keeps a single answer.
A vector that is null, zero, of another length than the set's or with a null or non-finite component is like nothing (similarity 0).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import saved
from . import phrases

#: Rows of the set that one task holds, and rows of a table per matrix product.
BLOCK, SLICE = 4096, 1024
# Names that never align by likeness.
FORBIDDEN = [("langchain", "langgraph"), ("gpt", "gemini"), ("rag", "向量数据库"), ("pytorch", "tensorflow")]
# Names that stand for each other.
APPROVED = {"prompt engineering": "提示词工程", "提示词工程": "prompt engineering"}


def units(vectors, width: int) -> np.ndarray:
    """Vectors as rows of length 1, unusable ones as zeros."""
    out = np.zeros((len(vectors), width))
    for i, x in enumerate(vectors):
        if x is not None and len(x) == width:
            out[i] = np.asarray(x, dtype=float)
    out[~np.isfinite(out).all(axis=1)] = 0
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def width_of(vectors) -> int:
    return max((len(x) for x in vectors if x is not None), default=0)


def best_of(frame: pd.DataFrame, known: pd.DataFrame, banned: dict[str, set[str]]) -> pd.DataFrame:
    """Of known, sorted by ord, the first most similar row for each row of frame; pairs of names in banned are passed over."""
    if known.empty:
        return pd.DataFrame({"id": frame["id"], "skill": None, "ord": None, "sim": None})
    width = width_of(known["skill_vector"])
    table = units(known["skill_vector"], width)
    columns = {n: [k for k, other in enumerate(known["name"]) if other in others] for n, others in banned.items()}
    rows = units(frame["vector"], width)
    at, sim = np.zeros(len(frame), dtype=int), np.zeros(len(frame))
    for lo in range(0, len(frame), SLICE):
        sims = rows[lo : lo + SLICE] @ table.T
        for k, name in enumerate(frame["name"].iloc[lo : lo + SLICE]):
            if columns.get(name):
                sims[k, columns[name]] = -np.inf
        at[lo : lo + SLICE], sim[lo : lo + SLICE] = sims.argmax(axis=1), sims.max(axis=1)
    none = np.isneginf(sim)
    pick = lambda c: known[c].astype(object).iloc[at].where(~none, None).to_numpy()
    return pd.DataFrame({"id": frame["id"].to_numpy(), "skill": pick("skill"), "ord": pick("ord"), "sim": np.where(none, np.nan, sim)})


def nearest(queries: DataFrame, vocabulary: DataFrame, forbidden: list[tuple[str, str]] = (), block: int = BLOCK) -> DataFrame:
    """id, skill, sim: the most similar vocabulary vector of each query, the earliest by ord of equals.

    queries(id, vector[, name]) have distinct ids; vocabulary(skill, ord, skill_vector[, name]) is a stated set without nulls in skill and ord. Up to ``block`` rows of it go to
    the tasks as they are; a larger one is cut into blocks that meet blocks of queries in a grid, and the best of each row's blocks wins.
    Without a vocabulary, or where all of it is forbidden, skill and sim are null.
    """
    banned: dict[str, set[str]] = {}
    for a, b in forbidden:
        banned.setdefault(a, set()).add(b)
        banned.setdefault(b, set()).add(a)
    named = lambda df: df if "name" in df.columns else df.withColumn("name", F.lit(None).cast("string"))
    rows, known = named(queries).select("id", "vector", "name"), named(vocabulary).select("skill", F.col("ord").cast("double").alias("ord"), "skill_vector", "name")
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("skill", known.schema["skill"].dataType), T.StructField("ord", T.DoubleType()), T.StructField("sim", T.DoubleType())])
    size = known.count()
    if size <= block:
        held = pd.DataFrame([tuple(r) for r in known.orderBy("ord", "skill").collect()], columns=known.columns)

        def against(frames):
            for frame in frames:
                yield best_of(frame, held, banned)

        return rows.mapInPandas(against, schema).select("id", "skill", "sim")
    parts, groups = -(-size // block), max(1, -(-rows.count() // (16 * block)))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("row_part", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")).withColumn("set_part", numbers(parts))
    right = known.withColumn("set_part", F.pmod(F.xxhash64("skill", "ord"), F.lit(parts)).cast("int")).withColumn("row_part", numbers(groups))

    def cell(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return best_of(a, b.sort_values(["ord", "skill"]).reset_index(drop=True), banned)

    found = left.groupBy("row_part", "set_part").cogroup(right.groupBy("row_part", "set_part")).applyInPandas(cell, schema)
    key = F.struct(F.col("skill").isNotNull().alias("any"), F.coalesce("sim", F.lit(0.0)).alias("sim"), (-F.col("ord")).alias("back"))
    best = found.groupBy("id").agg(F.max_by(F.struct("skill", "sim"), key).alias("best"))
    return best.select("id", F.col("best.skill").alias("skill"), F.col("best.sim").alias("sim"))


def align_rows(rows: DataFrame, vocabulary: DataFrame, threshold: float = 0.70, forbidden: list[tuple[str, str]] = FORBIDDEN, approved: dict[str, str] = APPROVED, block: int = BLOCK) -> DataFrame:
    """rows(id, name, vector, candidate) with the skill they stand for: id, skill, how, sim.

    ``exact``: the surface is a name or synonym of vocabulary(skill, name, synonyms, ord, skill_vector), or an approved word for one; the first by
    ord wins. ``similar``: else the nearest vector, unless the two names are forbidden as a pair or the likeness is below the threshold. Rows
    marked as alias candidates, and empty names, align with nothing.
    """
    spark = rows.sparkSession
    names = F.concat(F.array("name"), F.coalesce("synonyms", F.array().cast("array<string>")))
    forms = vocabulary.select("skill", "ord", F.explode(names).alias("form")).select("skill", "ord", phrases.surface(F.col("form")).alias("name")).filter("name <> ''")
    if approved:
        other = spark.createDataFrame(list(approved.items()), "name string, also string")
        forms = forms.unionByName(forms.join(other, "name").select("skill", "ord", phrases.surface(F.col("also")).alias("name")))
    first = forms.groupBy("name").agg(F.min_by("skill", F.struct("ord", "skill")).alias("exact"))
    keyed = rows.select("id", phrases.surface(F.col("name")).alias("name"), "vector", (F.coalesce("candidate", F.lit(False)) | (F.coalesce(F.trim("name"), F.lit("")) == "")).alias("out"))
    marked = keyed.join(first, "name", "left")
    rest = marked.filter("not out and exact is null")
    near = nearest(rest, vocabulary.withColumn("name", phrases.surface(F.col("name"))), forbidden, block).filter(F.col("sim") >= threshold)
    out = marked.filter("out or exact is not null").select("id", F.expr("if(out, null, exact)").alias("skill"), F.expr("if(out, null, 'exact')").alias("how"), F.lit(None).cast("double").alias("sim"))
    like = rest.select("id").join(near, "id", "left").select("id", "skill", F.when(F.col("skill").isNotNull(), "similar").alias("how"), "sim")
    return out.unionByName(like)


def usable(vector: Column) -> Column:
    """No null or non-finite component, and not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def leaders_in(table: np.ndarray, threshold: float) -> list[int]:
    """Rows that no earlier leader is similar to."""
    free, out = np.ones(len(table), dtype=bool), []
    for i in range(len(table)):
        if free[i]:
            out.append(i)
            free[i + 1 :] &= table[i + 1 :] @ table[i] < threshold
    return out


def leader_clusters(rows: DataFrame, threshold: float = 0.70, block: int = BLOCK) -> DataFrame:
    """id, leader of rows(id, ord, vector): in the order of (ord, id) a row joins the earliest leader at or over the threshold, else it leads.

    Exactly what one pass in order gives. Equal vectors are one class, as they share their leader. A round takes the first ``block`` classes left,
    finds the leaders among them, and holds all classes left against these; what joins or leads goes. As no class left is similar to an earlier
    leader, the next round starts from nothing. Rounds grow with leaders / block, rows written with classes x rounds; a cluster of any
    size is one row per class. Unusable vectors lead themselves alone. (id, ord) are distinct and not null; an empty table gives an empty one.
    """
    keyed = rows.select("id", "ord", "vector", usable(F.col("vector")).alias("ok"))
    first = F.min(F.struct("ord", "id"))
    left = saved(keyed.filter("ok").groupBy("vector").agg(first.alias("m")).select("vector", "m.ord", "m.id"), "leaders-classes")
    schema = T.StructType([*left.schema.fields, T.StructField("leader", left.schema["id"].dataType)])
    done = []
    while True:
        front = left.orderBy("ord", "id").limit(block).collect()
        if not front:
            break
        width = width_of([r["vector"] for r in front])
        table = units([r["vector"] for r in front], width)
        lead = leaders_in(table, threshold)
        names = np.array([front[k]["id"] for k in lead], dtype=object)
        table, own = table[lead], {(front[k]["ord"], front[k]["id"]): i for i, k in enumerate(lead)}

        def against(frames, table=table, names=names, own=own, width=width):
            for frame in frames:
                vectors, leader = units(frame["vector"], width), np.full(len(frame), None, dtype=object)
                for lo in range(0, len(frame), SLICE):
                    hit = vectors[lo : lo + SLICE] @ table.T >= threshold
                    some = np.flatnonzero(hit.any(axis=1))
                    leader[lo + some] = names[hit[some].argmax(axis=1)]
                for k, key in enumerate(zip(frame["ord"], frame["id"], strict=True)):
                    if key in own:
                        leader[k] = names[own[key]]
                yield frame.assign(leader=leader)

        seen = saved(left.mapInPandas(against, schema), "leaders-round")
        done.append(seen.filter("leader is not null").select("vector", "leader"))
        left = seen.filter("leader is null").drop("leader")
        if len(front) < block:
            break
    alone = keyed.filter("not ok").select("id", F.col("id").alias("leader"))
    for part in done:
        alone = alone.unionByName(keyed.filter("ok").join(part, "vector").select("id", "leader"))
    return alone


def clusters_of(rows: DataFrame, least: int = 3, threshold: float = 0.70, block: int = BLOCK) -> DataFrame:
    """leader, n of the clusters of at least ``least`` rows."""
    return leader_clusters(rows, threshold, block).groupBy("leader").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
