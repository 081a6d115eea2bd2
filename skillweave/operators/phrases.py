"""Names of a vocabulary in whole texts, by one automaton of all names that runs over each text in Arrow batches.

Names may hold blanks, full stops, signs and ideographs. A task gets at most ``BOUND`` names; a larger vocabulary is cut by hash, and each part
is a pass over the texts that is written before the next part is read. Null texts hold nothing; null or empty names are found nowhere.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.shared import saved

BOUND = 262_144
#: Characters of copied texts, and rows, that leave a task at once.
PIECE, PIECE_ROWS = 4_000_000, 10_000
# Typographic signs and what they stand for.
SIGNS = str.maketrans({"，": ",", "。": ".", "：": ":", "；": ";", "（": "(", "）": ")", "／": "/"})
WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789_")


def folded(text: str) -> str:
    """Compatibility forms composed, case folded."""
    return unicodedata.normalize("NFKC", text).casefold()


def plain_surface(text: str | None) -> str:
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text or "").translate(SIGNS).strip()).casefold()


@F.pandas_udf(T.StringType())
def surface(names: pd.Series) -> pd.Series:
    """A name's form for comparison: compatibility forms composed, signs mapped, white space collapsed, case folded; null is empty."""
    return names.map(plain_surface)


@F.pandas_udf(T.StringType())
def form(names: pd.Series) -> pd.Series:
    """A name as texts are searched for it: folded and trimmed; null is empty."""
    return names.map(lambda x: folded(x or "").strip())


def lowered(text: str) -> str:
    return text.lower()


def ideographic(name: str) -> bool:
    return any("一" <= c <= "鿿" for c in name)


def automaton(forms: list[str]):
    """An automaton whose hits carry the place in forms and the form's length."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for k, form in enumerate(forms):
        machine.add_word(form, (k, len(form), ideographic(form)))
    machine.make_automaton()
    return machine


def places(machine, blob: str, bounded: bool = True) -> dict[int, list[int]]:
    """Per form found its first place and number of places; names without ideographs stand between word bounds if asked for."""
    found: dict[int, list[int]] = {}
    for end, (k, size, free) in machine.iter(blob):
        start = end - size + 1
        if bounded and not free and ((start and blob[start - 1] in WORD) or (end + 1 < len(blob) and blob[end + 1] in WORD)):
            continue
        if k in found:
            found[k][1] += 1
        else:
            found[k] = [start, 1]
    return found


def find(texts: DataFrame, names: DataFrame, fold=folded, bounded: bool = True, bound: int = BOUND, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """A row per text and name that it holds: the columns ``keep`` of texts(text, ...), those of names(name, ...), ``first`` place and number ``n``
    of places in the folded text. Columns of both carry different names; equal names of several rows are all found. A text is copied to its rows only
    if it is kept, and rows leave the task in pieces of bounded size."""
    size = names.count()
    kept = [texts.schema[c] for c in keep]
    schema = T.StructType([*kept, *names.schema.fields, T.StructField("first", T.IntegerType()), T.StructField("n", T.IntegerType())])
    arrow, source = to_arrow_schema(schema), texts.select(*{*keep, "text"})
    parts = max(1, -(-size // bound))
    cut = names.withColumn("__part", F.pmod(F.xxhash64("name"), F.lit(parts)).cast("int"))
    out = None
    for part in range(parts):
        rows: dict[str, list[tuple]] = {}
        for r in cut.filter(F.col("__part") == part).drop("__part").distinct().collect():
            form = fold(r["name"] or "")
            if form:
                rows.setdefault(form, []).append(tuple(r))
        forms = sorted(rows)

        def scan(batches, forms=forms, rows=rows):
            machine = automaton(forms) if forms else None

            def piece(batch, at, got):
                own = batch.select(list(keep)).take(pa.array(at, pa.int64())).columns
                rest = [pa.array([r[i] for r in got], t.type) for i, t in enumerate(list(arrow)[len(keep) :])]
                return pa.RecordBatch.from_arrays([c.cast(t.type) for c, t in zip(own, arrow, strict=False)] + rest, schema=arrow)

            for batch in batches:
                column, at, got, weight = batch.column("text"), [], [], 0
                for i in range(batch.num_rows if machine else 0):
                    text = column[i].as_py()
                    for k, (first, n) in sorted(places(machine, fold(text), bounded).items()) if text else ():
                        for name in rows[forms[k]]:
                            at.append(i)
                            got.append((*name, first, n))
                            weight += len(text) if "text" in keep else 1
                            if weight >= PIECE or len(at) >= PIECE_ROWS:
                                yield piece(batch, at, got)
                                at, got, weight = [], [], 0
                if at:
                    yield piece(batch, at, got)
                pa.default_memory_pool().release_unused()

        each = source.mapInArrow(scan, schema)
        each = saved(each, "phrases") if parts > 1 else each
        out = each if out is None else out.unionByName(each)
    return out


def mentions(texts: DataFrame, vocabulary: DataFrame, bound: int = BOUND) -> DataFrame:
    """id, skill, n, first of texts(id, text) that hold a name or synonym of vocabulary(skill, name, synonyms): its places in all forms, the first one."""
    every = vocabulary.select("skill", F.explode(F.concat(F.array("name"), F.coalesce("synonyms", F.array().cast("array<string>")))).alias("name"))
    forms = every.select("skill", form(F.col("name")).alias("name")).filter("name <> ''").distinct()
    rows = find(texts.select("id", "text"), forms, bound=bound)
    return rows.groupBy("id", "skill").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def longest_contained(titles: DataFrame, names: DataFrame, bound: int = BOUND) -> DataFrame:
    """id, target: the longest of names(name, ord) that a title of titles(id, title) contains anywhere, whatever its case; of equals the least ord."""
    rows = find(titles.select("id", F.col("title").alias("text")), names.select("name", "ord"), bounded=False, bound=bound)
    return rows.groupBy("id").agg(F.min(F.struct((-F.length("name")).alias("size"), "ord", "name")).alias("m")).select("id", F.col("m.name").alias("target"))
