"""Benchmark decontamination by winnowing.

Words are hashed into k-grams. Of every w consecutive k-grams of a text the one with the least hash is
kept, so two texts that share a span of at least k + w - 1 = ``window`` words keep a common
fingerprint inside it. Items shorter than the window are fingerprinted whole, by an n-gram of
their own length. A fixed-size bit set of the items' fingerprints lets each task drop nearly all of the
corpus's own; what remains joins the items' fingerprints on the hash, with the words around it, and
each hit is extended over both texts' words in both directions, word by word. Extended spans of at least the
window's length are the occurrences of windows, so the result is exact: hashes only find candidates.

Equal surroundings on the item side are one row with a list of items, so an item that is copied many
times costs no pairs. The bit set has at most MAX_BITS bits whatever the benchmark's size; when it
fills up, it lets more through and the join decides.

Defined results: null or empty text, or text without words, has no words and no hits; items without
words are never found; rows that repeat (doc_id too) each get their own row; an empty benchmark hits
nothing; windows of items with null item_id count in n_hit and contaminated, but the null id not in n_items and
the digest; other columns are ignored. item_ids are compared as strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .textscan import ALNUM, Words, mix, words

WINDOW = 10
K = 6
MAX_BITS = 1 << 26

HITS = "row long, doc_id long, n_words long, h long, size int, context string, at int"
MARKS = "item_id string, h long, size int, context string, at int"


def winnow(found: Words, k: int, w: int) -> np.ndarray:
    """Word numbers at which a k-gram is the least of some w consecutive ones of its document (the last of equals)."""
    hashes, inside = found.grams(k)
    n = len(hashes) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, arg = hashes[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, w):
        less = hashes[j : n + j] <= best
        best[less] = hashes[j : n + j][less]
        arg[less] = j
    whole = inside[:n] & inside[w - 1 :] & (np.repeat(np.arange(len(found.counts)), found.counts)[:n] == np.repeat(np.arange(len(found.counts)), found.counts)[w - 1 :])
    return np.unique((np.arange(n) + arg)[whole])


def surroundings(found: Words, doc: np.ndarray, at: np.ndarray, size: np.ndarray, window: int) -> tuple[list[str], np.ndarray]:
    """The words that any window around a fingerprint can reach, and the fingerprint's place in them."""
    reach = np.maximum(window - size, 0)
    a = np.maximum(found.first[doc], at - reach)
    b = np.minimum(found.first[doc + 1], at + size + reach)
    texts = [" ".join(found.data[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(found.start[x:y], found.end[x:y], strict=True)) for x, y in zip(a, b, strict=True)]
    return texts, at - a


def item_marks(items: DataFrame, window: int, k: int) -> DataFrame:
    """A row per fingerprint of items(item_id, text)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("item_id").to_pylist()
            for found in words(batch.column("text"), ALNUM):
                n = found.counts
                at = winnow(found, k, window - k + 1)
                doc = np.searchsorted(found.first, at, "right") - 1
                size = np.full(len(at), k)
                hashes = found.grams(k)[0][at]
                for length in np.unique(n[(n > 0) & (n < window)]):
                    short = np.flatnonzero(n == length)
                    doc, at = np.append(doc, short), np.append(at, found.first[short])
                    size = np.append(size, np.full(len(short), length))
                    hashes = np.append(hashes, found.grams(int(length))[0][found.first[short]])
                context, place = surroundings(found, doc, at, size, window)
                # a short item is one window of its own length, wherever it occurs
                own = [" ".join(c.split(" ")[p : p + s]) if n[d] < window else c for c, p, s, d in zip(context, place, size, doc, strict=True)]
                yield pa.RecordBatch.from_pydict({
                    "item_id": pa.array([names[found.row + d] for d in doc], pa.string()),
                    "h": mix(hashes + size.astype(np.uint64)).view(np.int64),
                    "size": pa.array(np.where(n[doc] < window, size, 0), pa.int32()),
                    "context": own,
                    "at": pa.array(place, pa.int32()),
                })

    keyed = items.select(F.col("item_id").cast("string").alias("item_id"), "text")
    return keyed.mapInArrow(scan, MARKS)


def bit_set(hashes: DataFrame, column: str) -> tuple[np.ndarray, int]:
    """A bit per hash, in at most MAX_BITS bits; built by a grouped bit_or, so the driver sees the set alone."""
    n = hashes.count()
    bits = min(MAX_BITS, max(1 << 16, 1 << (16 * max(n, 1) - 1).bit_length()))
    place = F.col(column).bitwiseAND(bits - 1)
    found = hashes.groupBy(F.shiftright(place, 6).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({column} & 63 as int))")).alias("bits")).toPandas()
    out = np.zeros(bits // 64, np.uint64)
    out[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return out, bits


def in_bit_set(hashes: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    place = hashes & np.uint64(bits - 1)
    return (table[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def corpus_marks(docs: DataFrame, table: np.ndarray, bits: int, short: list[int], window: int, k: int) -> DataFrame:
    """A row per document (h null) and one per fingerprint that the bit set lets through."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            names = np.array(batch.column("doc_id").fill_null(0))
            nulls = np.array(batch.column("doc_id").is_null())
            for found in words(batch.column("text"), ALNUM):
                n = found.counts
                parts = []
                for size in [0, *short]:
                    hashes, inside = found.grams(size or k)
                    at = winnow(found, k, window - k + 1) if size == 0 else np.flatnonzero(inside)
                    h = mix(hashes[at] + np.uint64(size or k))
                    keep = in_bit_set(h, shared.value, bits)
                    parts.append((at[keep], h[keep], np.full(int(keep.sum()), size)))
                at, h, size = (np.concatenate(x) for x in zip(*parts, strict=True))
                doc = np.searchsorted(found.first, at, "right") - 1
                context, place = surroundings(found, doc, at, np.where(size == 0, k, size), window)
                every = np.concatenate([np.arange(len(n)), doc])
                none = np.arange(len(every)) < len(n)
                fill = lambda x: pa.array(np.concatenate([np.zeros(len(n), np.int64), x]), mask=none)  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row + found.row + every),
                        pa.array(names[found.row + every], pa.int64(), mask=nulls[found.row + every]),
                        pa.array(n[every].astype(np.int64)),
                        fill(h.view(np.int64)),
                        # where in the document the context begins is size-independent: the fingerprint's word number
                        pa.array(np.concatenate([np.zeros(len(n), np.int64), size]), pa.int32(), mask=none),
                        pa.array([None] * len(n) + context, pa.string()),
                        pa.array(np.concatenate([np.zeros(len(n), np.int64), place]), pa.int32(), mask=none),
                        pa.array(np.concatenate([np.zeros(len(n), np.int64), at - found.first[doc]]), pa.int64(), mask=none),
                    ],
                    ["row", "doc_id", "n_words", "h", "size", "context", "at", "word"],
                )
            row += batch.num_rows

    return docs.select("doc_id", "text").mapInArrow(scan, HITS + ", word long")


def extend(pairs: DataFrame, window: int, k: int) -> DataFrame:
    """Spans (row, from_word, to_word, items) that a hit grows to, where it reaches a window's length."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, a, b, items = [], [], [], []
            for x in batch.to_pylist():
                doc, item = x["context"].split(" "), x["item_context"].split(" ")
                i, j, n = x["at"], x["item_at"], x["size"] or k
                if x["size"]:
                    if doc[i : i + n] == item:
                        rows.append(x["row"]), a.append(x["word"]), b.append(x["word"] + n), items.append(x["items"])
                    continue
                if doc[i : i + n] != item[j : j + n]:
                    continue
                left = right = 0
                while i > left and j > left and doc[i - left - 1] == item[j - left - 1]:
                    left += 1
                while i + n + right < len(doc) and j + n + right < len(item) and doc[i + n + right] == item[j + n + right]:
                    right += 1
                if left + n + right >= window:
                    rows.append(x["row"]), a.append(x["word"] - left), b.append(x["word"] + n + right), items.append(x["items"])
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(items, pa.list_(pa.string()))], ["a_row", "a", "b", "items"])

    return pairs.mapInArrow(grow, "a_row long, a long, b long, items array<string>").withColumnRenamed("a_row", "row")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, k: int = K) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated per row of docs(doc_id, text)."""
    marks = saved(item_marks(benchmark, window, k), "benchmark-marks")
    table, bits = bit_set(marks.select("h").distinct(), "h")
    short = sorted(r[0] for r in marks.filter("size > 0").select("size").distinct().collect())  # lengths below the window
    found = saved(corpus_marks(docs, table, bits, short, window, k), "corpus-marks")
    sides = marks.groupBy("h", "size", F.col("context").alias("item_context"), F.col("at").alias("item_at")).agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    pairs = found.filter("h is not null").join(sides, ["h", "size"]).select("row", "word", "size", "context", "at", "item_context", "item_at", "items")
    spans = extend(pairs, window, k)
    # the union of spans: each adds what lies beyond the furthest end so far
    union = F.aggregate(
        F.array_sort(F.collect_set(F.struct("a", "b"))),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], s["end"]))).alias("n"), F.greatest(s["end"], x["b"]).alias("end")),
    )["n"]
    hit = spans.groupBy("row").agg(union.alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    out = found.filter("h is null").select("row", "doc_id", "n_words").join(hit, "row", "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP5_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM iw WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM win),
dg AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM dw, lens WHERE len(w) >= n)
), hits AS (SELECT doc_id, dg.n, i, item_id FROM dg JOIN win ON dg.g = win.g AND dg.n = win.n),
pos AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)),
ph AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY doc_id),
ih AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM hits GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN ph USING (doc_id) LEFT JOIN ih USING (doc_id)
"""
