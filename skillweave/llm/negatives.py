"""Hard negatives by exact integer inner products: Strassen multiplication of anchor and candidate tiles.

Rows become int64 vectors and are cut into blocks of BLOCK rows, each of one bucket of labels. A grid of cells deals
anchor blocks out over candidate blocks: a cell holds at most CELL_ANCHORS x CELL_CANDIDATES blocks, and as many cells are made
as there are tasks to fill, so anchors and candidates are copied once per column and row of the grid, never per pair. Inside a
task each pair of blocks is one tile, multiplied by Strassen's recursion on matrices filled up with zeros.

Two passes: the first multiplies only blocks of the same bucket and keeps each anchor's POSITIVES best rows of its own label; the
second multiplies all blocks (but those that have no two labels) and keeps, per anchor and positive, the first NEGATIVES of the
rows in the positive's window. What a tile gives is a heap of that size; heaps of the same anchor are merged inside the
cell, then over the cells by a row limit per anchor, which Spark applies before and after its shuffle. Anchors are a stated set of
queries against all rows; its size times that of the table is the work, in blocks.

Strassen's intermediate sums may pass 64 bits; as the arithmetic is modulo 2**64, results are exact wherever the products themselves fit. A
row whose squared length is over LARGEST (100 times a score might pass 64 bits) stops the job.

Defined results: rows with a null label, a null vector or a null or non-finite component take no part; an empty vector has score 0 with every
other, and a shorter vector counts as filled up with zeros; a null vec_id is no anchor and comes before all others in ties;
rows that share a vec_id are rows of their own (ties among them by their vectors' order of reading), so one may be the
other's positive; an empty table, or one without anchors, gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
ANCHOR_EVERY = 100
LOWEST_PERCENT = 30
HIGHEST_PERCENT = 90
BUCKETS = 64
BLOCK = 2048
CELL_ANCHORS = 8
CELL_CANDIDATES = 32
LARGEST = (1 << 63) // 100
#: Below this many rows, columns or inner products Strassen's recursion stops.
LEAST_SIDE = 32


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of two int64 matrices. Odd sides are filled up with zeros; all sums are exact modulo 2**64."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) < LEAST_SIDE:
        return a @ b
    x, y = np.zeros((m + m % 2, k + k % 2), np.int64), np.zeros((k + k % 2, n + n % 2), np.int64)
    x[:m, :k], y[:k, :n] = a, b
    r, s, t = x.shape[0] // 2, x.shape[1] // 2, y.shape[1] // 2
    a11, a12, a21, a22 = x[:r, :s], x[:r, s:], x[r:, :s], x[r:, s:]
    b11, b12, b21, b22 = y[:s, :t], y[:s, t:], y[s:, :t], y[s:, t:]
    p = strassen(a11 + a22, b11 + b22)
    q = strassen(a21 + a22, b11)
    u = strassen(a11, b12 - b22)
    v = strassen(a22, b21 - b11)
    w = strassen(a11 + a12, b22)
    out = np.empty((2 * r, 2 * t), np.int64)
    out[:r, t:] = u + w
    out[r:, :t] = q + v
    out[r:, t:] = p - q + u + strassen(a21 - a11, b11 + b12)
    out[:r, :t] = p + v - w + strassen(a12 - a22, b21 + b22)
    return out[:m, :n]


def quantised(vectors: DataFrame, relabelled: Column | None = None) -> DataFrame:
    """key, vec_id, label, vector of the rows that take part; components are floor(SCALE * x). relabelled: the labels to use."""
    label = F.col("label").cast("long") if relabelled is None else relabelled
    numbers = F.transform("embedding", lambda x: x.cast("double"))
    sound = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), numbers.alias("numbers")).filter(F.col("label").isNotNull() & F.col("numbers").isNotNull() & sound)
    # the squared length is checked in doubles first: what passes has components that fit in 32 bits
    length = F.aggregate("numbers", F.lit(0.0), lambda s, x: s + F.floor(x * SCALE).cast("double") * F.floor(x * SCALE).cast("double"))
    checked = F.when(length <= float(LARGEST), F.transform("numbers", lambda x: F.floor(x * SCALE).cast("long"))).otherwise(F.raise_error(F.lit("a vector is too long for exact scores")))
    return rows.select(F.monotonically_increasing_id().alias("key"), "vec_id", "label", checked.alias("vector"))


def every_seventh(label: Column, vec_id: Column) -> Column:
    """The labels that the query mines with."""
    moved = (label.cast("long") + 1) % 10
    return F.when(F.coalesce(vec_id % 7 == 0, F.lit(False)), moved).otherwise(label.cast("long"))


BLOCKS = "bucket int, block int, ids binary, nulls binary, keys binary, labels binary, vectors binary, goals binary"
_FIELDS = ["ids", "nulls", "keys", "labels", "vectors", "goals"]


def blocks(rows: DataFrame, name: str) -> tuple[DataFrame, int]:
    """rows in blocks of about BLOCK rows of one bucket, a row each, and how many there are. ``goals``, where rows have it: scores of an anchor's positives."""
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("label"), F.lit(BUCKETS)).cast("int"))
    if "goals" not in rows.columns:
        rows = rows.withColumn("goals", F.array().cast("array<long>"))
    counts = {r.bucket: r.n for r in rows.groupBy("bucket").agg(F.count("*").alias("n")).collect()}
    first, total = {}, 0
    for bucket, n in sorted(counts.items()):
        first[bucket] = (total, -(-n // BLOCK))
        total += first[bucket][1]
    if not total:
        return rows.sparkSession.createDataFrame([], BLOCKS), 0
    starts = F.create_map(*(F.lit(x) for b, (at, _) in first.items() for x in (b, at)))
    widths = F.create_map(*(F.lit(x) for b, (_, n) in first.items() for x in (b, n)))
    block = (starts[F.col("bucket")] + F.pmod(F.xxhash64("key"), widths[F.col("bucket")])).cast("int")

    def pack(table: pa.Table) -> pa.Table:
        ids = table["vec_id"].combine_chunks()
        nulls, plain = np.asarray(ids.is_null()), ids.fill_null(0).to_numpy(zero_copy_only=False)
        keys, labels = table["key"].to_numpy(), table["label"].to_numpy()
        order = np.lexsort((keys, plain, ~nulls))  # ties go by this order

        def matrix(column: str, fill: int) -> np.ndarray:
            lists = table[column].combine_chunks()
            sizes = np.diff(lists.offsets.to_numpy())
            out = np.full((len(lists), int(sizes.max(initial=0))), fill, np.int64)
            out[np.arange(out.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy()
            return out[order]

        parts = [plain[order].astype("<i8"), nulls[order].astype("u1"), keys[order].astype("<i8"), labels[order].astype("<i8"), matrix("vector", 0).astype("<i8"), matrix("goals", -1).astype("<i8")]
        head = [pa.array([table["bucket"][0].as_py()], pa.int32()), pa.array([table["block"][0].as_py()], pa.int32())]
        return pa.table(head + [pa.array([x.tobytes()], pa.binary()) for x in parts], names=["bucket", "block", *_FIELDS])

    packed = rows.select("bucket", block.alias("block"), "vec_id", "key", "label", "vector", "goals").groupBy("bucket", "block").applyInArrow(pack, BLOCKS)
    return saved(packed, name), total


class Block:
    """A block's rows, those with null vec_id first, then by vec_id and key."""

    def __init__(self, parts: list):
        ids, nulls, keys, labels, vectors, goals = (np.frombuffer(x.as_buffer() if hasattr(x, "as_buffer") else x, "u1" if k == 1 else "<i8") for k, x in enumerate(parts))
        self.ids, self.nulls, self.keys, self.labels = ids, nulls, keys, labels
        self.vectors = vectors.reshape(len(ids), -1) if len(vectors) else np.zeros((len(ids), 0), np.int64)
        self.goals = goals.reshape(len(ids), -1) if len(goals) else np.zeros((len(ids), 0), np.int64)


def scores(anchors: Block, candidates: Block) -> np.ndarray:
    wide = max(anchors.vectors.shape[1], candidates.vectors.shape[1])
    a, b = (np.pad(x.vectors, ((0, 0), (0, wide - x.vectors.shape[1]))) for x in (anchors, candidates))
    return strassen(a, np.ascontiguousarray(b.T))


def best(table: np.ndarray, n: int) -> np.ndarray:
    """The first n rows of (score, null first, id, key, ...) rows: higher scores, then smaller ids."""
    return table[np.lexsort((table[:, 3], table[:, 2], -table[:, 1], -table[:, 0]))[:n]]


def positive_heaps(anchors: Block, candidates: Block) -> Iterator[tuple[int, int, np.ndarray]]:
    """(anchor's place, 0, heap of its best rows of the same label) of a tile."""
    shared = np.isin(anchors.labels, candidates.labels)
    if not shared.any():
        return
    table = scores(anchors, candidates)
    for i in np.flatnonzero(shared):
        at = np.flatnonzero((candidates.labels == anchors.labels[i]) & (candidates.keys != anchors.keys[i]))
        at = at[np.argsort(-table[i, at], kind="stable")[:POSITIVES]]
        if len(at):
            yield i, 0, np.stack([table[i, at], candidates.nulls[at].astype(np.int64), candidates.ids[at], candidates.keys[at]], 1)


def window_heaps(anchors: Block, candidates: Block) -> Iterator[tuple[int, int, np.ndarray]]:
    """(anchor's place, number of the positive, heap of the first rows of other labels in its window) of a tile."""
    if not anchors.goals.shape[1] or len(np.unique(np.concatenate([anchors.labels, candidates.labels]))) < 2:
        return
    table = scores(anchors, candidates)
    for i in range(len(anchors.ids)):
        at = np.flatnonzero(candidates.labels != anchors.labels[i])
        at = at[np.argsort(-table[i, at], kind="stable")]
        falling = -100 * table[i, at]
        for k, goal in enumerate(anchors.goals[i].tolist()):
            if goal < 0:  # no window holds a score then; -1 also fills up
                continue
            a, b = np.searchsorted(falling, -HIGHEST_PERCENT * goal, "left"), np.searchsorted(falling, -LOWEST_PERCENT * goal, "right")
            some = at[a : min(b, a + NEGATIVES)]
            if len(some):
                yield i, k, np.stack([table[i, some], candidates.nulls[some].astype(np.int64), candidates.ids[some], candidates.keys[some]], 1)


HEAPS = "anchor_key long, anchor_id long, number int, score long, id_null int, other_id long, other_key long"


def tiles(anchors: DataFrame, candidates: DataFrame, n_anchors: int, n_candidates: int, heaps, most: int, same_bucket: bool) -> DataFrame:
    """The heaps of all tiles, merged within each cell. same_bucket: only tiles whose blocks share a bucket."""
    tasks = int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    across = max(-(-n_candidates // CELL_CANDIDATES), min(n_candidates, tasks))
    down = max(-(-n_anchors // CELL_ANCHORS), min(n_anchors, -(-tasks // max(across, 1))))
    left = anchors.select(*(F.col(c).alias("a_" + c) for c in ["bucket", "block", *_FIELDS]), F.pmod("block", F.lit(down)).alias("cell_a"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("cell_c"))
    right = candidates.select(*(F.col(c).alias("c_" + c) for c in ["bucket", "block", *_FIELDS[:-1]]), F.pmod("block", F.lit(across)).alias("cell_c"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("cell_a"))
    meet = (left.cell_a == right.cell_a) & (left.cell_c == right.cell_c)
    if same_bucket:
        meet = meet & (F.col("a_bucket") == F.col("c_bucket"))
    pairs = left.hint("merge").join(right, meet).select("a_block", *("a_" + c for c in _FIELDS), *("c_" + c for c in _FIELDS[:-1]))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        number, block = None, None

        def emit() -> Iterator[pa.RecordBatch]:
            if held:
                sizes = [len(x) for x in held.values()]
                rows = np.concatenate(list(held.values()))
                place = np.repeat([i for i, _ in held], sizes)
                which = np.repeat([k for _, k in held], sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.keys[place]), pa.array(block.ids[place]), pa.array(which.astype(np.int32)), pa.array(rows[:, 0]), pa.array(rows[:, 1].astype(np.int32)), pa.array(rows[:, 2]), pa.array(rows[:, 3])],
                    ["anchor_key", "anchor_id", "number", "score", "id_null", "other_id", "other_key"],
                )
                held.clear()

        for batch in batches:
            for r in range(batch.num_rows):
                if batch.column(0)[r].as_py() != number:
                    yield from emit()
                    number, block = batch.column(0)[r].as_py(), Block([batch.column(k)[r] for k in range(1, 7)])
                other = Block([*(batch.column(k)[r] for k in range(7, 12)), b""])
                for i, k, rows in heaps(block, other):
                    old = held.get((i, k))
                    held[i, k] = rows if old is None else best(np.concatenate([old, rows]), most)
        yield from emit()

    return pairs.mapInArrow(multiply, HEAPS)


def first(heaps: DataFrame, most: int) -> DataFrame:
    """The heaps of each anchor (and number) merged: the first rows over all cells, with their rank."""
    order = Window.partitionBy("anchor_key", "number").orderBy(F.desc("score"), F.desc("id_null"), "other_id", "other_key")
    found = heaps.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    return found.withColumn("other_id", F.when(F.col("id_null") == 0, F.col("other_id"))).drop("id_null")


def hard_negatives(vectors: DataFrame, relabelled: Column | None = None, *, anchor_every: int = ANCHOR_EVERY) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score over the rows of vectors(vec_id, embedding, label)."""
    rows = saved(quantised(vectors, relabelled), "negatives-rows")
    candidates, n_candidates = blocks(rows, "negatives-blocks")
    wanted = rows.filter(F.col("vec_id") % anchor_every == 0)
    anchors, n_anchors = blocks(wanted, "negatives-anchors")
    positives = saved(first(tiles(anchors, candidates, n_anchors, n_candidates, positive_heaps, POSITIVES, True), POSITIVES), "negatives-positives")
    # POSITIVES rows per anchor at most
    goals = positives.groupBy("anchor_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("goals"))
    aiming, n_aiming = blocks(wanted.join(goals, F.col("key") == F.col("anchor_key")).drop("anchor_key"), "negatives-aims")
    negatives = first(tiles(aiming, candidates, n_aiming, n_candidates, window_heaps, NEGATIVES, False), NEGATIVES)
    of = positives.select("anchor_key", (F.col("rank") - 1).alias("number"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return negatives.join(of, ["anchor_key", "number"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return hard_negatives(vectors, every_seventh(F.col("label"), F.col("vec_id")))


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS same, CAST(list_dot_product(a.q, c.q) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0
),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (
  SELECT p.*, other_id AS negative_id, score AS negative_score, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
