"""N-gram Jaccard self-join with adaptive multi-match prefixes, and its connected components.

A text's set is its distinct five-word shingles, as 64-bit hashes. Texts with one set are one class and
enter the join once. All sets are read in one global order: shingles by hash, those that more than HOT
prefixes hold last. If two sets overlap in at least O elements, their first ``n - O + l`` elements share at
least l; O follows from the threshold and a set's own size. Each set gets the l, 1 to LONGEST, with the
least estimated cost, which adds the postings that it scans and the candidates left to verify, fewer
as l grows. A pair is a candidate when it shares min(l of both) elements of its prefixes, cut to
what the sizes of both allow.

Only components are asked for, so pairs inside one component need no verification: in each of a few star
rounds every set is verified against one pivot, first the most central set of its postings, and in one
more round against its closest set in long postings; then all candidate pairs
between different components are verified, which makes the result exact. Before any text is fetched, an
exact upper bound on the overlap, from bitmaps of the buckets that shingles fall into, drops most
candidates; postings with many classes make theirs block by block, as rows only within that bound. Texts that are left are fetched once, by a fixed-size Bloom filter on their ids.

Nothing is dropped or capped: HOT and the order only say which elements come first. At most MAX_HOT
shingles are moved to the end (HOT rises if there are more), so what is broadcast is bounded. Class
keys are 64-bit hashes of whole sets: two different sets among N share one with probability N*N/2**65.

Defined results: null text, or text without words, has an empty set, is linked with nothing and is its own
component; a null doc_id is never the smallest unless a component has no other; rows that repeat are in
one component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, tidy
from .decontaminate import bit_set, in_bit_set
from .textscan import SPACED, Words, mix, words

SHINGLE = 5
PERCENT = 80
HOT = 64
MAX_HOT = 1 << 20
LONGEST = 4
STAR_ROUNDS = 1
#: Bits of a set's bitmap, postings that are paired as rows at most, members of a block of longer ones.
BITS = 2048
PAIRED = 32
BLOCK = 1024


def sets_of(found: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, end to end, and where each document's begin."""
    counts = found.counts
    grams, inside = found.grams(k)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        for size in np.unique(counts[short]):
            at = found.first[:-1][short[counts[short] == size]]
            grams[at] = mix(found.grams(int(size))[0][at] + np.uint64(size))
            inside[at] = True
    parts, sizes = [], np.zeros(len(counts) + 1, np.int64)
    for d, (a, b) in enumerate(zip(found.first[:-1], found.first[1:], strict=True)):
        own = np.sort(grams[a:b][inside[a:b]])
        if len(own):
            own = own[np.append(True, own[1:] != own[:-1])]
        parts.append(own)
        sizes[d + 1] = len(own)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.cumsum(sizes)


def class_keys(flat: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.append(np.uint64(0), np.cumsum(mix(flat ^ np.uint64(0xA5A5A5A55A5A5A5A))))
    return mix((total[first[1:]] - total[first[:-1]]) * np.uint64(0x9E3779B97F4A7C15) + np.diff(first).astype(np.uint64)).view(np.int64)


def sketches(flat: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Per document a bitmap of the buckets that its shingles fall into."""
    n = len(first) - 1
    table = np.zeros((n, BITS), bool)
    table[np.repeat(np.arange(n), np.diff(first)), (flat & np.uint64(BITS - 1)).astype(np.int64)] = True
    return [row.tobytes() for row in np.packbits(table, axis=1)]


def most_overlap(n_x, n_y, bits_x, bits_y, common):
    """An upper bound on the overlap: a bucket that only one set has holds an element that the other lacks."""
    return np.minimum(n_x - (bits_x - common), n_y - (bits_y - common))


def can_reach(n_x, n_y, most):
    return 100 * most >= PERCENT * (n_x + n_y - most)


def least_overlap(n):
    """The least overlap that a set of n elements has with any partner."""
    return -(-PERCENT * n // 100)


def prefix_ranks(flat: np.ndarray, first: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each element in the global order, and whether it lies in the longest prefix."""
    late = np.zeros(len(flat), bool)
    if len(hot) and len(flat):
        late = hot[np.minimum(np.searchsorted(hot, flat), len(hot) - 1)] == flat
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    before = np.append(0, np.cumsum(late))
    lates = before[:-1] - before[first[:-1]][doc]  # hot ones before it in its document
    place = np.arange(len(flat)) - first[:-1][doc]
    early = n - (before[first[1:]] - before[first[:-1]])
    rank = np.where(late, early[doc] + lates, place - lates)
    o = least_overlap(n)
    return rank, rank < (n - o + np.minimum(LONGEST, o))[doc]


def set_rows(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n, cid, sketch of every row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("doc_id")
            for found in words(batch.column("text"), SPACED):
                flat, first = sets_of(found, k)
                n = np.diff(first)
                yield pa.RecordBatch.from_arrays([names.slice(found.row, len(n)), pa.array(n), pa.array(class_keys(flat, first)), pa.array(sketches(flat, first), pa.binary())], ["doc_id", "n", "cid", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(tidy(scan), "doc_id long, n long, cid long, sketch binary")


def prefix_rows(docs: DataFrame, k: int, hot: np.ndarray | None, broadcast=None) -> DataFrame:
    """h, cid, n, rank of the elements in each set's longest prefix; of equal sets in one slice, once. Without hot: h alone."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = broadcast.value if broadcast is not None else np.zeros(0, np.uint64)
        for batch in batches:
            for found in words(batch.column("text"), SPACED):
                flat, first = sets_of(found, k)
                rank, keep = prefix_ranks(flat, first, late)
                if broadcast is None:
                    yield pa.RecordBatch.from_pydict({"h": flat[keep].view(np.int64)})
                    continue
                cid, n = class_keys(flat, first), np.diff(first)
                once = np.zeros(len(n), bool)
                once[np.unique(cid, return_index=True)[1]] = True
                doc = np.repeat(np.arange(len(n)), n)
                keep &= once[doc]
                doc = doc[keep]
                yield pa.RecordBatch.from_pydict({"h": flat[keep].view(np.int64), "cid": cid[doc], "n": pa.array(n[doc], pa.int32()), "rank": pa.array(rank[keep], pa.int32())})

    return docs.select("text").mapInArrow(tidy(scan), "h long" if broadcast is None else "h long, cid long, n int, rank int")


def hot_shingles(docs: DataFrame, k: int) -> np.ndarray:
    """Shingles that more than HOT prefixes hold, sorted; at most MAX_HOT, for which HOT rises."""
    counts = saved(prefix_rows(docs, k, None).groupBy("h").agg(F.count("*").alias("df")).filter(F.col("df") > HOT), "hot-shingles")
    least = HOT
    while counts.filter(F.col("df") > least).count() > MAX_HOT:
        least *= 2
    return np.sort(counts.filter(F.col("df") > least).select("h").toPandas()["h"].to_numpy(np.int64).view(np.uint64))


def postings(docs: DataFrame, k: int) -> DataFrame:
    """Prefix elements that at least two classes share, with each class's own l and its centrality."""
    hot = docs.sparkSession.sparkContext.broadcast(hot_shingles(docs, k))
    w = Window.partitionBy("h")
    rows = prefix_rows(docs, k, None, hot).select("h", "cid", "n", "rank", F.count("*").over(w).alias("df"), F.min("cid").over(w).alias("lo"), F.max("cid").over(w).alias("hi"))
    shared = saved(rows.filter("lo <> hi").drop("lo", "hi").dropDuplicates(["h", "cid"]), "postings")
    own = Window.partitionBy("cid")
    base = F.col("n") - least_overlap_sql("n")
    costs = []
    for size in range(1, LONGEST + 1):
        inside = F.when(F.col("rank") < base + size, F.col("df"))
        scan, n_inside = F.coalesce(F.sum(inside).over(own), F.lit(0)), F.count(inside).over(own)
        verify = (scan - n_inside) / size * F.col("n") / 8
        costs.append(F.when(F.lit(size) <= F.greatest(F.lit(1), least_overlap_sql("n")), F.struct((scan + verify).alias("cost"), F.lit(size).alias("l"))))
    chosen = shared.withColumn("l", F.least(*costs)["l"]).withColumn("central", F.sum("df").over(own))
    return saved(chosen.filter(F.col("rank") < base + F.col("l")).drop("df"), "prefixes")


def least_overlap_sql(n: str):
    return F.expr(f"cast(({PERCENT} * cast({n} as long) + 99) div 100 as int)")


def sizes_fit(a: str, b: str) -> str:
    return f"100L * least({a}, {b}) >= {PERCENT}L * greatest({a}, {b})"


def star_candidates(rows: DataFrame, turn: int) -> DataFrame:
    """One pair per class and round: with the pivot that it shares most elements with."""
    w = Window.partitionBy("h")
    key = F.struct(F.col("central") if turn == 0 else F.xxhash64("cid", F.lit(turn)).alias("central"), "cid", "n", "comp")
    led = rows.withColumn("pivot", F.max(key).over(w)).filter("pivot.cid <> cid and pivot.comp <> comp and " + sizes_fit("n", "pivot.n"))
    pairs = led.groupBy("cid", F.col("pivot.cid").alias("b")).agg(F.count("*").alias("shared"))
    return pairs.groupBy(F.col("cid").alias("a")).agg(F.max(F.struct("shared", "b"))["b"].alias("b"))


def mixed_postings(rows: DataFrame) -> DataFrame:
    """Postings that hold classes of different components, with their number of classes."""
    w = Window.partitionBy("h")
    mixed = rows.withColumn("one", F.min("comp").over(w)).withColumn("two", F.max("comp").over(w)).withColumn("size", F.count("*").over(w)).filter("one <> two")
    return saved(mixed.select("h", "cid", "n", "rank", "l", "comp", "size"), "mixed-postings")


def block_candidates(mixed: DataFrame, sketch: DataFrame, best: bool) -> DataFrame:
    """Pairs across components in postings of more than PAIRED classes: all whose bitmaps leave the threshold within reach, or of these each
    class's closest alone. Each pair of blocks of about BLOCK classes is one group, so only such pairs become rows.

    Prefixes for one shared element serve here: they hold a common element of every similar pair, whatever l its sets have.
    """
    heavy = mixed.filter(F.col("size") > PAIRED).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    heavy = heavy.filter(F.col("rank") <= F.col("n") - least_overlap_sql("n"))
    heavy = heavy.join(sketch.drop("n"), "cid").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    heavy = heavy.select("h", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cid", "n", "rank", "comp", "sketch")

    def block_pairs(table: pa.Table) -> pa.Table:
        cid, n, rank, comp, block = (table.column(c).to_numpy().astype(np.int64) for c in ("cid", "n", "rank", "comp", "block"))
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        bits = np.unpackbits(np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(cid), -1), axis=1).astype(np.float32)
        own = bits.sum(1)
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        found = [np.zeros((0, 2), np.int64)]
        for s in range(0, len(left), 512):
            x, y = left[s : s + 512][:, None], right[None, :]
            o = -(-PERCENT * (n[x] + n[y]) // (100 + PERCENT))
            ok = (comp[x] != comp[y]) & (100 * np.minimum(n[x], n[y]) >= PERCENT * np.maximum(n[x], n[y])) & (rank[x] <= n[x] - o) & (rank[y] <= n[y] - o)
            if i == j:
                ok &= cid[x] < cid[y]
            most = most_overlap(n[x], n[y], own[x], own[y], bits[x[:, 0]] @ bits[right].T)
            ok &= can_reach(n[x], n[y], most)
            if best and ok.any():
                value = np.where(ok, most / (n[x] + n[y] - most), -1)
                only = np.zeros_like(ok)
                only[np.arange(len(ok)), value.argmax(1)] = True
                only[value.argmax(0), np.arange(ok.shape[1])] = True
                ok &= only
            p, q = np.nonzero(ok)
            p, q = cid[x[p, 0]], cid[right[q]]
            found.append(np.stack([np.minimum(p, q), np.maximum(p, q)], 1))
        pairs = np.concatenate(found)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return heavy.groupBy("h", "i", "j").applyInArrow(block_pairs, "a long, b long").distinct()


def cross_candidates(rows: DataFrame, sketch: DataFrame) -> DataFrame:
    """All pairs of different components that share enough prefix elements and may reach the threshold. Postings of up to PAIRED classes make
    their pairs by a join, longer ones by blocks."""
    mixed = mixed_postings(rows)
    a, b = (mixed.filter(F.col("size") <= PAIRED).select("h", *(F.col(c).alias(f"{c}_{s}") for c in ("cid", "n", "rank", "l", "comp"))) for s in "ab")
    o = F.expr(f"({PERCENT}L * (n_a + n_b) + {99 + PERCENT}) div {100 + PERCENT}")
    least = F.least("l_a", "l_b")
    pairs = a.join(b, "h").filter("cid_a < cid_b and comp_a <> comp_b and " + sizes_fit("n_a", "n_b")).filter((F.col("rank_a") < F.col("n_a") - o + least) & (F.col("rank_b") < F.col("n_b") - o + least))
    few = pairs.groupBy(F.col("cid_a").alias("a"), F.col("cid_b").alias("b")).agg(F.count("*").alias("shared"), F.first(least).alias("need"))
    # a pair may share its other elements in longer postings: then one is enough here
    some = mixed.filter(F.col("size") > PAIRED).select(F.col("cid").alias("a")).distinct().withColumn("longer", F.lit(True))
    few = few.join(some, "a", "left").filter("shared >= need or longer").select("a", "b")
    return overlap_can_do(few, sketch).unionByName(block_candidates(mixed, sketch, best=False)).distinct()


def overlap_can_do(pairs: DataFrame, sketch: DataFrame) -> DataFrame:
    """Drops pairs whose bitmaps rule the threshold out."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 10_000):
                part = batch.slice(s, 10_000)
                x, y = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint64).reshape(part.num_rows, -1) for c in ("sketch_a", "sketch_b"))
                n_x, n_y = (part.column(c).to_numpy() for c in ("n_a", "n_b"))
                count = lambda z: np.bitwise_count(z).sum(1, dtype=np.int64)
                keep = can_reach(n_x, n_y, most_overlap(n_x, n_y, count(x), count(y), count(x & y)))
                yield pa.RecordBatch.from_pydict({c: part.column(c).filter(pa.array(keep)) for c in ("a", "b")})

    a, b = (sketch.select(F.col("cid").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"sketch_{s}")) for s in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(tidy(bound), "a long, b long")


def verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets reach the threshold, from their texts."""
    needed = saved(pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct().join(classes, "cid").select("cid", "rep"), "needed-texts")
    table, bits = bit_set(needed.select(F.xxhash64("rep").alias("h")), "h")
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = in_bit_set(np.array(batch.column("h")).view(np.uint64), shared.value, bits)
            part = batch.filter(pa.array(keep))
            for found in words(part.column("text"), SPACED):
                flat, first = sets_of(found, k)
                yield pa.RecordBatch.from_arrays([pa.array(class_keys(flat, first)), part.column("text").slice(found.row, len(first) - 1)], ["cid", "text"])

    texts = docs.select(F.xxhash64("doc_id").alias("h"), "text").mapInArrow(tidy(fetch), "cid long, text string")
    texts = saved(texts.join(needed.select("cid"), "cid").groupBy("cid").agg(F.first("text").alias("text")), "pair-texts")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(column: pa.Array) -> list[np.ndarray]:
            out = []
            for found in words(column, SPACED):
                flat, first = sets_of(found, k)
                out += [flat[p:q] for p, q in zip(first[:-1], first[1:], strict=True)]
            return out

        for batch in batches:
            for s in range(0, batch.num_rows, 200):
                part = batch.slice(s, 200)
                keep = []
                for x, y in zip(one(part.column("text_a")), one(part.column("text_b")), strict=True):
                    merged = np.sort(np.concatenate([x, y]))
                    union = int((merged[1:] != merged[:-1]).sum()) + (len(merged) > 0)
                    keep.append(100 * (len(merged) - union) >= PERCENT * union)
                yield pa.RecordBatch.from_pydict({c: part.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")})

    a, b = (texts.select(F.col("cid").alias(s), F.col("text").alias(f"text_{s}")) for s in "ab")
    return saved(pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(tidy(check), "a long, b long"), "links")


def components(edges: DataFrame) -> DataFrame:
    """cid, comp of every node of edges(a, b): large-star and small-star steps in turn until nothing changes."""
    now = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    last = None
    while True:
        mark = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if mark == last:
            return now.select(F.col("u").alias("cid"), F.col("v").alias("comp")).unionByName(now.select(F.col("v").alias("cid"), F.col("v").alias("comp")).distinct())
        last = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        now = saved(small.filter("v <> m").select("v", "m").unionByName(low.select(F.col("u").alias("v"), "m")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")


def jaccard_components(docs: DataFrame, *, k: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id per row of docs(doc_id, text)."""
    sets = saved(set_rows(docs, k), "sets")
    classes = saved(sets.filter("n > 0").groupBy("cid").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n")), "classes")
    rows = postings(docs, k)
    ours = rows.select("cid").distinct()
    sketch = saved(sets.join(ours, "cid").groupBy("cid").agg(F.first("sketch").alias("sketch"), F.first("n").alias("n")), "sketches")
    links, comp = None, None
    for turn in range(STAR_ROUNDS + 2):
        if comp is None:
            placed = rows.withColumn("comp", F.col("cid"))
        else:
            placed = rows.join(comp, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
        if turn < STAR_ROUNDS:
            pairs = overlap_can_do(star_candidates(placed, turn), sketch)
        elif turn == STAR_ROUNDS:
            pairs = block_candidates(mixed_postings(placed), sketch, best=True)
        else:
            pairs = cross_candidates(placed, sketch)
        pairs = saved(pairs, "candidates")
        new = None if pairs.isEmpty() else verified(docs, pairs, classes, k)
        if new is None or new.isEmpty():
            continue  # a round without a new link leaves all components as they are
        links = new if links is None else links.unionByName(new)
        comp = components(links)
    if comp is None:
        comp = docs.sparkSession.createDataFrame([], "cid long, comp long")
    named = comp.join(classes, "cid").groupBy("comp").agg(F.min("rep").alias("component_id"))
    placed = classes.select("cid", "rep").join(comp, "cid", "left").join(named, "comp", "left").select("cid", F.coalesce("component_id", "rep").alias("component_id"))
    out = sets.select("doc_id", "n", "cid").join(placed, "cid", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op7_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
