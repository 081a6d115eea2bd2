"""Language-model scores by prediction by partial matching over bytes.

Training counts every (ORDER bytes, next byte) gram of every training text, beginnings and ends
included; tasks add up their own grams before the shuffle. Shorter contexts follow by summing. From
the counts the trie of contexts is compiled once: escape estimation by the number of distinct symbols
(method D: half a count per symbol), and symbol exclusion, which a static trie allows to be worked out per context, because the
symbols seen after a context are a subset of those seen after its suffix.

The model has every context and gram of every order and grows with the corpus: it is a table of counts per order,
never gathered. What a symbol costs follows from its gram of full length alone. The costs of the
most frequent grams are a cache of bounded size that tasks look up; all other grams of a text, added up per text, join the
costs by shuffle: those of grams that training texts have, and for the rest what the descent through
the shorter contexts gives, one join an order. The cache's size changes no score.

Counts travel packed: a task sends its sorted grams as one compressed row per bucket of their hashes, and the tasks
that buckets are dealt to merge them one bucket at a time, so only distinct grams of the corpus become rows.

The unigram base needs the count of every token of the corpus. The most frequent words, a table
of bounded size, are looked up in the tasks; all others join the full count table by shuffle.

Defined results: a null or empty text is its end alone; a null doc_id is not held out; repeated rows
each get their own row; an empty table gives an empty result; without training texts every symbol is
equally likely; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved
from .textscan import LOWER, SPACED, mix, slices, words

ORDER = 6
FREQUENT_GRAMS = 1 << 21
FREQUENT_WORDS = 1 << 18
END = 0xFF  # no byte of UTF-8
END_TOKEN = np.array([0x5EED0F7E], np.int64)[0]
#: Grams that a task sorts at once, and distinct ones that it holds before it hands them on.
CHUNK = 1 << 21
HELD = 1_000_000
#: Buckets of counts that are merged at once.
BUCKET_BITS = 12


def gram_codes(raw: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """For each byte of each text, lower-cased, and then its end: the ``order`` bytes before it, and itself. Ends fill up what lies before a text."""
    n_docs, lengths = len(offsets) - 1, np.diff(offsets)
    gap = order + 1
    data = np.full(len(raw) + n_docs * gap + 8, END, np.uint8)
    data[np.arange(len(raw)) + np.repeat(np.arange(n_docs) * gap + order, lengths)] = LOWER[raw]
    # eight bytes from each byte on, as one number; a gram is the first of these
    eight = np.ndarray(len(data) - 8, ">u8", data.data, strides=(1,))
    at = np.ones(len(eight), bool)  # not the grams of ends that fill up
    for j in range(order):
        at[offsets[1:] + np.arange(n_docs) * gap + 1 + j] = False
    return eight[at].astype(np.uint64) >> np.uint64(8 * (7 - order))


def run_starts(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal sorted keys begins."""
    return np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)


def added_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = run_starts(keys)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def packed(numbers: np.ndarray) -> bytes:
    """64-bit numbers, small differences best: byte by byte place, so that what is mostly zero lies together."""
    return pa.compress(np.diff(numbers, prepend=numbers.dtype.type(0)).view(np.uint8).reshape(-1, 8).T.tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel())


class Tally:
    """Adds up how often 64-bit keys come, within bounded memory: CHUNK keys as they come, and about HELD with their counts."""

    def __init__(self, kind: int, chunk: int):
        self.kind, self.waiting, self.n = kind, np.empty(chunk, np.uint64), 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        while len(keys):
            own = keys[: len(self.waiting) - self.n]
            self.waiting[self.n : self.n + len(own)] = own
            self.n += len(own)
            keys = keys[len(own) :]
            if self.n == len(self.waiting):
                yield from self.settle()

    def settle(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        """Counts what waits, and hands on what is held when it is too much."""
        own = self.waiting[: self.n]
        own.sort()
        first = run_starts(own)
        keys, counts = own[first], np.diff(np.append(first, len(own)))
        self.n = 0
        if len(self.keys):
            keys, counts = added_up(np.append(self.keys, keys), np.append(self.counts, counts))
        self.keys, self.counts = keys, counts
        if len(keys) and (last or len(keys) > HELD):
            self.keys, self.counts = self.keys[:0], self.counts[:0]
            yield from self.rows(keys, counts)

    def rows(self, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """A packed row per bucket that has keys."""
        bucket = (mix(keys) >> np.uint64(64 - BUCKET_BITS)).astype(np.uint16)
        order = np.argsort(bucket, kind="stable")
        bucket, keys, counts = bucket[order], keys[order], counts[order]
        first = run_starts(bucket)
        cuts = list(zip(first, np.append(first[1:], len(keys)), strict=True))
        for s in range(0, len(cuts), 256):
            part = cuts[s : s + 256]
            yield pa.RecordBatch.from_pydict({
                "kind": pa.array([self.kind] * len(part), pa.int32()),
                "bucket": pa.array([int(bucket[a]) for a, _ in part], pa.int32()),
                "size": pa.array([b - a for a, b in part], pa.int32()),
                "codes": pa.array([packed(keys[a:b]) for a, b in part], pa.binary()),
                "counts": pa.array([packed(counts[a:b].view(np.uint64)) for a, b in part], pa.binary()),
            })


def corpus_counts(docs: DataFrame, order: int) -> DataFrame:
    """kind (0 gram, 1 word), code, n over docs(text)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, tokens, ends = Tally(0, CHUNK), Tally(1, CHUNK // 8), 0
        for batch in batches:
            column = batch.column("text")
            for _, raw, offsets in slices(column):
                yield from grams.add(gram_codes(raw, offsets, order))
            for found in words(column, SPACED):
                yield from tokens.add(found.hashes)
            ends += batch.num_rows
        yield from grams.settle(True)
        yield from tokens.settle(True)
        if ends:
            yield from tokens.rows(np.array([END_TOKEN]).view(np.uint64), np.array([ends]))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, keys, counts, held = None, [], [], 0

        def whole() -> Iterator[pa.RecordBatch]:
            if keys:
                k, c = added_up(np.concatenate(keys), np.concatenate(counts))
                for a in range(0, len(k), 100_000):
                    n = len(k[a : a + 100_000])
                    yield pa.RecordBatch.from_pydict({"kind": pa.array(np.full(n, at[0]), pa.int32()), "code": k[a : a + 100_000].view(np.int64), "n": c[a : a + 100_000]})

        for batch in batches:
            for kind, bucket, size, k, c in zip(*(batch.column(x).to_pylist() for x in ("kind", "bucket", "size", "codes", "counts")), strict=True):
                if (kind, bucket) != at:
                    yield from whole()
                    at, keys, counts, held = (kind, bucket), [], [], 0
                keys.append(unpacked(k, size))
                counts.append(unpacked(c, size).view(np.int64))
                held += size
                if held > CHUNK:
                    one = added_up(np.concatenate(keys), np.concatenate(counts))
                    keys, counts, held = [one[0]], [one[1]], len(one[0]) // 2
        yield from whole()

    parts = docs.select("text").mapInArrow(scan, "kind int, bucket int, size int, codes binary, counts binary")
    return parts.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket").mapInArrow(merge, "kind int, code long, n long")


def gram_levels(counts: DataFrame, order: int) -> list[DataFrame]:
    """code, n of all grams of each order from 0; shorter ones are sums of longer ones."""
    levels = [saved(counts.filter("kind = 0").select("code", "n"), "grams")]
    for k in range(order - 1, -1, -1):
        shorter = F.col("code").bitwiseAND((1 << 8 * (k + 1)) - 1)
        levels.insert(0, saved(levels[0].groupBy(shorter.alias("code")).agg(F.sum("n").alias("n")), "grams"))
    return levels


def seen_costs(grams: DataFrame) -> DataFrame:
    """code, n, cost of the grams of full length that training texts have."""
    total = F.sum("n").over(Window.partitionBy(F.shiftrightunsigned("code", 8)))  # 256 rows at most
    return grams.select("code", "n", F.log10((F.col("n") - 0.5) / total).alias("cost"))


def unseen_costs(codes: DataFrame, levels: list[DataFrame], never: float) -> DataFrame:
    """code, cost of distinct codes that no training text has: the way down from the longest known context, one join an order."""
    # seen: the symbols of the longer context that was escaped from; null where none was known so far
    out = codes.select("code", F.lit(0.0).alias("cost"), F.lit(False).alias("done"), F.lit(None).cast("array<int>").alias("seen"))
    symbol = F.col("code").bitwiseAND(255).cast("int")
    for k in range(len(levels) - 1, -1, -1):
        entries = F.map_from_entries(F.collect_list(F.struct(symbol.alias("symbol"), "n")))  # 256 at most
        context = F.shiftrightunsigned("code", 8).bitwiseAND((1 << 8 * k) - 1)
        own = levels[k].withColumn("context", F.shiftrightunsigned("code", 8))
        if k > 1:  # the contexts that are asked for
            own = own.join(codes.select(context.alias("context")).distinct().hint("merge"), "context", "left_semi")
        own = own.groupBy("context").agg(F.sum("n").alias("total"), entries.alias("counts"))
        # up to order 1 there are 256 contexts at most; longer ones are never broadcast: one plan at every size
        own = F.broadcast(own) if k < 2 else own.hint("merge")
        rows = out.withColumn("context", context).join(own, "context", "left")
        n, kinds, fresh = F.try_element_at("counts", symbol), F.size("counts"), F.col("seen").isNull()
        low = F.aggregate("seen", F.lit(0).cast("long"), lambda t, x: t + F.coalesce(F.try_element_at("counts", x), F.lit(0).cast("long")))
        rest = F.when(fresh, F.col("total")).otherwise(F.greatest(F.col("total") - low, F.lit(1)))
        more = F.when(fresh, kinds).otherwise(kinds - F.size("seen"))
        step = F.when(n.isNotNull(), F.log10((n - 0.5) / rest)).when(more > 0, F.log10(more / 2 / rest)).otherwise(0.0)
        at = F.col("total").isNotNull() & ~F.col("done")
        out = rows.select(
            "code",
            (F.col("cost") + F.when(at, step).otherwise(0.0)).alias("cost"),
            (F.col("done") | (at & n.isNotNull())).alias("done"),
            F.when(at & n.isNull(), F.map_keys("counts")).when(~F.col("done"), F.col("seen")).alias("seen"),
        )
    return out.select("code", F.when(F.col("done"), F.col("cost")).otherwise(F.col("cost") + never).alias("cost"))


def most_frequent(rows: DataFrame, value: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """code, value of rows(code, n) of the highest counts, ``most`` at most: whole classes of counts, so nothing is sorted."""
    size = F.floor(F.log2("n") * 8)
    sizes = sorted(((r["size"], r["count"]) for r in rows.groupBy(size.alias("size")).count().collect()), reverse=True)
    held = np.cumsum([c for _, c in sizes])
    kept = [s for (s, _), c in zip(sizes, held, strict=True) if c <= most]
    if not kept:
        return np.zeros(0, np.int64), np.zeros(0)
    top = rows.filter(size >= kept[-1]).select("code", value).toArrow()
    return top.column("code").to_numpy(), top.column(value).to_numpy()


def places(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each asked key stands among sorted keys, and whether it does."""
    if not len(keys):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return at, keys[at] == asked


def lm_scores(docs: DataFrame, *, order: int = ORDER, frequent_grams: int = FREQUENT_GRAMS, frequent_words: int = FREQUENT_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per row of docs(doc_id, text)."""
    if not 0 < order < 7:
        raise ValueError("a gram of at most 7 bytes is one number beside its document")
    spark = docs.sparkSession
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))
    rows = docs.select("doc_id", "text", held.alias("held_out"))
    counts = saved(corpus_counts(rows.filter(~F.col("held_out")), order), "corpus-counts")
    tokens = counts.filter("kind = 1").select("code", "n")
    n_train, v_train = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    frequent, often = most_frequent(tokens, "n", frequent_words)
    by_code = np.argsort(frequent)
    frequent, often = frequent[by_code], often[by_code]
    norm = n_train + 0.1 * (v_train + 1)
    levels = gram_levels(counts, order)
    never = float(-np.log10(max(1, 256 - levels[0].count())))
    costs = saved(seen_costs(levels[-1]), "gram-costs")
    codes, cost = most_frequent(costs, "cost", frequent_grams)
    by_code = np.argsort(codes)
    codes, cost = codes[by_code], cost[by_code]
    shared = spark.sparkContext.broadcast((codes, cost, frequent, often))
    del codes, cost, by_code, frequent, often

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, cost, frequent, often = shared.value
        row = TaskContext.get().partitionId() << 40

        def rare(kind: int, rr: np.ndarray, rc: np.ndarray, tf: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(rr), 200_000):
                k = slice(a, a + 200_000)
                m = len(rr[k])
                yield pa.RecordBatch.from_arrays([pa.array(rr[k]), pa.array(np.full(m, kind), pa.int32()), pa.array(rc[k]), pa.array(tf[k]), *(pa.nulls(m, t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()))], NAMES)

        for batch in batches:
            column, n = batch.column("text"), batch.num_rows
            score, size, known, base = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
            for first, raw, offsets in slices(column, 256):
                doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(offsets) + 1)
                both = gram_codes(raw, offsets, order) << np.uint64(8) | doc  # a gram has 56 bits, its document among 256 the rest
                both.sort()
                starts = run_starts(both)
                tf = np.diff(np.append(starts, len(both)))
                both = both[starts]
                code, doc = (both >> np.uint64(8)).view(np.int64), (both & np.uint64(255)).astype(np.int64)
                runs = run_starts(code)
                at, hit = (np.repeat(x, np.diff(np.append(runs, len(code)))) for x in places(codes, code[runs]))
                score[first : first + len(offsets) - 1] = np.bincount(doc[hit], tf[hit] * cost[at[hit]], len(offsets) - 1)
                if not hit.all():
                    yield from rare(0, row + first + doc[~hit], code[~hit], tf[~hit])
            for found in words(column, SPACED):
                h = np.insert(found.hashes.view(np.int64), found.first[1:], END_TOKEN)
                doc = np.repeat(np.arange(len(found.counts)), found.counts + 1)
                order_of = np.lexsort((doc, h))
                h, doc = h[order_of], doc[order_of]
                starts = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))[: len(h)])
                tf = np.diff(np.append(starts, len(h)))
                h, doc = h[starts], doc[starts]
                at, hit = places(frequent, h)
                k = slice(found.row, found.row + len(found.counts))
                size[k] = found.counts + 1
                known[k] = np.bincount(doc[hit], tf[hit], len(found.counts))
                base[k] = np.bincount(doc[hit], tf[hit] * np.log10((often[at[hit]] + 0.1) / norm), len(found.counts))
                if not hit.all():
                    yield from rare(1, row + found.row + doc[~hit], h[~hit], tf[~hit])
            yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(n)), pa.nulls(n, pa.int32()), *(pa.nulls(n, pa.int64()) for _ in range(2)), batch.column("doc_id"), batch.column("held_out"), pa.array(size), pa.array(known), pa.array(base), pa.array(score)], NAMES)
            row += n

    found = saved(rows.mapInArrow(scan, SCAN), "scores")
    grams = found.filter("kind = 0").select("row", "code", "tf")
    fresh = grams.select("code").distinct().join(costs.select("code").hint("merge"), "code", "left_anti")
    rest = costs.select("code", "cost").unionByName(unseen_costs(saved(fresh, "unseen"), levels, never))
    more = grams.join(rest.hint("merge"), "code").groupBy("row").agg(F.sum(F.col("tf") * F.col("cost")).alias("more_score"))
    c = F.coalesce("n", F.lit(0))
    rare_words = found.filter("kind = 1").select("row", "code", "tf").join(tokens, "code", "left").groupBy("row").agg(F.sum(F.col("tf") * F.log10((c + 0.1) / F.lit(float(norm)))).alias("more"), F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("more_known"))
    out = found.filter("kind is null").join(rare_words, "row", "left").join(more, "row", "left")
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )


SCAN = "row long, kind int, code long, tf long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double"
NAMES = [x.split(" ")[0] for x in SCAN.split(", ")]


def op9_lm_score(spark, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
