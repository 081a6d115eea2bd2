"""Merkle manifest of a dataset, with proofs for every row from one multiproof per leaf partition.

A row is a leaf; the leaves of a source, by ascending doc_id, are a tree of ARITY, and the roots of the sources, by
source, are the leaves of one more tree, whose root stands for the dataset. ``build`` writes three tables: leaves
(with their tree and place), trees, and all interior nodes.

``prove`` works octopus fashion. The leaves in their overall order are cut into partitions of SPAN leaves, whatever trees they
belong to. For a partition the least set of nodes that it can't derive is worked out from coordinates alone: on each level the
siblings just outside its run, in its first and last tree, then in the tree of sources. These few
coordinates per partition are joined with the nodes once (``fetched``). A task then derives all interior nodes that its leaves
share, level by level, and reads each leaf's own proof off the combined levels. No path is fetched per leaf.

Distribution: texts are hashed where they are read and never move; digests are range-sorted by
(source, doc_id, leaf, row), so a source with a third of all rows, or a third of all rows being one repeated row, is spread evenly;
places follow from the partitions' row counts, of which the driver holds one number per partition. Interior nodes are made in chunks
of ARITY**LEVELS leaves per round, two or three rounds for any corpus. A task holds SPAN leaves or one chunk.

Defined results: null columns are encoded as ``-``; a null source is the first source, a null doc_id the first of its
source, and is never tampered with by ``tampered``; rows that share a doc_id are ordered by leaf; equal rows have equal leaves, each in its own place; one
source alone: its subroot is the root; a lone leaf is its own subroot; an empty table has no tree and no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

ARITY = 3
LEVELS = 9
SPAN = 10_000
#: The tree whose leaves are the roots of the others.
TOP = -1
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def encoded(column: Column) -> Column:
    value = column.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_of(text: Column) -> Column:
    """The leaf of a row of documents with this text."""
    return F.unhex(F.sha2(F.concat(*(encoded(text if name == "text" else F.col(name)) for name in FIELDS)), 256))


def tampered(text: Column) -> Column:
    """The tampering that verification is tried with: line ends go where 2 divides the checksum of doc_id."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(even, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows, written in the order of the columns, with ``rank`` from 0. The driver holds a row count per partition."""
    spark = rows.sparkSession
    table = saved(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), name)
    part = F.shiftright("place", 33)
    counts = {r.part: r.n for r in table.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    firsts, total = [], 0
    for k in sorted(counts):
        firsts.append((k, total))
        total += counts[k]
    before = spark.createDataFrame(firsts, "part_no long, part_first long")
    found = table.join(F.broadcast(before), part == F.col("part_no"))
    return found.withColumn("rank", F.col("part_first") + F.col("place").bitwiseAND((1 << 33) - 1)).drop("place", "part_no", "part_first")


def parent(children: list[bytes]) -> bytes:
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


def sizes(n: int) -> list[int]:
    """Nodes on each level of a tree of n leaves."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // ARITY))
    return out


NODES = "tree long, level int, place long, digest binary, total long"
_NODE_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64()]


def _interior(base: int):
    """Runs of (tree, chunk) in the order of their places give the nodes of the next LEVELS levels, as far as their tree goes."""

    def chunk_nodes(tree: int, start: int, n: int, digests: list[bytes]) -> Iterator[tuple]:
        for level in range(1, LEVELS + 1):
            if n == 1:
                return
            digests = [parent(digests[k : k + ARITY]) for k in range(0, len(digests), ARITY)]
            start, n = start // ARITY, -(-n // ARITY)
            for k, digest in enumerate(digests):
                yield tree, base + level, start + k, digest, n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []

        def emit() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _NODE_TYPES, strict=True)], ["tree", "level", "place", "digest", "total"])
            out.clear()
            return batch

        for batch in batches:
            trees, places, totals = (batch.column(c).to_numpy() for c in ("tree", "place", "total"))
            digests = batch.column("digest").to_pylist()
            chunks = places // ARITY**LEVELS
            cuts = np.flatnonzero((np.diff(trees) != 0) | (np.diff(chunks) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(trees)], strict=True):
                if a == b:
                    continue
                if key is None or key[:2] != (int(trees[a]), int(chunks[a])):
                    if key:
                        out += chunk_nodes(key[0], key[2], key[3], held)
                    key, held = (int(trees[a]), int(chunks[a]), int(places[a]), int(totals[a])), []
                held += digests[a:b]
            if len(out) >= 50_000:
                yield emit()
        if key:
            out += chunk_nodes(key[0], key[2], key[3], held)
        yield emit()

    return run


def interior(leaves: DataFrame, most: int, name: str) -> list[DataFrame]:
    """Nodes above leaves(tree, place, digest, total), by rounds of LEVELS levels. most: leaves of the largest tree."""
    found, level = [], 0
    cells = leaves.select("tree", "place", "digest", "total").filter("total > 1")
    while most > 1:
        chunk = F.floor(F.col("place") / ARITY**LEVELS)
        nodes = cells.repartition("tree", chunk).sortWithinPartitions("tree", "place").mapInArrow(_interior(level), NODES)
        nodes = saved(nodes, f"{name}-nodes")
        found.append(nodes)
        level += LEVELS
        most = -(-most // ARITY**LEVELS)
        cells = nodes.filter((F.col("level") == level) & (F.col("total") > 1)).select("tree", "place", "digest", "total")
    return found


@dataclass
class Manifest:
    """leaves(doc_id, tree, place, total, rank, leaf, other), trees(tree, source, total, subroot), nodes(tree, level, place, digest) without the leaves of any tree."""

    leaves: DataFrame
    trees: DataFrame
    nodes: DataFrame
    n_trees: int
    root: str | None


def build(docs: DataFrame, changed: Column | None = None) -> Manifest:
    """The manifest of documents. changed: a text that a row's proof is tried with (``other`` is that row's leaf)."""
    text = F.col("text")
    other = leaf_of(changed) if changed is not None else F.lit(None).cast("binary")
    rows = docs.select(*FIELDS).select(F.col("doc_id").cast("long").alias("doc_id"), "source", leaf_of(text).alias("leaf"), other.alias("other"), F.monotonically_increasing_id().alias("row"))
    rows = ranked(saved(rows, "merkle-rows"), ["source", "doc_id", "leaf", "row"], "merkle-order").drop("row")
    trees = rows.groupBy("source").agg(F.min("rank").alias("first"), F.count("*").alias("total"))
    trees = ranked(trees, ["source"], "merkle-trees").withColumnRenamed("rank", "tree")
    found = trees.agg(F.count("*").alias("n"), F.max("total").alias("most")).first()
    of = trees.select(F.col("source").alias("of"), "tree", "first", "total")
    leaves = rows.join(of, F.col("source").eqNullSafe(F.col("of"))).withColumn("place", F.col("rank") - F.col("first")).drop("source", "of", "first")
    leaves = saved(leaves, "merkle-leaves")
    nodes = interior(leaves.withColumnRenamed("leaf", "digest"), found.most or 0, "merkle")
    tops = leaves.filter("total = 1").select("tree", F.col("leaf").alias("subroot"))
    for part in nodes:
        tops = tops.unionByName(part.filter("total = 1").select("tree", F.col("digest").alias("subroot")))
    trees = saved(trees.select("tree", "source", "total").join(tops, "tree"), "merkle-subroots")
    top = trees.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("place"), F.col("subroot").alias("digest"), F.lit(found.n).cast("long").alias("total"))
    above = interior(top, found.n, "merkle-top")
    every = top.select("tree", F.lit(0).alias("level"), "place", "digest")
    for part in nodes + above:
        every = every.unionByName(part.select("tree", "level", "place", "digest"))
    root = None
    if found.n == 1:
        root = trees.first().subroot
    elif found.n:
        root = above[-1].filter("total = 1").first().digest
    return Manifest(leaves, trees, every, found.n, bytes(root).hex() if root is not None else None)


def outside(a: int, b: int, n: int) -> Iterator[tuple[int, int]]:
    """(level, place) of the nodes that are needed and can't be derived from leaves a to before b of n: the least set."""
    level = 0
    while n > 1:
        left, right = a - a % ARITY, min(n, b + -b % ARITY)
        for place in (*range(left, a), *range(b, right)):
            yield level, place
        a, b, n, level = left // ARITY, -(-right // ARITY), -(-n // ARITY), level + 1


def missing(first: tuple[int, int, int], last: tuple[int, int, int], n_trees: int) -> list[tuple[int, int, int]]:
    """(tree, level, place) that a partition must fetch. It holds all leaves from first to last, each (tree, place, total)."""
    out = []
    if first[0] == last[0]:
        out += [(first[0], *x) for x in outside(first[1], last[1] + 1, first[2])]
    else:
        out += [(first[0], *x) for x in outside(first[1], first[2], first[2])]
        out += [(last[0], *x) for x in outside(0, last[1] + 1, last[2])]
    return out + [(TOP, *x) for x in outside(first[0], last[0] + 1, n_trees)]


def fetched(manifest: Manifest, span: int) -> DataFrame:
    """part, tree, level, place, digest: per partition of span leaves, the nodes it lacks, by one join."""
    part = F.floor(F.col("rank") / span).cast("long")
    at = F.struct("tree", "place", "total")
    ends = manifest.leaves.groupBy(part.alias("part")).agg(F.min(at).alias("first"), F.max(at).alias("last"))
    n_trees = manifest.n_trees

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r["part"], *x) for r in batch.to_pylist() for x in missing(tuple(r["first"].values()), tuple(r["last"].values()), n_trees)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.int32(), pa.int64()], strict=True)], ["part", "tree", "level", "place"])

    coordinates = ends.mapInArrow(wanted, "part long, tree long, level int, place long")
    low = manifest.leaves.select("tree", F.lit(0).alias("level"), "place", F.col("leaf").alias("digest"))
    return coordinates.join(manifest.nodes.unionByName(low), ["tree", "level", "place"])


class Known:
    """The levels of one tree as far as a partition knows them: its own run and the fetched siblings around it."""

    def __init__(self, start: int, digests: list[bytes], n: int, extra: dict[tuple[int, int], bytes]):
        self.sizes, self.levels = sizes(n), []
        a, run = start, digests
        for level in range(len(self.sizes)):
            left = a - a % ARITY if self.sizes[level] > 1 else a
            b = a + len(run)
            right = min(self.sizes[level], b + -b % ARITY) if self.sizes[level] > 1 else b
            run = [extra[level, k] for k in range(left, a)] + run + [extra[level, k] for k in range(b, right)]
            self.levels.append((left, run))
            if self.sizes[level] > 1:
                run = [parent(run[k : k + ARITY]) for k in range(0, len(run), ARITY)]
                a = left // ARITY

    @property
    def root(self) -> bytes:
        return self.levels[-1][1][0]

    def path(self, place: int) -> list[tuple[list[bytes], list[bytes]]]:
        """Per level, the siblings left and right of the node above this leaf."""
        out = []
        for (start, run), n in zip(self.levels[:-1], self.sizes, strict=False):
            k, low = place - start, place - place % ARITY - start
            out.append((run[low:k], run[k + 1 : min(low + ARITY, n - start)]))
            place //= ARITY
        return out


def proof_digest(path: list[tuple[list[bytes], list[bytes]]]) -> str:
    return hashlib.sha256("".join(d.hex() for left, right in path for d in (*left, *right)).encode()).hexdigest()


def fold(leaf: bytes, path: list[tuple[list[bytes], list[bytes]]]) -> bytes:
    """The root that a leaf and its siblings give."""
    for left, right in path:
        leaf = parent([*left, leaf, *right])
    return leaf


PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def prove(manifest: Manifest, span: int = SPAN) -> DataFrame:
    """Per row: its leaf, subroot and root, the digest of its proof, and the root that its leaf (or ``other``, where not null) folds to."""
    n_trees = manifest.n_trees
    part = F.floor(F.col("rank") / span).cast("long")
    leaves = manifest.leaves.withColumn("part", part)

    def expand(own: pa.Table, lacking: pa.Table) -> pa.Table:
        own = own.sort_by("rank")
        tree, place, total = (own[c].to_pylist() for c in ("tree", "place", "total"))
        ids, leaf, other = (own[c].to_pylist() for c in ("doc_id", "leaf", "other"))
        extra: dict[int, dict] = {}
        for r in lacking.select(["tree", "level", "place", "digest"]).to_pylist():
            extra.setdefault(r["tree"], {})[r["level"], r["place"]] = r["digest"]
        cuts = [0, *(np.flatnonzero(np.diff(tree)) + 1).tolist(), len(tree)] if len(tree) > 1 else [0, len(tree)]
        known = [Known(place[a], leaf[a:b], total[a], extra.get(tree[a], {})) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        top = Known(tree[0], [k.root for k in known], n_trees, extra.get(TOP, {}))
        root = top.root
        rows = []
        for k, (a, b) in zip(known, zip(cuts[:-1], cuts[1:], strict=True), strict=True):
            above, subroot = top.path(tree[a]), k.root.hex()
            for i in range(a, b):
                path = k.path(place[i]) + above
                folded = fold(leaf[i] if other[i] is None else other[i], path)
                rows.append((ids[i], leaf[i].hex(), subroot, root.hex(), proof_digest(path), folded.hex(), folded == root))
        columns = list(zip(*rows, strict=True))
        names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        return pa.table([pa.array(c, t) for c, t in zip(columns, [pa.int64(), *[pa.string()] * 5, pa.bool_()], strict=True)], names=names)

    return leaves.groupBy("part").cogroup(fetched(manifest, span).groupBy("part")).applyInArrow(expand, PROOFS)


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return prove(build(docs, tampered(F.col("text"))))


_SQL_LEVELS = 16  # 3**16 leaves


def _leaf_sql(text: str) -> str:
    field = lambda c, v: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode(CAST({v} AS VARCHAR))) || ':' || CAST({v} AS VARCHAR) END"
    return "sha256(" + " || ".join(field(c, text if c == "text" else c) for c in FIELDS) + ")"


def _tree_sql(name: str, leaves: str, key: str) -> str:
    """CTEs name_0 to name_K of the levels, each with runs of hashes, from leaves(key, i, h)."""
    parts = [f"{name}_0 AS (SELECT {key}, i, h, count(*) OVER (PARTITION BY {key}) AS n FROM {leaves})"]
    for k in range(_SQL_LEVELS):
        parts.append(f"{name}_run_{k} AS (SELECT {key}, i // 3 AS i, list(h ORDER BY i) AS hs, any_value(n) AS n FROM {name}_{k} WHERE n > 1 GROUP BY {key}, i // 3)")
        parts.append(
            f"{name}_{k + 1} AS (SELECT {key}, i, sha256(array_to_string(hs, '')) AS h, (n + 2) // 3 AS n FROM {name}_run_{k} UNION ALL SELECT {key}, i, h, n FROM {name}_{k} WHERE n = 1)"
        )
    return ",\n".join(parts)


def _path_sql(name: str, start: str, key: str, place: str) -> str:
    """CTEs that carry each row's place, siblings so far and folded digest up the levels."""
    parts = []
    for k in range(_SQL_LEVELS):
        before = start if k == 0 else f"{name}_up_{k - 1}"
        at = f"CAST(x.{place} % 3 + 1 AS BIGINT)"
        parts.append(
            f"""{name}_up_{k} AS (SELECT x.* REPLACE (
  x.{place} // 3 AS {place},
  CASE WHEN g.hs IS NULL THEN x.proof ELSE x.proof || array_to_string(g.hs[:{at} - 1], '') || array_to_string(g.hs[{at} + 1:], '') END AS proof,
  CASE WHEN g.hs IS NULL THEN x.fold ELSE sha256(array_to_string(g.hs[:{at} - 1], '') || x.fold || array_to_string(g.hs[{at} + 1:], '')) END AS fold)
FROM {before} x LEFT JOIN {name}_run_{k} g ON g.{key} = x.{key} AND g.i = x.{place} // 3)"""
        )
    return ",\n".join(parts)


OP12_SQL = f"""
WITH d AS (SELECT doc_id, source, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, {_leaf_sql("text")} AS leaf, {_leaf_sql("replace(text, chr(10), '')")} AS other FROM documents),
-- checksum of the decimal doc_id, bit by bit: e is a byte, or 0 seven times
sums AS (
  SELECT DISTINCT doc_id AS e, list_reduce([4294967295] || flatten(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda k: [CAST(ascii(CAST(doc_id AS VARCHAR)[k]) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])),
    lambda c, e: xor(xor(c, e) >> 1, 3988292384 * (xor(c, e) & 1))) AS c
  FROM documents WHERE doc_id IS NOT NULL
),
evens AS (SELECT e, c & 1 = 1 AS even FROM sums),
p AS (SELECT *, tree AS place_top, 0 AS one, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM d),
s_leaves AS (SELECT tree, place AS i, leaf AS h FROM p),
{_tree_sql("s", "s_leaves", "tree")},
t_leaves AS (SELECT 0 AS one, tree AS i, h FROM s_{_SQL_LEVELS}),
{_tree_sql("t", "t_leaves", "one")},
low AS (SELECT doc_id, tree, one, place, place_top, leaf, '' AS proof, CASE WHEN even THEN other ELSE leaf END AS fold FROM p LEFT JOIN evens ON doc_id = e),
{_path_sql("s", "low", "tree", "place")},
{_path_sql("t", f"s_up_{_SQL_LEVELS - 1}", "one", "place_top")}
SELECT u.doc_id, u.leaf, s.h AS subroot, r.h AS root, sha256(u.proof) AS proof_sha256, u.fold AS folded_root, u.fold = r.h AS verified
FROM t_up_{_SQL_LEVELS - 1} u JOIN s_{_SQL_LEVELS} s ON s.tree = u.tree CROSS JOIN t_{_SQL_LEVELS} r
"""
