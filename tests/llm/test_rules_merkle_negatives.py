"""Quality rules, Merkle proofs and hard negatives against brute force, on small tables with awkward rows."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from skillweave.llm import merkle, negatives, qualityrules

SENTENCE = "the cat sat on the mat and the dog ran to the river with a stone in its mouth while it rained on the town"
TEXTS = [
    (1, SENTENCE, "en", "a"), (2, None, "en", "a"), (3, "", None, None), (4, " \n\t\n ", "de", ""), (5, f"{SENTENCE}\n{SENTENCE}\r\n{SENTENCE}\n\n\n", "en", "b"),
    (6, "one two three four five six seven eight " * 9, "en", "b"), (6, "one two three four five six seven eight " * 9, "en", "b"), (None, "orphan # text\n*** $%&|<> ünï 漢字 🙂\n*** $%&|<> ünï 漢字 🙂", None, "c"),
    (7, " ".join(f"w{i % 977}x{i % 13}" for i in range(20_000)), "fr", "a"), (8, "Same line\nsame line\nSame line \nSame line\n", "xx", "Z"), (9, "x", "en", "é"), (10, SENTENCE.upper().replace(" ", "!! "), "en", None), (-4, "neg\native", "en", None),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame(TEXTS, SCHEMA).withColumn("n_chars", F.when(F.col("doc_id") != 9, F.length("text")).cast("long")).repartition(3)
    for name in ("n_words", "word", "bin", "place", "tree", "rank", "part", "first", "leaf", "other", "row", "level"):
        rows = rows.withColumn(name, F.lit("x"))
    return rows


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def base_counts(text):
    ws = spaced(text)
    seen = collections.Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
    covered = {j for i in range(len(ws) - 7) if seen[tuple(ws[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = collections.Counter(x for x in (text or "").split("\n") if spaced(x))
    failed = len(ws) < 20 or 100 * len(covered) > 30 * len(ws)
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), sum(lines.values()) - len(lines), len(covered), failed


def test_base_rules_equal_brute_force(odd):
    got = qualityrules.quality_rules(odd).select("doc_id", *qualityrules._COUNTS, "base_failed").collect()
    assert sorted(map(tuple, got), key=str) == sorted(((i, *base_counts(t)) for i, t, _, _ in TEXTS), key=str)


def test_lines_and_windows_of_random_texts(spark):
    draw = np.random.default_rng(5)
    texts = ["".join(draw.choice(list("ab \n\r\t#é"), size=int(n))) for n in draw.integers(0, 200, 300)]
    for row, m in qualityrules.measured(pa.array(texts)):
        got = zip(m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, m.base_failed, strict=True)
        assert [tuple(map(int, x)) for x in got] == [tuple(map(int, base_counts(t))) for t in texts[row : row + m.docs]]


def js(p, q):
    m = {k: (p.get(k, 0) + q.get(k, 0)) / 2 for k in p.keys() | q.keys()}
    spread = lambda x: -sum(v * math.log2(v) for v in x.values() if v > 0)
    return math.sqrt(max(0.0, spread(m) - (spread(p) + spread(q)) / 2))


def shares(counts):
    total = sum(counts.values())
    return {k: v / total for k, v in counts.items()}


def test_distances_equal_brute_force(spark):
    """Of documents as they are given: references by language from all documents that pass the base rules, then each document's distances."""
    frame = pd.read_parquet(f"{DATA}/documents.parquet")
    got = {r.doc_id: r for r in qualityrules.quality_rules(spark.read.parquet(f"{DATA}/documents.parquet")).collect()}
    kind = lambda c: int(qualityrules.CLASS_OF[c.encode()[0]])
    by_words, by_classes = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for text, lang in zip(frame.text, frame.lang, strict=True):
        if not base_counts(text)[-1]:
            by_words[lang].update(spaced(text))
            by_classes[lang].update(map(kind, text))
    common = {lang: {w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0].encode()))[: qualityrules.COMMON]} for lang, c in by_words.items()}
    fold = lambda words, lang: collections.Counter(w if w in common[lang] else None for w in words)
    for i, text, lang in zip(frame.doc_id, frame.text, frame.lang, strict=True):
        row, ws = got[i], spaced(text)
        if len(ws) >= qualityrules.LEAST_WORDS:
            reference = collections.Counter()
            for w, n in by_words[lang].items():
                reference[w if w in common[lang] else None] += n
            assert row.word_distance == pytest.approx(js(shares(fold(ws, lang)), shares(reference)), abs=1e-9)
        else:
            assert row.word_distance is None
        if len(text or "") >= qualityrules.LEAST_CHARS:
            assert row.class_distance == pytest.approx(js(shares(collections.Counter(map(kind, text))), shares(by_classes[lang])), abs=1e-9)
        else:
            assert row.class_distance is None
        far = (row.word_distance or 0) > qualityrules.WORD_LIMIT or (row.class_distance or 0) > qualityrules.CLASS_LIMIT
        assert row.kept == (not row.base_failed and not far)


def test_rules_keep_labelled_quality(spark):
    """Of the labelled rows that pass the base rules, nearly all good ones stay and most bad ones go."""
    rows = qualityrules.quality_rules(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    found = rows.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("not base_failed").toPandas()
    good, bad = found[found.quality == 1], found[found.quality == 0]
    assert good.kept.mean() >= 0.99 and bad.kept.mean() <= 0.2


def test_rules_of_empty_and_failing_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert qualityrules.quality_rules(empty).collect() == []
    few = qualityrules.quality_rules(spark.createDataFrame([(1, "too few words", "en", None), (None, None, None, None)], SCHEMA)).collect()
    assert [r.kept for r in few] == [False, False] and all(r.class_distance is None for r in few)


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree_of(level):
    out = [level]
    while len(level) > 1:
        level = [digest(level[k : k + 3]) for k in range(0, len(level), 3)]
        out.append(level)
    return out


def path_of(levels, place):
    out = []
    for level in levels[:-1]:
        low = place - place % 3
        out.append((level[low:place], level[place + 1 : low + 3]))
        place //= 3
    return out


def merkle_rows(rows):
    """Sequential version of the whole query over (doc_id, source, lang, n_chars, text)."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: digest([field(r[0]), field(r[1]), field(r[2]), field(r[3]), field(text)])
    by = collections.defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        trees.append(tree_of([leaf(r, r[4]) for r in by[s]]))
    top = tree_of([t[-1][0] for t in trees]) if trees else []
    out = []
    for k, s in enumerate(sources):
        for place, r in enumerate(by[s]):
            path = path_of(trees[k], place) + path_of(top, k)
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            node = leaf(r, r[4].replace("\n", "") if even and r[4] is not None else r[4])
            for left, right in path:
                node = digest([*left, node, *right])
            root = top[-1][0]
            out.append((r[0], trees[k][0][place], trees[k][-1][0], root, digest([x for left, right in path for x in (*left, *right)]), node, node == root))
    return out


def rows_of(frame):
    return [tuple(None if pd.isna(v) else v for v in (r.doc_id, r.source, r.lang, r.n_chars, r.text)) for r in frame.collect()]


def many(spark, sizes):
    rows = [(1000 * s + k, f"line {k}\nof {s}" if k % 5 else None, "en", f"s{s:03d}" if s else None, k % 7 or None) for s, n in enumerate(sizes) for k in range(n)]
    return spark.createDataFrame(rows, SCHEMA + ", n_chars long").repartition(5)


@pytest.mark.parametrize(("sizes", "span"), [([40, 1, 7, 28, 1, 1, 3, 81], 10), ([5] * 20, 7), ([1] * 30, 4), ([100], 9), ([1], 10), ([2, 9], 1)])
def test_proofs_equal_a_sequential_version(spark, sizes, span):
    docs = many(spark, sizes)
    got = merkle.prove(merkle.build(docs, merkle.tampered(F.col("text"))), span)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(merkle_rows(rows_of(docs)), key=str)


def test_proofs_in_rounds_and_of_awkward_rows(spark, odd, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 2)
    for docs in (many(spark, [200, 30, 1]), odd):
        got = merkle.prove(merkle.build(docs, merkle.tampered(F.col("text"))), 13)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(merkle_rows(rows_of(docs)), key=str)


def test_proofs_of_no_rows_and_without_tampering(spark, odd):
    empty = merkle.build(odd.limit(0), merkle.tampered(F.col("text")))
    assert empty.root is None and merkle.prove(empty).collect() == []
    whole = merkle.build(odd)
    assert all(r.verified and r.root == whole.root for r in merkle.prove(whole).collect())


@pytest.mark.parametrize(("a", "b", "n"), [(0, 1, 1), (0, 100, 100), (4, 9, 30), (29, 30, 30), (13, 14, 100), (1, 99, 100), (27, 54, 81)])
def test_missing_nodes_are_the_least_set(a, b, n):
    """All that is needed is there or can be derived, and nothing that is fetched can be derived."""
    levels = merkle.sizes(n)
    have = {(0, k) for k in range(a, b)}
    lacking = set(merkle.outside(a, b, n))

    def close(known):
        known = set(known)
        for level in range(len(levels) - 1):
            for k in range(levels[level + 1]):
                if all((level, c) in known for c in range(3 * k, min(3 * k + 3, levels[level]))):
                    known.add((level + 1, k))
        return known

    full = close(have | lacking)
    for place in range(a, b):
        for level, size in enumerate(levels[:-1]):
            low = place - place % 3
            assert all((level, k) in full for k in range(low, min(low + 3, size)))
            place //= 3
    assert not lacking & close(have) and all(x not in close(have | lacking - {x}) for x in lacking)


@pytest.mark.parametrize(("m", "k", "n"), [(1, 1, 1), (7, 0, 3), (33, 64, 70), (64, 64, 64), (65, 33, 130), (128, 100, 257)])
def test_strassen_is_exact(m, k, n):
    draw = np.random.default_rng(m)
    a, b = draw.integers(-(1 << 27), 1 << 27, (m, k)), draw.integers(-(1 << 27), 1 << 27, (k, n))
    assert (negatives.strassen(a, b) == a @ b).all()


def brute_negatives(rows):
    """rows: (key, vec_id, label, embedding). The query's rule, one row at a time."""
    sound = []
    for key, i, label, vector in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        sound.append((key, i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(256 * x) for x in vector]))
    score = lambda a, b: sum(x * y for x, y in zip(a[3], b[3], strict=False))
    out = []
    for a in sound:
        if a[1] is None or a[1] % 100:
            continue
        order = lambda x: (-x[0], x[1][1] is not None, x[1][1] or 0, x[1][0])
        ranked = sorted(((score(a, c), c) for c in sound if c[0] != a[0]), key=order)
        for p, c in [x for x in ranked if x[1][2] == a[2]][:5]:
            near = [(s, d) for s, d in ranked if d[2] != a[2] and 30 * p <= 100 * s <= 90 * p][:10]
            out += [(a[1], c[1], k, d[1], p, s) for k, (s, d) in enumerate(near, 1)]
    return sorted(out, key=str)


VECTORS = "vec_id long, embedding array<float>, label int"


def test_hard_negatives_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 17)
    monkeypatch.setattr(negatives, "CELL_CANDIDATES", 3)
    monkeypatch.setattr(negatives, "CELL_ANCHORS", 2)
    draw = np.random.default_rng(3)
    base = draw.normal(size=(12, 40)) * 0.2
    rows = []
    for k in range(260):
        v = (base[k % 12] + draw.normal(size=40) * 0.05).astype(np.float32).tolist()
        rows.append([k * 20 if k % 3 else k, v, int(draw.integers(0, 4))])
    rows += [list(r) for r in rows[:20]]  # repeated rows
    rows += [[None, rows[0][1], 1], [100, None, 1], [200, rows[1][1], None], [300, [0.5, None, 0.1], 2], [400, [float("nan")] * 40, 2], [500, [float("inf")] * 40, 2], [600, [], 2], [700, [0.3, 0.2], 2], [800, [0.0] * 40, 3]]
    table = spark.createDataFrame([tuple(r) for r in rows], VECTORS).repartition(4).withColumn("key", F.lit(9)).withColumn("block", F.lit(1)).withColumn("score", F.lit("x"))
    got = negatives.hard_negatives(table, negatives.every_seventh(F.col("label"), F.col("vec_id")))
    # equal rows can stand for each other: keys follow the order of reading, so compare without them
    want = brute_negatives([(k, i, label, vector) for k, (i, vector, label) in enumerate(rows)])
    assert sorted(map(tuple, got.collect()), key=str) == want and len(want) > 200


def test_hard_negatives_without_rows_or_anchors(spark):
    assert negatives.hard_negatives(spark.createDataFrame([], VECTORS)).collect() == []
    assert negatives.hard_negatives(spark.createDataFrame([(1, [0.1, 0.2], 1), (2, [0.1, 0.2], 2)], VECTORS)).collect() == []
    assert negatives.hard_negatives(spark.createDataFrame([(0, [0.1, 0.2], 1)], VECTORS)).collect() == []


def test_too_long_vectors_stop_the_job(spark):
    with pytest.raises(Exception, match="too long for exact scores"):
        negatives.hard_negatives(spark.createDataFrame([(0, [1e30, 0.2], 1), (1, [0.1, 0.2], 1)], VECTORS)).collect()
