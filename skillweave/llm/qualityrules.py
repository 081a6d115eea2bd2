"""Quality rules: base counts, and the divergence of a document's histograms from its language's references.

``references`` sums, by language, the character classes and the words of all documents that pass the base
rules, so a reference grows with the corpus and is the same at every partitioning. A language's common words are its
COMMON most frequent ones (ties by the word). ``judge`` then reads every text once more: the document's histogram of
classes, and that of the common words with one bin for all others, are compared with the reference of its
language by Jensen-Shannon distance (base 2, 0 to 1); a document further away than the limits is
dropped. Guards: texts with fewer than LEAST_CHARS code points aren't judged by classes, those with fewer than LEAST_WORDS words
aren't judged by words, as histograms of little text are far from any reference.

A language has a reference of its own if it holds at least one of LEAST_SHARE words of the corpus and LEAST_REFERENCE
words; all others share that of the whole corpus. So there are LEAST_SHARE + 1 references at most, of COMMON words each,
whatever the lang column holds: this bounds what the driver gathers and tasks are sent. Everything else is one pass
without a shuffle, apart from the sums by (language, word), which combine in the tasks first.

Equal words, windows and lines of one text are told by 64-bit hashes: among n of them two different ones count as equal
with probability n*n/2**65.

Defined results: a null text has no words, so base_failed; rows with null or repeated doc_id are judged each by
themselves; a null lang is a language of its own; where no document passes the base rules nothing is compared; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved
from .textscan import SPACED, _power_tables, mix, slices, words

COMMON = 64
WINDOW = 8
LEAST_BASE_WORDS = 20
MOST_REPEATED_PERCENT = 30
LEAST_CHARS = 400
LEAST_WORDS = 60
LEAST_SHARE = 10_000
LEAST_REFERENCE = 1_000
CLASS_LIMIT = 0.35
WORD_LIMIT = 0.47
#: (language, word) sums that one task holds before it hands them on.
HELD = 200_000

#: The symbols that the base rule counts.
SYMBOLS = "#*$%&|<>"
CLASSES = ["space", "control", "digit", "upper", "lower", "stop", "exclaim", "mark", "symbol", "ascii", "latin", "two", "three", "four"]


def _class_table() -> np.ndarray:
    """The class of each first byte of a code point; len(CLASSES) for the bytes that continue one."""
    at = {name: k for k, name in enumerate(CLASSES)}
    table = np.full(256, at["ascii"], np.uint8)
    table[0x20], table[:0x20], table[0x7F] = at["space"], at["control"], at["control"]
    table[0x30:0x3A], table[0x41:0x5B], table[0x61:0x7B] = at["digit"], at["upper"], at["lower"]
    for name, characters in (("stop", ".,"), ("exclaim", "!?"), ("mark", ";:'\"()-"), ("symbol", SYMBOLS)):
        table[[ord(c) for c in characters]] = at[name]
    table[0x80:0xC0] = len(CLASSES)
    table[0xC0:0xE0], table[0xC3:0xCB], table[0xE0:0xF0], table[0xF0:] = at["two"], at["latin"], at["three"], at["four"]
    return table


CLASS_OF = _class_table()


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many flags lie between consecutive bounds."""
    running = np.concatenate([[0], np.cumsum(flags)])
    return running[bounds[1:]] - running[bounds[:-1]]


def _repeated_lines(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per document, lines that hold a word and equal an earlier line."""
    n, docs = len(raw), len(offsets) - 1
    breaks = np.flatnonzero(raw == 10)
    begins, ends = offsets[:-1][np.diff(offsets) > 0], offsets[1:][np.diff(offsets) > 0]
    last = np.zeros(n + 1, bool)
    last[ends - 1] = True
    # a break at the head of a document is where the one before ends, so both lists may hold it
    start = np.sort(np.concatenate([begins, breaks[~last[breaks]] + 1]))
    end = np.sort(np.concatenate([breaks, ends[raw[ends - 1] != 10]]))
    running = np.concatenate([[0], np.cumsum(SPACED[raw])])
    worded = running[end] > running[start]
    start, end = start[worded], end[worded]
    up, down = _power_tables(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    doc = np.searchsorted(offsets, start, "right") - 1
    key = mix(mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)) ^ mix(doc.astype(np.uint64)))
    _, first = np.unique(key, return_index=True)
    return np.bincount(doc, minlength=docs) - np.bincount(doc[first], minlength=docs)


def _repeated_words(found, doc: np.ndarray) -> np.ndarray:
    """Per document, words inside a window that occurs twice or more in it."""
    grams, inside = found.grams(WINDOW)
    at = np.flatnonzero(inside)
    _, group, size = np.unique(mix(grams[at] ^ mix(doc[at].astype(np.uint64))), return_inverse=True, return_counts=True)
    at = at[size[group] > 1]
    n = len(grams)
    covered = np.cumsum(np.bincount(at, minlength=n + WINDOW + 1) - np.bincount(at + WINDOW, minlength=n + WINDOW + 1))[:n] > 0
    return _sums(covered, found.first)


class Measured:
    """Counts of the documents of one slice."""

    def __init__(self, found, raw: np.ndarray, offsets: np.ndarray):
        self.found, self.docs = found, len(offsets) - 1
        self.doc = np.repeat(np.arange(self.docs), found.counts)
        self.n_words = found.counts
        kind = CLASS_OF[raw]
        of = np.repeat(np.arange(self.docs), np.diff(offsets))
        wide = len(CLASSES) + 1
        self.classes = np.bincount(of * wide + kind, minlength=self.docs * wide).reshape(self.docs, wide)[:, :-1]
        self.word_chars = _sums(SPACED[raw] & (kind < len(CLASSES)), offsets)
        self.n_symbols = self.classes[:, CLASSES.index("symbol")]
        self.n_dup_lines = _repeated_lines(raw, offsets)
        self.n_repeat_words = _repeated_words(found, self.doc)
        self.base_failed = (self.n_words < LEAST_BASE_WORDS) | (100 * self.n_repeat_words > MOST_REPEATED_PERCENT * self.n_words)


def measured(column: pa.Array) -> Iterator[tuple[int, Measured]]:
    for found, (row, raw, offsets) in zip(words(column, SPACED, fold=False), slices(column), strict=True):
        yield row, Measured(found, raw, offsets)


def distances(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts from the same row of the reference; 0 where either is all zeros."""

    def spread(x: np.ndarray) -> np.ndarray:
        return -(x * np.log2(np.where(x > 0, x, 1.0))).sum(1)

    total, other = counts.sum(1, keepdims=True), reference.sum(1, keepdims=True)
    p, q = counts / np.maximum(total, 1), reference / np.maximum(other, 1)
    both = (total[:, 0] > 0) & (other[:, 0] > 0)
    return np.sqrt(np.maximum(0.0, np.where(both, spread((p + q) / 2) - (spread(p) + spread(q)) / 2, 0.0)))


SUMS = "lang string, word string, bin int, n long"


def _corpus_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by language over the documents that pass the base rules: of classes (bin) and of words."""
    held: dict[int, list] = {}
    classes: dict[str | None, np.ndarray] = {}

    def flush() -> pa.RecordBatch:
        rows = list(held.values()) + [[lang, None, k, int(n)] for lang, row in classes.items() for k, n in enumerate(row) if n]
        held.clear()
        classes.clear()
        columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int64()), strict=True)], ["lang", "word", "bin", "n"])

    for batch in batches:
        langs = batch.column("lang").to_pylist()
        code_of = {lang: k for k, lang in enumerate(dict.fromkeys(langs))}
        name_of = list(code_of)
        codes = np.array([code_of[x] for x in langs], np.int64)
        for row, m in measured(batch.column("text")):
            code = codes[row : row + m.docs]
            for c in np.unique(code[~m.base_failed]):
                lang = name_of[c]
                classes[lang] = classes.get(lang, 0) + m.classes[(code == c) & ~m.base_failed].sum(0)
                at = np.flatnonzero(((code == c) & ~m.base_failed)[m.doc])
                salt = hash((lang,)) & 0xFFFFFFFFFFFFFFFF
                keys, first, n = np.unique(mix(m.found.hashes[at] ^ np.uint64(salt)), return_index=True, return_counts=True)
                for key, k, count in zip(keys.tolist(), at[first].tolist(), n.tolist(), strict=True):
                    entry = held.get(key)
                    if entry is None:
                        held[key] = [lang, m.found.text(k, k + 1), -1, count]
                    else:
                        entry[3] += count
            if len(held) > HELD:
                yield flush()
    yield flush()


class References:
    """Per language (None for one is a language too) its classes, common words and their counts; ``pool`` serves all other languages."""

    def __init__(self, by_lang: dict, pool):
        self.by_lang, self.pool = by_lang, pool

    def of(self, lang: str | None):
        return self.by_lang.get((lang,), self.pool)


def _reference(classes: dict[int, int], common: list[tuple[str, int]], total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(counts of classes, sorted hashes of the common words, their counts and that of all other words)."""
    found = [w.hashes for w in words(pa.array([w for w, _ in common], pa.string()), SPACED, fold=False)]
    hashes = np.concatenate(found) if found else np.zeros(0, np.uint64)
    order = np.argsort(hashes)
    counts = np.zeros(COMMON + 1)
    counts[: len(common)] = np.array([n for _, n in common], float)[order]
    counts[COMMON] = total - counts.sum()
    row = np.zeros(len(CLASSES))
    for k, n in classes.items():
        row[k] = n
    return row, hashes[order], counts


def references(docs: DataFrame) -> References:
    """The references of documents(lang, text). The driver gathers at most LEAST_SHARE + 1 times COMMON words."""
    sums = docs.select("lang", "text").mapInArrow(_corpus_sums, SUMS).groupBy("lang", "word", "bin").agg(F.sum("n").alias("n"))
    sums = saved(sums, "quality-sums")
    totals = sums.filter("bin < 0").groupBy("lang").agg(F.sum("n").alias("total"))
    all_words = totals.agg(F.sum("total")).first()[0] or 0
    own = totals.filter((F.col("total") * LEAST_SHARE >= all_words) & (F.col("total") >= LEAST_REFERENCE))
    own = own.select(F.col("lang").alias("own"), "total")
    mine = sums.join(own, F.col("lang").eqNullSafe(F.col("own")), "left_semi")

    def top(rows: DataFrame, *by: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc("n"), "word")
        return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= COMMON)

    # the pool is a group of its own: one task ends up with COMMON rows of each other task, by the limit that comes before the shuffle
    pool_words = top(sums.filter("bin < 0").groupBy("word").agg(F.sum("n").alias("n")).withColumn("all", F.lit(0)), "all").orderBy("place").collect()
    pool_classes = {r.bin: r.n for r in sums.filter("bin >= 0").groupBy("bin").agg(F.sum("n").alias("n")).collect()}
    found: dict = {(r.own,): ({}, [], r.total) for r in own.collect()}
    for r in mine.filter("bin >= 0").collect():
        found[(r.lang,)][0][r.bin] = r.n
    for r in top(mine.filter("bin < 0"), "lang").orderBy("place").collect():
        found[(r.lang,)][1].append((r.word, r.n))
    pool = _reference(pool_classes, [(r.word, r.n) for r in pool_words], all_words)
    return References({lang: _reference(*x) for lang, x in found.items()}, pool)


RESULT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, class_distance double, word_distance double"
)
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _histograms(m: Measured, langs: list, refs: References) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each document: counts of its language's common words, that language's own counts, and its classes."""
    counts, of_words, of_classes = np.zeros((m.docs, COMMON + 1)), np.zeros((m.docs, COMMON + 1)), np.zeros((m.docs, len(CLASSES)))
    groups: dict = {}
    for d, lang in enumerate(langs):
        groups.setdefault(lang, []).append(d)
    for lang, members in groups.items():
        classes, hashes, reference = refs.of(lang)
        of_words[members], of_classes[members] = reference, classes
        chosen = np.zeros(m.docs, bool)
        chosen[members] = True
        at = np.flatnonzero(chosen[m.doc])
        if len(hashes) and len(at):
            place = np.minimum(np.searchsorted(hashes, m.found.hashes[at]), len(hashes) - 1)
            place = np.where(hashes[place] == m.found.hashes[at], place, COMMON)
            counts += np.bincount(m.doc[at] * (COMMON + 1) + place, minlength=m.docs * (COMMON + 1)).reshape(counts.shape)
    return counts, of_words, of_classes


def judge(docs: DataFrame, refs: References, *, class_limit: float = CLASS_LIMIT, word_limit: float = WORD_LIMIT) -> DataFrame:
    """One row per row of documents(doc_id, lang, text): the base counts, the distances (null where the text is too short to be judged) and the verdict."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, langs = batch.column("doc_id"), batch.column("lang").to_pylist()
            for row, m in measured(batch.column("text")):
                counts, of_words, of_classes = _histograms(m, langs[row : row + m.docs], refs)
                by_class, by_word = distances(m.classes, of_classes), distances(counts, of_words)
                short, few = m.classes.sum(1) < LEAST_CHARS, m.n_words < LEAST_WORDS
                far = ~short & (by_class > class_limit) | ~few & (by_word > word_limit)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(row, m.docs), *(pa.array(getattr(m, c).astype(np.int64)) for c in _COUNTS), pa.array(m.base_failed), pa.array(~m.base_failed & ~far)]
                    + [pa.array(by_class, mask=short), pa.array(by_word, mask=few)],
                    ["doc_id", *_COUNTS, "base_failed", "kept", "class_distance", "word_distance"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").mapInArrow(rows, RESULT)


def quality_rules(docs: DataFrame) -> DataFrame:
    return judge(docs, references(docs))


def op11_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("class_distance", "word_distance")


#: A regular expression for the characters of each class, in the order of CLASSES.
_CLASS_PATTERNS = [
    r"\x20", r"\x00-\x1F\x7F", "0-9", "A-Z", "a-z", ".,", "!?", r";:''\"()\-", r"#*$%&|<>", r"\x2B\x2F=@\[\\\]\x5E_`{}~",
    r"\x{C0}-\x{2BF}", r"\x{80}-\x{BF}\x{2C0}-\x{7FF}", r"\x{800}-\x{FFFF}", r"\x{10000}-\x{10FFFF}",
]
_CLASS_COUNTS = ", ".join(f"length(regexp_replace(t, '[^{p}]', '', 'g'))" for p in _CLASS_PATTERNS)
OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
dup AS (
  SELECT r, sum(n - 1) AS n FROM (SELECT r, l, count(*) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r, l) GROUP BY r
),
win AS (SELECT r, unnest(range(1, len(ws) - {WINDOW - 2})) AS i, unnest(list_transform(range(1, len(ws) - {WINDOW - 2}), lambda i: array_to_string(ws[i:i + {WINDOW - 1}], ' '))) AS g FROM w WHERE len(ws) >= {WINDOW}),
twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win),
rep AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(i, i + {WINDOW})) AS at FROM twice WHERE n > 1) GROUP BY r),
base AS (
  SELECT w.r, doc_id, lang, t, ws, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
         len(ws) < {LEAST_BASE_WORDS} OR 100 * coalesce(rep.n, 0) > {MOST_REPEATED_PERCENT} * len(ws) AS base_failed
  FROM w LEFT JOIN dup ON w.r = dup.r LEFT JOIN rep ON w.r = rep.r
),
cls AS (SELECT r, lang, base_failed, unnest(range({len(CLASSES)})) AS k, unnest([{_CLASS_COUNTS}]) AS n FROM base),
wrd AS (SELECT r, lang, base_failed, word, count(*) AS n FROM (SELECT r, lang, base_failed, unnest(ws) AS word FROM base) GROUP BY ALL),
sums AS (SELECT lang, word, sum(n) AS n FROM wrd WHERE NOT base_failed GROUP BY lang, word),
own AS (SELECT lang FROM sums GROUP BY lang HAVING sum(n) >= {LEAST_REFERENCE} AND sum(n) * {LEAST_SHARE} >= (SELECT sum(n) FROM sums)),
of_lang AS (SELECT DISTINCT b.lang, o.lang IS NULL AND NOT (b.lang IS NULL AND EXISTS (SELECT 1 FROM own WHERE lang IS NULL)) AS pooled FROM base b LEFT JOIN own o ON b.lang = o.lang),
every AS (SELECT word, sum(n) AS n FROM sums GROUP BY word),
ref_word AS (
  SELECT lang, FALSE AS pooled, word, n FROM sums QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) <= {COMMON}
  UNION ALL SELECT NULL, TRUE, word, n FROM every QUALIFY row_number() OVER (ORDER BY n DESC, word) <= {COMMON}
),
ref_total AS (SELECT lang, FALSE AS pooled, sum(n) AS total FROM sums GROUP BY lang UNION ALL SELECT NULL, TRUE, sum(n) FROM every),
ref_class AS (
  SELECT lang, FALSE AS pooled, k, sum(n) AS n FROM cls WHERE NOT base_failed GROUP BY lang, k
  UNION ALL SELECT NULL, TRUE, k, sum(n) FROM cls WHERE NOT base_failed GROUP BY k
),
key AS (SELECT r, b.n_words, o.pooled, CASE WHEN o.pooled THEN NULL ELSE b.lang END AS lang FROM base b JOIN of_lang o ON b.lang IS NOT DISTINCT FROM o.lang),
ref_other AS (SELECT t.lang, t.pooled, total, total - coalesce(sum(w.n), 0) AS n FROM ref_total t LEFT JOIN ref_word w ON t.pooled = w.pooled AND t.lang IS NOT DISTINCT FROM w.lang GROUP BY t.lang, t.pooled, total),
hit AS (
  SELECT k.r, f.word, f.n / t.total AS q, coalesce(x.n, 0) / greatest(k.n_words, 1) AS p, coalesce(x.n, 0) AS n
  FROM key k JOIN ref_word f ON k.pooled = f.pooled AND k.lang IS NOT DISTINCT FROM f.lang JOIN ref_total t ON k.pooled = t.pooled AND k.lang IS NOT DISTINCT FROM t.lang
  LEFT JOIN wrd x ON x.r = k.r AND x.word = f.word
),
word_rows AS (
  SELECT r, p, q FROM hit
  UNION ALL SELECT k.r, (k.n_words - coalesce(h.n, 0)) / greatest(k.n_words, 1), o.n / o.total FROM key k JOIN ref_other o ON k.pooled = o.pooled AND k.lang IS NOT DISTINCT FROM o.lang LEFT JOIN (SELECT r, sum(n) AS n FROM hit GROUP BY r) h ON h.r = k.r
),
class_rows AS (
  SELECT k.r, c.n / greatest(length(b.t), 1) AS p, f.n / sum(f.n) OVER (PARTITION BY k.r) AS q
  FROM key k JOIN base b ON b.r = k.r JOIN cls c ON c.r = k.r JOIN ref_class f ON f.k = c.k AND f.pooled = k.pooled AND f.lang IS NOT DISTINCT FROM k.lang
),
js AS (
  SELECT 'word' AS kind, r, p, q FROM word_rows UNION ALL SELECT 'class', r, p, q FROM class_rows
),
dist AS (
  SELECT kind, r, sqrt(greatest(0, sum(CASE WHEN p + q > 0 THEN -(p + q) / 2 * log2((p + q) / 2) ELSE 0 END + CASE WHEN p > 0 THEN p * log2(p) / 2 ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q) / 2 ELSE 0 END))) AS js
  FROM js GROUP BY kind, r
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND NOT (length(t) >= {LEAST_CHARS} AND coalesce(c.js, 0) > {CLASS_LIMIT}) AND NOT (n_words >= {LEAST_WORDS} AND coalesce(x.js, 0) > {WORD_LIMIT}) AS kept
FROM base b LEFT JOIN dist c ON c.kind = 'class' AND c.r = b.r LEFT JOIN dist x ON x.kind = 'word' AND x.r = b.r
"""
