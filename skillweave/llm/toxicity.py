"""Toxicity by a support vector machine over a gap-weighted subsequence kernel with Nyström landmarks.

A unit is a white-space token without what isn't a letter, or a run of single letters ("i d i o t").
The kernel counts common subsequences of three letters, weighted down by the gaps they span, so a
unit with inserted, dropped or spaced letters stays close to the word it hides. Landmarks are the
units of three letters at least that tell the labels of the training texts apart, as far as that is significant. A text's kernel row is the largest
value that any of its units has with each landmark, that is, of its most telling sentence; the Nyström map of that row goes into a
linear machine that Spark's LinearSVC trains, and Platt's sigmoid makes its margin a score.

Only units that have most of a landmark's distinct letters are compared with it; the kernel of all
others is taken as 0, as are values under FLOOR. Each worker works a distinct unit out once.

Labels come from at most ``max_train`` labelled rows (a documented bound), chosen by a hash of doc_id
among those whose crc32(doc_id as text) mod 5 is not 0. Word statistics, landmarks and the machine
are learnt from these; every whole text is scored.

Defined results: null or empty text has no units and gets the machine's score for none; a null doc_id is not held
out and never labelled; null labels are no labels; repeated rows each get their row; without labels
of both kinds the score is the share of toxic labels (0 without any); other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, tidy

SUBSEQUENCE = 3
DECAY = 0.6
POWER = 3
FLOOR = 0.1
LANDMARKS = 96
MAX_TRAIN = 20_000
LENGTH = 24
#: Least log-likelihood ratio of a unit that tells the labels apart: chance 1 in 10,000 without any difference.
SIGNIFICANT = 15.14
#: Distinct tokens, and bytes of them, that a worker remembers before it starts anew.
CACHE_TOKENS, CACHE_BYTES = 400_000, 16 << 20

SPLIT_LETTERS = re.compile(r"(?<!\S)[^\W\d_](?:[\s.\-_*]{1,3}[^\W\d_]){2,}(?!\S)")
NOT_LETTERS = re.compile(r"[\W\d_]+")


def tokens_of(text: str | None) -> set[str]:
    low = (text or "").lower()
    found = set(low.split())
    found.update(m.group() for m in SPLIT_LETTERS.finditer(low))
    return found


def unit_of(token: str) -> str:
    return NOT_LETTERS.sub("", token)


def windows(unit: str) -> list[str]:
    """A unit in pieces of LENGTH letters, each half over the last."""
    return [unit[a : a + LENGTH] for a in range(0, max(1, len(unit) - LENGTH // 2), LENGTH // 2)] if len(unit) > LENGTH else [unit]


def codes(units: list[str], width: int, pad: int) -> np.ndarray:
    out = np.full((len(units), width), pad, np.int32)
    for k, u in enumerate(units):
        out[k, : len(u)] = np.frombuffer(u.encode("utf-32-le"), np.int32)
    return out


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Gap-weighted subsequence kernel of each row of a with the same row of b."""
    n, m = b.shape
    prefix = [np.ones((m + 1, n), np.float32)] + [np.zeros((m + 1, n), np.float32) for _ in range(SUBSEQUENCE - 1)]
    total = np.zeros(n, np.float32)
    columns = np.ascontiguousarray(b.T)
    for i in range(a.shape[1]):
        match = (columns == a[:, i]) * np.float32(DECAY * DECAY)
        total += (match * prefix[-1][:-1]).sum(0)
        for q in range(SUBSEQUENCE - 1, 0, -1):
            inner = np.zeros(n, np.float32)
            step = match * prefix[q - 1][:-1]
            prefix[q] *= np.float32(DECAY)
            for j in range(m):
                inner = inner * np.float32(DECAY) + step[j]
                prefix[q][j + 1] += inner
    return total


class Landmarks:
    def __init__(self, words: list[str]):
        self.words = words
        self.width = max(map(len, words), default=1)
        self.codes = codes(words, self.width, -1)
        self.norm = np.sqrt(kernel(codes(words, self.width, 0), self.codes))
        self.letters = [set(w) for w in words]
        self.alphabet = sorted(set().union(*self.letters))
        self.has = np.array([[c in s for c in self.alphabet] for s in self.letters], np.float32).reshape(len(words), -1)
        self.least = np.ceil(self.has.sum(1) * 2 / 3)

    def rows(self, units: list[str]) -> np.ndarray:
        """Kernel values of each unit with each landmark, to the power POWER, 0 below FLOOR."""
        out = np.zeros((len(units), len(self.words)), np.float32)
        pieces = [(k, w) for k, u in enumerate(units) if len(u) >= SUBSEQUENCE for w in windows(u)]
        for a in range(0, len(pieces), 20_000):
            part = pieces[a : a + 20_000]
            own = codes([w for _, w in part], LENGTH, 0)
            present = np.stack([(own == ord(c)).any(1) for c in self.alphabet], 1).astype(np.float32)
            unit, mark = np.nonzero(present @ self.has.T >= self.least)
            if not len(unit):
                continue
            size = (own > 0).sum(1)
            value = np.zeros(len(unit), np.float32)
            order = np.argsort(size[unit], kind="stable")
            for s in range(0, len(order), 8_000):  # short units don't pay for long ones
                at = order[s : s + 8_000]
                top = int(size[unit[at]].max())
                value[at] = kernel(own[unit[at], :top], self.codes[mark[at]])
            need = np.unique(unit)
            norm = np.ones(len(part), np.float32)
            for s in range(0, len(need), 8_000):
                at = need[s : s + 8_000]
                top = int(size[at].max())
                two = own[at, :top]
                norm[at] = np.sqrt(kernel(two, np.where(two > 0, two, -1)))
            value = (value / np.maximum(norm[unit] * self.norm[mark], 1e-9)) ** POWER
            value[value < FLOOR] = 0
            np.maximum.at(out, (np.array([k for k, _ in part])[unit], mark), value)
        return out


class Scanner:
    """Kernel rows of texts; remembers tokens."""

    def __init__(self, marks: Landmarks):
        self.marks, self.plain, self.telling, self.held = marks, set(), {}, 0

    def rows(self, texts: list[str | None]) -> np.ndarray:
        found = [tokens_of(t) for t in texts]
        new = set().union(*found).difference(self.plain, self.telling) if found else set()
        if len(self.plain) + len(self.telling) > CACHE_TOKENS or self.held > CACHE_BYTES:
            self.plain, self.telling, self.held = set(), {}, 0
            new = set().union(*found)
        fresh = list(new)
        self.held += sum(map(len, fresh))
        for a in range(0, len(fresh), 5_000):
            part = fresh[a : a + 5_000]
            values = self.marks.rows([unit_of(t) for t in part])
            some = values.any(1)
            self.telling.update((part[k], values[k].copy()) for k in np.flatnonzero(some))  # a view would keep the rows of all other tokens
            self.plain.update(t for t, s in zip(part, some, strict=True) if not s)
        out = np.zeros((len(texts), len(self.marks.words)), np.float32)
        for k, own in enumerate(found):
            for t in own.difference(self.plain):
                np.maximum(out[k], self.telling[t], out=out[k])
        return out


def training_rows(docs: DataFrame, labels: DataFrame, max_train: int) -> DataFrame:
    """label, text of at most max_train labelled rows that are not held out; the chosen ids are as bounded, so they are broadcast."""
    own = labels.filter("toxic is not null and doc_id is not null and crc32(cast(doc_id as string)) % 5 <> 0")
    chosen = own.select("doc_id", (F.col("toxic") > 0).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_train)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("label", "text")


def choose_landmarks(train: DataFrame, most: int) -> list[str]:
    """The units that toxic texts hold over three times as often as clean ones, as far as that is significant: ``most`` at most, the surest first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: tuple[Counter, Counter] = Counter(), Counter()
        for batch in batches:
            for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist(), strict=True):
                sums[label].update({u for u in map(unit_of, tokens_of(text)) if SUBSEQUENCE <= len(u) <= LENGTH})
        units = list(sums[0].keys() | sums[1].keys())
        yield pa.RecordBatch.from_pydict({"unit": pa.array(units, pa.string()), "clean": pa.array([sums[0][u] for u in units], pa.int64()), "toxic": pa.array([sums[1][u] for u in units], pa.int64())})

    sizes = train.groupBy("label").count().collect()
    n1 = sum(r["count"] for r in sizes if r["label"] == 1)
    n0 = sum(r["count"] for r in sizes if r["label"] == 0)
    if not n0 or not n1:
        return []
    both = train.mapInArrow(tidy(count), "unit string, clean long, toxic long").groupBy("unit").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    # the log-likelihood ratio of the table (with the unit or not) x (toxic or clean)
    term = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    n = float(n0 + n1)
    units = F.col("toxic") + F.col("clean")
    cells = [(F.col("toxic"), units, n1), (F.col("clean"), units, n0), (n1 - F.col("toxic"), n - units, n1), (n0 - F.col("clean"), n - units, n0)]
    ratio = 2 * sum((term(seen.cast("double"), own * size / n) for seen, own, size in cells), F.lit(0.0))
    top = both.filter("toxic >= 3").withColumn("ratio", ratio).filter((F.col("ratio") >= SIGNIFICANT) & (F.col("toxic") * n0 > 3 * F.col("clean") * n1))
    return [r["unit"] for r in top.orderBy(F.desc("ratio"), "unit").limit(most).collect()]


class Machine:
    """Landmarks, Nyström map, hyperplane, sigmoid."""

    def __init__(self, marks: Landmarks | None, weights: np.ndarray, bias: float, slope: float, offset: float):
        self.marks, self.weights, self.bias, self.slope, self.offset = marks, weights, bias, slope, offset

    def margin(self, rows: np.ndarray) -> np.ndarray:
        return rows @ self.weights + self.bias

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -40, 40)))


def platt(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the sigmoid, by Newton's method on softened targets."""
    high, low = (label.sum() + 1) / (label.sum() + 2), 1 / ((1 - label).sum() + 2)
    target, x, w = np.where(label > 0, high, low), np.stack([margin, np.ones_like(margin)], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (target - p) - 1e-3 * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def train_machine(docs: DataFrame, labels: DataFrame, *, max_train: int = MAX_TRAIN, n_landmarks: int = LANDMARKS) -> Machine:
    spark = docs.sparkSession
    train = training_rows(docs, labels, max_train)
    words = choose_landmarks(train, n_landmarks)
    if not words:
        share = train.agg(F.avg("label")).first()[0] or 0.0
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Machine(None, np.zeros(0), 0.0, 1.0, float(np.log(share / (1 - share))))
    marks = spark.sparkContext.broadcast(Landmarks(words))
    own = marks.value.rows(words).astype(np.float64)
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    nystrom = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 0.05))) @ vectors.T

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(marks.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                z = scanner.rows(part.column("text").to_pylist()).astype(np.float64) @ nystrom
                yield pa.RecordBatch.from_pydict({"label": part.column("label").cast(pa.float64()), "z": pa.array(list(z), pa.list_(pa.float64()))})

    # the points stay a table; the driver sees a label and a margin of each
    points = saved(train.mapInArrow(tidy(mapped), "label double, z array<double>"), "toxicity-points").select("label", array_to_vector("z").alias("features"))
    model = LinearSVC(maxIter=60, regParam=1e-3, standardization=False).fit(points)
    machine = Machine(marks.value, nystrom @ model.coefficients.toArray(), float(model.intercept), 1.0, 0.0)
    margins = model.transform(points).select("label", vector_to_array("rawPrediction")[1].alias("margin")).toArrow()
    machine.slope, machine.offset = platt(margins["margin"].to_numpy(), margins["label"].to_numpy())
    return machine


def toxicity_scores(docs: DataFrame, machine: Machine, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of each row of docs(doc_id, text), held_out, score, predicted. Texts alone go through Python."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def scores(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        scanner = Scanner(m.marks) if m.marks else None
        for column in columns:
            margin = np.zeros(len(column))
            for a in range(0, len(column) if scanner else 0, 500):
                margin[a : a + 500] = m.margin(scanner.rows(column.slice(a, 500).to_pylist()))
            yield pa.array(m.probability(margin))

    def returned(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from tidy(scores)(columns)

    score = F.arrow_udf(returned, "double").asNondeterministic()  # once per row, whatever is filtered later
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return docs.select(*keep, held.alias("held_out"), score("text").alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity_scores(docs, train_machine(docs, labels), ["doc_id"])
