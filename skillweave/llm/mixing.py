"""Mixing to target weights with soft membership.

A multinomial word model, learnt from a labelled table by grouped counts over all labelled rows, gives every
document posteriors over domains instead of one domain. Each document gets a nonnegative rate (its expected
number of copies) such that the expected tokens of each domain, summed over documents by their
posteriors, meet the target shares of the total. The rates solve a bounded least-squares problem by projected
gradient steps: one step needs the vector of domain totals under the present rates, a single
grouped sum over all documents; the step itself is the same expression for each document. So a document's
rate is a fold of its posteriors over the steps so far, worked out anew in each pass, and neither rates nor
gradients of documents are ever gathered: the driver sees K totals a step, and the K x K moment matrix of the documents
whose rates no bound holds, which scales the step.

Words are hashed into ``BUCKETS`` buckets, so the model is a table of fixed size. Posteriors use the
mean log likelihood per word times ``sharpness``, which keeps long texts from being all one domain.

Defined results: null or empty text has no words and gets the domains' prior; its token count is 0 and its rate 1; documents
with null doc_id count as unlabelled; labels that are null or name no document are ignored; without
labels every document has the one domain "all"; repeated rows are documents of their own; an empty
table gives an empty result. Targets need not sum to 1; a domain that they don't name has target 0.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved
from .textscan import SPACED, words

BUCKETS = 1 << 15
SHARPNESS = 4.0
STEPS = 40
TOLERANCE = 1e-6
#: Shares of tokens that miss their target by more are reported.
MISS = 1e-3


def bucket_counts(rows: DataFrame) -> DataFrame:
    """domain, bucket, n over rows(domain, text); tasks add up first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.array(batch.column("domain").to_pylist(), object)
            for found in words(batch.column("text"), SPACED):
                own = names[found.row : found.row + len(found.counts)]
                doc = np.repeat(np.arange(len(own)), found.counts)
                at = (found.hashes & np.uint64(BUCKETS - 1)).astype(np.int64)
                for name in set(own):
                    sums.setdefault(name, np.zeros(BUCKETS, np.int64))
                    sums[name] += np.bincount(at[(own == name)[doc]], minlength=BUCKETS)
        for name, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"domain": pa.array([name] * len(at), pa.string()), "bucket": pa.array(at, pa.int32()), "n": total[at]})

    return rows.mapInArrow(count, "domain string, bucket int, n long").groupBy("domain", "bucket").agg(F.sum("n").alias("n"))


class DomainModel:
    def __init__(self, domains: list[str], counts: np.ndarray, prior: np.ndarray, sharpness: float):
        """counts: words per domain and bucket; prior: share of documents of each domain."""
        self.domains, self.sharpness = domains, sharpness
        self.logp = np.log((counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * BUCKETS)).T.astype(np.float32)
        self.prior = np.log(np.maximum(prior, 1e-12))

    def posteriors(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        out, sizes = np.zeros((len(column), len(self.domains))), np.zeros(len(column), np.int64)
        for found in words(column, SPACED):
            n = found.counts
            rows = self.logp[(found.hashes & np.uint64(BUCKETS - 1)).astype(np.int64)]
            total = np.concatenate([np.zeros((1, rows.shape[1])), np.cumsum(rows, 0, dtype=np.float64)])
            mean = (total[found.first[1:]] - total[found.first[:-1]]) / np.maximum(n, 1)[:, None]
            out[found.row : found.row + len(n)] = mean * self.sharpness
            sizes[found.row : found.row + len(n)] = n
        out += self.prior
        out = np.exp(out - out.max(1, keepdims=True))
        return out / out.sum(1, keepdims=True), sizes


def learn_domains(docs: DataFrame, labelled: DataFrame, sharpness: float = SHARPNESS) -> DomainModel:
    """From labelled(doc_id, domain), all its rows."""
    own = labelled.filter("doc_id is not null and domain is not null").select("doc_id", F.col("domain").cast("string").alias("domain")).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    # the labelled table has no bound, so it is never broadcast: one plan at every size
    rows = docs.select("doc_id", "text").join(own.hint("merge"), "doc_id").select("domain", "text")
    sizes = {r["domain"]: r["count"] for r in own.groupBy("domain").count().collect()}
    domains = sorted(sizes) or ["all"]
    counts = np.zeros((len(domains), BUCKETS))
    if sizes:
        found = bucket_counts(rows).toPandas()  # domains x BUCKETS rows at most
        counts[[domains.index(d) for d in found["domain"]], found["bucket"]] = found["n"]
    prior = np.array([sizes.get(d, 1) for d in domains], float)
    return DomainModel(domains, counts, prior / prior.sum(), sharpness)


def with_posteriors(docs: DataFrame, model: DomainModel, keep: list[str]) -> DataFrame:
    """The columns ``keep``, n_tokens (words) and p, the posterior of each domain."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, *([] if "text" in keep else ["text"]))
    schema = rows.select(*keep, F.lit(0).cast("long").alias("mix_tokens"), F.array(F.lit(0.0)).alias("mix_p")).schema

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, n = shared.value.posteriors(batch.column("text"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(n), pa.array(list(p), pa.list_(pa.float64()))], [*keep, "mix_tokens", "mix_p"])

    return rows.mapInArrow(scan, schema)


def rate_column(steps: list[np.ndarray], low: float, high: float | None) -> Column:
    """A document's rate after the steps so far: a fold over them, clipped to its bounds at each."""
    high = float("inf") if high is None else high
    if not steps:
        return F.lit(min(max(1.0, low), high))
    table = F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in steps])
    dot = lambda s: F.aggregate(F.zip_with("mix_p", s, lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x)
    return F.aggregate(table, F.lit(min(max(1.0, low), high)), lambda r, s: F.greatest(F.lit(low), F.least(F.lit(high), r - dot(s))))


def fit_rates(rows: DataFrame, target: np.ndarray, *, low: float, high: float | None = None, budget: float | None = None) -> tuple[Column, np.ndarray, float]:
    """The rate of each row(mix_tokens, mix_p) as a column, the shares of domains that it reaches, and the token budget.

    budget: the total as a multiple of all tokens; by default the least that meets the targets when no domain
    may fall below ``low`` times what it has. Without ``high`` only the budget bounds the rates. Warns where the
    shares that are reached miss the target by more than MISS.
    """
    k = len(target)
    part = lambda i: F.element_at("mix_p", i + 1)
    sums = [F.sum("mix_tokens")] + [F.sum(F.col("mix_tokens") * part(i)) for i in range(k)] + [F.sum(F.col("mix_tokens") * part(i) * part(j)) for i in range(k) for j in range(k)]
    total, *rest = rows.agg(*sums).first()
    if not total:
        return rate_column([], low, high), np.zeros(k), 0.0
    have, moment = np.array(rest[:k]) / total, np.array(rest[k:]).reshape(k, k) / total
    target = target / target.sum()
    if budget is None:
        budget = float(max(low, np.max(np.where(target > 0, low * have / np.maximum(target, 1e-12), 0))))
    goal = budget * target
    steps: list[np.ndarray] = []
    best, best_error = 0, np.inf
    for n in range(STEPS + 1):
        rate = rate_column(steps, low, high)
        # the gradient needs the totals; its scale the moments of the rows whose rates no bound holds
        free = F.when((F.col("mix_r") > low) & (F.col("mix_r") < (float("inf") if high is None else high)), F.col("mix_tokens")).otherwise(0)
        given = rows.withColumn("mix_r", rate).withColumn("mix_w", F.col("mix_r") * F.col("mix_tokens"))
        found = given.agg(*[F.sum(F.col("mix_w") * part(i)) for i in range(k)], *[F.sum(free * part(i) * part(j)) for i in range(k) for j in range(k)]).first()
        now, inside = np.array(found[:k]) / total, np.array(found[k:]).reshape(k, k) / total
        error = float(np.abs(now - goal).max())
        if error < best_error - TOLERANCE:
            best, best_error, reached = n, error, now
        elif n - best >= 8:
            break
        if error < TOLERANCE:
            break
        scale = np.linalg.pinv(inside if np.linalg.matrix_rank(inside, 1e-9) == np.linalg.matrix_rank(moment, 1e-9) else moment, rcond=1e-6)
        steps.append(scale @ (now - goal))
    shares = reached / reached.sum()
    if np.abs(shares - target).max() > MISS:
        warnings.warn(f"the mix reaches shares {shares.round(6).tolist()} of the targets {target.round(6).tolist()}", stacklevel=2)
    return rate_column(steps[:best], low, high), shares, budget


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], keep: list[str], *, low: float = 0.0, high: float | None = None, budget: float | None = 1.0) -> tuple[DataFrame, dict[str, float]]:
    """The columns ``keep`` with mix_tokens, mix_p and mix_rate of every row, and the shares that are reached."""
    model = learn_domains(docs, labelled)
    rows = saved(with_posteriors(docs, model, [c for c in keep if c != "text"]), "mix-posteriors")
    target = np.array([targets.get(d, 0.0) for d in model.domains])
    if target.sum() <= 0:
        target = np.ones(len(target))
    rate, reached, _ = fit_rates(rows, target, low=low, high=high, budget=budget)
    if "text" in keep:  # texts are read again, not copied: posteriors follow from them alone
        rows = with_posteriors(docs, model, keep)
    return rows.withColumn("mix_rate", rate), dict(zip(model.domains, reached.tolist(), strict=True))


def sampled(rows: DataFrame, keep: list[str], key: str = "doc_id") -> DataFrame:
    """Each row as often as its rate says: the whole part, and one more with the probability of the rest, by a hash of ``key``. Rows are drawn
    independently where their keys differ, so a caller whose ids may be null or repeat gives a key of its own."""
    u = F.pmod(F.xxhash64(key, F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    times = F.floor(F.col("mix_rate") + u).cast("int")
    return rows.filter(times >= 1).select(*keep, F.explode(F.sequence(F.lit(1), times)).alias("mix_copy")).drop("mix_copy")


#: Shares of tokens that the query and the pipeline ask for, by the labels' quality.
TARGETS = {"quality=1": 0.9, "quality=0": 0.1}


def quality_labels(labels: DataFrame) -> DataFrame:
    return labels.filter("quality is not null").select("doc_id", F.concat(F.lit("quality="), F.col("quality").cast("string")).alias("domain"))


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows, _ = mix(docs, quality_labels(labels), TARGETS, ["doc_id"])
    return rows.select("doc_id", F.col("mix_tokens").alias("n_tokens"), F.round(F.element_at("mix_p", 1), 9).alias("p_low_quality"), F.round(F.element_at("mix_p", -1), 9).alias("p_high_quality"), F.round("mix_rate", 9).alias("rate"))
