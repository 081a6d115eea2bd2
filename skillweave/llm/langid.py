"""Language identification of web pages by Bayesian evidence fusion.

Four kinds of evidence meet in one posterior: the text (a naive Bayes model over character trigrams),
the language that the markup declares, the suffix of the address (top-level domain, and a language code
as a path part), and a prior for the host. The conditional tables of the declared language and of the
suffix, and the host priors, are grouped sums of soft assignments (text posteriors) over all pages.
Host priors are smoothed hierarchically: all pages, the registered domain, the host, each level shrunk
towards the one above with ``strength`` pseudo-pages; a page's own contribution is taken out of its host's.

The text model is fitted on at most ``max_train`` labelled documents (a documented bound), chosen by a
hash of doc_id; all pages count in the priors and all get a posterior. Sums by host combine
before the shuffle; the page side of the joins on hosts is split by adaptive execution, the other has a row per host.

Defined results: null html or url is an empty one; a page without text, declaration or host gets the prior over all pages;
null page_ids and repeated rows each get their row; without labelled documents the language is null; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved
from .textscan import LOWER, mix, slices

MAX_TRAIN = 4000
BUCKETS = 1 << 15
STRENGTH = 4.0
#: The text's log likelihood is tempered: trigrams overlap and are no independent evidence.
TEMPER = 0.3
LONGEST_EVIDENCE = 30.0


def trigram_buckets(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A bucket for each byte trigram inside a document, and the document of each."""
    data = LOWER[raw].astype(np.uint64)
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = data[:-2] << np.uint64(16) | data[1:-1] << np.uint64(8) | data[2:]
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = doc[:-2] == doc[2:]
    return (mix(code[inside]) & np.uint64(BUCKETS - 1)).astype(np.int64), doc[:-2][inside]


def visible_text(html: Column) -> Column:
    """Text without scripts, styles, comments and tags."""
    body = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(body, r"<[^>]*>", " ")


class TextModel:
    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        self.logp = np.log((counts + 0.2) / (counts.sum(1, keepdims=True) + 0.2 * BUCKETS)).T

    def log_likelihoods(self, column: pa.Array) -> np.ndarray:
        out = np.zeros((len(column), len(self.langs)))
        for row, raw, offsets in slices(column):
            at, doc = trigram_buckets(raw, offsets)
            for k in range(len(self.langs)):
                out[row : row + len(offsets) - 1, k] = np.bincount(doc, self.logp[at, k], len(offsets) - 1)
        return np.maximum((out - out.max(1, keepdims=True)) * TEMPER, -LONGEST_EVIDENCE) if len(self.langs) else out


def fit_text_model(docs: DataFrame, max_train: int = MAX_TRAIN) -> TextModel:
    """From at most max_train documents(doc_id, lang, text); the ids are as bounded, so they are broadcast."""
    chosen = docs.filter("lang is not null and doc_id is not null").select("doc_id", "lang").orderBy(F.xxhash64("doc_id"), "doc_id", "lang").limit(max_train)
    train = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.array(batch.column("lang").to_pylist(), object)
            for row, raw, offsets in slices(batch.column("text")):
                at, doc = trigram_buckets(raw, offsets)
                own = names[row : row + len(offsets) - 1]
                for name in set(own):
                    sums.setdefault(name, np.zeros(BUCKETS, np.int64))
                    sums[name] += np.bincount(at[(own == name)[doc]], minlength=BUCKETS)
        for name, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(at), pa.string()), "bucket": pa.array(at, pa.int32()), "n": total[at]})

    found = train.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found["lang"].unique())
    counts = np.zeros((len(langs), BUCKETS))
    counts[[langs.index(x) for x in found["lang"]], found["bucket"]] = found["n"]
    return TextModel(langs, counts)


def vector(f, k: int) -> Column:
    return F.array(*[f(i) for i in range(k)])


def normalised(weights: Column) -> Column:
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    return F.transform(weights, lambda x: x / total)


def table_of(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """Sums of the text posteriors by some columns: s, an array."""
    sums = rows.groupBy(*by).agg(*[F.sum(F.element_at("text_p", i + 1)).alias(f"s{i}") for i in range(k)])
    return sums.select(*by, vector(lambda i: F.col(f"s{i}"), k).alias("s"))


def identify(pages: DataFrame, docs: DataFrame, *, max_train: int = MAX_TRAIN, strength: float = STRENGTH) -> DataFrame:
    """page_id, host, declared, text_lang, lang, posterior of each row of pages(page_id, url, html)."""
    model = fit_text_model(docs, max_train)
    langs, k = model.langs, len(model.langs)
    host = F.lower(F.coalesce(F.regexp_extract("url", r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))
    declared = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})\b", 1))
    path_code = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"(?i)^[a-z][a-z0-9+.-]*://[^/]+/([a-z]{2})(?:[/?#-]|$)", 1))
    rows = pages.select("page_id", host.alias("host"), declared.alias("declared"), path_code.alias("path_code"), visible_text(F.col("html")).alias("text"))
    if not k:
        none = F.lit(None)
        return rows.select("page_id", "host", "declared", none.cast("string").alias("text_lang"), none.cast("string").alias("lang"), none.cast("double").alias("posterior"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "page_id long, host string, declared string, path_code string, log_text array<double>"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                ll = shared.value.log_likelihoods(part.column("text"))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("page_id", "host", "declared", "path_code")), pa.array(list(ll), pa.list_(pa.float64()))], ["page_id", "host", "declared", "path_code", "log_text"])

    names = F.array(*[F.lit(x) for x in langs])
    known = lambda c: F.when(F.col(c).isin(langs), F.col(c)).otherwise(F.when(F.col(c) == "", F.lit("none")).otherwise(F.lit("other")))
    label = F.split("host", r"\.")
    domain = F.when(F.size(label) >= 2, F.concat_ws(".", F.element_at(label, -2), F.element_at(label, -1))).otherwise(F.col("host"))
    scored = rows.withColumn("page_id", F.col("page_id").cast("long")).mapInArrow(scan, schema)
    scored = scored.select("page_id", "host", domain.alias("domain"), "declared", known("declared").alias("mark"), F.concat_ws("/", F.element_at(label, -1), known("path_code")).alias("suffix"), "log_text", normalised(F.transform("log_text", lambda x: F.exp(x))).alias("text_p"))
    rows = saved(scored, "page-evidence")

    everything = rows.agg(*[F.sum(F.element_at("text_p", i + 1)) for i in range(k)]).first()
    total = np.array([x or 0.0 for x in everything]) + 0.5
    base = total / total.sum()
    at = lambda c, i: F.element_at(c, i + 1)
    size = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    # P(mark | language) and P(suffix | language): marks are a closed set, suffixes a table
    marks = table_of(rows, ["mark"], k).select("mark", vector(lambda i: F.log((at("s", i) + 0.1) / F.lit(float(total[i] + 0.1 * (k + 2)))), k).alias("log_mark"))
    suffixes = table_of(rows, ["suffix"], k).select("suffix", vector(lambda i: F.log((at("s", i) + strength * float(base[i])) / (size(F.col("s")) + strength)) - F.lit(float(np.log(base[i]))), k).alias("log_suffix"))
    hosts = table_of(rows, ["domain", "host"], k)
    domains = hosts.groupBy("domain").agg(*[F.sum(at("s", i)).alias(f"s{i}") for i in range(k)]).select("domain", vector(lambda i: F.col(f"s{i}"), k).alias("d"))
    joined = rows.join(marks, "mark", "left").join(suffixes, "suffix", "left").join(hosts.join(domains, "domain"), ["domain", "host"], "left")
    # a page's own text isn't evidence about itself: it leaves the sums of its host and domain
    less = lambda c: vector(lambda i: F.greatest(at(c, i) - at("text_p", i), F.lit(0.0)), k)
    joined = joined.withColumn("s", less("s")).withColumn("d", less("d"))
    joined = joined.withColumn("dp", vector(lambda i: (at("d", i) + strength * float(base[i])) / (size(F.col("d")) + strength), k))
    joined = joined.withColumn("prior", vector(lambda i: (at("s", i) + strength * at("dp", i)) / (size(F.col("s")) + strength), k))
    score = joined.withColumn("score", vector(lambda i: at("log_text", i) + at("log_mark", i) + at("log_suffix", i) + F.log(at("prior", i)), k))
    top = F.array_max("score")
    score = score.withColumn("p", normalised(F.transform("score", lambda x: F.exp(x - top))))
    best = lambda c: F.element_at(names, F.array_position(F.col(c), F.array_max(c)).cast("int"))
    return score.select("page_id", "host", "declared", best("text_p").alias("text_lang"), best("p").alias("lang"), F.round(F.array_max("p"), 6).alias("posterior"))


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/documents.parquet"))
