"""The corpus operators against brute force, exact round trips and held-out labels, on small tables with awkward rows."""

import collections
import re
import sys
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from conftest import DATA, table
from pyspark.sql import functions as F

from skillweave.llm import chat, decontaminate, exactdedup, langid, mixing, ngramjoin, ppm, queries, tokenbin, toxicity, warc
from skillweave.llm.textscan import ALNUM, SPACED, words

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = str.maketrans(UPPER, UPPER.lower())
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
#: Nulls, empty and blank texts, repeats, clashing columns, a very long text, odd spaces and signs.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs far away", "en"), (2, "the QUICK brown fox jumps over the lazy dog and runs far away", None), (3, None, "en"), (4, "", ""),
    (5, "   \n\t ", "de"), (6, LONG, "de"), (6, LONG, "de"), (None, "orphan text of no id at all", None), (7, "a\xa0b  c\n\n d <|endoftext|> Ünï", "fr"), (8, "one two", "en"), (9, LONG + " extra words", "de"), (10, "!!! ... ???", "en"),
]
SCHEMA = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    return rows.withColumn("n", F.lit(1)).withColumn("digest", F.lit("x")).withColumn("row", F.lit(2)).withColumn("cid", F.lit(3)).withColumn("h", F.lit(4))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def frame():
    return pd.read_parquet(f"{DATA}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    assert table(queries.QUERIES[name](spark, DATA).toPandas()) == table(duck.execute(queries.ORACLE_SQL[name]).df())


@pytest.mark.parametrize(("alphabet", "pattern"), [(SPACED, r"[^\x20\x09-\x0D]+"), (ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")])
def test_words_equal_the_pattern(alphabet, pattern):
    texts = [t for _, t, _ in ROWS]
    got, seen = [], {}
    for found in words(pa.array(texts, pa.string()), alphabet):
        for a, b in zip(found.first[:-1], found.first[1:], strict=True):
            got.append([found.text(k, k + 1) for k in range(a, b)])
            for k in range(a, b):
                assert seen.setdefault(got[-1][k - a], found.hashes[k]) == found.hashes[k]
    assert got == [re.findall(pattern, (t or "").translate(ASCII_LOWER)) for t in texts]
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("width", [1, 7, 16, 17, 31, 32])
def test_bits_round_trip(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1000, dtype=np.uint64)
    data = tokenbin.pack(ids, width)
    assert len(data) == 16 * width * 8 and (tokenbin.unpack(data, width, 1000) == ids).all()


def encoded(texts):
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(tokenbin.default_tokenizer())
    return [np.array([*x.ids, 2], "<u4") for x in fresh.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_token_files_hold_every_id(spark, odd, tmp_path):
    manifest = tokenbin.write_token_ids(odd, f"file://{tmp_path}/t")
    got = tokenbin.read_token_ids(manifest).orderBy("start").collect()
    ordered = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    for row, (doc_id, _, _), ids in zip(got, ordered, encoded([r[1] for r in ordered]), strict=True):
        assert (row["doc_id"], row["start"], row["n_tokens"], row["ids_crc32"]) == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_random_access(spark, docs, frame, tmp_path):
    manifest = tokenbin.write_token_ids(docs, f"file://{tmp_path}/t").collect()
    reader = tokenbin.ShardReader(manifest[0]["path"])
    k = len(reader.counts) // 2
    text = frame.loc[frame.doc_id == reader.doc_ids[k], "text"].iloc[0]
    assert (reader.document(k) == encoded([text])[0]).all()


def test_encoder_cuts_change_nothing():
    texts = ["", " ", " a", "a ", "a  b", "it's  don't we're", "a\n b", "a \nb", "x <|endoftext|> y", "x<|endoftext|>", "a <|endoftext|><|endoftext|>b c", "<|endoftext", "café's, 12,3.4 x!!! ...", "日本語 テスト, ok. 　x", "'s 's a's", "wörd! wörd.,;", "é éx, ab", "\x1c a \x1f b"]
    code = tokenbin.Encoder(tokenbin.default_tokenizer())
    assert [x.tolist() for x in code.encode(texts)] == [x.tolist()[:-1] for x in encoded(texts)]


def test_encoder_of_another_kind_of_vocabulary(tmp_path):
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

    own = Tokenizer(models.WordLevel({"a": 0, "b": 1, "?": 2}, unk_token="?"))
    own.normalizer, own.pre_tokenizer = normalizers.Lowercase(), pre_tokenizers.Whitespace()
    own.save(f"{tmp_path}/own.json")
    assert [x.tolist() for x in tokenbin.Encoder(f"{tmp_path}/own.json").encode(["A b c", "", "b"])] == [[0, 1, 2], [], [1]]


def test_warc_round_trip_and_determinism(spark, tmp_path):
    pages = [(1, "http://a.example/x", "<p>same</p>"), (2, None, "<p>same</p>"), (3, "http://b.example/ z", None), (4, "u", ""), (5, "u5", "é" * 50_000), (5, "u5", "é" * 50_000), (None, "u", "<p>same</p>"), (9, "v", "alone")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("kind", F.lit(5)).withColumn("digest", F.lit("x"))
    first, second = (warc.write_warc(df, f"file://{tmp_path}/{k}", roll_mb=1) for k in "ab")
    sums = lambda m: sorted((r["shard"], r["seq"], r["sha1"]) for r in m.collect())
    assert sums(first) == sums(second)
    got = {(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.read_warc(first).collect()}
    n = len("<p>same</p>")
    assert got == {(1, "revisit", 2, n), (2, "response", None, n), (None, "revisit", 2, n), (3, "revisit", 4, 0), (4, "response", None, 0), (5, "response", None, 100_000), (9, "response", None, 5)}
    assert warc.read_warc(warc.write_warc(df.limit(0), f"file://{tmp_path}/none")).count() == 0


def test_warc_bytes_follow_from_the_rows_alone(spark, tmp_path):
    import random

    rng = random.Random(5)
    body = lambda n: "".join(rng.choices("abcdefghijklmnop <>", k=n))
    ids = [*range(200), *(10**15 + 7 * k for k in range(60)), -5, None]
    pages = [(i, f"http://h{i}/", body(rng.choice([10, 3000, 9000])) if k % 5 else "same") for k, i in enumerate(ids)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    first, second = (warc.write_warc(df.repartition(n), f"file://{tmp_path}/{n}", roll_mb=1 / 128, shard_mb=1 / 16).collect() for n in (2, 5))
    assert sorted((r["shard"], r["seq"], r["n_records"], r["sha1"]) for r in first) == sorted((r["shard"], r["seq"], r["n_records"], r["sha1"]) for r in second)
    assert len({r["shard"] for r in first}) > 5 and max(r["seq"] for r in first) > 1
    assert sum(r["n_records"] for r in first) == len(pages)


def test_shards_hold_about_the_goal_wherever_ids_lie(spark):
    sizes = [(k, 10) for k in range(1000)] + [(2**62 + k, 10) for k in range(1000)] + [(-(2**62), 10), (7, 5000)]
    starts = warc.shard_starts(spark.createDataFrame(sizes, "page_id long, size long"), 500)
    held = np.bincount(np.searchsorted(np.array(starts), [i for i, _ in sizes], "right"), [n for _, n in sizes])
    assert sorted(held)[-1] <= 5500 and sorted(held)[-2] <= 500 and len(held) < 100


def brute_force_hits(texts, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(ASCII_LOWER))
    windows = collections.defaultdict(set)
    for k, t in items:
        w = cut(t)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(str(k))
    for t in texts:
        w, hit, found = cut(t), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if own := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= own
        yield len(w), len(hit), len(found)


def test_decontamination_equals_brute_force(spark, odd, empty):
    items = [(1, "fox jumps over the lazy dog and runs far away"), (2, "brown FOX, jumps over... the lazy dog and runs far away"), (3, "one two"), (4, "two"), (5, None), (6, "..."), (7, " ".join(LONG.split()[500:530])), (8, " ".join(LONG.split()[500:530]))]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("h", F.lit(1))
    got = decontaminate.decontaminate(odd, bench).collect()
    want = [(r[0], *x) for r, x in zip(ROWS, brute_force_hits([r[1] for r in ROWS], items), strict=True)]
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"]) for r in got), key=str) == sorted(want, key=str)
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert decontaminate.decontaminate(odd, bench.limit(0)).filter("contaminated").count() == 0


def shingle_components(rows):
    sets = []
    for _, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(ASCII_LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and find(i) != find(j):
                root[find(i)] = find(j)
    ids = collections.defaultdict(list)
    for i, r in enumerate(rows):
        ids[find(i)].append(r[0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return sorted(((r[0], len(sets[i]), least[find(i)] if sets[i] else r[0]) for i, r in enumerate(rows)), key=str)


def near_copies():
    """Chains and clouds of near copies with one hot passage, large enough for blocks of postings."""
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(80)]
    passage = " ".join(f"p{i}" for i in range(30))
    rows = []
    for k in range(90):
        own = list(base)
        for i in rng.integers(0, 80, rng.integers(0, 4)):
            own[i] = f"z{rng.integers(1000)}"
        rows.append((1000 + k, " ".join(own), None))
    for k in range(60):
        rows.append((3000 + k, passage + " " + " ".join(f"u{rng.integers(100000)}" for _ in range(60)), None))
    chain = [f"c{i}" for i in range(60)]
    for k in range(12):
        chain = chain[:]
        chain[5 * k % 60] = f"y{k}"
        rows.append((2000 + k, " ".join(chain), None))
    return rows


def test_jaccard_components_equal_brute_force(spark, odd, empty, monkeypatch):
    for rows, df in ((ROWS, odd), (near_copies(), spark.createDataFrame(near_copies(), SCHEMA).repartition(4))):
        got = ngramjoin.jaccard_components(df).collect()
        assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == shingle_components(rows)
    assert ngramjoin.jaccard_components(empty).count() == 0


def test_exact_dedup_of_awkward_rows(spark, odd, empty):
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exactdedup.exact_dedup(odd).collect()}
    assert {(1, 2, 2, False), (2, 2, 2, True), (3, 4, 2, False), (4, 4, 2, True), (6, 6, 2, True), (None, None, 1, True)} <= got
    assert exactdedup.exact_dedup(empty).count() == 0


@pytest.mark.parametrize("bits", [64, 1 << 24])
def test_a_full_filter_changes_nothing(spark, monkeypatch, bits):
    monkeypatch.setattr(exactdedup, "FILTER_BITS", bits)
    df = spark.createDataFrame([(i, f"Text {i % 90}" if i < 120 else f"alone {i}", None) for i in range(300)], SCHEMA)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exactdedup.exact_dedup(df, memtables=3).collect()}
    assert got == {i: ((i + 90 if i < 30 else i), 2 if i < 30 or 90 <= i < 120 else 1) for i in range(300)}


def test_index_takes_more_runs(spark, tmp_path):
    rows = exactdedup.keyed(spark.createDataFrame([(i, f"t{i % 7}", None) for i in range(50)], SCHEMA)).select("doc_id", "digest")
    index = exactdedup.DigestIndex(spark, f"file://{tmp_path}/i", fan_in=2)
    index.flush(rows.filter("doc_id < 20"), 3)
    index.flush(rows.filter("doc_id >= 20"), 3)
    merged = index.compact().collect()
    assert len(index.runs) == 1 and sorted((r["min_id"], r["n"]) for r in merged) == [(k, len(range(k, 50, 7))) for k in range(7)]


def test_unigram_base_equals_brute_force(spark, docs, frame):
    got = ppm.lm_scores(docs).toPandas().set_index("doc_id").sort_index()
    frame = frame.sort_values("doc_id")
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", t.translate(ASCII_LOWER)), None] for t in frame.text]
    held = np.array([zlib.crc32(str(i).encode()) % 10 == 0 for i in frame.doc_id])
    c = collections.Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    n, v = sum(c.values()), len(c)
    assert (got.held_out == held).all() and (got.train_tokens == n).all()
    assert list(got.n_known) == [sum(c[w] > 0 for w in t) for t in tokens]
    assert np.allclose(got.base_score, [sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t) for t in tokens])


def brute_force_ppm(train, text, order=ppm.ORDER):
    seen = collections.defaultdict(collections.Counter)  # context -> symbols
    as_bytes = lambda t: b"\xff" * order + (t or "").translate(ASCII_LOWER).encode() + b"\xff"
    for t in map(as_bytes, train):
        for i in range(order, len(t)):
            for k in range(order + 1):
                seen[t[i - k : i]][t[i]] += 1
    score, data = 0.0, as_bytes(text)
    for i in range(order, len(data)):
        out = set()  # symbols of longer contexts
        for k in range(order, -1, -1):
            counts = {s: n for s, n in seen[data[i - k : i]].items() if s not in out}
            if not counts:
                continue
            total = sum(counts.values())
            if data[i] in counts:
                score += np.log10((counts[data[i]] - 0.5) / total)
                break
            score += np.log10(len(counts) / 2 / total)
            out |= set(counts)
        else:
            score -= np.log10(max(1, 256 - len(seen[b""])))
    return score


@pytest.mark.parametrize("cached", [0, 50, 1 << 20])
def test_lm_scores_equal_brute_force_at_every_cache_size(spark, cached):
    texts = [f"the {a} {b} of {c}" for a in ("quick", "lazy", "brown") for b in ("fox", "dog", "jumper") for c in ("yore", "old", "THE QUIZ")] + ["the the the the", "zq# \xe9\xff", "", None, "quack 7 foxes"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "no id"), (3, "the repeated")]
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    train = [t for (_, t), h in zip(rows, held, strict=True) if not h]
    assert any(held)
    got = ppm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), frequent_grams=cached).collect()
    want = sorted((str(i), brute_force_ppm(train, t)) for i, t in rows)
    assert np.allclose([s for _, s in sorted((str(r["doc_id"]), r["score"]) for r in got)], [s for _, s in want], rtol=0, atol=1e-9)


def test_lm_keeps_every_context(spark):
    """More contexts of full length than a model of 65,536 per order can hold."""
    import random

    rng = random.Random(3)
    train = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=400)) for _ in range(250)]
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10][:250]
    docs = spark.createDataFrame(list(zip(ids, train, strict=True)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["score"] for r in ppm.lm_scores(docs).collect()}
    assert all(abs(got[i] - brute) < 1e-2 for i, brute in zip(ids[:2], [brute_force_ppm(train, t) for t in train[:2]], strict=True))


def test_lm_of_awkward_rows(spark, odd, empty):
    got = ppm.lm_scores(odd).collect()
    assert len(got) == len(ROWS) and all(r["score"] < 0 for r in got)
    assert ppm.lm_scores(empty).count() == 0


def test_toxicity_on_held_out_labels_and_gapped_words(spark):
    big = DATA.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    machine = toxicity.train_machine(docs, labels)
    got = toxicity.toxicity_scores(docs, machine, ["doc_id"]).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.predicted == held.toxic).mean() > 0.9
    hidden = spark.createDataFrame([(1, "you are an i d i o t and a l-o-s-e-r", ""), (2, "you idxiot, you stuupid clo.wn", ""), (3, "and the other one of them", ""), (4, None, ""), (5, "", "")], SCHEMA)
    score = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(hidden, machine, ["doc_id"]).collect()}
    assert min(score[1], score[2]) > 0.5 > max(score[3], score[4], score[5])


def slow_kernel(s, t, p=toxicity.SUBSEQUENCE, d=toxicity.DECAY):
    import itertools

    spans = lambda x: [(tuple(x[i] for i in at), at[-1] - at[0] + 1) for at in itertools.combinations(range(len(x)), p)]
    return sum(d ** (a + b) for u, a in spans(s) for w, b in spans(t) if u == w)


def test_kernel_equals_its_definition():
    pairs = [("idiot", "idxiot"), ("scum", "scum"), ("abcabc", "bca"), ("loser", "moron")]
    width = max(len(a) for a, _ in pairs), max(len(b) for _, b in pairs)
    pairs_a = toxicity.codes([b for _, b in pairs], width[1], 0)
    pairs_b = toxicity.codes([a for a, _ in pairs], width[0], -1)
    assert np.allclose(toxicity.kernel(pairs_a, pairs_b), [slow_kernel(a, b) for a, b in pairs], rtol=1e-4)


def test_toxicity_without_labels(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["predicted"] for r in toxicity.toxicity_scores(odd, toxicity.train_machine(odd, none), ["doc_id"]).collect()} == {0}


def test_mixing_meets_its_targets(spark, odd, empty):
    big = DATA.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    for options in ({"budget": 1.0}, {"low": 1.0, "high": 4.0, "budget": None}):
        rows, reached = mixing.mix(docs, mixing.quality_labels(labels), mixing.TARGETS, ["doc_id"], **options)
        assert all(abs(reached[d] - share) < 1e-3 for d, share in mixing.TARGETS.items())
        p = rows.select("mix_tokens", "mix_p", "mix_rate").toPandas()
        tokens = (p.mix_rate * p.mix_tokens).to_numpy() @ np.stack(p.mix_p.to_numpy())
        assert np.allclose(tokens / tokens.sum(), [reached[d] for d in sorted(reached)], atol=1e-6)
        assert p.mix_rate.min() >= options.get("low", 0)
    none = spark.createDataFrame([], "doc_id long, domain string")
    rows, _ = mixing.mix(odd, none, {"all": 1.0}, ["doc_id"])
    assert rows.count() == len(ROWS) and rows.filter("abs(mix_rate - 1) > 1e-6").count() == 0
    assert mixing.mix(empty, none, {}, ["doc_id"])[0].count() == 0


@pytest.mark.parametrize("options", [{"low": 1.0, "budget": None}, {"budget": 1.0}])
def test_mixing_meets_targets_far_from_the_given_shares(spark, options):
    n = 200
    rows = [(i, "good fine prose about rivers " * 4 if i % 20 == 0 else "spam click buy cheap pills " * 4) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, f"quality={int(i % 20 == 0)}") for i in range(n)], "doc_id long, domain string")
    got, reached = mixing.mix(docs, labels, mixing.TARGETS, ["doc_id"], **options)
    assert all(abs(reached[d] - share) < 1e-3 for d, share in mixing.TARGETS.items())
    assert got.agg(F.max("mix_rate")).first()[0] > 8
    with pytest.warns(UserWarning, match="the mix reaches"):
        mixing.mix(docs, labels, mixing.TARGETS, ["doc_id"], low=1.0, high=4.0, budget=None)


def test_language_of_pages(spark, docs):
    rows = [(1, "http://a.example.com/en/1", '<html lang="en"><p>the of and with that</p>'), (2, "http://a.example.com/de/2", "<html><p>der die und nicht ist mit</p>"), (3, None, None), (4, "junk", ""), (4, "junk", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("lang", F.lit("x"))
    got = {r["page_id"]: r for r in langid.identify(pages, docs).collect()}
    assert got[1]["lang"] == "en" and got[2]["lang"] == "de" and got[3]["lang"] is not None
    assert langid.identify(pages, docs.limit(0)).filter("lang is not null").count() == 0
    assert langid.identify(pages.limit(0), docs).count() == 0


def test_chat_in_blocks_equals_one_block(spark, monkeypatch):
    turns = [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t}") for c, n in ((1, 9), (2, 5), (3, 9), (4, 3)) for t in range(n)]
    turns += [(5, 0, None, None), (5, 1, "user", "x"), (5, 1, "user", "x"), (None, 0, "user", "lost"), (6, None, "user", "first"), (6, 3, "user", "last")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("pos", F.lit(1))
    whole = {r["conv_id"]: (r["n_turns"], r["copies"], r["text"]) for r in chat.render(chat.collapse(df)).collect()}
    assert {k: v[:2] for k, v in whole.items()} == {1: (9, 2), 5: (3, 1), 6: (2, 1)}
    monkeypatch.setattr(chat, "BLOCK", 2)
    parts = chat.render(chat.collapse(df)).orderBy("conv_id", "segment").collect()
    assert {k: "".join(r["text"] for r in parts if r["conv_id"] == k) for k in whole} == {k: v[2] for k, v in whole.items()}


def test_pipeline_stages_equal_their_definitions(spark, duck):
    sys.path.insert(0, str(queries.__file__).split("/skillweave/")[0])
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = [n for n, _ in cp.STAGES]
    assert names == ["toxicity", "ngram_jaccard", "decontamination", "mixing", "token_ids"]
    frame = pd.read_parquet(f"{DATA}/documents.parquet")
    rows = list(zip(frame.doc_id, frame.text, frame.lang, strict=True))
    kept = {r["doc_id"] for r in cp.drop_near_duplicates(spark, docs, DATA).collect()}
    assert kept == {c for _, _, c in shingle_components(rows)}
    leaks = {r[0] for r in duck.execute(queries.ORACLE_SQL["op5_decontamination"]).fetchall() if r[-1]}
    assert {r["doc_id"] for r in cp.drop_leaks(spark, docs, DATA).collect()} == set(frame.doc_id) - leaks
    mixed = cp.mix_sources(spark, docs, DATA)
    assert mixed.columns == cp.COLUMNS and {r["doc_id"] for r in mixed.select("doc_id").collect()} == set(frame.doc_id)
    out = cp.run(spark, DATA).toPandas()
    assert len(out) and set(out.doc_id) <= kept - leaks and out.start.is_unique


def test_stages_decide_on_each_row_whatever_its_id(spark, tmp_path):
    import corpus_pipeline as cp

    words_of = lambda p, n=60: " ".join(f"{p}{i}" for i in range(n))
    leak = words_of("leak", 12)
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    make = lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    texts = lambda df: sorted((str(r["doc_id"]), r["text"]) for r in df.collect())
    clean = words_of("clean", 20)
    rows = make([(None, "x " + leak), (None, clean), (5, leak + " y"), (5, clean)])
    rows.withColumn("row_key", F.lit(1)).withColumn("digest", F.lit("x")).write.parquet(f"{tmp_path}/leaky")
    for form in (rows, spark.read.parquet(f"{tmp_path}/leaky")):
        assert texts(cp.drop_leaks(spark, form, str(tmp_path))) == [("5", clean), ("None", clean)]
    a, b, c = words_of("a"), words_of("b"), words_of("c")
    rows = make([(1, a), (1, a), (None, a + " more"), (2, b), (3, b), (3, c), (None, "no ids " + c[::-1]), (None, "no ids " + c[::-1]), (4, "")])
    assert texts(cp.drop_near_duplicates(spark, rows, str(tmp_path))) == sorted([("1", a), ("2", b), ("3", c), ("None", "no ids " + c[::-1]), ("4", "")])


def test_rows_are_drawn_one_by_one_whatever_their_ids(spark):
    rows = spark.range(2000).select(F.when(F.col("id") < 1000, F.lit(7)).cast("long").alias("doc_id"), F.col("id").alias("row_key"), F.lit(1.5).alias("mix_rate"))
    got = {r.doc_id: r.n for r in mixing.sampled(rows, ["doc_id"], "row_key").groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert set(got) == {7, None} and all(1430 < n < 1570 for n in got.values())


def test_stages_of_an_empty_table_and_of_awkward_rows(spark, tmp_path):
    import corpus_pipeline as cp

    kinds = "doc_id long, text string, lang string, source string, n_chars long, row_key int"
    labels = spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(12)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "never said by any text of these here at all my friend")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], kinds).write.parquet(f"{tmp_path}/none")
    spark.createDataFrame([(i, t, None, "s", 3, 1) for i, t, _ in ROWS], kinds).write.parquet(f"{tmp_path}/odd")
    for name, n in (("none", 0), ("odd", len(ROWS))):
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        for stage in (cp.drop_toxic, cp.drop_leaks, cp.mix_sources):
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == cp.COLUMNS and out.count() >= n
        assert cp.drop_near_duplicates(spark, docs, str(tmp_path)).count() == (n and len({c for _, _, c in shingle_components(ROWS)} | {3, 4, 5}))
        assert cp.write_tokens(spark, docs, str(tmp_path)).count() == n


@pytest.mark.parametrize("targets", [{"quality=0": 0.5, "quality=1": 0.5}, {"quality=0": 0.8, "quality=1": 0.2}])
def test_rates_equal_a_bounded_solver(spark, targets):
    """Rates are those nonnegative ones that are nearest to 1 and meet the targets: a brute-force solver by bisection on the multipliers' line."""
    n = 120
    rows = [(i, "good fine prose about rivers " * (1 + i % 5) if i % 4 else "spam click buy cheap pills " * (1 + i % 3)) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, f"quality={int(i % 4 > 0)}") for i in range(0, n, 2)], "doc_id long, domain string")
    got, reached = mixing.mix(docs, labels, targets, ["doc_id"])
    found = got.select("mix_tokens", "mix_p", "mix_rate").toPandas()
    p, tokens = np.stack(found.mix_p.to_numpy()), found.mix_tokens.to_numpy().astype(float)
    goal = np.array([targets[d] for d in sorted(targets)]) * tokens.sum()
    low, high = np.full(2, -50.0), np.full(2, 50.0)
    for _ in range(200):  # r = max(0, 1 - p y); totals fall in each y: alternate bisection
        for k in range(2):
            a, b = -50.0, 50.0
            for _ in range(60):
                y = (low + high) / 2
                y[k] = (a + b) / 2
                a, b = (y[k], b) if (np.maximum(0, 1 - p @ y) * tokens) @ p[:, k] > goal[k] else (a, y[k])
            low[k] = high[k] = (a + b) / 2
    best = np.maximum(0, 1 - p @ low)
    assert np.allclose((best * tokens) @ p, goal, rtol=1e-3) and np.allclose(found.mix_rate, best, atol=2e-2)


def test_items_without_id_count_as_windows(spark):
    text = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, "so " + text), (2, "short thing"), (3, "clean " * 12)], "doc_id long, text string")
    items = spark.createDataFrame([(None, text), (None, "short thing"), (7, "short thing")], "item_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["n_items"], r["contaminated"]) for r in decontaminate.decontaminate(docs, items).collect()}
    assert got == {1: (12, 0, True), 2: (2, 1, True), 3: (0, 0, False)}
