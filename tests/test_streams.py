"""Streams in several micro-batches: merging with a replay, late rows, timers."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from skillweave.streaming import ingest, merge

COLUMNS = "id string, posting string, body string, observed_on date"


def postings(seed, n=36):
    """Bodies in groups that differ by a word or not at all, over few postings and days."""
    rng = random.Random(seed)
    words = [f"word{k}" for k in range(400)]
    bases = [rng.sample(words, 60) for _ in range(9)]
    rows = []
    for k in range(n):
        body = list(rng.choice(bases))
        if rng.random() < 0.6:
            body[rng.randrange(60)] = rng.choice(words)
        rows.append((f"r{k:03}", rng.choice(["p", "q", None, f"x{k}"]), " ".join(body), dt.date(2024, 1, rng.randint(1, 20))))
    return [*rows, ("void", None, None, dt.date(2024, 1, 3)), ("void2", "p", "", dt.date(2024, 1, 2)), (None, "p", "x", dt.date(2024, 1, 1)), ("undated", "p", "x", None)]


def ids(rows):
    return sorted(r["id"] for r in rows.select("id").collect())


def test_batches_with_a_replay_equal_the_rule(spark, tmp_path):
    rows = postings(3)
    random.Random(1).shuffle(rows)
    batches = [rows[:15], rows[15:16] * 2 + rows[10:28], rows[28:]]
    root, known = str(tmp_path / "store"), spark.createDataFrame([], COLUMNS)
    for n, part in enumerate(batches):
        batch = spark.createDataFrame(part, COLUMNS)
        known = spark.createDataFrame(ingest.merge_batch(batch.filter("id is not null and observed_on is not null"), known).collect(), COLUMNS)
        merge.apply_batch(batch, n, root)
        if n == 1:
            (tmp_path / "store" / "done" / f"batch={n}" / "_SUCCESS").unlink()
            merge.apply_batch(batch, n, root)
        merge.apply_batch(batch, n, root)
        assert ids(merge.snapshots(spark, root)) == ids(known), n
    counts = {r["batch"]: r for r in merge.metrics(spark, root).collect()}
    assert [counts[n]["n_rows"] for n in range(3)] == [len(p) for p in batches]
    assert sum(r["n_added"] - r["n_dropped"] for r in counts.values()) == known.count()
    assert counts[1]["n_known"] > 0 and counts[1]["n_near"] > 0 and sum(r["n_dropped"] for r in counts.values()) > 0


def test_an_unfinished_batch_is_not_read(spark, tmp_path):
    root = str(tmp_path / "store")
    merge.apply_batch(spark.createDataFrame(postings(4, 10), COLUMNS), 0, root)
    before = ids(merge.snapshots(spark, root))
    merge.apply_batch(spark.createDataFrame([("late", "z", "quite another text", dt.date(2024, 1, 1))], COLUMNS), 1, root)
    done = tmp_path / "store" / "done" / "batch=1"
    for file in done.iterdir():
        file.unlink()
    assert ids(merge.snapshots(spark, root)) == before


@pytest.fixture
def fed(spark, tmp_path):
    """A stream over a folder that a test feeds file by file, one file a micro-batch."""

    def start(batches, schema, transform):
        folder = tmp_path / "in"
        folder.mkdir()
        for n, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / f"b{n}"))
            (file,) = (tmp_path / f"b{n}").glob("part-*.json")
            file.rename(folder / f"{n:03}.json")
            (folder / f"{n:03}.json").touch()
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(str(folder))
        out = []
        query = transform(stream).writeStream.foreachBatch(lambda df, n: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
        return out

    return start


def test_late_rows_are_no_changes(fed):
    at = lambda m: dt.datetime(2024, 1, 1, 10, m)
    batches = [[("p", at(1), "a"), ("p", at(5), "b")], [("p", at(3), "c"), ("p", at(6), "b"), ("q", at(1), None)], [("p", at(7), "a"), ("p", None, "z"), ("q", at(0), "x")]]
    out = fed(batches, "posting string, observed_at timestamp, body string", ingest.body_changes)
    assert sorted((r["posting"], r["version"]) for r in out) == [("p", 1), ("p", 2), ("p", 3), ("q", 1)]


def test_sessions_expire_by_event_time(fed):
    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    batches = [
        [("s", at(10), at(10), "r1"), ("s", at(10), at(10, 30), "r2"), ("t", at(10, 30), at(10, 40), "r2"), (None, at(10), at(10), "r1")],
        [("s", at(10), at(10, 59), "r2"), ("s", at(10), at(11), "r3"), ("t", at(10, 30), at(10, 35), "r1")],
        [("u", at(13), at(13), "r3")],
        [("u", at(13), at(13, 5), "r3")],
    ]
    out = fed(batches, "session string, opened_at timestamp, at timestamp, release string", ingest.sessions)
    got = {r["session"]: (r["n_calls"], r["n_refused"], r["release"], r["expires_at"] - r["opened_at"]) for r in out}
    assert got == {"s": (3, 1, "r1", dt.timedelta(hours=1)), "t": (2, 0, "r1", dt.timedelta(hours=1))}


def test_a_stream_merges_batch_by_batch(spark, tmp_path):
    rows = [r for r in postings(5, 30) if r[0]]
    folder, root = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()
    for n, part in enumerate((rows[:15], rows[15:])):
        spark.createDataFrame(part, COLUMNS).coalesce(1).write.json(str(tmp_path / f"b{n}"))
        (file,) = (tmp_path / f"b{n}").glob("part-*.json")
        file.rename(folder / f"{n}.json")
    stream = spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).json(str(folder))
    merge.merge_stream(stream, root, str(tmp_path / "cp")).awaitTermination()
    assert merge.metrics(spark, root).count() == 2
    assert merge.metrics(spark, root).agg(F.sum("n_rows")).first()[0] == len(rows)
    assert 0 < merge.snapshots(spark, root).count() <= len(rows)
