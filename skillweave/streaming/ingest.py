"""Streaming ingest, event windows, posting state and run status."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.dedup import keep_earliest, simhash


def fresh_postings(stream: DataFrame, key: str = "fingerprint", at: str = "observed_at", late: str = "30 days") -> DataFrame:
    """The first row of each fingerprint; the set of those seen is bounded by the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def event_windows(stream: DataFrame, at: str = "at", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by kind in tumbling windows, final once the watermark has passed."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), "kind").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "kind", "n", "value")


def run_status(stream: DataFrame) -> DataFrame:
    """Per run: portals done and failed, rows read and taken, and its state."""
    n = lambda k: F.sum((F.col("type") == k).cast("long"))
    out = stream.groupBy("run").agg(n("done").alias("done"), n("failed").alias("failed"), F.sum("rows_read").alias("rows_read"), F.sum("ingested").alias("ingested"), F.max((F.col("type") == "finished").cast("int")).alias("ended"))
    return out.withColumn("state", F.when(F.col("ended") == 1, F.when(F.col("failed") > 0, "partial").otherwise("finished")).otherwise("running")).drop("ended")


def body_changes(stream: DataFrame) -> DataFrame:
    """A row (posting, body_hash, version) whenever a posting's body differs from its last one; state is the last hash and its time per posting.

    Rows of a micro-batch count in order of (observed_at, body_hash). A row older than the last one of an earlier batch is late: it is no change
    and does not become the last body. Rows without a time are left out.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, version, since = state.get if state.exists else ("", 0, None)
        rows = pd.concat(list(batches)).sort_values(["observed_at", "body_hash"], kind="stable")
        out = []
        for at, h in zip(rows["observed_at"], rows["body_hash"], strict=True):
            if since is not None and at < since:
                continue
            since = at
            if h != last:
                last, version = h, version + 1
                out.append((key[0], h, version))
        state.update((last, version, since))
        yield pd.DataFrame(out, columns=["posting", "body_hash", "version"])

    own = stream.filter("observed_at is not null").select("posting", "observed_at", F.md5(F.coalesce("body", F.lit(""))).alias("body_hash"))
    state = "last string, version long, since timestamp"
    return own.groupBy("posting").applyInPandasWithState(step, "posting string, body_hash string, version long", state, "append", GroupStateTimeout.NoTimeout)


def sessions(stream: DataFrame, hours: float = 1.0, late: str = "10 minutes") -> DataFrame:
    """A row (session, opened_at, expires_at, n_calls, n_refused, release) once a session has expired.

    stream(session, opened_at, at, release): calls of a session, each with the time that it was opened. A session lives ``hours`` from then; calls do not
    prolong it, and those at its end or later are refused. It keeps the release of its earliest call (least of equals). An event-time timer
    set to its end emits the row and removes the state once the watermark has passed; calls later than that are refused too, as a row of their own.
    Calls without session, opened_at or at are left out; of different opened_at the earliest in the first batch holds.
    """
    life = pd.Timedelta(hours=hours)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = ["session", "opened_at", "expires_at", "n_calls", "n_refused", "release"]
        if state.hasTimedOut:
            opened, n, refused, _, release = state.get
            state.remove()
            yield pd.DataFrame([(key[0], opened, opened + life, n, refused, release)], columns=columns)
            return
        rows = pd.concat(list(batches))
        opened, n, refused, first, release = state.get if state.exists else (rows["opened_at"].min(), 0, 0, None, None)
        opened = pd.Timestamp(opened)
        taken = rows[rows["at"] < opened + life]
        n, refused = n + len(taken), refused + len(rows) - len(taken)
        for at, name in zip(taken["at"], taken["release"].fillna(""), strict=True):
            if first is None or (at, name) < (first, release):
                first, release = at, name
        end = int((opened + life).timestamp() * 1000)
        if end <= state.getCurrentWatermarkMs():
            if state.exists:
                state.remove()
            yield pd.DataFrame([(key[0], opened, opened + life, n, refused, release)], columns=columns)
            return
        state.update((opened, n, refused, first, release))
        state.setTimeoutTimestamp(end)
        yield pd.DataFrame([], columns=columns)

    calls = stream.filter("session is not null and opened_at is not null and at is not null").select("session", "opened_at", "at", "release").withWatermark("at", late)
    out = "session string, opened_at timestamp, expires_at timestamp, n_calls long, n_refused long, release string"
    state = "opened_at timestamp, n long, refused long, first timestamp, release string"
    return calls.groupBy("session").applyInPandasWithState(step, out, state, "append", GroupStateTimeout.EventTimeTimeout)


def merge_batch(batch: DataFrame, known: DataFrame) -> DataFrame:
    """The state of the snapshot table after a micro-batch: known and new rows (id, posting, body, observed_on) by the keep-earliest rule,
    so a late older posting replaces the one it is near to."""
    rows = known.unionByName(batch.join(known.select("id"), "id", "left_anti").dropDuplicates(["id"]))
    hashed = simhash(rows, "id", "body")
    kept = keep_earliest(rows.select("id", "posting", "observed_on").join(hashed, "id"))
    return rows.join(kept.select("id"), "id", "left_semi")


def emit_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, op) rows that turn one state of the table into the next."""
    added = after.select("id").join(before.select("id"), "id", "left_anti").withColumn("op", F.lit("add"))
    gone = before.select("id").join(after.select("id"), "id", "left_anti").withColumn("op", F.lit("remove"))
    return added.unionByName(gone)
