"""WARC: deterministic sharded writer and reader.

The payload digest of each page decides the record types by a grouped aggregation: of equal payloads
the largest page_id is the response and the others revisit it. Only (page_id, digest, target) rows join;
those and the pages with their html then pass one shuffle by ranges of page_id, sorted by (page_id, digest), in which a
page's targets come directly before its html, so each task writes its records as a stream. The ranges
follow from the summed bytes of the pages alone, not from a sample: a shard is a range. Files roll
by compressed size; every record is a gzip member with regenerated HTTP and WARC headers and digests.

Tasks write below a folder of temporary names, one per attempt. The manifest, committed by Spark's own
writer, names the attempt that counts for each shard; only its files get their final names, in a job
that can be repeated. What the manifest doesn't name is no part of the archive.

Shards, names, dates and record ids follow from the rows alone: the same rows, however they are
partitioned, give the same bytes.

Defined results: null html is an empty payload, a null url is ``urn:page:<page_id>``; a null page_id
is never the largest unless all of its group are null, and then all of these are responses; rows
that repeat a response's page_id and payload are responses too; an empty table gives no files; other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, saved
from .files import open_store

MANIFEST = "shard int, seq int, temporary string, path string, n_records long, n_bytes long, sha1 string"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, path string"
#: Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'page:{page_id}:{digest}')}>"


def member(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """One record as a gzip member without a time in it."""
    head = VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n".encode()
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head + block + b"\r\n\r\n") + z.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, target: tuple[int, str | None] | None, date: str) -> bytes:
    digest = base32(hashlib.sha1(payload).digest())
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if target else http + payload
    headers: list[tuple[str, object]] = [
        ("WARC-Type", "revisit" if target else "response"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", one_line(url, page_id)),
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base32(hashlib.sha1(block).digest())}"),
        ("X-Payload-Length", len(payload)),
    ]
    if page_id is not None:
        headers.append(("X-Page-ID", page_id))
    if target:
        headers += [
            ("WARC-Profile", REVISIT_PROFILE),
            ("WARC-Refers-To", record_id(target[0], digest)),
            ("WARC-Refers-To-Target-URI", one_line(target[1], target[0])),
            ("WARC-Refers-To-Date", date),
            ("X-Refers-To-Page-ID", target[0]),
        ]
    return member(headers, block)


def one_line(url: str | None, page_id: int | None) -> str:
    return " ".join((url or "").split()) or f"urn:page:{page_id}"


class RollingFiles:
    """Consecutive files of about ``roll_bytes`` compressed bytes each."""

    def __init__(self, base: str, shard: int, roll_bytes: int, date: str):
        self.attempt = f"{base}/temporary/{shard:06d}-{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        self.base, self.shard, self.roll, self.date, self.done, self.sink = base, shard, roll_bytes, date, [], None

    def add(self, data: bytes) -> None:
        if self.sink is None:
            self.name = f"{self.shard:06d}-{len(self.done):05d}.warc.gz"
            fs, path = open_store(f"{self.attempt}/{self.name}")
            fs.create_dir(path.rpartition("/")[0], recursive=True)
            self.sink, self.sha1, self.n, self.size = fs.open_output_stream(path, compression=None), hashlib.sha1(), 0, 0
            info = f"software: spark warc writer\r\nformat: WARC File Format 1.1\r\nisPartOf: {self.name}\r\n".encode()
            self._put(member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(SPACE, self.name)}>"), ("WARC-Date", self.date), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], info))
        self._put(data)
        self.n += 1
        if self.size >= self.roll:
            self.close()

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.sha1.update(data)
        self.size += len(data)

    def close(self) -> list[tuple]:
        if self.sink is not None:
            self.sink.close()
            self.done.append((self.shard, len(self.done), f"{self.attempt}/{self.name}", f"{self.base}/{self.name}", self.n, self.size, self.sha1.hexdigest()))
            self.sink = None
        return self.done


def revisits(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """page_id, digest, refers_to, refers_url of the pages that revisit another. No html is shuffled."""
    payload = F.coalesce("html", F.lit(""))
    keys = pages.select("page_id", "url", F.unhex(F.sha1(payload)).alias("digest"), F.octet_length(payload).alias("size")).filter(F.col("size") >= min_revisit_bytes)
    groups = keys.groupBy("digest", "size").agg(F.max("page_id").alias("refers_to"), F.max_by("url", F.struct("page_id", "url")).alias("refers_url"), F.count("*").alias("n"))
    groups = groups.filter("n > 1 and refers_to is not null").drop("n")
    found = keys.drop("url").join(groups, ["digest", "size"]).filter(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    return found.select("page_id", "digest", "refers_to", "refers_url").distinct()


def shard_starts(sizes: DataFrame, goal: int) -> list[int]:
    """The smallest page_id of every shard but the first, for sizes(page_id, size) and about ``goal`` bytes a shard.

    Bytes are summed by cells of 2**shift ids; cells that hold more than the goal are cut finer, each by what it holds, until
    one id is left. The driver sees some 16 cells a shard.
    """
    rows = sizes.filter("page_id is not null").select("page_id", "size")
    low, high, total = rows.agg(F.min("page_id"), F.max("page_id"), F.sum("size")).first()
    if low is None:
        return []
    finer = lambda held: max(0, (held // goal).bit_length() + 3)
    shift = max(0, (high - low).bit_length() - finer(total))
    cells, open_ = {}, rows.select("page_id", "size", F.lit(shift).alias("shift"))
    while True:
        found = open_.groupBy("shift", F.expr("shiftright(page_id, shift)").alias("cell")).agg(F.sum("size").alias("size")).collect()
        cells.update(((r["cell"] << r["shift"]), r["size"]) for r in found)
        heavy = [(r["shift"], r["cell"], max(0, r["shift"] - finer(r["size"]))) for r in found if r["size"] > goal and r["shift"]]
        if not heavy:
            break
        for s, c, _ in heavy:
            del cells[c << s]
        table = sizes.sparkSession.createDataFrame(heavy, "shift int, cell long, next int")  # a row per shard's bytes at most
        open_ = open_.withColumn("cell", F.expr("shiftright(page_id, shift)")).join(F.broadcast(table), ["shift", "cell"]).select("page_id", "size", F.col("next").alias("shift"))
    starts, held = [], 0
    for start, size in sorted(cells.items()):
        if held and held + size > goal:
            starts.append(start)
            held = 0
        held += size
    return starts


def write_warc(pages: DataFrame, out: str, *, roll_mb: float = 4, shard_mb: float = 32, min_revisit_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes pages(page_id, url, html) as WARC files below out; returns the manifest, a row per file. A shard has about shard_mb of html, a file of it about roll_mb compressed."""
    digest = F.unhex(F.sha1(F.coalesce("html", F.lit(""))))
    rows = pages.select("page_id", "url", "html", digest.alias("digest"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("refers_to"))
    notes = revisits(pages, min_revisit_bytes).select("page_id", F.col("refers_url").alias("url"), F.lit(None).cast("string").alias("html"), "digest", F.lit(0).alias("kind"), "refers_to")
    sizes = saved(pages.select(F.col("page_id").cast("long").alias("page_id"), (F.coalesce(F.octet_length("html"), F.lit(0)) + 512).cast("long").alias("size")), "warc-sizes")
    starts = np.array(shard_starts(sizes, int(shard_mb * (1 << 20))), np.int64)
    shared = pages.sparkSession.sparkContext.broadcast(starts)

    def shard_of(ids: pa.Array) -> pa.Array:
        return pa.array(np.where(ids.is_null(), 0, np.searchsorted(shared.value, np.array(ids.fill_null(0)), "right")), pa.int32())

    both = rows.unionByName(notes).withColumn("shard", F.arrow_udf(shard_of, "int")(F.col("page_id").cast("long")))
    both = both.repartitionById(len(starts) + 1, "shard").sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), F.col("digest").asc(), "kind", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, done = None, []
        at, target = None, None
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                for row in batch.slice(a, 512).to_pylist():
                    key = (row["page_id"], row["digest"])
                    if files is None or files.shard != row["shard"]:
                        done += files.close() if files else []
                        files = RollingFiles(out, row["shard"], int(roll_mb * (1 << 20)), date)
                    if key != at:
                        at, target = key, None
                    if row["kind"] == 0:
                        target = (row["refers_to"], row["url"])
                    else:
                        files.add(page_record(row["page_id"], row["url"], (row["html"] or "").encode(), target, date))
        done += files.close() if files else []
        if done:
            types = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            columns = [pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "seq", "temporary", "path", "n_records", "n_bytes", "sha1"])

    manifest = saved(both.mapInArrow(write, MANIFEST), "warc-manifest")
    commit(manifest)
    return manifest


def commit(manifest: DataFrame) -> None:
    """Gives the files of the manifest their final names. Can be repeated: what has its name stays."""

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for temporary, path, n_bytes in zip(*(batch.column(c).to_pylist() for c in ("temporary", "path", "n_bytes")), strict=True):
                (fs, old), (_, new) = open_store(temporary), open_store(path)
                there = fs.get_file_info(new)
                if not (there.is_file and there.size == n_bytes):
                    fs.move(old, new)
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    done = manifest.select("temporary", "path", "n_bytes").mapInArrow(rename, "n long").agg(F.sum("n")).first()[0] or 0
    if done != manifest.count():
        raise RuntimeError("not all files of the manifest have their final names")


def members(source, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The unpacked gzip members of a stream, one at a time."""
    z, out, data = zlib.decompressobj(31), [], b""
    while data or (data := source.read(chunk)):
        out.append(z.decompress(data))
        data = z.unused_data
        if z.eof:
            yield b"".join(out)
            z, out = zlib.decompressobj(31), []
    if any(out):
        raise ValueError("the file ends within a record")


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not version.startswith(b"WARC/"):
        raise ValueError(f"not a record: {version[:20]!r}")
    headers = {k.decode().lower(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines)}
    return headers, rest[: int(headers["content-length"])]


def read_warc(manifest: DataFrame) -> DataFrame:
    """The page records of the manifest's files: lengths and digests of responses are taken from the payload itself
    and must equal the headers'. Each file is one task's, read as a stream."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "path"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, where = open_store(path)
                rows = []
                with fs.open_input_stream(where, compression=None) as source:
                    for headers, block in map(parsed, members(source)):
                        kind = headers["warc-type"]
                        if kind not in ("response", "revisit"):
                            continue
                        n, digest = int(headers["x-payload-length"]), headers["warc-payload-digest"].removeprefix("sha1:")
                        if f"sha1:{base32(hashlib.sha1(block).digest())}" != headers["warc-block-digest"]:
                            raise ValueError(f"{path}: a block differs from its digest")
                        if kind == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            if (len(payload), base32(hashlib.sha1(payload).digest())) != (n, digest):
                                raise ValueError(f"{path}: a payload differs from its digest")
                        number = lambda k: int(headers[k]) if k in headers else None  # noqa: E731, B023
                        rows.append((number("x-page-id"), n, digest, kind, number("x-refers-to-page-id"), headers["warc-target-uri"], path))
                        if len(rows) == 5000:
                            yield pack(rows)
                            rows = []
                if rows:
                    yield pack(rows)

    return manifest.select("path").repartition(max(1, manifest.count()), "path").mapInArrow(read, RECORDS)


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
b AS (SELECT page_id, html, max(page_id) OVER (PARTITION BY html) AS top FROM p),
hx AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS h, top FROM b),
bits AS (
  SELECT page_id, string_agg('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[CAST(1 + v AS INTEGER)], '' ORDER BY i) AS payload_digest
  FROM (
    SELECT page_id, i, list_sum(list_transform(generate_series(0, 4), lambda k:
             ((CAST(instr('0123456789abcdef', h[((i * 5 + k) // 4) + 1]) - 1 AS INTEGER) >> CAST(3 - (i * 5 + k) % 4 AS INTEGER)) & 1) << CAST(4 - k AS INTEGER))) AS v
    FROM (SELECT page_id, h, unnest(generate_series(0, 31)) AS i FROM hx)
  ) GROUP BY page_id
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM hx JOIN bits USING (page_id)
"""


def op2_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return read_warc(write_warc(pages, fresh_path(spark, "warc"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
