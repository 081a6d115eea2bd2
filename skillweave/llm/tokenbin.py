"""Token-ID output: fixed-width bit packing, block offsets, random access.

A shard file holds the ids of consecutive documents, ``width`` bits each (the least that hold the
vocabulary), least significant bit first in little-endian 64-bit words. 64 ids fill ``width`` words, so
packing and unpacking are 64 vectorised shifts over whole blocks. Layout::

    magic, width u32, ids per block u32 | blocks | footer | footer offset u64, magic

The footer has the number of documents and blocks, the offset of each block, and per document its id,
whether that is null, and its number of ids. A manifest table lists the shards that count; a task
writes under a name of its own attempt, so retried and speculative attempts never meet, and what no
manifest row names is no part of the output.

Defined results: a null or empty text is the end id alone; a null doc_id sorts first and stays null;
rows that share a doc_id follow each other by text; an empty table gives no shard; other columns are
ignored.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, n_partitions
from .files import open_store

MAGIC = b"PACKIDS1"
BLOCK_IDS = 1 << 16
#: Pieces that one worker remembers before it starts anew.
CACHE_PIECES = 800_000

MANIFEST = "shard int, path string, n_docs long, n_tokens long, n_bytes long, crc32 long"
DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long, shard int"


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """ids, filled up with zeros to a multiple of 64."""
    rows = np.zeros((-(-len(ids) // 64), 64), np.uint64)
    rows.reshape(-1)[: len(ids)] = ids
    out = np.zeros((len(rows), width), "<u8")
    for j in range(64):
        word, shift = divmod(j * width, 64)
        out[:, word] |= rows[:, j] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= rows[:, j] >> np.uint64(64 - shift)
    return out.tobytes()


def unpack(data: bytes, width: int, n: int) -> np.ndarray:
    packed = np.frombuffer(data, "<u8").reshape(-1, width)
    out = np.empty((len(packed), 64), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        value = packed[:, word] >> np.uint64(shift)
        if shift + width > 64:
            value = value | packed[:, word + 1] << np.uint64(64 - shift)
        out[:, j] = value & mask
    return out.reshape(-1)[:n]


class Encoder:
    """Ids of whole texts. A single space between two other characters always begins a new piece of a
    byte-level vocabulary, so texts are cut there and each distinct piece is encoded once per worker.
    A piece of letters, or of letters and then stops, goes to the model straight: these are the
    pieces that the vocabulary's own splitting makes of it. Texts that hold an added token (an end mark, say)
    are encoded whole, and so is every text where the vocabulary is of another kind."""

    STOPS = ".,;:!?"

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        split = self.tokenizer.pre_tokenizer
        self.cuts = isinstance(split, ByteLevel) and not split.add_prefix_space and split.use_regex and self.tokenizer.normalizer is None and isinstance(self.tokenizer.model, BPE)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.pieces: dict[str, bytes | None] = {}
        self.stops: dict[str, bytes] = {}
        # the characters that stand for bytes in a byte-level vocabulary
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [x for x in range(256) if x not in shown]
        self.shown = {x: chr(256 + hidden.index(x)) if x in hidden else chr(x) for x in range(256)}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters alone, each after a space."""
        tokenize, shown = self.model.tokenize, self.shown
        return [array("I", [t.id for t in tokenize((" " + w).encode().decode("latin-1").translate(shown))]).tobytes() for w in words]

    def _learn(self, new: set[str]) -> None:
        letters, tailed, other = set(), [], []
        for p in new:
            if p.isalpha():
                letters.add(p)
            elif (word := p.rstrip(self.STOPS)).isalpha():
                tailed.append((p, word, p[len(word) :]))
                letters.add(word)
            elif p and not p[0].isspace() and not p[-1].isspace():
                other.append(p)
            else:
                self.pieces[p] = None  # a cut beside other white space is none
        words = [w for w in letters if w not in self.pieces]
        self.pieces.update(zip(words, self._letters(words), strict=True))
        stops = list({x[2] for x in tailed}.difference(self.stops))
        self.stops.update(zip(stops, self._ids(stops), strict=True))
        self.pieces.update((p, self.pieces[w] + self.stops[s]) for p, w, s in tailed)
        self.pieces.update(zip(other, self._ids([" " + p for p in other]), strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.pieces) > CACHE_PIECES:
            self.pieces.clear()
        if not self.cuts:
            return [np.frombuffer(x, np.uint32) for x in self._ids(texts)]
        cut = [t.split(" ") for t in texts]
        self._learn({p for parts in cut for p in parts[1:]}.difference(self.pieces))
        heads = self._ids([parts[0] for parts in cut])
        out = []
        for text, parts, head in zip(texts, cut, heads, strict=True):
            try:
                if len(parts) > 1 and (not parts[0] or parts[0][-1].isspace()) or self.added and self.added.search(text):
                    raise TypeError
                data = head + b"".join(map(self.pieces.__getitem__, parts[1:]))
            except TypeError:
                data = self._ids([text])[0]
            out.append(np.frombuffer(data, np.uint32))
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ShardWriter:
    def __init__(self, sink, width: int):
        self.sink, self.width, self.pending, self.waiting = sink, width, [], 0
        self.at, self.crc, self.blocks, self.docs, self.n_tokens = 0, 0, [], [], 0
        self._put(MAGIC + struct.pack("<II", width, BLOCK_IDS))

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)
        self.crc = zlib.crc32(data, self.crc)

    def _flush(self, least: int) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.zeros(0, np.uint32)
        k = 0
        while len(ids) - k >= least and k < len(ids):
            self.blocks.append(self.at)
            self._put(pack(ids[k : k + BLOCK_IDS], self.width))
            k += BLOCK_IDS
        self.pending = [ids[k:]]
        self.waiting = max(0, len(ids) - k)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, doc_id is None, len(ids)))
        self.pending.append(ids)
        self.waiting += len(ids)
        self.n_tokens += len(ids)
        if self.waiting >= 4 * BLOCK_IDS:
            self._flush(BLOCK_IDS)

    def close(self) -> None:
        self._flush(1)
        footer = self.at
        names, nulls, counts = zip(*self.docs, strict=True) if self.docs else ((), (), ())
        self._put(struct.pack("<QQ", len(self.docs), len(self.blocks)) + np.array(self.blocks, "<i8").tobytes())
        self._put(np.array(names, "<i8").tobytes() + np.array(counts, "<i8").tobytes() + np.array(nulls, "u1").tobytes())
        self._put(struct.pack("<Q", footer) + MAGIC)


class ShardReader:
    """Random access to one shard."""

    def __init__(self, uri: str):
        fs, path = open_store(uri)
        self.source = fs.open_input_file(path)
        size = self.source.size()
        footer, magic = struct.unpack("<Q8s", self._at(size - 16, 16))
        head, self.width, self.block_ids = struct.unpack("<8sII", self._at(0, 16))
        if magic != MAGIC or head != MAGIC:
            raise ValueError(f"{uri}: not a whole shard")
        data = self._at(footer, size - 16 - footer)
        n, m = struct.unpack_from("<QQ", data)
        self.blocks = np.frombuffer(data, "<i8", m, 16)
        self.doc_ids = np.frombuffer(data, "<i8", n, 16 + 8 * m)
        self.counts = np.frombuffer(data, "<i8", n, 16 + 8 * (m + n))
        self.nulls = np.frombuffer(data, "u1", n, 16 + 8 * (m + 2 * n)).astype(bool)
        self.starts = np.cumsum(self.counts) - self.counts
        self.ends = np.append(self.blocks[1:], footer)

    def _at(self, offset: int, n: int) -> bytes:
        return self.source.read_at(n, offset)

    def ids(self, start: int, n: int) -> np.ndarray:
        """ids start to start + n of the shard; reads only the blocks that hold them."""
        if n <= 0:
            return np.zeros(0, np.uint32)
        a, b = start // self.block_ids, (start + n - 1) // self.block_ids
        data = self._at(int(self.blocks[a]), int(self.ends[b] - self.blocks[a]))
        skip = start - a * self.block_ids
        return unpack(data, self.width, skip + n)[skip:]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.counts[k]))

    def close(self) -> None:
        self.source.close()


def write_token_ids(docs: DataFrame, out: str, *, tokenizer: str | None = None, end_id: int = 2, partition_mb: int = 24) -> DataFrame:
    """Encodes documents(doc_id, text), writes shards in ascending doc_id order below out, returns the manifest."""
    path = tokenizer or default_tokenizer()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        shard, code, writer, sink = task.partitionId(), encoder(path), None, None
        width = bits_for(max(code.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1))
        end = np.array([end_id], np.uint32)
        name = f"{out}/shards/{shard:06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.ids"
        for batch in batches:
            texts, names = batch.column("text"), batch.column("doc_id").to_pylist()
            for a in range(0, len(names), 256):
                part = texts.slice(a, 256).to_pylist()
                if writer is None:
                    fs, where = open_store(name)
                    fs.create_dir(where.rpartition("/")[0], recursive=True)
                    sink = fs.open_output_stream(where)
                    writer = ShardWriter(sink, width)
                for doc_id, ids in zip(names[a : a + 256], code.encode([t or "" for t in part]), strict=True):
                    writer.add(doc_id, np.concatenate([ids, end]))
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [name], "n_docs": [len(writer.docs)], "n_tokens": [writer.n_tokens], "n_bytes": [writer.at], "crc32": [writer.crc]})

    rows = docs.select("doc_id", "text")
    ordered = rows.repartitionByRange(n_partitions(rows, "text", partition_mb), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ordered.mapInArrow(write, MANIFEST).write.parquet(f"{out}/manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{out}/manifest")


def read_token_ids(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, shard of each document, from the files that the manifest names.

    Only the manifest (a row per shard) passes the running sum; each shard is read by one task.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, uri, base in zip(*(batch.column(c).to_pylist() for c in ("shard", "path", "base")), strict=True):
                reader = ShardReader(uri)
                for a in range(0, len(reader.counts), 2000):
                    counts, starts = reader.counts[a : a + 2000], reader.starts[a : a + 2000]
                    ids = reader.ids(int(starts[0]), int(counts.sum())).astype("<u4")
                    cuts = starts - starts[0]
                    sums = [zlib.crc32(ids[x : x + n].data) for x, n in zip(cuts, counts, strict=True)]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(reader.doc_ids[a : a + 2000], pa.int64(), mask=reader.nulls[a : a + 2000]),
                        "start": starts + base,
                        "n_tokens": counts,
                        "ids_crc32": pa.array(sums, pa.int64()),
                        "shard": pa.array(np.full(len(counts), shard), pa.int32()),
                    })
                reader.close()

    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    placed = manifest.select("shard", "path", F.coalesce(before, F.lit(0)).alias("base"))
    return placed.repartition(max(1, manifest.count()), "shard").mapInArrow(read, DOCS)


def op1_token_ids(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_token_ids(write_token_ids(docs, fresh_path(spark, "token-ids")))
