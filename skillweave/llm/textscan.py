"""Words and word n-grams of whole Arrow text columns as numpy arrays, without a Python loop over words.

A word's hash is a polynomial over its bytes modulo 2**64, read off a running sum, then mixed; equal
words have equal hashes everywhere. Texts are taken in slices of whole documents, so memory follows
the slice (SLICE bytes, or one longer document) and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words that white space ends: all but space and tab to carriage return.
SPACED = np.ones(256, bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False
#: Bytes of words of digits, letters a-z and whatever is not ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SLICE + 1)
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


@dataclass
class Words:
    """Words of some consecutive documents. Word i has bytes start[i]:end[i]; document d has words first[d]:first[d + 1]."""

    row: int
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of k consecutive words at each word, and whether those lie in one document."""
        n = len(self.hashes)
        out, inside = np.zeros(n, np.uint64), np.zeros(n, bool)
        if n >= k:
            total = np.zeros(n - k + 1, np.uint64)
            for j in range(k):
                total = total * np.uint64(0xD6E8FEB86659FD93) + self.hashes[j : n - k + 1 + j]
            out[: n - k + 1] = mix(total)
            doc = np.repeat(np.arange(len(self.first) - 1), self.counts)
            inside[: n - k + 1] = doc[: n - k + 1] == doc[k - 1 :]
        return out, inside

    def text(self, a: int, b: int) -> str:
        """Lower-cased text from word a to before word b."""
        return self.data[self.start[a] : self.end[b - 1]].tobytes().decode("utf-8", "replace")


def slices(column: pa.Array, most: int = 1 << 62) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of the documents in them) of about SLICE bytes each, of ``most`` documents at most; nulls are empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(column):
        b = min(a + most, max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE, "right")) - 1))
        yield a, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def words(column: pa.Array, alphabet: np.ndarray, fold: bool = True) -> Iterator[Words]:
    """Words by slices, lower-cased unless ``fold`` is off."""
    for row, raw, offsets in slices(column):
        data = LOWER[raw] if fold else raw
        n = len(data)
        inside = np.zeros(n + 1, bool)
        inside[:n] = alphabet[data]
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        begins = offsets[:-1][np.diff(offsets) > 0]
        ends = offsets[1:][np.diff(offsets) > 0]
        opens[begins] = inside[begins]
        closes[ends - 1] = inside[ends - 1]
        start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        up, down = _power_tables(n + 1)
        running = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=running[1:])
        hashes = mix((running[end] - running[start]) * down[start] + (end - start).astype(np.uint64))
        yield Words(row, data, start, end, np.searchsorted(start, offsets), hashes)
