"""Words of whole texts and their hashes, in numpy over the UTF-8 bytes of Arrow batches.

A word is a run of bytes other than space and the five controls from tab to carriage return.
Everything here runs inside Spark tasks, on one Arrow batch at a time and in slices of a
few megabytes, so the memory of a task does not depend on the number of its documents. A
document longer than a slice is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 4_000_000
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
_U = np.uint64
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: every bit of the result depends on every bit of the input."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class Hasher:
    """Polynomial hash of any range of a sequence of 64-bit numbers, by prefix sums modulo 2^64."""

    def __init__(self, seed: int):
        self.base = int(mix(np.array([2 * seed + 1], dtype=_U))[0]) | 5  # odd, so that it has an inverse
        self.inverse = pow(self.base, -1, 1 << 64)
        self.bytes = mix(np.arange(256, dtype=_U) + _U(1000 * seed + 1))
        self.powers = np.ones(1, dtype=_U)
        self.inverses = np.ones(1, dtype=_U)

    def _reach(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, 1 << 16)
            self.powers = np.cumprod(np.r_[_U(1), np.full(n - 1, self.base, dtype=_U)])
            self.inverses = np.cumprod(np.r_[_U(1), np.full(n - 1, self.inverse, dtype=_U)])

    def prefix(self, values: np.ndarray) -> np.ndarray:
        n = len(values)
        self._reach(n + 1)
        out = np.zeros(n + 1, dtype=_U)
        np.cumsum(values * self.powers[:n], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each range [start, end)."""
        return mix((prefix[end] - prefix[start]) * self.inverses[start] + (end - start).astype(_U))


FIRST, SECOND = Hasher(1), Hasher(2)


@dataclass
class Words:
    """Words of a slice of documents: byte range of each word, and the range of words of each document."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray  # document d has the words bounds[d] to bounds[d + 1]
    offsets: np.ndarray  # and the bytes offsets[d] to offsets[d + 1]

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, hasher: Hasher = FIRST) -> np.ndarray:
        return hasher.ranges(hasher.prefix(hasher.bytes[self.data]), self.start, self.end)

    def owner(self) -> np.ndarray:
        """Number of the document of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def window_starts(self, k: int) -> np.ndarray:
        """First words of all windows of k words that lie inside one document."""
        n = np.diff(self.bounds)
        left = np.repeat(self.bounds[1:], n) - np.arange(len(self.start))
        return np.flatnonzero(left >= k)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=kind, count=len(texts) + 1, offset=texts.offset * kind().itemsize).astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def cut(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of the documents whose bytes are given."""
    n = len(data)
    inside = ~_SEPARATOR[data]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = heads[heads > 0] - 1
    last[tails] = inside[tails]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    return Words(data, start, end, np.searchsorted(start, offsets) if n else np.zeros(len(offsets), dtype=np.int64), offsets)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[int, int, Words]]:
    """Runs of rows [first, last) of a batch with about ``most`` bytes of text each, and their words."""
    data, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last, cut(data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first])
        first = last


def grams(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of the k values from each position on (the last k - 1 positions have none)."""
    n = max(len(hashes) - k + 1, 0)
    factor = _U(0x9E3779B97F4A7C15)
    out = np.full(n, seed, dtype=_U)
    for j in range(k):
        out = out * factor + hashes[j:j + n]
    return mix(out)


def lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Arrow lists from flat values and the bounds of each list."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, type=kind))


def row_key(id_column: str = "doc_id", text_column: str = "text") -> Column:
    """Key of a document row from its id and whole text; equal rows share it, rows with one id but other texts do not."""
    return F.xxhash64(F.col(id_column), F.col(text_column))


def total_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts, from one aggregate over the input."""
    return docs.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0


def grams_down(rows: np.ndarray, seed: int) -> np.ndarray:
    """One hash per column of a matrix of hashes."""
    out = np.full(rows.shape[1], seed, dtype=_U)
    for row in rows:
        out = out * _U(0x9E3779B97F4A7C15) + row
    return mix(out)
