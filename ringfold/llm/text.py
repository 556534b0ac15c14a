"""Words, hashes and windows of many texts at once, on the buffers that Arrow hands over.

A word is a maximal run of bytes other than space, tab, line feed, vertical tab, form feed
and carriage return; that is the pattern ``[^\\x20\\x09-\\x0D]+`` on UTF-8.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

try:
    _LIBRARY = ctypes.CDLL(None)
except (OSError, TypeError):
    _LIBRARY = None
SPACES = b" \t\n\x0b\x0c\r"
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True

_MASK = (1 << 64) - 1
_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xC2B2AE3D27D4EB4F
_SEGMENT = 1 << 20


def bytes_of(column: str | Column) -> Column:
    """The UTF-8 bytes of a text column; null counts as the empty text."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("binary"), F.lit(b"").cast("binary"))


def partitions(df: DataFrame) -> int:
    """How many shuffle partitions the session asks for; buckets are dealt by it."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary array as one uint8 array, and int64 offsets into it."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_binary(array.type) or pa.types.is_large_string(array.type)
    _, offsets, data = array.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def release() -> None:
    """Gives memory that is free in this worker back to the system, so that a worker that is used again begins small."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(_LIBRARY, "malloc_trim", None):
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "body", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about ``most`` bytes of text (one row at least), so that memory stays bounded."""
    release()
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        _, off = buffers(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    release()


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each text the index of its first word (one more entry than texts)."""
    n = len(buf)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    ink = ~IS_SPACE[buf]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    begins = ink.copy()
    begins[1:] &= ~ink[:-1] | edge[1:n]
    closes = ink.copy()
    closes[:-1] &= ~ink[1:] | edge[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    return start, end, np.searchsorted(start, off)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit integers (a bijection)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, k, 1 << 64))])
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = _Powers(_BYTE_BASE), _Powers(_WORD_BASE)


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, alike wherever the word stands."""
    out, at, n = np.empty(len(start), np.uint64), 0, len(start)
    while at < n:
        a = int(start[at])
        to = int(np.searchsorted(end, a + _SEGMENT, "right"))
        if to <= at:
            out[at], at = _long_hash(buf[a : int(end[at])]), at + 1
            continue
        b = int(end[to - 1])
        up, down = _BYTES.get(b - a)
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum((buf[a:b].astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
        s, e = start[at:to] - a, end[at:to] - a
        out[at:to] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)
        at = to
    return mix(out)


def _long_hash(word: np.ndarray) -> int:
    total, up = 0, _BYTES.get(_SEGMENT)[0]
    for k in range(0, len(word), _SEGMENT):
        part = word[k : k + _SEGMENT].astype(np.uint64) + np.uint64(1)
        total += int((part * up[: len(part)]).sum(dtype=np.uint64)) * pow(_BYTE_BASE, k, 1 << 64)
    return (total + len(word)) & _MASK


def window_hashes(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every window of ``size`` consecutive words of one text, and the index of each window's first word."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    last = np.repeat(first[1:], np.diff(first))
    at = np.flatnonzero(np.arange(n) + size <= last)
    up, down = _WORDS.get(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * up, out=total[1:])
    return mix((total[at + size] - total[at]) * down[at]), at


_PRIME = (1 << 31) - 1


class _Residues:
    """Powers of a base and of its inverse modulo the prime, for one segment's places."""

    def __init__(self, base: int):
        self.base = base % _PRIME
        self.up, self.down = (self._powers(x) for x in (self.base, pow(self.base, -1, _PRIME)))

    @staticmethod
    def _powers(base: int) -> np.ndarray:
        out = np.ones(1, np.uint64)
        while len(out) < _SEGMENT:
            out = np.concatenate([out, out * np.uint64(pow(base, len(out), _PRIME)) % np.uint64(_PRIME)])
        return out[:_SEGMENT]

    def sums(self, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each span [start, end), in rising order, the sum of (value + 1) * base ** place modulo the prime, places from 0."""
        p, out, at = np.uint64(_PRIME), np.empty(len(start), np.uint64), 0
        while at < len(start):
            a = int(start[at])
            to = int(np.searchsorted(end, a + _SEGMENT, "right"))
            if to <= at:
                total = 0
                for k in range(a, int(end[at]), _SEGMENT):
                    part = values[k : min(k + _SEGMENT, int(end[at]))].astype(np.uint64) + np.uint64(1)
                    total += int((part * self.up[: len(part)] % p).sum()) * pow(self.base, k - a, _PRIME)
                out[at], at = total % _PRIME, at + 1
                continue
            b = int(end[to - 1])
            total = np.zeros(b - a + 1, np.uint64)
            np.cumsum((values[a:b].astype(np.uint64) + np.uint64(1)) * self.up[: b - a] % p, out=total[1:])
            s, e = start[at:to] - a, end[at:to] - a
            out[at:to] = (total[e] - total[s]) % p * self.down[s] % p
            at = to
        return out


@functools.cache
def _residues(base: int) -> _Residues:
    return _Residues(base)


def prime_words(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Another hash of each word's bytes, modulo the prime 2**31 - 1."""
    lengths = (end - start).astype(np.uint64) % np.uint64(_PRIME)
    return (_residues(0x2F0B4C47).sums(buf, start, end) * np.uint64(48271) + lengths) % np.uint64(_PRIME)


def prime_windows(hashes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Another hash of the windows of ``size`` words that begin at ``at``, modulo the prime."""
    return _residues(0x5DEECE6D).sums(hashes, at, at + size).astype(np.uint32)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of all ranges [start, start + length), one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)


def binaries(blobs: list[bytes]) -> pa.Array:
    return pa.array(blobs, pa.binary())
