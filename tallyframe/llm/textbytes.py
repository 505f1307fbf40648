"""Vectorised tokenisation of UTF-8 text held in Arrow buffers.

Every word class used here separates on ASCII bytes only, so that words can be found on bytes: bytes of
multi-byte characters never equal an ASCII separator. One chunk of some MB of texts becomes one set of
numpy arrays; nothing is done per word in Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_GRAM = np.uint64(0xD1342543DE82EF95)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def byte_class(text: str | None = None) -> np.ndarray:
    """Word bytes of ``[^\\x20\\x09-\\x0D]+``, or with "folded" those of ``[0-9a-z]`` and all above ASCII."""
    if text == "folded":
        table = np.zeros(256, bool)
        table[0x30:0x3A] = table[0x61:0x7B] = table[0x80:] = True
    else:
        table = np.ones(256, bool)
        table[[0x20, *range(0x09, 0x0E)]] = False
    return table


PLAIN, FOLDED = byte_class(), byte_class("folded")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for k, b in enumerate((_BASE, _BASE_INVERSE)):
            a = np.full(size, b, np.uint64)
            a[0] = 1
            _powers[k] = np.cumprod(a, dtype=np.uint64)
        if n > 16 * CHUNK_BYTES:  # a table for one huge text isn't kept
            out = _powers[0], _powers[1]
            _powers[0], _powers[1] = np.ones(1, np.uint64), np.ones(1, np.uint64)
            return out
    return _powers[0], _powers[1]


@dataclass
class Words:
    """Words of a chunk of texts; word i is data[start[i]:end[i]], those of text d are first[d]:first[d + 1]."""

    data: np.ndarray
    text_at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    _prefix: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, most: int | None = None, last: int | None = None) -> np.ndarray:
        """64-bit hashes of the words, or of their first ``most`` or last ``last`` bytes."""
        if not len(self.start):
            return np.empty(0, np.uint64)
        s, e = self.start, self.end
        if most is not None:
            e = np.minimum(e, s + most)
        if last is not None:
            s = np.maximum(s, e - last)
        return mix((self._prefix[e] - self._prefix[s]) * _power_tables(len(self._prefix))[1][s])

    def grams(self, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of k consecutive words by first word, and which of them lie in one text."""
        n = len(h) - k + 1
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, bool)
        g = np.zeros(n, np.uint64)
        for j in range(k):
            g = g * _GRAM + h[j : j + n]
        stop = np.repeat(self.first[1:], self.counts)[:n]
        return mix(g), np.arange(n) + k <= stop


def words(data: np.ndarray, text_at: np.ndarray, table: np.ndarray, fold: bool = False) -> Words:
    """data: bytes of all texts; text_at: where each begins, and the end of the last."""
    if fold:
        data = LOWER[data]
    n = len(data)
    inside = table[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:] = inside[:-1]
    after[:-1] = inside[1:]
    begins = text_at[text_at < n]
    before[begins] = False
    after[begins[begins > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power_tables(n + 1)[0][:n], out=prefix[1:])
    return Words(data, text_at, start, end, np.searchsorted(start, text_at), prefix)


def raw(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and text borders of a string or binary array; null counts as empty."""
    array = pc.fill_null(array, b"" if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type) else "")
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks)
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, at, data = array.buffers()
    at = np.frombuffer(at, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64) if len(array) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.empty(0, np.uint8)
    return data, at - at[0]


def chunks(array: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, borders) of runs of rows of about ``most`` bytes; a longer text is alone."""
    if not len(array):
        return
    data, at = raw(array)
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def pieces(data: np.ndarray, table: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """(begin, end) of runs of about ``most`` bytes of one text, cut where a gap begins; a longer word stays whole."""
    a = 0
    while len(data) - a > most:
        size, cuts = most, np.empty(0, np.int64)
        while True:
            inside = table[data[a : a + size]]
            cuts = np.flatnonzero(inside[:-1] & ~inside[1:])
            if len(cuts) or a + size >= len(data):
                break
            size *= 2
        if not len(cuts):
            break
        b = a + int(cuts[-1]) + 1
        yield a, b
        a = b
    if a < len(data):
        yield a, len(data)


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
