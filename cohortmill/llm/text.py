"""Vectorised text kernels: words and their 64-bit hashes over Arrow string buffers.

A word hash is a polynomial over its bytes, read from prefix sums, so that any substring of the buffer hashes in
constant time. Letters A-Z hash as a-z. Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
SLICE_BYTES = 1 << 20


def _is_space() -> np.ndarray:
    out = np.zeros(256, bool)
    out[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
    return out


SPACE = _is_space()


@cache
def byte_codes(fold: bool = True) -> np.ndarray:
    codes = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
    if fold:
        codes[65:91] = codes[97:123]
    return codes


_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64, for i below n at least."""
    if len(_powers[0]) < n:
        m = max(n, 2 * SLICE_BYTES)
        for k, b in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            a = np.full(m, _U(b), _U)
            a[0] = _U(1)
            _powers[k] = np.multiply.accumulate(a)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and the len(texts) + 1 offsets of their bounds."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and len(off) and off[-1] > off[0] else np.zeros(0, np.uint8)
    if not len(off):
        off = np.zeros(1, np.int64)
    return data[off[0] : off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of one slice have about size bytes; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = text_bytes(batch.column(batch.schema.get_field_index(column)))
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(off, off[begin] + size, side="right")) - 1)
            yield batch.slice(begin, end - begin)
            begin = end


def gathered(batches: Iterator[pa.RecordBatch], column: str, size: int = 4 * SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices put together up to about size bytes (a row counts 8 more): short texts come in batches of few bytes."""
    held: list[pa.RecordBatch] = []
    room = 0
    for batch in slices(batches, column, size):
        n = int(text_bytes(batch.column(batch.schema.get_field_index(column)))[1][-1]) + 8 * batch.num_rows
        if held and room + n > size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, room = [], 0
        held.append(batch)
        room += n
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


class Hashed:
    """Prefix sums over the bytes of a slice; of() hashes the substrings [start, end)."""

    def __init__(self, data: np.ndarray, fold: bool = True):
        power, self.inverse = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, _U)
        np.cumsum(byte_codes(fold)[data] * power[: len(data)], out=self.sums[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.raw(start, end))


def word_bounds(data: np.ndarray, off: np.ndarray, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run of bytes outside `apart` within one text, and the text's index."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~apart[data]
    edge = inside[1:] != inside[:-1]
    edge = edge.astype(np.int8)
    cut = off[1:-1]
    cut = np.unique(cut[(cut > 0) & (cut < len(data))])
    cut = cut[inside[cut] & inside[cut + 1]]  # a word on both sides of a bound
    at = np.flatnonzero(edge)
    if len(cut):
        at = np.sort(np.concatenate([at, cut, cut]))
    start, end = at[0::2], at[1::2]
    return start, end, np.searchsorted(off, start, side="right") - 1


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, text and hash of each word."""
    start, end, doc = word_bounds(data, off)
    return start, end, doc, Hashed(data).of(start, end)


def grams(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n following words of one text, and the index of the first word of each."""
    if len(hashes) < n:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[n - 1 :] == doc[: len(doc) - n + 1])
    h = np.zeros(len(at), _U)
    for k in range(n):
        h = h * _U(0xD6E8FEB86659FD93) + hashes[at + k]
    return mix(h), at


def shingle_sets(hashes: np.ndarray, doc: np.ndarray, n_docs: int, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Per text its sorted distinct n-word shingles, one after the other, and the n_docs + 1 bounds. A text with fewer
    words has the whole sequence as its one shingle; without words it has none."""
    h, at = grams(hashes, doc, n)
    d = doc[at]
    count = np.bincount(doc, minlength=n_docs)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        first = np.searchsorted(doc, short)
        extra = np.empty(len(short), _U)
        for i, (a, c) in enumerate(zip(first, count[short])):
            x = 0x1234567
            for w in hashes[a : a + c]:
                x = (x * 0xD6E8FEB86659FD93 + int(w) + int(c)) % 2**64
            extra[i] = x
        h, d = np.concatenate([h, mix(extra)]), np.concatenate([d, short])
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[keep], d[keep]
    return h, np.searchsorted(d, np.arange(n_docs + 1))


def strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The substrings [start, end), A-Z lower-cased, as an Arrow string array."""
    size = end - start
    off = np.zeros(len(start) + 1, np.int32)
    np.cumsum(size, out=off[1:])
    at = np.arange(off[-1]) + np.repeat(start - off[:-1], size)
    out = data[at] if len(at) else np.zeros(0, np.uint8)
    out = np.where((out >= 65) & (out <= 90), out + 32, out).astype(np.uint8)
    return pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(off), pa.py_buffer(out)])
