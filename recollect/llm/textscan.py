"""Word scanning and n-gram hashing on whole Arrow string batches, without a Python loop per word.

The UTF-8 bytes of many rows are classified through a 256-entry table; words are runs of word
bytes inside a row. A word's 64-bit hash is a polynomial over its bytes modulo 2**64, read off one
prefix sum (the multiplier is odd, so its powers have inverses) and then finalised by a mixer.
A-Z are lower-cased in the same table. Rows are taken in blocks of a few MB, so memory does not
grow with the batch; one very long row makes one larger block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1_000_000
_MULT = 0x9E3779B97F4A7C15 | 1
_GRAM = 0xD6E8FEB86659FD93 | 1
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n at least, modulo 2**64; kept by the worker process."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        n = max(n, 1 << 20)
        up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[base] = have = (np.cumprod(up), np.cumprod(down))
    return have[0][:n], have[1][:n]


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xA0761D6478BD642F))
_LOWERED = _BYTE.copy()
_LOWERED[65:91] = _BYTE[97:123]


def _table(is_word) -> np.ndarray:
    return np.array([is_word(b) for b in range(256)], dtype=bool)


#: Word bytes: everything but ASCII space and tab to carriage return.
NON_SPACE = _table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Word bytes after lower-casing: ASCII digits and letters, and every non-ASCII byte.
ALNUM = _table(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or 0x41 <= b <= 0x5A)


@dataclass
class Block:
    """Words of rows ``row0 .. row0+rows``: those of its r-th row are ``first[r]:first[r+1]``."""

    row0: int
    rows: int
    first: np.ndarray
    hash: np.ndarray
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    offsets: np.ndarray

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.first))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and offsets[-1] else np.zeros(0, np.uint8)
    return data, offsets


def blocks(column: pa.Array, word_bytes: np.ndarray, lower: bool = True, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """The column's rows, in order, as blocks of scanned words."""
    data, offsets = utf8(column)
    n, row = len(offsets) - 1, 0
    values = _LOWERED if lower else _BYTE
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + block_bytes, "right")) - 1)
        stop = min(stop, n)
        part, off = data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        yield _scan(row, part, off, word_bytes, values)
        row = stop


def _scan(row0: int, data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray, values: np.ndarray) -> Block:
    size = len(data)
    inside = np.zeros(size + 1, bool)
    inside[:size] = word_bytes[data]
    begin, stop = inside.copy(), np.zeros(size + 1, bool)
    begin[1:] &= ~inside[:-1]
    stop[1:] = inside[:-1] & ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < size)]
    begin[edge] |= inside[edge]
    stop[edge] |= inside[edge - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop)
    up, down = _power(_MULT, size + 1)
    total = np.zeros(size + 1, np.uint64)
    if size:
        np.cumsum(values[data] * up[:size], out=total[1:])
    hashes = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    first = np.searchsorted(start, offsets)
    return Block(row0, len(offsets) - 1, first, hashes, data, start, end, offsets)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; positions near the end are left out."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = _power(_GRAM, n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * up[:n], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[: n - k + 1] + _U(k))


def in_row(first: np.ndarray, n: int, k: int) -> np.ndarray:
    """Whether the k words from each of the first n - k + 1 positions lie in one row."""
    if n < k:
        return np.zeros(0, bool)
    ends = np.repeat(first[1:], np.diff(first))
    return np.arange(n - k + 1) + k <= ends[: n - k + 1]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w consecutive values, by doubling."""
    if len(x) < w:
        return x[:0]
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def sliding_argmin(x: np.ndarray, w: int) -> np.ndarray:
    """Where the first least of each w consecutive values is, by doubling."""
    if len(x) < w:
        return np.zeros(0, np.int64)
    at, have = np.arange(len(x)), 1
    while have < w:
        step = min(have, w - have)
        a, b = at[:-step], at[step:]
        at, have = np.where(x[b] < x[a], b, a), have + step
    return at


#: Bytes of terms: ASCII letters and every non-ASCII byte.
ALPHA = _table(lambda b: b >= 0x80 or 0x61 <= b <= 0x7A or 0x41 <= b <= 0x5A)
_LOWER_BYTES = np.arange(256, dtype=np.uint8)
_LOWER_BYTES[65:91] += 32


@dataclass
class Interned:
    """Words of rows ``row0 ..``, those of its r-th row being ``first[r]:first[r+1]``, each as an index into the distinct words."""

    row0: int
    first: np.ndarray
    ids: np.ndarray
    distinct: pa.Array
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    offsets: np.ndarray

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def interned(column: pa.Array, word_bytes: np.ndarray, lower: bool, block_bytes: int = BLOCK_BYTES) -> Iterator[Interned]:
    """The column's rows, in order, as blocks of words that are compared as bytes, not by hash."""
    data, offsets = utf8(column)
    n, row = len(offsets) - 1, 0
    while row < n:
        stop = min(n, max(row + 1, int(np.searchsorted(offsets, offsets[row] + block_bytes, "right")) - 1))
        part, off = data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        size = len(part)
        inside = np.zeros(size + 1, bool)
        inside[:size] = word_bytes[part]
        begin, end = inside.copy(), np.zeros(size + 1, bool)
        begin[1:] &= ~inside[:-1]
        end[1:] = inside[:-1] & ~inside[1:]
        edge = off[1:-1]
        edge = edge[(edge > 0) & (edge < size)]
        begin[edge] |= inside[edge]
        end[edge] |= inside[edge - 1]
        start, end = np.flatnonzero(begin), np.flatnonzero(end)
        letters = part[inside[:size]]
        cuts = np.r_[0, np.cumsum(end - start)].astype(np.int64)
        buffers = [None, pa.py_buffer(cuts), pa.py_buffer(_LOWER_BYTES[letters] if lower else letters)]
        words = pa.Array.from_buffers(pa.large_binary(), len(start), buffers).dictionary_encode()
        yield Interned(row, np.searchsorted(start, off), words.indices.to_numpy().astype(np.int64), words.dictionary, part, start, end, off)
        row = stop
