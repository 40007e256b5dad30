"""Vectorised words and rolling hashes over Arrow string batches.

Words are runs of bytes other than 0x20 and 0x09-0x0D. Hashes are 64-bit
polynomials with an odd base, so a prefix sum and the base's inverse give the
hash of any slice in constant time; a final mix spreads the bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_MASK = (1 << 64) - 1
_BYTE_BASE = 0x9E3779B97F4A7C15
_rng = np.random.default_rng(20240607)
_BYTE_VALUE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BYTE_VALUE_LOWER = _BYTE_VALUE.copy()
_BYTE_VALUE_LOWER[65:91] = _BYTE_VALUE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes, or neighbours, hashed together: the tables of powers and all temporaries have this size, however long a text is.
_BLOCK = 1 << 16
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    found = _powers.get(base)
    if found is None or len(found[0]) < n:
        size = max(n, _BLOCK + 64)
        pair = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            pair.append(np.multiply.accumulate(x))
        found = _powers[base] = (pair[0], pair[1])
    return found


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """True for the bytes of closed ranges."""
    found = np.zeros(256, bool)
    for lo, hi in ranges:
        found[lo : hi + 1] = True
    return found


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_chunks(column: pa.Array, limit: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past last row, bytes, byte offsets) of runs of rows of about ``limit`` bytes; null counts as empty.

    A row is never cut, so a longer text makes a longer chunk.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    if len(column) == 0:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def words(buf: np.ndarray, offs: np.ndarray, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the word offsets of each text; ``gaps``: True for bytes between words."""
    starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a in range(0, len(buf), 1 << 20):
        b = min(len(buf), a + (1 << 20))
        word = ~gaps[buf[a:b]]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        if a and not gaps[buf[a - 1]]:
            first[0] = False
        if b < len(buf) and not gaps[buf[b]]:
            last[-1] = False
        edge = offs[(offs >= a) & (offs < b)] - a
        first[edge] = word[edge]
        edge = offs[(offs > a) & (offs <= b)] - a - 1
        last[edge] = word[edge]
        starts.append(np.flatnonzero(first) + a)
        ends.append(np.flatnonzero(last) + a + 1)
    starts, ends = np.concatenate(starts), np.concatenate(ends)
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    value = _BYTE_VALUE_LOWER if lower else _BYTE_VALUE
    p, inverse = powers(_BYTE_BASE, _BLOCK)
    out = np.empty(len(starts), np.uint64)
    total = np.zeros(_BLOCK + 1, np.uint64)
    lo = 0
    while lo < len(starts):
        begin = starts[lo]
        hi = int(np.searchsorted(ends, begin + _BLOCK, "right"))
        if hi == lo:  # one word longer than a block
            sum_ = 0
            for a in range(int(begin), int(ends[lo]), _BLOCK):
                part = buf[a : min(a + _BLOCK, int(ends[lo]))]
                sum_ += int((value[part] * p[: len(part)]).sum()) * pow(_BYTE_BASE, a - int(begin), 1 << 64)
            out[lo] = np.uint64(sum_ & _MASK)
            lo += 1
            continue
        seg = buf[begin : ends[hi - 1]]
        np.cumsum(value[seg] * p[: len(seg)], out=total[1 : len(seg) + 1])
        s, e = starts[lo:hi] - begin, ends[lo:hi] - begin
        out[lo:hi] = (total[e] - total[s]) * inverse[s]
        lo = hi
    return mix64(out)


def window_hashes(h: np.ndarray, size: int, base: int) -> np.ndarray:
    """Hash of every run of ``size`` neighbours in ``h`` (runs over text borders included)."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    p, inverse = powers(base, _BLOCK + size)
    out = np.empty(n, np.uint64)
    for a in range(0, n, _BLOCK):
        seg = h[a : a + _BLOCK + size - 1]
        total = np.zeros(len(seg) + 1, np.uint64)
        np.cumsum(seg * p[: len(seg)], out=total[1:])
        m = len(seg) - size + 1
        out[a : a + m] = (total[size:] - total[:-size]) * inverse[:m]
    return mix64(out)


def windows_inside(word_offs: np.ndarray, size: int) -> np.ndarray:
    """True for each window of ``window_hashes`` that lies in one text."""
    n = int(word_offs[-1]) - size + 1
    if n <= 0:
        return np.zeros(0, bool)
    end = np.repeat(word_offs[1:], np.diff(word_offs))[:n]
    return np.arange(size, n + size) <= end
