"""Vectorised views of text columns: word boundaries and 64-bit hashes of whole Arrow batches.

Everything here works on the UTF-8 bytes of a batch. The word classes that the operators use are defined over
ASCII only, and every byte of a multi-byte character is 0x80 or more, so a byte table decides them exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = (0xD6E8FEB86659FD95 & ~7) | 5  # 5 modulo 8: differences of powers lose the fewest low bits
_INVERSE = pow(_BASE, -1, 1 << 64)
_SEGMENT = 1 << 18


def _byte_codes() -> np.ndarray:
    codes = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64)
    return codes * np.uint64(2) + np.uint64(1)


_CODES = _byte_codes()
_FOLDED = _CODES.copy()
_FOLDED[65:91] = _CODES[97:123]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = _SEGMENT
    while size < n:
        size *= 2
    if size not in _powers:
        tables = []
        for base in (_BASE, _INVERSE):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        if size > _SEGMENT:
            return tables[0], tables[1]  # for one very long word only: not kept
        _powers[size] = tables[0], tables[1]
    return _powers[size]


def word_table(separators: str) -> np.ndarray:
    """True for the bytes that belong to a word: all but the given ASCII separators."""
    table = np.ones(256, dtype=bool)
    table[list(separators.encode("ascii"))] = False
    return table


#: `[^\x20\x09-\x0D]+`
SPACED = word_table(" \t\n\x0b\x0c\r")
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, applied after lower-casing A-Z: the letters A-Z count as a-z.
ALNUM = np.ones(256, dtype=bool)
ALNUM[0x00:0x30] = ALNUM[0x3A:0x41] = ALNUM[0x5B:0x61] = ALNUM[0x7B:0x80] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offset of each row (n + 1 of them); nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = 2 << 20):
    """Consecutive slices of a batch whose text takes about `limit` bytes; one longer text is a slice of its own."""
    size = _lengths(batch.column(column))
    ends = np.cumsum(size)
    start = 0
    while start < len(size):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def _lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, fold: bool = True):
    """Start and end byte of every word, the number of words before each row (n + 1 values), and a hash of each word.

    fold: the letters A-Z hash as a-z.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64), np.zeros(0, np.uint64)
    inside = table[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < n]
    first = inside & ~before
    first[cuts] |= inside[cuts]
    last = np.empty(n, bool)
    last[-1] = True
    last[:-1] = first[1:] | ~inside[1:]
    last &= inside
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    counts = np.searchsorted(starts, offsets)
    return starts, ends, counts, span_hashes(data, starts, ends, _FOLDED if fold else _CODES)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray = _CODES) -> np.ndarray:
    """64-bit hashes of byte spans that are sorted and don't overlap; memory is bounded by a segment or the longest span."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + _SEGMENT, side="right")))
        top = int(ends[j - 1])
        power, inverse = _power_tables(top - base + 1)
        total = np.zeros(top - base + 1, np.uint64)
        np.cumsum(codes[data[base:top]] * power[: top - base], out=total[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64) * _MULT
        i = j
    return mix(out)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive elements; gram i starts at element i."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = out * np.uint64(_BASE) + hashes[k : k + m]
    return mix(out + np.uint64(n * int(_MULT) % (1 << 64)))
