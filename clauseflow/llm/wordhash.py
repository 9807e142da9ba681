"""Vectorised word and shingle hashes over Arrow string columns.

A word's hash is a polynomial over its (case-folded) bytes modulo 2**64, taken
as a difference of prefix sums over a whole buffer, then mixed.  No Python
object is made per word.  All separators are ASCII bytes, so cutting bytes and
cutting code points are the same thing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


#: A 64-bit value for each byte.
_VALUES = mix(np.arange(1, 257, dtype=_U) * _U(_BASE))
#: Byte classes: 0 separates, others are word bytes.
_SPACES = [0x20, *range(0x09, 0x0E)]
WHITESPACE_WORDS = np.ones(256, np.uint8)
WHITESPACE_WORDS[_SPACES] = 0
ALNUM_WORDS = np.zeros(256, np.uint8)
ALNUM_WORDS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
#: Words and runs of punctuation are separate tokens.
TOKENS = WHITESPACE_WORDS * 2 - ALNUM_WORDS
_IDENTITY = np.arange(256, dtype=np.uint8)
LOWER_ASCII = np.where((_IDENTITY >= 0x41) & (_IDENTITY <= 0x5A), _IDENTITY + 32, _IDENTITY).astype(np.uint8)
KEEP_CASE = _IDENTITY

_powers = [np.ones(1, _U), np.ones(1, _U)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, _INVERSE)):
            factors = np.full(size, base, _U)
            factors[0] = 1
            _powers[i] = np.multiply.accumulate(factors)
    return _powers[0], _powers[1]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (n + 1) of a string column; null rows are empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return buf[at[0]:at[-1]] if len(at) else buf[:0], (at - at[0]).astype(np.int64)


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Consecutive row slices whose texts hold at most ``max_bytes`` together, or one row."""
    _, at = text_buffer(batch.column(column))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(at, at[i] + max_bytes, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def _pieces(buf, at, classes, limit) -> Iterator[tuple[int, int]]:
    """Byte ranges of about ``limit`` bytes that cut no word."""
    pos, end_all = 0, len(buf)
    while pos < end_all:
        end = min(pos + limit, end_all)
        if end < end_all:
            k = int(np.searchsorted(at, end, "right")) - 1
            if at[k] > pos:
                end = int(at[k])  # a row starts here
            else:  # inside one long row: after its last separator, else after its next one
                gaps = np.flatnonzero(classes[buf[pos:end]] == 0)
                row_end = int(at[k + 1])
                while not len(gaps) and end < row_end:
                    more = min(end + limit, row_end)
                    gaps = np.flatnonzero(classes[buf[end:more]] == 0)
                    if len(gaps):
                        end = end + int(gaps[0]) + 1
                        break
                    end = more
                else:
                    if len(gaps):
                        end = pos + int(gaps[-1]) + 1
        yield pos, end
        pos = end


def words(column: pa.Array, classes: np.ndarray = WHITESPACE_WORDS, fold: np.ndarray = LOWER_ASCII,
          limit: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a column in order, and for each row where its words start (n + 1)."""
    buf, at = text_buffer(column)
    values = _VALUES[fold]
    hashes, rows = [np.empty(0, _U)], [np.empty(0, np.int64)]
    for lo, hi in _pieces(buf, at, classes, limit):
        part = buf[lo:hi]
        kind = classes[part]
        cut = np.empty(len(part) + 1, bool)
        cut[0] = cut[-1] = True
        np.not_equal(kind[1:], kind[:-1], out=cut[1:-1])
        inner = at[np.searchsorted(at, lo, "right"):np.searchsorted(at, hi, "left")] - lo
        cut[inner] = True
        edge = np.flatnonzero(cut)
        start, stop = edge[:-1], edge[1:]
        real = kind[start] != 0
        start, stop = start[real], stop[real]
        if not len(start):
            continue
        power, inverse = _power_tables(len(part))
        total = np.empty(len(part) + 1, _U)
        total[0] = 0
        np.cumsum(values[part] * power[:len(part)], out=total[1:])
        hashes.append(mix((total[stop] - total[start]) * inverse[start]))
        rows.append(start + lo)
    place = np.concatenate(rows)
    return np.concatenate(hashes), np.searchsorted(place, at, "left")


def located(column: pa.Array, classes: np.ndarray = WHITESPACE_WORDS, fold: np.ndarray = LOWER_ASCII,
            limit: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words of a column in order, and the bytes of its buffer at
    which each starts and ends (``classes``: 0 separates, 1 is a word byte)."""
    buf, at = text_buffer(column)
    values = _VALUES[fold]
    found = [(np.empty(0, _U), np.empty(0, np.int64), np.empty(0, np.int64))]
    for lo, hi in _pieces(buf, at, classes, limit):
        part = buf[lo:hi]
        real = np.zeros(len(part) + 2, bool)
        real[1:-1] = classes[part] != 0
        first, over = real[1:] & ~real[:-1], real[:-1] & ~real[1:]
        inner = at[np.searchsorted(at, lo, "right"):np.searchsorted(at, hi, "left")] - lo
        inner = inner[real[inner] & real[inner + 1]]  # a word ends with its row
        first[inner] = over[inner] = True
        start, stop = np.flatnonzero(first), np.flatnonzero(over)
        power, inverse = _power_tables(len(part))
        total = np.zeros(len(part) + 1, _U)
        np.cumsum(values[part] * power[:len(part)], out=total[1:])
        found.append((mix((total[stop] - total[start]) * inverse[start]), start + lo, stop + lo))
    return tuple(np.concatenate(x) for x in zip(*found))


def shingles(hashes: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``n``-word shingles of each row in order, and where each
    row's shingles start (rows + 1).  A row of fewer words (but one at least)
    has its whole word sequence as its one shingle."""
    count = np.diff(starts)
    made = np.where(count >= n, count - n + 1, (count > 0).astype(count.dtype))
    out_at = np.concatenate([[0], np.cumsum(made)])
    total = np.full(max(len(hashes) - n + 1, 0), _U(n), _U)
    for k in range(n):
        total = mix(total + hashes[k:k + len(total)] * _U(2 * k + 3))
    out = np.empty(out_at[-1], _U)
    full = count >= n
    long_rows = np.flatnonzero(full)
    if len(long_rows):
        size = made[long_rows]
        src = np.repeat(starts[long_rows] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        dst = np.repeat(full, made)
        out[dst] = total[src]
    for r in np.flatnonzero((count > 0) & ~full):
        h = np.full(1, _U(1000 + count[r]), _U)
        for k in range(starts[r], starts[r + 1]):
            h = mix(h + hashes[k:k + 1] * _U(3))
        out[out_at[r]] = h[0]
    return out, out_at


def distinct(sorted_or_not: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(sorted_or_not)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x
