"""Words and word shingles of a whole batch of texts as numpy arrays.

Texts are read as one UTF-8 buffer. A word is a maximal run of bytes that are no separators, never
across two rows. Words and shingles are named by 64-bit hashes: a polynomial over the bytes (one
running sum over the buffer gives that of any range), then a finaliser that mixes all bits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SALT = np.uint64(0xD6E8FEB86659FD93)


def byte_class(members: bytes) -> np.ndarray:
    mask = np.zeros(256, bool)
    mask[np.frombuffer(members, np.uint8)] = True
    return mask


#: The six ASCII white-space bytes, and those with all ASCII punctuation.
WHITE_SPACE = byte_class(b" \t\n\x0b\x0c\r")
WHITE_SPACE_OR_PUNCTUATION = WHITE_SPACE | byte_class(
    bytes(b for b in range(33, 127) if not chr(b).isalnum())
)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i <= n, kept for the next batch."""
    if len(_powers[0]) <= n:
        steps = np.full(n + 1, _BASE, np.uint64)
        steps[0] = 1
        back = np.full(n + 1, np.uint64(_inverse(int(_BASE))), np.uint64)
        back[0] = 1
        _powers[:] = [np.multiply.accumulate(steps), np.multiply.accumulate(back)]
    return _powers[0], _powers[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows in one buffer, and row boundaries; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or bounds[-1] == bounds[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def running_sums(text: np.ndarray) -> np.ndarray:
    """Sums from which ``range_hashes`` gives the hash of any byte range."""
    power, _ = _power_tables(len(text))
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * power[: len(text)], out=sums[1:])
    return sums


def range_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, back = _power_tables(len(sums) - 1)
    return mixed((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64) * _SALT)


@dataclass
class Words:
    """``row`` of each word, its byte range in the buffer, and the rows' word ranges."""

    text: np.ndarray
    bounds: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    sums: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, start: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Hashes of byte ranges, of the words by default."""
        start = self.start if start is None else start
        end = self.end if end is None else end
        return range_hashes(self.sums, start, end)


def find_words(column: pa.Array, separators: np.ndarray = WHITE_SPACE, lower: bool = True) -> Words:
    """Words of each row, A-Z in lower case if ``lower``."""
    text, bounds = utf8(column)
    text = _LOWER[text] if lower else text
    inside = ~separators[text]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    full = bounds[1:] > bounds[:-1]
    begin, last = bounds[:-1][full], bounds[1:][full] - 1
    opens[begin] = inside[begin]
    closes[last] = inside[last]
    start = np.flatnonzero(opens)
    end = np.flatnonzero(closes) + 1
    first = np.searchsorted(start, bounds)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    return Words(text, bounds, row, start, end, first, running_sums(text))


def _slot_factors(k: int) -> np.ndarray:
    return mixed(np.arange(1, k + 1, dtype=np.uint64) * _SALT) | np.uint64(1)


def shingles(
    row: np.ndarray, first: np.ndarray, word_hash: np.ndarray, k: int, short: bool = True
) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of ``k`` words, repeats included, in row order.

    A row with some words but fewer than ``k`` has its whole sequence as one shingle if ``short``.
    """
    factors = _slot_factors(k)
    n = len(word_hash)
    if n >= k:
        total = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            total += word_hash[j : n - k + 1 + j] * factors[j]
        same = row[: n - k + 1] == row[k - 1 :]
        rows, hashes = row[: n - k + 1][same], mixed(total[same])
    else:
        rows, hashes = row[:0], word_hash[:0]
    counts = np.diff(first)
    few = np.flatnonzero((counts > 0) & (counts < k)) if short else np.zeros(0, np.int64)
    if len(few):
        total = counts[few].astype(np.uint64) * _SALT
        for j in range(k - 1):
            has = counts[few] > j
            total[has] += word_hash[first[few[has]] + j] * factors[j]
        rows = np.concatenate([rows, few])
        hashes = np.concatenate([hashes, mixed(total)])
        order = np.argsort(rows, kind="stable")
        rows, hashes = rows[order], hashes[order]
    return rows, hashes


def shingle_starts(row: np.ndarray, k: int) -> np.ndarray:
    """The first word of every run of ``k`` words within a row, as ``shingles`` lists them."""
    n = len(row)
    return np.flatnonzero(row[: n - k + 1] == row[k - 1 :]) if n >= k else np.zeros(0, np.int64)


def distinct(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (row, hash) once, by row, then hash."""
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[new], hashes[new]


def row_sums(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sum modulo 2**64 of the values of each of ``n`` rows; ``rows`` is sorted."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=sums[1:])
    first = np.searchsorted(rows, np.arange(n + 1))
    return sums[first[1:]] - sums[first[:-1]]
