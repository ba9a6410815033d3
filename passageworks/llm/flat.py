"""Flat arrays over batches of texts: bounded pieces of a batch, words and their hashes.

A batch of texts is one byte array with row offsets. Words are maximal runs of bytes other than
ASCII white space (U+0020 and U+0009 to U+000D), A-Z lower-cased. All arithmetic is on unsigned
64-bit integers that wrap around.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 21  # bytes of text handled at once: the arrays over it are 8 to 40 times as large
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so powers never vanish


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: a bijection that spreads every bit over the word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    space = np.zeros(256, dtype=bool)
    space[[32, *range(9, 14)]] = True
    lower = np.arange(256, dtype=np.uint64)
    lower[65:91] += np.uint64(32)
    return space, mix((lower + np.uint64(1)) * _BASE)


_SPACE, _LETTER = _tables()
with np.errstate(over="ignore"):
    _POWER = np.cumprod(np.full(BLOCK, _BASE), dtype=np.uint64)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), int(n), 1 << 64))


def pieces(rows: pa.Array, most: int = BLOCK) -> Iterator[tuple[int, pa.Array]]:
    """A string column in slices of about ``most`` bytes (one row at least), with their first row."""
    rows = rows.cast(pa.large_string()) if not pa.types.is_large_string(rows.type) else rows
    ends = pc.fill_null(pc.binary_length(rows), 0).to_numpy(zero_copy_only=False).cumsum()
    start = 0
    while start < len(rows):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield start, rows.slice(start, stop - start)
        start = stop


def text_bytes(rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a large string column and its len + 1 row offsets; null counts as empty."""
    rows = pc.fill_null(rows, "") if rows.null_count else rows
    offsets = np.frombuffer(rows.buffers()[1], dtype=np.int64)[rows.offset : rows.offset + len(rows) + 1]
    data = rows.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(rows) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _block_words(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and plain sum of the words of one block; ``cuts`` marks bytes that open a row."""
    inside = ~_SPACE[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | cuts[1:]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | cuts[1:]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    if not len(start):
        return start, end, np.zeros(0, dtype=np.uint64)
    at = np.arange(len(data)) - np.repeat(
        np.r_[0, start], np.diff(np.r_[0, start, len(data)])
    )
    value = _LETTER[data] * _POWER[at]
    value[~inside] = 0
    return start, end, np.add.reduceat(value, start)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, start, end and 64-bit hash of every word, in order.

    The bytes are read block by block; the sum of a word that spans blocks is carried on, so a
    word of any length needs no more memory than a block.
    """
    starts, ends, sums = [], [], []
    tail = None  # start and sum of a word that reaches the end of the last block
    heads = np.unique(offsets[:-1])
    for lo in range(0, len(data), BLOCK):
        block = data[lo : lo + BLOCK]
        cuts = np.zeros(len(block), dtype=bool)
        cuts[heads[np.searchsorted(heads, lo) : np.searchsorted(heads, lo + len(block))] - lo] = True
        s, e, v = _block_words(block, cuts)
        s, e = s + lo, e + lo
        if tail is not None and len(s) and s[0] == lo and not cuts[0]:
            v[0] = tail[1] + v[0] * _power(lo - tail[0])
            s[0] = tail[0]
        elif tail is not None:
            starts.append(np.array([tail[0]])), ends.append(np.array([lo]))
            sums.append(np.array([tail[1]], dtype=np.uint64))
        tail = None
        if len(e) and e[-1] == lo + len(block) and e[-1] < len(data):
            tail = (s[-1], v[-1])
            s, e, v = s[:-1], e[:-1], v[:-1]
        starts.append(s), ends.append(e), sums.append(v)
    if not starts:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, np.zeros(0, dtype=np.uint64)
    start, end = np.concatenate(starts), np.concatenate(ends)
    row = np.searchsorted(offsets, start, side="right") - 1
    return row, start, end, mix(np.concatenate(sums) + (end - start).astype(np.uint64))


def shingles(row: np.ndarray, word: np.ndarray, n_rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every run of ``size`` words; a row with fewer words is one run.

    ``row`` must ascend. Runs of fewer words get hashes of their own kind.
    """
    count = np.bincount(row, minlength=n_rows)
    first = np.cumsum(count) - count
    total = np.zeros(max(0, len(word) - size + 1), dtype=np.uint64)
    for k in range(size):
        total += mix(word[k : k + len(total)] + _power(k + 1)) * _power(k)
    whole = row[: len(total)] == row[size - 1 :] if len(total) else np.zeros(0, dtype=bool)
    rows, values = row[: len(total)][whole], mix(total[whole])
    few = np.flatnonzero((count > 0) & (count < size))
    if len(few):
        short = np.zeros(len(few), dtype=np.uint64)
        for k in range(size - 1):
            has = count[few] > k
            short[has] += mix(word[first[few[has]] + k] + _power(k + 1)) * _power(k)
        rows = np.r_[rows, few]
        values = np.r_[values, mix(short + count[few].astype(np.uint64))]
    return rows, values
