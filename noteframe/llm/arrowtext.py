"""Whole texts of an Arrow batch as flat byte arrays, cut into words and hashed with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19  # text handled at once; a longer text is a chunk of its own

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Splitmix finaliser: 64 well mixed bits for each value."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 .. n of the base and of its inverse."""
    if len(_powers[0]) <= n:
        for k, step in enumerate((_BASE, _INVERSE)):
            row = np.full(n + 1, step, np.uint64)
            row[0] = 1
            _powers[k] = np.cumprod(row, dtype=np.uint64)
    return _powers[0], _powers[1]


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, bytes, offsets)`` of bounded pieces; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1
        end = max(row + 1, min(end, len(column)))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; every other byte as it is."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word; words are parted by blanks and U+0009 to U+000D."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | first[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | first[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span."""
    power, inverse = _grow(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    value = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(value + (ends - starts).astype(np.uint64) * _GOLD)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """For each text its distinct word shingles, hashed and sorted.

    A text with fewer words than ``size`` gives its whole word sequence as one
    shingle; a text without words gives none.
    """
    data = lower_ascii(data)
    starts, ends, owner = word_bounds(data, offsets)
    hashed = span_hashes(data, starts, ends)
    keys = mix(np.arange(1, size + 1, dtype=np.uint64) * _GOLD) | np.uint64(1)
    counts = np.bincount(owner, minlength=len(offsets) - 1)
    at = np.concatenate([[0], np.cumsum(counts)])
    rolled = np.zeros(max(0, len(hashed) - size + 1), np.uint64)
    for k in range(size):
        rolled += hashed[k : k + len(rolled)] * keys[k]
    rolled = mix(rolled)
    for a, b in zip(at[:-1], at[1:], strict=True):
        n = b - a
        if n >= size:
            yield np.unique(rolled[a : b - size + 1])
        elif n:
            short = (hashed[a:b] * keys[:n]).sum(dtype=np.uint64) + np.uint64(n)
            yield mix(np.array([short], np.uint64))
        else:
            yield np.zeros(0, np.uint64)
