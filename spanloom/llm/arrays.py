"""Texts of an Arrow batch as one byte array, and vectorised work on it."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 1 << 20
"""Texts are worked on in runs of about so many bytes, which bounds a task's memory; one longer text forms a run of its own."""
PART_ROWS = 1000
"""Rows of an Arrow batch that numpy works on at once."""


def lower_ascii() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = lower_ascii()


def flags(*ranges: tuple[int, int]) -> np.ndarray:
    """Table of 256 flags, true inside the ranges (both ends included)."""
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple]:
    """(rows, bytes, offsets) of runs of rows; null texts are empty."""
    give_back()
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        texts = texts.fill_null("") if texts.null_count else texts
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8) if raw else np.zeros(0, dtype=np.uint8)
        begin = 0
        while begin < len(texts):
            end = int(np.searchsorted(offsets, int(offsets[begin]) + SLICE_BYTES, side="right")) - 1
            end = min(max(end, begin + 1), len(texts))
            own = offsets[begin : end + 1].astype(np.int64)
            yield batch.slice(begin, end - begin), data[own[0] : own[-1]], own - own[0]
            begin = end
        give_back()


def parts(batches: Iterator[pa.RecordBatch], rows: int = PART_ROWS) -> Iterator[pa.RecordBatch]:
    """The rows, so many at a time; what they took is given back at the end."""
    give_back()
    batch = None
    for batch in batches:
        for begin in range(0, len(batch), rows):
            yield batch.slice(begin, rows)
        give_back()
    del batch
    give_back()


def give_back() -> None:
    """Return freed memory to the system: workers are used again and would keep the most that any task held."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple:
    """Starts, ends and text numbers of the maximal runs of bytes that are ``inside``."""
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    mask = inside[data]
    before = np.empty_like(mask)
    before[0], before[1:] = False, mask[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after = np.empty_like(mask)
    after[-1], after[:-1] = False, mask[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(mask & ~before)
    ends = np.flatnonzero(mask & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (a public finaliser)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_VALUES = mix(np.arange(1, 257, dtype=U64))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        ones = lambda b: np.cumprod(np.concatenate([[U64(1)], np.full(size, b, dtype=U64)]), dtype=U64)
        _powers["up"], _powers["down"] = ones(_BASE), ones(_BASE_INVERSE)
    return _powers["up"][: n + 1], _powers["down"][: n + 1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span; equal bytes hash alike wherever they stand."""
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(_VALUES[data] * up[:-1], out=sums[1:], dtype=U64)
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))
