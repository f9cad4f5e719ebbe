"""Lists of whole numbers in few bytes, as a column of lists is shuffled: seven bits of a number in a byte, the lowest first."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def packed(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Numbers from 0 on, and how many of them are of each list -> a binary array, a value for each list."""
    rest, sizes = np.flatnonzero(values >> 7), np.ones(len(values), np.int64)  # most are one byte
    out_of = values[rest]
    for k in range(1, 9):
        sizes[rest] += (out_of >> 7 * k) > 0
    ends = np.r_[0, np.cumsum(sizes)]
    out = np.zeros(ends[-1], np.uint8)
    out[ends[:-1]] = values & 127
    out[ends[:-1][rest]] |= 128
    for k in range(1, sizes.max(initial=0)):
        rest = rest[sizes[rest] > k]
        out[ends[rest] + k] = values[rest] >> 7 * k & 127 | (sizes[rest] > k + 1) << 7
    offsets = ends[np.r_[0, np.cumsum(counts)]].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def unpacked(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """What ``packed`` was given."""
    _, offsets, data = lists.cast(pa.binary()).buffers()
    offsets = np.frombuffer(offsets, np.int32)[lists.offset : lists.offset + len(lists) + 1].astype(np.int64)
    raw = np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]
    last = raw < 128
    ends = np.flatnonzero(last) + 1
    start = np.r_[0, ends][:-1]
    values, sizes = (raw[start] & 127).astype(np.int64), ends - start
    rest = np.flatnonzero(sizes > 1)
    for k in range(1, sizes.max(initial=0)):
        rest = rest[sizes[rest] > k]
        values[rest] |= (raw[start[rest] + k] & 127).astype(np.int64) << 7 * k
    return values, np.diff(np.r_[0, np.cumsum(last)][offsets - offsets[0]])


def slices(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """(first, length) of runs of rows whose sizes sum up to ``most``, about."""
    if not len(sizes):
        return []
    part = (np.cumsum(sizes) - sizes) // most
    first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    return list(zip(first.tolist(), np.diff(np.r_[first, len(sizes)]).tolist(), strict=True))


def within(counts: np.ndarray) -> np.ndarray:
    """0, 1, 2 ... for the entries of each list."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def running(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Running sums that begin anew at ``starts`` (flags; the first is one)."""
    sums = np.cumsum(values)
    at = np.flatnonzero(starts)
    return sums - np.repeat((sums - values)[at], np.diff(np.r_[at, len(values)]))
