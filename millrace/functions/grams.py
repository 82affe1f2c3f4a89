"""Rolling hashes of byte strings in numpy, for functions that work on Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE, _SPREAD = 0xD1342543DE82EF95, np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(0xFFFFFF)
#: Places looked at in one go; fewer than _LOW.
PIECE = 1 << 22


def spread(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers, well mixed."""
    x = x * _SPREAD
    x = (x ^ x >> np.uint64(32)) * _SPREAD
    return x ^ x >> np.uint64(29)


_BYTE = spread(np.arange(1, 257, dtype=np.uint64))


def grams(data: np.ndarray, k: int) -> np.ndarray:
    """A polynomial hash of each k bytes, built by doubling."""
    power = lambda m: np.uint64(pow(_BASE, m, 1 << 64))
    size, h, done, out = 1, _BYTE[data], 0, None
    while True:
        if k & size:
            n = len(data) - done - size + 1
            out = h if out is None else out[:n] * power(size) + h[done : done + n]
            done += size
        if done == k:
            return out
        h = h[:-size] * power(size) + h[size:]
        size *= 2


def least(values: np.ndarray, w: int) -> np.ndarray:
    """The least of each w values in a row."""
    n = len(values) - w + 1
    pad = -len(values) % w
    rows = np.concatenate([values, np.full(pad, np.iinfo(values.dtype).max, values.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def ordered(data: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each k bytes, and what orders them: hashes mixed, then places."""
    h = grams(data, k)
    return h, spread(h) & ~_LOW | np.arange(len(h), dtype=np.uint64)


def window_grams(data: np.ndarray, offsets: np.ndarray, length: int, k: int, known: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts laid end to end -> windows of `length` bytes of one text: their first places, and the place and hash of the least
    of each one's grams of k bytes, the leftmost of equals. Equal windows have it at equal places in them. At most PIECE windows at a time. known: ordered() of the same data."""
    h, order = known or ordered(data, k)
    edge = np.zeros(len(data) - length + 2, np.int32)
    top = len(edge) - 1
    begins, stops = offsets[:-1], np.maximum(offsets[:-1], offsets[1:] - length + 1)
    np.add.at(edge, np.clip(begins, 0, top), 1)
    np.add.at(edge, np.clip(stops, 0, top), -1)
    starts = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    at = (least(order, length - k + 1) & _LOW).astype(np.int64)[starts]
    return starts, at, h[at]


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A binary column without nulls as its bytes, end to end, and offsets."""
    wide = column.type in (pa.large_binary(), pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]
