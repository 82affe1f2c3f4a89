"""Bit filters of numbers: which names can't be among many others, told without a shuffle of the rows asked for."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: Bits for each name, least and most bits of a filter. A filter at its most (64 MB) lets more names
#: through as they grow in number, in the end all: that costs time, never a row.
BITS_A_NAME, LEAST_BITS, MOST_BITS = 8, 1 << 20, 1 << 29
#: Bits that one task sets at a time.
PIECE = 1 << 19


def spread(names: np.ndarray) -> np.ndarray:
    """Longs as well-mixed unsigned numbers."""
    x = names.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ x >> np.uint64(29)


def bit_filter(names: DataFrame, tag: str) -> np.ndarray:
    """(name long, distinct) -> a filter sized by the names' number, as bytes on the driver, at most MOST_BITS / 8.

    Names are dealt by the piece of the filter that they fall in, so each piece is made and sent once.
    """
    names = common.saved(names.toDF("name"), tag)
    bits = LEAST_BITS
    n = names.count()
    while bits < MOST_BITS and bits < BITS_A_NAME * n:
        bits *= 2
    mask = np.uint64(bits - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = (spread(batch.column(0).to_numpy()) & mask).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at // PIECE).astype(np.int32)), pa.array((at % PIECE).astype(np.int32))], names=["slot", "at"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, np.zeros(PIECE, bool)
        done = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(held).tobytes()])], names=["slot", "data"])
        for batch in batches:
            slot, at = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for s in np.unique(slot).tolist():
                if s != now:
                    if now is not None:
                        yield done()
                    now, held = s, np.zeros(PIECE, bool)
                held[at[slot == s]] = True
        if now is not None:
            yield done()

    dealt = names.mapInArrow(place, "slot int, at int").repartition("slot").sortWithinPartitions("slot")
    table = np.zeros(bits // 8, np.uint8)
    for r in dealt.mapInArrow(pieces, "slot int, data binary").collect():  # the filter's bytes
        table[r["slot"] * PIECE // 8 : (r["slot"] + 1) * PIECE // 8] = np.frombuffer(r["data"], np.uint8)
    return table


def may_hold(table: np.ndarray, names: np.ndarray) -> np.ndarray:
    """For each name whether the filter can hold it."""
    at = (spread(names) & np.uint64(len(table) * 8 - 1)).astype(np.int64)
    return table[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 == 1
