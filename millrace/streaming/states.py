"""Keyed state as streams: each key once, and the state of each run's class after every step.

State is kept by Spark for each key, or block of keys, in the query's checkpoint: a batch touches the keys or
blocks of its own rows and timers that have come due, whatever has been read before.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..shared import ship

#: The state store that state with timers and time to live needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepare(spark: SparkSession) -> None:
    """Give executors this package, and choose the state store for queries that start from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    ship(spark)


class Once(StatefulProcessor):
    """The least row of each key that comes first; later rows of the key give nothing while its state lives."""

    def __init__(self, order: list[str], ttl_ms: int | None):
        self.order, self.ttl_ms = order, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        rank = lambda r: [(r[c] is not None, r[c]) if r[c] is not None else (False, 0) for c in self.order]
        if self.seen.exists():
            for _ in rows:
                pass
            return
        first = min(rows, key=rank, default=None)
        self.seen.update((True,))
        if first is not None:
            yield first

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.seen.update((True,))

    def close(self) -> None:
        pass


def once(stream: DataFrame, key: list[str], known: DataFrame | None = None, ttl_ms: int | None = None) -> DataFrame:
    """The stream with each key once: its least row by all columns of the batch that brings it first.

    known: a table whose keys count as there already (read once, when the query first starts). With
    ttl_ms a key may come again when that much time has passed since it came.
    """
    prepare(stream.sparkSession)
    processor = Once([c for c in stream.columns if c not in key], ttl_ms)
    start = {"initialState": known.select(*key).distinct().groupBy(*key)} if known is not None else {}
    return stream.groupBy(*key).transformWithState(statefulProcessor=processor, outputStructType=stream.schema, outputMode="Append", timeMode="ProcessingTime" if ttl_ms else "None", **start)


#: Rows that a task packs at once, at most but for an Arrow batch.
PACK_ROWS = 131_072
_PACKED = {"run": None, "at": "long", "id": "long", "failed": "boolean", "done": "boolean"}
_GIVEN = {"run": None, "id": "long", "at": "long", "class_index": "long", "attempts": "long", "last_good": "long"}


def packed(rows: DataFrame) -> DataFrame:
    """(block, and the columns of _PACKED) with a row for many of one block: the columns as arrays.

    Spark hands a stateful processor each row by itself, cell by cell; arrays come whole.
    """
    kind = rows.schema["run"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            table = table.take(pa.array(np.argsort(table["block"].to_numpy(), kind="stable"))).combine_chunks()
            block = table["block"].to_numpy()
            first = np.flatnonzero(np.diff(block, prepend=-1))
            bounds = pa.array(np.append(first, len(block)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(bounds, table[c].combine_chunks()) for c in _PACKED]
            return pa.RecordBatch.from_arrays([pa.array(block[first]), *lists], names=["block", *_PACKED])

        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= PACK_ROWS:
                yield pack(held)
                held, size = [], 0
        if held:
            yield pack(held)

    return rows.mapInArrow(run, "block int, " + ", ".join(f"{c} array<{t or kind}>" for c, t in _PACKED.items()))


class Steps(StatefulProcessor):
    """Rows of a block of runs wait in state until the watermark has passed them, then go in order through their runs' classes.

    A block's waiting rows and its runs' states are one value, so what is asked of the state store are a few
    calls for each block and batch, however many rows and runs there are.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.block = handle.getValueState("block", "value binary")

    def _read(self) -> tuple[list, dict, int | None]:
        """Waiting rows (run, at, id, failed, done); by run class_index, attempts and last_good; the timer that is set."""
        value = self.block.get()
        return pickle.loads(value[0]) if value else ([], {}, None)

    def _write(self, waiting: list, known: dict, timer: int | None) -> None:
        self.block.update((pickle.dumps((waiting, known, timer), 5),))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        new = [x for r in rows for x in zip(*(r[c] for c in _PACKED)) if x[1] // 1000 >= passed]  # late rows would be out of order
        if new:
            waiting, known, timer = self._read()
            first = min(r[1] for r in new) // 1000
            if timer is None or first < timer:
                self.handle.registerTimer(timer := first)  # one that was set for later finds nothing due
            self._write(waiting + new, known, timer)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        waiting, known, timer = self._read()
        due, rest = [], []
        for r in waiting:
            (due if r[1] // 1000 < passed else rest).append(r)
        after = max(min(r[1] for r in rest) // 1000, passed + 1) if rest else None
        if after is not None and after != timer:
            self.handle.registerTimer(after)
        if due or after != timer:
            due.sort(key=lambda r: (r[1], r[2] is not None, r[2] or 0))
            out = []
            for run, at, id_, failed, done in due:
                name = run if run == run else "NaN"
                index, attempts, last_good = known.get(name, (0, 0, None))
                attempts += failed
                if not failed and id_ is not None:
                    last_good = id_ if last_good is None else max(last_good, id_)
                out.append((run, id_, at, index, attempts, last_good))
                known[name] = (index + 1, 0, None) if done else (index, attempts, last_good)
            self._write(rest, known, after)
            for lo in range(0, len(out), PACK_ROWS):
                yield Row(**dict(zip(_GIVEN, map(list, zip(*out[lo : lo + PACK_ROWS])))))

    def close(self) -> None:
        pass


#: Blocks that runs are dealt to. Of a checkpoint it can't be changed.
BLOCKS = 1024


def class_states(stream: DataFrame, run: str, at: str, row_id: str, failed: Column, done: Column, late: str = "1 hour", blocks: int = BLOCKS) -> DataFrame:
    """(run, id, at in microseconds, class_index, attempts, last_good): routing.class_states() as a stream.

    Rows of a run are taken in order of `at` and id, once the watermark (the latest time seen, less `late`)
    has passed them; rows that come after that are left out, as are rows without a time. Equal rows
    count each. Rows wait in state no longer than `late` of event time, the latest ones until later ones come.
    run: a column of an atomic type, binary excepted. Runs are dealt to blocks by their hash; a batch reads and writes the
    states of the blocks that its runs are in.
    """
    prepare(stream.sparkSession)
    rows = stream.where(F.col(at).isNotNull()).withWatermark(at, late).select(
        F.col(run).alias("run"), F.col(row_id).cast("long").alias("id"), F.unix_micros(at).alias("at"), F.coalesce(failed, F.lit(False)).alias("failed"), F.coalesce(done, F.lit(False)).alias("done")
    )
    kind = stream.schema[run].dataType.simpleString()
    dealt = packed(rows.select(F.pmod(F.xxhash64("run"), F.lit(blocks)).cast("int").alias("block"), *_PACKED))
    given = dealt.groupBy("block").transformWithState(statefulProcessor=Steps(), outputStructType=", ".join(f"{c} array<{t or kind}>" for c, t in _GIVEN.items()), outputMode="Append", timeMode="EventTime")
    return given.select(F.inline(F.arrays_zip(*_GIVEN)))
