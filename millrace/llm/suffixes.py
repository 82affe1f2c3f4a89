"""Repeated strings by suffix arrays (operator 13).

A window is a string of `length` bytes of one text. It repeats if it starts anywhere else too. One suffix
array of a corpus is one task's work, so texts are first cut to runs that can only repeat run by run:

* Each window names the least hash among its grams (the leftmost of equals). Equal windows name equal
  grams at equal places in them, and neighbours mostly name the same gram, so a text becomes runs of
  windows of one gram, about one for each (length - gram) / 2 bytes. All windows of a run are different.
* Runs whose gram is named once are done: none of their windows repeats. Of the others, the strings from
  a run's first to its last window's end are counted by a 128-bit digest: all windows of a string that is
  there twice repeat. This settles copied texts and the inside of shared passages, however often copied.
* What is left are different strings of one gram (the rims of passages, near copies). Each goes once,
  from its first place, to a task with all others of its gram. There a suffix array is built over them by
  doubling; the previous and next smaller text positions in suffix order give the longest previous factor
  of each position, and with the order of texts turned round the longest later one. Grams with more than
  HOT different strings don't meet in a task: their windows are counted by digest in a shuffle.

Places are ordered by doc_id, text digest and offset, so `keep="first"` leaves each window's first place;
`keep="none"` removes every place of a window that repeats.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import grams
from . import common

LENGTH = 400
#: Different strings of one gram that meet in a task, at most, and bytes at which a page of grams is worked through.
HOT, PAGE_BYTES = 2048, 1 << 20
#: Window starts looked at in one go.
PIECE = grams.PIECE


def gram_of(length: int) -> int:
    return max(1, length // 4)


def runs_of(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts laid end to end -> by pieces: the text's number, first window, end of windows, name of the gram, of each run."""
    k = gram_of(length)
    for a in range(0, max(0, len(data) - length + 1), PIECE):
        part = data[a : a + PIECE + length - 1]
        starts, at, h = grams.window_grams(part, np.clip(offsets - a, 0, len(part)), length, k)
        if not len(starts):
            continue
        first = np.flatnonzero(np.concatenate([[True], (starts[1:] != starts[:-1] + 1) | (at[1:] != at[:-1])]))
        last = np.append(first[1:], len(starts)) - 1
        begin = starts[first] + a
        yield np.searchsorted(offsets, begin, "right") - 1, begin, starts[last] + a + 1, h[first].view(np.int64)


def _digests(pieces: Iterator[bytes]) -> tuple[pa.Array, pa.Array]:
    both = np.frombuffer(b"".join(blake2b(x, digest_size=16).digest() for x in pieces), np.int64).reshape(-1, 2)
    return pa.array(both[:, 0]), pa.array(both[:, 1])


def runs(texts: DataFrame, length: int) -> DataFrame:
    """(id, digest, data binary) -> a row for each run: id, digest, begin, end (of its window starts), gram, and t1, t2, the digest of its string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = grams.bytes_of(batch.column(2))
            view = memoryview(data)
            for text, begin, end, gram in runs_of(data, offsets, length):
                t1, t2 = _digests(view[b:e] for b, e in zip(begin.tolist(), (end + length - 1).tolist()))
                own = pa.array(text)
                cut = offsets[text]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), pa.array((begin - cut).astype(np.int32)), pa.array((end - cut).astype(np.int32)), pa.array(gram), t1, t2], names=["id", "digest", "begin", "end", "gram", "t1", "t2"])

    id_type = texts.schema["id"].dataType.simpleString()
    return texts.where(F.octet_length("data") >= length).mapInArrow(run, f"id {id_type}, digest binary, begin int, end int, gram long, t1 long, t2 long")


# suffix arrays


def suffix_order(data: np.ndarray, end: np.ndarray, depth: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """All suffixes' order by their first `depth` bytes at least, and ranks by their first 8, 16, ... bytes. end: of the string that a position is in."""
    n = len(data)
    at = np.arange(n)
    left = end - at
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = key << np.uint64(8) | np.where(left > j, padded[j : j + n], np.uint64(0))
    short = np.minimum(left, 8)
    order = np.lexsort((short, key))
    rank = np.empty(n, np.int64)
    rank[order] = np.concatenate([[0], np.cumsum((key[order][1:] != key[order][:-1]) | (short[order][1:] != short[order][:-1]))])
    levels, size = [(8, rank)], 8
    while size < depth and rank[order[-1]] < n - 1:
        pair = rank * (n + 1) + np.where(left > size, rank[np.minimum(at + size, n - 1)] + 1, 0)
        order = np.argsort(pair)
        own = pair[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(own[1:] != own[:-1])])
        size *= 2
        levels.append((size, rank))
    return order, levels


def shared(p: np.ndarray, q: np.ndarray, data: np.ndarray, end: np.ndarray, levels: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """How many bytes the suffixes at p and q have in common: exact below twice the deepest level, else that much at least."""
    got, room, last = np.zeros(len(p), np.int64), np.minimum(end[p] - p, end[q] - q), len(data) - 1
    for size, rank in reversed(levels):
        got += size * ((got + size <= room) & (rank[np.minimum(p + got, last)] == rank[np.minimum(q + got, last)]))
    alive = np.ones(len(p), bool)
    for _ in range(7):
        alive &= (got < room) & (data[np.minimum(p + got, last)] == data[np.minimum(q + got, last)])
        got += alive
    return got


def previous_smaller(values: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """For each value the place of the nearest smaller one before it in its block, else -1. opens: where blocks begin."""
    to = np.where(opens, -1, np.arange(len(values)) - 1)
    todo = np.flatnonzero(to >= 0)
    while len(todo):
        todo = todo[values[to[todo]] > values[todo]]
        to[todo] = to[to[todo]]  # all between are greater too
        todo = todo[to[todo] >= 0]
    return to


def factors(data: np.ndarray, end: np.ndarray, least_length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each position the longest string from there that also starts at an earlier position, and at a later one; 0 below least_length.

    Strings don't cross `end`; the two places may overlap.
    """
    before, after = np.zeros(len(data), np.int64), np.zeros(len(data), np.int64)
    if not len(data):
        return before, after
    order, levels = suffix_order(data, end, least_length)
    joined = shared(order[1:], order[:-1], data, end, levels) >= least_length
    inside = np.concatenate([joined, [False]]) | np.concatenate([[False], joined])
    at, opens = order[inside], ~np.concatenate([[False], joined])[inside]
    closes = np.concatenate([opens[1:], [True]]) if len(at) else opens
    n = len(at)
    for out, values in ((before, at), (after, -at)):
        up, down = previous_smaller(values, opens), previous_smaller(values[::-1], closes[::-1])[::-1]
        for to in (up, np.where(down >= 0, n - 1 - down, -1)):
            some = np.flatnonzero(to >= 0)
            out[at[some]] = np.maximum(out[at[some]], shared(at[some], at[to[some]], data, end, levels))
    return before, after


_FLAGS = "t1 long, t2 long, earlier array<int>, again array<int>"


def _spans(flags: np.ndarray, bases: np.ndarray) -> list[list[int]]:
    """For each string begins and ends of what is flagged, from its base."""
    edges = np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8))
    begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    own = np.searchsorted(bases, begin, "right") - 1
    out: list[list[int]] = [[] for _ in bases]
    for t, b, e in zip(own.tolist(), (begin - bases[own]).tolist(), (end - bases[own]).tolist()):
        out[t] += [b, e]
    return out


def compared(strings: DataFrame, length: int) -> DataFrame:
    """(gram, t1, t2, id, digest, begin, data), rows of a gram together -> for each string its windows that also start in an earlier one, and in any."""

    def page(rows: list[tuple]) -> pa.RecordBatch:
        rows.sort(key=lambda r: (r[3] is not None, r[3] if r[3] is not None else 0, r[4], r[5]))
        sizes = np.array([len(r[6]) for r in rows])
        bases = np.cumsum(sizes) - sizes
        before, after = factors(np.frombuffer(b"".join(r[6] for r in rows), np.uint8), np.repeat(bases + sizes, sizes), length)
        return pa.RecordBatch.from_arrays(
            [pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array(_spans(before >= length, bases), pa.list_(pa.int32())), pa.array(_spans((before >= length) | (after >= length), bases), pa.list_(pa.int32()))],
            names=["t1", "t2", "earlier", "again"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, known = [], 0, set()
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[-1][0] != row[0] and size >= PAGE_BYTES:
                    yield page(held)
                    held, size, known = [], 0, set()
                if row[1:3] not in known:  # rows repeated with one id give a string more than once
                    known.add(row[1:3])
                    held.append(row)
                    size += len(row[6])
        if held:
            yield page(held)

    return strings.repartition("gram").sortWithinPartitions("gram").select("gram", "t1", "t2", "id", "digest", "begin", "data").mapInArrow(run, _FLAGS)


def counted(strings: DataFrame, length: int) -> DataFrame:
    """What compared() gives, for grams of any number of strings: every window's digest is counted in a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in enumerate(batch.column(5).to_pylist()):
                n = len(data) - length + 1
                w1, w2 = _digests(data[o : o + length] for o in range(n))
                own = pa.array(np.full(n, i))
                at = np.arange(n, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([w1, w2, *[batch.column(c).take(own) for c in range(4)], pa.array(at + batch.column(4)[i].as_py()), pa.array(at)], names=["w1", "w2", "t1", "t2", "id", "digest", "begin", "at"])

    id_type = strings.schema["id"].dataType.simpleString()
    windows = strings.select("t1", "t2", "id", "digest", "begin", "data").mapInArrow(run, f"w1 long, w2 long, t1 long, t2 long, id {id_type}, digest binary, begin int, at int").dropDuplicates(["w1", "w2", "t1", "t2"])
    windows = common.saved(windows, "hot-windows")
    place = F.struct("id", "digest", "begin")
    known = windows.groupBy("w1", "w2").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    each = windows.join(known, ["w1", "w2"]).withColumn("late", place > F.col("first"))
    spans = lambda c: F.flatten(F.transform(F.array_sort(c), lambda o: F.array(o, o + 1)))
    return each.groupBy("t1", "t2").agg(spans(F.collect_list(F.when(F.col("late"), F.col("at")))).alias("earlier"), spans(F.collect_list("at")).alias("again"))


def repeats(docs: DataFrame, length: int = LENGTH, keep: str = "none", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Where windows repeat: (id with keep="first", digest, found: array of (begin, spans: begins and ends of window starts, from `begin`)).

    A row for each different text with something to remove (with keep="first" for each doc_id and text).
    """
    if keep not in ("none", "first") or length < 2:
        raise ValueError("keep is none or first, length 2 at least")
    common.prepare(docs.sparkSession)
    texts = _texts(docs, doc_id, text)
    table = common.saved(runs(texts.select("id", "digest", "data"), length), "runs")
    # small sides of joins are written first: Spark splits a hot key's rows only where both sides come from exchanges of their own
    named = common.saved(table.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "repeated-grams")
    again = common.saved(table.join(named, "gram"), "repeated-runs")
    common.drop(table)
    common.drop(named)
    strings = again.groupBy("gram", "t1", "t2").agg(F.count("*").alias("n"), F.min(F.struct("id", "digest", "begin", "end")).alias("place"))
    strings = common.saved(strings.select("gram", "t1", "t2", "n", "place.*"), "strings")
    kinds = common.saved(strings.groupBy("gram").agg(F.count("*").alias("kinds")).where("kinds > 1"), "kinds")
    unlike = strings.join(kinds, "gram")
    wanted = unlike.groupBy("id", "digest").agg(F.collect_list(F.struct("gram", "t1", "t2", "begin", "end", "kinds")).alias("wanted"))  # as many as a text has runs

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["gram", "t1", "t2", "begin", "kinds"]
        for batch in batches:
            for i, (data, rows) in enumerate(zip(batch.column(2), batch.column(3).to_pylist())):
                data = memoryview(data.as_buffer())
                for lo in range(0, len(rows), 4096):
                    part = rows[lo : lo + 4096]
                    own = pa.array(np.full(len(part), i))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(own), batch.column(1).take(own), *[pa.array([r[n] for r in part], pa.int32() if n in ("begin", "kinds") else pa.int64()) for n in names], pa.array([bytes(data[r["begin"] : r["end"] + length - 1]) for r in part], pa.binary())],
                        names=["id", "digest", *names, "data"],
                    )

    id_type = texts.schema["id"].dataType.simpleString()
    w = wanted.withColumnsRenamed({"id": "_id", "digest": "_digest"}).withColumn("kinds", F.lit(0))
    fetched = texts.join(w, texts["id"].eqNullSafe(w["_id"]) & (texts["digest"] == w["_digest"])).select("id", "digest", "data", F.transform("wanted", lambda x: x.withField("kinds", x["kinds"].cast("int"))).alias("wanted"))
    fetched = common.saved(fetched.mapInArrow(fetch, f"id {id_type}, digest binary, gram long, t1 long, t2 long, begin int, kinds int, data binary"), "fetched")
    flags = compared(fetched.where(F.col("kinds") <= HOT), length)
    hot = fetched.where(F.col("kinds") > HOT)
    if not hot.isEmpty():
        flags = flags.unionByName(counted(hot, length))
    every = F.when(F.col("n") > 1, F.array(F.lit(0), F.col("end") - F.col("begin"))).otherwise(F.array().cast("array<int>"))
    none = F.array().cast("array<int>")
    known = strings.join(flags, ["t1", "t2"], "left").select("t1", "t2", F.col("id").alias("_id"), F.col("digest").alias("_digest"), F.col("begin").alias("_begin"), F.coalesce("earlier", none).alias("earlier"), F.concat(every, F.coalesce("again", none)).alias("again")).where("size(again) > 0")
    known = common.saved(known, "known")
    key = ["digest"] if keep == "none" else ["id", "digest"]
    places = again.select(*key, "begin", "end", "t1", "t2").distinct().join(known, ["t1", "t2"])
    if keep == "none":
        spans = F.col("again")
    else:
        first = F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")) & (F.col("begin") == F.col("_begin"))
        spans = F.when(first, F.col("earlier")).otherwise(F.array(F.lit(0), F.col("end") - F.col("begin")))
    found = places.select(*key, F.struct("begin", spans.alias("spans")).alias("one")).where("size(one.spans) > 0")
    return common.saved(found.groupBy(*key).agg(F.collect_list("one").alias("found")), "found")


def _texts(docs: DataFrame, doc_id: str, text: str, *more: str) -> DataFrame:
    """id, digest (128 bits), data, and more columns of docs."""
    data = F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b""))
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), data.alias("data"), *more)
    return rows.select("id", F.substring(F.unhex(F.sha2("data", 256)), 1, 16).alias("digest"), "data", *more)


def removed_of(found: list[dict], length: int) -> list[tuple[int, int]]:
    """The maximal runs of bytes that windows cover."""
    out: list[list[int]] = []
    for b, e in sorted((f["begin"] + b, f["begin"] + e - 1 + length) for f in found for b, e in zip(f["spans"][::2], f["spans"][1::2])):
        if out and b <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([b, e])
    return [(b, e) for b, e in out]


def without_repeats(docs: DataFrame, length: int = LENGTH, keep: str = "none", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's doc_id, n_bytes, n_removed, n_spans, spans (removed runs of bytes) and kept (the other bytes, binary: a cut may part a character).

    A null text is an empty one; texts below `length` keep all. With keep="first", places are ordered by
    doc_id (rows without one first), then by text and offset; rows equal in doc_id and text count as one,
    so all of them keep what is first there. With keep="none" repeated rows repeat each other.
    """
    found = repeats(docs, length, keep, doc_id, text)
    texts = _texts(docs, doc_id, text)
    f = found.withColumnsRenamed({"id": "_id", "digest": "_digest"})
    same = texts["digest"] == f["_digest"]
    rows = texts.join(f, same if keep == "none" else same & texts["id"].eqNullSafe(f["_id"]), "left").select("id", "data", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                n, gone, spans, kept = [], [], [], []
                for data, own in zip(part.column(1), part.column(2).to_pylist()):
                    data = data.as_buffer()
                    cut = removed_of(own, length) if own else []
                    n.append(data.size)
                    gone.append(sum(e - b for b, e in cut))
                    spans.append([{"begin": b, "end": e} for b, e in cut])
                    edges = [0, *[x for s in cut for x in s], data.size]
                    kept.append(b"".join(memoryview(data)[b:e] for b, e in zip(edges[::2], edges[1::2])))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array([len(s) for s in spans], pa.int64()), pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"],
                )

    id_type = texts.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, spans array<struct<begin: bigint, end: bigint>>, kept binary")


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes that strings of 400 bytes cover which also start anywhere else."""
    rows = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
