"""Substring dedup by content-defined chunks (operator 1).

A gear hash rolls over the text's bytes; a chunk ends where given bits of it are zero, which depends
on the last WINDOW bytes alone. So an insertion moves the ends near it and no others, and a passage
that two texts share is cut alike in both but for its rims. Chunks are told apart by a 128-bit
digest; of equal ones the first place, by doc_id and offset, is kept, and the others repeat it.
Where MOST bytes have no end of their own, a chunk ends after MOST bytes: that cut isn't told from the
content, and an insertion moves it, up to the next end that is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from . import common
from .filters import bit_filter, may_hold

#: Bytes the rolling hash sees, the bits that must be zero at a chunk's end, least and most bytes of a chunk.
WINDOW, BITS, SHIFT, LEAST, MOST = 16, 4, 11, 16, 256
#: Repeated chunks are reported where they cover at least so many words in a row, as a passage of 50
#: words does: its rims, up to the first and from the last end within it, lie in chunks of their own.
PASSAGE_WORDS = 20


def _gear() -> np.ndarray:
    """256 pseudo-random numbers by the splitmix64 rule from seed 1."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(by)
    return (x ^ x >> np.uint64(31)).astype(np.uint32)


GEAR = _gear()
_BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))


def rolling(raw: np.ndarray) -> np.ndarray:
    """The gear hash at each byte: the sum of GEAR of the last WINDOW bytes, each shifted by its age.

    Built by doubling: the sum over 2 m bytes is that over the last m and, shifted, over the m before.
    """
    h, m = GEAR[raw], 1
    while m < WINDOW:
        older = h[:-m] << np.uint32(m)
        h = h.copy()
        h[m:] += older
        m *= 2
    return h


def ends(raw: np.ndarray) -> list[int]:
    """Where the chunks of a text end (exclusive), the text's end included; between characters only."""
    n = len(raw)
    if n <= LEAST:
        return [n] if n else []
    h = rolling(raw)
    between = np.ones(n, bool)
    between[:-1] = (raw[1:] & 0xC0) != 0x80
    wanted = np.flatnonzero(((h >> np.uint32(SHIFT)) & np.uint32((1 << BITS) - 1) == 0) & between) + 1
    out, last = [], 0
    for e in wanted.tolist() + [n]:
        while e - last > MOST:
            cut = last + MOST
            while not between[cut - 1]:
                cut -= 1
            out.append(cut)
            last = cut
        if e - last >= LEAST and e < n:
            out.append(e)
            last = e
    if last < n:
        out.append(n)
    return out


def _chunked(data: bytes, cuts: list[int]) -> list[bytes]:
    """The digests of a text's chunks."""
    return [xxhash.xxh3_128_digest(data[a:b]) for a, b in zip([0, *cuts], cuts)]


def _names(digests: list[bytes]) -> np.ndarray:
    """Both halves of digests, a row each; the second one names a chunk until digests are compared whole."""
    return np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)


def _source(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    common.prepare(docs.sparkSession)
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("text")).where("doc_id IS NOT NULL AND length(text) > 0")


def repeated_names(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The names (64 bits) that two or more chunks have, counted before and after one shuffle of names alone."""
    source = _source(docs, doc_id, text).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for data in batch.column(0).to_pylist():
                held += _chunked(data, ends(np.frombuffer(data, np.uint8)))
                if len(held) > 200_000:
                    yield counted(held)
                    held = []
        if held:
            yield counted(held)

    def counted(held: list[bytes]) -> pa.RecordBatch:
        name, n = np.unique(_names(held)[:, 1], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(name), pa.array(n.astype(np.int64))], names=["name", "n"])

    return source.mapInArrow(run, "name long, n long").groupBy("name").agg(F.sum("n").alias("n")).where("n > 1").select("name")


def chunk_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", only: np.ndarray | None = None) -> DataFrame:
    """Each chunk: doc_id, start and stop (code points), words that begin in it, and its digest as two longs.

    `only`: a bit_filter() of names; chunks of other names are left out.
    """
    source = _source(docs, doc_id, text)
    wanted = source.sparkSession.sparkContext.broadcast(only) if only is not None else None  # at most filters.MOST_BITS
    schema = "doc_id long, start int, stop int, words int, hi long, lo long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for d, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = np.frombuffer(data, np.uint8)
                cuts = ends(raw)
                both = _names(_chunked(data, cuts))
                kept = np.arange(len(both)) if wanted is None else np.flatnonzero(may_hold(wanted.value, both[:, 1]))
                if not len(kept):
                    continue
                at = np.array([0, *cuts])
                points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[at]
                blank = _BLANK[raw]
                begins = ~blank
                begins[1:] &= blank[:-1]
                words = np.diff(np.concatenate([[0], np.cumsum(begins)])[at])
                held.append((np.full(len(kept), d, np.int64), points[:-1][kept].astype(np.int32), points[1:][kept].astype(np.int32), words[kept].astype(np.int32), both[kept, 0], both[kept, 1]))
                n += len(kept)
                if n > 200_000:
                    yield rows(held)
                    held, n = [], 0
        if held:
            yield rows(held)

    def rows(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names=["doc_id", "start", "stop", "words", "hi", "lo"])

    return source.mapInArrow(run, schema)


def repeated_chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", within: bool = True) -> DataFrame:
    """Chunks that occur at more than one place: doc_id, start, stop, words, first_doc_id, first_start, n_places.

    The first place is the least (doc_id, start); it is among the rows too. With within=False the
    places must be in two documents at least. Null and empty texts have no chunks; rows without a
    doc_id are left out, as nothing could name them; rows of one doc_id are one document.

    Texts are cut twice: once for the chunks' names, which are counted, and once for the chunks that
    a filter of the repeated names lets through. Only these are written and compared by their whole
    digests. Sums by digest are taken before the shuffle; the join back to places is one that Spark
    splits where a digest is hot.
    """
    only = bit_filter(repeated_names(docs, doc_id, text), "chunk-names")
    rows = common.saved(chunk_rows(docs, doc_id, text, only), "chunks")
    place = F.struct("doc_id", "start")
    seen = rows.groupBy("hi", "lo").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n_places"))
    seen = seen.where("first < last" if within else "first.doc_id < last.doc_id")
    seen = seen.select(F.col("hi").alias("h"), F.col("lo").alias("l"), F.col("first.doc_id").alias("first_doc_id"), F.col("first.start").alias("first_start"), "n_places")
    return rows.join(seen, (F.col("hi") == F.col("h")) & (F.col("lo") == F.col("l"))).drop("hi", "lo", "h", "l")


def repeated_spans(docs: DataFrame, min_words: int = PASSAGE_WORDS, doc_id: str = "doc_id", text: str = "text", within: bool = True) -> DataFrame:
    """Runs of repeated chunks without a gap, of at least min_words words, parted where first places and repeats meet.

    doc_id, start, stop (code points), n_words, n_chunks, first_doc_id (the least of the chunks' first
    documents), max_places and is_first: whether the chunks' first places are these very ones. Each
    chunk's first place is in a span with is_first or in none. min_words holds for the whole run; a
    part of it may have fewer. within=False: only chunks that two documents or more hold. One document's
    chunks are ordered in one task, which its length bounds.
    """
    rows = repeated_chunks(docs, doc_id, text, within).repartition("doc_id").distinct()  # one shuffle for both and the windows
    order = Window.partitionBy("doc_id").orderBy("start", "stop", "first_doc_id", "first_start")
    rows = rows.withColumn("own", (F.col("first_doc_id") == F.col("doc_id")) & (F.col("first_start") == F.col("start")))
    rows = rows.withColumn("gap", F.coalesce(F.col("start") > F.lag("stop").over(order), F.lit(False))).withColumn("turn", F.coalesce(F.col("own") != F.lag("own").over(order), F.lit(False)))
    rows = rows.withColumn("run", F.sum(F.col("gap").cast("int")).over(order)).withColumn("part", F.sum((F.col("gap") | F.col("turn")).cast("int")).over(order))
    spans = rows.groupBy("doc_id", "run", "part").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("words").alias("n_words"), F.count("*").alias("n_chunks"),
        F.min("first_doc_id").alias("first_doc_id"), F.max("n_places").alias("max_places"), F.bool_and("own").alias("is_first"),
    )
    spans = spans.withColumn("run_words", F.sum("n_words").over(Window.partitionBy("doc_id", "run")))
    return spans.where(F.col("run_words") >= min_words).drop("run", "part", "run_words")


def dedup(docs: DataFrame, min_words: int = PASSAGE_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs (one row for each doc_id) without the repeated spans that are not the first of their kind; each chunk stays at its first place."""
    cut = repeated_spans(docs, min_words, doc_id, text).where(~F.col("is_first"))
    own, parts, spans = common.fresh(docs, "cut_id", "cut_blocks", "cut_spans")
    cut = cut.groupBy(F.col("doc_id").alias(own)).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias(spans))  # of one document
    t, s = F.col(f"`{text}`"), F.col(spans)
    rows = docs.join(cut, F.col(f"`{doc_id}`") == F.col(own), "left").withColumn(parts, F.when(s.isNotNull(), common.blocks(t)))
    left = F.zip_with(F.concat(F.array(F.lit(0)), s["stop"]), F.concat(s["start"], F.array(F.length(t))), lambda a, b: common.cut(F.col(parts), a, b))
    return rows.withColumn(text, F.when(s.isNull(), t).otherwise(F.array_join(left, ""))).drop(own, parts, spans)


def op1_gear_chunks(spark, sf_dir: str) -> DataFrame:
    """All passages that documents share, with where each was seen first."""
    return repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), within=False)
