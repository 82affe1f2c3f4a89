"""Which texts hold which other texts: a join by rare grams."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions import grams
from ..shared import saved, ship, spread

#: Bytes of a gram. Needles are looked for by windows of LEAST bytes or 4, 16, ... times as many, up to MOST; shorter needles by themselves.
GRAM, LEAST, MOST = 12, 16, 256
#: Bits of the filter for each gram of the needles, and at most (16 MB): with more grams it lets more through, which costs time, never a row.
BITS_A_GRAM, MOST_BITS = 16, 1 << 27


def window_of(length: int) -> int:
    """The bytes of a needle's windows: 0 for an empty one."""
    window = LEAST
    while window < MOST and 4 * window <= length:
        window *= 4
    return window if length >= LEAST else length


def _gram(window: int) -> int:
    return GRAM if window >= LEAST else window


def _places(data: np.ndarray, offsets: np.ndarray, windows: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """By pieces, for each window but that of empty needles: number of the text, place in it and hash of each gram that some window of it names."""
    step = grams.PIECE
    for a in range(0, len(data), step):
        known = None
        for window in windows:
            part = data[a : a + step + max(windows) - 1]
            if not window or len(part) < window:
                continue
            if window >= LEAST and known is None:  # hashed once for all windows
                known = grams.ordered(part, GRAM)
            starts, at, h = grams.window_grams(part, np.clip(offsets - a, 0, len(part)), window, _gram(window), known if window >= LEAST else None)
            at, h = at[starts < step], h[starts < step]
            if len(at):
                new = np.concatenate([[True], at[1:] != at[:-1]])
                at, h = at[new] + a, h[new]
                text = np.searchsorted(offsets, at, "right") - 1
                yield window, text, at - offsets[text], h.view(np.int64)


def _named(rows: DataFrame, windows: list[int], table: np.ndarray | None = None) -> DataFrame:
    """(k, data binary) -> (k, window, gram, at). table: a filter of the grams to give, by bits of their hash."""
    key = rows.schema["k"].dataType
    held = None if table is None else rows.sparkSession.sparkContext.broadcast(table)  # at most MOST_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = grams.bytes_of(batch.column(1))
            none = np.zeros(batch.num_rows, np.int64)
            for window, text, at, h in chain(_places(data, offsets, windows), [(0, np.arange(batch.num_rows), none, none)] if 0 in windows else []):
                if held is not None:
                    bit = h & (len(held.value) * 8 - 1)
                    some = held.value[bit >> 3] >> (bit & 7).astype(np.uint8) & 1 == 1
                    text, at, h = text[some], at[some], h[some]
                if len(text):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text)), pa.array(np.full(len(text), window, np.int32)), pa.array(h), pa.array(at.astype(np.int32))], names=["k", "window", "gram", "at"])

    return rows.mapInArrow(run, T.StructType([T.StructField("k", key), T.StructField("window", T.IntegerType()), T.StructField("gram", T.LongType()), T.StructField("at", T.IntegerType())]))


def _filter(spark: SparkSession, names: DataFrame) -> np.ndarray:
    """Bits for the grams of a table, as bytes: built by Spark, of bounded size."""
    n, bits = names.count(), 1 << 16
    while bits < MOST_BITS and bits < BITS_A_GRAM * n:
        bits *= 2
    place = (F.col("gram").bitwiseAND(F.lit(bits - 1)) + 1).cast("long")  # buckets count from 1
    table = np.zeros(bits // 8, np.uint8)
    for r in names.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("m")).collect():  # the filter's bytes
        table[(r["b"] - 1) * len(r["m"]) : r["b"] * len(r["m"])] = np.frombuffer(r["m"], np.uint8)
    return table


def containing_texts(docs: DataFrame, needles: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, doc_id) for each needle that a document contains, exactly; once for each row of docs and of needles.

    A window of bytes names the least of its grams by hash, so a needle and a text that holds it name the
    same grams inside it. Texts give the grams that pass a filter of the needles' grams (of bounded size);
    each needle is looked for by that one of its grams which is rarest in them, and goes if that is in none.
    Places are verified in the texts. Needles and texts meet in joins by gram and by text: nothing is
    collected but the filter, and Spark splits frequent grams. Null needles are in no text, an empty one is
    in every text, a null text holds nothing. Needles below LEAST bytes are looked for at every place.
    """
    spark = docs.sparkSession
    ship(spark)
    n = needles.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).cast("binary").alias("needle")).withColumn("k", F.monotonically_increasing_id())
    n = saved(n, "needles")
    windows = sorted({window_of(r["l"]) for r in n.groupBy(F.least(F.octet_length("needle"), F.lit(MOST)).alias("l")).count().collect()})  # at most MOST lengths
    wanted = F.lit(0)
    for w in windows:
        wanted = F.when(F.octet_length("needle") >= w, w).otherwise(wanted)  # the greatest window that fits, as window_of() says
    parts = [_named(n.where(wanted == w).select("k", F.col("needle").alias("data")), [w]) for w in windows]
    own = None
    for p in parts:
        own = p if own is None else own.union(p)
    if own is None:
        return spark.createDataFrame([], T.StructType([T.StructField(key, needles.schema[key].dataType), T.StructField(doc_id, docs.schema[doc_id].dataType)]))
    own = saved(own.groupBy("k", "window", "gram").agg(F.min("at").alias("at")), "needle-grams")
    texts = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("data")).withColumn("t", F.xxhash64("data"))
    table = _filter(spark, own.select("gram").distinct())
    # equal texts are read once
    once = spread(texts.select(F.col("t").alias("k"), "data").distinct())
    found = saved(_named(once, windows, table).withColumnsRenamed({"k": "t", "at": "place"}), "text-grams")
    # each needle by its rarest gram
    often = found.groupBy("window", "gram").agg(F.count("*").alias("n"))
    least = own.join(often, ["window", "gram"]).groupBy("k", "window").agg(F.min(F.struct("n", "gram", "at")).alias("r"))
    whole = own.groupBy("k", "window").agg(F.count("*").alias("grams"))
    known = own.join(often, ["window", "gram"]).groupBy("k", "window").agg(F.count("*").alias("there"))
    chosen = least.join(whole, ["k", "window"]).join(known, ["k", "window"]).where("grams = there")  # a gram that is in no text rules its needle out
    chosen = saved(chosen.select("k", "window", "r.gram", "r.at"), "chosen-grams")
    places = found.join(chosen, ["window", "gram"]).select("t", "k", (F.col("place") - F.col("at")).alias("begin")).where("begin >= 0")
    places = places.groupBy("t", "k").agg(F.collect_set("begin").alias("begins")).join(n, "k")  # as many as a text has places
    places = saved(places.select("t", "key", "needle", "begins"), "places")
    held = F.exists("begins", lambda b: F.substring(F.col("data"), b + 1, F.octet_length("needle")) == F.col("needle"))
    return texts.join(places, "t").where(held).select(F.col("key").alias(key), F.col("doc_id").alias(doc_id))
