"""Document fingerprints from closed syncmers (operator 6), in built-in functions only.

The text's words are hashed; a k-mer is a run of K words, an s-mer a run of S words in it. A k-mer
is a closed syncmer if its least s-mer is its first or its last one. That depends on the k-mer's own
words alone, so an edit changes only the anchors whose k-mers it touches, wherever they lie. A
fingerprint is the sketch of the least anchors of a text; the anchors themselves, with their places,
serve to match two texts by position.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common

K, S = 5, 2
#: Anchors in a fingerprint, and hex digits of each.
SKETCH, DIGITS = 64, 8
#: Ranges of doc_id for which the next document is sought apart, for each shuffle partition.
RANGES_PER_PARTITION = 4


def _mers(df: DataFrame, text: str, tag: str) -> DataFrame:
    """df with arrays of a text's word hashes, and for each k-mer of its four s-mers, as {tag}_words and {tag}_four.

    Each array is a column of its own, so that it is computed once.
    """
    w, s, four = f"{tag}_words", f"{tag}_smers", f"{tag}_four"
    df = df.withColumn(w, F.transform(F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda x: x != ""), lambda x: F.xxhash64(x)))
    n = F.greatest(F.size(w) - (S - 1), F.lit(0))
    df = df.withColumn(s, F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(S), n), lambda a, b: F.xxhash64(a, b)))
    n = F.greatest(F.size(w) - (K - 1), F.lit(0))
    zipped = F.arrays_zip(*[F.slice(s, F.lit(i + 1), n).alias(x) for i, x in enumerate("abcd")])
    return df.withColumn(four, zipped).drop(s)


def _closed(x: Column) -> Column:
    return F.least(x["a"], x["d"]) <= F.least(x["b"], x["c"])


def _anchor(x: Column) -> Column:
    # s-mers 0, 2 and 3 hold all five words
    return _short(F.xxhash64(x["a"], x["c"], x["d"]))


def with_sketch(df: DataFrame, text: str, out: str, places: str | None = None) -> DataFrame:
    """df with `out`, the SKETCH least anchors of a text (not null) as an ascending array of 32-bit numbers.

    A text of fewer than K words is one anchor, an empty one has none. `places`: a column for all
    anchors with their places, each as one long (place in the upper half), in the text's order.
    """
    (tag,) = common.fresh(df, "mers")
    df = _mers(df, text, tag)
    if places:
        at = F.transform(F.col(f"{tag}_four"), lambda x, i: F.when(_closed(x), F.shiftleft(i.cast("long"), 32).bitwiseOR(_anchor(x))))
        df = df.withColumn(places, F.filter(at, lambda x: x.isNotNull()))
    w, four = F.col(f"{tag}_words"), F.col(f"{tag}_four")
    hashes = F.transform(F.filter(four, _closed), _anchor)
    few = F.when(F.size(w) > 0, F.array(_short(F.xxhash64(w)))).otherwise(F.expr("cast(array() as array<bigint>)"))
    least = F.slice(F.array_sort(F.array_distinct(F.when(F.size(w) >= K, hashes).otherwise(few))), 1, SKETCH)
    return df.withColumn(out, least).drop(f"{tag}_words", f"{tag}_four")


def _short(h: Column) -> Column:
    return h.bitwiseAND(F.lit(0xFFFFFFFF))


def fingerprint(least: Column) -> Column:
    """A sketch as a string: DIGITS hex digits for each anchor."""
    return F.array_join(F.transform(least, lambda h: F.lpad(F.lower(F.hex(h)), DIGITS, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The Jaccard index of two texts' anchors, estimated from their sketches; two empty ones are alike."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, SKETCH)
    both = F.array_intersect(F.array_intersect(a, b), union)
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(F.size(both) / F.size(union))


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `fingerprint`. A null text counts as empty and has the empty fingerprint; equal texts
    have equal fingerprints. Rows stay where they are, columns of other names stay."""
    whole, out = common.fresh(docs, "whole_text", "sketch")
    df = with_sketch(docs.withColumn(whole, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))), whole, out)
    return df.withColumn("fingerprint", fingerprint(F.col(out))).drop(whole, out)


def anchors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each anchor: doc_id, at (of its first word, from 0), anchor (32 bits).

    Texts of fewer than K words, empty and null ones have none here.
    """
    rows = _mers(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")), "text", "m")
    rows = rows.select("doc_id", F.posexplode("m_four").alias("at", "x"))
    return rows.where(_closed(F.col("x"))).select("doc_id", "at", _anchor(F.col("x")).alias("anchor"))


def shifts(left: DataFrame, right: DataFrame, pairs: DataFrame) -> DataFrame:
    """Positional matching: for given pairs (left_id, right_id), how many anchors agree at each shift of place.

    left and right: anchors(). Both are first cut to one place for each document and anchor (the
    first), so a repeated line adds one match, not a square of them. Only the pairs asked for meet;
    they are joined by document and anchor, so a common anchor joins no others.
    """
    first = lambda d, n: d.groupBy(F.col("doc_id").alias(f"{n}_id"), "anchor").agg(F.min("at").alias(f"{n}_at"))
    asked = pairs.select("left_id", "right_id").distinct().join(first(left, "left"), "left_id")
    met = asked.join(first(right, "right"), ["right_id", "anchor"])
    return met.groupBy("left_id", "right_id", (F.col("right_at") - F.col("left_at")).alias("shift")).agg(F.count("*").alias("n_anchors"))


def _range_of(bounds: list[tuple]) -> tuple[Column, Column]:
    """The number of bounds (none, inv, tie) up to a row's key, and the bounds as one constant of the plan.

    The row's place among the sorted bounds is found by halving.
    """
    table = F.from_json(F.lit(json.dumps([dict(zip(("none", "inv", "tie"), b)) for b in bounds])), "array<struct<none:int,inv:bigint,tie:bigint>>")
    key = F.struct("none", "inv", "tie")

    def halve(a: Column, _: Column) -> Column:
        mid = F.shiftright(a["lo"] + a["hi"], 1)
        open_ = a["lo"] < a["hi"]
        right = open_ & (F.get(table, mid) <= key)
        return F.struct(F.when(right, mid + 1).otherwise(a["lo"]).alias("lo"), F.when(open_ & ~right, mid).otherwise(a["hi"]).alias("hi"))

    begin = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(len(bounds).bit_length())), begin, halve, lambda a: a["lo"]), table


def _starts(rows: DataFrame, ranges: int) -> list[tuple]:
    """The least key (none, inv, tie) of each of about `ranges` ranges of rows, none of them empty, in order.

    Quantiles of ids say roughly where to cut; an id (or none) on many rows is cut by quantiles of ties
    as well, so that only rows equal in id and text stay together. What the ranges hold is then asked
    of the rows themselves, as quantiles are rounded. At most about 2 * ranges keys come to the driver.
    """
    cuts = [i / ranges for i in range(1, ranges)] or [0.5]
    got = rows.agg(F.percentile_approx(F.when(F.col("none") == 0, F.col("inv")), cuts, 10 * ranges).alias("q"), F.sum("none").alias("nulls"), F.count("*").alias("n")).first()
    ids = got["q"] or []
    seen = {i: ids.count(i) for i in set(ids)} if len(set(ids)) < len(ids) else {}
    parts = {(0, i): k for i, k in seen.items() if k > 1} | ({(1, 0): max(1, got["nulls"] * ranges // got["n"])} if got["nulls"] else {})
    bounds = {(0, i, None) for i in ids} | {(n, i, None) for n, i in parts}
    if parts:
        hot = rows.sparkSession.createDataFrame([(*k, max(1, ranges // p)) for k, p in parts.items()], "h_none int, h_inv long, every int")  # at most `ranges` rows
        ties = rows.join(F.broadcast(hot), (F.col("none") == F.col("h_none")) & (F.col("inv") == F.col("h_inv"))).groupBy("none", "inv", "every").agg(F.percentile_approx("tie", cuts, 10 * ranges).alias("q"))
        for r in ties.select("none", "inv", F.filter("q", lambda x, i: i % F.col("every") == 0).alias("q")).collect():  # about `ranges` numbers in all
            bounds |= {(r["none"], r["inv"], t) for t in r["q"]}
    place, _ = _range_of(sorted(bounds, key=lambda b: (b[0], b[1], b[2] is not None, b[2] or 0)))
    least = rows.groupBy(place.alias("range")).agg(F.min(F.struct("none", "inv", "tie")).alias("k"))
    return sorted(tuple(r["k"]) for r in least.collect())


def with_next(docs: DataFrame, ranges: int | None = None) -> tuple[DataFrame, object]:
    """(doc_id, text, mark, …) dealt to windows, and the window in which the next row is the next document.

    Next is the row that follows in descending doc_id order, and the first after the last. Rows of one
    doc_id follow each other by their texts' hashes; null ids come last. Rows are dealt to ranges, see
    _starts(). The first row of a range follows the last of the range before: it is dealt to both
    ranges, marked 1. The first row of all is dealt to the last range too, behind all others, marked 2.
    Rows marked 0 are the documents. One shuffle of the texts.
    """
    spark = docs.sparkSession
    ranges = ranges or RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # ascending by these is descending by doc_id, nulls last, then by the text's hash
    rows = rows.withColumns({"none": F.col("doc_id").isNull().cast("int"), "inv": F.coalesce(F.bitwise_not("doc_id"), F.lit(0)), "tie": F.xxhash64("text")})
    starts = _starts(rows.select("none", "inv", "tie"), ranges) or [(0, 0, 0)]
    own, table = _range_of(starts[1:])
    is_key = lambda k: F.struct("none", "inv", "tie") == k
    none = F.expr("cast(array() as array<struct<range:int,mark:int>>)")
    to = lambda r, m: F.array(F.struct(r.cast("int").alias("range"), F.lit(m).alias("mark")))
    borders = (F.col("own") > 0) & is_key(F.get(table, F.col("own") - 1))
    wraps = is_key(F.struct(*[F.lit(x).cast(t).alias(n) for x, t, n in zip(starts[0], ("int", "long", "long"), ("none", "inv", "tie"))]))
    copies = F.concat(to(F.col("own"), 0), F.when(borders, to(F.col("own") - 1, 1)).otherwise(none), F.when(wraps, to(F.lit(len(starts) - 1), 2)).otherwise(none))
    dealt = rows.withColumn("own", own).withColumn("copy", F.explode(copies)).select("doc_id", "text", "none", "inv", "tie", "copy.range", "copy.mark")
    return dealt.repartition("range"), Window.partitionBy("range").orderBy(F.col("mark") == 2, "none", "inv", "tie", "mark")


def edited_pairs(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Each document with its edited text and three sketches: its own, its edited text's and the next document's.

    n_anchors: the document's anchors, by place; n_in_place: those that its edited text has at the
    same place. A text of fewer than K words has none of either.

    Edited: the last floor(n_chars / 3) code points are replaced by the first as many (or all) of the
    next document. A null text counts as empty. A table of one row has itself as next.
    """
    dealt, order = with_next(docs, ranges)
    rows = with_sketch(dealt, "text", "sketch", "places")
    rows = rows.withColumn("next_text", F.lead("text").over(order)).withColumn("next_sketch", F.lead("sketch").over(order)).where("mark = 0")
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("k", F.floor(F.col("n_chars") / 3).cast("int"))
    rows = rows.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars as int) - k), substring(next_text, 1, k))"))
    rows = with_sketch(rows.select("doc_id", "n_chars", "edited", "sketch", "next_sketch", "places"), "edited", "edited_sketch", "edited_places")
    rows = rows.withColumn("n_anchors", F.size("places").cast("long")).withColumn("n_in_place", F.size(F.array_intersect("places", "edited_places")).cast("long"))
    return rows.drop("places", "edited_places")


def op6_closed_syncmers(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, their likeness, and how many of its anchors the edit left in place."""
    rows = edited_pairs(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("sketch")).alias("fingerprint"), fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"), "n_anchors", "n_in_place",
    )
