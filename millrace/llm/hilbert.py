"""Sharding along a Hilbert curve over metadata (operator 3).

Size, language and source are quantised to BITS bits each: sizes by their quantiles, names in their
order, so that a bin is a range of sizes or of names and bins hold about equally many rows. The
cell's index on the Hilbert curve through that cube orders the rows, so rows near each other in all
dimensions are near each other in the order, and a run of it covers few values of each dimension.
Runs of equal row counts are cut (the law `rows`); each shard's range of every dimension is kept for
pruning by values.

No task sorts all rows: counts by cell (at most 2 ** (3 * BITS)) give each cell's first rank; a cell
with many rows is split by a hash of its rows into parts, whose counts give the parts' first ranks; only the rows of a part are ordered among themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common

DIMENSIONS = ("size", "lang", "source")
BITS = 4
#: A cell is split into parts of about this share of a shuffle partition's rows, LEAST_ROWS at least.
PARTS_PER_PARTITION, LEAST_ROWS = 4, 100
#: Up to so many names their bins are sent to the rows.
SENT_NAMES = 1 << 16


def size_bins(rows: DataFrame) -> DataFrame:
    """rows with size_bin: how many of the sizes' 2 ** BITS - 1 quantiles are below the size."""
    cuts = [i / (1 << BITS) for i in range(1, 1 << BITS)]
    quantiles = rows.agg(F.percentile_approx("size", cuts, 10_000)).first()[0] or []
    return rows.withColumn("size_bin", sum((F.when(F.col("size") > q, 1).otherwise(0) for q in sorted(set(quantiles))), F.lit(0)))


def name_bins(rows: DataFrame, column: str) -> DataFrame:
    """rows with {column}_bin: names in order, null first, in 2 ** BITS ranges of about equally many rows.

    Names, not rows, are ordered in one task; a row each.
    """
    order = Window.orderBy(F.asc_nulls_first(column)).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    middle = F.coalesce(F.sum("n").over(order), F.lit(0)) + F.col("n") / 2
    bins = common.saved(counts.select(F.col(column).alias("name"), F.floor(middle * (1 << BITS) / F.sum("n").over(everything)).cast("int").alias(f"{column}_bin")), "shard-names")
    small = F.broadcast(bins) if bins.count() <= SENT_NAMES else bins
    return rows.join(small, F.col(column).eqNullSafe(F.col("name"))).drop("name")


def curve_index(df: DataFrame, dims: list[str], out: str, bits: int = BITS) -> DataFrame:
    """df with the Hilbert index of the cell given by integer columns in [0, 2 ** bits).

    The axes are transformed bit by bit from the top (Skilling, "Programming the Hilbert curve",
    2004); each round is a projection of its own, so an expression never repeats an earlier round's.
    """
    n = len(dims)
    x = common.fresh(df, *[f"axis_{i}" for i in range(n)])
    (swap,) = common.fresh(df, "axis_swap")
    df = df.select("*", *[F.col(d).cast("int").alias(c) for d, c in zip(dims, x)])
    q = 1 << bits - 1
    while q > 1:
        p = q - 1
        for i in range(n):
            # where the bit is set the first axis is inverted below it, else it trades bits with axis i
            is_set = F.col(x[i]).bitwiseAND(F.lit(q)) != 0
            df = df.withColumn(swap, F.when(is_set, F.lit(p)).otherwise(F.col(x[0]).bitwiseXOR(F.col(x[i])).bitwiseAND(F.lit(p))))
            other = F.col(x[i]).bitwiseXOR(F.when(is_set, F.lit(0)).otherwise(F.col(swap)))
            df = df.withColumns({x[0]: F.col(x[0]).bitwiseXOR(F.col(swap)), **({x[i]: other} if i else {})})
        q >>= 1
    for i in range(1, n):
        df = df.withColumn(x[i], F.col(x[i]).bitwiseXOR(F.col(x[i - 1])))
    t, q = F.lit(0), 1 << bits - 1
    while q > 1:
        t = t.bitwiseXOR(F.when(F.col(x[n - 1]).bitwiseAND(F.lit(q)) != 0, F.lit(q - 1)).otherwise(F.lit(0)))
        q >>= 1
    df = df.withColumn(swap, t)
    index = F.lit(0).cast("long")
    for b in range(bits - 1, -1, -1):
        for c in x:
            bit = F.shiftright(F.col(c).bitwiseXOR(F.col(swap)), b).bitwiseAND(F.lit(1)).cast("long")
            index = index * 2 + bit
    return df.withColumn(out, index).drop(*x, swap)


def placed(rows: DataFrame, shards: int, cell: str = "cell", key: str = "key") -> DataFrame:
    """rows with shard and slot: `shards` runs of the order by (cell, part, key), counts at most one apart.

    `key` is a hash that tells rows apart; rows equal in it follow each other in any order, which
    only rows equal in all kept columns can show.
    """
    rows = common.saved(rows, "shard-rows")
    cells = common.saved(rows.groupBy(F.col(cell).alias("c")).agg(F.count("*").alias("n")), "shard-cells")
    n = cells.agg(F.sum("n")).first()[0] or 0
    in_part = max(LEAST_ROWS, n // (PARTS_PER_PARTITION * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    cells = cells.withColumn("parts", F.ceil(F.col("n") / in_part))
    rows = rows.join(F.broadcast(cells.select("c", "parts")), F.col(cell) == F.col("c")).drop("c")  # at most 2 ** (3 * BITS) rows
    rows = rows.withColumn("part", F.pmod(F.col(key), F.col("parts"))).drop("parts")
    sums = common.saved(rows.groupBy(F.col(cell).alias("c"), F.col("part").alias("p")).agg(F.count("*").alias("n")), "shard-parts")
    in_cell = Window.partitionBy("c").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    along = Window.orderBy("c").rowsBetween(Window.unboundedPreceding, -1)  # cells, not rows
    first = sums.groupBy("c").agg(F.sum("n").alias("n")).withColumn("cell_first", F.coalesce(F.sum("n").over(along), F.lit(0))).select(F.col("c").alias("c2"), "cell_first")
    parts = sums.withColumn("part_first", F.coalesce(F.sum("n").over(in_cell), F.lit(0))).join(first, F.col("c") == F.col("c2")).select("c", "p", (F.col("cell_first") + F.col("part_first")).alias("first"))
    each, more = divmod(n, shards)
    rank = F.row_number().over(Window.partitionBy(cell, "part").orderBy(key, "doc_id")) - 1
    rows = rows.withColumn("rank", rank).join(parts, (F.col(cell) == F.col("c")) & (F.col("part") == F.col("p"))).withColumn("rank", F.col("rank") + F.col("first")).drop("c", "p", "first", "part")
    # the first `more` shards hold one row more
    edge = more * (each + 1)
    shard = F.when(F.col("rank") < edge, F.floor(F.col("rank") / (each + 1))).otherwise(more + F.floor((F.col("rank") - edge) / max(each, 1)))
    start = F.when(F.col("shard") < more, F.col("shard") * (each + 1)).otherwise(edge + (F.col("shard") - more) * each)
    return rows.withColumn("shard", shard.cast("int")).withColumn("slot", (F.col("rank") - start).cast("long")).drop("rank")


def metadata(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", whole: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, the dimensions and their bins, the curve's cell and a key that tells rows apart.

    Size is the text's UTF-8 bytes and 1; a null text has none. Null languages and sources come before
    all names, null doc_ids are ordered by their texts. Equal rows get places next to each other. If
    `whole`, the row itself goes along as `document`.
    """
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"),
        F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{source}`").cast("string").alias("source"), F.xxhash64(F.col(f"`{doc_id}`"), t).alias("key"),
        *[F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document")] * whole,
    )
    rows = size_bins(common.saved(rows, "shard-metadata"))
    for name in DIMENSIONS[1:]:
        rows = name_bins(rows, name)
    return curve_index(rows, [f"{d}_bin" for d in DIMENSIONS], "cell")


def shards(docs: DataFrame, n: int, **columns: str) -> DataFrame:
    """metadata() of every row with its shard (0 to n - 1) and slot (from 0, without gaps).

    The law is `rows`: shards' counts are at most one apart. An empty table gives no rows; with
    fewer rows than shards the last shards are empty.
    """
    return placed(metadata(docs, **columns), n)


def manifest(rows: DataFrame) -> DataFrame:
    """For each shard its rows, bytes, and of each dimension the least and greatest value and how many are null, for pruning."""
    ranges = [x for d in DIMENSIONS for x in (F.min(d).alias(f"{d}_min"), F.max(d).alias(f"{d}_max"), F.count_if(F.col(d).isNull()).alias(f"{d}_nulls"))]
    return rows.groupBy("shard").agg(F.count("*").alias("n_rows"), F.sum("size").alias("n_bytes"), *ranges)


def prune(manifest_rows: DataFrame, **wanted: tuple) -> DataFrame:
    """The shards that can hold rows with values in the given ranges, e.g. prune(m, size=(1000, 5000), lang=("de", "en")); (None, None) asks for nulls."""
    for d, (lo, hi) in wanted.items():
        some = F.col(f"{d}_nulls") > 0 if lo is None and hi is None else (F.col(f"{d}_min") <= hi) & (F.col(f"{d}_max") >= lo)
        manifest_rows = manifest_rows.where(some)
    return manifest_rows.select("shard")


def write_shards(docs: DataFrame, n: int, path: str, doc_id: str = "doc_id") -> DataFrame:
    """Write docs under `path`, a folder for each shard in curve order, and the manifest beside them; returns the manifest.

    Each row is written once, at its own place, repeated rows and rows without a doc_id too.
    """
    rows = common.saved(placed(metadata(docs, doc_id=doc_id, whole=True), n), "shards")
    at, slot = common.fresh(docs, "shard", "slot")
    placed_docs = rows.select(*[F.col("document")[c].alias(c) for c in docs.columns], F.col("shard").alias(at), F.col("slot").alias(slot))
    placed_docs.repartitionByRange(at, slot).sortWithinPartitions(at, slot).drop(slot).write.partitionBy(at).parquet(path)
    out = manifest(rows)
    out.coalesce(1).write.parquet(f"{path}/_manifest")  # a row for each shard; readers of the shards pass over it
    return docs.sparkSession.read.schema(out.schema).parquet(f"{path}/_manifest")


def op3_hilbert_shards(spark, sf_dir: str) -> DataFrame:
    """Shard and slot of every document among eight shards of equal row counts."""
    rows = shards(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source"), 8)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "cell", "size_bin", "lang_bin", "source_bin")
