"""Mixing sources to target weights by hash-threshold histograms (operator 7), in built-in functions only.

Each document has a place in [0, 2**32) by the hash of its id. A source's share is a number of whole
copies and a budget of words that a threshold on the place meets. The words by source and coarse
bucket of places say in which bucket the threshold lies; only that bucket is summed again, in finer
buckets. Documents are then kept by comparing their place with the threshold: no sort, no shuffle of
texts, and a larger budget keeps all that a smaller one kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common

#: Coarse buckets and fine buckets within the boundary bucket.
COARSE, FINE = 256, 256
#: No source is taken more often than this.
MOST_COPIES = 3
#: Weights of sources by code point, repeating.
WEIGHTS = (1, 2, 3)
#: Fixed value: what lies between words.
BLANK = r"[\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """The number of words; a null text has none."""
    parts = F.split(F.coalesce(text.cast("string"), F.lit("")), BLANK, -1)
    return (F.size(parts) - (F.element_at(parts, 1) == "").cast("int") - ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")).cast("long")


def targets(sizes: DataFrame, most: int = MOST_COPIES, weights: tuple = WEIGHTS) -> DataFrame:
    """source, source_size -> with weight and target.

    The targets share the sum of all sizes by weight; none is above `most` times its source's size,
    and what that leaves over goes to the others by weight. So there is a level L with
    target = min(most * size, L * weight): sources ordered by most * size / weight are full up to
    some point, and the first that isn't, given all before it are, sets L. One row for each source.
    """
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    rows = sizes.withColumn("weight", weight.cast("double")).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    filled = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    everyone = filled.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everyone) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(filled.rowsBetween(0, Window.unboundedFollowing))
    open_at = F.when(level * F.col("weight") <= F.col("cap"), level)
    rows = rows.withColumn("level", open_at).withColumn("level", F.first("level", ignorenulls=True).over(everyone))
    return rows.select("source", "source_size", "weight", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def plan(sized: DataFrame, most: int = MOST_COPIES, weights: tuple = WEIGHTS) -> DataFrame:
    """For each source of (source, place, size): source_size, target, copies and threshold.

    A document is taken `copies` times, and once more if its place is below `threshold`.
    """
    width, fine_width = (1 << 32) // COARSE, (1 << 32) // COARSE // FINE
    coarse = common.saved(sized.groupBy("source", F.floor(F.col("place") / width).alias("bucket")).agg(F.sum("size").alias("size")), "mix-coarse")
    per_source = targets(coarse.groupBy("source").agg(F.sum("size").alias("source_size")), most, weights)
    goals = per_source.select(
        F.col("source").alias("s"), "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).alias("copies"),
    ).withColumn("budget", F.col("target") - F.col("copies") * F.col("source_size"))
    goals = common.saved(goals, "mix-goals")

    def boundary(hist: DataFrame, key: list[str]) -> DataFrame:
        """The bucket in which the running sum passes the budget, and the sum before it."""
        order = Window.partitionBy(*key).orderBy("bucket")
        run = hist.withColumn("upto", F.sum("size").over(order)).withColumn("before", F.col("upto") - F.col("size"))
        return run.where((F.col("before") <= F.col("budget")) & (F.col("upto") > F.col("budget")))

    first = boundary(coarse.join(goals, F.col("source").eqNullSafe(F.col("s"))).drop("s"), ["source"])
    first = common.saved(first.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.col("before").alias("sum_before"), "budget"), "mix-boundary")
    inside = sized.join(first, F.col("source").eqNullSafe(F.col("s")) & (F.floor(F.col("place") / width) == F.col("b")))
    fine = inside.groupBy("source", "b", "sum_before", "budget", F.floor(F.col("place") % width / fine_width).alias("bucket")).agg(F.sum("size").alias("size"))
    fine = fine.withColumn("budget", F.col("budget") - F.col("sum_before"))
    second = boundary(fine, ["source"]).select(
        F.col("source").alias("s2"),
        # the boundary's own fine bucket comes in if that ends nearer to the budget
        (F.col("b") * width + (F.col("bucket") + F.when(F.col("upto") - F.col("budget") < F.col("budget") - F.col("before"), 1).otherwise(0)) * fine_width).alias("threshold"),
    )
    rows = goals.join(second, F.col("s").eqNullSafe(F.col("s2")), "left").select(F.col("s").alias("source"), "source_size", "target", "copies", F.coalesce("threshold", F.lit(0)).alias("threshold"))
    # written, so that Spark knows its size and sends it to the rows instead of dealing these by source
    return common.saved(rows, "mix-plan")


def sized_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    return docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").cast("string").alias("source"), n_words(F.col(f"`{text}`")).alias("size"),
        # the id's hash; rows of one id (or none) lie apart by their texts
        F.xxhash64(F.col(f"`{doc_id}`"), F.xxhash64(F.col(f"`{text}`"))).bitwiseAND(F.lit((1 << 32) - 1)).alias("place"),
    )


def with_copies(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """rows (source, place, …) with source_size, target and n_copies; goals are small, so rows stay where they are."""
    g = goals.withColumnRenamed("source", "goal_source")
    joined = rows.join(g, F.col("source").eqNullSafe(F.col("goal_source")))
    return joined.withColumn("n_copies", (F.col("copies") + F.when(F.col("place") < F.col("threshold"), 1).otherwise(0)).cast("long")).drop("goal_source", "copies", "threshold")


def mix(docs: DataFrame, most: int = MOST_COPIES, weights: tuple = WEIGHTS, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mixed documents: each row of docs as often as the mix takes it.

    Null sources are one source, the last; null or empty texts have no words and are taken like
    others of their source. Rows without words in a source without words are never taken. Repeated
    rows are decided alike. An empty table gives no rows. Columns keep their names, whatever they are.
    Sources, not rows, are ordered in one task; a row each.
    """
    goals = plan(common.saved(sized_rows(docs, doc_id, text, source), "mix-sizes"), most, weights)
    place, name, size, target, copies, threshold = common.fresh(docs, "place", "goal_source", "goal_size", "goal_target", "goal_copies", "goal_threshold")
    g = goals.toDF(name, size, target, copies, threshold)
    with_place = docs.withColumn(place, F.xxhash64(F.col(f"`{doc_id}`"), F.xxhash64(F.col(f"`{text}`"))).bitwiseAND(F.lit((1 << 32) - 1)))
    joined = with_place.join(g, F.col(f"`{source}`").cast("string").eqNullSafe(F.col(name)))
    often = (F.col(copies) + F.when(F.col(place) < F.col(threshold), 1).otherwise(0)).cast("int")
    return joined.withColumn(copies, F.explode(F.array_repeat(F.lit(0), often))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_hash_threshold_mix(spark, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    sized = common.saved(sized_rows(docs), "mix-sizes")
    rows = with_copies(sized, plan(sized))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("n_copies")).alias("taken"))
