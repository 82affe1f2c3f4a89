"""Attribution: points to the intervals that hold them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


#: Bits between a level of bins and the next: each bin has 2 ** STEP of the level below, so points ask about 64 / STEP bins at most.
STEP = 4


def level_of(start: Column, end: Column) -> Column:
    """The level of the smallest bin that holds a span of whole numbers: a bin of level n is 2 ** n wide and begins at a multiple of that; levels are multiples of STEP."""
    differ = start.cast("long").bitwiseXOR(end.cast("long"))
    return F.when(differ == 0, 0).otherwise(F.ceil(F.length(F.bin(differ)) / STEP).cast("int") * STEP)


def bin_of(at: Column, level: Column) -> Column:
    """The bin of a level that holds a place; one bin of level 64 holds all."""
    return F.when(level >= 64, F.lit(0).cast("long")).otherwise(F.call_function("shiftright", at.cast("long"), level))


def whole(rows: DataFrame, name: str) -> Column:
    """A column of whole numbers, or of times as microseconds, as longs that rise with it."""
    kind, c = rows.schema[name].dataType.typeName(), F.col(name)
    if kind == "timestamp":
        return F.unix_micros(c)
    if kind == "timestamp_ntz":  # told from its parts: a time zone's jumps would turn times round
        return F.unix_date(c.cast("date")) * F.lit(86_400_000_000) + ((F.hour(c) * 60 + F.minute(c)).cast("long") * F.lit(60_000_000) + (F.date_part(F.lit("SECOND"), c) * 1_000_000)).cast("long")
    return c.cast("long")


def containing(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, pick: Column, keep: list[str], columns: list[str]) -> DataFrame:
    """Each point with the span of its key that holds it (start <= at <= end, whole numbers or times), null where none does.

    `pick` orders the spans that hold a point, the least is taken; `keep` tells points apart. Bins are
    hierarchical: each span lies in the one smallest bin that holds it, whatever its length, and each point
    asks one bin of every level that has spans (17 at most). So the join is by key, level and bin: a hot
    key's spans and points meet bin by bin, and a span is one row. The choice is a partial aggregate. A
    span without a start or an end, or that ends before it starts, holds nothing.
    """
    s = spans.select(F.col(key).alias("k_"), whole(spans, start).alias("s_"), whole(spans, end).alias("e_"), *[F.col(c).alias(f"{c}_") for c in columns], pick.alias("p_"))
    s = s.where("s_ <= e_").withColumn("l_", level_of(F.col("s_"), F.col("e_"))).withColumn("c_", bin_of(F.col("s_"), F.col("l_")))
    levels = [r["l_"] for r in s.select("l_").distinct().collect()]  # at most 17
    asked = points.withColumn("at_", whole(points, at)).withColumn("at_level_", F.explode(F.array(*map(F.lit, levels or [0])))).withColumn("at_bin_", bin_of(F.col("at_"), F.col("at_level_")))
    same = (F.col(key) == F.col("k_")) & (F.col("at_level_") == F.col("l_")) & (F.col("at_bin_") == F.col("c_")) & F.col("at_").between(F.col("s_"), F.col("e_"))
    held = asked.join(s, same, "left")
    return held.groupBy(*keep).agg(F.min_by(F.struct(*[F.col(f"{c}_").alias(c) for c in columns]), "p_").alias("r")).select(*keep, "r.*")


def attribute_errors(errors: DataFrame, spans: DataFrame) -> DataFrame:
    """errors (suite, row, message), spans (suite, name, start, end) -> by suite the broken names, and the
    errors outside of all spans. The first span by start holds a line."""
    held = containing(errors.withColumn("n_", F.monotonically_increasing_id()), spans, "suite", "row", "start", "end", F.col("start"), ["suite", "n_", "row"], ["name"])
    return held.groupBy("suite").agg(F.array_sort(F.collect_set("name")).alias("broken"), F.count_if(F.col("name").isNull()).alias("n_skeleton_errors"), F.count("*").alias("n_errors"))


def smallest_enclosing(points: DataFrame, spans: DataFrame) -> DataFrame:
    """points (suite, row), spans (suite, name, kind, start, end, size): a test that holds the point, the
    first by start, else the smallest declaration; the suite gets null names if any point has none."""
    order = F.struct(F.when(F.col("kind") == "test", 0).otherwise(1), F.when(F.col("kind") == "test", F.col("start")).otherwise(F.col("size")), F.col("start"), F.col("name"))
    held = containing(points, spans, "suite", "row", "start", "end", order, ["suite", "row"], ["name"])
    whole = F.min(F.col("name").isNotNull()).over(Window.partitionBy("suite"))
    return held.withColumn("name", F.when(whole, F.col("name")))


def by_name_or_none(wanted: DataFrame, spans: DataFrame) -> DataFrame:
    """wanted (suite, name) -> by suite the ranges of all wanted names, or null if one isn't found."""
    held = wanted.distinct().join(spans.select("suite", "name", "start", "end"), ["suite", "name"], "left")
    return held.groupBy("suite").agg(F.when(F.bool_and(F.col("start").isNotNull()), F.sort_array(F.collect_list(F.struct("start", "end")), asc=False)).alias("ranges"))
