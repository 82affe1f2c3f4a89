"""What the operators share: shipping the package, tables in the shared folder, Arrow batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..shared import drop, saved, shared_dir, ship  # noqa: F401

#: Upper bound of one Arrow batch handed to Python; one row larger than this travels alone.
ARROW_BATCH_BYTES = 4 << 20

def prepare(spark: SparkSession) -> None:
    """Give executors this package (once per application) and bound the Arrow batches, by a setting of the session that stays."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))
    ship(spark)


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that don't clash with df's own, in any letter case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


#: Code points in a block of a text that is cut to pieces.
BLOCK = 4096


def blocks(text: Column) -> Column:
    """A text as an array of blocks of BLOCK code points, the last one shorter; to be a column of its own before cut()."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def cut(parts: Column, start: Column, stop: Column) -> Column:
    """The code points [start, stop) of a text given as blocks(), at a cost of its own length and two blocks, wherever it lies."""
    first, last = F.floor(start / BLOCK).cast("int"), F.floor((stop - 1) / BLOCK).cast("int")
    at = (start % BLOCK).cast("int") + 1
    within = F.substring(F.element_at(parts, first + 1), at, (stop - start).cast("int"))
    begin = F.substring(F.element_at(parts, first + 1), at, F.lit(BLOCK))
    end = F.substring(F.element_at(parts, last + 1), F.lit(1), ((stop - 1) % BLOCK).cast("int") + 1)
    across = F.concat(begin, F.array_join(F.slice(parts, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), end)
    return F.when(stop <= start, F.lit("")).when(first == last, within).otherwise(across)


#: Elements in a block of running().
RUN = 128


def running_sql(numbers: str, greatest: bool = False) -> str:
    """SQL for running() of the numbers that a name stands for. One text instead of many calls keeps large plans quick to build."""
    add = (lambda x, y: f"greatest({x}, {y})") if greatest else (lambda x, y: f"{x} + {y}")
    fold = lambda values: f"aggregate({values}, named_struct('at', 0L, 'before', cast(array() as array<bigint>)), (a, x) -> named_struct('at', {add('a.at', 'cast(x as bigint)')}, 'before', concat(a.before, array(a.at))))"
    parts = f"transform(sequence(0, cast(ceil(size({numbers}) / {RUN}) as int) - 1), i -> {fold(f'slice({numbers}, i * {RUN} + 1, {RUN})')})"
    # both arrays are made once and bound to names by a fold over one element
    joined = f"transform(array({parts}), p -> flatten(zip_with(p, {fold('transform(p, y -> y.at)')}.before, (x, y) -> transform(x.before, b -> {add('b', 'y')}))))[0]"
    return f"CASE WHEN size({numbers}) > 0 THEN {joined} ELSE cast(array() as array<bigint>) END"


def running(numbers: str, greatest: bool = False) -> Column:
    """For each of the non-negative numbers in an array column what those before it add up to, or the greatest of them (0 for the first).

    Folds grow an array, which copies it, so they go over blocks: within each, then over the blocks'
    totals. For n numbers about n * RUN / 2 + (n / RUN) ** 2 / 2 numbers are copied.
    """
    return F.expr(running_sql(f"`{numbers}`", greatest))
