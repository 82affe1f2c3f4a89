"""Statistics over rollouts, runs and audits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..shared import drop, saved

#: Different values of a group that one task orders, at most, and buckets that a wider range is cut to at a time.
ORDERED, BUCKETS = 1 << 16, 1 << 12


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """100 * part / whole, null where whole is 0."""
    return F.round(F.try_divide(100.0 * part, whole), digits)


def rollout_stats(rows: DataFrame, by: list[str] | None = None, prompt: str = "class_key", quality: str = "quality", digits: int | None = None) -> DataFrame:
    """Fourteen figures over rollouts (usable, compiled, is_green, terminated, n_tests, line and mutation
    percentages, quality), for each group of `by`.

    Two levels: sums by prompt carry the spread of quality within a prompt (population deviation, of
    prompts with two or more rollouts) and its distinct values; the others are taken over all rows.
    Only usable rows count, but for the number of rollouts. A null quality counts as 0. Percents are
    rounded to 1 digit, medians and distinct values to 2, means to 4, or all to `digits`.
    """
    by = by or []
    places = lambda n: n if digits is None else digits
    q = F.coalesce(F.col(quality).cast("double"), F.lit(0.0))
    u = F.col("usable")
    when = lambda c: F.count(F.when(c, 1))
    some = lambda c, x: F.when(c, x)
    all_rows = rows.groupBy(*by).agg(
        F.count("*").alias("rollouts"), when(u).alias("usable"),
        percent(when(u & F.col("compiled")), when(u), places(1)).alias("compiled_pct"), percent(when(u & F.col("is_green")), when(u), places(1)).alias("green_pct"),
        percent(when(u & F.col("terminated")), when(u), places(1)).alias("terminated_pct"),
        F.round(F.avg(some(u, q)), places(4)).alias("mean_quality"),
    )
    prompts = rows.where(u).groupBy(*by, F.col(prompt)).agg(F.count("*").alias("n"), F.bool_or("compiled").alias("c"), F.bool_or("is_green").alias("g"), F.stddev_pop(q).alias("spread"), F.count_distinct(q).alias("values"))
    two = prompts.groupBy(*by).agg(
        F.count("*").alias("prompts"), F.count_if("c").alias("prompts_any_compile"), F.count_if("g").alias("prompts_any_green"),
        F.round(F.avg(F.when(F.col("n") > 1, F.col("spread"))), places(4)).alias("within_prompt_stdev"), F.round(F.avg("values"), places(2)).alias("distinct_values_per_prompt"),
    )
    middle = medians(rows, {"median_tests": some(u, F.col("n_tests")), "median_line_coverage_compiling": some(u & F.col("compiled"), F.col("line_coverage_pct")), "median_mutation_green": some(u & F.col("compiled") & F.col("is_green"), F.col("mutation_score_pct"))}, by)
    middle = middle.withColumns({c: F.round(c, places(2)) for c in middle.columns if c not in by})
    return _beside(_beside(all_rows, middle, by), two, by)


def _beside(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    if not by:
        return a.join(b, F.lit(True), "left")  # a has one row, b one or, of medians without any value, none
    right = b.withColumnsRenamed({c: f"{c}__b" for c in by})
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}__b"))
    return a.join(right, same, "left").drop(*[f"{c}__b" for c in by])


def at_ranks(rows: DataFrame, value: str, ranks: dict[str, Callable[[Column], Column]], by: list[str] | None = None) -> DataFrame:
    """For each group the values at ranks (from 0) of the ascending order, exactly: columns of by, and one for each rank, told from the group's size.

    Equal values are counted first. While a rank lies among more than ORDERED different values, their range
    is cut to BUCKETS, which are counted in a shuffle of their own, and the bucket that holds the rank is
    the new range, from its least to its greatest value; so no task orders more than ORDERED values or holds
    a group. Null values don't count, NaN is the greatest; a group without values gives no row. Where no
    group has more than ORDERED values to begin with, nothing is written.
    """
    by = by or []
    own = rows.where(F.col(value).isNotNull())
    if _largest(own, by) <= ORDERED:
        counts = own.groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
        w = counts.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*by).orderBy("_v"))).withColumn("_total", F.sum("_n").over(Window.partitionBy(*by)))
        at = lambda rank: (F.col("_upto") - F.col("_n") <= rank(F.col("_total"))) & (rank(F.col("_total")) < F.col("_upto"))
        return w.groupBy(*by).agg(F.count("*").alias("_some"), *[F.max(F.when(at(rank), F.col("_v"))).alias(k) for k, rank in ranks.items()]).where("_some > 0").drop("_some")
    g = F.struct(F.lit(1).alias("_"), *by).alias("g")
    counts = saved(own.select(g, F.col(value).alias("v")).groupBy("g", "v").agg(F.count("*").alias("n")), "value-counts")
    whole = counts.groupBy("g").agg(F.sum("n").alias("total"), F.count("*").alias("values"), F.min("v").alias("low"), F.max("v").alias("high"))
    wanted = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), rank(F.col("total")).cast("long").alias("rank")) for k, rank in ranks.items()])).alias("r")
    state = saved(whole.select("g", "values", "low", "high", wanted).select("g", "r.name", "r.rank", "values", "low", "high"), "ranks")
    while not (wide := state.where(F.col("values") > ORDERED)).isEmpty():
        v, low, high = (F.col(c).cast("double") for c in ("v", "low", "high"))
        at = F.when(F.col("v") == F.col("low"), 0).when(F.col("v") == F.col("high"), BUCKETS + 1).otherwise(1 + F.greatest(F.lit(0), F.least(F.lit(BUCKETS - 1), F.floor((v - low) / (high - low) * BUCKETS))))
        held = counts.join(wide.drop("values"), "g").where(F.col("v").between(F.col("low"), F.col("high")))
        sums = held.groupBy("g", "name", "rank", at.cast("int").alias("bucket")).agg(F.sum("n").alias("n"), F.count("*").alias("values"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = F.sum("n").over(Window.partitionBy("g", "name").orderBy("bucket"))  # over BUCKETS + 2 rows
        one = sums.withColumn("before", upto - F.col("n")).where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n")))
        narrower = saved(state.where(F.col("values") <= ORDERED).unionByName(one.select("g", "name", (F.col("rank") - F.col("before")).alias("rank"), "values", "low", "high")), "ranks")
        drop(state)
        state = narrower
    held = counts.join(state, "g").where(F.col("v").between(F.col("low"), F.col("high")))
    upto = F.sum("n").over(Window.partitionBy("g", "name").orderBy("v"))
    found = held.withColumn("upto", upto).where((F.col("upto") - F.col("n") <= F.col("rank")) & (F.col("rank") < F.col("upto")))
    return found.groupBy("g").agg(*[F.max(F.when(F.col("name") == k, F.col("v"))).alias(k) for k in ranks]).select(*[F.col("g")[c].alias(c) for c in by], *ranks)


def _largest(rows: DataFrame, by: list[str]) -> int:
    """The number of rows in the largest group."""
    return rows.groupBy(*by).agg(F.count("*").alias("n_")).agg(F.max("n_")).first()[0] or 0


def medians(rows: DataFrame, values: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """The exact medians of several columns by group, as doubles: of an even number of values the mean of the middle two, null where there is none.

    A group without any value gives no row. Where no group has more than ORDERED rows, each is ordered
    within an aggregation; else ranks are found as at_ranks() does.
    """
    by = by or []
    if _largest(rows, by) <= ORDERED:
        found = rows.groupBy(*by).agg(*[F.median(x.cast("double")).alias(k) for k, x in values.items()])
        return found.where(F.coalesce(*values).isNotNull())
    each = rows.select(*by, F.explode(F.array(*[F.struct(F.lit(k).alias("_name"), x.cast("double").alias("_value")) for k, x in values.items()])).alias("_r")).select(*by, "_r.*")
    two = at_ranks(each, "_value", {"_a": lambda n: F.floor((n - 1) / 2), "_b": lambda n: F.floor(n / 2)}, [*by, "_name"])
    found = two.groupBy(*by).agg(*[F.max(F.when(F.col("_name") == k, (F.col("_a") + F.col("_b")) / 2)).alias(k) for k in values])
    return found


def at_share(rows: DataFrame, value: str, share: float | None, by: list[str] | None = None, out: str = "value") -> DataFrame:
    """The value at index floor(n * share) of the ascending order (the upper middle for None), by group."""
    return at_ranks(rows, value, {out: lambda n: F.least(F.floor(n / 2) if share is None else F.floor(n * F.lit(share)), n - 1)}, by)


def recall(rows: DataFrame, group: str, hit: Column, miss: Column, total_name: str = "ALL") -> DataFrame:
    """Hits, misses and their shares by group, with a row over all groups."""
    sums = rows.rollup(group).agg(F.count(F.when(hit, 1)).alias("n_hit"), F.count(F.when(miss, 1)).alias("n_miss"), F.grouping(group).alias("over_all"))
    name = F.when(F.col("over_all") == 1, total_name).otherwise(F.col(group))
    return sums.select(name.alias(group), "n_hit", "n_miss", F.round(F.try_divide(F.col("n_hit"), F.col("n_hit") + F.col("n_miss")), 6).alias("recall"))


def shares(rows: DataFrame, category: str, size: str) -> DataFrame:
    """Rows and sizes by category and their shares of all (categories, not rows, meet in one task)."""
    sums = rows.groupBy(category).agg(F.count("*").alias("n"), F.sum(size).alias("size"))
    over = Window.partitionBy(F.lit(0))
    return sums.select(category, "n", "size", F.round(F.col("n") / F.sum("n").over(over), 6).alias("n_share"), F.round(F.col("size") / F.sum("size").over(over), 6).alias("size_share"))


def cumulative(rows: DataFrame, key: str, wanted: str, size: str) -> DataFrame:
    """Groups best first by their share of wanted rows, with running totals: one row for each group."""
    groups = rows.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col(wanted)).alias("n_wanted"), F.sum(size).alias("size"))
    groups = groups.withColumn("rate", F.round(F.col("n_wanted") / F.col("n"), 6))
    order = Window.orderBy(F.desc("rate"), key)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return groups.select(key, "n", "n_wanted", "rate", F.row_number().over(order).alias("place"), F.sum("n_wanted").over(upto).alias("wanted_upto"), F.sum("size").over(upto).alias("size_upto"))


def wins(pairs: DataFrame, a: str, b: str, margin: float = 0.5) -> DataFrame:
    """How often a beats b, b beats a, or neither by more than the margin; pairs with a null don't count."""
    verdict = F.when(F.col(a) - F.col(b) > margin, "a").when(F.col(b) - F.col(a) > margin, "b").otherwise("tie")
    return pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(verdict.alias("winner")).count()


def run_summary(rows: DataFrame, run: str = "run_id", seq: str = "seq") -> DataFrame:
    """By run: compiles, failures, red rounds, the best green mutation (first of equals; null and 0 tie),
    and whether the first compile worked and was green."""
    ok, green = F.coalesce(F.col("compiler_success"), F.lit(False)), F.coalesce(F.col("suite_green"), F.lit(False))
    rank = F.when(green, F.struct(F.coalesce(F.nullif(F.col("mutation"), F.lit(0.0)), F.lit(-1.0)).alias("m"), (-F.col(seq)).alias("s")))
    return rows.groupBy(run).agg(
        F.count("*").alias("compiles"), F.count_if(~ok).alias("compile_failures"), F.count_if(ok & ~green).alias("red_rounds"), F.bool_or(green).alias("ended_green"),
        F.max_by(F.col("mutation"), rank).alias("best_mutation"), F.min_by(ok, seq).alias("first_compile_ok"), F.min_by(green, seq).alias("first_compile_green"),
    )


def error_tally(rows: DataFrame, errors: Column, kind, run: str = "run_id") -> DataFrame:
    """Errors by run and kind; `errors` is an array of a row's messages, each counted once for a row."""
    each = rows.select(run, F.explode(F.array_distinct(errors)).alias("m"))
    return each.groupBy(run, kind(F.col("m")).alias("kind")).count()


def run_figures(calls: DataFrame, errors: DataFrame, run: str = "run_id") -> DataFrame:
    """By run: calls, tokens in and out, retries, and a map of errors by kind. errors (run, kind)."""
    c = calls.groupBy(run).agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("tokens_in"), F.sum("output_tokens").alias("tokens_out"), F.count_if(F.col("node_name").endswith(":no_thinking_retry")).alias("retries"))
    kinds = errors.groupBy(run, "kind").agg(F.count("*").alias("n")).groupBy(run).agg(F.map_from_entries(F.collect_list(F.struct("kind", "n"))).alias("errors"))  # a few kinds
    return c.join(kinds, run, "left")


def prefix_medians(sizes: DataFrame, curve: DataFrame, cut: str, pattern: str, size: str) -> DataFrame:
    """(place, median_size): for each prefix of patterns, best first, the median over all classes of what the prefix gives them.

    Classes a prefix gives nothing count as 0. There is a row for each class and place.
    """
    places = curve.agg(F.max("place")).first()[0]
    own = sizes.join(curve.select(pattern, "place"), pattern).groupBy(cut, "place").agg(F.sum(size).alias("own"))
    if places is None:
        return own.select("place", F.lit(None).cast("double").alias("median_size"))
    grid = sizes.select(cut).distinct().withColumn("place", F.explode(F.sequence(F.lit(1), F.lit(places))))
    upto = F.sum(F.coalesce(F.col("own"), F.lit(0))).over(Window.partitionBy(cut).orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    rows = grid.join(own, [cut, "place"], "left").withColumn("upto", upto)
    return medians(rows, {"median_size": F.col("upto")}, ["place"])
