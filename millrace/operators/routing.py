"""Routing of rollouts: keyed joins, resumption, ranking with total orders, accumulation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..shared import saved
from . import stats


def resume(todo: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """The rows whose key isn't done yet."""
    return todo.join(done.select(*key).distinct(), key, "left_anti")


def overlay(base: DataFrame, over: DataFrame, key: list[str]) -> DataFrame:
    """Rows of both by key, whole rows of `over` in place of those of `base`; missing columns are null."""
    columns = list(dict.fromkeys([*base.columns, *over.columns]))
    wide = lambda d: d.select(*[F.col(c) if c in d.columns else F.lit(None).cast((base.schema if c in base.columns else over.schema)[c].dataType).alias(c) for c in columns])
    left = wide(base).select(*key, F.struct(*columns).alias("b"))
    right = wide(over).select(*key, F.struct(*columns).alias("o"))
    return left.join(right, key, "full_outer").select(F.coalesce("o", "b").alias("r")).select("r.*")


def top(rows: DataFrame, key: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each key in a total order, with their ranks from 1."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col(rank) <= n)


def best(rows: DataFrame, key: list[str], order: Column, *columns: str) -> DataFrame:
    """The row of each key that is greatest in a total order, by a partial aggregate instead of a sort."""
    return rows.groupBy(*key).agg(F.max_by(F.struct(*columns), order).alias("r")).select(*key, "r.*")


def last_where(rows: DataFrame, key: list[str], seq: str, holds: Column, *columns: str) -> DataFrame:
    """Of each key the last row for which a condition holds; keys without one are left out."""
    return best(rows.where(holds), key, F.col(seq), *columns)


def first_accepted(ranked: DataFrame, key: list[str], accepted: Column, rank: str = "rank") -> DataFrame:
    """The first accepted row of each key and the number of rows tried until then (all, if none is)."""
    found = F.min(F.when(accepted, F.col(rank)))
    return ranked.groupBy(*key).agg(found.alias("chosen"), F.count("*").alias("n")).withColumn("n_tried", F.coalesce("chosen", "n")).drop("n")


def accumulate(rows: DataFrame, key: list[str], order: Column, *columns: str) -> DataFrame:
    """One row for each key over all rounds: the greatest in `order`, which must end in what tells rows apart."""
    return best(rows, key, order, *columns)


def round_robin(rows: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """n rows, one of each group in turn: by place within the group, then by group.

    Only n rows of a group can be taken, so the place is limited before the last order.
    """
    placed = top(rows, [group], order, n, "place")
    return placed.orderBy("place", group).limit(n)


def caps(prompts: DataFrame, references: DataFrame, key: str, most: int, spare: int = 16, default: int = 4096) -> DataFrame:
    """prompts with max_tokens: twice the reference and 64, at most what the model's length leaves.

    Prompts without a reference take the median of all references (whole), or `default` without any.
    """
    middle = stats.medians(references, {"m": F.col("tokens")}).agg(F.coalesce(F.floor(F.max("m")), F.lit(default)).alias("middle"))
    rows = prompts.join(references.select(key, "tokens"), key, "left").join(F.broadcast(middle))  # one row
    cap = 2 * F.coalesce("tokens", "middle") + 64
    return rows.withColumn("max_tokens", F.least(cap, most - F.col("prompt_tokens") - spare)).drop("tokens", "middle")


def dataset(targets: DataFrame, prompts: DataFrame, key: str, cutoff: int) -> DataFrame:
    """Pairs of instruction and output that fit the cutoff together, with the tokens of both."""
    return _with_tokens(targets, prompts, key).where(F.col("tokens") <= cutoff)


def _with_tokens(targets: DataFrame, prompts: DataFrame, key: str) -> DataFrame:
    return targets.join(prompts, key).withColumn("tokens", F.col("prompt_tokens") + F.col("output_tokens"))


def dataset_counts(targets: DataFrame, prompts: DataFrame, key: str, cutoff: int, by: list[str] | None = None) -> DataFrame:
    """How many pairs dataset() keeps and how many it drops as too long, in all or by group."""
    long = F.col("tokens") > cutoff
    return _with_tokens(targets, prompts, key).groupBy(*by or []).agg(F.count_if(~long).alias("n_kept"), F.count_if(long).alias("n_dropped"))


def deltas(rows: DataFrame, key: str, seq: str, value: str, least: float) -> DataFrame:
    """Each value against the one before (a missing one carries the last on), and whether that is an
    improvement of at least `least`."""
    order = Window.partitionBy(key).orderBy(seq)
    held = rows.withColumn("held", F.last(value, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    delta = F.round(F.col("held") - F.lag("held").over(order), 6)
    return held.withColumn("delta", delta).withColumn("improved", F.coalesce(F.col("delta") >= least, F.lit(False)))


def streaks(rows: DataFrame, key: str, order: list[Column | str], failed: Column) -> DataFrame:
    """rows with `streak`: failures in a row up to and with this one, 0 for a success."""
    w = Window.partitionBy(key).orderBy(*order)
    island = F.sum(F.when(failed, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("failed_", failed).withColumn("island_", island)
    run = F.sum(F.col("failed_").cast("int")).over(Window.partitionBy(key, "island_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("streak", run).drop("failed_", "island_")


def overlaps(rows: DataFrame, key: str, start: str, end: str, order: list[str]) -> DataFrame:
    """By key, whether a range begins at or before the end of the one before it."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("o", F.coalesce(F.col(start) <= F.lag(end).over(w), F.lit(False))).groupBy(key).agg(F.count("*").alias("n_ranges"), F.count_if("o").alias("n_overlaps"))


def keep_first(rows: DataFrame, key: list[str], seq: str, *columns: str) -> DataFrame:
    """The first row of each key by seq."""
    return rows.groupBy(*key).agg(F.min_by(F.struct(seq, *columns), seq).alias("r"), F.count("*").alias("n_rows")).select(*key, "r.*", "n_rows")


def tagged_union(parts: dict[str, DataFrame], tag: str = "kind") -> DataFrame:
    """The rows of several tables, each with its name."""
    out = None
    for name, df in parts.items():
        df = df.withColumn(tag, F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out


def rotation(classes: DataFrame, arms: list[str], index: str = "idx") -> DataFrame:
    """For each class the arms in an order turned by its index: arm and turn."""
    each = classes.select("*", F.posexplode(F.array(*map(F.lit, arms))).alias("arm_idx", "arm"))
    return each.withColumn("turn", F.pmod(F.col("arm_idx") - F.col(index), F.lit(len(arms)))).drop("arm_idx")


def over_limit(tokens: Column, most: int) -> Column:
    """Whether a prompt is longer than the limit; just as long is not."""
    return tokens > most


def mode(file: Column, name: Column) -> Column:
    """A run's mode: of a rollout's file, of a single class, or of all classes."""
    return F.when(file.isNotNull(), "rollout").when(name.isNotNull(), "single").otherwise("batch")


def upto_round(rows: DataFrame, last: int, column: str = "round") -> DataFrame:
    """The rows of all rounds up to one; of a table partitioned by round the others aren't read."""
    return rows.where(F.col(column) <= last)


def trimmed_deltas(rows: DataFrame, key: str, seq: str, value: str, trimmed: str, least: float) -> DataFrame:
    """deltas() that begin anew with each suite trimmed to green: its own delta is null, as its score is absolute."""
    order = Window.partitionBy(key).orderBy(seq)
    part = F.sum(F.col(trimmed).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    within = Window.partitionBy(key, "part_").orderBy(seq)
    held = rows.withColumn("part_", part).withColumn("held", F.last(value, ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    delta = F.when(~F.col(trimmed), F.round(F.col("held") - F.lag("held").over(within), 6))
    return held.withColumn("delta", delta).withColumn("improved", F.coalesce(F.col("delta") >= least, F.lit(False))).drop("part_")


def updated_map(rows: DataFrame, key: str, seq: str, name: str, value: str, out: str = "map") -> DataFrame:
    """By key a map of names to the values set last."""
    last = rows.groupBy(key, name).agg(F.max_by(value, seq).alias("v"))
    return last.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(name, "v"))).alias(out))


def checked_join(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """The inner join of left with right by key; a row of left without a partner is an error at run time."""
    rows = left.join(right.withColumn("found_", F.lit(True)), key, "left")
    told = F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), F.coalesce(F.col(k).cast("string"), F.lit("null"))) for k in key])
    return rows.where(F.when(F.col("found_"), True).otherwise(F.raise_error(F.concat(F.lit("nothing for "), told)).cast("boolean"))).drop("found_")


def in_report_order(rows: DataFrame, keys: list[str], out: str = "place") -> DataFrame:
    """rows with their places from 0 in the order of keys (nulls first), however the work was dealt and whichever task ended first.

    Keys should tell rows apart; equal ones are in any order among themselves. Rows are dealt by ranges and
    numbered within; a range begins at the sum of those before it, so no task orders them all.
    """
    # written, as ranges found anew could be others
    dealt = saved(rows.repartitionByRange(*keys).withColumn("part_", F.spark_partition_id()), "report-order")
    within = F.row_number().over(Window.partitionBy("part_").orderBy(*keys))
    counts = dealt.groupBy("part_").agg(F.count("*").alias("n_"))  # a row for each range
    before = counts.select("part_", F.coalesce(F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_"))
    return dealt.withColumn("within_", within).join(before, "part_").withColumn(out, F.col("before_") + F.col("within_") - 1).drop("part_", "within_", "before_")


def run_graph(rows: DataFrame, route: Column, nodes: dict[str, Callable[[DataFrame], DataFrame]], end: str = "end", most: int = 100, out: str = "steps") -> DataFrame:
    """rows after a graph of named steps with conditional edges: `route` tells from a row's columns the node that it goes to next, or the
    end; a node is a function from its rows to the same columns. With the number of steps each row took.

    All rows that stand before a node go through it together, and each round is written, so its cost is that of
    the rows still under way. A route to no node (or to null) is an error, as are rows still under way after `most` rounds.
    """
    names = rows.columns
    told = F.when((route == end) | route.isin(*nodes), route).otherwise(F.raise_error(F.concat(F.lit("no node "), F.coalesce(route, F.lit("null")))).cast("string"))
    state, done = saved(rows.withColumns({out: F.lit(0), "next_": told}), "graph"), None
    for _ in range(most + 1):
        left = state.where(F.col("next_") == end).select(*names, out)
        done = left if done is None else done.unionByName(left)
        if state.where(F.col("next_") != end).isEmpty():
            return done
        moved = None
        for name, node in nodes.items():
            part = state.where(F.col("next_") == name)
            branch = node(part.drop("next_")).select(*names, (F.col(out) + 1).alias(out))
            moved = branch if moved is None else moved.unionByName(branch)
        state = saved(moved.withColumn("next_", told), "graph")
    raise RuntimeError(f"rows are under way after {most} rounds")


def with_run_ids(runs: DataFrame, key: list[str], out: str = "run_id", fresh: bool = False) -> DataFrame:
    """runs with an id in the form of a UUID: told from the key, so a run that is written again keeps it, or a fresh one at random each time it is asked for."""
    hashed = F.md5(F.to_json(F.struct(*key), {"ignoreNullFields": "false"}))
    part = lambda a, n: F.substring(hashed, a, n)
    named = F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-3"), part(14, 3), F.lit("-8"), part(18, 3), F.lit("-"), part(21, 12))
    return runs.withColumn(out, F.uuid() if fresh else named)


def single(rows: DataFrame, path: str, column: str = "path") -> DataFrame:
    """The rows of one path, or an error at run time if there are none."""
    found = rows.where(F.col(column) == path)
    n = found.agg(F.count("*").alias("n_")).select(F.when(F.col("n_") > 0, F.col("n_")).otherwise(F.raise_error(F.lit(f"{path} isn't there"))).alias("n_"))
    return found.join(F.broadcast(n)).where("n_ > 0").drop("n_")  # one row


def timeouts(attempts: Column, first: int = 60, step: int = 60, most: int = 600) -> Column:
    """The seconds that a call may take at its n-th try, from 1: longer each time, up to a most."""
    return F.least(F.lit(first) + (attempts - 1) * step, F.lit(most))


def class_states(rows: DataFrame, key: str, order: list[Column | str], failed: Column, done: Column, value: str) -> DataFrame:
    """rows with the state after each: class_index (classes done before), attempts (failures of this class
    so far) and last_good (the greatest value of a row of this class that didn't fail)."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = rows.withColumns({"failed_": failed, "done_": done})
    indexed = marked.withColumn("class_index", F.coalesce(F.sum(F.col("done_").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = Window.partitionBy(key, "class_index").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    state = {"attempts": F.sum(F.col("failed_").cast("int")).over(own), "last_good": F.max(F.when(~F.col("failed_"), F.col(value))).over(own)}
    return indexed.withColumns(state).drop("failed_", "done_")
