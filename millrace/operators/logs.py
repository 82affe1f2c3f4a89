"""Figures from logs of model calls and runs, and the small lookups around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text
from ..sources import tables
from . import stats

#: Fixed value: characters a token where no call says otherwise.
CHARS_A_TOKEN = 4.27


def running_totals(rows: DataFrame, key: list[str], order: list[Column | str], *columns: str) -> DataFrame:
    """rows with {column}_total, each column's sum up to and with the row."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({f"{c}_total": F.sum(c).over(w) for c in columns})


def chars_a_token(calls: DataFrame, run: str = "run_id", seq: str = "seq") -> DataFrame:
    """By run the characters a token of its first call that tells both."""
    known = (F.col("prompt_chars") > 0) & (F.col("input_tokens") > 0)
    first = F.min_by(F.col("prompt_chars") / F.col("input_tokens"), F.when(known, F.col(seq)))
    return calls.groupBy(run).agg(F.coalesce(first, F.lit(CHARS_A_TOKEN)).alias("chars_a_token"))


def call_figures(calls: DataFrame, by: list[str]) -> DataFrame:
    """Calls, tokens in and out, the share of thinking in what was written, tokens a second, retries and
    empty answers. Shares of nothing are 0; durations are nanoseconds."""
    out, think, answer = F.sum("output_tokens"), F.sum("thinking_chars"), F.sum("answer_chars")
    at_least_one = lambda x: F.greatest(x, F.lit(1))
    return calls.groupBy(*by).agg(
        F.count("*").alias("n_calls"), F.sum("input_tokens").alias("tokens_in"), out.alias("tokens_out"),
        F.round(think / at_least_one(think + answer), 6).alias("thinking_share"), F.round(out / at_least_one(F.sum("eval_duration") / 1e9), 6).alias("tokens_a_second"),
        F.count_if(F.col("node_name").endswith(":no_thinking_retry")).alias("n_retries"), F.count_if((F.col("answer_chars") == 0) & (F.col("n_tool_calls") == 0)).alias("n_empty"),
    )


def flat_calls(calls: DataFrame) -> DataFrame:
    """The figures of nested call rows as columns, nulls as 0."""
    data = "response.data"
    n = lambda c: F.coalesce(F.col(f"{data}.{c}"), F.lit(0))
    chars = lambda c: F.coalesce(F.length(c), F.lit(0))
    return calls.select(
        "run_id", "time_stamp", "node_name", chars(text.content_text(F.col("prompt"))).alias("prompt_chars"), n("usage_metadata.input_tokens").alias("input_tokens"), n("usage_metadata.output_tokens").alias("output_tokens"),
        n("response_metadata.eval_duration").alias("eval_duration"), chars(text.content_text(F.col(f"{data}.content"))).alias("answer_chars"), chars(F.col(f"{data}.additional_kwargs.reasoning_content")).alias("thinking_chars"),
        F.greatest(F.coalesce(F.size(F.col(f"{data}.tool_calls")), F.lit(0)), F.lit(0)).alias("n_tool_calls"),
    )


def class_listing(files: DataFrame) -> DataFrame:
    """Concrete implementation classes with their index in path order. Paths, not contents, are ordered, and no task orders them all."""
    rows = files.where(text.is_implementation(F.col("path")) & text.is_concrete(F.col("path"), F.col("content"))).select("path", text.class_key(F.col("path")).alias("class_key"))
    return tables.with_places(rows, "path", "idx")


def resolve_class(listing: DataFrame, wanted: str) -> DataFrame:
    """The one listed class of a name; none, or more than one, is an error at run time."""
    needle = wanted.replace("\\", "/").replace(".", "/").removesuffix("/java")
    hits = listing.where((F.col("class_key") == needle) | F.col("class_key").endswith(f"/{needle}"))
    one = hits.groupBy().agg(F.count("*").alias("n"), F.min("class_key").alias("class_key"))
    return one.select(F.when(F.col("n") == 1, F.col("class_key")).otherwise(F.raise_error(F.concat(F.col("n").cast("string"), F.lit(f" classes match {wanted}")))).alias("class_key"))


def nearby(files: DataFrame, targets: DataFrame, most: int = 2) -> DataFrame:
    """For each target (root, path) up to `most` other test files below its root, those of its own folder first."""
    # all that a target can show are the first files of its folder, itself perhaps among them, and the first of the root's
    # other folders; of these each folder gives `most` at most, so of twice as many some `most` are of other folders
    folder = lambda c: F.regexp_extract(c, r"^(.*)[/\\][^/\\]*$", 1)
    first = lambda rows, n, *key: rows.withColumn("n_", F.row_number().over(Window.partitionBy(*key).orderBy("path"))).where(F.col("n_") <= n).drop("n_")
    t = targets.select("root", F.col("path").alias("target")).where("root IS NOT NULL AND target IS NOT NULL").distinct().withColumn("folder", folder(F.col("target")))
    own = first(files.select("root", "path").where("root IS NOT NULL AND path IS NOT NULL").distinct().withColumn("folder", folder(F.col("path"))), most + 1, "root", "folder")
    other = first(first(own, most, "root", "folder"), 2 * most, "root").withColumnRenamed("folder", "its_folder")
    near = t.join(own, ["root", "folder"]).where("path <> target").select("root", "target", "path", F.lit(0).alias("far"))
    far = t.join(other, "root").where("its_folder <> folder").select("root", "target", "path", F.lit(1).alias("far"))
    rows = near.union(far).withColumn("place", F.row_number().over(Window.partitionBy("root", "target").orderBy("far", "path")))
    return rows.where(F.col("place") <= most).drop("far")


def line_starts(files: DataFrame) -> DataFrame:
    """(path, line, start, stop): the UTF-8 bytes of each line, its line break included."""
    lines = files.select("path", F.posexplode(F.split("content", "\n", -1)).alias("i", "s"))
    sums = Window.partitionBy("path").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.octet_length("s") + 1).over(sums), F.lit(0))
    return lines.select("path", (F.col("i") + 1).alias("line"), start.alias("start"), (start + F.octet_length("s") + 1).alias("stop"))


def lines_of_bytes(points: DataFrame, starts: DataFrame) -> DataFrame:
    """points (path, byte) with the line that holds each."""
    held = points.join(starts, "path").where((F.col("start") <= F.col("byte")) & (F.col("byte") < F.col("stop")))
    return held.select("path", "byte", "line")


def failing_lines(outputs: DataFrame, own: str = "file_name") -> DataFrame:
    """outputs (…, output, file_name) with `lines`: the sorted lines of a file's compiler errors, or null
    if any error names another file. A column `errors` (text.javac_errors()) is taken as it is; else they are told here."""
    rows = outputs if "errors" in outputs.columns else outputs.withColumn("errors", text.javac_errors(F.col("output")))
    foreign = F.exists("errors", lambda e: ~e["file"].endswith(F.col(own)))
    rows = rows.withColumn("lines", F.when(~foreign, F.array_sort(F.array_distinct(F.transform("errors", lambda e: e["row"])))))
    return rows if "errors" in outputs.columns else rows.drop("errors")


def trim_plan(by_name: DataFrame, by_line: DataFrame, compiled: DataFrame, key: str = "suite") -> DataFrame:
    """The ranges to drop from a red suite: by the names of failing tests where it compiled, by the lines
    of errors where it didn't; null where they can't be told."""
    rows = compiled.join(by_name.select(key, F.col("ranges").alias("n")), key, "left").join(by_line.select(key, F.col("ranges").alias("l")), key, "left")
    return rows.select(key, F.when(F.col("compiled"), F.col("n")).otherwise(F.col("l")).alias("ranges"))


def round_summary(prompts: DataFrame, targets: DataFrame) -> DataFrame:
    """One row: prompts, those that serve themselves, those that fall through and their share, targets by
    kind and the median of their tests."""
    served = targets.where("kind = 'self'").select("class_key").distinct().withColumn("served", F.lit(1))
    p = prompts.select("class_key").distinct().join(served, "class_key", "left").agg(F.count("*").alias("classes"), F.count("served").alias("self_served"))
    t = targets.agg(F.count("*").alias("targets"), F.count_if(F.col("kind") == "harness").alias("rescued")).join(stats.medians(targets, {"m": F.col("n_tests")}).agg(F.max("m").alias("median_target_tests")))
    both = p.join(t)  # one row each
    fall = F.col("classes") - F.col("self_served")
    return both.withColumn("fall_through", fall).withColumn("harness_usage_pct", F.round(F.try_divide(100.0 * fall, F.col("classes")), 6))


def prompt_summary(prompts: DataFrame) -> DataFrame:
    """One row: prompts, excluded ones, the median of tokens of the kept."""
    kept = ~F.coalesce(F.col("excluded"), F.lit(False))
    middle = stats.medians(prompts, {"m": F.when(kept, F.col("prompt_tokens"))}).agg(F.max("m").alias("median_tokens"))
    return prompts.agg(F.count("*").alias("rows"), F.count_if(~kept).alias("excluded")).join(middle)  # one row each


#: A class's metrics at its start.
START_VALUES = {
    "test_class": "", "compiler_success": False, "compiler_feedback": "", "test_file_path": "", "last_compilable_test_class": "", "last_compilable_test_file_path": "",
    "coverage_previous": 0.0, "coverage_current": 0.0, "coverage_delta": 0.0, "coverage_improved_significantly": False, "coverage_feedback": "",
    "mutation_previous": 0.0, "mutation_current": 0.0, "mutation_delta": 0.0, "mutation_improved_significantly": False, "mutation_feedback": "",
    "active_validation_phase": "coverage", "repair_attempts": 0, "coverage_iterations": 0, "mutation_iterations": 0,
}


def with_start_values(rows: DataFrame) -> DataFrame:
    """rows with all metrics: null ones, and those that aren't there, as at a class's start."""
    return rows.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in rows.columns else F.lit(v) for c, v in START_VALUES.items()})


def epoch_millis(at: Column) -> Column:
    return F.unix_millis(at.cast("timestamp"))


def elapsed_minutes(start: Column, end: Column) -> Column:
    return F.round((F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 6e7, 1)


def first_prompts(calls: DataFrame, key: str, seq: str, node: str = "initial_test_write_node") -> DataFrame:
    """By class the first initial prompt: (key, prompt). Calls of other nodes, and their retries, don't count."""
    own = calls.where(F.col("node_name") == node)
    return own.groupBy(key).agg(F.min_by("prompt", seq).alias("prompt"))


def run_report(results: DataFrame, summaries: DataFrame, calls: DataFrame, run: str = "run_id") -> DataFrame:
    """results (run, arm, class, status, minutes) with what each run's log and calls tell; runs without either keep nulls."""
    return results.withColumn("ok", F.col("status") == "finished").join(summaries, run, "left").join(calls, run, "left")
