"""Coverage, mutation and test figures from report rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Mutants that say nothing about a suite, and those that can be acted upon.
NO_MUTANTS = ("NON_VIABLE", "MEMORY_ERROR", "RUN_ERROR")
ACTIONABLE = ("SURVIVED", "NO_COVERAGE", "TIMED_OUT")


def _ratio(kind: str, empty: float) -> Column:
    """100 * covered / (covered + missed) of one type of counter, pooled; `empty` where there is none."""
    of = lambda c: F.coalesce(F.sum(F.when(F.col("type") == kind, F.col(c))), F.lit(0))
    return F.coalesce(F.try_divide(100.0 * of("covered"), of("covered") + of("missed")), F.lit(empty))


def pooled_branch(counters: DataFrame, by: list[str]) -> DataFrame:
    """Branch coverage over whole reports (rows without a class); no branches count as covered."""
    return counters.where(F.col("class").isNull()).groupBy(*by).agg(_ratio("BRANCH", 100.0).alias("branch_pct"))


def class_coverage(counters: DataFrame, by: list[str], no_lines: float = 100.0) -> DataFrame:
    """branch_pct, line_pct, n_branches, n_lines by class. Without branches 100; without lines `no_lines`,
    100 for the verifier's figure and 0 for the harness's."""
    n = lambda kind: F.coalesce(F.sum(F.when(F.col("type") == kind, F.col("missed") + F.col("covered"))), F.lit(0))
    rows = counters.where(F.col("class").isNotNull())
    return rows.groupBy(*by, "class").agg(_ratio("BRANCH", 100.0).alias("branch_pct"), _ratio("LINE", no_lines).alias("line_pct"), n("BRANCH").alias("n_branches"), n("LINE").alias("n_lines"))


def mutation_score(mutations: DataFrame, by: list[str]) -> DataFrame:
    """Killed of all mutants that count, in percent; 0 without any."""
    counts = ~F.col("status").isin(*NO_MUTANTS)
    return mutations.groupBy(*by).agg(F.coalesce(F.try_divide(100.0 * F.count_if(F.col("status") == "KILLED"), F.count_if(counts)), F.lit(0.0)).alias("mutation_pct"), F.count_if(counts).alias("n_mutants"))


def test_counts(suites: DataFrame, by: list[str], harness: bool = False) -> DataFrame:
    """(run, passed, failed). The verifier doesn't count skipped tests as run; the harness does, and
    takes them from the passed ones."""
    t, f, s = F.sum("tests"), F.sum(F.col("failures") + F.col("errors")), F.sum("skipped")
    run = t if harness else t - s
    passed = run - f - s if harness else F.greatest(run - f, F.lit(0))
    return suites.groupBy(*by).agg(run.alias("run"), passed.alias("passed"), f.alias("failed"))


def _first(rows: DataFrame, by: list[str], order: list[str], value: str, most: int, out: str) -> DataFrame:
    """By key the first `most` values in order and how many there are; only those are ever collected."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    first = rows.withColumn("place", place).where(F.col("place") <= most).groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", value))), lambda x: x[value]).alias(out))
    return first.join(rows.groupBy(*by).agg(F.count("*").alias("n")), by)


def mutant_line() -> Column:
    """A mutant as a line of text; what it doesn't tell is <unknown> or ?."""
    return F.concat_ws(" ", F.col("status"), F.coalesce("mutated_method", F.lit("<unknown>")), F.coalesce(F.col("line_number").cast("string"), F.lit("?")), F.coalesce("description", F.lit("")))


def actionable(mutations: DataFrame, by: list[str], most: int = 20) -> DataFrame:
    """By class the mutants to act upon: the first `most` as lines, and how many more there are."""
    rows = mutations.where(F.col("status").isin(*ACTIONABLE)).withColumn("line", mutant_line())
    return _first(rows, by, ["line_number", "line"], "line", most, "lines").select(*by, "lines", F.greatest(F.col("n") - most, F.lit(0)).alias("n_omitted"))


def status_counts(mutations: DataFrame, by: list[str]) -> DataFrame:
    return mutations.groupBy(*by, "status").count()


def uncovered(lines: DataFrame, by: list[str], most: int = 40) -> DataFrame:
    """Lines never run, and lines run with branches missed, `most` of each; only sources that have some."""
    kind = F.when(F.col("ci") == 0, "never_run").when((F.col("mb") > 0) & (F.col("cb") > 0), "partial")
    rows = lines.withColumn("kind", kind).where("kind IS NOT NULL")
    first = _first(rows, [*by, "kind"], ["nr"], "nr", most, "lines")
    pick = lambda k: F.coalesce(F.max(F.when(F.col("kind") == k, F.col("lines"))), F.expr("cast(array() as array<int>)")).alias(k)
    return first.groupBy(*by).agg(pick("never_run"), pick("partial"))


def source_lines(lines: DataFrame, by: list[str], most: int = 30) -> DataFrame:
    """By source the first `most` lines that miss something, as a text `nr: missed/all`, and how many more there are."""
    rows = lines.where((F.col("mi") > 0) | (F.col("mb") > 0)).withColumn("line", F.concat(F.col("nr").cast("string"), F.lit(": "), F.col("mi").cast("string"), F.lit("/"), (F.col("mi") + F.col("ci")).cast("string")))
    return _first(rows, by, ["nr"], "line", most, "lines").select(*by, F.array_join("lines", ", ").alias("lines"), F.greatest(F.col("n") - most, F.lit(0)).alias("n_omitted"))


def summary(counters: DataFrame, methods: DataFrame, by: list[str], most: int = 30) -> DataFrame:
    """A text for each class: its counters, then the methods that miss something."""
    one = F.concat(F.lower("type"), F.lit(" "), F.col("covered").cast("string"), F.lit("/"), (F.col("covered") + F.col("missed")).cast("string"))
    head = counters.where(F.col("class").isNotNull()).groupBy(*by, "class").agg(F.array_join(F.array_sort(F.collect_list(one)), ", ").alias("counters"))
    missed = methods.where((F.col("type") == "LINE") & (F.col("missed") > 0)).groupBy(*by, "class").agg(F.array_sort(F.collect_list(F.struct("line", F.concat("method", F.lit(" misses "), F.col("missed").cast("string")).alias("m")))).alias("ms"))
    rows = head.join(missed, [*by, "class"], "left")
    return rows.select(*by, "class", F.concat_ws("\n", F.col("counters"), F.array_join(F.transform(F.slice("ms", 1, most), lambda x: x["m"]), "\n")).alias("summary"))
