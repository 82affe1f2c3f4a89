"""Scores of generated suites as Column expressions. A null measure is "not measured", which isn't zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Statuses whose results say something about the model, best first.
USABLE = ("OK", "TEST_FAIL", "COMPILE_FAIL", "UNPARSEABLE")
#: Weights of the first formula (compiled, passing, coverage, mutation) and the second
#: (coverage, passing, mutation), and the ceiling of what doesn't compile under the second.
WEIGHTS_1 = (0.4, 0.2, 0.2, 0.2)
WEIGHTS_2 = (0.2, 0.4, 0.4)
SALVAGE_CEILING = 0.15


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def share(part: Column, whole: Column) -> Column:
    """part / whole, or 0 where whole is 0 or null."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def zero(x: Column) -> Column:
    return F.coalesce(x.cast("double"), F.lit(0.0))


def usable(status: Column | str = "status") -> Column:
    return F.coalesce(_c(status).isin(*USABLE), F.lit(False))


def green(compiled: Column, run: Column, failed: Column) -> Column:
    """It compiled, ran something and nothing failed."""
    return F.coalesce(compiled & (run > 0) & (failed == 0), F.lit(False))


def effective_coverage(branch: Column, line: Column, n_branches: Column) -> Column:
    """Branch coverage, or line coverage where there are no branches to cover."""
    has_branches = F.coalesce(n_branches != 0, F.lit(False))
    return F.when(has_branches, zero(branch)).otherwise(F.coalesce(line.cast("double"), branch.cast("double"), F.lit(0.0)))


def compiled_fraction(compiled: Column, clean: Column, broken: Column, skeleton_errors: Column, errors: Column, available: Column) -> Column:
    """The share of tests that compile. A failure that no test explains is a whole one."""
    unexplained = (errors == 0) & (broken == 0)
    return F.when(compiled, 1.0).when(~available | (skeleton_errors > 0) | unexplained, 0.0).otherwise(share(clean, clean + broken))


def covers_nothing(line: Column) -> Column:
    """The veto: lines were measured and none ran. Unmeasured lines are no evidence."""
    return F.coalesce(line <= 0, F.lit(False))


class Suite:
    """The measures of a score row by their names, a prefix for those of its salvaged part."""

    def __init__(self, prefix: str = ""):
        get = lambda n: F.col(f"{prefix}{n}")
        self.run, self.passed, self.failed = get("tests_run"), get("tests_passed"), get("tests_failed")
        self.branch, self.line = get("branch_coverage_pct"), get("line_coverage_pct")
        self.n_branches, self.mutation = get("n_branches"), get("mutation_score_pct")
        self.pass_rate = share(self.passed, self.run)
        self.coverage = effective_coverage(self.branch, self.line, self.n_branches)


def fraction() -> Column:
    return compiled_fraction(*[F.col(c) for c in ("compiled", "n_tests_clean", "n_tests_broken", "n_skeleton_errors", "n_compile_errors", "attribution_available")])


def quality(graded: bool = False) -> Column:
    """The first formula; null for a row that isn't usable.

    graded: a suite that doesn't compile scores by its clean tests and by what the salvaged rest does.
    """
    w_compiled, w_pass, w_cover, w_mutation = WEIGHTS_1
    own, rest = Suite(), Suite("salvaged_")
    own_green = green(F.col("compiled"), own.run, own.failed)
    rest_green = green(F.col("salvaged"), rest.run, rest.failed)
    whole = w_compiled + w_pass * own.pass_rate + w_cover * zero(own.branch) / 100 + F.when(own_green, w_mutation * zero(own.mutation) / 100).otherwise(0.0)
    part = w_compiled * fraction() + w_pass * rest.pass_rate + w_cover * zero(rest.branch) / 100 + F.when(rest_green, w_mutation * zero(rest.mutation) / 100).otherwise(0.0)
    return F.when(usable(), F.when(F.col("compiled"), whole).otherwise(part if graded else F.lit(0.0)))


def quality_2() -> Column:
    """The second formula: nothing for compiling alone, nothing for a suite that runs no line, and
    mutation on the green part discounted by the passing share; null for a row that isn't usable."""
    w_cover, w_pass, w_mutation = WEIGHTS_2
    own, rest = Suite(), Suite("salvaged_")
    p = own.pass_rate
    mutation = F.when(green(F.col("compiled"), own.run, own.failed), own.mutation).otherwise(F.col("green_subset_mutation_score_pct"))
    whole = F.when(covers_nothing(own.line), 0.0).otherwise(w_cover * own.coverage / 100 + w_pass * p + w_mutation * p * zero(mutation) / 100)
    lost = (F.col("n_skeleton_errors") > 0) | ~F.col("salvaged") | covers_nothing(rest.line)
    part = F.when(lost, 0.0).otherwise(SALVAGE_CEILING * (w_cover * rest.coverage / 100 + w_pass * rest.pass_rate) * fraction())
    return F.when(usable(), F.round(F.when(F.col("compiled"), whole).otherwise(part), 6))


def kills_a_mutant() -> Column:
    """Any of the three mutation scores is above zero."""
    return F.greatest(*[zero(F.col(c)) for c in ("mutation_score_pct", "green_subset_mutation_score_pct", "salvaged_mutation_score_pct")]) > 0


def kept_fraction(n: Column, broken: Column) -> Column:
    return F.round(share(n - broken, n), 3)


def selection_why(has_rest: Column, kept: Column, least: float, vetoed: Column, skeleton_errors: Column) -> Column:
    """Why a candidate was taken or not, the first reason that holds."""
    few = F.concat(F.lit("kept only "), F.bround(kept * 100).cast("int").cast("string"), F.lit("% of its tests"))
    return F.when(has_rest & (kept < least), few).when(has_rest, "VERIFIED").when(vetoed, "compiles but covers 0% of the class").when(skeleton_errors > 0, "skeleton fault").otherwise("nothing salvageable")


def next_step(compiled: Column, suite_green: Column, repairs: Column, mutation: Column, rounds: Column, improved: Column, max_repairs: int, max_rounds: int) -> Column:
    """The step that follows a measured suite, the first rule that holds; nulls count as no and 0."""
    no, nought = F.lit(False), F.lit(0)
    red = ~F.coalesce(compiled, no) | ~F.coalesce(suite_green, no)
    n = F.coalesce(rounds, nought)
    pays = (n == 0) | F.coalesce(improved, no)
    return (
        F.when(red & (F.coalesce(repairs, nought) >= max_repairs), "faulty_test_cleanup_node").when(red, "test_repair_node")
        .when((F.coalesce(mutation, F.lit(0.0)) >= 100) | (n >= max_rounds), "class_advancer_node").when(pays, "mutation_test_writer_node").otherwise("class_advancer_node")
    )


def after_class(index: Column, n_classes: Column) -> Column:
    """The step that follows a finished class: the next one's first, or the end of the run after the last."""
    return F.when(F.coalesce(index, F.lit(0)) >= F.coalesce(n_classes, F.lit(0)), "end").otherwise("initial_test_write_node")


def result_line(*columns: str) -> Column:
    """name=value for each column, a null as --."""
    return F.concat_ws(" ", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("--"))) for c in columns])


def number_or_null(x: Column) -> Column:
    """A number out of a text; null for what isn't one, such as None."""
    return F.try_to_number(F.when(x.rlike(r"^-?[0-9]{1,15}(\.[0-9]{1,6})?$"), x), F.lit("S999999999999999.999999")).cast("double")


def record(rows: DataFrame, most: int = 8000) -> DataFrame:
    """Score rows as they are written: a cut compiler output, and the derived flags, shares and scores beside their columns."""
    derived = {
        "compiler_output": F.substring("compiler_output", 1, most), "usable_for_training": usable(), "is_green": green(F.col("compiled"), F.col("tests_run"), F.col("tests_failed")), "compiled_fraction": F.round(fraction(), 6),
        "quality_binary": F.round(quality(graded=False), 6), "quality_graded": F.round(quality(graded=True), 6), "quality_v2": quality_2(),
    }
    return rows.withColumns(derived)


def flag() -> Column:
    """What is shown of a score: GREEN, compiled, or its status."""
    return F.when(green(F.col("compiled"), F.col("tests_run"), F.col("tests_failed")), "GREEN").when(F.col("compiled"), "compiled").otherwise(F.col("status"))
