"""Audits: what was retrieved against what was used, differences of sets, paired experiments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text
from . import stats


def successive(rows: DataFrame, key: str, seq: str, value: str) -> DataFrame:
    """Each row's value with that of the next place of its key (seq + 1), as before and after."""
    after = rows.select(F.col(key).alias("k_"), (F.col(seq) - 1).alias("s_"), F.col(value).alias("after"))
    return rows.select(key, seq, F.col(value).alias("before")).join(after, (F.col(key) == F.col("k_")) & (F.col(seq) == F.col("s_"))).drop("k_", "s_")


def set_difference(pairs: DataFrame, before: str, after: str) -> DataFrame:
    """pairs with added, removed and kept elements and their counts."""
    sets = {"added": F.array_except(after, before), "removed": F.array_except(before, after), "kept": F.array_intersect(before, after)}
    return pairs.withColumns(sets).withColumns({f"n_{k}": F.size(k) for k in sets})


def paired(rows: DataFrame, key: str, arm: str, arms: list[str], value: Column) -> DataFrame:
    """By key one column for each arm; keys that lack an arm have a null there."""
    return rows.where(F.col(arm).isin(*arms)).groupBy(key).pivot(arm, arms).agg(value)


def agreement(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """By key whether two tables' sets of values are equal, and what either has alone."""
    sets = lambda d, n: d.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias(n))
    none = F.expr("cast(array() as array<string>)")
    both = sets(a, "a").join(sets(b, "b"), key, "full_outer").withColumns({c: F.coalesce(F.col(c).cast("array<string>"), none) for c in "ab"})
    return both.select(key, (F.col("a") == F.col("b")).alias("equal"), F.array_except("a", "b").alias("only_a"), F.array_except("b", "a").alias("only_b"))


#: What a retrieved file is to a class, in the order of the tests.
RETRIEVAL_CLASSES = (
    "unref: the class under test itself", "needed", "internal", "unref: not named by the CUT (implementer, producer, 2nd hop)",
    "unref: same name, different type", "unref: comment or string only", "unref: substring of a longer name",
)


def retrieval_class(is_self: Column, needed: Column, internal: Column, simple: Column, code: Column, names: Column) -> Column:
    """What a retrieved file is to the class it was retrieved for, the first of RETRIEVAL_CLASSES that holds.

    simple: the file's simple name; code: the class's source; names: the array of names in its code,
    without comments and literals.
    """
    word = F.regexp_like(code, F.concat(F.lit(r"\b\Q"), simple, F.lit(r"\E\b")))
    tests = (is_self, needed, internal, ~code.contains(simple), F.array_contains(names, simple), word)
    out = F.lit(RETRIEVAL_CLASSES[-1])
    for test, name in reversed(list(zip(tests, RETRIEVAL_CLASSES))):
        out = F.when(test, name).otherwise(out)
    return out


def hit_rates(files: DataFrame, reason: str = "reason") -> DataFrame:
    """By reason of retrieval: files, needed ones, characters and those of needed files."""
    needed = F.col("class") == "needed"
    return files.groupBy(reason).agg(F.count("*").alias("n"), F.count_if(needed).alias("n_needed"), F.sum("chars").alias("chars"), F.coalesce(F.sum(F.when(needed, F.col("chars"))), F.lit(0)).alias("useful_chars"))


def most_common(rows: DataFrame, value: str, seq: str, n: int) -> DataFrame:
    """The n most frequent values with their counts; of equals the one seen first."""
    return rows.groupBy(value).agg(F.count("*").alias("count"), F.min(seq).alias("first_seq")).orderBy(F.desc("count"), "first_seq").limit(n)


def noisiest(files: DataFrame, n: int = 8) -> DataFrame:
    """The n classes with most characters of unreferenced files: (cut, chars, n_files)."""
    unref = F.col("class").startswith("unref")
    sums = files.groupBy("cut").agg(F.coalesce(F.sum(F.when(unref, F.col("chars"))), F.lit(0)).alias("chars"), F.count_if(unref).alias("n_files"))
    return sums.orderBy(F.desc("chars"), "cut").limit(n)


def retrieval_summary(files: DataFrame, cuts: DataFrame) -> DataFrame:
    """One row of fourteen figures over an audit.

    files (cut, class, chars), cuts (cut, cut_chars, has_suites, n_api, n_missing_api, n_used,
    n_missing_used, n_gaps). Recalls are percents of what was needed; the middle and the ninth tenth of
    characters per class are taken by index, over one row for each class.
    """
    f, c = F.col, lambda x: F.coalesce(F.sum(x), F.lit(0))
    pct = lambda a, b: F.round(F.try_divide(100.0 * a, b), 1)
    n, chars = F.count("*"), c("chars")
    unref = f("class").startswith("unref")
    one = files.agg(n.alias("files"), pct(F.count_if(f("class") == "needed"), n).alias("needed_pct"), pct(F.count_if(f("class") == "internal"), n).alias("internal_pct"), pct(F.count_if(unref), n).alias("unreferenced_pct"), chars.alias("chars"), pct(c(F.when(unref, f("chars"))), chars).alias("unreferenced_chars_pct"))
    suites = f("has_suites")
    two = cuts.agg(
        pct(c(f("n_api") - f("n_missing_api")), c("n_api")).alias("api_recall_pct"), pct(c(F.when(suites, f("n_used") - f("n_missing_used"))), c(F.when(suites, f("n_used")))).alias("used_recall_pct"),
        F.count_if((f("n_missing_api") > 0) | (f("n_missing_used") > 0)).alias("classes_with_a_miss"), c("n_gaps").alias("called_members_cut"), c(f("n_used") - f("n_missing_used")).alias("used_pairs"), c("cut_chars").alias("cut_chars"),
    )
    each = cuts.select("cut").join(files.groupBy("cut").agg(F.sum("chars").alias("per_class")), "cut", "left").select(F.coalesce("per_class", F.lit(0)).alias("per_class"))
    three = stats.at_share(each, "per_class", None, out="median_chars").join(stats.at_share(each, "per_class", 0.9, out="p90_chars")).join(each.agg(F.max("per_class").alias("max_chars")))  # one row each
    return one.join(two).join(three).withColumn("context_ratio", F.round(F.try_divide(f("chars"), f("cut_chars")), 2))


def engagement(errors: DataFrame, used: DataFrame, prompt: DataFrame, key: list[str], own: str = "cut", by: tuple[str, ...] = ()) -> DataFrame:
    """Types that errors or uses are about, by class (and by columns of the key): in the prompt, not in it, or the class itself, with counts."""
    # one aggregate over all three: no join, and rows told twice count once
    flagged = lambda rows, e, u, p: rows.select(*key, "type", F.lit(e).alias("error"), F.lit(u).alias("used"), F.lit(p).alias("shown"))
    each = flagged(errors, 1, 0, False).union(flagged(used, 0, 1, False)).union(flagged(prompt, 0, 0, True)).groupBy(*key, "type").agg(F.max("error").alias("error"), F.max("used").alias("used"), F.max("shown").alias("shown"))
    rows = each.where("error + used > 0")
    place = F.when(F.col("type") == F.col(own), "class under test").when(F.col("shown"), "in prompt").otherwise("NOT in prompt")
    never = F.when((F.col("error") == 1) & (F.col("used") == 0), 1)
    return rows.groupBy(*by, place.alias("place")).agg(F.count("*").alias("n"), F.sum("error").alias("n_error"), F.sum("used").alias("n_used"), F.count(never).alias("n_never_fixed"), F.round(F.avg("error"), 6).alias("error_rate"))


def pattern_stats(candidates: DataFrame, cuts: DataFrame, patterns: list[str]) -> DataFrame:
    """By pattern: candidates, needed ones, characters, and the median of characters per class, classes
    without any counting as 0 (the grid has a row for each class and pattern)."""
    each = candidates.groupBy("cut", "pattern").agg(F.count("*").alias("n"), F.count_if("needed").alias("n_needed"), F.sum("chars").alias("chars"))
    grid = cuts.select("cut", F.explode(F.array(*map(F.lit, patterns))).alias("pattern"))
    rows = grid.join(each, ["cut", "pattern"], "left").fillna(0)
    sums = rows.groupBy("pattern").agg(F.sum("n").alias("n"), F.sum("n_needed").alias("n_needed"), F.sum("chars").alias("chars"))
    return sums.join(stats.medians(rows, {"median_chars": F.col("chars")}, ["pattern"]), "pattern")


def exclusive(candidates: DataFrame) -> DataFrame:
    """By pattern the needed candidates that no other pattern reached."""
    return candidates.where(F.col("needed") & (F.size("patterns") == 1)).groupBy(F.col("patterns")[0].alias("pattern")).count()


def suite_difference(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Tests (…key, name, body, pos) of two suites: added, removed, modified or unchanged, and whether an
    added one stands before the last that was kept."""
    b = before.select(*key, "name", F.col("body").alias("old"))
    a = after.select(*key, "name", F.col("body").alias("new"), "pos")
    rows = b.join(a, [*key, "name"], "full_outer")
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "unchanged").otherwise("modified")
    rows = rows.withColumn("kind", kind)
    last = rows.groupBy(*key).agg(F.max(F.when(F.col("kind").isin("unchanged", "modified"), F.col("pos"))).alias("last_kept"))
    return rows.join(last, key).select(*key, "name", "kind", ((F.col("kind") == "added") & F.coalesce(F.col("pos") < F.col("last_kept"), F.lit(False))).alias("interleaved"))


def difference_totals(differences: DataFrame, key: list[str]) -> DataFrame:
    """One row over suite_difference(): suites, those that were only added to, tests of each kind, and suites with an interleaved test."""
    each = differences.groupBy(*key).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("added", "removed", "modified", "unchanged")], F.bool_or("interleaved").alias("mixed"))
    only = (F.col("added") > 0) & (F.col("removed") == 0) & (F.col("modified") == 0)
    return each.agg(F.count("*").alias("n_suites"), F.count_if(only).alias("only_added"), F.count_if("mixed").alias("n_interleaved"), *[F.sum(k).alias(k) for k in ("added", "removed", "modified", "unchanged")])


def complete_pairs(rows: DataFrame, key: str, arm: str, arms: list[str]) -> DataFrame:
    """The rows of keys that have every arm; the other keys' rows are left out."""
    whole = rows.where(F.col(arm).isin(*arms)).groupBy(key).agg(F.count_distinct(arm).alias("n")).where(F.col("n") == len(arms)).select(key)
    return rows.where(F.col(arm).isin(*arms)).join(whole, key, "left_semi")


def recipes(members: DataFrame, most: int = 3) -> DataFrame:
    """(class, recipes): how to build each type. members (class, kind, name, params, accessible, seq).

    Of accessible constructors, then of factories (kind method), the `most` with fewest parameters,
    those of equally many in their order.
    """
    simple = F.regexp_extract("class", r"([^.]*)$", 1)
    call = F.when(F.col("kind") == "ctor", F.concat(F.lit("new "), text.call_of(simple, F.col("params")))).otherwise(F.concat(simple, F.lit("."), text.call_of(F.col("name"), F.col("params"))))
    order = Window.partitionBy("class", "kind").orderBy(F.size("params"), "seq")
    first = members.where("accessible").withColumn("call", call).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    return first.groupBy("class").agg(F.transform(F.array_sort(F.collect_list(F.struct("kind", "place", "call"))), lambda x: x["call"]).alias("recipes"))


def rendered(members: DataFrame, classes: DataFrame, most: int = 40) -> DataFrame:
    """(class, view): a type as a text, its head and the kept members' declarations in their order, `most` of them at most.

    members (class, decl, seq, kept), classes (class, package, kind). What is left out is told as a
    number; a type without kept members has an empty body.
    """
    kept = members.where("kept").withColumn("place", F.row_number().over(Window.partitionBy("class").orderBy("seq", "decl")))
    first = kept.where(F.col("place") <= most).groupBy("class").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "decl"))), lambda x: F.concat(F.lit("    "), x["decl"], F.lit(";\n"))), "").alias("body"))
    rest = members.groupBy("class").agg((F.count("*") - F.least(F.count_if("kept"), F.lit(most))).alias("n_left"))
    rows = classes.join(first, "class", "left").join(rest, "class", "left")
    note = F.when(F.coalesce("n_left", F.lit(0)) > 0, F.concat(F.lit("    // "), F.col("n_left").cast("string"), F.lit(" more\n"))).otherwise("")
    simple = F.regexp_extract("class", r"([^.]*)$", 1)
    kind = F.when(F.col("kind") == "abstract", "abstract class").otherwise(F.col("kind"))
    return rows.select("class", F.concat(F.lit("package "), "package", F.lit(";\n"), kind, F.lit(" "), simple, F.lit(" {\n"), F.coalesce("body", F.lit("")), note, F.lit("}\n")).alias("view"))
