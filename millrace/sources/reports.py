"""XML reports of coverage, mutation and test runs, parsed with Spark's XML functions.

Reports come as (path, content). One that isn't well-formed gives no rows, or with strict=True an
error at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .tables import newest

COUNTER = "counter array<struct<_type:string,_missed:long,_covered:long>>"
COVERAGE = (
    f"struct<{COUNTER.replace(' ', ':', 1)},package:array<struct<_name:string,class:array<struct<_name:string,_sourcefilename:string,{COUNTER.replace(' ', ':', 1)},method:array<struct<_name:string,_line:int,{COUNTER.replace(' ', ':', 1)}>>>>,"
    "sourcefile:array<struct<_name:string,line:array<struct<_nr:int,_mi:int,_ci:int,_mb:int,_cb:int>>>>>>>"
)
MUTATIONS = "struct<mutation:array<struct<_status:string,mutatedClass:string,mutatedMethod:string,lineNumber:int,mutator:string,description:string>>>"
SUITE = "struct<_name:string,_tests:int,_failures:int,_errors:int,_skipped:int,testcase:array<struct<_name:string,_classname:string,failure:array<struct<_message:string>>,error:array<struct<_message:string>>>>>"


#: Where the builds' tools leave their reports, below a module.
PLACES = {COVERAGE: "target/site/jacoco/jacoco.xml", MUTATIONS: "mutations.xml", SUITE: "TEST-*.xml"}


def discovered(spark: SparkSession, root: str, schema: str, newest_only: bool = False) -> DataFrame:
    """(path, content, modificationTime) of the reports of one kind below root, in no order.

    newest_only: those of the latest modification time alone, as mutation reports of earlier runs stay beside them.
    """
    place = PLACES[schema]
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", place.rsplit("/", 1)[-1]).load(root)
    rows = raw.where(F.col("path").endswith(f"/{place}")) if "/" in place else raw
    return (newest(rows) if newest_only else rows).select("path", F.decode("content", "UTF-8").alias("content"), "modificationTime")


def _body(content: Column) -> Column:
    """Without the document type, which names a file that isn't there, and with empty elements that
    have children's type kept as they are."""
    return F.regexp_replace(content, r"(?s)<!DOCTYPE[^>]*>", "")


def parsed(reports: DataFrame, schema: str, strict: bool = False) -> DataFrame:
    """reports with `x`, the parsed root; of those that don't parse no row, or an error."""
    name = {COVERAGE: "report", MUTATIONS: "mutations", SUITE: "testsuite"}[schema]
    well_formed = F.col("content").rlike(rf"(?s)<{name}\b.*(?:</{name}>|/>)\s*\z")
    x = F.when(well_formed, F.from_xml(_body(F.col("content")), schema, {"mode": "PERMISSIVE"}))
    rows = reports.withColumn("x", x)
    if strict:
        return rows.withColumn("x", F.when(F.col("x").isNotNull(), F.col("x")).otherwise(F.raise_error(F.concat(F.lit("not a report: "), F.col("path")))))
    return rows.where(F.col("x").isNotNull())


def counters(reports: DataFrame, strict: bool = False) -> DataFrame:
    """(path, class, type, missed, covered) of classes; class is null for the report's own sums."""
    rows = parsed(reports, COVERAGE, strict)
    own = rows.select("path", F.lit(None).cast("string").alias("class"), F.explode("x.counter").alias("c"))
    classes = rows.select("path", F.explode("x.package").alias("p")).select("path", F.explode("p.class").alias("k")).select("path", F.col("k._name").alias("class"), F.explode("k.counter").alias("c"))
    return own.union(classes).select("path", F.replace("class", F.lit("/"), F.lit(".")).alias("class"), F.col("c._type").alias("type"), F.col("c._missed").alias("missed"), F.col("c._covered").alias("covered"))


def first_class(reports: DataFrame, fqn: Column | str, strict: bool = False) -> DataFrame:
    """(path, class, missed_branches, covered_branches): each report's first class of a name, nulls where there is none."""
    name = F.lit(fqn) if isinstance(fqn, str) else fqn
    rows = parsed(reports, COVERAGE, strict)
    every = F.flatten(F.transform("x.package", lambda p: p["class"]))
    rows = rows.withColumn("k", F.get(F.filter(every, lambda k: F.replace(k["_name"], F.lit("/"), F.lit(".")) == name), F.lit(0)))
    branch = F.get(F.filter("k.counter", lambda c: c["_type"] == "BRANCH"), F.lit(0))
    return rows.select("path", F.replace("k._name", F.lit("/"), F.lit(".")).alias("class"), branch["_missed"].alias("missed_branches"), branch["_covered"].alias("covered_branches"))


def lines(reports: DataFrame, strict: bool = False) -> DataFrame:
    """(path, package, sourcefile, nr, mi, ci, mb, cb)."""
    rows = parsed(reports, COVERAGE, strict).select("path", F.explode("x.package").alias("p")).select("path", F.col("p._name").alias("package"), F.explode("p.sourcefile").alias("s"))
    each = rows.select("path", "package", F.col("s._name").alias("sourcefile"), F.explode("s.line").alias("l"))
    return each.select("path", "package", "sourcefile", *[F.col(f"l._{c}").alias(c) for c in ("nr", "mi", "ci", "mb", "cb")])


def methods(reports: DataFrame, strict: bool = False) -> DataFrame:
    """(path, class, method, line, type, missed, covered)."""
    rows = parsed(reports, COVERAGE, strict).select("path", F.explode("x.package").alias("p")).select("path", F.explode("p.class").alias("k")).select("path", F.replace("k._name", F.lit("/"), F.lit(".")).alias("class"), F.explode("k.method").alias("m"))
    return rows.select("path", "class", F.col("m._name").alias("method"), F.col("m._line").alias("line"), F.explode("m.counter").alias("c")).select("path", "class", "method", "line", F.col("c._type").alias("type"), F.col("c._missed").alias("missed"), F.col("c._covered").alias("covered"))


def mutations(reports: DataFrame, strict: bool = False) -> DataFrame:
    """(path, status, mutated_class, mutated_method, line_number, mutator, description), status in capitals."""
    rows = parsed(reports, MUTATIONS, strict).select("path", F.explode("x.mutation").alias("m"))
    return rows.select("path", F.upper("m._status").alias("status"), F.col("m.mutatedClass").alias("mutated_class"), F.col("m.mutatedMethod").alias("mutated_method"), F.col("m.lineNumber").alias("line_number"), F.col("m.mutator").alias("mutator"), F.col("m.description").alias("description"))


def suites(reports: DataFrame, strict: bool = False) -> DataFrame:
    """(path, name, tests, failures, errors, skipped)."""
    return parsed(reports, SUITE, strict).select("path", F.col("x._name").alias("name"), *[F.coalesce(F.col(f"x._{c}"), F.lit(0)).alias(c) for c in ("tests", "failures", "errors", "skipped")])


def failing_tests(reports: DataFrame, strict: bool = False) -> DataFrame:
    """(path, name) of tests that failed or broke, each once; what follows a [ isn't part of the name."""
    rows = parsed(reports, SUITE, strict).select("path", F.explode("x.testcase").alias("t"))
    failed = (F.coalesce(F.size("t.failure"), F.lit(0)) > 0) | (F.coalesce(F.size("t.error"), F.lit(0)) > 0)
    return rows.where(failed).select("path", F.substring_index("t._name", "[", 1).alias("name")).distinct()


def of_class(reports: DataFrame, fqn: str) -> DataFrame:
    """The report files of one test class."""
    return reports.where(F.regexp_extract("path", r"([^/\\]+)$", 1) == f"TEST-{fqn}.xml")
