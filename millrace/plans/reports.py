"""Queries over XML reports made from order lines, and their SQL, which reads the lines themselves.

Supplier r has a coverage and a mutation report, order k a report of test cases. Reports of every
seventeenth supplier break off and give no rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports as figures
from ..sources import reports, tables
from .registry import query, sql_table, table

_COVER = "SELECT l_suppkey AS r, l_partkey % 5 AS c, l_linenumber AS nr, count(*) FILTER (WHERE l_linestatus = 'F') AS mi, count(*) FILTER (WHERE l_linestatus = 'O') AS ci, count(*) FILTER (WHERE l_returnflag = 'R') AS mb, count(*) FILTER (WHERE l_returnflag = 'N') AS cb FROM lineitem GROUP BY l_suppkey, l_partkey % 5, l_linenumber"
_WHOLE = f"WITH v AS (SELECT * FROM ({_COVER}) WHERE r % 17 <> 0), k AS (SELECT r, c, sum(mi) AS mi, sum(ci) AS ci, sum(mb) AS mb, sum(cb) AS cb FROM v GROUP BY 1, 2)"


def _tag(name, body=None, /, **attributes):
    """An element as a Column; attributes are Columns."""
    parts = [F.lit(f"<{name}")]
    for k, v in attributes.items():
        parts += [F.lit(f' {k}="'), v.cast("string"), F.lit('"')]
    return F.concat(*parts, F.lit("/>") if body is None else F.concat(F.lit(">"), body, F.lit(f"</{name}>")))


def _joined(*columns):
    """The texts of a group, in the order of their other columns."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*columns))), lambda x: x[columns[-1]]), "")


def coverage_reports(spark, sf):
    c = F.col
    counter = lambda kind, missed, covered: _tag("counter", type=F.lit(kind), missed=missed, covered=covered)
    v = sql_table(spark, sf, _COVER)
    v = v.withColumn("m", _tag("method", counter("LINE", c("mi"), c("ci")), name=F.concat(F.lit("m"), c("nr").cast("string")), desc=F.lit("()V"), line=c("nr") * 10)).withColumn("l", _tag("line", nr=c("nr"), mi=c("mi"), ci=c("ci"), mb=c("mb"), cb=c("cb")))
    k = v.groupBy("r", "c").agg(_joined("nr", "m").alias("ms"), _joined("nr", "l").alias("ls"), *[F.sum(x).alias(x) for x in ("mi", "ci", "mb", "cb")])
    name = F.concat(F.lit("p/C"), c("c").cast("string"))
    branches = F.when(c("c") != 0, counter("BRANCH", c("mb"), c("cb"))).otherwise("")
    k = k.withColumn("k", _tag("class", F.concat("ms", branches, counter("LINE", c("mi"), c("ci"))), name=name, sourcefilename=F.concat(name, F.lit(".java"))))
    k = k.withColumn("s", _tag("sourcefile", c("ls"), name=F.concat(F.lit("C"), c("c").cast("string"), F.lit(".java"))))
    own = lambda x: F.sum(F.when(c("c") != 0, c(x)).otherwise(0))
    r = k.groupBy("r").agg(_joined("c", "k").alias("ks"), _joined("c", "s").alias("ss"), own("mb").alias("mb"), own("cb").alias("cb"))
    text = _tag("report", F.concat(_tag("package", F.concat("ks", "ss"), name=F.lit("p")), counter("BRANCH", c("mb"), c("cb"))), name=c("r"))
    text = F.concat(F.lit('<?xml version="1.0"?><!DOCTYPE report PUBLIC "x" "report.dtd">'), text)
    return r.select(c("r").cast("string").alias("path"), F.when(c("r") % 17 == 0, F.substring(text, 1, 300)).otherwise(text).alias("content"))


@query(f"""{_WHOLE} SELECT CAST(r AS VARCHAR) AS path, 'p.C' || c AS class, CASE WHEN c = 0 OR mb + cb = 0 THEN 100.0 ELSE round(100.0 * cb / (mb + cb), 6) END AS branch_pct, CASE WHEN mi + ci = 0 THEN 100.0 ELSE round(100.0 * ci / (mi + ci), 6) END AS line_pct,
CAST(CASE WHEN c = 0 THEN 0 ELSE mb + cb END AS BIGINT) AS n_branches, CAST(mi + ci AS BIGINT) AS n_lines FROM k""")
def q_xml_coverage(spark, sf):
    """Branch and line coverage of each class of each report."""
    rows = figures.class_coverage(reports.counters(coverage_reports(spark, sf)), ["path"])
    return rows.select("path", "class", F.round("branch_pct", 6).alias("branch_pct"), F.round("line_pct", 6).alias("line_pct"), "n_branches", "n_lines")


@query(f"{_WHOLE} SELECT CAST(r AS VARCHAR) AS path, coalesce(round(100.0 * sum(cb) FILTER (c <> 0) / nullif(sum(mb + cb) FILTER (c <> 0), 0), 6), 100.0) AS branch_pct FROM k GROUP BY 1")
def q_xml_pooled(spark, sf):
    """Branch coverage over whole reports."""
    return figures.pooled_branch(reports.counters(coverage_reports(spark, sf)), ["path"]).select("path", F.round("branch_pct", 6).alias("branch_pct"))


@query(f"""{_WHOLE}, n AS (SELECT r, c, string_agg(CAST(nr AS VARCHAR), ',' ORDER BY nr) FILTER (ci = 0) AS never_run, string_agg(CAST(nr AS VARCHAR), ',' ORDER BY nr) FILTER (ci > 0 AND mb > 0 AND cb > 0) AS partial FROM v GROUP BY 1, 2)
SELECT CAST(r AS VARCHAR) AS path, 'C' || c || '.java' AS sourcefile, coalesce(never_run, '') AS never_run, coalesce(partial, '') AS partial FROM n WHERE never_run IS NOT NULL OR partial IS NOT NULL""")
def q_xml_uncovered(spark, sf):
    """Lines never run, and lines run with branches missed."""
    rows = figures.uncovered(reports.lines(coverage_reports(spark, sf)), ["path", "sourcefile"])
    return rows.select("path", "sourcefile", *[F.array_join(F.transform(c, lambda n: n.cast("string")), ",").alias(c) for c in ("never_run", "partial")])


@query(f"{_WHOLE}, m AS (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY nr) AS place FROM v WHERE mi > 0 OR mb > 0) SELECT CAST(r AS VARCHAR) AS path, 'C' || c || '.java' AS sourcefile, string_agg(nr || ': ' || mi || '/' || (mi + ci), ', ' ORDER BY nr) FILTER (place <= 3) AS lines, greatest(count(*) - 3, 0) AS n_omitted FROM m GROUP BY 1, 2")
def q_xml_source_lines(spark, sf):
    """The first lines of each source that miss something, and how many more there are."""
    return figures.source_lines(reports.lines(coverage_reports(spark, sf)), ["path", "sourcefile"], 3)


@query(f"""{_WHOLE}, m AS (SELECT r, c, string_agg('m' || nr || ' misses ' || mi, chr(10) ORDER BY nr) AS ms FROM v WHERE mi > 0 GROUP BY 1, 2)
SELECT CAST(k.r AS VARCHAR) AS path, 'p.C' || k.c AS class, CASE WHEN k.c <> 0 THEN 'branch ' || cb || '/' || (mb + cb) || ', ' ELSE '' END || 'line ' || ci || '/' || (mi + ci) || coalesce(chr(10) || ms, '') AS summary FROM k LEFT JOIN m ON m.r = k.r AND m.c = k.c""")
def q_xml_summary(spark, sf):
    """A text for each class: its counters and the methods that miss something."""
    r = coverage_reports(spark, sf)
    return figures.summary(reports.counters(r), reports.methods(r), ["path"]).select("path", "class", "summary")


@query(f"{_WHOLE} SELECT CAST(r AS VARCHAR) AS path, 'p.C3' AS class, mb AS missed_branches, cb AS covered_branches FROM k WHERE c = 3 UNION ALL SELECT CAST(r AS VARCHAR), NULL, NULL, NULL FROM v GROUP BY r HAVING count(*) FILTER (c = 3) = 0")
def q_xml_first_class(spark, sf):
    """Each report's first class of a name."""
    return reports.first_class(coverage_reports(spark, sf), "p.C3")


_MUTANTS = "SELECT l_suppkey AS r, l_partkey % 3 AS c, CASE l_returnflag WHEN 'R' THEN 'KILLED' WHEN 'A' THEN 'survived' ELSE CASE l_linenumber WHEN 1 THEN 'NON_VIABLE' WHEN 2 THEN 'RUN_ERROR' WHEN 3 THEN 'NO_COVERAGE' ELSE 'TIMED_OUT' END END AS status, CASE WHEN l_linenumber = 4 THEN NULL ELSE 'm' || l_linenumber END AS method, l_partkey AS line, l_linestatus AS d FROM lineitem"


def mutation_reports(spark, sf):
    c = F.col
    m = sql_table(spark, sf, _MUTANTS)
    some = lambda name, x: F.coalesce(_tag(name, x.cast("string")), F.lit(""))
    m = m.withColumn("m", _tag("mutation", F.concat(some("mutatedClass", F.concat(F.lit("p.C"), c("c").cast("string"))), some("mutatedMethod", c("method")), some("lineNumber", c("line")), some("description", c("d"))), detected=F.lit("true"), status=c("status")))
    r = m.groupBy("r").agg(_joined("line", "m").alias("ms"))
    text = _tag("mutations", c("ms"))
    return r.select(c("r").cast("string").alias("path"), F.when(c("r") % 17 == 0, F.substring(text, 1, 200)).otherwise(text).alias("content"))


@query(f"""WITH m AS (SELECT CAST(r AS VARCHAR) AS path, 'p.C' || c AS mutated_class, upper(status) AS status FROM ({_MUTANTS}) WHERE r % 17 <> 0)
SELECT path, mutated_class, round(coalesce(100.0 * count(*) FILTER (status = 'KILLED') / nullif(count(*) FILTER (status NOT IN ('NON_VIABLE', 'MEMORY_ERROR', 'RUN_ERROR')), 0), 0.0), 6) AS mutation_pct, count(*) FILTER (status NOT IN ('NON_VIABLE', 'MEMORY_ERROR', 'RUN_ERROR')) AS n_mutants FROM m GROUP BY 1, 2""")
def q_xml_mutations(spark, sf):
    """The mutation score of each class of each report."""
    rows = figures.mutation_score(reports.mutations(mutation_reports(spark, sf)), ["path", "mutated_class"])
    return rows.withColumn("mutation_pct", F.round("mutation_pct", 6))


@query(f"""WITH m AS (SELECT CAST(r AS VARCHAR) AS path, line, concat_ws(' ', upper(status), coalesce(method, '<unknown>'), CAST(line AS VARCHAR), d) AS t FROM ({_MUTANTS}) WHERE r % 17 <> 0 AND upper(status) IN ('SURVIVED', 'NO_COVERAGE', 'TIMED_OUT')),
p AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line, t) AS place FROM m) SELECT path, string_agg(t, '; ' ORDER BY place) FILTER (place <= 20) AS lines, greatest(count(*) - 20, 0) AS n_omitted FROM p GROUP BY 1""")
def q_xml_actionable(spark, sf):
    """The first twenty mutants to act upon of each report, and how many more there are."""
    rows = figures.actionable(reports.mutations(mutation_reports(spark, sf)), ["path"])
    return rows.select("path", F.array_join("lines", "; ").alias("lines"), "n_omitted")


_CASES = "SELECT l_orderkey AS k, 't' || l_linenumber AS name, l_partkey AS p, l_returnflag AS flag, l_linenumber = 7 AS skipped FROM lineitem"


def suite_reports(spark, sf):
    c = F.col
    t = sql_table(spark, sf, _CASES)
    body = F.when(c("flag") == "R", '<failure message="no"/>').when(c("flag") == "A", '<error message="no"/>').otherwise("")
    t = t.withColumn("t", _tag("testcase", body, name=F.concat("name", F.lit("["), c("p").cast("string"), F.lit("]")), classname=F.lit("x")))
    n = lambda cond: F.count_if(cond)
    r = t.groupBy("k").agg(_joined("name", "p", "t").alias("ts"), n(F.lit(True)).alias("n"), n(c("flag") == "R").alias("f"), n(c("flag") == "A").alias("e"), n(c("skipped")).alias("s"))
    name = F.concat(F.lit("org.C"), c("k").cast("string"), F.lit("Test"))
    return r.select(F.concat(F.lit("/w/target/surefire-reports/TEST-"), name, F.lit(".xml")).alias("path"), _tag("testsuite", c("ts"), name=name, tests=c("n"), failures=c("f"), errors=c("e"), skipped=c("s")).alias("content"))


@query(f"""WITH t AS ({_CASES}), s AS (SELECT 'org.C' || k || 'Test' AS name, count(*) AS n, count(*) FILTER (flag IN ('R', 'A')) AS bad, count(*) FILTER (skipped) AS skipped FROM t GROUP BY 1)
SELECT name, n - skipped AS run, greatest(n - skipped - bad, 0) AS passed, bad AS failed, n AS harness_run, n - bad - skipped AS harness_passed FROM s""")
def q_xml_suites(spark, sf):
    """Tests run, passed and failed, as the verifier and as the harness count them."""
    s = reports.suites(suite_reports(spark, sf))
    both = figures.test_counts(s, ["name"]).join(figures.test_counts(s, ["name"], harness=True).select("name", F.col("run").alias("harness_run"), F.col("passed").alias("harness_passed")), "name")
    return both.select("name", "run", "passed", "failed", "harness_run", "harness_passed")


@query(f"WITH t AS ({_CASES}) SELECT DISTINCT '/w/target/surefire-reports/TEST-org.C' || k || 'Test.xml' AS path, name FROM t WHERE flag IN ('R', 'A')")
def q_xml_failing_tests(spark, sf):
    """Names of tests that failed or broke, without what follows a bracket."""
    return reports.failing_tests(suite_reports(spark, sf))


@query(f"WITH t AS ({_CASES}) SELECT count(*) AS n, count(*) FILTER (flag IN ('R', 'A')) AS failed FROM t WHERE k = (SELECT min(k) FROM t WHERE k % 7 = 3)")
def q_xml_one_class(spark, sf):
    """Tests and failures of one test class, by its file's name."""
    k = table(spark, sf, "lineitem").where("l_orderkey % 7 = 3").agg(F.min("l_orderkey")).first()[0]
    s = reports.suites(reports.of_class(suite_reports(spark, sf), f"org.C{k}Test"))
    return s.agg(F.sum("tests").alias("n"), F.sum(F.col("failures") + F.col("errors")).alias("failed"))


@query("SELECT event_id, user_id FROM events WHERE ts = (SELECT max(ts) FROM events)")
def q_newest(spark, sf):
    """What has the latest time only."""
    return tables.newest(table(spark, sf, "events", "event_id", "user_id", "ts"), "ts").select("event_id", "user_id")
