"""Queries over test suites in Java made from orders, and their SQL.

Order k is the suite C<k>Test with a test t<n> for each of its lines; lines of one number give tests
of one name. What a line's flag is decides whether its test asserts something; every tenth suite
breaks off. The SQL tells the figures from the lines, not from the text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import java, text
from .registry import query, sql_table

_LINES = "SELECT l_orderkey AS k, l_linenumber AS n, l_returnflag AS flag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS i FROM lineitem"
_ORDERS = "SELECT o_orderkey AS k, o_custkey % 5 <> 0 AS packaged, 'org.p' || (o_custkey % 7) AS package, o_orderkey % 10 = 0 AS broken FROM orders"
_CTE = f"WITH o AS ({_ORDERS}), l AS ({_LINES}), s AS (SELECT o.*, n_tests, n_plain, n_names, n_first FROM o JOIN (SELECT k, count(*) AS n_tests, count(*) FILTER (flag = 'A') AS n_plain, count(DISTINCT n) AS n_names, count(*) FILTER (n = 1) AS n_first FROM l GROUP BY 1) USING (k)), h AS (SELECT *, CASE WHEN packaged THEN 4 ELSE 3 END AS head FROM s)"


def suites(spark, sf):
    """(k, source): the suites."""
    body = "CASE flag WHEN 'R' THEN 'assertEquals(1, \"a}b(\");' WHEN 'A' THEN 'run(2); // no claim {' ELSE '// fail(3)' END"
    tests = sql_table(spark, sf, f"SELECT k, i, '    @Test\\n    void t' || n || '() {{\\n        ' || {body} || '\\n    }}\\n' AS t FROM ({_LINES})")
    tests = tests.groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "t"))), lambda x: x["t"]), "").alias("tests"))  # of one order
    o = sql_table(spark, sf, _ORDERS).join(tests, "k")
    head = F.concat(F.when(F.col("packaged"), F.concat(F.lit("package "), "package", F.lit(";\n"))).otherwise(""), F.lit("import org.junit.Test;\nimport static org.junit.Assert.*;\npublic class C"), F.col("k").cast("string"), F.lit("Test {\n"))
    return o.select("k", F.concat(head, "tests", F.when(F.col("broken"), "    int x =").otherwise("}\n")).alias("source"))


@query(f"{_CTE} SELECT k, CAST(n_tests AS INT) AS n_tests, CAST(n_plain AS INT) AS n_assertless, NOT broken AS balanced, NOT broken AS terminated, CASE WHEN packaged THEN package ELSE '' END AS package, 'C' || k || 'Test' AS entity, CASE WHEN packaged THEN package || '.' ELSE '' END || 'C' || k || 'Test' AS fqn, true AS concrete FROM h")
def q_suite_figures(spark, sf):
    """Tests, tests without an assertion, balance, end, package and names of suites."""
    s = F.col("source")
    path = F.concat(F.lit("src/main/java/org/C"), F.col("k").cast("string"), F.lit("Test.java"))
    return suites(spark, sf).select("k", text.count_tests(s).alias("n_tests"), text.count_assertless(s).alias("n_assertless"), text.is_balanced(s).alias("balanced"), text.looks_terminated(s).alias("terminated"), text.package_name(s).alias("package"), text.entity_name(s).alias("entity"), text.qualified_name(s).alias("fqn"), text.is_concrete(path, s).alias("concrete"))


@query(f"{_CTE} SELECT h.k, string_agg('t' || n || ':' || (head + 4 * (i - 1) + 1) || '-' || (head + 4 * i), ' ' ORDER BY i) AS spans FROM h JOIN l USING (k) GROUP BY 1")
def q_test_spans(spark, sf):
    """Names and lines of a suite's tests."""
    spans = F.transform(java.test_spans(F.col("source")), lambda x: F.concat(x["name"], F.lit(":"), x["start"].cast("string"), F.lit("-"), x["end"].cast("string")))
    return suites(spark, sf).select("k", F.array_join(spans, " ").alias("spans"))


@query(f"{_CTE} SELECT k, CAST(n_tests - n_names AS INT) AS n_removed, CAST(n_names AS INT) AS n_once, CAST(n_tests - n_first AS INT) AS n_without_first, true AS lines_kept, CAST(n_tests AS INT) AS n_closed, true AS closed_balanced FROM h")
def q_suite_repairs(spark, sf):
    """Suites without repeated tests, without named ones, and closed after the last whole member; what is kept was there."""
    s = F.col("source")
    rows = suites(spark, sf).withColumn("once", java.deduplicate_tests(s)).withColumn("without", java.drop_tests(s, F.array(F.lit("t1")))).withColumn("closed", java.truncate_to_last_member(s))
    kept = F.size(F.array_except(text.lines(F.col("without")), text.lines(s))) == 0
    return rows.select("k", F.col("once.removed").alias("n_removed"), text.count_tests(F.col("once.source")).alias("n_once"), text.count_tests(F.col("without")).alias("n_without_first"), kept.alias("lines_kept"), text.count_tests(F.col("closed")).alias("n_closed"), text.is_balanced(F.col("closed")).alias("closed_balanced"))


@query(f"{_CTE} SELECT k, CAST(n_tests + 1 AS INT) AS n_appended, CAST(head + 4 * n_tests + 2 AS INT) AS n_lines_imported, CASE WHEN n_first <> 1 THEN n_first || ' tests are named t1' END AS replace_error, CAST(CASE WHEN n_first = 1 THEN n_tests - 1 END AS INT) AS n_replaced FROM h")
def q_suite_edits(spark, sf):
    """A test appended, an import added, the one test of a name replaced or why not."""
    s = F.col("source")
    rows = suites(spark, sf).withColumn("a", java.append_test(s, F.lit("    @Test void more() { }"))).withColumn("i", java.add_imports(s, F.array(F.lit("java.util.List"), F.lit("org.junit.Test")))).withColumn("r", java.replace_test(s, F.lit("t1"), F.lit("    // gone")))
    return rows.select("k", text.count_tests(F.col("a.text")).alias("n_appended"), F.size(text.lines(F.col("i.text"))).alias("n_lines_imported"), F.col("r.error").alias("replace_error"), text.count_tests(F.col("r.text")).alias("n_replaced"))


@query(f"{_CTE} SELECT k, CAST(head + 4 * n_tests + 1 - 2 + 1 AS INT) AS n_lines, CASE WHEN k % 3 = 0 THEN 'ranges overlap' END AS error FROM h")
def q_replace_lines(spark, sf):
    """Ranges of lines replaced from the bottom; overlapping ones are refused."""
    edit = lambda r, t: F.struct(F.lit(r).alias("range"), F.lit(t).alias("text"))
    edits = F.when(F.col("k") % 3 == 0, F.array(edit("1-2", "x"), edit("2", "y"))).otherwise(F.array(edit("3", "x\ny"), edit("1:2", "")))
    rows = suites(spark, sf).withColumn("e", java.replace_lines(F.regexp_replace("source", r"\n\z", ""), edits))
    n = F.when(F.col("e.error").isNull(), F.size(F.split("e.text", "\n", -1)))
    return rows.select("k", F.coalesce(n, F.size(text.lines(F.col("source"))) - 1).alias("n_lines"), F.col("e.error").alias("error"))


@query(f"{_CTE}, t AS (SELECT k, string_agg('t' || n || '=' || CASE flag WHEN 'R' THEN 'assertEquals(1,\"a}}b(\");' WHEN 'A' THEN 'run(2);' ELSE '' END, ' ' ORDER BY i) AS tests FROM l GROUP BY 1) SELECT k, tests, CASE WHEN packaged THEN 'package' || package || ';' ELSE '' END || 'importorg.junit.Test;importstaticorg.junit.Assert.*;publicclassC' || k || 'Test{{' || CASE WHEN broken THEN 'intx=' ELSE '}}' END AS other FROM h JOIN t USING (k)".replace("{{", "{").replace("}}", "}"))
def q_suite_members(spark, sf):
    """A suite's tests in order and what is beside them, both without comments and white space."""
    rows = suites(spark, sf).withColumn("m", java.suite_members(F.col("source")))
    inner = lambda t: F.concat(t["name"], F.lit("="), F.regexp_extract(t["body"], r"\(\)\{(.*)\}$", 1))
    return rows.select("k", F.array_join(F.transform("m.tests", inner), " ").alias("tests"), F.col("m.other").alias("other"))


@query(f"{_CTE}, t AS (SELECT k, count(*) FILTER (n = 2) AS n_two FROM l GROUP BY 1) SELECT k, CASE WHEN broken THEN CAST(head + 4 * n_tests + 1 AS INT) END AS broken_at, CAST(n_tests - n_two AS INT) AS n_left, CAST(n_tests AS INT) AS n_methods FROM h JOIN t USING (k)")
def q_suite_structure(spark, sf):
    """Where a suite's braces break, methods, and the suite without a named test and what is above it."""
    s = F.col("source")
    rows = suites(spark, sf).withColumn("f", java.syntax_feedback(s, s, F.array(F.struct(F.lit("1").alias("range"), F.lit("x").alias("text")))))
    at = F.regexp_extract("f", r"breaks near line (\d+) ", 1)
    return rows.select("k", F.when(F.col("f").isNotNull(), at.cast("int")).alias("broken_at"), text.count_tests(java.without_tests(s, F.array(F.lit("t2")))).alias("n_left"), F.size(java.methods(s)).alias("n_methods"))


_OUTPUT = """SELECT user_id, event_id, event_type = 'error' AS foreign_file, CAST(floor(value) AS INT) AS ln, CASE event_type WHEN 'click' THEN 'cannot find symbol' WHEN 'view' THEN 'x has private access in Y' ELSE 'missing ;' END AS m FROM events"""


@query(f"""WITH e AS ({_OUTPUT}), d AS (SELECT DISTINCT user_id, foreign_file, ln, m FROM e) SELECT user_id, count(*) AS n_errors, count(*) FILTER (NOT foreign_file) AS n_own, (SELECT count(*) FROM e x WHERE x.user_id = d.user_id) >= 100 AS truncated,
CASE WHEN bool_or(foreign_file) THEN NULL ELSE string_agg(DISTINCT CAST(ln AS VARCHAR), ',' ORDER BY CAST(ln AS VARCHAR)) END AS lines, string_agg(DISTINCT CASE WHEN m = 'cannot find symbol' THEN 'T' || ln % 5 WHEN m LIKE 'x%' THEN 'Y' END, ',' ORDER BY CASE WHEN m = 'cannot find symbol' THEN 'T' || ln % 5 WHEN m LIKE 'x%' THEN 'Y' END) AS types FROM d GROUP BY 1""")
def q_compiler_output(spark, sf):
    """Errors of a compiler's output, each once; those of the own file, their lines, whether the cap was met, the types they are about."""
    e = sql_table(spark, sf, _OUTPUT)
    line = F.concat(F.lit("[ERROR] /w/src/"), F.when(F.col("foreign_file"), "Other").otherwise("Own"), F.lit(".java:["), F.col("ln").cast("string"), F.lit(",7] "), "m", F.when(F.col("m") == "cannot find symbol", F.concat(F.lit("\n  symbol:   class T"), (F.col("ln") % 5).cast("string"), F.lit("\n  location: class Own"))).otherwise(""))
    out = e.withColumn("line", line).groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "line"))), lambda x: x["line"]), "\n").alias("o"), F.count("*").alias("n"))
    out = out.withColumn("output", F.concat("o", F.lit("\n"), "o", F.lit("\n[INFO] "), F.col("n").cast("string"), F.lit(" errors")))  # the build prints its errors twice
    from ..operators import logs

    told = out.withColumn("file_name", F.lit("Own.java")).withColumn("errors", text.javac_errors(F.col("output")))
    rows = logs.failing_lines(told).withColumn("own", text.own_errors(F.col("output"), F.lit("Own.java"), F.col("errors")))
    return rows.select("user_id", F.size("errors").cast("long").alias("n_errors"), F.size("own.errors").cast("long").alias("n_own"), F.col("own.truncated").alias("truncated"), F.array_join(F.array_sort(F.transform("lines", lambda x: x.cast("string"))), ",").alias("lines"), F.array_join(text.misused_types(F.col("output")), ",").alias("types"))
