"""Named queries over the driver's tables and their SQL for DuckDB.

The tables hold no rollouts, so each query puts an operator of this package to work on an analogue:
lines of orders stand for rollouts of prompts, orders for prompts, events for a log. Every query
reads its whole tables.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scoring, text
from ..operators import attribution, audit, graph, logs, reports, routing, search, stats
from ..shared import fit, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "q_rollout_stats"


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    fit(spark, f"{sf}/{name}.parquet")
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return df.select(*columns) if columns else df


def sql_table(spark: SparkSession, sf: str, sql: str, dealt: bool = False) -> DataFrame:
    """A table made by SQL that both engines read alike, over the tables of sf; dealt: their rows are spread() first, for dear work on each."""
    names = sorted(set(re.findall(r"\b(?:FROM|JOIN) (part|orders|lineitem|supplier|customer|nation|events|documents|conversations|labels|pages|benchmark)\b", sql)))
    text = re.sub(rf"\b(FROM|JOIN) ({'|'.join(names)})\b", r"\1 {\2}", sql.replace("{", "{{").replace("}", "}}"))
    return spark.sql(text, **{n: spread(table(spark, sf, n)) if dealt else table(spark, sf, n) for n in names})


# Lines as rollouts: what a score row has, told from a line's columns.
ROLLOUTS = {
    "class_key": "l_orderkey", "status": "CASE l_returnflag WHEN 'R' THEN 'INFRA_ERROR' WHEN 'A' THEN 'COMPILE_FAIL' ELSE 'OK' END", "compiled": "l_returnflag <> 'A'",
    "tests_run": "l_linenumber * 3", "tests_passed": "CASE WHEN l_linestatus = 'O' THEN l_linenumber * 3 ELSE l_linenumber * 2 END", "tests_failed": "CASE WHEN l_linestatus = 'O' THEN 0 ELSE l_linenumber END",
    "branch_coverage_pct": "CASE WHEN l_discount = 0 THEN NULL ELSE l_quantity * 2 END", "line_coverage_pct": "CASE WHEN l_tax >= 0.07 THEN NULL WHEN l_tax = 0 THEN 0.0 ELSE l_tax * 1000 END",
    "n_branches": "CASE WHEN l_quantity < 10 THEN 0 WHEN l_quantity < 20 THEN NULL ELSE CAST(l_quantity AS INT) END", "mutation_score_pct": "CASE WHEN l_linestatus = 'O' THEN l_discount * 1000 END",
    "green_subset_mutation_score_pct": "CASE WHEN l_linestatus <> 'O' AND l_discount > 0.02 THEN l_discount * 500 END",
    "n_tests": "l_linenumber * 3", "terminated": "l_quantity > 5", "n_tests_clean": "CAST(l_quantity AS INT) % 5", "n_tests_broken": "l_linenumber % 4", "n_skeleton_errors": "CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END",
    "n_compile_errors": "l_linenumber % 3", "attribution_available": "l_linenumber <> 6", "salvaged": "l_quantity > 25", "salvaged_tests_run": "l_linenumber % 5", "salvaged_tests_passed": "l_linenumber % 3",
    "salvaged_tests_failed": "CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE 1 END", "salvaged_branch_coverage_pct": "l_quantity", "salvaged_line_coverage_pct": "CASE WHEN l_tax = 0 THEN 0.0 ELSE l_quantity END",
    "salvaged_n_branches": "l_linenumber", "salvaged_mutation_score_pct": "l_discount * 100",
}
ROLLOUTS_SQL = "rollouts AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in ROLLOUTS.items()) + ", l_partkey, l_suppkey, l_linenumber, l_extendedprice FROM lineitem)"


def rollouts(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "lineitem").selectExpr(*[f"{v} AS {k}" for k, v in ROLLOUTS.items()], "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    return df.withColumn("is_green", scoring.green(F.col("compiled"), F.col("tests_run"), F.col("tests_failed"))).withColumn("usable", scoring.usable())


_GREEN = "(compiled AND tests_run > 0 AND tests_failed = 0)"
_USABLE = "(status IN ('OK', 'TEST_FAIL', 'COMPILE_FAIL', 'UNPARSEABLE'))"
_SALVAGED_GREEN = "(salvaged AND salvaged_tests_run > 0 AND salvaged_tests_failed = 0)"
_FRACTION = "(CASE WHEN compiled THEN 1.0 WHEN NOT attribution_available OR n_skeleton_errors > 0 OR (n_compile_errors = 0 AND n_tests_broken = 0) THEN 0.0 WHEN n_tests_clean + n_tests_broken = 0 THEN 0.0 ELSE CAST(n_tests_clean AS DOUBLE) / (n_tests_clean + n_tests_broken) END)"
_PASS = "(CASE WHEN {p}tests_run = 0 THEN 0.0 ELSE CAST({p}tests_passed AS DOUBLE) / {p}tests_run END)"
_COVER = "(CASE WHEN {p}n_branches IS NOT NULL AND {p}n_branches <> 0 THEN coalesce({p}branch_coverage_pct, 0.0) ELSE coalesce({p}line_coverage_pct, {p}branch_coverage_pct, 0.0) END)"
QUALITY_SQL = f"""CASE WHEN NOT {_USABLE} THEN NULL WHEN compiled
  THEN 0.4 + 0.2 * {_PASS.format(p='')} + 0.2 * coalesce(branch_coverage_pct, 0.0) / 100 + CASE WHEN {_GREEN} THEN 0.2 * coalesce(mutation_score_pct, 0.0) / 100 ELSE 0.0 END
  ELSE 0.4 * {_FRACTION} + 0.2 * {_PASS.format(p='salvaged_')} + 0.2 * coalesce(salvaged_branch_coverage_pct, 0.0) / 100 + CASE WHEN {_SALVAGED_GREEN} THEN 0.2 * coalesce(salvaged_mutation_score_pct, 0.0) / 100 ELSE 0.0 END END"""
QUALITY_2_SQL = f"""CASE WHEN NOT {_USABLE} THEN NULL
  WHEN compiled AND line_coverage_pct <= 0 THEN 0.0
  WHEN compiled THEN 0.2 * {_COVER.format(p='')} / 100 + 0.4 * {_PASS.format(p='')} + 0.4 * {_PASS.format(p='')} * coalesce(CASE WHEN {_GREEN} THEN mutation_score_pct ELSE green_subset_mutation_score_pct END, 0.0) / 100
  WHEN n_skeleton_errors > 0 OR NOT salvaged OR salvaged_line_coverage_pct <= 0 THEN 0.0
  ELSE 0.15 * (0.2 * {_COVER.format(p='salvaged_')} / 100 + 0.4 * {_PASS.format(p='salvaged_')}) * {_FRACTION} END"""


@query(f"""WITH {ROLLOUTS_SQL}, s AS (SELECT *, {_USABLE} AS usable, {_GREEN} AS is_green, {QUALITY_SQL} AS quality FROM rollouts),
g AS (SELECT status, class_key, count(*) n, bool_or(compiled) c, bool_or(is_green) g, stddev_pop(coalesce(quality, 0.0)) spread, count(DISTINCT coalesce(round(quality, 9), 0.0)) v FROM s WHERE usable GROUP BY 1, 2),
two AS (SELECT status, count(*) prompts, count(*) FILTER (c) prompts_any_compile, count(*) FILTER (g) prompts_any_green, round(avg(spread) FILTER (n > 1), 6) within_prompt_stdev, round(avg(v), 6) distinct_values_per_prompt FROM g GROUP BY 1),
one AS (SELECT status, count(*) rollouts, count(*) FILTER (usable) usable,
  round(100.0 * count(*) FILTER (usable AND compiled) / nullif(count(*) FILTER (usable), 0), 6) compiled_pct, round(100.0 * count(*) FILTER (usable AND is_green) / nullif(count(*) FILTER (usable), 0), 6) green_pct,
  round(100.0 * count(*) FILTER (usable AND terminated) / nullif(count(*) FILTER (usable), 0), 6) terminated_pct,
  median(CAST(n_tests AS DOUBLE)) FILTER (usable) median_tests, median(CAST(line_coverage_pct AS DOUBLE)) FILTER (usable AND compiled) median_line_coverage_compiling,
  median(CAST(mutation_score_pct AS DOUBLE)) FILTER (usable AND compiled AND is_green) median_mutation_green, round(avg(coalesce(quality, 0.0)) FILTER (usable), 6) mean_quality FROM s GROUP BY 1)
SELECT one.*, two.* EXCLUDE (status) FROM one LEFT JOIN two USING (status)""")
def q_rollout_stats(spark, sf):
    """Fourteen figures over rollouts by status: the summary of a sampling round."""
    rows = rollouts(spark, sf).withColumn("quality", F.round(scoring.quality(graded=True), 9))
    out = stats.rollout_stats(rows, ["status"], digits=6)
    return out.select("status", "rollouts", "usable", "compiled_pct", "green_pct", "terminated_pct", "median_tests", "median_line_coverage_compiling", "median_mutation_green", "mean_quality", "prompts", "prompts_any_compile", "prompts_any_green", "within_prompt_stdev", "distinct_values_per_prompt")


@query(f"WITH {ROLLOUTS_SQL} SELECT class_key, l_partkey, l_suppkey, l_linenumber, round({QUALITY_SQL}, 6) AS quality, round({QUALITY_2_SQL}, 6) AS quality_v2 FROM rollouts")
def q_quality(spark, sf):
    """Both score formulas of every rollout."""
    return rollouts(spark, sf).select("class_key", "l_partkey", "l_suppkey", "l_linenumber", F.round(scoring.quality(graded=True), 6).alias("quality"), scoring.quality_2().alias("quality_v2"))


@query(f"WITH {ROLLOUTS_SQL} SELECT class_key, l_linenumber, l_partkey, round({_FRACTION}, 6) AS compiled_fraction, round({_COVER.format(p='')}, 6) AS coverage, {_GREEN} AS is_green, greatest(coalesce(mutation_score_pct, 0.0), coalesce(green_subset_mutation_score_pct, 0.0), coalesce(salvaged_mutation_score_pct, 0.0)) > 0 AS kills FROM rollouts")
def q_score_columns(spark, sf):
    """Derived score columns: compiled share, effective coverage, green, kills a mutant."""
    return rollouts(spark, sf).select("class_key", "l_linenumber", "l_partkey", F.round(scoring.fraction(), 6).alias("compiled_fraction"), F.round(scoring.Suite().coverage, 6).alias("coverage"), "is_green", scoring.kills_a_mutant().alias("kills"))


_RANK = "l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber, l_quantity, l_shipdate"


def _ranked() -> list:
    return [F.desc("l_extendedprice"), "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate"]


@query(f"SELECT l_orderkey, l_partkey, l_extendedprice, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_RANK}) AS r FROM lineitem WHERE l_extendedprice >= 2000) WHERE r <= 3")
def q_topk_candidates(spark, sf):
    """The three best candidates of each prompt."""
    rows = table(spark, sf, "lineitem").where("l_extendedprice >= 2000")
    return routing.top(rows, ["l_orderkey"], _ranked(), 3).select("l_orderkey", "l_partkey", "l_extendedprice", "rank")


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_RANK}) AS rank FROM lineitem), t AS (SELECT * FROM r WHERE rank <= 3),
g AS (SELECT l_orderkey, min(rank) FILTER (l_returnflag = 'N') AS chosen, count(*) AS n FROM t GROUP BY 1) SELECT l_orderkey, CAST(chosen AS INT) AS chosen, CAST(coalesce(chosen, n) AS BIGINT) AS n_tried FROM g""")
def q_first_accepted(spark, sf):
    """The first candidate that verifies, and how many were tried."""
    return routing.first_accepted(routing.top(table(spark, sf, "lineitem"), ["l_orderkey"], _ranked(), 3), ["l_orderkey"], F.col("l_returnflag") == "N").select("l_orderkey", "chosen", F.col("n_tried").cast("long"))


@query("SELECT l_orderkey, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem) WHERE r = 1")
def q_argmax_tie(spark, sf):
    """The rollout with most tests, ties to the lowest index."""
    order = F.struct("l_quantity", -F.col("l_linenumber"), -F.col("l_partkey"), -F.col("l_suppkey"))
    return routing.best(table(spark, sf, "lineitem"), ["l_orderkey"], order, "l_partkey", "l_quantity")


@query("SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE role = 'assistant' AND text <> '') WHERE r = 1")
def q_last_state(spark, sf):
    """The last answer of each conversation (the last green suite of a run)."""
    return routing.last_where(table(spark, sf, "conversations"), ["conv_id"], "turn", (F.col("role") == "assistant") & (F.col("text") != ""), "turn", "text")


@query("""SELECT * FROM (SELECT user_id, 'latest' AS kind, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1)
UNION ALL SELECT * FROM (SELECT user_id, 'most' AS kind, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, ts DESC, event_id DESC) AS r FROM events) WHERE r = 1)""")
def q_accumulate(spark, sf):
    """Latest wins, and more wins with ties to the later row."""
    rows = table(spark, sf, "events", "user_id", "ts", "event_id", "value")
    parts = {"latest": F.struct("ts", "event_id"), "most": F.struct("value", "ts", "event_id")}
    return routing.tagged_union({k: routing.accumulate(rows, ["user_id"], o, "event_id", "value") for k, o in parts.items()})


@query("SELECT o_orderkey, o_orderpriority, CAST(r AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS r FROM orders) ORDER BY r, o_orderpriority LIMIT 100")
def q_round_robin(spark, sf):
    """A hundred prompts, one of each project in turn, cheapest first."""
    rows = table(spark, sf, "orders", "o_orderkey", "o_orderpriority", "o_totalprice")
    return routing.round_robin(rows, "o_orderpriority", ["o_totalprice", "o_orderkey"], 100).select("o_orderkey", "o_orderpriority", "place")


@query("SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
def q_resume_anti(spark, sf):
    """What is still to do."""
    return routing.resume(table(spark, sf, "orders", "o_orderkey", "o_custkey"), table(spark, sf, "lineitem", "l_orderkey").withColumnRenamed("l_orderkey", "o_orderkey"), ["o_orderkey"])


@query("SELECT o_orderkey, o_totalprice FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_discount > 0.05 AND l.l_returnflag = 'R')")
def q_semi_eligible(spark, sf):
    """What is eligible for the expensive tier."""
    lines = table(spark, sf, "lineitem").where("l_discount > 0.05 AND l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders", "o_orderkey", "o_totalprice").join(lines, "o_orderkey", "left_semi")


@query("""SELECT coalesce(l.doc_id, d.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN d.source END AS source, CASE WHEN l.doc_id IS NULL THEN d.n_chars END AS n_chars, l.quality, l.toxic
FROM (SELECT doc_id, source, n_chars FROM documents) d FULL JOIN labels l ON d.doc_id = l.doc_id""")
def q_overlay(spark, sf):
    """Second-tier rows in place of first-tier ones, whole rows."""
    return routing.overlay(table(spark, sf, "documents", "doc_id", "source", "n_chars"), table(spark, sf, "labels"), ["doc_id"])


@query("""WITH refs AS (SELECT o_custkey, CAST(count(*) AS BIGINT) AS tokens FROM orders GROUP BY 1), m AS (SELECT CAST(floor(median(tokens)) AS BIGINT) AS middle FROM refs)
SELECT c_custkey, least(2 * coalesce(tokens, middle) + 64, 100 - c_nationkey - 16) AS max_tokens FROM customer LEFT JOIN refs ON c_custkey = o_custkey CROSS JOIN m""")
def q_caps(spark, sf):
    """Token caps: twice the reference or the median of all, within the model's length."""
    refs = table(spark, sf, "orders", "o_custkey").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("tokens"))
    prompts = table(spark, sf, "customer", "c_custkey", "c_nationkey").withColumnRenamed("c_nationkey", "prompt_tokens")
    return routing.caps(prompts, refs, "c_custkey", 100).select("c_custkey", F.col("max_tokens").cast("long"))


@query("""WITH spans AS (SELECT user_id, event_id AS span_id, ts AS s, ts + to_minutes(CAST(floor(value) AS INTEGER) % 240) AS e FROM events WHERE event_type = 'purchase' OR event_type = 'click'),
points AS (SELECT user_id, event_id, ts FROM events WHERE event_type NOT IN ('purchase', 'click'))
SELECT p.user_id, p.event_id, arg_min(s.span_id, (s.s, s.span_id)) AS span_id FROM points p LEFT JOIN spans s ON p.user_id = s.user_id AND p.ts BETWEEN s.s AND s.e GROUP BY 1, 2""")
def q_interval_attr(spark, sf):
    """Points to the first interval of their key that holds them."""
    rows = table(spark, sf, "events", "user_id", "event_id", "ts", "event_type", "value")
    kind = F.col("event_type").isin("purchase", "click")
    spans = rows.where(kind).select("user_id", F.col("event_id").alias("span_id"), F.col("ts").alias("s"), (F.col("ts") + F.make_interval(mins=F.floor("value").cast("int") % 240)).alias("e"))
    return attribution.containing(rows.where(~kind).select("user_id", "event_id", "ts"), spans, "user_id", "ts", "s", "e", F.struct("s", "span_id"), ["user_id", "event_id"], ["span_id"])


@query("""WITH o AS (SELECT o_custkey AS suite, CAST(floor(o_totalprice) AS BIGINT) AS a, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'test' ELSE 'other' END AS kind FROM orders),
spans AS (SELECT suite, o_orderkey AS name, kind, a AS "start", a + 20000 + o_orderkey % 90000 AS "end", 20000 + o_orderkey % 90000 AS size FROM o), points AS (SELECT DISTINCT suite, a + 7000 AS "row" FROM o),
held AS (SELECT p.suite, p."row", arg_min(s.name, (CASE WHEN kind = 'test' THEN 0 ELSE 1 END, CASE WHEN kind = 'test' THEN s."start" ELSE size END, s."start", s.name)) AS name FROM points p LEFT JOIN spans s ON p.suite = s.suite AND p."row" BETWEEN s."start" AND s."end" GROUP BY 1, 2)
SELECT suite, "row", CASE WHEN bool_and(name IS NOT NULL) OVER (PARTITION BY suite) THEN name END AS name FROM held""")
def q_smallest_enclosing(spark, sf):
    """Points to the tests, or else the smallest declarations, that hold them; all of a suite or none."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("suite"), F.floor("o_totalprice").alias("a"), "o_orderkey", F.when(F.col("o_orderstatus") == "F", "test").otherwise("other").alias("kind"))
    size = 20000 + F.col("o_orderkey") % 90000
    spans = o.select("suite", F.col("o_orderkey").alias("name"), "kind", F.col("a").alias("start"), (F.col("a") + size).alias("end"), size.alias("size"))
    return attribution.smallest_enclosing(o.select("suite", (F.col("a") + 7000).alias("row")).distinct(), spans)


@query("""WITH c AS (SELECT CAST(l_suppkey AS VARCHAR) AS class,
  100.0 * sum(l_linenumber) FILTER (l_returnflag = 'R') / nullif(7 * count(*) FILTER (l_returnflag = 'R'), 0) AS b, 100.0 * sum(l_linenumber) FILTER (l_returnflag = 'A') / nullif(7 * count(*) FILTER (l_returnflag = 'A'), 0) AS li,
  7 * count(*) FILTER (l_returnflag = 'R') AS nb, 7 * count(*) FILTER (l_returnflag = 'A') AS nl FROM lineitem GROUP BY 1)
SELECT class, round(coalesce(b, 100.0), 6) AS branch_pct, round(coalesce(li, 0.0), 6) AS line_pct, CAST(nb AS BIGINT) AS n_branches, CAST(nl AS BIGINT) AS n_lines FROM c""")
def q_pooled_ratio(spark, sf):
    """Coverage by class from counters; the figure where there is nothing to cover differs by kind."""
    kind = F.when(F.col("l_returnflag") == "R", "BRANCH").when(F.col("l_returnflag") == "A", "LINE").otherwise("OTHER")
    counters = table(spark, sf, "lineitem").select(F.lit(1).alias("one"), F.col("l_suppkey").cast("string").alias("class"), kind.alias("type"), (7 - F.col("l_linenumber")).alias("missed"), F.col("l_linenumber").alias("covered"))
    out = reports.class_coverage(counters, ["one"], no_lines=0.0)
    return out.select("class", F.round("branch_pct", 6).alias("branch_pct"), F.round("line_pct", 6).alias("line_pct"), "n_branches", "n_lines")


_STATUS = "CASE WHEN l_linenumber = 1 THEN 'NON_VIABLE' WHEN l_returnflag = 'R' THEN 'KILLED' WHEN l_returnflag = 'A' THEN 'SURVIVED' ELSE 'NO_COVERAGE' END"


@query(f"WITH m AS (SELECT l_suppkey AS report, {_STATUS} AS status FROM lineitem) SELECT report, round(coalesce(100.0 * count(*) FILTER (status = 'KILLED') / nullif(count(*) FILTER (status <> 'NON_VIABLE'), 0), 0.0), 6) AS mutation_pct, count(*) FILTER (status <> 'NON_VIABLE') AS n_mutants FROM m GROUP BY 1")
def q_mutation_score(spark, sf):
    """Killed of all mutants that count."""
    m = table(spark, sf, "lineitem").selectExpr("l_suppkey AS report", f"{_STATUS} AS status")
    return reports.mutation_score(m, ["report"]).withColumn("mutation_pct", F.round("mutation_pct", 6))


@query(f"WITH m AS (SELECT l_returnflag AS report, {_STATUS} AS status FROM lineitem) SELECT report, status, count(*) AS count FROM m GROUP BY 1, 2")
def q_status_hist(spark, sf):
    """Mutants by status."""
    return reports.status_counts(table(spark, sf, "lineitem").selectExpr("l_returnflag AS report", f"{_STATUS} AS status"), ["report"])


@query("""SELECT coalesce(l_returnflag, 'ALL') AS l_returnflag, count(*) FILTER (l_discount > 0.03) AS n_hit, count(*) FILTER (l_discount <= 0.03) AS n_miss,
  round(CAST(count(*) FILTER (l_discount > 0.03) AS DOUBLE) / count(*), 6) AS recall FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), ())""")
def q_recall_rollup(spark, sf):
    """Recall by project, and over all."""
    hit = F.col("l_discount") > 0.03
    return stats.recall(table(spark, sf, "lineitem", "l_returnflag", "l_discount"), "l_returnflag", hit, ~hit)


@query("""WITH s AS (SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS size FROM documents GROUP BY 1)
SELECT lang, n, size, round(n / sum(n) OVER (), 6) AS n_share, round(size / sum(size) OVER (), 6) AS size_share FROM s""")
def q_category_shares(spark, sf):
    """Files and characters by category, with their shares."""
    return stats.shares(table(spark, sf, "documents", "lang", "n_chars"), "lang", "n_chars")


@query("""WITH r AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT lang, max(n_chars) FILTER (i = floor(n * 0.9)) AS p90, max(n_chars) FILTER (i = floor(n / 2)) AS middle FROM r GROUP BY 1""")
def q_percentile_nearest(spark, sf):
    """Percentiles by index, not interpolated."""
    rows = table(spark, sf, "documents", "lang", "n_chars")
    return stats.at_share(rows, "n_chars", 0.9, ["lang"], "p90").join(stats.at_share(rows, "n_chars", None, ["lang"], "middle"), "lang")


@query("""WITH e AS (SELECT user_id, event_id, ts, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS v FROM events),
h AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS held FROM e),
d AS (SELECT user_id, event_id, round(held - lag(held) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS delta FROM h)
SELECT user_id, event_id, delta, coalesce(delta >= 1.0, false) AS improved FROM d""")
def q_delta(spark, sf):
    """Each score against the one before; a missing one carries the last on."""
    rows = table(spark, sf, "events", "user_id", "event_id", "ts", "event_type", "value").withColumn("v", F.when(F.col("event_type") != "error", F.col("value"))).withColumn("seq", F.struct("ts", "event_id"))
    return routing.deltas(rows, "user_id", "seq", "v", 1.0).select("user_id", "event_id", "delta", "improved")


@query("""WITH e AS (SELECT user_id, event_id, ts, value < 20 AS failed FROM events), g AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM e)
SELECT user_id, event_id, CAST(sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM g""")
def q_streak_reset(spark, sf):
    """Failures in a row, reset by a success."""
    return routing.streaks(table(spark, sf, "events", "user_id", "event_id", "ts", "value"), "user_id", ["ts", "event_id"], F.col("value") < 20).select("user_id", "event_id", F.col("streak").cast("long"))


@query("""WITH g AS (SELECT d.source, count(*) AS n, count(*) FILTER (quality = 1) AS n_wanted, CAST(sum(n_chars) AS BIGINT) AS size FROM documents d LEFT JOIN labels USING (doc_id) GROUP BY 1), r AS (SELECT *, round(CAST(n_wanted AS DOUBLE) / n, 6) AS rate FROM g)
SELECT source, n, n_wanted, rate, CAST(row_number() OVER w AS INT) AS place, CAST(sum(n_wanted) OVER w AS BIGINT) AS wanted_upto, CAST(sum(size) OVER w AS BIGINT) AS size_upto FROM r WINDOW w AS (ORDER BY rate DESC, source ROWS UNBOUNDED PRECEDING)""")
def q_cum_curve(spark, sf):
    """The recall curve: groups best first, with running totals."""
    rows = table(spark, sf, "documents", "doc_id", "source", "n_chars").join(table(spark, sf, "labels"), "doc_id", "left").withColumn("wanted", F.coalesce(F.col("quality") == 1, F.lit(False)))
    return stats.cumulative(rows, "source", "wanted", "n_chars")


@query("""WITH s AS (SELECT user_id, event_id, epoch(ts) AS a, epoch(ts) + CAST(floor(value) AS BIGINT) * 60 AS b FROM events), o AS (SELECT *, coalesce(a <= lag(b) OVER (PARTITION BY user_id ORDER BY a, event_id), false) AS o FROM s)
SELECT user_id, count(*) AS n_ranges, count(*) FILTER (o) AS n_overlaps FROM o GROUP BY 1""")
def q_overlap_check(spark, sf):
    """Ranges that overlap the one before."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = table(spark, sf, "events", "user_id", "event_id", "ts", "value").withColumn("a", at).withColumn("b", at + F.floor("value") * 60)
    return routing.overlaps(rows, "user_id", "a", "b", ["a", "event_id"])


@query("SELECT text, min(doc_id) AS doc_id, count(*) AS n_rows FROM documents GROUP BY 1")
def q_dedup_first(spark, sf):
    """The first of equal texts. The texts' digests are grouped, not the texts."""
    rows = table(spark, sf, "documents", "doc_id", "text")
    kept = routing.keep_first(rows.select("doc_id", F.sha2("text", 256).alias("digest")), ["digest"], "doc_id").select("doc_id", "n_rows")
    return rows.join(kept, "doc_id").select("text", "doc_id", "n_rows")


@query("""SELECT kind, count(*) AS n, CAST(sum(round(price * 100)) AS BIGINT) AS cents FROM (SELECT 'self' AS kind, o_totalprice AS price FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'model_best', o_totalprice FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT 'harness', p_retailprice FROM part) GROUP BY 1""")
def q_union_kinds(spark, sf):
    """Targets of three kinds."""
    o = table(spark, sf, "orders", "o_orderstatus", F.col("o_totalprice").alias("price"))
    rows = routing.tagged_union({"self": o.where("o_orderstatus = 'O'").select("price"), "model_best": o.where("o_orderstatus = 'F'").select("price"), "harness": table(spark, sf, "part", F.col("p_retailprice").alias("price"))})
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.round(F.col("price") * 100)).cast("long").alias("cents"))


@query("""WITH w AS (SELECT conv_id, turn, list_distinct(string_split(lower(text), ' ')) AS words FROM conversations), p AS (SELECT a.conv_id, a.turn, a.words AS x, b.words AS y FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, len(list_filter(y, lambda v: NOT list_contains(x, v))) AS n_added, len(list_filter(x, lambda v: NOT list_contains(y, v))) AS n_removed, len(list_filter(x, lambda v: list_contains(y, v))) AS n_kept FROM p""")
def q_set_diff(spark, sf):
    """Words added, removed and kept from one turn to the next."""
    w = table(spark, sf, "conversations").select("conv_id", "turn", F.array_distinct(F.split(F.lower("text"), " ")).alias("words"))
    pairs = audit.successive(w, "conv_id", "turn", "words")
    return audit.set_difference(pairs, "before", "after").select("conv_id", "turn", *[F.col(c).cast("long") for c in ("n_added", "n_removed", "n_kept")])


@query("SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def q_substring_theta(spark, sf):
    """Texts that contain another text."""
    return search.containing_texts(table(spark, sf, "documents", "doc_id", "text"), table(spark, sf, "benchmark"), "item_id")


@query("SELECT o_custkey AS value, array_to_string(list_sort(list(DISTINCT o_orderkey)), ',') AS keys FROM orders GROUP BY 1")
def q_inversion(spark, sf):
    """An inverted index."""
    out = graph.inverted(table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("value")), "key", "value", "keys")
    return out.select("value", F.array_join("keys", ",").alias("keys"))


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 0), r AS (SELECT src, dst, 1 AS depth FROM e WHERE src <> dst UNION ALL SELECT r.src, e.dst, depth + 1 FROM r JOIN e ON r.dst = e.src)
SELECT src, dst, min(depth) AS depth FROM r WHERE src <> dst GROUP BY 1, 2""")
def q_closure(spark, sf):
    """Everything reachable, with the nearest depth."""
    return graph.closure(table(spark, sf, "part").where("p_partkey > 0").selectExpr("p_partkey AS src", "p_partkey div 2 AS dst"))


@query("""WITH ol AS (SELECT o_custkey AS cut, l_partkey, l_suppkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
steps AS (SELECT cut, l_partkey AS fqn, 0 AS prio, 'own_surface' AS pattern, 1 AS hops FROM ol UNION SELECT cut, l_suppkey, 4, 'ctor_args', 2 FROM ol UNION SELECT cut, l_partkey // 2, 7, 'results', 2 FROM ol)
SELECT cut, fqn, arg_min(pattern, prio) AS pattern, min(hops) AS hops, count(*) AS n FROM steps WHERE cut <> fqn AND fqn IN (SELECT p_partkey FROM part) GROUP BY 1, 2""")
def q_walk(spark, sf):
    """Candidates of a walk over patterns, the first pattern by priority."""
    ol = table(spark, sf, "orders", "o_orderkey", "o_custkey").join(table(spark, sf, "lineitem", "l_orderkey", "l_partkey", "l_suppkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    step = lambda e, pattern, hops: F.struct(F.expr(e).cast("long").alias("fqn"), F.lit(pattern).alias("pattern"), F.lit(hops).alias("hops"))
    steps = F.array(step("l_partkey", "own_surface", 1), step("l_suppkey", "ctor_args", 2), step("l_partkey div 2", "results", 2))
    out = graph.walked(ol.select(F.col("o_custkey").alias("cut"), F.inline(steps)), table(spark, sf, "part", F.col("p_partkey").alias("class")))
    return out.select("cut", "fqn", "pattern", "hops", F.size("patterns").cast("long").alias("n"))


_MESSAGE = "CASE event_type WHEN 'click' THEN 'cannot find symbol X' WHEN 'view' THEN 'x has private access in Y' WHEN 'purchase' THEN 'unreported exception Z' WHEN 'error' THEN 'incompatible types: A' ELSE 'missing ;' END"


@query(f"""WITH m AS (SELECT user_id, {_MESSAGE} AS m FROM events) SELECT user_id, CASE WHEN starts_with(m, 'cannot find symbol') THEN 'missing symbol' WHEN contains(m, 'private access') THEN 'access violation' WHEN starts_with(m, 'unreported exception') THEN 'uncaught checked exception'
WHEN starts_with(m, 'incompatible types') THEN 'wrong signature/type' ELSE 'other' END AS kind, count(*) AS count FROM m GROUP BY 1, 2""")
def q_error_kind(spark, sf):
    """Compiler errors by kind."""
    rows = table(spark, sf, "events").selectExpr("user_id", f"{_MESSAGE} AS m")
    return stats.error_tally(rows, F.array("m"), text.error_kind, "user_id")


@query("""SELECT conv_id, turn, len(regexp_extract_all(text, '(?m)^\\s*[A-Z]')) AS n_starts, len(string_split(text, chr(10))) AS n_lines, len(text) - len(replace(text, '.', '')) AS n_stops, ends_with(rtrim(text), '.') AS ended,
len(regexp_extract_all(text, '[a-z]+')) AS n_runs FROM conversations""")
def q_text_counts(spark, sf):
    """Counts of patterns, lines and signs, and endings."""
    t = F.col("text")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.regexp_count(t, F.lit(r"(?m)^\s*[A-Z]")).cast("long").alias("n_starts"), F.size(F.split(t, "\n", -1)).cast("long").alias("n_lines"), text.count_of(t, ".").cast("long").alias("n_stops"), text.rstrip(t).endswith(".").alias("ended"), F.regexp_count(t, F.lit("[a-z]+")).cast("long").alias("n_runs"))


@query("""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a href="([^"]*)"')) AS n_links, regexp_extract(html, '<html lang="([a-z]*)"', 1) AS lang,
array_to_string(list_sort(list_distinct(regexp_extract_all(html, '<a href="([^"]*)"', 1))), ' ') AS links FROM pages""")
def q_html_fields(spark, sf):
    """Fields and links of marked-up text."""
    h = F.col("html")
    links = F.regexp_extract_all(h, F.lit('<a href="([^"]*)"'), F.lit(1))
    return table(spark, sf, "pages", "page_id", "html").select("page_id", F.regexp_extract(h, "<title>([^<]*)</title>", 1).alias("title"), F.size(links).cast("long").alias("n_links"), F.regexp_extract(h, '<html lang="([a-z]*)"', 1).alias("lang"), F.array_join(F.array_sort(F.array_distinct(links)), " ").alias("links"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN (l_returnflag = 'A' OR l_linestatus = 'F') AND l_linenumber >= 4 THEN 'faulty_test_cleanup_node' WHEN l_returnflag = 'A' OR l_linestatus = 'F' THEN 'test_repair_node'
WHEN l_quantity * 2 >= 100 OR l_linenumber >= 5 THEN 'class_advancer_node' WHEN l_linenumber = 0 OR l_discount > 0.04 THEN 'mutation_test_writer_node' ELSE 'class_advancer_node' END AS next FROM lineitem""")
def q_router(spark, sf):
    """The step that follows each measured suite."""
    step = scoring.next_step(F.col("l_returnflag") != "A", F.col("l_linestatus") != "F", F.col("l_linenumber"), F.col("l_quantity") * 2, F.col("l_linenumber"), F.col("l_discount") > 0.04, max_repairs=4, max_rounds=5)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", step.alias("next"))


@query("""WITH o AS (SELECT o_orderkey AS k, o_custkey % 8 AS n, 30 * (o_custkey % 3) AS m FROM orders), r AS (SELECT k, n, m, CAST(least(2, ceil(greatest(n - 1, 0) / 2.0)) AS BIGINT) AS repairs, n > 5 AS cleaned, CAST(ceil((100 - m) / 40.0) AS BIGINT) AS rounds FROM o)
SELECT k, repairs, cleaned, rounds, m + 40 * rounds AS mutation, repairs + CASE WHEN cleaned THEN 1 ELSE 0 END + rounds + 1 AS steps FROM r""")
def q_graph_of_steps(spark, sf):
    """Runs through the graph of repair, clean-up, mutation tests and the next class, until each has ended."""
    o = sql_table(spark, sf, "SELECT o_orderkey AS k, o_custkey % 8 AS n, 30 * (o_custkey % 3) AS mutation, 0 AS repairs, 0 AS rounds, false AS cleaned, 0 AS index FROM orders")
    step = scoring.next_step(F.col("n") <= 1, F.lit(True), F.col("repairs"), F.col("mutation"), F.col("rounds"), F.lit(True), max_repairs=2, max_rounds=3)
    route = F.when(F.col("index") > 0, scoring.after_class(F.col("index"), F.lit(1))).otherwise(step)
    done = routing.run_graph(o, route, {
        "test_repair_node": lambda d: d.withColumns({"n": F.col("n") - 2, "repairs": F.col("repairs") + 1}),
        "faulty_test_cleanup_node": lambda d: d.withColumns({"n": F.lit(0).cast("long"), "cleaned": F.lit(True)}),
        "mutation_test_writer_node": lambda d: d.withColumns({"mutation": F.col("mutation") + 40, "rounds": F.col("rounds") + 1}),
        "class_advancer_node": lambda d: d.withColumn("index", F.col("index") + 1),
    })
    return done.select("k", F.col("repairs").cast("long"), "cleaned", F.col("rounds").cast("long"), "mutation", F.col("steps").cast("long"))


@query("SELECT 'p' || l_suppkey % 10 AS project, l_orderkey AS class_key, l_linenumber AS n, l_partkey, row_number() OVER (ORDER BY 'p' || l_suppkey % 10, l_orderkey, l_linenumber, l_partkey) - 1 AS place FROM lineitem")
def q_report_order(spark, sf):
    """Rows of a report in the order of project and class, whoever ended first."""
    rows = sql_table(spark, sf, "SELECT 'p' || l_suppkey % 10 AS project, l_orderkey AS class_key, l_linenumber AS n, l_partkey FROM lineitem")
    return routing.in_report_order(rows, ["project", "class_key", "n", "l_partkey"])


@query("""SELECT u.conv_id % 10 AS part, count(*) FILTER (n <= 120) AS n_kept, count(*) FILTER (n > 120) AS n_dropped FROM (SELECT u.conv_id, len(string_split(u.text, ' ')) + len(string_split(a.text, ' ')) AS n FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant') u GROUP BY 1""")
def q_dataset_counts(spark, sf):
    """How many training pairs fit the cutoff and how many are dropped."""
    c = table(spark, sf, "conversations").withColumn("n", F.size(F.split("text", " ", -1)))
    prompts = c.where("role = 'user'").select("conv_id", "turn", F.col("n").alias("prompt_tokens"))
    targets = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("n").alias("output_tokens"), (F.col("conv_id") % 10).alias("part"))
    return routing.dataset_counts(targets, prompts, ["conv_id", "turn"], 120, ["part"])


@query("SELECT l_orderkey AS run, l_linenumber AS at, l_partkey AS class, CASE WHEN l_linenumber >= count(*) OVER (PARTITION BY l_orderkey) THEN 'end' ELSE 'initial_test_write_node' END AS next FROM lineitem")
def q_end_of_run(spark, sf):
    """What follows each class of a run that is done: the next class, or the end after the last."""
    li = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey")
    n = li.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return li.join(n, "l_orderkey").select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("at"), F.col("l_partkey").alias("class"), scoring.after_class(F.col("l_linenumber"), F.col("n")).alias("next"))


@query("""SELECT u.conv_id, u.turn, u.text AS instruction, '```java' || chr(10) || rtrim(a.text) || chr(10) || '```' AS output, len(string_split(u.text, ' ')) + len(string_split(a.text, ' ')) AS tokens
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant' AND len(string_split(u.text, ' ')) + len(string_split(a.text, ' ')) <= 120""")
def q_dataset_rows(spark, sf):
    """Training pairs that fit the cutoff, answers fenced."""
    c = table(spark, sf, "conversations").withColumn("n", F.size(F.split("text", " ", -1)))
    prompts = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("instruction"), F.col("n").alias("prompt_tokens"))
    targets = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), text.fenced(F.col("text")).alias("output"), F.col("n").alias("output_tokens"))
    return routing.dataset(targets, prompts, ["conv_id", "turn"], 120).select("conv_id", "turn", "instruction", "output", F.col("tokens").cast("long"))


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def q_props_json(spark, sf):
    """Nested JSON fields."""
    return table(spark, sf, "events", "event_type", "props").select("event_type", F.from_json("props", "k long")["k"].alias("k")).groupBy("event_type", "k").agg(F.count("*").alias("n"))


@query("""WITH w AS (SELECT o_custkey, o_orderstatus, avg(o_totalprice) AS p FROM orders GROUP BY 1, 2), p AS (SELECT o_custkey, max(p) FILTER (o_orderstatus = 'O') AS a, max(p) FILTER (o_orderstatus = 'F') AS b FROM w GROUP BY 1)
SELECT CASE WHEN a - b > 0.5 THEN 'a' WHEN b - a > 0.5 THEN 'b' ELSE 'tie' END AS winner, count(*) AS count FROM p WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1""")
def q_paired_arms(spark, sf):
    """Two arms of an experiment, paired by class: wins and ties."""
    pairs = audit.paired(table(spark, sf, "orders", "o_custkey", "o_orderstatus", "o_totalprice"), "o_custkey", "o_orderstatus", ["O", "F"], F.avg("o_totalprice"))
    return stats.wins(pairs, "O", "F")


@query("""WITH r AS (SELECT user_id AS run_id, event_id AS seq, event_type <> 'error' AS ok, event_type = 'purchase' AS green, value AS mutation FROM events), b AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY CASE WHEN green THEN 0 ELSE 1 END, CASE WHEN mutation = 0 THEN -1 ELSE mutation END DESC, seq) AS r FROM r)
SELECT r.run_id, count(*) AS compiles, count(*) FILTER (NOT ok) AS compile_failures, count(*) FILTER (ok AND NOT green) AS red_rounds, bool_or(green) AS ended_green, (SELECT mutation FROM b WHERE b.run_id = r.run_id AND b.r = 1 AND green) AS best_mutation,
arg_min(ok, seq) AS first_compile_ok, arg_min(green, seq) AS first_compile_green FROM r GROUP BY 1""")
def q_run_summary(spark, sf):
    """A run's compiles, failures, red rounds, best green score and first compile."""
    rows = table(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("compiler_success"), (F.col("event_type") == "purchase").alias("suite_green"), F.col("value").alias("mutation"))
    return stats.run_summary(rows)


@query("""WITH n AS (SELECT l_suppkey AS suite, min(l_partkey) AS lo, max(l_partkey) AS hi FROM lineitem GROUP BY 1) SELECT suite, CASE WHEN lo >= 100 THEN hi - lo END AS width FROM n""")
def q_all_or_nothing(spark, sf):
    """A range of names, or none if one isn't known."""
    wanted = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("suite"), F.col("l_partkey").alias("name"))
    spans = wanted.distinct().where("name >= 100").select("suite", "name", F.col("name").alias("start"), F.col("name").alias("end"))
    out = attribution.by_name_or_none(wanted, spans)
    return out.select("suite", (F.col("ranges")[0]["start"] - F.element_at("ranges", -1)["start"]).alias("width"))


@query("""SELECT user_id, event_id, CAST(sum(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent_total FROM events""")
def q_running_totals(spark, sf):
    """What a run has spent so far."""
    rows = table(spark, sf, "events", "user_id", "event_id", "ts", "value").withColumn("spent", F.floor("value"))
    return logs.running_totals(rows, ["user_id"], ["ts", "event_id"], "spent").select("user_id", "event_id", F.col("spent_total").cast("long"))


@query("""WITH c AS (SELECT role, turn % 3 AS g, len(text) AS n, len(string_split(text, ' ')) AS w FROM conversations)
SELECT g, count(*) AS n_calls, CAST(sum(n) AS BIGINT) AS tokens_in, CAST(sum(w) AS BIGINT) AS tokens_out, round(CAST(sum(CASE WHEN role = 'user' THEN n ELSE 0 END) AS DOUBLE) / greatest(sum(n), 1), 6) AS thinking_share,
round(CAST(sum(w) AS DOUBLE) / greatest(sum(n) * 1000000 / 1e9, 1.0), 6) AS tokens_a_second, count(*) FILTER (role = 'system') AS n_retries, count(*) FILTER (role = 'user') AS n_empty FROM c GROUP BY 1""")
def q_call_figures(spark, sf):
    """Figures of model calls by group."""
    n, user = F.length("text"), F.col("role") == "user"
    calls = table(spark, sf, "conversations").select(
        (F.col("turn") % 3).alias("g"), n.alias("input_tokens"), F.size(F.split("text", " ", -1)).alias("output_tokens"), F.when(user, n).otherwise(0).alias("thinking_chars"), F.when(user, 0).otherwise(n).alias("answer_chars"),
        (n.cast("long") * 1000000).alias("eval_duration"), F.when(F.col("role") == "system", "a:no_thinking_retry").otherwise("a").alias("node_name"), F.lit(0).alias("n_tool_calls"),
    )
    return logs.call_figures(calls, ["g"])


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS path, CAST(line AS INT) AS line, CAST(coalesce(sum(strlen(s) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM l""")
def q_line_index(spark, sf):
    """The byte at which each line begins."""
    files = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    return logs.line_starts(files).select("path", "line", F.col("start").cast("long"))


@query("""WITH t AS (SELECT CAST(l_orderkey AS VARCHAR) AS class_key, CASE l_returnflag WHEN 'N' THEN 'self' WHEN 'A' THEN 'harness' ELSE 'model_best' END AS kind, l_linenumber AS n_tests FROM lineitem), s AS (SELECT count(*) AS classes, count(*) FILTER (EXISTS (SELECT 1 FROM t WHERE t.class_key = CAST(o_orderkey AS VARCHAR) AND kind = 'self')) AS self_served FROM orders)
SELECT classes, self_served, classes - self_served AS fall_through, round(100.0 * (classes - self_served) / classes, 6) AS harness_usage_pct, (SELECT count(*) FROM t) AS targets, (SELECT count(*) FROM t WHERE kind = 'harness') AS rescued, (SELECT median(CAST(n_tests AS DOUBLE)) FROM t) AS median_target_tests FROM s""")
def q_round_summary(spark, sf):
    """The summary of a round."""
    targets = table(spark, sf, "lineitem").selectExpr("cast(l_orderkey AS string) AS class_key", "CASE l_returnflag WHEN 'N' THEN 'self' WHEN 'A' THEN 'harness' ELSE 'model_best' END AS kind", "l_linenumber AS n_tests")
    return logs.round_summary(table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("class_key")), targets)


@query("""WITH c AS (SELECT source AS cut, lang AS pattern, n_chars AS chars, doc_id % 3 = 0 AS needed FROM documents), e AS (SELECT cut, pattern, count(*) AS n, count(*) FILTER (needed) AS n_needed, sum(chars) AS chars FROM c GROUP BY 1, 2),
g AS (SELECT * FROM (SELECT DISTINCT source AS cut FROM documents), (SELECT unnest(['en', 'fr', 'de', 'xx']) AS pattern))
SELECT pattern, CAST(sum(coalesce(n, 0)) AS BIGINT) AS n, CAST(sum(coalesce(n_needed, 0)) AS BIGINT) AS n_needed, CAST(sum(coalesce(chars, 0)) AS BIGINT) AS chars, median(CAST(coalesce(chars, 0) AS DOUBLE)) AS median_chars FROM g LEFT JOIN e USING (cut, pattern) GROUP BY 1""")
def q_pattern_stats(spark, sf):
    """Figures of retrieval patterns, with zeros for classes they don't reach."""
    d = table(spark, sf, "documents", "doc_id", "source", "lang", "n_chars")
    candidates = d.select(F.col("source").alias("cut"), F.col("lang").alias("pattern"), F.col("n_chars").alias("chars"), (F.col("doc_id") % 3 == 0).alias("needed"))
    return audit.pattern_stats(candidates, candidates.select("cut").distinct(), ["en", "fr", "de", "xx"])


from . import audits, classes, reports as report_plans, sources, stores, suites, texts  # noqa: E402, F401  # they register their queries
