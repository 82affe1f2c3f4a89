"""Queries over audits, logs and routed rows, and their SQL.

A source (table documents) stands for a class under test, its documents for files retrieved for it; an
order line for a rollout, a user's events for a run.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring, text
from ..operators import attribution, audit, logs, routing, stats
from .registry import query, sql_table, table

# what a document is to its source, told from its id
_FILES = "SELECT doc_id, source AS cut, n_chars AS chars, lang AS reason, doc_id % 11 = 0 AS is_self, doc_id % 5 = 0 AS needed, doc_id % 7 = 0 AS internal, doc_id % 13 AS m FROM documents"
_CODE = "CASE WHEN m < 3 THEN 'nothing' WHEN m < 6 THEN 'x = Name;' WHEN m < 9 THEN '// Name here' ELSE 'Names y;' END"
_KIND = f"CASE WHEN is_self THEN 'unref: the class under test itself' WHEN needed THEN 'needed' WHEN internal THEN 'internal' WHEN m < 3 THEN 'unref: not named by the CUT (implementer, producer, 2nd hop)' WHEN m < 6 THEN 'unref: same name, different type' WHEN m < 9 THEN 'unref: comment or string only' ELSE 'unref: substring of a longer name' END"


def _files(spark, sf):
    rows = sql_table(spark, sf, _FILES).withColumn("code", F.expr(_CODE))
    kind = audit.retrieval_class(F.col("is_self"), F.col("needed"), F.col("internal"), F.lit("Name"), F.col("code"), text.identifiers(F.col("code")))
    return rows.withColumn("class", kind)


_F = f"WITH f AS (SELECT *, {_KIND} AS class FROM ({_FILES}))"


@query(f"{_F} SELECT doc_id, cut, class FROM f")
def q_retrieval_class(spark, sf):
    """What each retrieved file is to its class."""
    return _files(spark, sf).select("doc_id", "cut", "class")


@query(f"{_F} SELECT reason, count(*) AS n, count(*) FILTER (class = 'needed') AS n_needed, CAST(sum(chars) AS BIGINT) AS chars, CAST(coalesce(sum(chars) FILTER (class = 'needed'), 0) AS BIGINT) AS useful_chars FROM f GROUP BY 1")
def q_hit_rates(spark, sf):
    """Files, needed ones and characters by reason of retrieval."""
    return audit.hit_rates(_files(spark, sf))


@query(f"{_F} SELECT class, count(*) AS count, min(doc_id) AS first_seq FROM f GROUP BY 1 ORDER BY 2 DESC, 3 LIMIT 4")
def q_most_common(spark, sf):
    """The most frequent kinds, of equals the one seen first."""
    return audit.most_common(_files(spark, sf), "class", "doc_id", 4)


@query(f"{_F} SELECT cut, CAST(coalesce(sum(chars) FILTER (class LIKE 'unref%'), 0) AS BIGINT) AS chars, count(*) FILTER (class LIKE 'unref%') AS n_files FROM f GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
def q_noisiest(spark, sf):
    """The classes with most characters of unreferenced files."""
    return audit.noisiest(_files(spark, sf))


_CUTS = "SELECT source AS cut, sum(n_chars) AS cut_chars, min(doc_id) % 2 = 0 AS has_suites, count(*) AS n_api, count(*) FILTER (WHERE doc_id % 3 = 0) AS n_missing_api, count(*) FILTER (WHERE doc_id % 2 = 0) AS n_used, count(*) FILTER (WHERE doc_id % 10 = 0) AS n_missing_used, min(doc_id) % 3 AS n_gaps FROM documents GROUP BY source"


@query(f"""{_F}, c AS ({_CUTS}), p AS (SELECT cut, sum(chars) AS per_class, row_number() OVER (ORDER BY sum(chars)) - 1 AS i, count(*) OVER () AS n FROM f GROUP BY 1),
one AS (SELECT count(*) AS files, round(100.0 * count(*) FILTER (class = 'needed') / count(*), 1) AS needed_pct, round(100.0 * count(*) FILTER (class = 'internal') / count(*), 1) AS internal_pct, round(100.0 * count(*) FILTER (class LIKE 'unref%') / count(*), 1) AS unreferenced_pct, CAST(sum(chars) AS BIGINT) AS chars, round(100.0 * sum(chars) FILTER (class LIKE 'unref%') / sum(chars), 1) AS unreferenced_chars_pct FROM f),
two AS (SELECT round(100.0 * sum(n_api - n_missing_api) / sum(n_api), 1) AS api_recall_pct, round(100.0 * sum(n_used - n_missing_used) FILTER (has_suites) / sum(n_used) FILTER (has_suites), 1) AS used_recall_pct, count(*) FILTER (n_missing_api > 0 OR n_missing_used > 0) AS classes_with_a_miss, CAST(sum(n_gaps) AS BIGINT) AS called_members_cut, CAST(sum(n_used - n_missing_used) AS BIGINT) AS used_pairs, CAST(sum(cut_chars) AS BIGINT) AS cut_chars FROM c)
SELECT *, (SELECT CAST(max(per_class) FILTER (i = n // 2) AS BIGINT) FROM p) AS median_chars, (SELECT CAST(max(per_class) FILTER (i = floor(n * 0.9)) AS BIGINT) FROM p) AS p90_chars, (SELECT CAST(max(per_class) AS BIGINT) FROM p) AS max_chars, round(CAST(chars AS DOUBLE) / cut_chars, 2) AS context_ratio FROM one, two""")
def q_retrieval_summary(spark, sf):
    """Fourteen figures of an audit in one row."""
    return audit.retrieval_summary(_files(spark, sf), sql_table(spark, sf, _CUTS))


_ERR = "SELECT DISTINCT l_returnflag AS model, l_orderkey AS cut, l_partkey % 30 AS type FROM lineitem WHERE l_linestatus = 'F'"
_USED = "SELECT DISTINCT l_returnflag AS model, l_orderkey AS cut, l_suppkey % 30 AS type FROM lineitem WHERE l_linenumber > 2"
_PROMPT = "SELECT DISTINCT l_returnflag AS model, l_orderkey AS cut, l_partkey % 30 AS type FROM lineitem WHERE l_linenumber % 2 = 0"


@query(f"""WITH e AS ({_ERR}), u AS ({_USED}), p AS ({_PROMPT}), a AS (SELECT * FROM e UNION SELECT * FROM u), r AS (SELECT a.*, CASE WHEN a.type = a.cut THEN 'class under test' WHEN p.type IS NOT NULL THEN 'in prompt' ELSE 'NOT in prompt' END AS place, CASE WHEN e.type IS NULL THEN 0 ELSE 1 END AS x, CASE WHEN u.type IS NULL THEN 0 ELSE 1 END AS y
FROM a LEFT JOIN e USING (model, cut, type) LEFT JOIN u USING (model, cut, type) LEFT JOIN p USING (model, cut, type)) SELECT model, place, count(*) AS n, CAST(sum(x) AS BIGINT) AS n_error, CAST(sum(y) AS BIGINT) AS n_used, count(*) FILTER (x = 1 AND y = 0) AS n_never_fixed, round(avg(x), 6) AS error_rate FROM r GROUP BY 1, 2""")
def q_engagement(spark, sf):
    """Types that errors and uses are about, by model and by whether the prompt showed them."""
    every = lambda sql: sql_table(spark, sf, sql.replace("SELECT DISTINCT", "SELECT"))  # noqa: E731 - the operator counts equal rows once
    return audit.engagement(every(_ERR), every(_USED), every(_PROMPT), ["model", "cut"], by=("model",))


@query("""WITH a AS (SELECT o_custkey AS k, list(DISTINCT 'v' || o_orderkey % 7) AS s FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT o_custkey AS k, list(DISTINCT 'v' || o_orderkey % 5) AS s FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1),
j AS (SELECT k, list_sort(coalesce(a.s, [])) AS x, list_sort(coalesce(b.s, [])) AS y FROM a FULL JOIN b USING (k)) SELECT k, x = y AS equal, array_to_string(list_filter(x, lambda v: NOT list_contains(y, v)), ',') AS only_a, array_to_string(list_filter(y, lambda v: NOT list_contains(x, v)), ',') AS only_b FROM j""")
def q_agreement(spark, sf):
    """Whether two tables hold the same sets by key, and what either has alone."""
    a = sql_table(spark, sf, "SELECT o_custkey AS k, 'v' || (o_orderkey % 7) AS v FROM orders WHERE o_orderkey % 2 = 0")
    b = sql_table(spark, sf, "SELECT o_custkey AS k, 'v' || (o_orderkey % 5) AS v FROM orders WHERE o_orderkey % 3 = 0")
    return audit.agreement(a, b, "k", "v").select("k", "equal", F.array_join("only_a", ",").alias("only_a"), F.array_join("only_b", ",").alias("only_b"))


_BEFORE = "SELECT l_suppkey AS suite, 't' || (l_partkey % 40) AS name, 'b' || min(l_linenumber) AS body, min(l_partkey % 40) AS pos FROM lineitem WHERE l_returnflag <> 'A' AND l_linenumber < 3 GROUP BY l_suppkey, l_partkey % 40"
_AFTER = "SELECT l_suppkey AS suite, 't' || (l_partkey % 40) AS name, 'b' || min(l_linenumber) AS body, min(l_partkey % 40) AS pos FROM lineitem WHERE l_returnflag <> 'R' AND l_linenumber < 4 GROUP BY l_suppkey, l_partkey % 40"
_DIFF = f"""WITH b AS ({_BEFORE}), a AS ({_AFTER}), d AS (SELECT suite, name, a.pos, CASE WHEN b.body IS NULL THEN 'added' WHEN a.body IS NULL THEN 'removed' WHEN a.body = b.body THEN 'unchanged' ELSE 'modified' END AS kind FROM b FULL JOIN a USING (suite, name)),
k AS (SELECT suite, max(pos) FILTER (kind IN ('unchanged', 'modified')) AS last_kept FROM d GROUP BY 1), r AS (SELECT suite, name, kind, kind = 'added' AND coalesce(pos < last_kept, false) AS interleaved FROM d JOIN k USING (suite))"""


@query(f"{_DIFF} SELECT * FROM r")
def q_suite_difference(spark, sf):
    """Tests added, removed, modified and unchanged between two suites, and those placed between others."""
    return audit.suite_difference(sql_table(spark, sf, _BEFORE), sql_table(spark, sf, _AFTER), ["suite"])


@query(f"""{_DIFF}, s AS (SELECT suite, count(*) FILTER (kind = 'added') AS added, count(*) FILTER (kind = 'removed') AS removed, count(*) FILTER (kind = 'modified') AS modified, count(*) FILTER (kind = 'unchanged') AS unchanged, bool_or(interleaved) AS mixed FROM r GROUP BY 1)
SELECT count(*) AS n_suites, count(*) FILTER (added > 0 AND removed = 0 AND modified = 0) AS only_added, count(*) FILTER (mixed) AS n_interleaved, CAST(sum(added) AS BIGINT) AS added, CAST(sum(removed) AS BIGINT) AS removed, CAST(sum(modified) AS BIGINT) AS modified, CAST(sum(unchanged) AS BIGINT) AS unchanged FROM s""")
def q_difference_totals(spark, sf):
    """Totals over the differences of suites."""
    return audit.difference_totals(audit.suite_difference(sql_table(spark, sf, _BEFORE), sql_table(spark, sf, _AFTER), ["suite"]), ["suite"])


@query("""WITH c AS (SELECT l_partkey AS p, l_suppkey AS s, count(DISTINCT l_returnflag) AS n, min(l_returnflag) AS one, bool_or(l_linestatus = 'F') AS needed FROM lineitem GROUP BY 1, 2) SELECT one AS pattern, count(*) AS count FROM c WHERE needed AND n = 1 GROUP BY 1""")
def q_exclusive(spark, sf):
    """Needed candidates that one pattern alone reached."""
    c = table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("patterns"), F.bool_or(F.col("l_linestatus") == "F").alias("needed"))
    return audit.exclusive(c)


@query("""WITH r AS (SELECT user_id AS run_id, event_id AS seq, event_type = 'click' AS known, CAST(floor(value) AS BIGINT) + 1 AS chars, event_id % 9 AS tokens FROM events), f AS (SELECT run_id, arg_min(CAST(chars AS DOUBLE) / tokens, seq) AS c FROM r WHERE known AND tokens > 0 GROUP BY 1)
SELECT DISTINCT r.run_id, round(coalesce(f.c, 4.27), 6) AS chars_a_token FROM r LEFT JOIN f USING (run_id)""")
def q_chars_a_token(spark, sf):
    """Characters a token by run, of the first call that tells both."""
    calls = sql_table(spark, sf, "SELECT user_id AS run_id, event_id AS seq, CASE WHEN event_type = 'click' THEN CAST(floor(value) AS BIGINT) + 1 ELSE 0 END AS prompt_chars, event_id % 9 AS input_tokens FROM events")
    return logs.chars_a_token(calls).select("run_id", F.round("chars_a_token", 6).alias("chars_a_token"))


@query("SELECT count(*) AS rows, count(*) FILTER (o_totalprice > 100000) AS excluded, median(CAST(o_custkey AS DOUBLE)) FILTER (o_totalprice <= 100000) AS median_tokens FROM orders")
def q_prompt_summary(spark, sf):
    """Prompts, those over the limit, the median of the others' tokens."""
    return logs.prompt_summary(table(spark, sf, "orders").select((F.col("o_totalprice") > 100000).alias("excluded"), F.col("o_custkey").alias("prompt_tokens")))


@query("SELECT o_orderkey AS k, o_totalprice > 100000 AS excluded, substr(o_orderpriority, 1, 3) AS head, try_cast(CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE 'None' END AS DOUBLE) AS n, CASE WHEN o_orderstatus = 'O' THEN 'rollout' WHEN o_custkey % 2 = 0 THEN 'single' ELSE 'batch' END AS mode FROM orders")
def q_prompt_rows(spark, sf):
    """Prompts over the limit, cut texts, numbers out of texts, and the mode of a run."""
    o = table(spark, sf, "orders")
    raw = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey").cast("string")).otherwise("None")
    single = F.when(F.col("o_custkey") % 2 == 0, F.lit("C"))
    return o.select(F.col("o_orderkey").alias("k"), routing.over_limit(F.col("o_totalprice"), 100000).alias("excluded"), F.substring("o_orderpriority", 1, 3).alias("head"), scoring.number_or_null(raw).alias("n"), routing.mode(F.when(F.col("o_orderstatus") == "O", F.lit("f")), single).alias("mode"))


@query("""WITH r AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_quantity AS q, CAST(l_quantity AS INT) % 10 AS tests, CAST(l_discount * 100 AS INT) % 4 AS broken FROM lineitem), f AS (SELECT *, CASE WHEN tests = 0 THEN 0.0 ELSE round(CAST(tests - broken AS DOUBLE) / tests, 3) END AS kept FROM r)
SELECT k, n, p, q, kept, CASE WHEN n < 5 AND kept < 0.35 THEN 'kept only ' || CAST(CAST(round_even(kept * 100, 0) AS INT) AS VARCHAR) || '% of its tests' WHEN n < 5 THEN 'VERIFIED' WHEN n = 5 THEN 'compiles but covers 0% of the class' WHEN n = 6 THEN 'skeleton fault' ELSE 'nothing salvageable' END AS why, 'kept=' || CAST(kept AS VARCHAR) || ' n=' || CASE WHEN n = 7 THEN '--' ELSE CAST(n AS VARCHAR) END AS line FROM f""")
def q_selection_why(spark, sf):
    """The kept share of a suite's tests, why it was taken or not, and a line of figures."""
    n = F.col("l_linenumber")
    r = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), n.alias("n"), F.col("l_partkey").alias("p"), F.col("l_quantity").alias("q"), scoring.kept_fraction(F.col("l_quantity").cast("int") % 10, (F.col("l_discount") * 100).cast("int") % 4).alias("kept"))
    why = scoring.selection_why(F.col("n") < 5, F.col("kept"), 0.35, F.col("n") == 5, F.when(F.col("n") == 6, 1).otherwise(0))
    shown = r.withColumn("why", why).withColumn("m", F.when(F.col("n") != 7, F.col("n")))
    return shown.select("k", "n", "p", "q", "kept", "why", F.replace(scoring.result_line("kept", "m"), F.lit(" m="), F.lit(" n=")).alias("line"))


@query("""SELECT c_custkey AS k, arm, CAST((j - c_custkey % 3 + 3) % 3 AS INT) AS turn FROM customer, (VALUES (0, 'v1'), (1, 'v4'), (2, 'v6')) a(j, arm)""")
def q_rotation(spark, sf):
    """The arms of an experiment in an order turned by class."""
    return routing.rotation(table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 3).alias("idx")), ["v1", "v4", "v6"]).select("k", "arm", F.col("turn").cast("int"))


@query("SELECT user_id, event_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS repairs, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS rounds FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def q_counters(spark, sf):
    """Attempts and rounds so far."""
    e = table(spark, sf, "events", "user_id", "event_id", "ts", "event_type")
    one = lambda kind: F.when(F.col("event_type") == kind, 1).otherwise(0)
    rows = logs.running_totals(e.withColumn("repairs", one("error")).withColumn("rounds", one("purchase")), ["user_id"], ["ts", "event_id"], "repairs", "rounds")
    return rows.select("user_id", "event_id", F.col("repairs_total").alias("repairs"), F.col("rounds_total").alias("rounds"))


@query("SELECT o_orderpriority AS project, o_orderkey AS k, o_totalprice AS price FROM orders WHERE CAST(substr(o_orderpriority, 1, 1) AS INT) <= 3")
def q_rounds_upto(spark, sf):
    """All rounds up to one."""
    o = table(spark, sf, "orders").select(F.substring("o_orderpriority", 1, 1).cast("int").alias("round"), F.col("o_orderpriority").alias("project"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"))
    return routing.upto_round(o, 3).select("project", "k", "price")


@query("""WITH e AS (SELECT user_id, CASE event_type WHEN 'click' THEN 'missing symbol' WHEN 'view' THEN 'access violation' ELSE 'other' END AS kind FROM events), c AS (SELECT user_id, kind, count(*) AS n FROM e GROUP BY 1, 2), d AS (SELECT user_id, count(*) AS calls, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS tokens, count(*) FILTER (event_id % 7 = 0) AS retries FROM events GROUP BY 1)
SELECT d.user_id AS run_id, calls, tokens AS tokens_in, retries, (SELECT string_agg(kind || '=' || n, ',' ORDER BY kind) FROM c WHERE c.user_id = d.user_id) AS errors FROM d""")
def q_run_figures(spark, sf):
    """Calls, tokens, retries and errors by kind of each run."""
    e = table(spark, sf, "events", "user_id", "event_id", "event_type", "value")
    kind = F.when(F.col("event_type") == "click", "missing symbol").when(F.col("event_type") == "view", "access violation").otherwise("other")
    calls = e.select(F.col("user_id").alias("run_id"), F.when(F.col("event_id") % 7 == 0, "x:no_thinking_retry").otherwise("x").alias("node_name"), F.floor("value").alias("input_tokens"), F.lit(0).alias("output_tokens"))
    rows = stats.run_figures(calls, e.select(F.col("user_id").alias("run_id"), kind.alias("kind")))
    entries = F.array_sort(F.transform(F.map_entries("errors"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))))
    return rows.select("run_id", "calls", "tokens_in", "retries", F.array_join(entries, ",").alias("errors"))


@query("""WITH w AS (SELECT o_custkey AS k, o_orderstatus AS arm, max(o_totalprice) AS m, count(*) AS n FROM orders WHERE o_orderstatus IN ('O', 'F') GROUP BY 1, 2), p AS (SELECT k FROM w GROUP BY 1 HAVING count(*) = 2)
SELECT arm, count(*) AS pairs, CAST(sum(n) AS BIGINT) AS compiles, round(avg(CASE WHEN m > 50000 THEN m END), 6) AS mean_best FROM w WHERE k IN (SELECT k FROM p) GROUP BY 1""")
def q_paired_totals(spark, sf):
    """Totals of both arms over the classes that have both."""
    w = table(spark, sf, "orders").where("o_orderstatus IN ('O', 'F')").groupBy(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("arm")).agg(F.max("o_totalprice").alias("m"), F.count("*").alias("n"))
    rows = audit.complete_pairs(w, "k", "arm", ["O", "F"])
    return rows.groupBy("arm").agg(F.count("*").alias("pairs"), F.sum("n").alias("compiles"), F.round(F.avg(F.when(F.col("m") > 50000, F.col("m"))), 6).alias("mean_best"))


@query("""WITH m AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderkey % 4 AS n, o_custkey % 2 = 0 AS ctor, o_orderkey % 5 <> 0 AS open FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY c, ctor ORDER BY n, k) AS place FROM m WHERE open)
SELECT 'C' || c AS class, string_agg(CASE WHEN ctor THEN 'new C' || c ELSE 'C' || c || '.m' || k END || '(' || CASE n WHEN 0 THEN '' WHEN 1 THEN 'Map' WHEN 2 THEN 'Map, Map' ELSE 'Map, Map, Map' END || ')', '; ' ORDER BY place) AS recipes FROM r WHERE place <= 3 GROUP BY 1, c""")
def q_recipes(spark, sf):
    """How to build a type: its accessible constructors and factories, fewest parameters first."""
    o = table(spark, sf, "orders").select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("class"), F.when(F.col("o_custkey") % 2 == 0, "ctor").otherwise("method").alias("kind"), F.concat(F.lit("m"), F.col("o_orderkey").cast("string")).alias("name"), F.array_repeat(F.lit("java.util.Map<K, V>"), (F.col("o_orderkey") % 4).cast("int")).alias("params"), (F.col("o_orderkey") % 5 != 0).alias("accessible"), F.col("o_orderkey").alias("seq"))
    return audit.recipes(o).select("class", F.array_join("recipes", "; ").alias("recipes"))


@query("SELECT l_orderkey AS suite, CASE WHEN l_orderkey % 2 = 0 THEN CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE 'n' || count(*) END ELSE 'l' || max(l_linenumber) END AS ranges FROM lineitem GROUP BY 1")
def q_trim_plan(spark, sf):
    """What to drop from a red suite: by names where it compiled, else by lines."""
    g = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("suite")).agg(F.count("*").alias("n"), F.max("l_linenumber").alias("m"))
    by_name = g.select("suite", F.when(F.col("suite") % 3 != 0, F.concat(F.lit("n"), F.col("n").cast("string"))).alias("ranges"))
    return logs.trim_plan(by_name, g.select("suite", F.concat(F.lit("l"), F.col("m").cast("string")).alias("ranges")), g.select("suite", (F.col("suite") % 2 == 0).alias("compiled")))


@query("""WITH e AS (SELECT user_id, event_id, ts, event_type = 'error' AS trimmed, CASE WHEN event_type <> 'view' THEN round(value, 2) END AS v FROM events), p AS (SELECT *, sum(CASE WHEN trimmed THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS part FROM e),
h AS (SELECT *, last_value(v IGNORE NULLS) OVER w AS held FROM p WINDOW w AS (PARTITION BY user_id, part ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) SELECT user_id, event_id, CASE WHEN trimmed THEN NULL ELSE round(held - lag(held) OVER (PARTITION BY user_id, part ORDER BY ts, event_id), 6) END AS delta FROM h""")
def q_trimmed_scores(spark, sf):
    """Deltas that begin anew with each suite trimmed to green."""
    e = table(spark, sf, "events", "user_id", "event_id", "ts", "event_type", "value").select("user_id", "event_id", F.struct("ts", "event_id").alias("seq"), (F.col("event_type") == "error").alias("trimmed"), F.when(F.col("event_type") != "view", F.round("value", 2)).alias("v"))
    return routing.trimmed_deltas(e, "user_id", "seq", "v", "trimmed", 1.0).select("user_id", "event_id", "delta")


@query("""WITH g AS (SELECT l_returnflag || l_linestatus AS pattern, count(*) AS n, count(*) FILTER (l_discount > 0.05) AS hit FROM lineitem GROUP BY 1), o AS (SELECT pattern, row_number() OVER (ORDER BY round(CAST(hit AS DOUBLE) / n, 6) DESC, pattern) AS place FROM g),
c AS (SELECT l_suppkey AS cut, l_returnflag || l_linestatus AS pattern, CAST(sum(l_quantity) AS BIGINT) AS size FROM lineitem GROUP BY 1, 2), s AS (SELECT p.place, c.cut, sum(c.size) AS size FROM o p JOIN o q ON q.place <= p.place JOIN c ON c.pattern = q.pattern GROUP BY 1, 2)
SELECT CAST(p.place AS INT) AS place, median(CAST(coalesce(s.size, 0) AS DOUBLE)) AS median_size FROM o p CROSS JOIN (SELECT DISTINCT l_suppkey AS cut FROM lineitem) k LEFT JOIN s ON s.place = p.place AND s.cut = k.cut GROUP BY 1""")
def q_prefix_medians(spark, sf):
    """The median size per class of each prefix of patterns, best first."""
    li = table(spark, sf, "lineitem").withColumn("pattern", F.concat("l_returnflag", "l_linestatus"))
    curve = stats.cumulative(li.withColumn("wanted", F.col("l_discount") > 0.05), "pattern", "wanted", "l_quantity").select("pattern", "place")
    sizes = li.groupBy(F.col("l_suppkey").alias("cut"), "pattern").agg(F.sum("l_quantity").cast("long").alias("size"))
    return stats.prefix_medians(sizes, curve, "cut", "pattern", "size")


@query("""WITH c AS (SELECT conv_id, turn, role FROM conversations) SELECT conv_id, map_extract_value(map_from_entries(list((role, turn) ORDER BY turn)), 'x') IS NULL AS no_x, string_agg(DISTINCT role, ',' ORDER BY role) AS roles, (SELECT max(turn) FROM c d WHERE d.conv_id = c.conv_id AND role = 'user') AS last_user FROM (SELECT DISTINCT ON (conv_id, role) conv_id, role, turn FROM c ORDER BY conv_id, role, turn) c GROUP BY 1""")
def q_maps(spark, sf):
    """Maps updated in order, looked up with a default, their keys sorted."""
    c = table(spark, sf, "conversations", "conv_id", "turn", "role")
    m = routing.updated_map(c, "conv_id", "turn", "role", "turn")
    return m.select("conv_id", F.element_at("map", "x").isNull().alias("no_x"), F.array_join(F.array_sort(F.map_keys("map")), ",").alias("roles"), F.element_at("map", "user").alias("last_user"))


@query("SELECT user_id AS k, coalesce(v, 0.0) AS coverage_current, coalesce(n, 0) AS repair_attempts, coalesce(p, 'coverage') AS active_validation_phase FROM (SELECT user_id, CASE WHEN count(*) % 2 = 0 THEN max(value) END AS v, CASE WHEN count(*) % 3 = 0 THEN count(*) END AS n, CASE WHEN count(*) % 5 = 0 THEN 'mutation' END AS p FROM events GROUP BY 1)")
def q_metric_defaults(spark, sf):
    """Metric rows with what isn't told as at a class's start."""
    e = table(spark, sf, "events", "user_id", "value").groupBy(F.col("user_id").alias("k")).agg(F.count("*").alias("c"), F.max("value").alias("m"))
    rows = e.select("k", F.when(F.col("c") % 2 == 0, F.col("m")).alias("coverage_current"), F.when(F.col("c") % 3 == 0, F.col("c")).alias("repair_attempts"), F.when(F.col("c") % 5 == 0, F.lit("mutation")).alias("active_validation_phase"))
    return logs.with_start_values(rows).select("k", "coverage_current", F.col("repair_attempts").cast("long"), "active_validation_phase")


@query("""SELECT 'docs/' || doc_id || '.txt' AS path, string_split(text, chr(10))[1] AS first_line, len(string_split(text, chr(10))) AS n_lines, CAST(row_number() OVER (ORDER BY 'docs/' || doc_id || '.txt') - 1 AS INT) AS place, sha256(CASE WHEN text LIKE '%' || chr(10) THEN replace(substr(text, 1, length(text) - 1), chr(10), chr(10) || chr(10)) || chr(10) ELSE replace(text, chr(10), chr(10) || chr(10)) END) AS doubled FROM documents""")
def q_ordered_sources(spark, sf):
    """Sources in path order, with and without doubled line ends."""
    from ..sources import tables

    files = table(spark, sf, "documents", "doc_id", "text").select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").alias("content"))
    return tables.in_path_order(files).select("path", F.substring_index("content", "\n", 1).alias("first_line"), F.size(F.split("content", "\n", -1)).cast("long").alias("n_lines"), "place", F.sha2(tables.doubled(F.col("content")), 256).alias("doubled"))


@query("""WITH d AS (SELECT user_id, event_id, ts, value FROM events), x AS (SELECT user_id, min(ts) AS a, max(ts) AS b FROM d GROUP BY 1) SELECT user_id, epoch_us(a) // 1000 AS first_ms, round((epoch(b) - epoch(a)) / 60, 1) AS minutes FROM x""")
def q_elapsed(spark, sf):
    """Times as milliseconds and elapsed minutes."""
    x = table(spark, sf, "events", "user_id", "ts").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return x.select("user_id", logs.epoch_millis(F.col("a")).alias("first_ms"), logs.elapsed_minutes(F.col("a"), F.col("b")).alias("minutes"))


@query("SELECT conv_id, text AS prompt FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE role = 'user') WHERE r = 1")
def q_first_prompts(spark, sf):
    """The first initial prompt of each class."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", "initial_test_write_node").otherwise("other").alias("node_name"), F.col("text").alias("prompt"))
    return logs.first_prompts(c, "conv_id", "turn")


@query("""WITH r AS (SELECT c_custkey AS run_id, CASE WHEN c_custkey % 4 = 0 THEN 'failed' ELSE 'finished' END AS status, c_mktsegment AS arm FROM customer), s AS (SELECT o_custkey AS run_id, count(*) AS compiles, count(*) FILTER (o_orderstatus = 'F') AS compile_failures FROM orders GROUP BY 1)
SELECT run_id, arm, status = 'finished' AS ok, compiles, compile_failures, CAST(CASE WHEN compiles IS NOT NULL AND run_id % 2 = 0 THEN compiles * 3 END AS BIGINT) AS tokens_in FROM r LEFT JOIN s USING (run_id)""")
def q_run_report(spark, sf):
    """Results of runs with their logs and calls."""
    results = table(spark, sf, "customer").select(F.col("c_custkey").alias("run_id"), F.when(F.col("c_custkey") % 4 == 0, "failed").otherwise("finished").alias("status"), F.col("c_mktsegment").alias("arm"))
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("seq"), (F.col("o_orderstatus") != "F").alias("compiler_success"), F.lit(False).alias("suite_green"), F.lit(0.0).alias("mutation"))
    calls = rows.where("run_id % 2 = 0").select("run_id", F.lit("x").alias("node_name"), F.lit(3).alias("input_tokens"), F.lit(0).alias("output_tokens"))
    figures = stats.run_figures(calls, rows.select("run_id", F.lit("other").alias("kind")))
    return logs.run_report(results, stats.run_summary(rows), figures).select("run_id", "arm", "ok", "compiles", "compile_failures", "tokens_in")


@query("SELECT o_orderkey AS k, o_totalprice, c_mktsegment AS segment, CAST(least(60 + (o_custkey % 15) * 60, 600) AS INT) AS timeout FROM orders JOIN customer ON c_custkey = o_custkey")
def q_checked_join(spark, sf):
    """A join whose left rows must all have a partner, and how long a call may take at each try."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer", "c_custkey"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").withColumnRenamed("o_custkey", "key")
    rows = routing.checked_join(o, table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment")), ["key"])
    return rows.select(F.col("o_orderkey").alias("k"), "o_totalprice", "segment", routing.timeouts((F.col("key") % 15 + 1).cast("int")).alias("timeout"))


@query("SELECT min(doc_id) AS doc_id, max(n_chars) AS n_chars FROM documents WHERE source = (SELECT min(source) FROM documents)")
def q_single(spark, sf):
    """The rows of one path, which must be there."""
    d = table(spark, sf, "documents", "doc_id", "source", "n_chars")
    return routing.single(d, d.agg(F.min("source")).first()[0], "source").agg(F.min("doc_id").alias("doc_id"), F.max("n_chars").alias("n_chars"))


_MEMBERS = "SELECT 'a.b.C' || l_suppkey AS class, l_returnflag || ' m' || l_partkey || '(' || l_linenumber || ')' AS decl, l_partkey * 10 + l_linenumber AS seq, l_linestatus = 'O' AS kept FROM lineitem WHERE l_partkey % 20 < 7"


@query(f"""WITH m AS ({_MEMBERS}), k AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY seq, decl) AS place FROM m WHERE kept), b AS (SELECT class, string_agg('    ' || decl || ';' || chr(10), '' ORDER BY place) AS body FROM k WHERE place <= 5 GROUP BY 1), r AS (SELECT class, count(*) - least(count(*) FILTER (kept), 5) AS n_left FROM m GROUP BY 1)
SELECT 'a.b.C' || s_suppkey AS class, 'package a.b;' || chr(10) || CASE WHEN s_suppkey % 2 = 0 THEN 'interface' ELSE 'abstract class' END || ' C' || s_suppkey || ' {{' || chr(10) || coalesce(body, '') || CASE WHEN n_left > 0 THEN '    // ' || n_left || ' more' || chr(10) ELSE '' END || '}}' || chr(10) AS view FROM supplier LEFT JOIN b ON b.class = 'a.b.C' || s_suppkey LEFT JOIN r ON r.class = 'a.b.C' || s_suppkey""".replace("{{", "{").replace("}}", "}"))
def q_rendered(spark, sf):
    """Types as texts: their heads and the members kept of them."""
    classes = table(spark, sf, "supplier").select(F.concat(F.lit("a.b.C"), F.col("s_suppkey").cast("string")).alias("class"), F.lit("a.b").alias("package"), F.when(F.col("s_suppkey") % 2 == 0, "interface").otherwise("abstract").alias("kind"))
    return audit.rendered(sql_table(spark, sf, _MEMBERS), classes, 5)


@query("SELECT substr(sha256(string_agg('d/' || doc_id || '.txt' || text, '' ORDER BY 'd/' || doc_id || '.txt')), 1, 16) AS fingerprint FROM documents")
def q_fingerprint(spark, sf):
    """One digest of a tree of files."""
    from ..sources import tables

    return tables.fingerprint(table(spark, sf, "documents").select(F.concat(F.lit("r/d/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").alias("content")), "r")
