"""Queries that write tables to the shared folder and read them again, by batch and by stream, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring, text
from ..operators import logs, routing
from ..shared import shared_dir
from ..sources import config, merkle, reports, tables
from ..streaming import ingest, states
from .registry import _FRACTION, _GREEN, _USABLE, QUALITY_2_SQL, QUALITY_SQL, ROLLOUTS_SQL, query, rollouts, sql_table, table


@query("SELECT user_id, min(event_id) AS event_id, count(*) AS n FROM (SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2) GROUP BY 1")
def q_ingested(spark, sf):
    """Files of JSON lines ingested as a stream into a keyed table, each key once, its least row; a second run adds nothing."""
    source, path = shared_dir(spark, "ingest-in"), shared_dir(spark, "ingest-table")
    tables.write_jsonl(table(spark, sf, "events", "user_id", "event_type", "event_id"), source)
    for _ in range(2):
        ingest.ingest(spark, source, "user_id long, event_type string, event_id long", path, ["user_id", "event_type"], shared_dir(spark, "ingest-check") if _ else f"{path}-check").awaitTermination()
    return ingest.read_ingested(spark, path).groupBy("user_id").agg(F.min("event_id").alias("event_id"), F.count("*").alias("n"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def q_windowed_counts(spark, sf):
    """Counts by window of event time."""
    rows = ingest.windowed_counts(table(spark, sf, "events", "ts", "event_type").withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], width="1 hour")
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("SELECT o_orderpriority AS project, count(*) AS kept, (SELECT count(*) FROM orders) AS n_all, CAST(sum(o_custkey) AS BIGINT) AS tokens FROM orders WHERE o_totalprice <= 100000 GROUP BY 1")
def q_prompts_saved(spark, sf):
    """A prompt set written and read again, with and without excluded prompts; what is there already isn't written again."""
    path = shared_dir(spark, "prompts")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("class_key"), F.col("o_orderpriority").alias("project"), F.lit("p").alias("prompt"), F.col("o_custkey").cast("int").alias("prompt_tokens"), (F.col("o_totalprice") > 100000).alias("excluded"))
    tables.write_jsonl(o, path)
    tables.write_once(o.limit(1), path)
    everything = tables.read_prompts(spark, path, with_excluded=True).agg(F.count("*").alias("n_all"))
    kept = tables.read_prompts(spark, path).groupBy("project").agg(F.count("*").alias("kept"), F.sum("prompt_tokens").alias("tokens"))
    return kept.join(F.broadcast(everything)).select("project", "kept", "n_all", "tokens")  # one row


@query("SELECT u.conv_id, u.turn, u.text AS instruction, '' AS input, a.text AS output FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'".replace("u.conv_id, u.turn, ", ""))
def q_dataset_written(spark, sf):
    """Training pairs as they are written: three fields, and the manifest's name of each."""
    c = table(spark, sf, "conversations")
    pairs = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("instruction")).join(c.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("output")), ["conv_id", "turn"])
    path = shared_dir(spark, "dataset")
    tables.write_dataset(pairs, path, "round_1")
    return spark.read.schema("instruction string, input string, output string").json(f"{path}/round_1")


@query(f"""WITH {ROLLOUTS_SQL} SELECT class_key, l_linenumber AS rollout, l_partkey, l_suppkey, substr(repeat('x', CAST(l_partkey % 9 AS INTEGER)), 1, 5) AS compiler_output, {_USABLE} AS usable_for_training, {_GREEN} AS is_green, round({_FRACTION}, 6) AS compiled_fraction,
CASE WHEN {_USABLE} AND NOT compiled THEN 0.0 ELSE round({QUALITY_SQL}, 6) END AS quality_binary, round({QUALITY_SQL}, 6) AS quality_graded, round({QUALITY_2_SQL}, 6) AS quality_v2, CASE WHEN {_GREEN} THEN 'GREEN' WHEN compiled THEN 'compiled' ELSE status END AS flag FROM rollouts""")
def q_records(spark, sf):
    """Score records with their derived columns and the flag that is shown."""
    rows = rollouts(spark, sf).withColumn("compiler_output", F.repeat(F.lit("x"), (F.col("l_partkey") % 9).cast("int"))).withColumn("rollout", F.col("l_linenumber"))
    return scoring.record(rows, most=5).select("class_key", "rollout", "l_partkey", "l_suppkey", "compiler_output", "usable_for_training", "is_green", "compiled_fraction", "quality_binary", "quality_graded", "quality_v2", scoring.flag().alias("flag"))


@query("SELECT 'p' || (min(o_custkey) % 9) || '/C' || min(o_orderkey) AS class_key FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey > 9)")
def q_resolved_class(spark, sf):
    """The one listed class that a name stands for."""
    one = table(spark, sf, "orders").where("o_orderkey % 3 <> 0 AND o_orderkey > 9").agg(F.min("o_orderkey")).first()[0]
    files = sql_table(spark, sf, "SELECT '/w/src/main/java/p' || (o_custkey % 9) || '/C' || o_orderkey || '.java' AS path, 'public class C' || o_orderkey || ' ' AS content FROM orders")
    return logs.resolve_class(logs.class_listing(files), f"C{one}")


@query("""WITH u AS (SELECT l_orderkey AS k, list(DISTINCT 'n' || l_partkey % 20) AS x FROM lineitem GROUP BY 1), s AS (SELECT l_orderkey AS k, list(DISTINCT 'n' || l_suppkey % 20) AS y FROM lineitem GROUP BY 1) SELECT k, array_to_string(list_sort(list_filter(x, lambda v: NOT list_contains(y, v))), ',') AS missing FROM u JOIN s USING (k)""")
def q_missing_names(spark, sf):
    """Names that are used and weren't shown."""
    li = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set(F.concat(F.lit("n"), (F.col("l_partkey") % 20).cast("string"))).alias("x"), F.collect_set(F.concat(F.lit("n"), (F.col("l_suppkey") % 20).cast("string"))).alias("y"))
    return li.select("k", F.array_join(text.missing_names(F.col("x"), F.col("y")), ",").alias("missing"))


@query("""WITH e AS (SELECT user_id, event_id, ts, event_type = 'error' AS bad, event_type = 'purchase' AS done FROM events), p AS (SELECT *, coalesce(sum(CASE WHEN done THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS class_index FROM e)
SELECT user_id, event_id, CAST(class_index AS BIGINT) AS class_index, CAST(sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, class_index ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS attempts, max(CASE WHEN NOT bad THEN event_id END) OVER (PARTITION BY user_id, class_index ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_good FROM p""")
def q_class_states(spark, sf):
    """The state of each run's class after each step: its index, attempts so far and the last suite that was good."""
    e = table(spark, sf, "events", "user_id", "event_id", "ts", "event_type")
    return routing.class_states(e, "user_id", ["ts", "event_id"], F.col("event_type") == "error", F.col("event_type") == "purchase", "event_id").select("user_id", "event_id", F.col("class_index").cast("long"), F.col("attempts").cast("long"), F.col("last_good"))


#: Rows to a file of the stream, about.
_FILE_ROWS = 1_000_000


def _arriving(spark, sf, parts: int = 4, file_rows: int = _FILE_ROWS):
    """The events as files in the order in which they came, up to half an hour after their time: a batch reads one part of that time.

    Each part has the same number of files, by which batches are told. If a file had no rows it wouldn't be there, so then each part is one file.
    """
    e = table(spark, sf, "events", "user_id", "event_id", "ts", "event_type").withColumn("ts", F.col("ts").cast("timestamp"))
    came = e.withColumn("came", F.unix_seconds("ts") + F.col("event_id") % 1800)
    bounds = came.agg(F.min("came").alias("a"), F.max("came").alias("b"), F.count("*").alias("n")).first()
    part = F.least(F.floor((F.col("came") - bounds["a"]) * parts / (bounds["b"] - bounds["a"] + 1)), F.lit(parts - 1))
    for files in sorted({max(1, -(-bounds["n"] // (parts * file_rows))), 1}, reverse=True):
        path = shared_dir(spark, "events-in")
        for n in range(parts):
            came.where(part == n).drop("came").repartition(files).write.mode("append").parquet(path)
        if files == 1 or len(spark.read.schema(e.schema).parquet(path).inputFiles()) == parts * files:
            return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", files).parquet(path)


def _streamed(spark, stream, tag):
    """What a stream gives until all files there are have been read."""
    path, at = shared_dir(spark, tag), shared_dir(spark, f"{tag}-check")
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query("""WITH e AS (SELECT user_id, event_id, ts, event_type = 'error' AS bad, event_type = 'purchase' AS done FROM events WHERE ts < (SELECT max(ts) - INTERVAL 1 HOUR FROM events)), p AS (SELECT *, coalesce(sum(CASE WHEN done THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS class_index FROM e)
SELECT user_id, event_id, CAST(class_index AS BIGINT) AS class_index, CAST(sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, class_index ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS attempts, max(CASE WHEN NOT bad THEN event_id END) OVER (PARTITION BY user_id, class_index ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_good FROM p""")
def q_streamed_states(spark, sf):
    """q_class_states as a stream over files whose rows come out of order: what the watermark has passed."""
    rows = states.class_states(_arriving(spark, sf), "user_id", "ts", "event_id", F.col("event_type") == "error", F.col("event_type") == "purchase")
    return _streamed(spark, rows, "states").select(F.col("run").alias("user_id"), F.col("id").alias("event_id"), "class_index", "attempts", "last_good")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2")
def q_streamed_counts(spark, sf):
    """Counts by window of event time as a stream: the windows that the watermark has closed."""
    rows = ingest.windowed_counts(_arriving(spark, sf), "ts", ["event_type"], late="1 hour", width="1 hour")
    return _streamed(spark, rows, "counts").select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


_FILES = "SELECT 'd/' || doc_id % 7 || '/' || doc_id || '.txt' AS path, text AS content FROM documents"
_LATER = "SELECT 'd/' || doc_id % 7 || '/' || (CASE WHEN doc_id % 83 = 0 THEN 'new' ELSE '' END) || doc_id || '.txt' AS path, CASE WHEN doc_id % 50 = 0 THEN text || '.' ELSE text END AS content FROM documents WHERE doc_id % 77 <> 5"


@query(f"""WITH l AS (SELECT path, sha256(path) AS place, sha256(sha256(path) || sha256(coalesce(content, ''))) AS digest FROM ({_FILES})), n3 AS (SELECT substr(place, 1, 3) AS place, sha256(string_agg(digest, '' ORDER BY path)) AS digest FROM l GROUP BY 1),
n2 AS (SELECT substr(place, 1, 2) AS place, sha256(string_agg(digest, '' ORDER BY place)) AS digest FROM n3 GROUP BY 1), n1 AS (SELECT substr(place, 1, 1) AS place, sha256(string_agg(digest, '' ORDER BY place)) AS digest FROM n2 GROUP BY 1)
SELECT substr(sha256(string_agg(digest, '' ORDER BY place)), 1, 16) AS fingerprint, (SELECT count(*) FROM l) AS n FROM n1""")
def q_tree_digest(spark, sf):
    """A digest of a tree of files by a hash tree of three levels."""
    return merkle.tree_digest(merkle.nodes(merkle.leaves(sql_table(spark, sf, _FILES)), 3))


@query(f"WITH a AS ({_FILES}), b AS ({_LATER}) SELECT path, CASE WHEN a.content IS NULL THEN 'added' WHEN b.content IS NULL THEN 'removed' ELSE 'changed' END AS kind FROM (SELECT path, coalesce(content, '') AS content FROM a) a FULL JOIN (SELECT path, coalesce(content, '') AS content FROM b) b USING (path) WHERE a.content IS DISTINCT FROM b.content")
def q_tree_changes(spark, sf):
    """Files added, removed and changed between two trees, told from their hash trees."""
    a, b = (merkle.leaves(sql_table(spark, sf, x)) for x in (_FILES, _LATER))
    return merkle.changed(a, b, merkle.nodes(a, 3), merkle.nodes(b, 3))


_RECORDS = "SELECT 'q.C' || p_partkey AS class, 'p' || (p_size % 5) AS package, array('q.C' || (p_partkey % 10)) AS extends FROM part"


@query("SELECT 'q.C' || p_partkey AS class, 'p' || (p_size % 5) AS package, 'q.C' || (p_partkey % 10) AS up, 'proj' AS project, true AS stale_is_none, (SELECT count(*) FROM part) AS records FROM part")
def q_index_file(spark, sf):
    """An index of one file with its header: read again by its hash, and not where it was built from something else."""
    path = shared_dir(spark, "index-file")
    tables.write_index_file(sql_table(spark, sf, _RECORDS), path, "h1", "proj")
    header, stale = tables.index_header(spark, path), tables.read_index_file(spark, path, "class string", "h2") is None
    rows = tables.read_index_file(spark, path, "class string, package string, extends array<string>", "h1")
    return rows.select("class", "package", F.col("extends")[0].alias("up"), F.lit(header["project"]).alias("project"), F.lit(stale).alias("stale_is_none"), F.lit(header["records"]).alias("records"))


@query("SELECT 'q.C' || p_partkey AS class, 'p' || (p_size % 5) AS package, true AS stale_is_none FROM part")
def q_index_folder(spark, sf):
    """An index of many files with its header beside them."""
    path = shared_dir(spark, "index-folder")
    tables.write_index(sql_table(spark, sf, _RECORDS), path, "h1", "proj")
    stale = tables.read_index(spark, path, "class string", "h2") is None
    return tables.read_index(spark, path, "class string, package string", "h1").withColumn("stale_is_none", F.lit(stale))


@query("""WITH f AS (SELECT p_size % 8 AS n, string_agg('class C' || p_partkey || ' { }', chr(10) ORDER BY p_partkey) || chr(10) AS content FROM part GROUP BY 1) SELECT n, length(content) AS n_chars, sha256(content) AS digest FROM f WHERE n < 4""")
def q_source_files(spark, sf):
    """Implementation sources of a tree of files, as they are; tests and other folders left out."""
    root = shared_dir(spark, "tree")
    lines = sql_table(spark, sf, "SELECT p_size % 8 AS n, p_partkey, 'class C' || p_partkey || ' { }' AS value FROM part")
    for n in range(8):  # one file for each, four of them below a folder src of no tests
        lines.where(F.col("n") == n).coalesce(1).sortWithinPartitions("p_partkey").select("value").write.text(f"{root}/{'src/main/java' if n < 4 else 'src/test/java' if n < 6 else 'docs'}/n={n}")
    files = tables.read_sources(spark, root, "*.txt").where(text.is_implementation(F.replace(F.col("path"), F.lit(".txt"), F.lit(".java"))))
    return files.select(F.regexp_extract("path", r"n=(\d+)", 1).cast("long").alias("n"), F.length("content").cast("long").alias("n_chars"), F.sha2("content", 256).alias("digest"))


@query("SELECT o_custkey % 7 AS class_index, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS total, 0 AS before, 1 AS gone FROM orders WHERE o_custkey % 7 = (SELECT max(o_custkey % 7) FROM orders) GROUP BY 1")
def q_checkpoint_summary(spark, sf):
    """A checkpoint's start, the checkpoint and a summary written and read again, and old reports cleared."""
    at, said, old = (shared_dir(spark, x) for x in ("checkpoint", "summary", "old-reports"))
    begin = tables.read_checkpoint(spark, at)
    first = begin.first()["class_index"]
    o = table(spark, sf, "orders", "o_custkey", "o_orderkey")
    last = o.agg(F.max(F.col("o_custkey") % 7).cast("int").alias("class_index"))
    tables.write_checkpoint(last.join(begin.drop("class_index")), at)  # one row each
    tables.write_summary(o.join(last, F.col("o_custkey") % 7 == F.col("class_index")).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("total")), said)
    tables.write_summary(last, old)
    gone = tables.clear_reports(spark, [old, f"{old}-none"])
    summary = spark.read.schema("n long, total long").json(said)
    return tables.read_checkpoint(spark, at).join(summary).select(F.col("class_index").cast("long").alias("class_index"), "n", "total", F.lit(first).alias("before"), F.lit(gone).alias("gone"))


@query("WITH f AS (SELECT s_suppkey % 5 AS m, string_agg('<testcase name=\"t' || s_suppkey || '\" classname=\"C\"/>', '' ORDER BY s_suppkey) AS c, count(*) AS n FROM supplier GROUP BY 1) SELECT m, n FROM f")
def q_found_reports(spark, sf):
    """Test reports found by their places below a root, and their cases."""
    root = shared_dir(spark, "reports")
    rows = sql_table(spark, sf, "SELECT s_suppkey % 5 AS m, s_suppkey FROM supplier").groupBy("m").agg(F.array_sort(F.collect_list("s_suppkey")).alias("k"))
    body = F.concat(F.lit('<testsuite name="S" tests="1">'), F.array_join(F.transform("k", lambda k: F.concat(F.lit('<testcase name="t'), k.cast("string"), F.lit('" classname="C"/>'))), ""), F.lit("</testsuite>"))
    for m in range(5):
        part, name = f"{root}/m{m}/parts", f"{root}/m{m}/TEST-{m}.xml"
        rows.where(F.col("m") == m).coalesce(1).select(body.alias("value")).write.text(part)
        hadoop = spark._jvm.org.apache.hadoop.fs.Path
        fs = hadoop(part).getFileSystem(spark._jsc.hadoopConfiguration())
        for f in fs.listStatus(hadoop(part)):
            if f.getPath().getName().startswith("part-"):
                fs.rename(f.getPath(), hadoop(name))
    found = reports.parsed(reports.discovered(spark, root, reports.SUITE), reports.SUITE)
    return found.select(F.regexp_extract("path", r"/m(\d+)/", 1).cast("long").alias("m"), F.size("x.testcase").cast("long").alias("n"))


@query("SELECT n_nationkey AS k, n_regionkey + 1 AS v, CASE WHEN n_nationkey % 2 = 0 THEN 7 ELSE n_regionkey END AS layered FROM nation")
def q_settings(spark, sf):
    """Settings of a file with those of an environment over them, as numbers."""
    path = shared_dir(spark, "settings")
    n = table(spark, sf, "nation", "n_nationkey", "n_regionkey")
    lines = n.select(F.concat(F.lit(" A"), F.col("n_nationkey").cast("string"), F.lit(" = '"), F.col("n_regionkey").cast("string"), F.lit("'\n# A0=9\n")).alias("value"))
    lines.write.text(path)
    keys = [r["n_nationkey"] for r in n.select("n_nationkey").collect()]  # 25
    own, over = config.read_env(spark, path), config.layered(spark, path, {f"A{k}": "7" for k in keys if k % 2 == 0})
    rows = spark.createDataFrame([(k, config.get_int(over, f"A{k}"), config.get_float(own, f"A{k}")) for k in keys], "k int, layered int, own double")
    return n.join(rows, F.col("n_nationkey") == F.col("k")).select(F.col("n_nationkey").alias("k"), (F.col("own") + 1).cast("long").alias("v"), "layered")


_CALLS = "SELECT event_id, user_id, event_type, CAST(floor(value) AS INT) AS v FROM events"


@query(f"WITH c AS ({_CALLS}) SELECT 'r' || user_id AS run_id, event_id AS time_stamp, event_type AS node_name, 5 AS prompt_chars, CASE WHEN v % 3 = 0 THEN 0 ELSE v END AS input_tokens, v % 4 AS answer_chars, CASE WHEN v % 2 = 0 THEN 0 ELSE v % 5 END AS thinking_chars, v % 2 AS n_tool_calls FROM c")
def q_flat_calls(spark, sf):
    """Nested rows of model calls read from JSON lines as plain figures."""
    path = shared_dir(spark, "calls")
    rows = sql_table(spark, sf, _CALLS)
    usage = F.when(F.col("v") % 3 != 0, F.struct(F.col("v").alias("input_tokens")))
    data = F.struct(F.repeat(F.lit("x"), F.col("v") % 4).alias("content"), usage.alias("usage_metadata"), F.when(F.col("v") % 2 == 1, F.array(F.struct(F.lit("f").alias("name")))).alias("tool_calls"), F.struct(F.when(F.col("v") % 2 == 1, F.repeat(F.lit("y"), F.col("v") % 5)).alias("reasoning_content")).alias("additional_kwargs"))
    tables.write_jsonl(rows.select(F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("run_id"), F.col("event_id").alias("time_stamp"), F.col("event_type").alias("node_name"), F.lit("hello").alias("prompt"), F.struct(data.alias("data")).alias("response")), path)
    flat = logs.flat_calls(tables.read_table(spark, path, "llm_calls"))
    return flat.select("run_id", "time_stamp", "node_name", *[F.col(c).cast("long") for c in ("prompt_chars", "input_tokens", "answer_chars", "thinking_chars", "n_tool_calls")])
