"""Queries over text and source functions, and their SQL, which tells the results from how the texts were made."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import java, syntax, text
from ..operators import graph, logs, tokens
from .registry import query, sql_table, table

_FENCES = r"""SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN 'intro\n```java\npackage p;\nw' || turn || '\n```\nend' WHEN 1 THEN '```java\nw' || turn WHEN 2 THEN 'w' || turn WHEN 3 THEN '```\nclass A' || turn || ' { }\n```' WHEN 4 THEN '```\nx\n``` mid ```\nlonger w' || turn || '\n```' ELSE '' END AS t FROM conversations"""


@query("""WITH c AS (SELECT conv_id, turn, turn % 6 AS m FROM conversations) SELECT conv_id, turn,
CASE m WHEN 0 THEN 'package p;' || chr(10) || 'w' || turn || chr(10) WHEN 1 THEN '```java' || chr(10) || 'w' || turn WHEN 2 THEN 'w' || turn WHEN 3 THEN 'class A' || turn || ' { }' || chr(10) WHEN 4 THEN 'longer w' || turn || chr(10) ELSE '' END AS strict,
CASE m WHEN 0 THEN 'package p;' || chr(10) || 'w' || turn || chr(10) WHEN 1 THEN 'w' || turn || chr(10) WHEN 2 THEN 'w' || turn || chr(10) WHEN 3 THEN 'class A' || turn || ' { }' || chr(10) WHEN 4 THEN 'longer w' || turn || chr(10) ELSE '' END AS lenient FROM c""")
def q_fences(spark, sf):
    """Code out of fenced answers, strictly and leniently."""
    t = F.col("t")
    return sql_table(spark, sf, _FENCES).select("conv_id", "turn", text.strip_fence(t).alias("strict"), text.strip_fence_lenient(t).alias("lenient"))


@query("""SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || chr(10) || '... [' || (length(text) - 100) || ' more characters]' ELSE text END AS head, CASE WHEN length(text) > 50 THEN right(text, 50) ELSE text END AS tail FROM documents""")
def q_text_windows(spark, sf):
    """The first characters of a text with a notice, and its last ones."""
    t = F.col("text")
    return table(spark, sf, "documents", "doc_id", "text").select("doc_id", text.head(t, 100).alias("head"), text.tail(t, 50).alias("tail"))


@query("""WITH l AS (SELECT conv_id, turn, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS l, text FROM conversations)
SELECT conv_id, turn, CASE WHEN text = '' THEN '' ELSE array_to_string(list_transform(l, lambda s, i: lpad(CAST(i AS VARCHAR), CAST(length(CAST(len(l) AS VARCHAR)) AS INTEGER), ' ') || ' | ' || s), chr(10)) END AS numbered FROM l""")
def q_numbered(spark, sf):
    """Lines behind their numbers."""
    return table(spark, sf, "conversations", "conv_id", "turn", "text").select("conv_id", "turn", text.numbered(F.col("text")).alias("numbered"))


_CODE = r"""SELECT o_orderkey AS k, 'int a' || (o_custkey % 9) || ' = 1; // set b\n// all c' || (o_custkey % 4) || '\n\n/* d */\n#### // kept ' || o_orderstatus || '\n * e\nfoo(\"x y\");   ' AS t FROM orders"""


@query("""SELECT o_orderkey AS k, 'int a' || (o_custkey % 9) || ' = 1; ' || chr(10) || chr(10) || '#### // kept ' || o_orderstatus || chr(10) || 'foo("x y");   ' AS code, 51 AS n_chars,
'inta' || (o_custkey % 9) || '=1;####*efoo("xy");' AS plain, 'a' || (o_custkey % 9) || ',e,foo' AS names, 'a' || (o_custkey % 9) || ',e,foo' AS by_patterns FROM orders""")
def q_code_lines(spark, sf):
    """Code without comment lines but for marked ones, characters of a prompt, code without white space, names in code."""
    t = F.col("t")
    return sql_table(spark, sf, _CODE).select("k", text.without_comments(t).alias("code"), text.prompt_chars(t).alias("n_chars"), text.normalized(t).alias("plain"), F.array_join(syntax.identifiers(syntax.tree(t)), ",").alias("names"), F.array_join(text.identifiers(t), ",").alias("by_patterns"))


_NAMES = "SELECT p_partkey AS k, 'a.b' || (p_partkey % 3) || '.' || CASE p_partkey % 4 WHEN 0 THEN 'Array' WHEN 1 THEN 'Unit' ELSE 'Point' END || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '$In' || p_size ELSE '' END AS name, p_size % 4 AS v FROM part"


@query(f"""WITH n AS ({_NAMES}) SELECT k, CASE WHEN k % 2 = 0 THEN split_part(name, '$', 2) ELSE split_part(name, '.', 3) END AS simple, split_part(name, '$', 1) AS outer_name,
CASE WHEN k % 4 = 0 THEN 'an ' ELSE 'a ' END || split_part(split_part(name, '.', 3), '$', 1) AS with_article, CASE v WHEN 0 THEN 'public' WHEN 1 THEN 'protected' WHEN 2 THEN 'private' ELSE 'package' END AS visibility,
v = 0 OR (v <> 2 AND k % 3 = 1) AS accessible, 'f(' || split_part(split_part(name, '.', 3), '$', CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END) || '[], Map)' AS call FROM n""")
def q_names(spark, sf):
    """Simple and outer names, articles, visibility, access and calls."""
    n, v = F.col("name"), F.col("v")
    mods = F.when(v == 0, F.array(F.lit("static"), F.lit("public"))).when(v == 1, F.array(F.lit("protected"))).when(v == 2, F.array(F.lit("private"), F.lit("final"))).otherwise(F.array(F.lit("final")))
    vis = text.visibility(mods)
    return sql_table(spark, sf, _NAMES).select(
        "k", text.simple_name(n).alias("simple"), text.outer_name(n).alias("outer_name"), text.article(text.simple_name(text.outer_name(n))).alias("with_article"), vis.alias("visibility"),
        text.accessible(vis, F.lit("a.b1"), F.regexp_extract(n, r"^(a\.b\d)", 1)).alias("accessible"), text.call_of(F.lit("f"), F.array(F.concat(n, F.lit("[]")), F.lit("java.util.Map<K, List<V>>"))).alias("call"),
    )


_PATHS = r"SELECT o_orderkey AS k, CASE o_custkey % 5 WHEN 0 THEN 'C:\\Proj\\src\\main\\java\\org\\C' || o_orderkey || '.java' WHEN 1 THEN '/w/src/main/java/C' || o_orderkey || '.java' WHEN 2 THEN '/w/src/test/java/C' || o_orderkey || 'Test.java' WHEN 3 THEN '/w/src/main/java11/C' || o_orderkey || '.java' ELSE '/w/docs/C' || o_orderkey || '.java' END AS p FROM orders"


@query("""WITH o AS (SELECT o_orderkey AS k, o_custkey % 5 AS m FROM orders) SELECT k, m IN (0, 1, 3) AS implementation, CASE m WHEN 0 THEN 'org/C' || k WHEN 1 THEN 'C' || k END AS class_key,
CASE m WHEN 0 THEN '/proj/src/main/java/org/c' || k || '.java' WHEN 1 THEN '/w/src/main/java/c' || k || '.java' WHEN 2 THEN '/w/src/test/java/c' || k || 'test.java' WHEN 3 THEN '/w/src/main/java11/c' || k || '.java' ELSE '/w/docs/c' || k || '.java' END AS normal,
CASE m WHEN 0 THEN 'C:/Proj/src/test/java/org/C' || k || 'Test.java' WHEN 1 THEN '/w/src/test/java/C' || k || 'Test.java' END AS test_path FROM o""")
def q_paths(spark, sf):
    """Implementation sources, class keys, normal paths and paths of tests."""
    p = F.col("p")
    return sql_table(spark, sf, _PATHS).select("k", text.is_implementation(p).alias("implementation"), text.class_key(p).alias("class_key"), text.normalized_path(p).alias("normal"), text.test_path(p).alias("test_path"))


@query("""WITH c AS (SELECT conv_id, turn, text, turn % 3 AS m FROM conversations) SELECT conv_id, turn, CASE m WHEN 2 THEN text || 'end' ELSE text END AS content, m = 0 AND trim(text) = '' AS empty_answer,
'<|im_start|>system' || chr(10) || 'be brief<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || text || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS chat, 'Turn ' || turn || ': ' || text || '!' AS filled,
CASE m WHEN 0 THEN 'nothing here' ELSE '1. a' || turn || CASE WHEN m = 2 THEN chr(10) || '2. b' ELSE '' END END AS listed FROM c""")
def q_messages(spark, sf):
    """The text of message contents, chat prompts, filled templates and numbered lists."""
    c, m = table(spark, sf, "conversations", "conv_id", "turn", "text"), F.col("turn") % 3
    t = F.col("text")
    parts = F.to_json(F.array(F.struct(F.lit("text").alias("type"), t.alias("text")), F.struct(F.lit("text").alias("type"), F.lit("end").alias("text"))))
    calls = F.when(m == 0, F.expr("cast(array() as array<string>)")).otherwise(F.array(F.lit("call")))
    items = F.when(m == 0, F.expr("cast(array() as array<string>)")).when(m == 1, F.array(F.concat(F.lit("a"), F.col("turn").cast("string")))).otherwise(F.array(F.concat(F.lit("a"), F.col("turn").cast("string")), F.lit("b")))
    return c.select(
        "conv_id", "turn", text.content_text(F.when(m == 2, parts).otherwise(t)).alias("content"), text.is_empty_answer(calls, t).alias("empty_answer"), text.chat_prompt(F.lit("be brief"), t).alias("chat"),
        text.fill("Turn {n}: {t}!", n=F.col("turn").cast("string"), t=t).alias("filled"), text.list_section(items, "nothing here").alias("listed"),
    )


_IMPORTS = r"SELECT o_orderkey AS k, 'package a;\nimport b.C' || (o_custkey % 7) || ';\nimport static d.E.f;\n' || CASE WHEN o_custkey % 2 = 0 THEN 'import g.h.*;\n' ELSE '' END || '/** {@link K' || (o_custkey % 3) || '} @see a.L and {@linkplain M#n} */\nclass X extends Y { }\nenum Z { }\nabstract class V { }' AS t FROM orders"


@query("""SELECT o_orderkey AS k, 'b.C' || (o_custkey % 7) AS single, CASE WHEN o_custkey % 2 = 0 THEN 'g.h' ELSE '' END AS wildcard, 'K' || (o_custkey % 3) || ',M' AS links, true AS z_enum, false AS x_enum, true AS v_abstract FROM orders""")
def q_imports(spark, sf):
    """Imports, links in comments and kinds of declared types."""
    t = F.col("t")
    i = text.imports(t)
    return sql_table(spark, sf, _IMPORTS).select(
        "k", F.array_join(i["single"], ",").alias("single"), F.array_join(i["wildcard"], ",").alias("wildcard"), F.array_join(text.doc_links(t), ",").alias("links"),
        text.declares("enum", t, F.lit("Z")).alias("z_enum"), text.declares("enum", t, F.lit("X")).alias("x_enum"), text.declares("abstract class", t, F.lit("V")).alias("v_abstract"),
    )


_SECTIONS = r"SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '# Top\n' ELSE '# Top\n## Now\nw' || turn || '\n## Then\nrest' END AS t, CASE turn % 3 WHEN 0 THEN 'private void a() throws E1 { } void b(int x) throws q.E' || turn || ', E2;' ELSE '@ParameterizedTest void c() { } // throws E9' END AS s FROM conversations"


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 <> 0 THEN 'w' || turn || chr(10) END AS section, CASE WHEN turn % 3 = 0 THEN 'E2,E' || turn END AS thrown, turn % 3 <> 0 AS is_test FROM conversations""")
def q_sections(spark, sf):
    """What stands between headings, types in throws clauses, tests by annotation."""
    rows = sql_table(spark, sf, _SECTIONS)
    thrown = text.thrown_types(F.col("s"))
    by_place = F.array_join(F.reverse(F.sort_array(F.transform(thrown, lambda n: F.when(n == "E2", F.concat(F.lit("~"), n)).otherwise(n)))), ",")
    return rows.select("conv_id", "turn", text.section(F.col("t"), "## Now", "## Then").alias("section"), F.nullif(F.replace(by_place, F.lit("~"), F.lit("")), F.lit("")).alias("thrown"), text.is_test_method(F.col("s"), F.lit("c")).alias("is_test"))


@query("""WITH e AS (SELECT event_id, event_type <> 'error' AS ok, event_type = 'purchase' AS green, value AS v FROM events) SELECT event_id, 'Compiler node result: Maven test compilation ' || CASE WHEN NOT ok THEN 'failed' WHEN green THEN 'passed' ELSE 'succeeded, but tests fail' END || '.' || chr(10) || 'Generated test file: T.java' || chr(10) || chr(10) || 'Relevant Maven output:' || chr(10) ||
CASE WHEN ok AND green THEN '[INFO] a' || chr(10) ELSE '' END || '[ERROR] b' || chr(10) || '[INFO] c' AS build, 'Mutation validator result: PIT mutation report generation ' || CASE WHEN ok THEN 'succeeded' ELSE 'failed' END || '.' || chr(10) || 'Mutation score previous: 1.00%' || chr(10) || 'Mutation score current: ' || printf('%.2f', floor(v)) || '%' || chr(10) || 'Mutation score delta: ' || printf('%.2f', floor(v) - 1) || '%' || chr(10) || 'Significant improvement threshold: 0.50%' || chr(10) || chr(10) ||
CASE WHEN ok THEN 'Mutation details for the class under test:' ELSE 'Maven output:' END || chr(10) || 'd' AS mutation FROM e""")
def q_feedback(spark, sf):
    """Results of builds and mutation runs as texts."""
    e = table(spark, sf, "events", "event_id", "event_type", "value")
    ok, green, v = F.col("event_type") != "error", F.col("event_type") == "purchase", F.floor("value")
    return e.select("event_id", text.compiler_feedback(ok, green, F.lit("T.java"), F.lit("[INFO] a\n[ERROR] b\n[INFO] c")).alias("build"), text.mutation_feedback(ok, F.lit(1), v, v - 1, F.lit(0.5), F.lit(" d\n")).alias("mutation"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[\\p{L}\\p{N}]+|[^\\s\\p{L}\\p{N}]')) AS n_tokens FROM documents")
def q_token_counts(spark, sf):
    """A stand-in for token counts."""
    return table(spark, sf, "documents", "doc_id", "text").select("doc_id", text.token_count(F.col("text")).cast("long").alias("n_tokens"))


_PRINTED = "SELECT l_partkey AS p, l_linenumber AS n, min(l_returnflag) AS flag, min(l_suppkey) AS s FROM lineitem GROUP BY l_partkey, l_linenumber"


@query(f"""WITH m AS ({_PRINTED}) SELECT 'a.C' || p AS owner, CASE WHEN n = 7 THEN 'C' || p ELSE 'm' || n END AS name, CASE WHEN n = 7 THEN 'ctor' WHEN n = 6 THEN 'field' ELSE 'method' END AS kind, CASE flag WHEN 'N' THEN 'public' WHEN 'R' THEN 'protected' ELSE 'package' END AS visibility, n = 5 AS is_static,
CASE WHEN n = 6 THEN '' ELSE 'int,java.util.Map' END AS params, CASE WHEN n = 6 THEN 'int' WHEN n <> 7 THEN 'a.B$In' END AS returns, CASE WHEN n < 6 THEN 'a.C' || s || '.x' ELSE '' END AS calls, CASE WHEN n < 6 THEN 'a.D' || s ELSE '' END AS news FROM m""")
def q_disassembled(spark, sf):
    """Members of disassembled classes with what each calls and builds."""
    c = F.col
    m = sql_table(spark, sf, _PRINTED)
    vis = F.when(c("flag") == "N", "public ").when(c("flag") == "R", "protected ").otherwise("")
    owner, s = F.concat(F.lit("a.C"), c("p").cast("string")), c("s").cast("string")
    head = F.when(c("n") == 6, F.concat(vis, F.lit("int m6;"))).when(c("n") == 7, F.concat(vis, owner, F.lit("(int, java.util.Map<K, V>);"))).otherwise(F.concat(vis, F.when(c("n") == 5, "static ").otherwise(""), F.lit("a.B$In m"), c("n").cast("string"), F.lit("(int, java.util.Map<K, java.util.List<V>>) throws a.E;")))
    body = F.when(c("n") < 6, F.concat(F.lit("    Code:\n       0: new           #2    // class a/D"), s, F.lit("\n       4: invokevirtual #3    // Method a/C"), s, F.lit(".x:()V\n"))).otherwise("")
    m = m.withColumn("t", F.concat(F.lit("  "), head, F.lit("\n"), body))
    texts = m.groupBy("p").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "t"))), lambda x: x["t"]), "").alias("ts"))
    texts = texts.select(F.concat(F.lit("public class a.C"), c("p").cast("string"), F.lit(" extends a.P<T> {\n"), "ts", F.lit("}\n")).alias("t"))
    rows = texts.select(F.explode(java.class_members(c("t"))).alias("m"))
    joined = lambda x: F.array_join(x, ",")
    return rows.select("m.owner", "m.name", "m.kind", "m.visibility", c("m.static").alias("is_static"), joined(c("m.params")).alias("params"), "m.returns", joined(F.transform("m.calls", lambda x: F.concat(x["owner"], F.lit("."), x["name"]))).alias("calls"), joined(c("m.news")).alias("news"))


@query("""WITH f AS (SELECT '/w/src/main/java/p' || (o_custkey % 9) || '/C' || o_orderkey || '.java' AS path, 'p' || (o_custkey % 9) || '/C' || o_orderkey AS class_key, o_orderkey % 3 AS m FROM orders) SELECT path, class_key, CAST(row_number() OVER (ORDER BY path) - 1 AS INT) AS idx FROM f WHERE m <> 0""")
def q_class_listing(spark, sf):
    """Concrete implementation classes with their places in path order."""
    path = "'/w/src/main/java/p' || (o_custkey % 9) || '/C' || o_orderkey || '.java'"
    files = sql_table(spark, sf, f"SELECT {path} AS path, CASE o_orderkey % 3 WHEN 0 THEN 'public abstract class C' ELSE 'public final class C' END || o_orderkey || ' {{ }}' AS content FROM orders".replace("{{", "{").replace("}}", "}"))
    return logs.class_listing(files)


@query("""WITH f AS (SELECT o_custkey % 50 AS root, '/w/r' || (o_custkey % 50) || '/d' || (o_orderkey % 3) || '/T' || o_orderkey || '.java' AS path, o_orderkey AS k FROM orders), t AS (SELECT * FROM f WHERE k % 20 = 0),
j AS (SELECT CAST(f.root AS VARCHAR) AS root, t.path AS target, f.path, row_number() OVER (PARTITION BY t.root, t.path ORDER BY CASE WHEN f.k % 3 = t.k % 3 THEN 0 ELSE 1 END, f.path) AS place FROM t JOIN f ON f.root = t.root AND f.path <> t.path) SELECT root, target, path, CAST(place AS INT) AS place FROM j WHERE place <= 2""")
def q_nearby(spark, sf):
    """Other tests below the same root, those of the same folder first."""
    files = sql_table(spark, sf, "SELECT CAST(o_custkey % 50 AS STRING) AS root, '/w/r' || (o_custkey % 50) || '/d' || (o_orderkey % 3) || '/T' || o_orderkey || '.java' AS path, o_orderkey AS k FROM orders")
    return logs.nearby(files, files.where("k % 20 = 0")).select("root", "target", "path", "place")


_TREE = "SELECT '/w' || CASE WHEN p_partkey % 7 = 0 THEN '' ELSE '/m' || (p_partkey % 5) || CASE WHEN p_partkey % 3 = 0 THEN '/sub' ELSE '' END END || '/src/main/java/C' || p_partkey || '.java' AS path FROM part UNION ALL SELECT '/w/m' || (s_suppkey % 4) || CASE WHEN s_suppkey % 8 = 3 THEN '/sub' ELSE '' END || '/pom.xml' FROM supplier WHERE s_suppkey < 9 UNION ALL SELECT '/else/' || p_partkey || '.java' FROM part"


@query(f"""WITH f AS ({_TREE}), p AS (SELECT DISTINCT regexp_replace(path, '/pom.xml$', '') AS m FROM f WHERE path LIKE '%/pom.xml') SELECT f.path, arg_max(m, length(m)) AS module FROM (SELECT DISTINCT path FROM f) f LEFT JOIN p ON starts_with(f.path, m || '/') AND starts_with(f.path, '/w/') GROUP BY 1""")
def q_modules(spark, sf):
    """The module of each file: the nearest folder above it with a pom."""
    return graph.modules(sql_table(spark, sf, _TREE).distinct(), "/w")


@query("SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN 'int load(int n) { return n; }' || chr(10) || '...' || chr(10) || 'void save' || p_size || '() { }' WHEN p_partkey % 3 = 1 THEN 'void save' || p_size || '() { }' END AS compact FROM part")
def q_compacted(spark, sf):
    """The methods of a source that a class names, with dots between."""
    rows = sql_table(spark, sf, "SELECT p_partkey AS k, 'class A { int load(int n) { return n; } /* void gone() { } */ void save' || p_size || '() { } void other() { } }' AS source, CASE p_partkey % 3 WHEN 0 THEN 'a.load(1); a.save' || p_size || '();' WHEN 1 THEN 'a.save' || p_size || '();' ELSE 'nothing' END AS user FROM part")
    return rows.select("k", java.compacted(F.col("source"), F.col("user")).alias("compact"))


@query()
def q_exact_tokens(spark, sf):
    """Exact token counts of all documents in a byte-level BPE; SQL has none, tests hold it against the library."""
    import public_tokenizers

    return tokens.token_counts(table(spark, sf, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "n_tokens")
