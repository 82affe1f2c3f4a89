"""Queries over Java sources read as trees of declarations, and their SQL, which tells the results from how the sources were made."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import syntax, table_functions, text
from .registry import query, sql_table

_LONG = ", ".join(str(i) for i in range(100, 150))
# a file for each part: literals and comments that look like declarations, nested types, an enum with a body, a long value
_SOURCES = rf"""SELECT p_partkey AS k, p_size AS s, p_partkey % 3 = 0 AS same, 'package a.b' || (p_partkey % 3) || ';\nimport java.util.List;\n/* class Gone {{ Lost x; }} */\npublic class C' || p_partkey || ' extends Base' || p_size || ' implements I' || (p_partkey % 5) || ' {{\n    private static final String T = "class Fake {{ }}"; // Comment\n    protected Dep' || (p_size % 7) || ' dep = Dep' || (p_size % 7) || '.of(' || p_size || ');\n    public C' || p_partkey || '(Arg' || (p_partkey % 4) || ' a) {{ this.go(a); }}\n'
|| CASE WHEN p_partkey % 2 = 0 THEN '    public int size' || p_size || '() {{ return n; }}\n' ELSE '' END || '    void go(List<Arg' || (p_partkey % 4) || '> xs) throws Bad' || (p_partkey % 2) || ' {{ Used' || p_size || '.run(xs); }}\n    private int hid() {{ return 0; }}\n    static class In' || p_size || ' {{ public Num get() {{ return null; }} private Own no() {{ return null; }} }}\n    enum Kind {{ ONE, TWO' || p_size || '(1), @Old THREE {{ int z() {{ return 3; }} }}; int v; }}\n    int[] many = {{{_LONG}}};\n}}\nclass Other {{ }}\n' AS source FROM part""".replace("{{", "{").replace("}}", "}")
_P = "p AS (SELECT p_partkey AS k, p_size AS s, p_partkey % 3 = 0 AS same, 'C' || p_partkey AS c, 'Dep' || (p_size % 7) AS dep, 'Arg' || (p_partkey % 4) AS arg, 'Bad' || (p_partkey % 2) AS bad, 'Used' || p_size AS used, 'In' || p_size AS nested, 'TWO' || p_size AS two FROM part)"
_JOIN = lambda names: f"array_to_string(list_sort(list_distinct([{names}])), ',')"


def _sources(spark, sf):
    rows = sql_table(spark, sf, _SOURCES, dealt=True)
    return rows.withColumn("tree", syntax.tree(F.col("source")))


@query(f"""WITH {_P} SELECT k, array_to_string(list_sort(list_distinct(['Base' || s, 'I' || (k % 5), c, 'T', 'String', dep, 'dep', 'of', arg, 'a', 'go', 'List', 'xs', bad, used, 'run', 'hid', nested, 'Num', 'get', 'Own', 'no', 'Kind', 'ONE', two, 'Old', 'THREE', 'z', 'v', 'many', 'Other'] || CASE WHEN k % 2 = 0 THEN ['size' || s, 'n'] ELSE [] END)), ',') AS names,
{_JOIN("'Base' || s, 'I' || (k % 5), 'String', dep, arg, 'List', bad, used, 'Num', 'Own'")} AS types, {_JOIN("'Base' || s, 'I' || (k % 5), dep, arg, 'List', bad, 'Num'")} AS api, {_JOIN("arg, 'List'")} AS params, {_JOIN("'Base' || s, 'I' || (k % 5)")} AS supers FROM p""")
def q_source_names(spark, sf):
    """Names, types, and what a source's declarations show of other types."""
    t = F.col("tree")
    told = {"names": syntax.identifiers(t), "types": syntax.type_names(t), "api": syntax.api_refs(t), "params": syntax.param_refs(t), "supers": syntax.super_refs(t)}
    return _sources(spark, sf).select("k", *[F.array_join(v, ",").alias(n) for n, v in told.items()])


_NL = "chr(10)"
_HEAD = "'public class ' || c || ' extends Base' || s || ' implements I' || (k % 5) || ' {' || chr(10)"
_CONSTANTS = "'    enum Kind {' || chr(10) || '        ONE, ' || two || '(1), @Old THREE;' || chr(10)"
_SIZE = "CASE WHEN k % 2 = 0 THEN '    public int size' || s || '() {' ELSE '' END"


@query(f"""WITH {_P} SELECT k, {_HEAD} || CASE WHEN same THEN '    protected ' || dep || ' dep = ' || dep || '.of(' || s || ');' || {_NL} ELSE '' END || '    public ' || c || '(' || arg || ' a) {{ /* body omitted */ }}' || {_NL} || CASE WHEN k % 2 = 0 THEN '    public int size' || s || '() {{ return n; }}' || {_NL} ELSE '' END
|| CASE WHEN same THEN '    void go(List<' || arg || '> xs) throws ' || bad || ' {{ ' || used || '.run(xs); }}' || {_NL} || '    static class ' || nested || ' {{' || {_NL} || '        public Num get() {{ /* body omitted */ }}' || {_NL} || '    }}' || {_NL} || {_CONSTANTS} || '        int v;' || {_NL} || '    }}' || {_NL} || '    int[] many = /* initializer omitted */;' || {_NL} ELSE '' END || '}}' AS surface,
CASE WHEN same OR k % 4 = 0 THEN {_HEAD} || CASE WHEN k % 4 = 0 THEN '    public ' || c || '(' || arg || ' a) {{ this.go(a); }}' || {_NL} ELSE '' END || CASE WHEN same THEN '    void go(List<' || arg || '> xs) throws ' || bad || ' {{ ' || used || '.run(xs); }}' || {_NL} || {_CONSTANTS} || '    }}' || {_NL} ELSE '' END || '}}' END AS called,
CASE WHEN k % 2 = 0 THEN {_HEAD} || '    public int size' || s || '() {{ /* body omitted */ }}' || {_NL} || '}}' END AS results FROM p""".replace("{{", "{").replace("}}", "}"))
def q_source_views(spark, sf):
    """Three views of a collaborator: its surface, what a class calls of it, its accessors."""
    t, src, same = F.col("tree"), F.col("source"), F.col("same")
    name = F.concat(F.lit("C"), F.col("k").cast("string"))
    used = F.array(F.lit("go"), F.concat(F.lit("size"), F.col("s").cast("string")))
    called = F.when(F.col("k") % 4 == 0, F.array(F.lit("go"), name)).otherwise(F.array(F.lit("go")))
    return _sources(spark, sf).select("k", syntax.surface_view(src, t, same, used).alias("surface"), syntax.called_view(src, t, same, called, name).alias("called"), syntax.results_view(src, t, same).alias("results"))


@query(f"""WITH src AS (SELECT * REPLACE (replace(source, '\\n', chr(10)) AS source) FROM ({_SOURCES})) SELECT k, replace(source, 'private ', '{syntax.PRIVATE_TAG} private ') AS tagged,
CASE WHEN k % 2 = 0 THEN regexp_replace(source, ' (I[0-9]) \\{{', ' \\1 {{' || chr(10) || '    /* INHERITED, {syntax.MARKER}: protected or package-private in another package: load, save (from Up' || s || '); x (from Far) */') ELSE source END AS inherited FROM src""".replace("{{", "{").replace("}}", "}"))
def q_source_tags(spark, sf):
    """Sources with private members marked, and with a note of inherited members out of reach."""
    t, src = F.col("tree"), F.col("source")
    entry = lambda a, *n: F.struct(a.alias("ancestor"), F.array(*map(F.lit, n)).alias("names"))
    out = F.when(F.col("k") % 2 == 0, F.array(entry(F.concat(F.lit("a.b.Up"), F.col("s").cast("string")), "load", "save"), entry(F.lit("Far"), "x")))
    none = F.array().cast("array<struct<ancestor:string,names:array<string>>>")
    return _sources(spark, sf).select("k", syntax.with_private_tags(src, t).alias("tagged"), syntax.with_inherited_tag(src, t, F.coalesce(out, none)).alias("inherited"))


@query("""SELECT p_partkey AS k, 'static class In' || p_size || ' { public Num get() { return null; } private Own no() { return null; } }' AS body, CAST(NULL AS VARCHAR) AS gone, 'class Other { }' AS other, 'm' || p_partkey || '(In, String[], T...)' AS signature,
'C' || p_partkey || '(Arg' || (p_partkey % 4) || ')' || CASE WHEN p_partkey % 2 = 0 THEN ' size' || p_size || '()' ELSE '' END || ' go(List) hid() get() no()' AS own FROM part""")
def q_nested_types(spark, sf):
    """The declaration of a nested type within its file, and members' signatures by simple names, of byte code and of source."""
    t, src = F.col("tree"), F.col("source")
    n = lambda c: F.col(c).cast("string")
    outer, params = F.concat(F.lit("C"), n("k")), F.array(F.lit("a.Out$In"), F.lit("java.lang.String[]"), F.lit("b.T..."))
    body = lambda *names: syntax.nested_body(src, t, F.array(*names))
    own = F.array_join(F.transform(F.filter(t["decls"], lambda d: d["kind"].isin("method", "constructor")), syntax.source_signature), " ")
    return _sources(spark, sf).select("k", body(outer, F.concat(F.lit("In"), n("s"))).alias("body"), body(outer, F.lit("Gone")).alias("gone"), body(F.lit("Other")).alias("other"), text.signature(F.concat(F.lit("m"), n("k")), params).alias("signature"), own.alias("own"))


@query("""WITH p AS (SELECT p_partkey AS k, p_size AS s FROM part), d AS (SELECT k, unnest([{'kind': 'class', 'name': 'C' || k, 'depth': 0, 'visibility': 'public', 'first': 4, 'returns': NULL}, {'kind': 'field', 'name': 'T', 'depth': 1, 'visibility': 'private', 'first': 5, 'returns': 'String'}, {'kind': 'field', 'name': 'dep', 'depth': 1, 'visibility': 'protected', 'first': 6, 'returns': 'Dep' || (s % 7)}, {'kind': 'constructor', 'name': 'C' || k, 'depth': 1, 'visibility': 'public', 'first': 7, 'returns': NULL},
{'kind': CASE WHEN k % 2 = 0 THEN 'method' END, 'name': 'size' || s, 'depth': 1, 'visibility': 'public', 'first': 8, 'returns': 'int'}, {'kind': 'method', 'name': 'go', 'depth': 1, 'visibility': 'package', 'first': 9 - k % 2, 'returns': 'void'}, {'kind': 'method', 'name': 'hid', 'depth': 1, 'visibility': 'private', 'first': 10 - k % 2, 'returns': 'int'}, {'kind': 'class', 'name': 'In' || s, 'depth': 1, 'visibility': 'package', 'first': 11 - k % 2, 'returns': NULL},
{'kind': 'method', 'name': 'get', 'depth': 2, 'visibility': 'public', 'first': 11 - k % 2, 'returns': 'Num'}, {'kind': 'method', 'name': 'no', 'depth': 2, 'visibility': 'private', 'first': 11 - k % 2, 'returns': 'Own'}, {'kind': 'enum', 'name': 'Kind', 'depth': 1, 'visibility': 'package', 'first': 12 - k % 2, 'returns': NULL}, {'kind': 'constant', 'name': 'ONE', 'depth': 2, 'visibility': 'package', 'first': 12 - k % 2, 'returns': NULL},
{'kind': 'constant', 'name': 'TWO' || s, 'depth': 2, 'visibility': 'package', 'first': 12 - k % 2, 'returns': NULL}, {'kind': 'constant', 'name': 'THREE', 'depth': 2, 'visibility': 'package', 'first': 12 - k % 2, 'returns': NULL}, {'kind': 'field', 'name': 'v', 'depth': 2, 'visibility': 'package', 'first': 12 - k % 2, 'returns': 'int'}, {'kind': 'field', 'name': 'many', 'depth': 1, 'visibility': 'package', 'first': 13 - k % 2, 'returns': 'int[]'}, {'kind': 'class', 'name': 'Other', 'depth': 0, 'visibility': 'package', 'first': 15 - k % 2, 'returns': NULL}]) AS d FROM p)
SELECT k, d.kind, d.name, CAST(d.depth AS INTEGER) AS depth, d.visibility, CAST(d."first" AS INTEGER) AS first_line, d.returns FROM d WHERE d.kind IS NOT NULL""")
def q_declarations(spark, sf):
    """Every declaration of every source, by a table function."""
    table_functions.register(spark)
    return spark.sql("SELECT k, d.kind, d.name, d.depth, d.visibility, d.first AS first_line, d.returns FROM {s}, LATERAL java_declarations(source) d", s=sql_table(spark, sf, _SOURCES, dealt=True))
