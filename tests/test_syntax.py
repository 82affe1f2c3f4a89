"""Java sources as trees: declarations, names, views."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import syntax

SOURCE = '''package a.b; import java.util.List; import x.Y;
/** class Hidden { } */
@Deprecated public abstract class Outer<T extends Base> extends Sup<Arg> implements I1, I2<K> {
    private static final String TEXT = "class Fake { int q; }"; // Comment
    protected int a, b = 3;
    List<Map<String, Foo[]>> xs = new ArrayList<>();
    Runnable r = () -> { Inside.run(); };
    static { Init.go(); }
    public Outer(@Nonnull final Dep dep, int... rest) throws Bad, Worse { this.x = Dep.of(dep); }
    <R extends Q> R go(List<? super Z> z, String[] q) { Other o = (Cast) z; for (Each e : z) { if (a < b && c > d) call(e); } return Ref::make; }
    abstract void none();
    private class Inner { int deep() { return 1; } private Secret p; }
    enum Kind { ONE, TWO(2) { int f() { return 0; } }, @Old THREE; private final int v = 1; Kind() {} Kind(int v) { } static Kind of() { return ONE; } }
    interface Shape { int SIDES = 4; double area(); default void show() { Printer.print(this); } }
    record Point(int x, Num y) implements Has { Point { check(x); } static Point zero() { return new Point(0, null); } }
    @interface Mark { String value() default "x"; int[] ns() default {1, 2}; }
    int broken( { }
}
class Second { void m() { } }
'''


def test_declarations():
    t = syntax.nodes_of(SOURCE)
    got = [(d["kind"], d["name"], d["depth"], d["visibility"]) for d in t["decls"]]
    assert got[:9] == [("class", "Outer", 0, "public"), ("field", "TEXT", 1, "private"), ("field", "a", 1, "protected"), ("field", "xs", 1, "package"), ("field", "r", 1, "package"), ("initializer", "", 1, "package"), ("constructor", "Outer", 1, "public"), ("method", "go", 1, "package"), ("method", "none", 1, "package")]
    assert [d["name"] for d in t["decls"] if d["kind"] == "constant"] == ["ONE", "TWO", "THREE"]
    assert ("method", "area", 2, "public") in got and ("element", "value", 2, "public") in got and ("compact", "Point", 2, "package") in got
    by = {(d["name"], d["depth"]): d for d in t["decls"]}
    assert by["go", 1]["params"] == ["List<? super Z>", "String[]"] and by["go", 1]["returns"] == "R" and by["Outer", 1]["params"] == ["Dep", "int..."] and by["Outer", 1]["returns"] is None
    assert by["deep", 2]["hidden"] and not by["go", 1]["hidden"] and t["decls"][by["deep", 2]["up"]]["name"] == "Inner" and by["deep", 2]["within"] == [0, by["deep", 2]["up"]]
    for d in t["decls"]:
        s = SOURCE[d["begin"] : d["end"]]
        assert s == s.strip() and d["name"] in s and (d["body"] < 0 or SOURCE[d["body"]] == "{")
    assert by["m", 1]["kind"] == "method"  # what follows broken source is still read


def test_types_are_told_from_other_names():
    types = {n["name"] for n in syntax.nodes_of(SOURCE)["names"] if n["kind"] == "type"}
    assert types == set("Arg ArrayList Bad Base Cast Dep Each Foo Has I1 I2 K Kind List Map Num Other Point Q R Runnable Secret String Sup T Worse Z".split())


def test_odd_sources():
    for s in ("", "}", "{", "class", "class A", "class A {", "class A { int", "class A { void f(", "((((", '"', "'", "/*", "@", "@A", "enum E { A(, B }", "class A { int x = ; ] } class B { }", "<<<>>", "record", "record R", "int x;", "é ß \U0001f600 class Ü { Ö ä; }", "x" * 100_000, "{" * 3000, "class A { " * 300):
        t = syntax.nodes_of(s)
        assert all(0 <= d["begin"] <= d["end"] <= len(s) and d["up"] < i for i, d in enumerate(t["decls"]))
        assert all(s[n["begin"] : n["begin"] + len(n["name"])] == n["name"] for n in t["names"])
    assert [d["name"] for d in syntax.nodes_of("class A { int x = ; ] } class B { }")["decls"] if d["kind"] == "class"] == ["A", "B"]
    assert [(d["name"], d["returns"]) for d in syntax.nodes_of("\U0001f600 class Ü { Ö ä; }")["decls"]] == [("Ü", None), ("ä", "Ö")]


def test_columns(spark):
    rows = spark.createDataFrame([(SOURCE,), (None,), ("",), ("enum E { A, B }",)], "s string").select("s", syntax.tree(F.col("s")).alias("t"))
    t, s = F.col("t"), F.col("s")
    used = F.array(F.lit("go"))
    got = rows.select(
        syntax.identifiers(t).alias("names"), syntax.type_names(t).alias("types"), syntax.type_names(t, True).alias("more"), syntax.api_refs(t).alias("api"), syntax.param_refs(t).alias("params"), syntax.super_refs(t).alias("supers"),
        syntax.surface_view(s, t, F.lit(False), used).alias("surface"), syntax.results_view(s, t, F.lit(True)).alias("results"), syntax.with_private_tags(s, t).alias("tagged"), syntax.nested_body(s, t, F.array(F.lit("Outer"), F.lit("Shape"))).alias("nested"),
        syntax.supertype_view(s, t, F.lit(True), used, F.array(F.lit("none()"), F.lit("go(List, String[])"))).alias("supertype"),
    ).collect()
    one = got[0]
    assert {"Hidden", "Fake", "Comment", "List", "Y", "class", "int", "q"} & set(one.names) == {"List", "q"} and {"Outer", "Nonnull", "Old", "make"} <= set(one.names)
    assert set(one.more) - set(one.types) == {"Ref"} and {"Inside", "Init", "Printer", "Dep"} <= set(one.types)
    assert one.api == sorted("Arg ArrayList Bad Dep Foo Has I1 I2 K Kind List Map Point Q R Runnable String Sup Worse Z".split())
    assert one.params == ["Dep", "List", "String", "Z"] and one.supers == ["Arg", "I1", "I2", "K", "Sup"]
    assert one.surface.startswith("@Deprecated public abstract class Outer<T extends Base> extends Sup<Arg> implements I1, I2<K> {\n    public Outer(@Nonnull final Dep dep, int... rest) throws Bad, Worse { /* body omitted */ }\n}")
    assert one.results is None  # no accessor of its own, and nested types aren't accessors
    assert one.tagged.count(syntax.PRIVATE_TAG) == 4 and one.tagged.replace(syntax.PRIVATE_TAG + " ", "") == SOURCE
    assert one.nested == "interface Shape { int SIDES = 4; double area(); default void show() { Printer.print(this); } }"
    assert one.supertype.split("\n")[1:] == ["    protected int a, b = 3;", "    List<Map<String, Foo[]>> xs = new ArrayList<>();", "    Runnable r = () -> { Inside.run(); };", [x for x in SOURCE.split("\n") if " go(" in x][0], "    abstract void none();", "}"]
    assert got[1].names == [] and got[1].surface is None and got[2].tagged == "" and got[1].nested is None
    assert got[3].surface == "enum E {\n    A, B;\n}"


def test_views_take_any_condition(spark):
    rows = spark.createDataFrame([(SOURCE,)], "s string").select("s", syntax.tree(F.col("s")).alias("t"))
    view = syntax.rendered(F.col("s"), F.col("t"), lambda d: d["name"].isin("Kind", "v", "Inner", "deep", "m") | (d["kind"] == "enum"), lambda d: d["name"] == "deep")
    assert rows.select(view.alias("v")).first().v.split("\n") == [
        "@Deprecated public abstract class Outer<T extends Base> extends Sup<Arg> implements I1, I2<K> {", "    private class Inner {", "        int deep() { return 1; }", "    }",
        "    enum Kind {", "        ONE, TWO(2), @Old THREE;", "        private final int v = 1;", "        Kind() { /* body omitted */ }", "        Kind(int v) { /* body omitted */ }", "    }", "}", "", "class Second {", "    void m() { /* body omitted */ }", "}",
    ]


def test_discovery_is_breadth_first(spark):
    from collections import deque
    import random

    from millrace.operators import graph

    r = random.Random(8)
    lists = {f"n{i}": r.sample([f"n{j}" for j in range(40)], r.randrange(0, 4)) for i in range(40)}

    def found(src):
        order, todo = [], deque(lists[src])
        while todo:
            a = todo.popleft()
            if a not in order and a != src:
                order.append(a)
                todo.extend(lists[a])
        return order

    edges = spark.createDataFrame([(a, b, i) for a, x in lists.items() for i, b in enumerate(x)], "src string, dst string, place int")
    got = {}
    for x in sorted(graph.discovered(edges).collect(), key=lambda x: (x.src, x.depth, x.label)):
        got.setdefault(x.src, []).append(x.dst)
    assert got == {a: found(a) for a in lists if found(a)}
    assert graph.discovered(edges.where("false")).count() == 0 and {x.depth for x in graph.discovered(edges, 2).collect()} == {1, 2}


def test_table_functions(spark):
    from millrace.functions import table_functions

    assert table_functions.register(spark) == list(table_functions.TYPES)
    rows = spark.createDataFrame([(1, "class A {\n  @Test\n  void t() { B b; }\n}"), (2, None), (3, "")], "k int, s string")
    got = spark.sql("SELECT k, d.name, d.first, d.last FROM {r}, LATERAL java_declarations(s) d", r=rows).collect()
    assert sorted(map(tuple, got)) == [(1, "A", 1, 4), (1, "t", 2, 3)]
    assert [tuple(r) for r in spark.sql("SELECT k, t.* FROM {r}, LATERAL java_tests(s) t", r=rows).collect()] == [(1, "t", 2, 3)]
    assert {tuple(r) for r in spark.sql("SELECT n.name, n.kind, n.line FROM {r}, LATERAL java_names(s) n WHERE k = 1", r=rows).collect()} >= {("B", "type", 3), ("b", "name", 3)}
    assert spark.sql("SELECT m.name FROM {r}, LATERAL java_members(s) m", r=rows.where("k > 1")).count() == 0
    assert spark.sql("SELECT k, d.name FROM {r} LEFT JOIN LATERAL java_declarations(s) d ON true", r=rows).count() == 4


def test_strategies_by_name(spark):
    import pytest

    from millrace.operators import strategies

    with pytest.raises(ValueError, match="v9"):
        strategies.retrieved(None, "v9")
    assert set(strategies.STRATEGIES) == {"v1", "v2", "v4", "v5", "v6"} and strategies.DEFAULT in strategies.STRATEGIES


def test_dear_rows_are_dealt(spark, tmp_path):
    """A table in one file of one row group is one task; sources are read in more."""
    from millrace.plans import sources

    spark.range(40).selectExpr("id AS p_partkey", "cast(id % 9 AS int) AS p_size").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    rows = sources._sources(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    assert sources.q_declarations(spark, str(tmp_path)).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    assert rows.select("k").distinct().count() == 40


def test_trees_in_slices(monkeypatch):
    import pyarrow as pa

    texts = [f"class A{i} {{ int f{i}; }}" if i % 3 else None for i in range(7)]
    whole = syntax.trees(pa.array(texts, pa.string()))
    monkeypatch.setattr(syntax, "SLICE", 2)
    assert syntax.trees(pa.array(texts, pa.string())).to_pylist() == whole.to_pylist() and whole[1].as_py()["decls"][1]["name"] == "f1" and whole[0].as_py()["names"] == []
    assert len(syntax.trees(pa.array([], pa.string()))) == 0
