"""Functions and operators on literal rows."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from millrace.functions import java, scoring, text
from millrace.operators import attribution, audit, graph, reports, routing, stats
from millrace.sources import reports as xml, schemas, tables
from millrace.streaming import ingest

WIDGET = """package org.example;

import org.junit.Test;

public class WidgetTest {
    private int helper() { return 1; }

    @Test
    public void firstIsFine() {
        assertEquals("} {", 1, helper());
    }

    // @Test is mentioned
    @Deprecated
    @Test(expected = IllegalStateException.class)
    public void secondIsBroken() throws Exception {
        new Widget().go(); // }
    }
}
"""


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("r")).first()["r"]


@pytest.mark.parametrize("x, want", [("a\n```java\npackage p;\nclass A {}\n```\nb", "package p;\nclass A {}\n"), ("```java\nclass A", "```java\nclass A"), ("none", "none"), ("```\nint a;\n```x```\nlonger part here\n```", "longer part here\n"), ("```class A {}```", "class A {}")])
def test_strip_fence(spark, x, want):
    assert one(spark, x, text.strip_fence) == want


def test_fences(spark):
    assert one(spark, "```java\nclass A {", text.strip_fence_lenient) == "class A {\n"
    assert one(spark, "```java\n```", text.strip_fence_lenient) == ""
    assert one(spark, one(spark, "package p;\nclass A {}  \n", text.fenced), text.strip_fence_lenient) == "package p;\nclass A {}\n"


def test_names(spark):
    assert one(spark, WIDGET, text.qualified_name) == "org.example.WidgetTest"
    assert one(spark, "int x;", text.qualified_name) is None and one(spark, "enum E {}", text.qualified_name) == "E"
    assert one(spark, "a/src/main/java/p/A.java", text.class_key) == "p/A" and one(spark, "a/src/test/java/p/A.java", text.is_implementation) is False
    assert one(spark, "p.A$B", text.simple_name) == "B"


def test_counts(spark):
    assert one(spark, WIDGET, text.count_tests) == 2
    assert one(spark, WIDGET, text.count_assertless) == 1  # the comment's part
    assert one(spark, WIDGET, text.is_balanced) is True and one(spark, 'f("(");', text.is_balanced) is True and one(spark, "f((", text.is_balanced) is False
    assert one(spark, "x }\n ", text.looks_terminated) is True and one(spark, "x {", text.looks_terminated) is False
    assert one(spark, "a\r\nb\x0bc\n", text.lines) == ["a", "b", "c"] and one(spark, "", text.lines) == []
    assert one(spark, "x\n// c\n  /* d\n * e\ny // z\n#### // kept\n", text.without_comments) == "x\ny \n#### // kept"
    assert one(spark, "ab\n\n// c\nd", text.prompt_chars) == 5
    assert one(spark, "a /* b */ c // d\n e", text.normalized) == "ace"
    assert one(spark, "a\nb", text.numbered) == "1 | a\n2 | b"
    assert one(spark, "{@link A} and @see b.C and {@link A}", text.doc_links) == ["A"]
    assert one(spark, "x" * 20, lambda c: text.tail(c, 5)) == "xxxxx"
    assert one(spark, '[{"type":"text","text":"a"},{"type":"text","text":"b"}]', text.content_text) == "ab"


def test_spans(spark):
    assert [tuple(s) for s in one(spark, WIDGET, java.test_spans)] == [("firstIsFine", 8, 11), ("secondIsBroken", 14, 18)]
    left = one(spark, WIDGET, lambda x: java.drop_tests(x, F.array(F.lit("secondIsBroken"))))
    assert "firstIsFine" in left and "secondIsBroken" not in left and set(left.split("\n")) <= set(WIDGET.split("\n"))
    assert one(spark, WIDGET[: WIDGET.index("new Widget")], java.truncate_to_last_member).endswith("    }\n}\n")
    twice = WIDGET.replace("secondIsBroken", "firstIsFine")
    got = one(spark, twice, java.deduplicate_tests)
    assert got["removed"] == 1 and got["source"].count("firstIsFine") == 1 and one(spark, WIDGET, java.deduplicate_tests)["removed"] == 0


def test_edits(spark):
    edit = lambda *e: lambda x: java.replace_lines(x, F.array(*[F.struct(F.lit(r).alias("range"), F.lit(t).alias("text")) for r, t in e]))
    assert one(spark, "a\nb\nc\nd", edit(("4", "D"), ("1-2", "x\ny\nz")))["text"] == "x\ny\nz\nc\nD"
    assert one(spark, "a\nb", edit(("1:2", ""), ("2", "x")))["error"] and one(spark, "a", edit(("2", "x")))["error"] and one(spark, "a", edit(("z", "x")))["error"]
    assert "void more()" in one(spark, WIDGET, lambda x: java.append_test(x, F.lit("    @Test void more() {}")))["text"]
    assert one(spark, WIDGET, lambda x: java.append_test(x, F.lit(" ")))["error"]
    got = one(spark, WIDGET, lambda x: java.add_imports(x, F.array(F.lit("a.B"), F.lit("org.junit.Test"))))["text"]
    assert got.count("import org.junit.Test;") == 1 and "import org.junit.Test;\nimport a.B;" in got
    assert "fresh" in one(spark, WIDGET, lambda x: java.replace_test(x, F.lit("firstIsFine"), F.lit("@Test void fresh() {}")))["text"]


def test_disassembly(spark):
    listing = 'public class p.A extends p.B {\n  private int n;\n  public p.A(java.util.Map<java.lang.String, p.C>, int);\n    Code:\n       0: new           #1 // class p/C\n       3: invokespecial #2 // Method p/C."<init>":()V\n  protected static p.D make() throws java.io.IOException;\n    Code:\n       0: invokestatic #3 // Method p/E.of:()Lp/D;\n}\n'
    a, b, c = one(spark, listing, java.class_members)
    assert (a["kind"], b["kind"], c["kind"]) == ("field", "ctor", "method")
    assert b["params"] == ["java.util.Map", "int"] and b["news"] == ["p.C"] and c["throws"] == ["java.io.IOException"] and c["static"] and c["returns"] == "p.D"
    assert [tuple(x) for x in c["calls"]] == [("p.E", "of")]


OUTPUT = "[ERROR] /x/WidgetTest.java:[17,9] cannot find symbol\n  symbol:   class Widget\n  location: class org.example.WidgetTest\n[ERROR] /x/WidgetTest.java:[17,9] cannot find symbol\n[ERROR] /x/A.java:[2,1] method go in class p.Q cannot be applied to given types\n"


def test_compiler_errors(spark):
    assert [(e["row"], e["message"]) for e in one(spark, OUTPUT, text.javac_errors)] == [(17, "cannot find symbol"), (2, "method go in class p.Q cannot be applied to given types")]
    assert one(spark, OUTPUT, text.misused_types) == ["Widget", "p.Q"]
    assert [one(spark, m, text.error_kind) for m in ("cannot find symbol", "x has private access in Y", "no suitable constructor", "unreported exception E", "?")] == ["missing symbol", "access violation", "wrong signature/type", "uncaught checked exception", "other"]


# scores

BASE = {"status": "OK", "compiled": True, "tests_run": 5, "tests_passed": 5, "tests_failed": 0, "branch_coverage_pct": 60.0, "line_coverage_pct": 60.0, "n_branches": 20, "mutation_score_pct": None, "green_subset_mutation_score_pct": None,
        "n_tests_clean": 5, "n_tests_broken": 0, "n_skeleton_errors": 0, "n_compile_errors": 0, "attribution_available": True, "salvaged": False, "salvaged_tests_run": 0, "salvaged_tests_passed": 0, "salvaged_tests_failed": 0,
        "salvaged_branch_coverage_pct": None, "salvaged_line_coverage_pct": None, "salvaged_n_branches": None, "salvaged_mutation_score_pct": None}
KINDS = {str: "string", bool: "boolean", int: "int", float: "double", type(None): "double"}


def scored(spark, *changes):
    rows = [BASE | c for c in changes]
    ddl = ", ".join(f"{k} {'int' if k == 'salvaged_n_branches' else KINDS[type(v)]}" for k, v in BASE.items())
    df = spark.createDataFrame([tuple(r.values()) for r in rows], ddl)
    return df.select(scoring.quality().alias("q"), scoring.quality(True).alias("g"), scoring.quality_2().alias("v2"), scoring.fraction().alias("fraction"), scoring.Suite().coverage.alias("coverage"), scoring.kills_a_mutant().alias("kills")).collect()


def test_scores(spark):
    failing = {"status": "COMPILE_FAIL", "compiled": False, "tests_run": 0, "tests_passed": 0, "n_compile_errors": 3}
    r = scored(
        spark, {"branch_coverage_pct": 100.0, "line_coverage_pct": 15.0, "n_branches": 0}, {"branch_coverage_pct": 0.0, "line_coverage_pct": 0.0}, {"branch_coverage_pct": 0.0, "line_coverage_pct": 40.0, "tests_run": 4, "tests_passed": 4},
        {"branch_coverage_pct": 100.0, "line_coverage_pct": 100.0, "mutation_score_pct": 100.0}, {"mutation_score_pct": 80.0}, {},
        failing | {"n_tests_clean": 2, "n_tests_broken": 2}, failing | {"n_tests_clean": 2, "n_tests_broken": 2, "salvaged": True, "salvaged_tests_run": 2, "salvaged_tests_passed": 1, "salvaged_tests_failed": 1, "salvaged_mutation_score_pct": 80.0},
        failing | {"n_tests_clean": 8, "n_compile_errors": 0}, {"status": "INFRA_ERROR"},
    )
    assert r[0]["coverage"] == 15 and r[1]["g"] > 0.5 and r[1]["v2"] == 0 and r[2]["v2"] == 0.4 and r[3]["v2"] == 1.0
    assert r[4]["v2"] - r[5]["v2"] == pytest.approx(0.4 * 0.8) and r[4]["kills"] and not r[5]["kills"]
    assert r[6]["g"] == pytest.approx(0.2) and r[6]["q"] == 0 and r[7]["g"] == pytest.approx(0.3) and r[8]["fraction"] == 0 == r[8]["g"]
    assert r[9]["q"] is None and r[9]["g"] is None and r[9]["v2"] is None
    falling = [x["g"] for x in scored(spark, *[failing | {"n_tests_broken": b} for b in range(1, 8)])]
    assert falling == sorted(falling, reverse=True) and len(set(falling)) == 7 and falling[0] < min(x["g"] for x in scored(spark, {"tests_passed": 0, "tests_failed": 5, "branch_coverage_pct": 0.0}))


def test_router(spark):
    rows = [(False, None, 0, None, None, None, "test_repair_node"), (True, False, 3, None, 0, None, "faulty_test_cleanup_node"), (True, True, 0, 100.0, 0, False, "class_advancer_node"), (True, True, 0, 50.0, 0, False, "mutation_test_writer_node"), (True, True, 0, 50.0, 2, False, "class_advancer_node"), (True, True, 0, 50.0, 2, True, "mutation_test_writer_node"), (True, True, 0, 50.0, 5, True, "class_advancer_node")]
    df = spark.createDataFrame(rows, "c boolean, g boolean, r int, m double, n int, i boolean, want string")
    assert df.where(scoring.next_step(*[F.col(c) for c in "cgrmni"], max_repairs=3, max_rounds=5) != F.col("want")).count() == 0


# reports

MUTATIONS = "<mutations>" + "".join(f"<mutation status='{s}'><mutatedClass>p.A</mutatedClass><mutatedMethod>m</mutatedMethod><lineNumber>{i}</lineNumber><description>d</description></mutation>" for i, s in enumerate(["KILLED", "survived", "NON_VIABLE", "MEMORY_ERROR"])) + "</mutations>"
COVERAGE = '<?xml version="1.0"?><!DOCTYPE report PUBLIC "x" "report.dtd"><report name="r"><package name="p"><class name="p/Target" sourcefilename="Target.java"><method name="m" line="3"><counter type="LINE" missed="1" covered="4"/></method><counter type="BRANCH" missed="2" covered="8"/><counter type="LINE" missed="1" covered="3"/></class><class name="p/Other"><counter type="BRANCH" missed="90" covered="0"/></class><class name="p/Plain"><counter type="METHOD" missed="1" covered="0"/></class><sourcefile name="Target.java"><line nr="1" mi="1" ci="0" mb="0" cb="0"/><line nr="2" mi="0" ci="2" mb="1" cb="1"/></sourcefile></package><counter type="BRANCH" missed="92" covered="8"/></report>'
SUITE = '<testsuite name="p.ATest" tests="10" failures="1" errors="2" skipped="3"><testcase name="a[1]" classname="p.ATest"><failure message="x">t</failure></testcase><testcase name="a[2]" classname="p.ATest"><error message="y"/></testcase><testcase name="b" classname="p.ATest"/></testsuite>'


def test_reports(spark):
    files = lambda *c: spark.createDataFrame([(f"/t/TEST-p.{i}.xml", x) for i, x in enumerate(c)], "path string, content string")
    m = xml.mutations(files(MUTATIONS, "<mutations><mut"))
    assert [(r["mutation_pct"], r["n_mutants"]) for r in reports.mutation_score(m, ["path"]).collect()] == [(50.0, 2)]
    assert reports.actionable(m, ["path"]).first()["lines"] == ["SURVIVED m 1 d"] and {r["status"]: r["count"] for r in reports.status_counts(m, ["path"]).collect()}["KILLED"] == 1
    c = xml.counters(files(COVERAGE))
    got = {r["class"]: r for r in reports.class_coverage(c, ["path"]).collect()}
    assert got["p.Target"]["branch_pct"] == 80 and got["p.Target"]["line_pct"] == 75 and got["p.Target"]["n_branches"] == 10 and got["p.Plain"]["branch_pct"] == 100 == got["p.Plain"]["line_pct"]
    assert {r["class"]: r["line_pct"] for r in reports.class_coverage(c, ["path"], 0.0).collect()}["p.Plain"] == 0
    assert reports.pooled_branch(c, ["path"]).first()["branch_pct"] == 8.0
    assert tuple(reports.uncovered(xml.lines(files(COVERAGE)), ["path"]).first())[1:] == ([1], [2])
    assert "m misses 1" in {r["class"]: r["summary"] for r in reports.summary(c, xml.methods(files(COVERAGE)), ["path"]).collect()}["p.Target"]
    s = xml.suites(files(SUITE, "not xml"))
    assert tuple(reports.test_counts(s, ["path"]).first())[1:] == (7, 4, 3) and tuple(reports.test_counts(s, ["path"], harness=True).first())[1:] == (10, 4, 3)
    assert [r["name"] for r in xml.failing_tests(files(SUITE)).collect()] == ["a"] and xml.of_class(files(SUITE), "p.0").count() == 1
    with pytest.raises(Exception):
        xml.suites(files("not xml"), strict=True).collect()


# graph


def test_closure_with_cycle_and_diamond(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("e", "b"), ("x", "x")], "src string, dst string")
    got = {(r["src"], r["dst"]): r["depth"] for r in graph.closure(edges).collect()}
    assert got[("a", "e")] == 3 and got[("a", "d")] == 2 and got[("e", "d")] == 2 and ("x", "x") not in got and len(got) == 4 + 3 + 3 + 3 + 3 - 3


def index_row(name, kind="class", **lists):
    names = ["extends", "implements", "ctor_params", "method_params", "returns", "throws", "fields", "instantiates", "references"]
    return (name, kind, *[lists.get(n, []) for n in names], lists.get("calls", {}))


def test_class_graph(spark):
    ddl = "class string, kind string, " + ", ".join(f"{n} array<string>" for n in ["extends", "implements", "ctor_params", "method_params", "returns", "throws", "fields", "instantiates", "references"]) + ", calls map<string,array<string>>"
    index = spark.createDataFrame([
        index_row("I", "interface", method_params=["P"]), index_row("Base", "abstract", implements=["I"], returns=["R"]), index_row("A", extends=["Base"], ctor_params=["P"], references=["U", "zzz"]), index_row("B", extends=["A"]),
        index_row("P", "interface", ctor_params=[]), index_row("PImpl", implements=["P"]), index_row("R", returns=["S"]), index_row("S"), index_row("U"), index_row("Maker"),
    ], ddl)
    ancestors = graph.closure(graph.supertypes(index))
    inverse, api = graph.inversions(index, ancestors), graph.inherited_api(index, ancestors)
    inv = {r["class"]: r for r in inverse.collect()}
    assert inv["I"]["implemented_by"] == ["A", "B"] and inv["Base"]["extended_by"] == ["A"] and inv["P"]["implemented_by"] == ["PImpl"] and inv["U"]["referenced_by_count"] == 1
    assert {r["class"]: r["returns"] for r in api.collect()}["A"] == ["R"]
    built = spark.createDataFrame([("A", "Maker", ["make()"])], "target string, class string, entries array<string>")
    got = {r["fqn"]: (r["pattern"], r["hops"]) for r in graph.class_walk(index, ancestors, inverse, api, built).where("cut = 'A'").collect()}
    assert got == {"P": ("own_surface", 1), "Maker": ("producers", 1), "R": ("inherited_api", 1), "Base": ("supertype", 1), "I": ("supertype", 1), "PImpl": ("implementations", 2), "B": ("subclasses", 1), "S": ("results", 2), "U": ("used_privately", 1)}


def test_overrides_and_resolution(spark):
    members = spark.createDataFrame([("A", "m", "method", "public", False, ["int"], ""), ("I", "m", "method", "public", False, ["int"], ""), ("Base", "m", "method", "private", False, ["int"], ""), ("I", "n", "method", "public", False, [], "")], "class string, name string, kind string, visibility string, static boolean, params array<string>, declared_in string")
    reach = spark.createDataFrame([("A", "Base", 1), ("A", "I", 2)], "src string, dst string, depth int")
    got = {(r["class"], r["name"]): r["overrides"] for r in graph.overrides(members, reach).collect()}
    assert got[("A", "m")] == "I" and got[("I", "n")] is None
    assert [(r["name"], r["declared_by"]) for r in graph.not_overridden(members, reach).collect()] == [("n", "I")]
    uses = spark.createDataFrame([("f", "X"), ("f", "Y"), ("f", "Z")], "file string, name string")
    candidates = spark.createDataFrame([("f", "X", 0, "lib.X"), ("f", "X", 1, "p.X"), ("f", "Y", 1, "p.Y"), ("f", "Y", 2, "q.Y"), ("f", "Z", 3, "q.Z")], "file string, name string, prio int, fqn string")
    classes = spark.createDataFrame([("p.X",), ("q.Y",), ("q.Z",)], "class string")
    assert {r["name"]: r["fqn"] for r in graph.resolved(uses, candidates, classes).collect()} == {"X": None, "Y": "q.Y", "Z": "q.Z"}


def test_producers(spark):
    news = spark.createDataFrame([("F", "make", "T"), ("F", "hidden", "T"), ("T", "self", "T")], "class string, member string, target string")
    members = spark.createDataFrame([("F", "make", "public", "T make()"), ("F", "hidden", "private", "T hidden()"), ("Base", "entry", "public", "T entry()"), ("T", "self", "public", "T self()")], "class string, member string, visibility string, decl string")
    calls = spark.createDataFrame([("Base", "entry", "F", "hidden"), ("Other", "x", "F", "hidden")], "caller string, member string, owner string, name string")
    lineage = spark.createDataFrame([("F", "F"), ("F", "Base")], "class string, of string")
    assert [tuple(r) for r in graph.producers(news, calls, members, lineage).collect()] == [("T", "F", ["T entry()", "T make()"])]


# routing, attribution, audits


def test_attribution(spark):
    spans = spark.createDataFrame([("s", "a", 1, 5), ("s", "b", 7, 9)], "suite string, name string, start int, end int")
    errors = spark.createDataFrame([("s", 3), ("s", 5), ("s", 6), ("t", 1)], "suite string, row int")
    got = {r["suite"]: r for r in attribution.attribute_errors(errors, spans).collect()}
    assert (got["s"]["broken"], got["s"]["n_skeleton_errors"], got["s"]["n_errors"]) == (["a"], 1, 3) and got["t"]["broken"] == []


def test_routing(spark):
    scores = spark.createDataFrame([("k", 0, 0.5), ("k", 1, None), ("j", 0, 0.1)], "key string, rollout int, q double")
    over = spark.createDataFrame([("k", 0, 0.9, "x")], "key string, rollout int, q double, extra string")
    rows = {(r["key"], r["rollout"]): (r["q"], r["extra"]) for r in routing.overlay(scores, over, ["key", "rollout"]).collect()}
    assert rows == {("k", 0): (0.9, "x"), ("k", 1): (None, None), ("j", 0): (0.1, None)}
    log = spark.createDataFrame([("r", i, g, m) for i, (g, m) in enumerate([(False, None), (True, "40.0"), (True, "55.0"), (False, "None")])], "run string, seq int, green boolean, mutation string")
    last = routing.last_where(log, ["run"], "seq", F.col("green"), "seq", "mutation").first()
    assert (last["seq"], last["mutation"]) == (2, "55.0")
    none = spark.createDataFrame([], "k string, tokens int")
    assert routing.caps(spark.createDataFrame([("p", 100)], "k string, prompt_tokens int"), none, "k", 32768).first()["max_tokens"] == 8256
    turns = routing.rotation(spark.createDataFrame([(1,)], "idx int"), ["a", "b", "c"]).orderBy("turn").collect()
    assert [r["arm"] for r in turns] == ["b", "c", "a"]


def test_audit(spark):
    t = lambda *r: spark.createDataFrame([("s", *x) for x in r], "suite string, name string, body string, pos int")
    got = {r["name"]: (r["kind"], r["interleaved"]) for r in audit.suite_difference(t(("a", "1", 0), ("b", "2", 1), ("c", "3", 2)), t(("a", "1", 0), ("n", "9", 1), ("b", "x", 2), ("m", "8", 3)), ["suite"]).collect()}
    assert got == {"a": ("unchanged", False), "b": ("modified", False), "c": ("removed", False), "n": ("added", True), "m": ("added", False)}
    c = spark.createDataFrame([("x", "p", True, 10), ("x", "p", False, 5)], "cut string, pattern string, needed boolean, chars int")
    stat = {r["pattern"]: r for r in audit.pattern_stats(c, spark.createDataFrame([("x",), ("y",), ("z",)], "cut string"), ["p", "q"]).collect()}
    assert stat["p"]["chars"] == 15 and stat["p"]["median_chars"] == 0 and stat["q"]["n"] == 0


def test_rollout_stats_empty_group(spark):
    rows = spark.createDataFrame([("k", False, True, True, True, 3, 10.0, None, 0.5)], "class_key string, usable boolean, compiled boolean, is_green boolean, terminated boolean, n_tests int, line_coverage_pct double, mutation_score_pct double, quality double")
    r = stats.rollout_stats(rows).first()
    assert r["rollouts"] == 1 and r["usable"] == 0 and r["compiled_pct"] is None and r["prompts"] == 0


# sources and streams


def test_tables(spark, tmp_path):
    p = tmp_path / "log" / "a.jsonl"
    p.parent.mkdir()
    p.write_text('{"run_id": "r", "mutation": "None", "suite_green": true}\n\n{"run_id": "r", "mutation": 55.0, "other": 1}\n')
    rows = tables.read_log(spark, str(p.parent), schemas.RUN_LOG).orderBy("seq").collect()
    assert [(r["seq"], r["mutation"], r["suite_green"]) for r in rows] == [(0, "None", True), (2, "55.0", None)]
    assert tables.read_table(spark, str(tmp_path / "none"), "scores").count() == 0 and tables.read_checkpoint(spark, str(tmp_path / "none")).first()["class_index"] == 0
    tables.write_dataset(spark.createDataFrame([("i", "o")], "instruction string, output string"), tmp_path.as_uri(), "round_1")
    assert json.loads((tmp_path / "dataset_info.json").read_text())["round_1"]["columns"]["response"] == "output"
    assert tables.read_jsonl(spark, f"{tmp_path.as_uri()}/round_1", schemas.SFT).first().asDict() == {"instruction": "i", "input": "", "output": "o"}
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "A.java").write_text("class A {}\n")
    files = tables.read_sources(spark, str(tmp_path / "src"))
    assert files.first()["content"] == "class A {}\n" and len(tables.fingerprint(files).first()["fingerprint"]) == 16


def test_ingest_once(spark, tmp_path):
    src, out = tmp_path / "in", f"{tmp_path}/out"
    src.mkdir()
    for n in range(2):
        (src / f"{n}.json").write_text("".join(json.dumps({"k": i, "v": n}) + "\n" for i in range(3 + n)))
        ingest.ingest(spark, str(src), "k long, v long", out, ["k"], f"{tmp_path}/check").awaitTermination()
    assert sorted(map(tuple, ingest.read_ingested(spark, out).collect())) == [(0, 0), (1, 0), (2, 0), (3, 1)]
    again = spark.createDataFrame([(3, 9), (4, 9), (4, 8)], "k long, v long")
    for _ in range(2):  # a batch that runs again replaces its own rows
        ingest.append_new(again, out, ["k"], 7)
    ingest.append_new(again, out, ["k"])
    assert sorted(map(tuple, ingest.read_ingested(spark, out).collect())) == [(0, 0), (1, 0), (2, 0), (3, 1), (4, 8)]


def test_index_with_header(spark, tmp_path):
    rows, path = spark.createDataFrame([("a.B", 1)], "class string, n int"), f"{tmp_path}/index"
    assert tables.read_index(spark, path, "class string, n int") is None
    tables.write_index(rows, path, "abc", "proj")
    assert tables.read_index(spark, path, "class string, n int", "abc").collect() == rows.collect() == tables.read_index(spark, path, "class string, n int").collect()
    assert tables.read_index(spark, path, "class string, n int", "other") is None


def test_sources_reports_and_checkpoints(spark, tmp_path):
    from millrace.sources import reports as report_files

    for p, t in (("m/src/main/java/A.java", "class A {\n}\n"), ("m/src/test/java/ATest.java", "class ATest {}"), ("m/lib/B.java", "class B {}"), ("m/target/site/jacoco/jacoco.xml", "<report name='x'/>"), ("n/jacoco.xml", "<report/>"), ("m/TEST-p.ATest.xml", "<testsuite/>")):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    files = tables.read_implementation(spark, str(tmp_path))
    assert [r["path"].rsplit("/", 1)[-1] for r in files.collect()] == ["A.java"]
    assert files.select(tables.doubled(F.col("content"))).first()[0] == "class A {\n\n}\n"
    assert [r["place"] for r in sorted(tables.in_path_order(tables.read_sources(spark, str(tmp_path))).collect(), key=lambda r: r["path"])] == [0, 1, 2]
    assert report_files.discovered(spark, str(tmp_path), report_files.COVERAGE).count() == 1 and report_files.discovered(spark, str(tmp_path), report_files.SUITE, newest_only=True).count() == 1
    assert tables.clear_reports(spark, [f"{tmp_path}/m/target/site/jacoco", f"{tmp_path}/none"]) == 1 and not (tmp_path / "m/target/site/jacoco").exists()
    start = tables.read_checkpoint(spark, f"{tmp_path}/check")
    tables.write_checkpoint(start.withColumn(start.columns[0], F.lit(4)), f"{tmp_path}/check")
    assert tables.read_checkpoint(spark, f"{tmp_path}/check").first()[0] == 4


def test_java_structure(spark):
    from millrace.functions import java

    src = 'package a;\nclass Q {\n  Q(int a) { x(a); }\n\n  // note\n  @Deprecated\n  @Test(expected = E.class)\n  void t1() throws A {\n    if (f > 1) { g("}"); }\n  }\n  static <T> List<T> h(Map<K, V> m) { return null; }\n  void testTwo() { }\n}\n'
    assert [(k, n) for k, n, *_ in java.methods_of(src)] == [("constructor", "Q"), ("method", "t1"), ("method", "h"), ("method", "testTwo")]
    name, first, last = java.spans_of(src)[0]
    left = java.without_ranges(src, [java.context_range(src, first, last)])
    assert (name, first, last) == ("t1", 6, 10) and "note" not in left and left.splitlines()[3:5] == ["", "  static <T> List<T> h(Map<K, V> m) { return null; }"]
    assert java.first_break(src) is None and java.first_break(src + "}") == 14 and java.first_break("a(b]") == 1 and java.first_break('f("}");') is None
    df = spark.createDataFrame([(src, "uses h and t1 only")], "s string, u string")
    row = df.select(java.compacted(F.col("s"), F.col("u")).alias("c"), java.suite_members(F.col("s")).alias("m")).first()
    assert row["c"].count("\n...\n") == 1 and [t["name"] for t in row["m"]["tests"]] == ["t1", "testTwo"] and "voidt1" not in row["m"]["other"]
    long = "class A {\n" + "".join(f"  @Test\n  void t{i}() {{ x(); }}\n" for i in range(4000)) + "}\n"
    import time

    began = time.perf_counter()
    assert len(java.spans_of(long)) == 4000 and time.perf_counter() - began < 3


def test_rollout_stats_rounds_as_reported(spark):
    cols = "class_key string, usable boolean, compiled boolean, is_green boolean, terminated boolean, n_tests int, line_coverage_pct double, mutation_score_pct double, quality double"
    rows = spark.createDataFrame([("a", True, True, True, True, 3, 33.333, 1.005, 0.123456), ("a", True, True, False, True, 4, 66.667, None, 0.3), ("b", True, False, False, False, 9, None, None, None)], cols)
    r = stats.rollout_stats(rows).first()
    assert (r["compiled_pct"], r["green_pct"], r["median_line_coverage_compiling"], r["mean_quality"], r["distinct_values_per_prompt"]) == (66.7, 33.3, 50.0, 0.1412, 1.5)


def test_shared_folder(spark, monkeypatch):
    from millrace import shared

    t = shared.saved(spark.range(3).toDF("x"), "t")
    shared.drop(t)
    with pytest.raises(Exception, match="(?i)not.exist|no such file"):
        t.count()
    u = shared.saved(spark.range(3).toDF("x"), "u")
    assert u.count() == 3 and shared.clean(spark) >= 1 and shared.clean(spark) == 0
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, default=None: None)
    monkeypatch.setattr(type(spark.sparkContext), "getCheckpointDir", lambda self: None)
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        shared.shared_dir(spark, "x")


def test_config_and_command(spark, tmp_path, capsys):
    from millrace.__main__ import main
    from millrace.sources import config

    (tmp_path / "env").write_text('# settings\nA=3\n B = "2.5"\n\nC=-1\nD=x\n')
    got = config.layered(spark, str(tmp_path / "env"), {"A": "4"})
    assert config.get_int(got, "A") == 4 and config.get_float(got, "B") == 2.5
    for name, why in (("C", "negative"), ("D", "integer"), ("E", "not set")):
        with pytest.raises(ValueError, match=why):
            config.get_int(got, name)
    assert main([]) == 0 and "q_rollout_stats" in capsys.readouterr().out and main(["q_none", "x"]) == 2
    assert main(["q_rotation", "/root/testdata/sf0.001", "2"]) == 0 and "arm" in capsys.readouterr().out


def test_joins_that_must_hold(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(1, "p")], "k int, w string")
    assert routing.checked_join(a.where("k = 1"), b, ["k"]).count() == 1
    with pytest.raises(Exception, match="nothing for k=2"):
        routing.checked_join(a, b, ["k"]).collect()
    assert routing.single(a, "x", "v").count() == 1
    with pytest.raises(Exception, match="isn't there"):
        routing.single(a, "z", "v").collect()


def test_logs_in_blocks(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    for n in (1, 2):
        (tmp_path / f"logs/{n}.jsonl").write_text("".join(json.dumps({"k": i * n}) + "\n" + "\n" * (i % 50 == 0) for i in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        rows = tables.read_log(spark, str(tmp_path / "logs"), "k long")
        assert tables.numbered_lines(spark, str(tmp_path / "logs")).select(F.spark_partition_id()).distinct().count() > 1
        for n in (1, 2):
            got = sorted((r["seq"], r["k"]) for r in rows.where(F.col("path").endswith(f"{n}.jsonl")).collect())
            assert [k for _, k in got] == [i * n for i in range(3000)] and got[1][0] == 2 and got[-1][0] == 3059
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_fingerprint(spark):
    from hashlib import sha256

    files = [("r/b.class", "two"), ("r/a.class", "one"), ("r/a/c.class", None)]
    df = spark.createDataFrame(files, "path string, content string")
    want = sha256(b"".join(p[2:].encode() + (c or "").encode() for p, c in sorted(files))).hexdigest()[:16]
    assert [r[0] for r in tables.fingerprint(df.repartition(3), "r").collect()] == [want]
    assert tables.fingerprint(df.where("false"), "r").first()[0] == sha256().hexdigest()[:16]
