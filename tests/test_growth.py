"""Operators whose work must not grow faster than their input: results by force, and what their plans carry."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from millrace.operators import audit, graph, logs
from millrace.plans import classes
from millrace.shared import saved


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_producers_are_told_once_for_all_targets(spark):
    rng = random.Random(3)
    name = lambda p, n: f"{p}{rng.randrange(n)}"
    news = [(name("C", 5), name("m", 3), name("T", 6)) for _ in range(40)] + [("C1", "m1", "C1$In")]
    calls = [(name("C", 5), name("m", 3), name("C", 5), name("m", 3)) for _ in range(60)]
    members = [(f"C{c}", f"m{m}", v, f"{v} C{c}.m{m}{s}") for c in range(5) for m in range(3) for s, v in (("", rng.choice(["public", "private"])), ("x", rng.choice(["public", "package"]))) if s == "" or rng.random() < 0.3]
    lineage = sorted({(f"C{c}", f"C{c}") for c in range(5)} | {(f"C{c}", f"C{c // 2}") for c in range(5)})
    want = {}
    for cls, m, target in news:
        if cls.split("$")[0] == target.split("$")[0]:
            continue
        for c, x, v, d in members:
            if (c, x) != (cls, m):
                continue
            found = {d} if v == "public" else {pd for caller, by, owner, n in calls if n == m and (cls, owner) in lineage and (cls, caller) in lineage for pc, pm, pv, pd in members if (pc, pm, pv) == (caller, by, "public")}
            if found:
                want[target, cls] = want.get((target, cls), set()) | found
    out = graph.producers(spark.createDataFrame(news, "class string, member string, target string"), spark.createDataFrame(calls, "caller string, member string, owner string, name string"), spark.createDataFrame(members, "class string, member string, visibility string, decl string"), spark.createDataFrame(lineage, "class string, of string"), 3)
    assert {(r["target"], r["class"]): r["entries"] for r in out.collect()} == {k: sorted(v)[:3] for k, v in want.items()}
    assert not [x for x in plan(out).split("\n") if "target#" in x and "caller#" in x]


def test_producers_tell_all_entries(spark):
    callers = [f"B{i:02d}" for i in range(12)]
    news = [("F", "hidden", "T"), ("F", "make", "T"), ("F", "make", "U")]
    members = [("F", "hidden", "private", "F.hidden"), ("F", "make", "public", "F.make")] + [(c, "e", "public", f"{c}.e") for c in callers]
    lineage = [("F", c) for c in ["F", *callers]]
    out = graph.producers(
        spark.createDataFrame(news, "class string, member string, target string"), spark.createDataFrame([(c, "e", "F", "hidden") for c in callers], "caller string, member string, owner string, name string"),
        spark.createDataFrame(members, "class string, member string, visibility string, decl string"), spark.createDataFrame(lineage, "class string, of string"),
    )
    assert {r["target"]: r["entries"] for r in out.collect()} == {"T": [f"{c}.e" for c in callers] + ["F.make"], "U": ["F.make"]}
    assert any(r["entries"].count(",") >= 3 for r in classes.q_producers(spark, "/root/testdata/sf0.001").collect())


def test_nearby_looks_at_few_files(spark):
    rng = random.Random(5)
    files = [(rng.choice("ab"), f"/r/d{rng.randrange(4)}/T{rng.randrange(30)}") for _ in range(70)] + [("a", "flat"), ("a", "/r/d0/T1"), (None, "/r/x"), ("a", None), ("c", "/r/d1/alone"), ("d", "/r/d1/T1"), ("d", "/r/d1/T2")]
    targets = files[::3] + [("a", "flat"), ("a", "/r/none/T"), ("d", "/r/d1/T1"), ("zz", "/r/d1/T1")]
    for most in (1, 2, 4):
        want = set()
        for root, target in set(targets) - {(None, "/r/x"), ("a", None)}:
            folder = lambda p: p.rpartition("/")[0]
            found = sorted({(folder(p) != folder(target), p) for r, p in files if r == root and p is not None and p != target})
            want |= {(root, target, p, i) for i, (_, p) in enumerate(found[:most], 1)}
        out = logs.nearby(spark.createDataFrame(files, "root string, path string"), spark.createDataFrame(targets, "root string, path string"), most)
        assert {tuple(r) for r in out.select("root", "target", "path", "place").collect()} == want and out.columns == ["root", "target", "path", "place"]
    # each join with the files of a root or folder stands above the limit of how many there are
    joins = [x for x in plan(out).split("\n") if "Join Inner" in x]
    assert len(joins) == 2 and plan(out).count("WindowGroupLimit") >= 3


def test_walk_over_known_types(spark):
    index = spark.createDataFrame(
        [("A", "class", [], [], ["X", "B"], ["Y", "C"], None, ["Z"], ["B", "Q"], {"B": 1}, ["X"], ["B"]), ("B", "interface", [], [], ["A"], ["C"], ["X", "A"], None, [], {}, [], []), ("C", "class", ["A"], ["B"], ["W"], [], ["C", "V"], [], ["A"], {"V": 2}, ["B"], ["V", "B"])],
        "class string, kind string, extends array<string>, implements array<string>, ctor_params array<string>, method_params array<string>, returns array<string>, throws array<string>, fields array<string>, calls map<string,int>, instantiates array<string>, references array<string>",
    )
    known = graph.known_types(index)
    assert {r["class"]: (r["ctor_params"], r["method_params"], r["returns"], r["throws"], r["fields"]) for r in known.collect()} == {"A": (["B"], ["C"], [], [], ["B"]), "B": (["A"], ["C"], ["A"], [], []), "C": ([], [], ["C"], [], ["A"])}
    reach = graph.closure(graph.supertypes(index))
    walk = lambda i: sorted(map(str, graph.class_walk(i, reach, graph.inversions(i, reach), graph.inherited_api(i, reach)).collect()))
    assert walk(known) == walk(index) and len(walk(index)) > 4


def test_misused_types_tell_lines_once(spark):
    from millrace.functions import text

    out = "[ERROR] /w/A.java:[1,07] cannot find symbol\n  symbol:   class T1\n  location: class Own\n[ERROR] /w/B.java:[02,7]  x has private access in Y\n[ERROR] /w/A.java:[1,7] cannot find symbol\n[ERROR] no place\n"
    df = spark.createDataFrame([(out,), ("",), (None,), ("[ERROR] /w/A.java:[1,7] cannot find symbol",)], "o string").select(text.misused_types(F.col("o")).alias("t"), text.javac_errors(F.col("o")).alias("e"))
    told = [(r["t"], None if r["e"] is None else [tuple(e) for e in r["e"]]) for r in df.collect()]
    assert told[0] == (["T1", "Y"], [("/w/A.java", 1, 7, "cannot find symbol"), ("/w/B.java", 2, 7, "x has private access in Y")])
    assert told[1:] == [([], []), (None, None), ([], [("/w/A.java", 1, 7, "cannot find symbol")])]
    # no lambda splits the text again
    one = plan(df.select("t"))
    assert one.rindex("split(") < one.index("lambdafunction(")


def test_class_listing_is_ordered_by_ranges(spark):
    rng = random.Random(7)
    files = [(f"/w/src/main/java/p{rng.randrange(5)}/C{n}.java", f"public {rng.choice(['final', 'abstract'])} class C{n} {{ }}") for n in (rng.randrange(60) for _ in range(200))]
    out = logs.class_listing(spark.createDataFrame(files, "path string, content string"))
    kept = sorted(p for p, c in files if "abstract" not in c)
    assert sorted((r["idx"], r["path"]) for r in out.collect()) == list(enumerate(kept)) and out.schema["idx"].dataType.simpleString() == "int"
    # the one window over all has a row for each range
    ordered = [x for x in plan(out).split("\n") if "Window " in x and "row_number" in x]
    assert ordered and all("windowspecdefinition(part_" in x for x in ordered)


def test_engagement_is_one_aggregate(spark):
    rng = random.Random(9)
    made = lambda n: [(rng.choice("ab"), rng.randrange(4), rng.randrange(6)) for _ in range(n)]
    errors, used, prompt = made(30), made(30), made(40)  # with equal rows
    want: dict = {}
    for x in set(errors) | set(used):
        place = "class under test" if x[2] == x[1] else "in prompt" if x in prompt else "NOT in prompt"
        n, e, u, never = want.get((x[0], place), (0, 0, 0, 0))
        want[x[0], place] = (n + 1, e + (x in errors), u + (x in used), never + (x in errors and x not in used))
    rows = lambda r: spark.createDataFrame(r, "model string, cut int, type int")
    out = audit.engagement(rows(errors), rows(used), rows(prompt), ["model", "cut"], by=("model",))
    assert {(r["model"], r["place"]): (r["n"], r["n_error"], r["n_used"], r["n_never_fixed"]) for r in out.collect()} == want
    assert "Join" not in plan(out) and plan(out).count("Aggregate") == 2


def test_tokens_are_counted_in_one_pass(spark):
    import pytest

    from millrace.operators import tokens

    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    out = tokens.token_counts(spark.createDataFrame([(1, "a b"), (2, None), (3, "a b")], "doc_id long, text string").coalesce(1), path)
    rows = {r["doc_id"]: r["n_tokens"] for r in out.collect()}
    assert rows[2] is None and rows[1] == rows[3] == 2
    assert not [x for x in ("Join", "Aggregate") if x in plan(out)] and "Repartition" in plan(out)  # dealt to all cores, counted once


def test_discovery_doubles_depths(spark, monkeypatch):
    written = []
    monkeypatch.setattr(graph, "saved", lambda df, tag, f=graph.saved: written.append(tag) or f(df, tag))
    chain = spark.createDataFrame([(i, i + 1, 0) for i in range(20)], "src long, dst long, place int")
    reach = graph.discovered(chain)
    assert sorted((r["src"], r["dst"], r["depth"], len(r["label"])) for r in reach.collect()) == [(a, b, b - a, b - a) for a in range(21) for b in range(a + 1, 21)]
    assert len(written) <= 7 and {r["depth"] for r in graph.discovered(chain, 3).collect()} == {1, 2, 3}


def test_parts_in_proportion_to_files(spark, tmp_path, monkeypatch):
    from millrace import shared

    names = ["spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes"]
    before = {n: spark.conf.get(n, None) for n in names}
    path = str(tmp_path / "t.parquet")
    spark.range(20000).selectExpr("id", "uuid() AS u").repartition(1).write.parquet(path)
    try:
        shared.fit(spark, path)
        assert {n: spark.conf.get(n, None) for n in names} == before  # small: nothing is changed
        monkeypatch.setattr(shared, "PART", 1 << 15)
        shared.fit(spark, path)
        size = sum(f.stat().st_size for f in (tmp_path / "t.parquet").iterdir() if f.name[0] != ".")
        assert int(spark.conf.get(names[0])) == -(-size // (1 << 15)) > 4 and [spark.conf.get(n) for n in names[1:]] == [str(1 << 15), str(1 << 18)]
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_equal_sources_are_read_once(monkeypatch):
    import pyarrow as pa

    from millrace.functions import syntax

    read = []
    monkeypatch.setattr(syntax, "nodes_of", lambda s, f=syntax.nodes_of: read.append(s) or f(s))
    some = ["class A { int b; }", None, "", "class A { int b; }", "x", "x", "x", None, ""]
    got = syntax.trees(pa.array(some, pa.string())).to_pylist()
    assert sorted(read) == ["", "class A { int b; }", "x"]
    read.clear()
    assert got == [syntax.trees(pa.array([s], pa.string())).to_pylist()[0] for s in some]
    assert syntax.trees(pa.array([None, None], pa.string())).to_pylist() == [{"decls": [], "names": []}] * 2 and syntax.trees(pa.array([], pa.string())).to_pylist() == []


def test_comment_lines_are_told_without_stripping(spark):
    from millrace.functions import text

    t = "a // b\n\u3000// c\n \u00a0* d\n/* e\n \t\n#### // f\n x\u2003\n*"
    df = spark.createDataFrame([(t,), ("",), (None,)], "t string").select(text.without_comments(F.col("t")).alias("c"), text.prompt_chars(F.col("t")).alias("n"))
    assert [tuple(r) for r in df.collect()] == [("a \n \t\n#### // f\n x\u2003", len("a // b") + len("#### // f") + len(" x\u2003") + 3), ("", 0), (None, None)]
    assert "\\s+" not in plan(df).replace("\\A\\s*", "")


def test_fingerprint_goes_on_from_task_to_task(spark, monkeypatch):
    from hashlib import sha256

    from millrace.sources import tables

    rng = random.Random(11)
    files = [(f"r/{n:03d}", rng.choice([None, "", "x" * n, "\u00e9" * 70])) for n in rng.sample(range(300), 120)]
    want = sha256(b"".join(p[2:].encode() + (c or "").encode() for p, c in sorted(files))).hexdigest()[:16]
    states = []
    monkeypatch.setattr(tables, "DIGEST_BYTES", 2000)
    monkeypatch.setattr(tables, "saved", lambda df, tag, *by, f=tables.saved: states.append(df.select("part").distinct().count()) or f(df, tag, *by))
    df = spark.createDataFrame(files, "path string, content string")
    assert tables.fingerprint(df, "r").first()[0] == want and states[0] > 3
    one = tables.Sha256()
    one.update(b"a" * 100)
    other = tables.Sha256(one.state.raw)
    other.update(b"b\0c")
    assert other.hexdigest() == other.hexdigest() == sha256(b"a" * 100 + b"b\0c").hexdigest()


def test_what_ancestors_have_goes_to_blocks_of_descendants(spark, monkeypatch):
    rng = random.Random(13)
    index = spark.createDataFrame([(f"C{c}", [f"C{rng.randrange(40)}" for _ in range(3)] if c % 4 else None, [f"T{rng.randrange(9)}"] if c % 3 else []) for c in range(40)], "class string, fields array<string>, returns array<string>")
    reach = sorted({(f"C{rng.randrange(40)}", f"C{rng.randrange(40)}") for _ in range(300)})
    api = {r["class"]: r for r in index.collect()}
    out = graph.inherited_api(index, spark.createDataFrame(reach, "src string, dst string"), ("fields", "returns"))
    want = {s: tuple(sorted({t for a, d in reach if a == s for t in api[d][p] or []} - {s}) for p in ("fields", "returns")) for s, _ in reach}
    assert {r["class"]: (r["fields"], r["returns"]) for r in out.collect()} == want
    # the last shuffle before the sums deals lists to blocks, and carries no class by itself
    physical = out._jdf.queryExecution().executedPlan().toString()
    last = next(x for x in physical.split("\n") if "Exchange" in x)
    assert "hashpartitioning(block" in last and "src" not in last

    monkeypatch.setattr(graph, "FEW", 0)
    chain = spark.createDataFrame([(i, i + 1, 0) for i in range(9)], "src long, dst long, place int")
    many = sorted(map(tuple, graph.closure(chain).collect()))
    monkeypatch.undo()
    assert many == sorted(map(tuple, graph.closure(chain).collect())) == sorted((a, b, b - a) for a in range(10) for b in range(a + 1, 10))


def test_passed_on_tells_pairs_without_signatures_of_shown_ancestors_only(spark):
    members = spark.createDataFrame([("A", "f", "method", "public", ["int"]), ("B", "g", "method", "private", []), ("D", "f", "method", "public", ["int"])], "class string, name string, kind string, visibility string, params array<string>")
    reach = spark.createDataFrame([("C", "A", 1), ("C", "B", 1), ("D", "A", 1), ("D", "B", 2)], "src string, dst string, depth int")
    packages = spark.createDataFrame([(c, "p" if c < "D" else "q") for c in "ABCD"], "class string, package string")
    whole = {(r["src"], r["dst"]): (r["same"], r["signatures"]) for r in graph.passed_on(members, reach, packages).collect()}
    assert {k: len(v[1]) for k, v in whole.items()} == {("C", "A"): 1, ("C", "B"): 0, ("D", "A"): 0, ("D", "B"): 0} and whole["C", "A"][0] and not whole["D", "A"][0]
    for shown in ([], ["B"], ["A", "B", "B"]):
        got = {(r["src"], r["dst"]): (r["same"], r["signatures"]) for r in graph.passed_on(members, reach, packages, spark.createDataFrame([(x,) for x in shown], "dst string")).select("src", "dst", "same", "signatures").collect()}
        assert got == {k: v for k, v in whole.items() if v[1] or k[1] in shown}


def test_closure_of_some_sources_finds_what_the_whole_one_does_with_fewer_pairs(spark, monkeypatch):
    r = random.Random(3)
    chain, tree, cyclic = [(i, i + 1) for i in range(18)], [(i, i // 2) for i in range(2, 200)] + [(i, i // 3) for i in range(3, 200)], [(r.randrange(40), r.randrange(40)) for _ in range(70)]
    for few, edges in ((graph.FEW, tree), (0, chain), (0, cyclic)):
        monkeypatch.setattr(graph, "FEW", few)
        written = []
        monkeypatch.setattr(graph, "saved", lambda df, tag, *by: written.append(out := saved(df, tag, *by)) or out)
        own = {3, 17, 31, 150, 1000}
        e = spark.createDataFrame(edges, "src long, dst long").coalesce(1)
        got = sorted(map(tuple, graph.closure(e, sources=spark.createDataFrame([(s,) for s in own], "src long")).collect()))
        some, n = sum(w.count() for w in written), len(written)
        every = sorted(map(tuple, graph.closure(e).collect()))
        assert got == [x for x in every if x[0] in own] and got
        assert edges is cyclic or some < 0.7 * sum(w.count() for w in written[n:])


def test_inaccessible_asks_only_for_ancestors_of_classes_that_miss_a_name(spark):
    members = spark.createDataFrame(
        [("Base", "p", "method", "protected", None), ("Base", "q", "method", "public", None), ("Base", "r", "method", "package", "In"), ("Base", "Base", "ctor", "protected", None), ("B", "p", "method", "public", "")],
        "class string, name string, kind string, visibility string, declared_in string",
    )
    names = spark.createDataFrame([("A", "p"), ("A", "p"), ("A", "q"), ("B", "p"), ("C", "r"), ("C", "zzz"), ("D", "Base"), ("E", "p")], "class string, name string")
    packages = spark.createDataFrame([("Base", "x"), ("A", "y"), ("B", "y"), ("C", "y"), ("D", "y"), ("E", "x")], "class string, package string")
    reach = spark.createDataFrame([(c, d) for c in "ABCDE" for d in ("Base", "Base$In")], "src string, dst string")
    needed = graph.missed(members, names)
    assert sorted(map(tuple, needed.collect())) == [("A", "p"), ("C", "r"), ("E", "p")]
    want = [("A", "Base", ["p"]), ("C", "Base.In", ["r"])]
    assert sorted(map(tuple, graph.inaccessible(members, reach, packages, names).collect())) == sorted(map(tuple, graph.inaccessible(members, reach, packages, None, needed).collect())) == want


def test_hierarchy_reads_no_lines(spark):
    assert "lineitem" not in classes.hierarchy(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
