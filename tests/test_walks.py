"""The walk by blocks gives what the walk over pairs does, whatever the blocks' and pieces' sizes."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import graph, strategies, walks


def project(spark, n=60, seed=17):
    r = random.Random(seed)
    some = lambda k: [f"C{r.randrange(n + 10)}" for _ in range(r.randrange(k))]  # noqa: E731  # some are no classes of the index
    rows = [(f"C{c}", r.choice(["class", "interface", "abstract", "enum"]), some(2), some(3), some(3), None if c % 7 == 0 else some(4), some(3), some(2), some(3), {t: 1 for t in some(3)}, some(2), some(3)) for c in range(n)]
    index = spark.createDataFrame(rows, "class string, kind string, extends array<string>, implements array<string>, ctor_params array<string>, method_params array<string>, returns array<string>, throws array<string>, fields array<string>, calls map<string,int>, instantiates array<string>, references array<string>")
    built = spark.createDataFrame([(f"C{r.randrange(n + 5)}", f"C{r.randrange(n + 5)}") for _ in range(80)] + [("C1", "C1")], "cut string, fqn string")
    needed = spark.createDataFrame([(f"C{r.randrange(n + 5)}", f"C{r.randrange(n + 5)}") for _ in range(600)], "cut string, fqn string")
    return index, graph.closure(graph.supertypes(index)), built, needed


@pytest.mark.parametrize("block, piece, size", [(1024, 1 << 22, 256), (16, 3, 5)])
def test_walk_by_blocks(spark, monkeypatch, block, piece, size):
    index, reach, built, needed = project(spark)
    inverse, api = graph.inversions(index, reach), graph.inherited_api(index, reach)
    pairs = graph.class_walk(index, reach, inverse, api, built.toDF("target", "class")).join(index.select(F.col("class").alias("cut")), "cut", "left_semi")
    want = {(r["cut"], r["fqn"]): (r["patterns"], r["hops"], r["place"]) for r in graph.in_walk_order(pairs).collect()}
    for name, value in (("BLOCK", block), ("PIECE", piece), ("SLICE", size)):
        monkeypatch.setattr(walks, name, value)
    rows = walks.candidates(index, reach, built).withColumn("hops", walks.hops()).collect()
    names = lambda m: [p for i, p in enumerate(graph.PATTERNS) if m >> i & 1]
    assert {(r["cut"], r["fqn"]): (names(r["mask"]), r["hops"], r["place"]) for r in rows} == want and len(rows) == len(want) > 1000
    marks = {tuple(r) for r in needed.collect()}
    numbers = {}
    for p in want:
        n, hit = numbers.get(p[0], (0, 0))
        numbers[p[0]] = (n + 1, hit + (p in marks))
    assert {r["cut"]: (r["n"], r["n_hit"]) for r in walks.counted(index, reach, built, needed).collect()} == numbers


def test_pairs_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(walks, "BLOCK", 16)
    index, reach, built, needed = project(spark)
    for out in (walks.candidates(index, reach, built), walks.counted(index, reach, built, needed)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.index("MapInArrow") < plan.index("Exchange") and "hashpartitioning(block" in plan[: plan.index("Exchange") + 60]


def test_measured_is_compared(spark):
    index, reach, built, needed = project(spark)
    sources = index.where("class <> 'C5'").select("class", F.concat(F.lit("class "), "class", F.lit(" { "), F.array_join(F.coalesce("fields", F.array()), " a; "), F.lit(" a; }")).alias("source"))
    p = strategies.Project(sources, index, reach, built)
    rows = lambda d: sorted(map(tuple, d.select("strategy", "cut", "n", "n_hit", "n_needed").collect()))
    for names in (("v1", "v4"), ("v5", "v6")):
        assert rows(strategies.measured(p, needed, *names)) == rows(strategies.compared(strategies.retrieved(p, *names), needed)) != []


def test_builders_are_the_pairs_of_producers(spark):
    r = random.Random(5)
    name = lambda p, n: f"{p}{r.randrange(n)}"
    frame = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    args = (
        frame([(name("C", 6), name("m", 3), name("C", 9)) for _ in range(40)], "class string, member string, target string"), frame([(name("C", 6), name("m", 3), name("C", 6), name("m", 3)) for _ in range(60)], "caller string, member string, owner string, name string"),
        frame([(f"C{c}", f"m{m}", v := r.choice(["public", "private", "protected"]), f"{v} C{c}.m{m}") for c in range(6) for m in range(3)], "class string, member string, visibility string, decl string"), frame(sorted({(f"C{c}", f"C{d}") for c in range(6) for d in (c, c // 2, c // 3)}), "class string, of string"),
    )
    pairs = lambda d: sorted(map(tuple, d.select("target", "class").collect()))
    assert pairs(graph.builders(*args)) == pairs(graph.producers(*args)) != []


def test_walk_order_needs_no_window(spark):
    from millrace.plans import classes

    plan = classes.q_walk_order(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Window" not in plan
