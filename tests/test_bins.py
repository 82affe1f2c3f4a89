"""Intervals in hierarchical bins, against brute force."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from millrace.operators import attribution


def test_each_span_has_one_smallest_bin(spark):
    r = random.Random(1)
    pairs = [(a, a + r.choice([0, 1, 5, 300, 10**6, 10**12])) for a in [r.randrange(-(10**6), 10**6) for _ in range(300)]] + [(-1, 0), (-(2**63), 2**63 - 1), (7, 7), (1023, 1024)]
    got = spark.createDataFrame(pairs, "s long, e long").withColumn("l", attribution.level_of(F.col("s"), F.col("e"))).withColumn("b", attribution.bin_of(F.col("s"), F.col("l"))).withColumn("c", attribution.bin_of(F.col("e"), F.col("l")))
    for x in got.collect():
        below = x.l - attribution.STEP
        assert x.b == x.c and x.l % attribution.STEP == 0 and (x.l == 0 or x.s >> below != x.e >> below)


def test_by_force(spark):
    r = random.Random(2)
    spans = [(r.choice("hhhk"), i, a, a + r.choice([0, 3, 40, 5000, 10**9])) for i, a in enumerate(r.randrange(-3000, 3000) for _ in range(200))]
    spans += [("h", 900, None, 5), ("h", 901, 5, None), ("h", 902, 9, 4), (None, 903, 0, 10)]
    points = [(r.choice("hhkz"), i, r.randrange(-3500, 3500)) for i in range(300)] + [("h", 998, None), (None, 999, 5)]
    out = attribution.containing(spark.createDataFrame(points, "k string, p int, x int"), spark.createDataFrame(spans, "k string, id int, s int, e long"), "k", "x", "s", "e", F.struct("s", "id"), ["k", "p"], ["id"])
    want = {(k, p, min(((s, i) for q, i, s, e in spans if q is not None and q == k and None not in (s, e, x) and s <= x <= e), default=(0, None))[1]) for k, p, x in points}
    assert {tuple(x) for x in out.collect()} == want


def test_times_and_no_spans(spark):
    t0 = datetime(2024, 3, 10, 1, 0)
    at = lambda n: t0 + timedelta(minutes=n)
    for kind in ("timestamp", "timestamp_ntz"):
        points = spark.createDataFrame([("a", i, at(i * 10)) for i in range(20)], f"k string, p int, x {kind}")
        spans = spark.createDataFrame([("a", 1, at(5), at(35)), ("a", 2, at(60), at(60)), ("a", 3, at(100), at(10_000))], f"k string, id int, s {kind}, e {kind}")
        join = lambda s: {(x.p, x.id) for x in attribution.containing(points, s, "k", "x", "s", "e", F.col("id"), ["p"], ["id"]).collect()}
        assert join(spans) == {(i, 1 if 1 <= i <= 3 else 2 if i == 6 else 3 if i >= 10 else None) for i in range(20)}
        assert join(spans.where("false")) == {(i, None) for i in range(20)}
