"""Exact ranks and medians, against brute force."""

from __future__ import annotations

import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from millrace.operators import stats


@pytest.mark.parametrize("ordered,buckets", [(1 << 16, 1 << 12), (3, 4)])
def test_ranks(spark, monkeypatch, ordered, buckets):
    monkeypatch.setattr(stats, "ORDERED", ordered)
    monkeypatch.setattr(stats, "BUCKETS", buckets)
    r = random.Random(5)
    rows = [("hot", r.choice([r.gauss(0, 1), 10.0 ** r.randrange(-30, 30), -(2.0 ** r.randrange(90)), 7.0])) for _ in range(600)]
    rows += [(None, float(i % 5)) for i in range(50)] + [("one", 4.0), ("none", None), ("ends", float("inf")), ("ends", float("-inf")), ("ends", 1.0), ("ends", 2.0), ("ends", 3.0), ("ends", 4.0)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(4)
    got = {x.k: tuple(x)[1:] for x in stats.at_ranks(df, "x", {"low": lambda n: n * 0, "p90": lambda n: F.floor(n * 0.9), "top": lambda n: n - 1}, ["k"]).collect()}
    groups = {k: sorted(x for j, x in rows if j == k and x is not None) for k in {k for k, _ in rows}}
    assert got == {k: (v[0], v[int(len(v) * 0.9)], v[-1]) for k, v in groups.items() if v}
    assert stats.at_ranks(df, "x", {"low": lambda n: n * 0}).first().low == float("-inf")
    found = {x.k: (x.m, x.seven) for x in stats.medians(df.where("k <> 'ends' OR k IS NULL"), {"m": F.col("x"), "seven": F.when(F.col("x") == 7, F.col("x"))}, ["k"]).collect()}
    assert found == {k: (median(v), 7.0 if 7.0 in v else None) for k, v in groups.items() if v and k != "ends"}
    assert stats.at_ranks(df.where("false"), "x", {"low": lambda n: n * 0}, ["k"]).count() == 0 and stats.medians(df.where("false"), {"m": F.col("x")}).count() in (0, 1)
    with_nan = spark.createDataFrame([(float(i),) for i in range(20)] + [(float("nan"),)] * 3, "x double")
    assert stats.at_ranks(with_nan, "x", {"a": lambda n: n * 0 + 19}).first().a == 19.0 and stats.at_share(with_nan, "x", 0.5).first().value == 11.0


def test_integers_keep_their_type(spark, monkeypatch):
    monkeypatch.setattr(stats, "ORDERED", 2)
    df = spark.range(1000).select((F.col("id") * 10**15).alias("x"))
    out = stats.at_share(df, "x", 0.9, out="p")
    assert out.schema["p"].dataType.simpleString() == "bigint" and out.first().p == 900 * 10**15
