"""Rows through a graph of steps, and ids of runs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millrace.operators import routing


def test_rows_go_their_own_ways(spark):
    rows = spark.createDataFrame([(i, i) for i in (1, 2, 3, 7, 16)], "k int, n long")
    n = F.col("n")
    route = F.when(n == 1, "end").when(n % 2 == 0, "half").otherwise("more")
    nodes = {"half": lambda d: d.withColumn("n", F.floor(F.col("n") / 2)), "more": lambda d: d.withColumn("n", 3 * F.col("n") + 1)}
    assert sorted(map(tuple, routing.run_graph(rows, route, nodes).collect())) == [(1, 1, 0), (2, 1, 1), (3, 1, 7), (7, 1, 16), (16, 1, 4)]
    assert routing.run_graph(rows.where("false"), route, nodes).count() == 0
    with pytest.raises(RuntimeError, match="under way"):
        routing.run_graph(rows, route, nodes, most=3)
    with pytest.raises(Exception, match="no node"):
        routing.run_graph(rows, F.when(n == 1, "end"), nodes).count()


def test_run_ids(spark):
    runs = spark.createDataFrame([("a", 1), ("a", 2), (None, 1), ("a", 1)], "p string, n int")
    ids = [r.run_id for r in routing.with_run_ids(runs, ["p", "n"]).collect()]
    assert len(set(ids)) == 3 and ids[0] == ids[3] and all(len(x) == 36 and x[14] == "3" and x.count("-") == 4 for x in ids)
    assert len({r.run_id for r in routing.with_run_ids(runs, ["p"], fresh=True).collect()}) == 4
