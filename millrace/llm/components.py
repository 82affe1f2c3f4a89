"""Connected components of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import common


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> (node, root): every node with the least node reachable from it; a null end is no link.

    In each round a node points to the least of its neighbours and itself; pointers are followed to
    their ends by doubling, the ends become nodes and the links between different ones go on. A round
    at least halves the nodes that have links. All rounds are joins and sums with tables written in
    between; nothing is collected. A table of pointers is deleted when the next one is written.
    """
    edges = common.saved(links.select("a", "b").where("a <> b").distinct(), "links")
    labels = None
    while True:
        both = edges.union(edges.select("b", "a"))
        up = table = common.saved(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("up")).withColumnRenamed("a", "node"), "pointers")
        while True:
            far = up.select(F.col("node").alias("n"), F.col("up").alias("far"))
            step = common.saved(up.join(far, F.col("up") == F.col("n")).select("node", F.col("far").alias("up"), (F.col("far") != F.col("up")).alias("moved")), "pointers")
            common.drop(table)
            table, up = step, step.select("node", "up")
            if step.where("moved").isEmpty():
                break
        if labels is None:
            labels = up
        else:
            new = up.select(F.col("node").alias("n"), F.col("up").alias("far"))
            labels = common.saved(labels.join(new, F.col("up") == F.col("n"), "left").select("node", F.coalesce("far", "up").alias("up")), "labels")
        a, b = up.select(F.col("node").alias("a"), F.col("up").alias("ra")), up.select(F.col("node").alias("b"), F.col("up").alias("rb"))
        edges = common.saved(edges.join(a, "a").join(b, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "links")
        if edges.isEmpty():
            return labels.select("node", F.col("up").alias("root"))
