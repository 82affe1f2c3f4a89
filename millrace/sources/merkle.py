"""Digests of trees of files that no one task reads: hash trees over ranges of hashed paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..shared import saved


def leaves(files: DataFrame, root: str = "") -> DataFrame:
    """(path, content) -> (path below root, place: its path's hash in hex, digest of path and content). A null content is an empty one."""
    below = F.when(F.startswith("path", F.lit(root)), F.ltrim(F.substring("path", len(root) + 1, 1 << 30), F.lit("/"))).otherwise(F.col("path")) if root else F.col("path")
    rows = files.select(below.alias("path"), F.coalesce(F.col("content").cast("binary"), F.lit(b"")).alias("content"))
    # both are digests of fixed length, so no path and content can be taken for another pair
    return rows.select("path", F.sha2("path", 256).alias("place"), F.sha2(F.concat(F.sha2("path", 256), F.sha2("content", 256)), 256).alias("digest"))


def depth_for(n: int) -> int:
    """Levels below the root for n files, so that a lowest node holds one or a few."""
    depth = 1
    while 16**depth < n and depth < 12:
        depth += 1
    return depth


def nodes(own: DataFrame, depth: int | None = None) -> DataFrame:
    """leaves() -> the tree's nodes: (level, place: the first `level` hex digits of their paths' hashes, digest, n files).

    A node's digest is that of its children's, in their order: 16 nodes at most, or the few files of a lowest
    node. Each level is a sum over the one below; level 0 is the whole tree, whose digest doesn't depend
    on how files are dealt. An empty tree has no nodes.
    """
    own = saved(own, "leaves")
    depth = depth or depth_for(own.count())
    joined = lambda order: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "digest"))), lambda x: x["digest"]), ""), 256).alias("digest")
    level = own.groupBy(F.substring("place", 1, depth).alias("place")).agg(joined("path"), F.count("*").alias("n"))
    level = out = saved(level.select(F.lit(depth).alias("level"), "place", "digest", "n"), "nodes")
    for d in range(depth - 1, -1, -1):
        above = level.groupBy(F.substring("place", 1, d).alias("up")).agg(joined("place"), F.sum("n").alias("n"))
        level = saved(above.select(F.lit(d).alias("level"), F.col("up").alias("place"), "digest", "n"), "nodes")
        out = out.unionByName(level)
    return out


def tree_digest(tree: DataFrame) -> DataFrame:
    """The whole tree's digest, 16 hex digits, and its number of files; no row for an empty tree."""
    return tree.where("level = 0").select(F.substring("digest", 1, 16).alias("fingerprint"), "n")


def changed(before: DataFrame, after: DataFrame, tree_before: DataFrame, tree_after: DataFrame) -> DataFrame:
    """(path, kind) of files added, removed or changed between two trees of one depth, given as leaves and nodes.

    Levels are compared from the root; only below nodes that differ is the next one looked at, and only the
    files of lowest nodes that differ are compared.
    """
    depth = max((r["level"] for r in tree_before.union(tree_after).groupBy("level").count().collect()), default=0)  # a few levels
    open_ = None
    for level in range(depth + 1):
        at = lambda t, name: t.where(F.col("level") == level).select("place", F.col("digest").alias(name))
        a, b = at(tree_before, "a"), at(tree_after, "b")
        if open_ is not None:
            up = open_.select(F.col("place").alias("up"))
            a, b = (t.join(up, F.substring("place", 1, level - 1) == F.col("up"), "left_semi") for t in (a, b))
        open_ = saved(a.join(b, "place", "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("place"), "changed-nodes")
        if open_.isEmpty():
            break
    under = lambda t, name: t.join(open_.select(F.col("place").alias("up")), F.substring("place", 1, depth) == F.col("up"), "left_semi").select("path", F.col("digest").alias(name))
    both = under(before, "a").join(under(after, "b"), "path", "full").where(~F.col("a").eqNullSafe(F.col("b")))
    return both.select("path", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed").alias("kind"))
