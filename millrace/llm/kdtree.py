"""Centroid clustering by kd-tree filtering (operator 12).

Vectors become integers, so every figure is exact. Each partition packs its vectors to pages, and each
page is a kd-tree whose nodes hold their vectors' count, componentwise sums and box. The pages are written
once; a round sends the centroids (a few numbers, whatever the data's size) to all pages and walks each
tree from its root with the centroids that can still be nearest to something in the node's box:

* a centroid goes if another one is strictly nearer to every point of the box, which is told at the
  box's corner farthest towards it; equal distances keep both, so ties are settled by number;
* a node with one centroid left is assigned whole, by its count and sums;
* a leaf resolves the centroids left for it exactly, vector by vector.

Tasks give a count and sums for each centroid, so a round shuffles a few rows a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from . import common

#: Vectors in a page and in a leaf, at most.
PAGE, LEAF = 4096, 32
#: Bound of the components as integers, so that squared distances of up to 2 ** 7 components are longs.
MOST = 1 << 27
#: Below this bound, double precision holds all squared distances of 2 ** 7 components exactly.
_EXACT = 1 << 21


def integers(vectors: DataFrame, width: int, scale: int, vector: str = "embedding") -> DataFrame:
    """vectors with a column `components`, floor(scale * x) for each component x, without the rows that don't have just `width`
    finite components. A component beyond MOST is an error: squared distances wouldn't be longs."""
    v = F.col(f"`{vector}`")
    fits = F.coalesce((F.size(v) == width) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))), F.lit(False))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * scale))
    checked = F.when(F.exists(v, lambda x: F.abs(x.cast("double")) * scale >= MOST), F.raise_error(F.lit(f"a component is beyond {MOST} / {scale}"))).otherwise(whole)
    return vectors.where(fits).select(*[F.col(f"`{c}`") for c in vectors.columns if c.lower() != "components"], checked.cast("array<int>").alias("components"))


class Tree:
    """A page's tree. Nodes are in the order in which they are split; a leaf has no children (-1)."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        self.begin, self.end, self.left = [0], [len(points)], []
        for node in range(1 << 62):
            if node == len(self.begin):
                break
            lo, hi = self.begin[node], self.end[node]
            own = points[self.order[lo:hi]]
            spans = own.max(0) - own.min(0)
            if hi - lo <= leaf or not spans.any():
                self.left.append(-1)
                continue
            half = (hi - lo) // 2
            self.order[lo:hi] = self.order[lo:hi][np.argpartition(own[:, spans.argmax()], half, kind="introselect")]
            self.left.append(len(self.begin))
            self.begin += [lo, lo + half]
            self.end += [lo + half, hi]
        p = points[self.order]
        self.count = np.subtract(self.end, self.begin)
        self.low = np.array([p[b:e].min(0) for b, e in zip(self.begin, self.end)])
        self.high = np.array([p[b:e].max(0) for b, e in zip(self.begin, self.end)])
        self.sums = np.array([p[b:e].sum(0, dtype=np.int64) for b, e in zip(self.begin, self.end)])


_PAGE = "ids array<bigint>, points binary, first array<int>, last array<int>, left array<int>, low binary, high binary, sums binary"


def pages(rows: DataFrame, width: int) -> DataFrame:
    """(vec_id long, components array<int>) -> pages with their trees."""
    common.prepare(rows.sparkSession)
    schema = pa.schema([("ids", pa.list_(pa.int64())), ("points", pa.binary()), ("first", pa.list_(pa.int32())), ("last", pa.list_(pa.int32())), ("left", pa.list_(pa.int32())), ("low", pa.binary()), ("high", pa.binary()), ("sums", pa.binary())])

    def packed(ids: pa.Array, points: np.ndarray) -> pa.RecordBatch:
        t = Tree(points)
        row = [ids.take(pa.array(t.order)).to_pylist(), points[t.order].tobytes(), t.begin, t.end, t.left, t.low.astype(np.int32).tobytes(), t.high.astype(np.int32).tobytes(), t.sums.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, np.ndarray]] = []
        n = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, PAGE):
                part = batch.slice(lo, PAGE)
                held.append((part.column(0), part.column(1).flatten().to_numpy().reshape(-1, width)))
                n += part.num_rows
                while n >= PAGE:
                    ids, points = pa.concat_arrays([x for x, _ in held]), np.concatenate([x for _, x in held])
                    yield packed(ids[:PAGE], points[:PAGE])
                    held, n = [(ids[PAGE:], points[PAGE:])], n - PAGE
        if n:
            yield packed(pa.concat_arrays([x for x, _ in held]), np.concatenate([x for _, x in held]))

    return rows.select("vec_id", "components").mapInArrow(build, _PAGE)


def squared(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all points to all centroids."""
    if len(points) and max(np.abs(points).max(), np.abs(centroids).max()) < _EXACT:
        points, centroids = points.astype(float), centroids.astype(float)
    return ((points * points).sum(1)[:, None] - 2 * (points @ centroids.T) + (centroids * centroids).sum(1)).astype(np.int64)


def undominated(low: np.ndarray, high: np.ndarray, centroids: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """The candidates that may be nearest, ties included, to some point of a box.

    One near the middle is compared with each other one at the corner that favours that other the most:
    if it is strictly nearer even there, the other is nearest to no point of the box.
    """
    own = centroids[candidates]
    middle = low + high  # twice the middle
    best = own[((2 * own - middle) ** 2).sum(1).argmin()]
    corners = np.where(own > best, high, low)
    return candidates[((corners - own) ** 2).sum(1) <= ((corners - best) ** 2).sum(1)]


def walk(page: dict, centroids: np.ndarray):
    """What a page's tree gives: (begin, end, cluster or an array of clusters, distances or None for whole nodes, node)."""
    width = centroids.shape[1]
    table = lambda name, kind: np.frombuffer(page[name], kind).reshape(-1, width).astype(np.int64)
    points, low, high = table("points", np.int32), table("low", np.int32), table("high", np.int32)
    todo = [(0, np.arange(len(centroids)))]
    while todo:
        node, candidates = todo.pop()
        if len(candidates) > 1:
            candidates = undominated(low[node], high[node], centroids, candidates)
        begin, end = page["first"][node], page["last"][node]
        if len(candidates) == 1:
            yield begin, end, int(candidates[0]), points[begin:end], node
        elif page["left"][node] < 0:
            yield begin, end, candidates[squared(points[begin:end], centroids[candidates]).argmin(1)], points[begin:end], node  # the first of equals is the smallest number
        else:
            todo += [(page["left"][node], candidates), (page["left"][node] + 1, candidates)]


def sums_of(paged: DataFrame, centroids: list[list[int]]) -> list[Row]:
    """For each centroid with vectors: cluster, n, sums. One row a centroid comes to the driver."""
    k, width = len(centroids), len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.array(centroids, np.int64)
        n, sums = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for batch in batches:
            for page in batch.to_pylist():
                whole = np.frombuffer(page["sums"], np.int64).reshape(-1, width)
                for begin, end, cluster, points, node in walk(page, at):
                    if isinstance(cluster, int):
                        n[cluster] += end - begin
                        sums[cluster] += whole[node]
                    else:
                        np.add.at(n, cluster, 1)
                        np.add.at(sums, cluster, points)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = paged.mapInArrow(run, "cluster int, n long, sums array<bigint>")
    total: Column = F.array(*[F.sum(F.col("sums")[i]) for i in range(width)])
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), total.alias("sums")).collect()


def assigned(paged: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Every vector's cluster and its squared distance: (vec_id, cluster, distance)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.array(centroids, np.int64)
        for batch in batches:
            for page in batch.to_pylist():
                cluster, distance = np.zeros(len(page["ids"]), np.int32), np.zeros(len(page["ids"]), np.int64)
                for begin, end, own, points, _ in walk(page, at):
                    cluster[begin:end] = own
                    distance[begin:end] = ((points - at[own]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(page["ids"], pa.int64()), pa.array(cluster), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return paged.mapInArrow(run, "vec_id long, cluster int, distance long")


def clustered(rows: DataFrame, k: int = 16, rounds: int = 3, seed: str = "1:") -> DataFrame:
    """(vec_id, components array<int>, of one width) -> vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Centroids start as the k vectors of least sha256 of seed and vec_id; vectors without an id come after
    all others, and repeated ids are ordered by their components. Fewer vectors than k give fewer
    centroids, none give no rows. Repeated rows are clustered each. A centroid without vectors stays.
    """
    spark = rows.sparkSession
    start = rows.select(F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256).alias("h"), "components").orderBy(F.asc_nulls_last("h"), "components").limit(k).collect()
    centroids = [list(r["components"]) for r in start]
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    paged = common.saved(pages(rows, len(centroids[0])), "kd-pages")
    for _ in range(rounds):
        for r in sums_of(paged, centroids):
            centroids[r["cluster"]] = [s // r["n"] for s in r["sums"]]
    done = common.saved(assigned(paged, centroids), "clusters")
    own = {r["cluster"]: r["s"] for r in done.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    figures = spark.createDataFrame([(c, s, sum(own.values()), digests[c]) for c, s in own.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return done.join(F.broadcast(figures), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # a row a centroid


def op12_kdtree_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings of 64 finite components in 16 clusters after 3 rounds."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return clustered(integers(vectors, 64, 64))
