"""Filter interactions and centroid clusters against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import interactions, kdtree
from oracle import difference

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

# operator 11


def replayed(docs, labels):
    """Every order applied document by document."""
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    parts = defaultdict(list)
    for i, t, s in docs:
        t = t or ""
        w = WORD.findall(t)
        f = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        parts[s or ""].append((f, i in good, i in toxic))
    out, shapley = {}, Counter()
    for part, rows in parts.items():
        for order in map("".join, permutations("ABCDE")):
            left = rows
            for step, x in enumerate(order, 1):
                gone, left = [r for r in left if r[0][x]], [r for r in left if not r[0][x]]
                shapley[part, x] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(r[0][x] for r in rows) - len(gone), sum(r[0][x] and sum(r[0].values()) == 1 for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)]
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


ODD = [
    (1, "plain words only", "a"), (2, "plain words only", "b"), (2, "plain words only", "b"), (None, "plain words only", "a"), (None, "plain words only", "a"), (5, None, None), (6, "", ""), (7, "", "a"), (None, None, "a"),
    (8, " ".join(f"w{i}" for i in range(60)), "a"), (9, "again " * 60, "a"), (10, "UPPER " * 60 + "#", "a"), (11, "é\x0b\U0001f600 " * 3000 + "|" * 5, "b"), (12, "A" * 5 + "b" * 95, "c"), (13, "A" * 6 + "b" * 94, "c"), (3, "plain words only", "c"),
]
MARKS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, None, 1), (9, 1, None), (None, 1, 1), (10, 0, 1), (99, 1, 1), (7, None, None)]


def test_interactions_of_odd_rows(spark):
    docs = spark.createDataFrame([(*r, 1, 2) for r in ODD], "doc_id long, text string, source string, n long, Part long")
    labels = spark.createDataFrame(MARKS, "doc_id long, quality int, toxic int")
    got = [tuple(r) for r in interactions.audit(docs, labels).collect()]
    assert len(got) == len(set(got)) and set(got) == replayed(ODD, MARKS)
    assert interactions.audit(docs.where("false"), labels).count() == 0
    assert {r[3] + r[4] >= 0 for r in interactions.audit(docs, labels.where("false")).collect()} == {True}


def test_interactions_over_the_table(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {tuple(r) for r in interactions.op11_filter_interactions(spark, SF).collect()}
    assert got == replayed([(r.doc_id, r.text, r.source) for r in docs.collect()], [(r.doc_id, r.quality, r.toxic) for r in labels.collect()])
    assert difference(spark, SF, interactions.op11_filter_interactions, interactions.ORACLE) == ""


def test_joint_failures_of_other_filters(spark):
    rows = [(random.Random(i).randrange(2), random.Random(i + 999).randrange(2), random.Random(i + 77).randrange(2), 1) for i in range(200)]
    flagged = spark.createDataFrame([("p", *r) for r in rows], "part string, x int, y int, z int, n long")
    n = F.col("n")
    joint = interactions.joint_failures(flagged, ["x", "y", "z"], {"all": n, "good": n * 0, "toxic": n * 0})
    got = {(r.filter_order, r.step): r for r in interactions.by_order(joint, "xyz").collect()}
    assert len(got) == 18 and got["xyz", 3].kept == sum(not any(r[:3]) for r in rows) and got["zyx", 1].removed == sum(r[2] for r in rows)
    assert sum(got[o, 1].shapley for o in ("xyz", "yxz", "zyx")) == 6 * sum(any(r[:3]) for r in rows)
    with pytest.raises(ValueError):
        interactions.joint_failures(flagged, list("abcdefgh"), {"all": n})


# operator 12


def by_hand(rows, width, k, rounds, scale):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]
    at = [c for _, c in start]
    d2 = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min(range(len(at)), key=lambda c: (d2(v, at[c]), c))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[nearest(v)].append(v)
        at = [[sum(x) // len(groups[c]) for x in zip(*groups[c])] if c in groups else at[c] for c in range(len(at))]
    out = [(i, c := nearest(v), d2(v, at[c])) for i, v in kept]
    own = Counter()
    for _, c, d in out:
        own[c] += d
    return Counter((i, c, d, own[c], sum(own.values()), hashlib.sha256(",".join(map(str, at[c])).encode()).hexdigest()) for i, c, d in out)


def test_clusters_over_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert Counter(map(tuple, kdtree.op12_kdtree_clusters(spark, SF).collect())) == by_hand(rows, 64, 16, 3, 64)


def test_clusters_of_odd_rows(spark, monkeypatch):
    r = random.Random(5)
    near = lambda x: [x + r.randrange(-2, 3) for _ in range(3)]
    rows = [(i, near(40.0 * (i % 7))) for i in range(400)] + [(None, [1.0, 2.0, 3.0]), (None, [3.0, 2.0, 1.0]), (7, [1.0, 2.0, 3.0]), (7, [1.0, 2.0, 3.0]), (7, [9.0, 9.0, 9.0])]
    rows += [(500, None), (501, [1.0, 2.0]), (502, [1.0, None, 2.0]), (503, [float("nan"), 0.0, 0.0]), (504, [float("inf"), 0.0, 0.0]), (505, []), (506, [0.0, -0.0, -0.01])] + [(600, [5.0, 5.0, 5.0])] * 300
    frame = lambda x: spark.createDataFrame([(*y, 1, 2) for y in x], "vec_id long, embedding array<float>, cluster int, Components int").repartition(3)
    monkeypatch.setattr(kdtree, "PAGE", 128)
    as_floats = [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    for k, rounds in ((16, 3), (5, 0), (1, 2)):
        assert Counter(map(tuple, kdtree.clustered(kdtree.integers(frame(rows), 3, 2), k, rounds).collect())) == by_hand(as_floats, 3, k, rounds, 2)
    few = kdtree.clustered(kdtree.integers(frame(rows[:3]), 3, 2))
    assert few.count() == 3 and kdtree.clustered(kdtree.integers(frame(rows[:3]).where("false"), 3, 2)).count() == 0
    assert few.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(Exception, match="beyond"):
        kdtree.clustered(kdtree.integers(frame([(1, [1e30, 0.0, 0.0])]), 3, 2)).count()


def test_boxes_lose_no_nearest_centroid():
    r = np.random.default_rng(3)
    whole = 0
    for _ in range(300):
        points, centroids = r.integers(-9, 10, (40, 2)) // r.integers(1, 6) + r.integers(-20, 20), r.integers(-30, 30, (9, 2))
        left = kdtree.undominated(points.min(0), points.max(0), centroids, np.arange(9))
        d = kdtree.squared(points, centroids)
        assert set(np.flatnonzero((d == d.min(1)[:, None]).any(0))) <= set(left)
        assert (d == ((points[:, None] - centroids) ** 2).sum(2)).all()
        whole += len(left) < 9
    assert whole > 100


def test_trees_hold_counts_sums_and_boxes():
    p = np.random.default_rng(4).integers(-100, 100, (1000, 5)).astype(np.int32)
    t = kdtree.Tree(p, 20)
    assert sorted(t.order) == list(range(1000)) and len(t.left) == len(t.begin)
    for b, e, child, n, low, high, sums in zip(t.begin, t.end, t.left, t.count, t.low, t.high, t.sums):
        own = p[t.order[b:e]]
        assert n == e - b and (low == own.min(0)).all() and (high == own.max(0)).all() and (sums == own.sum(0)).all()
        assert n <= 20 if child < 0 else (t.begin[child], t.end[child + 1]) == (b, e)
    big = np.full((2, 3), kdtree.MOST - 1, np.int64)
    assert kdtree.squared(big, -big)[0, 0] == 3 * (2 * kdtree.MOST - 2) ** 2
