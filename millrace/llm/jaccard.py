"""Exact n-gram Jaccard join by R-trees over count vectors (operator 9).

Shingles are hashed into groups; a text's point counts its shingles by group. Two texts share at
most the sum over groups of the smaller count, and two boxes of points at most that of their upper
corners (a longer text has more groups, up to a bound, so that its counts stay small and tell much;
a point of twice as many groups is folded where it meets one of fewer): pairs of boxes, then of points, that cannot share enough are cut off, the rest is verified
on the sets.

One tree over all texts cannot prune: points of unrelated texts of one length lie closer together
than the threshold allows them to differ in a few coordinates. So there is a forest. With shingles
ordered from rare to frequent, two texts that share 80 % have one of the first n - ceil(0.8 n) + 1
shingles of either in common. Each such shingle is, with a class of sizes, the root of a tree that holds
the texts whose count at that coordinate isn't zero, and only trees of two or more texts are built:

1. All texts: the set's size and digest, and counts of all shingles in 2 ** SKETCH_BITS slots, which
   order the shingles (any order gives the same links; frequent ones last gives small trees).
2. The root shingles of each distinct set; those of one set alone go after one shuffle. A size class
   reaches from a size to 100 / LEAST times it, so two similar sets are of one class or of neighbouring
   ones: a set is in the tree of its own class and, as a visitor, in that of the next one. If a root is
   the first shingle that two sets share, they share at most what follows it in either; a root that
   comes too late for a partner of the next class makes no visitor.
3. Each set joins the page of the least set it shares a root with. An R-tree over each page's points
   tells which texts have a partner within the bound; only their sets are fetched, the trees joined
   again with them and the surviving pairs verified. Components are formed from the links.
4. Trees with sets of more than one component remain. Each distinct one is joined in the same way;
   pairs in one component already need no test. Large trees are dealt to blocks. Those outside the
   tree's largest component meet each other and those of that component, each pair of blocks a page;
   so a hot root costs as many pages as pairs of blocks of which one is outside.

Sets are named by 64 bits of a 128-bit digest. If two of different digests have one name, all is done
again with another seed, so names never stand for two sets.

Links within a page are reported as a forest: a pair already joined by other links of its page is
passed over, so a page of m near copies gives m - 1 links after about m tests.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from . import common
from .components import components
from .filters import bit_filter, may_hold
from .shingles import _mixed, shingle_sets

#: Similarity in hundredths.
LEAST = 80
SKETCH_BITS, PIECE = 20, 4096
#: Fewest and most groups of a count vector and the greatest mean count of a group between them (by
#: chance, unrelated texts share two fifths of their bound at a mean of 1, four fifths at 8), points in a
#: leaf, texts in a page (block pairs hold twice as many).
FEWEST, MOST, MEAN, LEAF, PAGE = 64, 1 << 14, 2, 16, 256
#: Shingles (of 8 bytes) for which a set weighs one more in a page, so sets of a page have about PAGE * 8 * HEAVY bytes, 64 MB, at most, or one set more.
HEAVY = 1 << 15
#: Pairs that a page names for each of its points; with more it names the points, so it never makes more
#: rows than it has points. Either way all pairs within the bound are verified.
PAIRS_A_POINT = 1
#: Parts among which the rows of a frequent root are dealt.
SALTS = 64


def needed_overlap(a, b):
    """The least number of shared elements for sets of a and b elements (or, for boxes, their least sizes)."""
    return -(-LEAST * (a + b) // (100 + LEAST))


def root_count(n: int) -> int:
    return n - -(-LEAST * n // 100) + 1


def _size_classes() -> np.ndarray:
    """The least size of each class: the next class begins above 100 / LEAST times it."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(out[-1] * 100 // LEAST + 1)
    return np.array(out, np.int64)


CLASSES = _size_classes()


def root_classes(n: int) -> tuple[int, np.ndarray]:
    """The class of a set of n elements, and for each of its roots in order whether a partner of the next class can follow."""
    at = int(np.searchsorted(CLASSES, n, "right")) - 1
    left = n - np.arange(root_count(n))  # the root and what follows it
    return at, left * (100 + LEAST) // LEAST - n >= CLASSES[at + 1]


def groups(n: int) -> int:
    """The number of groups for a set of n elements: a power of two."""
    g = FEWEST
    while g < MOST and g * MEAN < n:
        g *= 2
    return g


def point(s: np.ndarray) -> np.ndarray:
    """A set's count vector."""
    g = groups(len(s))
    counts = np.bincount((s & np.uint64(g - 1)).astype(np.int64), minlength=g)
    top = int(counts.max())
    return counts.astype("u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4")


def read_point(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // groups(n)}").astype(np.int32)


class RTree:
    """A tree over count vectors, packed by halving along the coordinate of widest spread."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        #: Nodes: upper corner, least size, and either children (two nodes) or the points of a leaf.
        self.upper, self.least, self.inside = [], [], []
        self.root = self._pack(np.arange(len(points)))

    def _pack(self, at: np.ndarray) -> int:
        box = self.points[at]
        if len(at) <= LEAF:
            inside = at
        else:
            axis = int(np.argmax(box.max(0).astype(np.int64) - box.min(0)))
            order = at[np.argsort(box[:, axis], kind="stable")]
            half = len(at) // 2
            inside = (self._pack(order[:half]), self._pack(order[half:]))
        self.upper.append(box.max(0))
        self.least.append(int(self.sizes[at].min()))
        self.inside.append(inside)
        return len(self.inside) - 1

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of points (as two arrays) that may share enough: their bound, and that of all boxes above, allows it."""
        todo = [(self.root, self.root)]
        while todo:
            a, b = todo.pop()
            if a != b and np.minimum(self.upper[a], self.upper[b]).sum() < needed_overlap(self.least[a], self.least[b]):
                continue
            x, y = self.inside[a], self.inside[b]
            if isinstance(x, tuple):
                if a == b:
                    todo += [(x[0], x[0]), (x[0], x[1]), (x[1], x[1])]
                elif isinstance(y, tuple):
                    todo += [(p, q) for p in x for q in y]
                else:
                    todo += [(p, b) for p in x]
            elif isinstance(y, tuple):
                todo += [(a, q) for q in y]
            else:
                bound = np.minimum(self.points[x][:, None, :], self.points[y][None, :, :]).sum(2)
                may = bound >= needed_overlap(self.sizes[x][:, None], self.sizes[y][None, :])
                i, j = np.nonzero(np.triu(may, 1) if a == b else may)
                yield x[i], y[j]


def bounded_pairs(points: list[np.ndarray], sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a page's texts that may share enough, by a tree for each number of groups.

    Each tree holds the points of so many groups and, folded, those of twice as many; pairs of two
    folded ones are left to their own tree. Sizes further apart than that can't be similar.
    """
    own = np.array([len(p) for p in points])
    for g in np.unique(own).tolist():
        at = np.flatnonzero((own == g) | (own == 2 * g))
        if len(at) < 2:
            continue
        folded = np.stack([points[i] if own[i] == g else points[i][:g] + points[i][g:] for i in at.tolist()])
        for x, y in RTree(folded, sizes[at]).pairs():
            x, y = at[x], at[y]
            mine = (own[x] == g) | (own[y] == g)
            yield x[mine], y[mine]


def page_links(sets: list[np.ndarray], labels: list, sides: list[int]) -> Iterator[tuple[int, int]]:
    """Links that join a page's texts: a forest, given that texts of equal label are joined already.

    sides: 0 goes with all, 1 only with 2 and 0 (two blocks that were each joined in pages of their own).
    """
    parent = list(range(len(sets)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first: dict = {}
    for i, label in enumerate(labels):
        parent[i] = first.setdefault(label, i)
    sizes = np.array([len(s) for s in sets])
    for x, y in bounded_pairs([point(s).astype(np.int32) for s in sets], sizes):
        for i, j in zip(x.tolist(), y.tolist()):
            if sides[i] and sides[i] == sides[j] or (p := find(i)) == (q := find(j)):
                continue
            small, large = (sets[i], sets[j]) if sizes[i] <= sizes[j] else (sets[j], sets[i])
            at = np.searchsorted(large, small)
            at[at == len(large)] = 0
            if int((large[at] == small).sum()) >= needed_overlap(int(sizes[i]), int(sizes[j])):
                parent[p] = q
                yield i, j


def near_pairs(points: list[np.ndarray], labels: np.ndarray, sides: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a page's points of different labels that may share enough, and which points are in any.

    Beyond PAIRS_A_POINT pairs for each point the pairs are given up; the points in them are told all the same.
    """
    near, left, right, n = np.zeros(len(points), bool), [], [], 0
    for x, y in bounded_pairs(points, np.array([p.sum() for p in points])):
        open_ = (labels[x] != labels[y]) & ((sides[x] == 0) | (sides[x] != sides[y]))
        x, y = x[open_], y[open_]
        near[x] = near[y] = True
        n += len(x)
        if n <= PAIRS_A_POINT * len(points):
            left.append(x)
            right.append(y)
    if n > PAIRS_A_POINT * len(points):
        left = right = []
    whole = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts])
    return whole(left), whole(right), near


def _summed(pieces: DataFrame, length: int) -> np.ndarray:
    """(slot, data): arrays of `length` numbers by slot, added up, as one array on the driver; its length is fixed."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(length, "uint64")
        for data in table.column("data").to_pylist():
            total += np.frombuffer(data, f"<u{len(data) // length}").astype("uint64")
        return pa.table({"slot": table.column("slot").slice(0, 1), "data": [total.tobytes()]}, schema=pa.schema([("slot", pa.int32()), ("data", pa.binary())]))

    rows = pieces.groupBy("slot").applyInArrow(add, "slot int, data binary").collect()
    return np.concatenate([np.frombuffer(r["data"], "uint64") for r in sorted(rows, key=lambda r: r["slot"])]) if rows else np.zeros(0, "uint64")


def _digest(s: np.ndarray, seed: int) -> tuple[int, int]:
    """A set's name and the other half of its digest, as signed 64-bit numbers."""
    return struct.unpack("<2q", xxhash.xxh3_128_digest(s.tobytes(), seed)) if len(s) else (0, 0)


def _texts(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[tuple[list, list[bytes | None]]]:
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            part = batch.slice(lo, rows)
            yield part.column(0).to_pylist(), part.column(1).to_pylist()


def _profiles(source: DataFrame, seed: int) -> tuple[DataFrame, np.ndarray]:
    """Step 1: (doc_id, n, key, other, point) of every row, and the sketch of shingle counts."""
    schema = "doc_id long, n long, key long, other long, point binary, slot int, data binary"
    names = ["doc_id", "n", "key", "other", "point", "slot", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        some = False
        for ids, texts in _texts(batches):
            sets = list(shingle_sets(texts))
            some = True
            counts += np.bincount((np.concatenate(sets) & np.uint64(len(counts) - 1)).astype(np.int64), minlength=len(counts)).astype(np.uint32)
            keys, others = zip(*[_digest(s, seed) for s in sets])
            none = pa.nulls(len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.int64()), pa.array(others, pa.int64()), pa.array([point(s).tobytes() if len(s) else None for s in sets], pa.binary()), none.cast(pa.int32()), none.cast(pa.binary())], names=names)
        if some:
            pieces = counts.reshape(-1, PIECE)
            slots = np.flatnonzero(pieces.any(1)).tolist()
            none = pa.nulls(len(slots)).cast(pa.int64())
            data = [pieces[k].astype("u1" if pieces[k].max() < 1 << 8 else "<u4").tobytes() for k in slots]
            yield pa.RecordBatch.from_arrays([none, none, none, none, none.cast(pa.string()).cast(pa.binary()), pa.array(slots, pa.int32()), pa.array(data, pa.binary())], names=names)

    rows = common.saved(source.mapInArrow(run, schema), "profiles")
    pieces = rows.where("slot IS NOT NULL").select("slot", "data")
    sketch = np.zeros(1 << SKETCH_BITS, np.uint64)
    found = pieces.select("slot").distinct().orderBy("slot").collect()  # at most 2 ** SKETCH_BITS / PIECE
    for r, part in zip(found, _summed(pieces, PIECE).reshape(-1, PIECE)):
        sketch[r["slot"] * PIECE : (r["slot"] + 1) * PIECE] = part
    return rows.where("slot IS NULL").select("doc_id", "n", "key", "other", "point"), sketch


def _roots(source: DataFrame, sketch: np.ndarray, seed: int) -> DataFrame:
    """Step 2: (token, key) for the trees (a root and a size class) that more than one distinct set has."""
    counts = source.sparkSession.sparkContext.broadcast(sketch)  # 2 ** SKETCH_BITS numbers
    frequent = 2 * float(sketch.mean()) + 1000

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = counts.value, set()
        for _, texts in _texts(batches):
            tokens, keys, tags = [], [], []
            for s in shingle_sets(texts):
                if not len(s) or (key := _digest(s, seed)[0]) in seen:
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(key)
                rare = table[(s & np.uint64(len(table) - 1)).astype(np.int64)]
                at, up = root_classes(len(s))
                top = np.lexsort((s, rare))[: len(up)]
                tokens.append(s[top])
                keys.append(np.full(len(top), key, np.int64))
                tags.append(2 * at + up)
            if tokens:
                token, key, tag = np.concatenate(tokens), np.concatenate(keys), np.concatenate(tags)
                often = table[(token & np.uint64(len(table) - 1)).astype(np.int64)] > frequent
                salt = np.where(often, 1 + (key % SALTS + SALTS) % SALTS, 0)
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(key), pa.array((salt << 10 | tag).astype(np.int32))], names=["token", "key", "tag"])

    def trees(t: np.ndarray, k: np.ndarray, tag: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of their own class and visitors of the next one: tree, key, whether of its own class."""
        at, up = tag >> 1 & 511, (tag & 1).astype(bool)
        name = lambda t, c: _mixed(t.view(np.uint64) + (c + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
        own = np.concatenate([np.ones(len(t), bool), np.zeros(int(up.sum()), bool)])
        return np.concatenate([name(t, at), name(t[up], at[up] + 1)]), np.concatenate([k, k[up]]), own

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by token and key the trees of two sets or more, and all of frequent roots.

        The rows of the last token wait for the next batch; those of a frequent root, of which one task
        has a part only, don't.
        """
        waiting = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)]

        def out(t: np.ndarray, k: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(t), pa.array(k)], names=["token", "key"])

        def found(t: np.ndarray, k: np.ndarray, tag: np.ndarray) -> Iterator[pa.RecordBatch]:
            new = np.concatenate([[True], (t[1:] != t[:-1]) | (k[1:] != k[:-1])])
            t, k, tag = t[new], k[new], tag[new]
            often = tag >= 1 << 10
            if often.any():
                yield out(*trees(t[often], k[often], tag[often])[:2])
            same = t[1:] == t[:-1]
            some = (np.concatenate([[False], same]) | np.concatenate([same, [False]])) & ~often
            if not some.any():
                return
            tree, key, own = trees(t[some], k[some], tag[some])
            order = np.argsort(tree, kind="stable")
            tree, key, own = tree[order], key[order], own[order]
            first = np.flatnonzero(np.concatenate([[True], tree[1:] != tree[:-1]]))
            size = np.diff(np.concatenate([first, [len(tree)]]))
            keep = np.repeat((size > 1) & (np.add.reduceat(own.astype(np.int64), first) > 0), size)
            if keep.any():
                yield out(tree[keep], key[keep])

        for batch in batches:
            t, k, tag = (np.concatenate([w, batch.column(i).to_numpy()]) for i, w in enumerate(waiting))
            if not len(t):
                continue
            # of a frequent root only the last row waits, so that the next can be told from it
            cut = len(t) - 1 if tag[-1] >= 1 << 10 else int(np.searchsorted(t, t[-1], "left"))
            waiting = [t[cut:], k[cut:], tag[cut:]]
            if cut:
                if tag[-1] >= 1 << 10 and t[cut - 1] == t[cut] and k[cut - 1] == k[cut]:
                    t, k, tag = t[: cut - 1], k[: cut - 1], tag[: cut - 1]
                else:
                    t, k, tag = t[:cut], k[:cut], tag[:cut]
                if len(t):
                    yield from found(t, k, tag)
        if len(waiting[0]):
            yield from found(*waiting)

    rows = source.mapInArrow(emit, "token long, key long, tag int").repartition(F.col("token"), F.shiftright("tag", 10)).sortWithinPartitions("token", "key")
    return common.saved(rows.mapInArrow(shared, "token long, key long"), "trees")


def _sets_of(source: DataFrame, needed: DataFrame, seed: int) -> DataFrame:
    """(key, set) for at least the documents in needed (doc_id, key), by a scan that a filter of bounded size cuts down.

    A document is asked for by its doc_id or, without one, by its set's key, and rows without a doc_id
    give each set once a task. What the filter lets through beyond them has keys that no later join meets.
    """
    wanted = source.sparkSession.sparkContext.broadcast(bit_filter(needed.select(F.coalesce("doc_id", "key")).distinct(), "needed"))  # at most filters.MOST_BITS

    def asked(ids: list[int]) -> list[bool]:
        return may_hold(wanted.value, np.array(ids, np.int64)).tolist()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for ids, texts in _texts(batches):
            named = [(i, t) for i, t in zip(ids, texts) if i is not None]
            chosen = [t for (_, t), h in zip(named, asked([i for i, _ in named])) if h]
            for lo in range(0, len(chosen), 128):
                # repeated rows of a doc_id give their set once a task
                found = {k: s for s in shingle_sets(chosen[lo : lo + 128]) if (k := _digest(s, seed)[0]) not in seen}
                if len(seen) > 500_000:
                    seen.clear()
                seen.update(found)
                yield _key_sets(list(found), list(found.values()))
            unnamed = [t for i, t in zip(ids, texts) if i is None]
            for lo in range(0, len(unnamed), 128):
                found = {_digest(s, seed)[0]: s for s in shingle_sets(unnamed[lo : lo + 128]) if len(s)}
                keys = [k for k, h in zip(found, asked(list(found))) if h and k not in seen]
                if len(seen) > 500_000:
                    seen.clear()
                seen.update(keys)
                yield _key_sets(keys, [found[k] for k in keys])

    return source.mapInArrow(emit, "key long, set binary")


def _key_sets(keys: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["key", "set"])


def _joined_pages(pages: DataFrame, points: DataFrame, source: DataFrame, seed: int, tag: str) -> DataFrame:
    """Pages (page, side, key, label) -> links (a, b) between keys, by an R-tree for each page.

    points: (key, doc_id, n, point). First the trees over the points alone say whose sets are needed.
    """

    columns = ["page", "side", "key", "label", "doc_id"]
    names = [*columns, "key_b", "label_b", "doc_b"]

    def near(table: pa.Table) -> pa.Table:
        vectors = [read_point(x, n) for x, n in zip(table.column("point").to_pylist(), table.column("n").to_pylist())]
        x, y, some = near_pairs(vectors, table.column("label").to_numpy(), table.column("side").to_numpy())
        if len(x):
            return pa.table([*table.select(columns).take(pa.array(x)).columns, *table.select(columns[2:]).take(pa.array(y)).columns], names=names)
        own = table.select(columns).filter(pa.array(some))
        return pa.table([*own.columns, *[pa.nulls(own.num_rows, pa.int64())] * 3], names=names)

    def join(table: pa.Table) -> pa.Table:
        rows = list(dict(zip(zip(table.column("key").to_pylist(), table.column("side").to_pylist()), zip(table.column("label").to_pylist(), table.column("set").to_pylist()))).items())
        keys = [k for (k, _), _ in rows]
        found = list(page_links([np.frombuffer(s, np.uint64) for _, (_, s) in rows], [x for _, (x, _) in rows], [side for (_, side), _ in rows])) if len(rows) > 1 else []
        return pa.table({"a": pa.array([keys[i] for i, _ in found], pa.int64()), "b": pa.array([keys[j] for _, j in found], pa.int64())})

    with_points = pages.join(points, "key").select("page", "side", "key", "label", "doc_id", "n", "point")
    met = common.saved(with_points.groupBy("page").applyInArrow(near, "page long, side int, key long, label long, doc_id long, key_b long, label_b long, doc_b long"), f"near-{tag}")
    # a pair that several pages met is verified in one of them; pages that gave up pairs keep all their points
    once = met.where("key_b IS NOT NULL").groupBy(F.least("key", "key_b").alias("low"), F.greatest("key", "key_b").alias("high")).agg(F.min(F.struct("page", "key", "label", "doc_id", "key_b", "label_b", "doc_b")).alias("r"))
    member = lambda *c: once.select("r.page", F.lit(0).alias("side"), *[F.col(f"r.{x}") for x in c]).toDF(*columns)
    rest = met.where("key_b IS NULL").select(columns).union(member("key", "label", "doc_id")).union(member("key_b", "label_b", "doc_b")).distinct()
    rest = common.saved(rest, f"members-{tag}")
    sets = common.saved(_sets_of(source, rest, seed).groupBy("key").agg(F.first("set").alias("set")), f"sets-{tag}")  # each once, whatever rows repeat
    full = rest.join(sets, "key").select("page", "side", "key", "label", "set")
    return common.saved(full.groupBy("page").applyInArrow(join, "a long, b long"), f"links-{tag}")


def links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(doc_id, n, key) of every row, (key, first doc_id) of every distinct set, a forest of links (a, b) between keys, and the seed of the keys."""
    common.prepare(docs.sparkSession)
    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("text"))
    for seed in count():
        profiles, sketch = _profiles(source, seed)
        classes = profiles.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"), (F.min("other") != F.max("other")).alias("two"))
        classes = common.saved(classes, "sets")
        if classes.where("two").isEmpty():
            break
    classes, profiles = classes.drop("two"), profiles.drop("other")
    roots = _roots(source, sketch, seed)
    needed = roots.select(F.col("key").alias("k")).distinct().join(classes.select(F.col("key").alias("k"), F.col("doc_id").alias("d")), "k")
    # a set that only rows without a doc_id have is one point, however many they are
    unnamed = profiles.where("doc_id IS NULL AND n > 0").groupBy("key").agg(F.first("n").alias("n"), F.first("point").alias("point"))
    each = profiles.where("doc_id IS NOT NULL").unionByName(unnamed.withColumn("doc_id", F.lit(None).cast("long")))
    points = each.join(needed, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")))
    # rows repeated with one doc_id are one point
    points = common.saved(points.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("point").alias("point")), "points")
    # a page holds PAGE sets, or fewer of many shingles: a set weighs 1 and 1 more for each HEAVY shingles
    heavy = points.where(F.col("n") >= HEAVY).select(F.col("key").alias("heavy"), F.floor(F.col("n") / HEAVY).alias("more"))
    weighed = lambda rows: rows.join(heavy, F.col("key") == F.col("heavy"), "left").withColumn("weight", 1 + F.coalesce("more", F.lit(0))).drop("heavy", "more")

    # Step 3: the page of the least set met in any tree.
    least = roots.groupBy(F.col("token").alias("t")).agg(F.min("key").alias("hub"))
    hubs = common.saved(roots.join(least, F.col("token") == F.col("t")).groupBy("key").agg(F.min("hub").alias("hub")), "hubs")
    many = weighed(hubs).groupBy(F.col("hub").alias("h")).agg(F.ceil(F.sum("weight") / PAGE).alias("blocks"))
    many = common.saved(many, "hub-blocks")
    page = lambda p, b: F.xxhash64(p, b)
    members = hubs.where("key <> hub").join(many, F.col("hub") == F.col("h")).select(page(F.col("hub"), F.pmod(F.xxhash64("key"), F.col("blocks"))).alias("page"), "key")
    centres = many.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(page(F.col("h"), F.col("b")).alias("page"), F.col("h").alias("key"))
    pages = members.union(centres).select("page", F.lit(0).alias("side"), "key", F.col("key").alias("label"))
    found = _joined_pages(pages, points, source, seed, "1")

    # Step 4: trees with sets of several components.
    root_of = components(found)
    labelled = roots.join(root_of, F.col("key") == F.col("node"), "left").select("token", "key", F.coalesce("root", "key").alias("label"))
    labelled = common.saved(weighed(labelled), "labelled")
    trees = labelled.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n"), F.sum("weight").alias("w"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y"))
    open_trees = trees.where("low <> high").groupBy("n", "w", "x", "y").agg(F.min("token").alias("t"))
    open_trees = common.saved(open_trees.select("t", F.col("w").alias("n")), "open-trees")
    rest = common.saved(labelled.join(open_trees, F.col("token") == F.col("t")).drop("t"), "open-members")
    # of a large tree the members of its largest component don't meet each other, only those outside it
    sums = rest.where(F.col("n") > PAGE).groupBy("token", "label").agg(F.sum("weight").alias("n")).groupBy("token").agg(F.max(F.struct("n", "label")).alias("m"))
    rest = rest.join(sums.select(F.col("token").alias("t"), F.col("m.label").alias("main"), F.col("m.n").alias("n_main")), F.col("token") == F.col("t"), "left")
    rest = rest.withColumn("in_main", F.coalesce(F.col("label") == F.col("main"), F.lit(False)))
    rest = rest.withColumn("main_blocks", F.coalesce(F.ceil(F.col("n_main") / PAGE), F.lit(0))).withColumn("blocks", F.ceil((F.col("n") - F.coalesce("n_main", F.lit(0))) / PAGE))
    rest = rest.withColumn("own", F.pmod(F.xxhash64("key"), F.when(F.col("in_main"), F.col("main_blocks")).otherwise(F.col("blocks"))))
    # a block meets itself and each other block outside the largest component: pages (i, j) with i <= j; in those of two blocks each is a side
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).otherwise(F.expr("cast(array() as array<bigint>)"))
    place = lambda x, y, side: F.struct(x.alias("x"), y.alias("y"), side.alias("side"))
    own, zero = F.col("own"), F.lit(0)
    inside = F.transform(upto("blocks"), lambda i: place(-own - 1, i, zero + 1))
    outside = F.concat(
        F.transform(upto("blocks"), lambda i: place(F.least(own, i), F.greatest(own, i), F.when(own == i, zero).when(own < i, zero + 1).otherwise(zero + 2))),
        F.transform(upto("main_blocks"), lambda i: place(-i - 1, own, zero + 2)),
    )
    dealt = rest.withColumn("p", F.explode(F.when(F.col("in_main"), inside).otherwise(outside)))
    pages = dealt.select(F.xxhash64("token", "p.x", "p.y").alias("page"), F.col("p.side").alias("side"), "key", "label")
    more = _joined_pages(pages, points, source, seed, "2")
    roots_of = root_of.select(F.col("node").alias("a"), F.col("root").alias("b")).where("a <> b")
    return profiles, classes, roots_of.union(more), seed


def _components(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame, int]:
    """(doc_id, n, key) of every row, each distinct set's k, its component's root and component_id, and the seed of the keys."""
    profiles, classes, forest, seed = links(docs, doc_id, text)
    root_of = components(forest)
    named = common.saved(classes.join(root_of, F.col("key") == F.col("node"), "left").select(F.col("key").alias("k"), F.coalesce("root", "key").alias("root"), F.col("doc_id").alias("first")), "classes")
    names = named.groupBy(F.col("root").alias("r")).agg(F.min("first").alias("component_id"))
    return profiles, common.saved(named.join(names, F.col("root") == F.col("r")).select("k", "root", "component_id"), "named"), seed


def _grouped(profiles: DataFrame, named: DataFrame) -> DataFrame:
    rows = profiles.join(named, (F.col("key") == F.col("k")) & (F.col("n") > 0), "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def similar_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's doc_id, n_shingles and component_id, the least doc_id reachable by links.

    Null and empty texts, and texts without a word, have no shingles and are linked with nothing.
    Texts with equal sets are one point; repeated rows get equal results. A row without a doc_id can
    be a link's end but not a component's name; alone with others like it, its component is null. An
    empty table gives no rows.
    """
    return _grouped(*_components(docs, doc_id, text)[:2])


def _with_keys(docs: DataFrame, text: str, own: str, seed: int) -> DataFrame:
    """docs with the key of each text's set, null for an empty set, as column `own`."""
    (whole,) = common.fresh(docs, "whole_text")
    schema = T.StructType([*docs.schema.fields, T.StructField(own, T.LongType())])
    n = len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                keys = pa.array([_digest(s, seed)[0] if len(s) else None for s in shingle_sets(part.column(n).to_pylist())], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[:n], keys], names=schema.names)

    return docs.withColumn(whole, F.col(f"`{text}`").cast("binary")).mapInArrow(run, schema)


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows of a component other than its first document's.

    Of a component of rows without a doc_id one row is kept; those in a component with a name go.
    """
    profiles, named, seed = _components(docs, doc_id, text)
    own, root, row = common.fresh(docs, "kept_id", "kept_root", "kept_row")
    kept = _grouped(profiles, named).where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(own)).distinct()
    with_id = docs.join(kept, F.col(f"`{doc_id}`") == F.col(own), "left_semi")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    unnamed = common.saved(_with_keys(docs.where(F.col(f"`{doc_id}`").isNull()), text, own, seed), "unnamed")
    alone = named.where("component_id IS NULL").select(F.col("k").alias(f"{own}_k"), F.col("root").alias(root))
    hashed = [c for c, f in zip(columns, docs.schema.fields) if "map<" not in f.dataType.simpleString()]
    order = F.struct(own, F.xxhash64(*hashed))
    one = unnamed.join(alone, F.col(own) == F.col(f"{own}_k")).groupBy(root).agg(F.min_by(F.struct(*columns), order).alias(row))
    return with_id.unionByName(unnamed.where(F.col(own).isNull()).select(*columns)).unionByName(one.select(*[F.col(row)[c].alias(c) for c in docs.columns]))


def op9_count_vector_rtree(spark, sf_dir: str) -> DataFrame:
    """Shingle counts and components of all documents."""
    return similar_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
linked AS (SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
both_ways AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reach AS (SELECT doc_id AS d, doc_id AS r FROM documents UNION SELECT reach.d, both_ways.b FROM reach JOIN both_ways ON reach.r = both_ways.a)
SELECT d.doc_id, coalesce(max(s.n), 0) AS n_shingles, min(r.r) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN reach r ON r.d = d.doc_id GROUP BY d.doc_id
"""
