"""Hash trees over files."""

from __future__ import annotations

from millrace.sources import merkle


def test_trees(spark):
    files = [(f"/r/{i % 5}/f{i}.java", f"class F{i} {{ }}") for i in range(60)] + [("/r/none", None), ("/r/empty", "")]
    frame = lambda rows, n=3: spark.createDataFrame(rows, "path string, content string").repartition(n)
    own = merkle.leaves(frame(files), "/r")
    assert {r.path for r in own.collect()} == {p[3:] for p, _ in files}
    tree = merkle.nodes(own, 2)
    digest = lambda t: merkle.tree_digest(t).first()
    assert digest(tree) == digest(merkle.nodes(merkle.leaves(frame(files[::-1], 1), "/r/"), 2)) and digest(tree).n == 62
    assert all(r.n <= 62 for r in tree.collect()) and {r.level for r in tree.collect()} == {0, 1, 2} and merkle.depth_for(62) == 2 and merkle.depth_for(0) == 1
    later = [(p, c) if i != 7 else (p, "other") for i, (p, c) in enumerate(files) if i != 11] + [("/r/9/new", "x")]
    b = merkle.leaves(frame(later), "/r")
    tree_b = merkle.nodes(b, 2)
    assert digest(tree) != digest(tree_b)
    assert {tuple(r) for r in merkle.changed(own, b, tree, tree_b).collect()} == {("2/f7.java", "changed"), ("1/f11.java", "removed"), ("9/new", "added")}
    assert merkle.changed(own, own, tree, tree).count() == 0
    none = frame(files).where("false")
    empty = merkle.nodes(merkle.leaves(none), 2)
    assert empty.count() == 0 and merkle.tree_digest(empty).count() == 0
    assert merkle.changed(merkle.leaves(none), own, empty, tree).where("kind = 'added'").count() == 62
