"""Graphs of classes: closure, inversion, resolution, overrides, producers and walks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text
from ..shared import saved

#: Walk patterns in the order of their priority.
PATTERNS = ("own_surface", "producers", "inherited_api", "supertype", "ctor_args", "implementations", "subclasses", "results", "used_privately")
CONCRETE = ("class", "enum", "record")


#: Names that a join is told by a broadcast, at most.
FEW = 65_536


def _heads_and_tails(reach: DataFrame, depth: int) -> tuple[DataFrame, DataFrame] | None:
    """The pairs of just that depth, and those that go on from where they end; null if there are none.

    Far up are few nodes, so the pairs that go on are mostly picked by a broadcast of these, before they are shuffled.
    """
    heads = reach.where(F.col("depth") == depth)
    mids = heads.select(F.col("dst").alias("src")).distinct()
    n = mids.count()
    return (heads, reach.join(F.broadcast(mids), "src", "left_semi") if n <= FEW else reach) if n else None


def closure(edges: DataFrame, rounds: int | None = None, sources: DataFrame | None = None) -> DataFrame:
    """(src, dst) -> (src, dst, depth): everything reachable, nearest depth, without src itself. sources (src): of these only, if given.

    Known are all pairs up to a depth of 2 ** k. A shortest path up to twice as long passes a node at
    a depth of just 2 ** k, so only the pairs of that depth are joined with the known ones, and only
    new pairs are written; diamonds don't multiply and cycles end. It stops when nothing new comes,
    or after `rounds` rounds.
    With sources, a round finds pairs of these and of nodes that the next rounds may pass only: such a node
    ends a pair of depth 2 ** k whose start ends one of that depth too.
    """
    reach = saved(edges.where("src <> dst").select("src", "dst").distinct().withColumn("depth", F.lit(1)), "closure")
    k = 0
    while rounds is None or k < rounds:
        if not (both := _heads_and_tails(reach, 1 << k)):
            break
        heads = both[0].select("src", F.col("dst").alias("mid"))
        if sources is not None:
            ahead = both[0].join(both[0].select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select(F.col("dst").alias("src"))
            heads = heads.join(sources.select("src").union(ahead).distinct(), "src", "left_semi")
        tails = both[1].select(F.col("src").alias("mid"), "dst", F.col("depth").alias("more"))
        longer = heads.join(tails, "mid").where("src <> dst").groupBy("src", "dst").agg((F.min("more") + (1 << k)).alias("depth"))
        new = saved(longer.join(reach.select("src", "dst"), ["src", "dst"], "left_anti"), "closure")
        if new.isEmpty():
            break
        reach = reach.unionByName(new)
        k += 1
    return reach if sources is None else reach.join(sources.select("src").distinct(), "src", "left_semi")


def discovered(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(src, dst, place: of dst among what src lists) -> (src, dst, depth, label): everything reachable, without src itself, as a
    breadth-first search finds it.

    A label is the places on the way; of labels of one depth the least is that of the first discovery, as
    the queue holds nodes in the order of their parents, then in that of the parents' lists. So order by depth
    and label is the order of discovery; nothing is numbered on the way. Depths are doubled as in closure():
    a shortest way up to twice as long as 2 ** k passes a node at a depth of just 2 ** k, and the least label
    of such ways is a least one up to there and a least one from there. rounds: the greatest depth.
    """
    reach = saved(edges.where("src <> dst").groupBy("src", "dst").agg(F.min("place").cast("int").alias("place")).select("src", "dst", F.lit(1).alias("depth"), F.array("place").alias("label")), "discovered")
    k = 0
    while rounds is None or 1 << k < rounds:
        if not (both := _heads_and_tails(reach, 1 << k)):
            break
        heads = both[0].select("src", F.col("dst").alias("mid"), F.col("label").alias("head"))
        tails = both[1].select(F.col("src").alias("mid"), "dst", F.col("depth").alias("more"), F.col("label").alias("tail"))
        longer = heads.join(tails, "mid").where("src <> dst").groupBy("src", "dst").agg(F.min(F.struct("more", F.concat("head", "tail").alias("label"))).alias("x"))
        new = longer.join(reach.select("src", "dst"), ["src", "dst"], "left_anti").select("src", "dst", (F.col("x.more") + (1 << k)).alias("depth"), "x.label")
        reach = reach.unionByName(saved(new, "discovered"))
        k += 1
    return reach if rounds is None else reach.where(F.col("depth") <= rounds)


def inverted(edges: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """By value the sorted set of its keys."""
    return edges.groupBy(value).agg(F.array_sort(F.collect_set(key)).alias(out))


def supertypes(index: DataFrame) -> DataFrame:
    """(src, dst): a class and those it extends or implements that are in the index."""
    each = index.select(F.col("class").alias("src"), F.explode(F.array_union(F.coalesce("extends", F.expr("cast(array() as array<string>)")), F.coalesce("implements", F.expr("cast(array() as array<string>)")))).alias("dst"))
    return each.join(index.select(F.col("class").alias("dst")), "dst", "left_semi").select("src", "dst")


def listed_supertypes(index: DataFrame) -> DataFrame:
    """(src, dst, place): supertypes() with their places: what a class extends, then what it implements, as listed."""
    none = F.expr("cast(array() as array<string>)")
    each = index.select(F.col("class").alias("src"), F.posexplode(F.concat(F.coalesce("extends", none), F.coalesce("implements", none))).alias("place", "dst"))
    return each.join(index.select(F.col("class").alias("dst")), "dst", "left_semi").select("src", "dst", "place")


def inversions(index: DataFrame, ancestors: DataFrame) -> DataFrame:
    """class with implemented_by (concrete descendants), extended_by (direct) and referenced_by_count."""
    kinds = index.select(F.col("class").alias("src"), "kind")
    implemented = inverted(ancestors.join(kinds, "src").where(F.col("kind").isin(*CONCRETE)), "src", "dst", "implemented_by").withColumnRenamed("dst", "class")
    extended = inverted(index.select(F.col("class").alias("src"), F.explode("extends").alias("dst")), "src", "dst", "extended_by").withColumnRenamed("dst", "class")
    referenced = index.select("class", F.explode("references").alias("r")).groupBy(F.col("r").alias("class")).agg(F.count_distinct("class").alias("referenced_by_count")) if "references" in index.columns else None
    out = index.select("class").join(implemented, "class", "left").join(extended, "class", "left")
    if referenced is not None:
        out = out.join(referenced, "class", "left")
    return out.withColumns({c: F.coalesce(c, F.expr("cast(array() as array<string>)")) for c in ("implemented_by", "extended_by")} | ({"referenced_by_count": F.coalesce("referenced_by_count", F.lit(0))} if referenced is not None else {}))


def binary_ancestors(types: DataFrame) -> DataFrame:
    """types (name, extends, implements; binary names such as a.B$C, type arguments allowed) -> (src, dst, depth).

    Supertypes are followed through nested classes, whether or not they are in the table.
    """
    none = F.expr("cast(array() as array<string>)")
    each = types.select(F.col("name").alias("src"), F.explode(F.concat(F.coalesce("extends", none), F.coalesce("implements", none))).alias("s"))
    return closure(each.select("src", F.substring_index("s", "<", 1).alias("dst")))


def _hidden(members: DataFrame) -> DataFrame:
    """(name, outer, nested) of members that a test in another package can't use."""
    return members.where(F.col("visibility").isin("protected", "package") & (F.col("kind") != "ctor")).select("name", F.col("class").alias("outer"), F.coalesce("declared_in", F.lit("")).alias("nested"))


def missed(members: DataFrame, names: DataFrame) -> DataFrame:
    """(src, name): names that a class's code holds, that it doesn't declare and that some class has hidden. Only such
    classes can have rows in inaccessible(), so only their ancestors need be known. Columns as there."""
    declared = members.where(F.coalesce("declared_in", F.lit("")) == "").select(F.col("class").alias("src"), "name")
    hidden = _hidden(members).select("name").distinct()
    return names.select(F.col("class").alias("src"), "name").distinct().join(hidden, "name", "left_semi").join(declared, ["src", "name"], "left_anti").select("src", "name")


def inaccessible(members: DataFrame, reach: DataFrame, packages: DataFrame, names: DataFrame | None, needed: DataFrame | None = None) -> DataFrame:
    """(src, dst, names): members a class uses of an ancestor that a test in the class's package can't.

    members (class, name, kind, visibility, declared_in), reach (src, dst) of binary names, packages
    (class, package), names (class, name) that the class's code holds. Such members are protected or
    package-private ones of another package that the class doesn't declare anew; constructors never are.
    needed: missed() of members and names, where it is known already.
    """
    outer, nested = F.substring_index("dst", "$", 1), F.when(F.instr("dst", "$") > 0, F.regexp_extract("dst", r"\$(.*)", 1)).otherwise("")
    own = packages.select(F.col("class").alias("src"), F.col("package").alias("own_package"))
    theirs = packages.select(F.col("class").alias("outer"), F.col("package").alias("its_package"))
    wanted = needed if needed is not None else missed(members, names)
    # few classes miss a name and few hide one, so pairs go first through both; packages are told of what is left
    pairs = reach.select("src", "dst", outer.alias("outer"), nested.alias("nested")).join(wanted.groupBy("src").agg(F.collect_set("name").alias("used")), "src")  # of one class's names
    used = pairs.join(_hidden(members), ["outer", "nested"]).where(F.array_contains("used", F.col("name"))).select("src", "dst", "outer", "name")
    far = used.join(own, "src").join(theirs, "outer").where("own_package <> its_package")
    return far.groupBy("src", F.replace("dst", F.lit("$"), F.lit(".")).alias("dst")).agg(F.array_sort(F.collect_set("name")).alias("names"))


def implementer(candidates: DataFrame) -> DataFrame:
    """For each (cut, of) the class that stands for an open type: candidates (cut, of, class, package, of_package, deprecated, size).

    Deprecated ones only if all are; one of the type's own package if there is any; the shortest file
    of these, ties by name. By one aggregate, not by sorting.
    """
    order = F.struct(F.col("deprecated").cast("int").alias("d"), (F.col("package") != F.col("of_package")).cast("int").alias("p"), "size", "class")
    return candidates.groupBy("cut", "of").agg(F.min_by("class", order).alias("pick"), F.count("*").alias("n_candidates"))


def by_simple_name(uses: DataFrame, classes: DataFrame) -> DataFrame:
    """uses (…, name) with fqn: the class of that name, else that of its outer name, else the only one of that simple name."""
    known = classes.select(F.col("class").alias("known")).distinct()
    simple = known.groupBy(F.regexp_extract("known", r"([^.$]*)$", 1).alias("simple")).agg(F.min("known").alias("only"), F.count("*").alias("n")).where("n = 1")
    rows = uses.withColumns({"outer_": F.substring_index("name", "$", 1), "simple_": F.regexp_extract("name", r"([^.$]*)$", 1)})
    rows = rows.join(known.select(F.col("known").alias("name"), F.col("known").alias("k1")), "name", "left").join(known.select(F.col("known").alias("outer_"), F.col("known").alias("k2")), "outer_", "left")
    rows = rows.join(simple.select(F.col("simple").alias("simple_"), "only"), "simple_", "left")
    return rows.withColumn("fqn", F.coalesce("k1", "k2", "only")).drop("k1", "k2", "only", "outer_", "simple_")


def resolved_files(uses: DataFrame, classes: DataFrame, files: DataFrame) -> DataFrame:
    """(cut, paths): for each class the files of all names it uses, each once, sorted, without its own.

    uses (cut, names: array), classes as for by_simple_name(), files (class: outer name, path).
    """
    each = uses.select("cut", F.explode(F.array_distinct("names")).alias("name"))
    found = by_simple_name(each, classes).where("fqn IS NOT NULL").select("cut", F.substring_index("fqn", "$", 1).alias("class")).distinct()
    theirs = found.join(files.select("class", "path"), "class").join(files.select(F.substring_index("class", "$", 1).alias("cut"), F.col("path").alias("own")), "cut", "left")
    return theirs.where(~F.col("path").eqNullSafe(F.col("own"))).groupBy("cut").agg(F.array_sort(F.collect_set("path")).alias("paths"))  # of one source's names


def modules(files: DataFrame, root: str = "") -> DataFrame:
    """files (path) with `module`: the nearest folder at or above each, not above root, that holds a pom.xml; null without one or outside of root."""
    base = root.rstrip("/")
    folder = lambda c: F.regexp_replace(c, r"/[^/]*$", "")
    poms = files.where(F.col("path").endswith("/pom.xml")).select(folder("path").alias("at")).distinct()
    parts = F.split(F.substring("path", len(base) + 2, 1 << 30), "/")
    # folders from root down to the file's own
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.concat(F.lit(base), F.array_join(F.transform(F.slice(parts, F.lit(1), n), lambda p: F.concat(F.lit("/"), p)), "")))
    inside = files.select("path").distinct().where(F.startswith("path", F.lit(base + "/"))).select("path", F.explode(above).alias("at"))
    nearest = inside.join(poms, "at").groupBy("path").agg(F.max_by("at", F.length("at")).alias("module"))
    return files.join(nearest, "path", "left")


def to_descendants(reach: DataFrame, given: DataFrame, *more: str) -> DataFrame:
    """reach (src, dst, more) with given (dst, ...: one row for each dst), in blocks: (block, src, dst, more, ...), rows of a block and so of a src in one partition.

    Descendants are dealt to as many blocks as a shuffle has parts. What a dst gives goes once to each block that
    has descendants of it, with their list, not once to each of them; what is grouped by block and src then isn't shuffled again.
    """
    spark = reach.sparkSession
    n = int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) or spark.conf.get("spark.sql.shuffle.partitions"))
    block = F.pmod(F.xxhash64("src"), F.lit(n)).cast("int").alias("block")
    lists = reach.select(block, "dst", F.struct("src", *more).alias("s")).groupBy("block", "dst").agg(F.collect_list("s").alias("srcs"))  # of one block
    dealt = lists.join(given, "dst").repartition(n, "block")  # a number that is given: narrow rows grow here, so parts mustn't be joined
    return dealt.withColumn("s", F.explode("srcs")).select("block", "s.*", *[c for c in dealt.columns if c not in ("block", "srcs")])


def inherited_api(index: DataFrame, ancestors: DataFrame, parts: tuple = ("method_params", "returns", "throws", "fields")) -> DataFrame:
    """By class, for each part, the sorted union over its ancestors without the class itself."""
    api = index.select(F.col("class").alias("dst"), *[F.coalesce(p, F.expr("cast(array() as array<string>)")).alias(p) for p in parts])
    sums = to_descendants(ancestors, api).groupBy("block", "src").agg(*[F.flatten(F.collect_set(p)).alias(p) for p in parts])
    return sums.select(F.col("src").alias("class"), *[F.array_sort(F.array_remove(F.array_distinct(p), F.col("src"))).alias(p) for p in parts])


def overrides(members: DataFrame, ancestors: DataFrame) -> DataFrame:
    """members (class, name, kind, visibility, static, params, declared_in) with `overrides`: the first
    ancestor by name that has a visible instance method of that name and those parameters."""
    method = (F.col("kind") == "method") & ~F.col("static") & (F.coalesce("declared_in", F.lit("")) == "")
    theirs = members.where(method & (F.col("visibility") != "private")).select(F.col("class").alias("dst"), F.col("name").alias("n"), F.col("params").alias("p"))
    found = ancestors.join(theirs, "dst").groupBy(F.col("src").alias("c"), "n", "p").agg(F.min("dst").alias("overrides"))
    rows = members.join(found, (F.col("class") == F.col("c")) & (F.col("name") == F.col("n")) & (F.col("params") == F.col("p")), "left")
    return rows.withColumn("overrides", F.when(method, F.col("overrides"))).drop("c", "n", "p")


def _nearest(reach: DataFrame):
    """The order of a class's ancestors: by discovery, or by depth and name where no labels are known."""
    return F.struct("depth", "label" if "label" in reach.columns else "dst")


def not_overridden(members: DataFrame, reach: DataFrame) -> DataFrame:
    """By class the inherited methods it doesn't define, the first definition of each signature in the order of discovered()."""
    theirs = members.select(F.col("class").alias("dst"), "name", "params", F.col("visibility").alias("v")).where("v <> 'private'")
    met = reach.join(theirs, "dst").groupBy("src", "name", "params").agg(F.min_by("dst", _nearest(reach)).alias("declared_by"))
    return met.join(members.select(F.col("class").alias("src"), "name", "params"), ["src", "name", "params"], "left_anti")


def passed_on(members: DataFrame, reach: DataFrame, packages: DataFrame, shown: DataFrame | None = None) -> DataFrame:
    """(src, dst, same, signatures): for each class and ancestor whether their package is the same, and the ancestor's methods that
    the class sees, doesn't define, and doesn't have from an ancestor found before.

    members (class, name, kind, visibility, params), packages (class, package). shown (dst): if given, pairs without
    signatures are told of these ancestors only.
    """
    own = members.where("kind = 'method'")
    pack = lambda c, p: packages.select(F.col("class").alias(c), F.col("package").alias(p))
    paired = lambda r: r.join(pack("src", "p"), "src").join(pack("dst", "q"), "dst").withColumn("same", F.col("p") == F.col("q"))
    pairs = paired(reach)
    theirs = own.select(F.col("class").alias("dst"), "name", "params", F.col("visibility").alias("v"))
    seen = pairs.join(theirs, "dst").where("v = 'public' OR (v <> 'private' AND same)")
    first = seen.groupBy("src", "name", "params").agg(F.min_by(F.struct("dst", "same"), _nearest(reach)).alias("x")).join(own.select(F.col("class").alias("src"), "name", "params"), ["src", "name", "params"], "left_anti")
    signatures = first.groupBy("src", "x.dst").agg(F.any_value("x.same").alias("same"), F.array_sort(F.collect_set(text.signature(F.col("name"), F.col("params")))).alias("signatures"))  # of one class's members
    none = F.expr("cast(array() as array<string>)")
    if shown is not None:
        rest = paired(reach.select("src", "dst").join(shown.select("dst").distinct(), "dst", "left_semi")).join(signatures, ["src", "dst"], "left_anti")
        return signatures.unionByName(rest.select("src", "dst", "same", none.alias("signatures")))
    return pairs.select("src", "dst", "same").join(signatures.drop("same"), ["src", "dst"], "left").withColumn("signatures", F.coalesce("signatures", none))


def resolved(uses: DataFrame, candidates: DataFrame, classes: DataFrame) -> DataFrame:
    """uses (file, name), candidates (file, name, prio, fqn): imports 0, own package 1, wildcards 2 and
    up in order -> fqn or null. A name imported singly is that import or, if it is no class, nothing."""
    ranked = candidates.join(classes.select(F.col("class").alias("fqn"), F.lit(True).alias("known")), "fqn", "left")
    single = F.bool_or(F.col("prio") == 0)
    found = ranked.groupBy("file", "name").agg(single.alias("single"), F.min_by("fqn", F.when(F.col("known") & (F.col("prio") == 0), 0)).alias("imported"), F.min_by("fqn", F.when(F.col("known"), F.col("prio"))).alias("any"))
    return uses.join(found.select("file", "name", F.when(F.col("single"), F.col("imported")).otherwise(F.col("any")).alias("fqn")), ["file", "name"], "left")


def call_sites(calls: DataFrame, members: DataFrame) -> DataFrame:
    """calls (caller, member, owner, name) with the called member's own row."""
    return calls.join(members.select(F.col("class").alias("owner"), "name", "visibility", "decl"), ["owner", "name"])


def _ways(calls: DataFrame, members: DataFrame, lineage: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(class, member, decl): public ways to a member's work: itself, or public callers of a hidden one within the class's lineage.
    wanted (class, member): of these members only, if given."""
    of = members if wanted is None else members.join(wanted, ["class", "member"], "left_semi")
    hidden = of.where("visibility <> 'public'").select("class", "member").distinct()
    public = members.where("visibility = 'public'").select("class", "member", "decl")
    if wanted is not None:
        lineage = lineage.join(hidden.select("class"), "class", "left_semi")
    open_calls = calls.select("caller", F.col("member").alias("by"), "owner", F.col("name").alias("member")).join(public.toDF("caller", "by", "decl"), ["caller", "by"])
    steps = lineage.select("class", F.col("of").alias("caller")).join(open_calls, "caller").join(hidden, ["class", "member"], "left_semi")
    steps = steps.join(lineage.select("class", F.col("of").alias("owner")), ["class", "owner"], "left_semi")
    return of.where("visibility = 'public'").select("class", "member", "decl").union(steps.select("class", "member", "decl"))


def producers(news: DataFrame, calls: DataFrame, members: DataFrame, lineage: DataFrame, most: int | None = None) -> DataFrame:
    """(target, class, entries): public ways to get a target built; the first `most` by name, if given.

    news (class, member, target), calls (caller, member, owner, name), members (class, member,
    visibility, decl), lineage (class, of: each class and its ancestors). A public member that builds
    the target is an entry; for another one, public callers within the class's lineage are.
    Entries are told once for each member, not for each target that it builds, from public callers only;
    a target's are the union of the lists of its class's members, so nothing multiplies after that.
    """
    ways = _ways(calls, members, lineage).groupBy("class", "member").agg(F.collect_set("decl").alias("decls"))
    built = news.where(F.substring_index("class", "$", 1) != F.substring_index("target", "$", 1)).join(ways, ["class", "member"])
    entries = F.array_sort(F.array_distinct(F.flatten(F.collect_set("decls"))))  # of one class's members
    return built.groupBy("target", "class").agg((entries if most is None else F.slice(entries, 1, most)).alias("entries"))


def builders(news: DataFrame, calls: DataFrame, members: DataFrame, lineage: DataFrame) -> DataFrame:
    """(target, class): the pairs of producers() without their entries, from those members only that build a target."""
    news = news.where(F.substring_index("class", "$", 1) != F.substring_index("target", "$", 1))
    ways = _ways(calls, members, lineage, news.select("class", "member").distinct()).select("class", "member").distinct()
    return news.join(ways, ["class", "member"], "left_semi").select("target", "class").distinct()


def walked(steps: DataFrame, known: DataFrame) -> DataFrame:
    """steps (cut, fqn, pattern, hops) -> one row for each pair: patterns by priority, the first of them
    and the fewest hops. Types that aren't known and the class itself are left out."""
    names = F.array(*map(F.lit, PATTERNS))
    rows = steps.where("cut <> fqn").join(known.select(F.col("class").alias("fqn")), "fqn", "left_semi").withColumn("prio", F.array_position(names, F.col("pattern")).cast("int") - 1)
    # a bit for each pattern met: sums of bits, no sets
    met = rows.groupBy("cut", "fqn").agg(F.bit_or(F.expr("shiftleft(1, prio)")).alias("mask"), F.min("hops").alias("hops"), F.min("prio").alias("prio"))
    patterns = F.filter(names, lambda p, i: F.getbit(F.col("mask"), i) == 1)
    return met.select("cut", "fqn", patterns.alias("patterns"), F.element_at(names, F.col("prio") + 1).alias("pattern"), "hops")


def in_walk_order(candidates: DataFrame) -> DataFrame:
    """Candidates of walked() with `place` from 1 in each class: by the first pattern's priority, then by name; so a class always shows them alike."""
    prio = F.array_position(F.array(*map(F.lit, PATTERNS)), F.col("pattern"))
    return candidates.withColumn("place", F.row_number().over(Window.partitionBy("cut").orderBy(prio, "fqn")))


def walk(steps: dict[str, tuple[DataFrame, int]], known: DataFrame) -> DataFrame:
    """walked() over the (cut, fqn) pairs of each pattern, given with its hops."""
    out = None
    for name in PATTERNS:
        if name in steps:
            df, hops = steps[name]
            df = df.select("cut", "fqn", F.lit(name).alias("pattern"), F.lit(hops).alias("hops"))
            out = df if out is None else out.unionByName(df)
    return walked(out, known)


def known_types(index: DataFrame) -> DataFrame:
    """A class index whose lists of types hold only those that are its own classes, sorted: all that a walk can reach or step over.

    What is told from it (inherited_api() above all, which has a class's types once for each descendant) holds as little.
    """
    roles, none = ("ctor_params", "method_params", "returns", "throws", "fields"), F.expr("cast(array() as array<string>)")
    named = lambda r: F.transform(F.coalesce(r, none), lambda t: F.struct(F.lit(r).alias("role"), t.alias("t")))
    each = index.select("class", F.explode(F.flatten(F.array(*map(named, roles)))).alias("x")).select("class", "x.role", "x.t")
    kept = each.join(index.select(F.col("class").alias("t")), "t", "left_semi").groupBy("class").agg(*[F.array_sort(F.collect_set(F.when(F.col("role") == r, F.col("t")))).alias(r) for r in roles])
    return index.drop(*roles).join(kept, "class", "left").withColumns({r: F.coalesce(r, none) for r in roles})


def class_walk(index: DataFrame, ancestors: DataFrame, inverse: DataFrame, api: DataFrame, built: DataFrame | None = None) -> DataFrame:
    """The walk over a class index: walk() with all nine patterns from its columns. Over known_types(index), and what
    is told from that, it gives the same with less."""
    pairs = lambda d, c: d.select(F.col("class").alias("cut"), F.explode(c).alias("fqn"))
    merged = lambda *cs: F.array_distinct(F.flatten(F.array(*[F.coalesce(c, F.expr("cast(array() as array<string>)")) for c in cs])))
    full = index.join(api.select("class", *[F.col(c).alias(f"i_{c}") for c in ("method_params", "returns", "throws", "fields")]), "class", "left").join(inverse, "class", "left")
    kinds = index.select(F.col("class").alias("fqn"), F.col("kind").alias("fqn_kind"))
    params = pairs(full, merged("ctor_params", "method_params", "i_method_params")).withColumnRenamed("fqn", "via")
    returned = pairs(full, merged("returns", "i_returns")).withColumnRenamed("fqn", "via")
    over = lambda start, columns, cond=None: start.join(full.where(cond) if cond is not None else full, F.col("via") == F.col("class")).select("cut", F.explode(columns).alias("fqn"))
    concrete = lambda d: d.join(kinds, "fqn").where(F.col("fqn_kind").isin(*CONCRETE)).select("cut", "fqn")
    open_kind = F.col("kind").isin("interface", "abstract")
    steps = {
        "own_surface": (pairs(index, merged("ctor_params", "method_params", "returns", "throws", "fields")), 1),
        "inherited_api": (pairs(full, merged("i_method_params", "i_returns", "i_throws", "i_fields")), 1),
        "supertype": (ancestors.select(F.col("src").alias("cut"), F.col("dst").alias("fqn")), 1),
        "ctor_args": (over(params, F.col("ctor_params")), 2),
        "implementations": (concrete(over(params, F.col("implemented_by"), open_kind)), 2),
        "subclasses": (concrete(pairs(full.where(open_kind | (F.size("extended_by") > 0)), merged("implemented_by", "extended_by"))), 1),
        "results": (over(returned, F.col("returns")), 2),
        "used_privately": (pairs(index, merged(F.map_keys("calls"), "instantiates", "references")), 1),
    }
    if built is not None:
        steps["producers"] = (built.select(F.col("target").alias("cut"), F.col("class").alias("fqn")), 1)
    return walk(steps, index)
