"""Audit of how filters act together, by inclusion and exclusion (operator 11).

One pass over the texts tells each document's failures. All further figures come from the joint-failure
counts: for every set S of filters, how many documents fail all of S. Each is a sum of products of 0/1
flags, so it combines before its shuffle, and with n filters a part has 2 ** n of them, however many
documents it holds. Möbius inversion of these counts gives

* the survivors of any set P of filters: the sum over S within P of (-1) ** |S| times S's count,
  so what each order of the filters keeps after each of its steps;
* what fails one filter only: the sum over S holding it of (-1) ** (|S| - 1) times S's count;
* each filter's Shapley value: the game "documents removed by a set of filters" has the Harsanyi
  dividends (-1) ** (|S| - 1) times S's count, and each dividend is shared evenly by the filters of S.

No order is replayed over documents.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, functions as F

from . import common

_BLANK = r"[\x20\x09-\x0D]"

#: The filters in the order of their bits.
FILTERS = "ABCDE"
#: The most filters of one audit: 2 ** n counts are columns, n! orders are rows.
MOST_FILTERS = 7


def conditions(text: Column) -> dict[str, Column]:
    """When a document fails filters A to D, told from its text (not null)."""
    words = F.filter(F.split(text, _BLANK + "+"), lambda w: w != "")
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 5 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def failures(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """Documents counted by their failures: (part, a, b, c, d, e as 0 or 1, good, toxic, n).

    A null text is an empty one, a null part the empty string. A document fails E if a smaller doc_id
    has the same text, wherever it is; a document without a doc_id is no later than any, so it doesn't
    fail E, isn't what others repeat, and has no label. Rows repeated with one doc_id count each, and
    don't repeat each other. An id with several labels is good, or toxic, if one of them says so.

    Texts go through no shuffle: a 256-bit digest stands for one. Rows of equal digests, parts and
    flags are combined before they meet, so a text on a third of all rows is a few rows.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    fails = conditions(F.col("t"))
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), t.alias("t"))
    rows = rows.select("id", "part", F.unhex(F.sha2("t", 256)).alias("digest"), *[fails[f].cast("int").alias(f.lower()) for f in "ABCD"])
    # rows without an id are spread by their digests; no label has such a key
    spread = F.when(F.col("id").isNull(), F.xxhash64("digest")).otherwise(0)
    marks = labels.where("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy(F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("spread")).agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"), F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic")
    )
    own = ["digest", "part", "a", "b", "c", "d"]
    each = rows.withColumn("spread", spread).groupBy("id", "spread", *own).agg(F.count("*").alias("n"))
    each = each.join(marks, ["id", "spread"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})
    alike = each.groupBy(*own, "good", "toxic").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("n_null"), F.min("id").alias("first"), F.min_by("n", "id").alias("n_first"))
    alike = common.saved(alike, "failures")
    least = alike.groupBy("digest").agg(F.min("first").alias("least"))
    # of the rows alike, those of the text's least id don't fail E, nor those without an id
    known = alike.join(least, "digest").withColumn("n_kept", F.col("n_null") + F.when(F.col("first") == F.col("least"), F.col("n_first")).otherwise(0))
    halves = F.explode(F.array(F.struct(F.lit(0).alias("e"), F.col("n_kept").alias("m")), F.struct(F.lit(1).alias("e"), (F.col("n") - F.col("n_kept")).alias("m"))))
    return known.select("part", "a", "b", "c", "d", "good", "toxic", halves.alias("h")).select("part", "a", "b", "c", "d", "h.e", "good", "toxic", F.col("h.m").alias("n")).where("n > 0")


def joint_failures(flagged: DataFrame, flags: list[str], weights: dict[str, Column]) -> DataFrame:
    """For each part, and each weight, an array: at place S (a set of flags as bits, from 0) the sum of weight times the product of S's flags."""
    if len(flags) > MOST_FILTERS:
        raise ValueError(f"more than {MOST_FILTERS} filters at once")
    sums = []
    for name, weight in weights.items():
        for s in range(2 ** len(flags)):
            product = weight
            for i, f in enumerate(flags):
                if s >> i & 1:
                    product = product * F.col(f)
            sums.append(F.sum(product).alias(f"{name}_{s}"))
    wide = flagged.groupBy("part").agg(*sums)
    return wide.select("part", *[F.array(*[F.col(f"{name}_{s}") for s in range(2 ** len(flags))]).alias(name) for name in weights])


def survivors(joint: str, n: int) -> Column:
    """From joint-failure counts to the survivors of every set of filters, by Möbius inversion."""
    term = f"IF(bit_count(s) % 2 = 0, `{joint}`[s], -`{joint}`[s])"
    return F.expr(f"transform(sequence(0, {2**n - 1}), p -> aggregate(filter(sequence(0, {2**n - 1}), s -> s & p = s), 0L, (acc, s) -> acc + {term}))")


def dividends(joint: str, n: int, shares: bool) -> Column:
    """For every filter the sum of the Harsanyi dividends of the sets that hold it: whole (what fails it
    alone), or with shares each divided by the set's size and multiplied by the n! orders (exact in longs)."""
    share = f"* {factorial(n)} div bit_count(s)" if shares else ""
    term = f"IF(bit_count(s) % 2 = 1, `{joint}`[s], -`{joint}`[s]) {share}"
    return F.expr(f"transform(sequence(0, {n - 1}), f -> aggregate(filter(sequence(1, {2**n - 1}), s -> shiftright(s, f) % 2 = 1), 0L, (acc, s) -> acc + {term}))")


def by_order(joint: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, all, good, toxic: joint-failure counts) -> a row for each part, order of the filters and step.

    kept: documents left after the step; removed: those it takes; redundant: those that fail its filter
    but are gone already; unique_fails: those that fail no other; good_lost, toxic_lost: marked ones
    among the removed; shapley: what the filter removes over all orders together.
    """
    n = len(filters)
    told = joint.select("part", F.col("all"), *[survivors(c, n).alias(f"left_{c}") for c in ("all", "good", "toxic")], dividends("all", n, False).alias("alone"), dividends("all", n, True).alias("shares"))
    # two small arrays give the orders and the steps of each
    orders = told.withColumn("filter_order", F.explode(F.split(F.lit(" ".join("".join(p) for p in permutations(filters))), " "))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    mask = lambda length: f"aggregate(sequence(1, {n}), 0, (acc, k) -> IF(k <= {length}, acc + cast(shiftleft(1, instr('{filters}', substr(filter_order, k, 1)) - 1) as int), acc))"
    steps = orders.withColumns({"f": F.expr(f"instr('{filters}', substr(filter_order, step, 1)) - 1"), "before": F.expr(mask("step - 1")), "after": F.expr(mask("step"))})
    lost = lambda c: F.expr(f"left_{c}[before] - left_{c}[after]")
    return steps.select(
        "part", "filter_order", "step", F.expr("left_all[after]").alias("kept"), lost("all").alias("removed"), (F.expr("`all`[cast(shiftleft(1, f) as int)]") - lost("all")).alias("redundant"),
        F.expr("alone[f]").alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.expr("shares[f]").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, **names: str) -> DataFrame:
    """The whole audit of filters A to E over documents; names as in failures(). No documents give no rows."""
    flagged = failures(docs, labels, **names)
    n = F.col("n")
    return by_order(joint_failures(flagged, ["a", "b", "c", "d", "e"], {"all": n, "good": n * F.col("good"), "toxic": n * F.col("toxic")}))


def op11_filter_interactions(spark, sf_dir: str) -> DataFrame:
    """Five filters over all documents, by source, in every order and at every step."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: Replays every order over the counts of documents by their failures.
ORACLE = r"""
WITH docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM docs),
f AS (SELECT doc_id, part, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > least, false)] AS f FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
c AS (SELECT part, f, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders),
marked AS (SELECT part, filter_order, n, good, toxic, f, coalesce(list_position(list_transform(range(1, 6), lambda k: f[instr('ABCDE', filter_order[k])]), true), 9) AS gone FROM c, orders),
s AS (SELECT part, filter_order, step, instr('ABCDE', filter_order[step]) AS x, sum(CASE WHEN gone > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN gone = step THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN gone < step AND f[instr('ABCDE', filter_order[step])] THEN n ELSE 0 END) AS redundant, sum(CASE WHEN gone = step AND len(list_filter(f, lambda y: y)) = 1 THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN gone = step THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN gone = step THEN toxic ELSE 0 END) AS toxic_lost
  FROM marked JOIN steps USING (filter_order) GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM s
"""
