"""Quality rules as a ledger of failure bits (operator 5).

Every rule is evaluated once for each document. The ledger keeps the measurements and one bit for
each rule that failed. Policies are bit masks with a version: a document passes a policy if it fails
none of its rules, so a new policy, or the effect of leaving one rule out, is a bitwise aggregation
over the ledger that reads no text again.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import common

SIGNS = frozenset(b"#*$%&|<>")
_SIGN = np.isin(np.arange(256), list(SIGNS))
_BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]

#: Rules in the order of their bits: name, and when a document fails it.
RULES = [
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 14 * n_words"),
    ("signs", "10 * n_symbols > 3 * n_words"),
    ("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}

#: The policies that come with the package: by version, the rules that a document must not fail. Callers
#: give their own in the same form, or as a table of (version, mask).
POLICIES = {
    1: BIT["few_words"] | BIT["repeated_windows"],
    2: sum(BIT.values()),
}
CURRENT = 2
#: The most policies that judged() takes at once.
MOST_POLICIES = 1024


def policy(*names: str) -> int:
    """The mask of a policy of the named rules."""
    return sum(BIT[name] for name in set(names))


def measure(data: bytes) -> tuple[int, ...]:
    """The measurements of one text, given as UTF-8."""
    words = data.split()  # on exactly \\x20 and \\x09-\\x0D
    n = len(words)
    raw = np.frombuffer(data, np.uint8)
    starts = (raw & 0xC0) != 0x80
    word_chars = int(np.count_nonzero(starts)) - int(np.count_nonzero(_BLANK[raw]))
    signs = int(np.count_nonzero(_SIGN[raw]))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    repeated = 0
    if n > 3:
        # Integer names make a window a cheap key; only windows seen twice are looked at again.
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            seen = Counter(windows)
            end = 0
            for i, w in enumerate(windows):
                if seen[w] > 1:
                    repeated += i + 3 - max(end, i)
                    end = i + 3
    return n, word_chars, signs, len(lines) - len(set(lines)), repeated, len(lines)


def ledger(docs: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """docs with the measurements and `failed`, the rules' failure bits, in place of columns of those names.

    A null text counts as an empty one: no words, so it fails few_words. Every row gets its own
    measurements, repeated rows the same; an empty table gives an empty ledger. `text` is only kept
    if asked for: the ledger is small and is what policies are applied to.
    """
    common.prepare(docs.sparkSession)
    names = [*MEASURES, "failed"]
    kept = [f for f in docs.schema.fields if (keep_text or f.name != text) and f.name.lower() not in names]
    source = docs.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{text}`").cast("binary").alias(common.fresh(docs, "whole_text")[0]))
    schema = T.StructType(kept + [T.StructField(n, T.LongType()) for n in MEASURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                rows = [measure(x or b"") for x in part.column(len(kept)).to_pylist()]
                new = [pa.array(c, pa.int64()) for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(kept))] + new, names=schema.names)

    bits = None
    for name, fails in RULES:
        bit = F.when(F.expr(fails), F.lit(BIT[name])).otherwise(F.lit(0))
        bits = bit if bits is None else bits.bitwiseOR(bit)
    return source.mapInArrow(run, schema).withColumn("failed", bits.cast("long"))


def passes(mask: int = POLICIES[CURRENT], failed: str = "failed"):
    """Whether a ledger row passes a policy, given as its mask."""
    return F.col(failed).bitwiseAND(F.lit(mask)) == 0


def judged(rows: DataFrame, policies: DataFrame) -> DataFrame:
    """Ledger rows under each of the policies (version, mask), a table of MOST_POLICIES rows at most: with version and kept.

    Texts aren't read again. A null mask is no policy.
    """
    few = policies.select("version", "mask").dropna(subset=["mask"]).limit(MOST_POLICIES + 1).collect()
    if len(few) > MOST_POLICIES:
        raise ValueError(f"more than {MOST_POLICIES} policies at once")
    version = policies.schema["version"].dataType
    each = F.array(*[F.struct(F.lit(r["version"]).cast(version).alias("version"), F.lit(r["mask"]).cast("long").alias("mask")) for r in few])
    if not few:
        each = F.array().cast(T.ArrayType(T.StructType([T.StructField("version", version), T.StructField("mask", T.LongType())])))
    kept = [c for c in rows.columns if c.lower() not in ("version", "kept")]
    (own,) = common.fresh(rows, "policy")
    return rows.select(*[F.col(f"`{c}`") for c in kept], F.explode(each).alias(own)).select(*[F.col(f"`{c}`") for c in kept], F.col(own)["version"].alias("version"), (F.col("failed").bitwiseAND(F.col(own)["mask"]) == 0).alias("kept"))


def passing(docs: DataFrame, mask: int = POLICIES[CURRENT], text: str = "text") -> DataFrame:
    """docs without the rows that fail a policy, in one pass and without a shuffle; for a stage that
    reads each text but once. Columns keep their names, those of the ledger's names too."""
    names = [c for c in docs.columns if c.lower() in {*MEASURES, "failed"}]
    held = common.fresh(docs, *[f"held_{i}" for i in range(len(names))])
    rows = ledger(docs.withColumnsRenamed(dict(zip(names, held))), text, keep_text=True).where(passes(mask))
    return rows.drop(*MEASURES, "failed").withColumnsRenamed(dict(zip(held, names))).select(*[F.col(f"`{c}`") for c in docs.columns])


def ablations(rows: DataFrame, mask: int = POLICIES[CURRENT], by: list[str] | None = None) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail only it, and that would pass without it.

    One pass over the ledger: counts by mask first (at most 2 ** rules rows for each group), then the
    rules over the masks. An empty ledger gives no rows.
    """
    by = by or []
    masks = rows.groupBy(*by, F.col("failed").bitwiseAND(F.lit(mask)).alias("mask")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(BIT[name]).cast("long").alias("bit")) for name, _ in RULES if BIT[name] & mask])
    each = masks.select(*by, "mask", "n", F.explode(rules).alias("r"))
    total = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0))
    return each.groupBy(*by, F.col("r.rule").alias("rule")).agg(
        total(F.col("mask").bitwiseAND(F.col("r.bit")) != 0).alias("n_failed"),
        total(F.col("mask") == F.col("r.bit")).alias("n_only"),
        total(F.col("mask").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0).alias("n_kept_without"),
    )


def op5_rule_ledger(spark, sf_dir: str) -> DataFrame:
    """Measurements, failure bits and verdict of every document under the current policy."""
    rows = ledger(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return rows.select("doc_id", *MEASURES[:5], (~passes(POLICIES[1])).alias("base_failed"), passes().alias("kept"), "failed")


_WORD = r"[^\x20\x09-\x0D]"
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{_WORD}+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l FROM d),
windows AS (SELECT doc_id, i, w[i:i + 2] AS three FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, three) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM again) GROUP BY 1),
m AS (SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(l) AS n_lines FROM w LEFT JOIN covered c USING (doc_id)),
f AS (SELECT *, CAST({" + ".join(f"CASE WHEN {fails} THEN {BIT[name]} ELSE 0 END" for name, fails in RULES)} AS BIGINT) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & {POLICIES[1]} <> 0 AS base_failed, failed & {POLICIES[CURRENT]} = 0 AS kept, failed FROM f
"""
