"""Secret scans: fixed patterns, and windows of high Shannon entropy (operator 8), in built-in functions only.

Spans are code points, end exclusive. Where a pattern matches is found from what lies between its
matches: lengths of the gaps that split() leaves and of the matches themselves, summed up in turn.

The entropy scan takes candidate strings of one character class. A window of fixed width moves over
a candidate; its sum of c * log2(c) over character counts c changes by the entering and the leaving
character alone, so each step costs the same for any width. A candidate is reported if some window's
entropy reaches the class's threshold and no allow-list pattern matches it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import common

#: Patterns of the base kinds, in the order in which equal starts are listed.
BASE = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""),
    ("access", r"AKIA[A-Z0-9]+"),
    ("hex", r"[0-9a-f]+"),
]
#: The shortest match of a kind that counts; for assign, of the value behind the sign.
LEAST = {"assign": 6, "access": 20, "hex": 24}
VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""

#: Character classes of the entropy scan: kind, candidates, window, bits in a window.
CLASSES = [
    ("entropy64", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{24,}", 24, 3.9),
    ("entropy32", r"(?<![A-Z0-9])(?=[A-Z]*[0-9])[A-Z0-9]{24,}", 24, 3.6),
    # lower-case letters and digits; what is hex alone is of the base kind
    ("entropy36", r"(?<![A-Za-z0-9])(?![0-9a-f]+(?![A-Za-z0-9]))(?=[a-z]*[0-9])(?=[0-9]*[a-z])[a-z0-9]{24,}", 24, 3.6),
    # mixed case without a digit: names put together of words stay below this
    ("entropy52", r"(?<![A-Za-z0-9])(?=[a-z]*[A-Z])(?=[A-Z]*[a-z])[A-Za-z]{24,}", 24, 4.1),
]
#: Candidates that are no secrets: placeholders, and words or paths with a short number at the end.
ALLOW = [r"(?i)example|sample|placeholder|changeme|redacted|x{6}|0{8}|1234567", r"^[A-Za-z/_-]+[0-9]{1,8}$"]
KINDS = [k for k, _ in BASE] + [k for k, *_ in CLASSES]

_SPAN = "array<struct<start:int,end:int,kind:int,match:string>>"
_NONE = f"cast(array() as {_SPAN})"
#: Runs that hold every candidate of the entropy scan and every hex match. What stands beside a run is in
#: none of the classes, so a pattern is in a text exactly if it is in one of the text's runs.
LONG_RUN = "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}"


def _quoted(pattern: str) -> str:
    """A pattern as an SQL string."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def spans_of(text: str, pattern: str, kind: int, within: str | None = None) -> str:
    """SQL for all leftmost, non-overlapping matches, in the column `text`, of a pattern that never matches an empty string.

    `within`: a shorter text that holds the pattern exactly if `text` does, and is looked at first.
    Linear in the text and nearly so in the matches, see common.running().
    """
    p = _quoted(pattern)
    # each array is bound to a name by a lambda over one element, so that it is made once
    bound = lambda value, name, body: f"transform(array({value}), {name} -> {body})[0]"
    sizes = f"zip_with(slice(split({text}, {p}, -1), 1, size(m)), m, (g, x) -> named_struct('gap', length(g), 'size', length(x)))"
    placed = "zip_with(n, s, (x, y) -> named_struct('start', cast(y + x.gap as int), 'end', cast(y + x.gap + x.size as int)))"
    spans = f"zip_with(m, {placed}, (x, y) -> named_struct('start', y.start, 'end', y.end, 'kind', {kind}, 'match', x))"
    whole = bound(f"regexp_extract_all({text}, {p}, 0)", "m", bound(sizes, "n", bound("transform(n, x -> cast(x.gap + x.size as bigint))", "w", bound(common.running_sql("w"), "s", spans))))
    return f"CASE WHEN {within or text} RLIKE {p} THEN {whole} ELSE {_NONE} END"


#: What a count of 0 is written as; a window's counts are kept as a string, a sign for each character.
_ZERO = 48


def most_entropy(candidate: str, width: int) -> str:
    """SQL for the highest entropy, in bits a character, of a window of `width` ASCII characters (or of all, if fewer).

    The counts of the window's characters are signs of one string: a step reads and replaces the
    entering character's and the leaving one's, whatever the width.
    """
    term = lambda c: f"CASE WHEN {c} > 1 THEN {c} * log2({c}) ELSE 0.0D END"
    count = lambda code: f"ascii(substring(a.counts, {code} + 1, 1)) - {_ZERO}"
    put = lambda counts, code, n: f"overlay({counts} PLACING char({n} + {_ZERO}) FROM {code} + 1 FOR 1)"
    # s: the character that enters, and the one `width` places before it, which leaves, null at first
    same, stays = "coalesce(s.leaves = s.enters, false)", "(s.leaves IS NULL OR s.leaves = s.enters)"
    c_in, c_out = f"({count('s.enters')})", f"({count('s.leaves')})"
    total = f"a.sum + (CASE WHEN {stays} THEN 0.0D ELSE {term(f'({c_out} - 1)')} - {term(c_out)} END) + (CASE WHEN {same} THEN 0.0D ELSE {term(f'({c_in} + 1)')} - {term(c_in)} END)"
    without = f"CASE WHEN {stays} THEN a.counts ELSE {put('a.counts', 's.leaves', f'{c_out} - 1')} END"
    counts = f"CASE WHEN {same} THEN a.counts ELSE {put(without, 's.enters', f'{c_in} + 1')} END"
    least = "CASE WHEN a.held + 1 >= a.n THEN least(a.least, t) ELSE a.least END"
    step = f"transform(array({total}), t -> named_struct('counts', {counts}, 'sum', t, 'held', a.held + 1, 'n', a.n, 'least', {least}))[0]"
    begin = f"named_struct('counts', repeat('{chr(_ZERO)}', 128), 'sum', 0.0D, 'held', 0, 'n', least(length({candidate}), {width}), 'least', 1e9D)"
    codes = f"transform(split({candidate}, ''), c -> ascii(c))"
    steps = f"zip_with({codes}, slice(concat(array_repeat(cast(null as int), {width}), {codes}), 1, length({candidate})), (c, d) -> named_struct('enters', c, 'leaves', d))"
    # entropy = log2(n) - sum / n, so the highest entropy has the least sum
    return f"aggregate({steps}, {begin}, (a, s) -> {step}, a -> log2(a.n) - a.least / a.n)"


def entropy_spans(text: str, kind: int, runs: str | None = None) -> str:
    _, pattern, width, bits = CLASSES[kind - len(BASE)]
    allowed = " OR ".join(f"z.match RLIKE {_quoted(p)}" for p in ALLOW) or "false"
    return f"filter({spans_of(text, pattern, kind, runs)}, z -> NOT ({allowed}) AND {most_entropy('z.match', width)} >= {bits})"


def base_spans(text: str, kind: int, runs: str | None = None) -> str:
    name, pattern = BASE[kind]
    if name == "assign":
        signed = f"CASE WHEN contains({text}, ':') OR contains({text}, '=') THEN {text} ELSE '' END"
        return f"filter({spans_of(text, pattern, kind, signed)}, z -> length(regexp_replace(z.match, {_quoted(VALUE)}, '')) >= {LEAST[name]})"
    # For these, matches of the class that are long enough are the long ones among all its matches.
    longer = {"access": f"AKIA[A-Z0-9]{{{LEAST['access'] - 4},}}", "hex": f"[0-9a-f]{{{LEAST['hex']},}}"}[name]
    return spans_of(text, longer, kind, runs if name == "hex" else None)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `found`: an array of (start, end, kind name) by start, then kind as listed in KINDS.

    A null or empty text has no spans. Spans of different kinds may overlap; within a kind they don't.
    Repeated rows get the same spans; columns other than `found` stay, whatever their names. Each
    text is scanned whole, in its own row: nothing is shuffled.
    """
    out, whole, runs = common.fresh(docs, "found_spans", "whole_text", "long_runs")
    df = docs.withColumn(whole, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    t, r, long = f"`{whole}`", f"`{runs}`", _quoted(LONG_RUN)
    df = df.withColumn(runs, F.expr(f"CASE WHEN {t} RLIKE {long} THEN array_join(regexp_extract_all({t}, {long}, 0), ' ') ELSE '' END"))
    every = [base_spans(t, k, r) for k in range(len(BASE))] + [entropy_spans(t, k, r) for k in range(len(BASE), len(KINDS))]
    names = ", ".join(f"'{k}'" for k in KINDS)
    ordered = f"array_sort(transform(concat({', '.join(every)}), z -> named_struct('start', z.start, 'kind', z.kind, 'end', z.end)))"
    found = F.expr(f"transform({ordered}, z -> named_struct('start', z.start, 'end', z.end, 'kind', element_at(array({names}), z.kind + 1)))")
    df = df.withColumn(out, found).drop(whole, runs)
    return df.drop("found").withColumnRenamed(out, "found")


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with every span of `text` replaced by `mark`; overlapping or touching spans become one.

    Texts without spans, null ones too, stay as they are, and so do columns of any other name.
    """
    out, parts, ends = common.fresh(docs, "found_spans", "cut_blocks", "upto")
    held = [c for c in docs.columns if c.lower() == "found"]
    (spare,) = common.fresh(docs, "held_found")
    rows = scan(docs.withColumnsRenamed({c: spare for c in held}), spare if text in held else text).withColumnRenamed("found", out)
    t, s = F.col(f"`{spare if text in held else text}`"), F.col(out)
    some = F.size(s) > 0
    # what is kept before a span begins where all spans before it have ended
    rows = rows.withColumn(parts, F.when(some, common.blocks(t))).withColumn(ends, F.transform(s, lambda x: x["end"])).withColumn(ends, common.running(ends, greatest=True))
    kept = F.zip_with(s, F.col(ends), lambda x, e: F.when((x["start"] > e) | (e == 0), F.concat(common.cut(F.col(parts), e, x["start"].cast("long")), F.lit(mark))).otherwise(F.lit("")))
    last = F.greatest(F.element_at(ends, -1), F.element_at(s, -1)["end"].cast("long"))
    clean = F.concat(F.array_join(kept, ""), common.cut(F.col(parts), last, F.length(t).cast("long")))
    rows = rows.withColumn(spare if text in held else text, F.when(some, clean).otherwise(t)).drop(out, parts, ends)
    return rows.withColumnsRenamed({spare: c for c in held}).select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Counts and spans of secrets in every document."""
    rows = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "found")
    base = F.filter("found", lambda s: s["kind"].isin(*[k for k, _ in BASE]))
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k, _ in BASE]
    return rows.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
