"""URL filters from dated lists: validity intervals and an as-of join (operator 10).

A list is a log of dated changes: an entry (a host, a domain with all below it, or a path prefix)
is added with a verdict, or removed. Each change holds until the next of the same entry, which gives
intervals [valid_from, valid_to). A capture is looked up under every key its URL has - the host, each
domain above it, each prefix of its path - and meets the entries in force when it was fetched. Keys
carry the interval's months, so a much-changed entry or a much-captured host is spread over months.
The most specific entry decides: a longer prefix, then the host, then a longer domain; `allow` wins
between equals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common

#: Kinds of entries, least specific first.
KINDS = ("domain", "host", "prefix")
#: The end of an interval that hasn't ended.
OPEN_END = "9999-12-31 00:00:00"
#: Up to so many bytes the lists' keys are sent to the captures.
SENT_BYTES = 32 << 20
HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"


def host_of(url: Column) -> Column:
    """The lower-case host without user, port and final dot; null where there is none."""
    return F.nullif(F.rtrim(F.regexp_extract(F.lower(url), HOST, 1), F.lit(".")), F.lit(""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, PATH, 1)


def keys_of(url: Column) -> Column:
    """All keys under which a URL is listed: array of (kind, key)."""
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    steps = F.filter(F.split(path, "/"), lambda s: s != "")
    key = lambda kind, k: F.struct(F.lit(kind).alias("kind"), k.alias("key"))
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))), lambda i: key("domain", F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    prefixes = F.transform(F.sequence(F.lit(0), F.greatest(F.size(steps), F.lit(0))), lambda i: key("prefix", F.array_join(F.concat(F.array(host), F.slice(steps, F.lit(1), i)), "/")))
    none = F.expr("cast(array() as array<struct<kind:string,key:string>>)")
    return F.when(host.isNull(), none).otherwise(F.array_distinct(F.concat(F.array(key("host", host)), domains, F.coalesce(prefixes, none))))


def intervals(changes: DataFrame) -> DataFrame:
    """(kind, key, verdict, changed_at) -> (kind, key, verdict, valid_from, valid_to).

    `verdict` is allow, block or remove. Of changes of one entry at one time the last of remove,
    block, allow holds. Empty steps of a prefix don't count, as in keys_of(): `host/` is all of a host.
    Changes without a kind, key, verdict or time are no changes.
    """
    rows = changes.select("kind", F.lower("key").alias("key_lower"), "key", "verdict", "changed_at").dropna()
    parts = F.split("key", "/")
    steps = F.filter(F.slice(parts, F.lit(2), F.size(parts)), lambda s: s != "")
    rows = rows.withColumn("key", F.when(F.col("kind") == "prefix", F.array_join(F.concat(F.array(F.lower(parts[0])), steps), "/")).otherwise(F.col("key_lower"))).drop("key_lower")
    order = F.when(F.col("verdict") == "remove", 0).when(F.col("verdict") == "block", 1).otherwise(2)
    last = rows.groupBy("kind", "key", "changed_at").agg(F.max_by("verdict", order).alias("verdict"))
    ends = F.lead("changed_at").over(Window.partitionBy("kind", "key").orderBy("changed_at"))
    held = last.withColumn("valid_to", F.coalesce(ends, F.lit(OPEN_END).cast("timestamp"))).where("verdict <> 'remove'")
    return held.select("kind", "key", "verdict", F.col("changed_at").alias("valid_from"), "valid_to")


def evaluate(captures: DataFrame, lists: DataFrame, url: str = "url", fetched_at: str = "fetched_at") -> DataFrame:
    """captures with verdict, entry_kind, entry_key, valid_from and valid_to of the entry that decides.

    `lists` are intervals(). Captures no entry covers, without a host or a time, get verdict `none`
    and nulls; repeated rows get the same; columns of the new names are replaced. Hot hosts are split
    by Spark's skew join: the side of the intervals has few rows for a key and month.
    """
    u, t = common.fresh(captures, "asked_url", "asked_at")
    new = ["verdict", "entry_kind", "entry_key", "valid_from", "valid_to"]
    kept = [c for c in captures.columns if c.lower() not in new]
    asked = captures.select(F.col(f"`{url}`").cast("string").alias(u), F.col(f"`{fetched_at}`").cast("timestamp").alias(t)).dropna().distinct()
    month = lambda c: F.year(c) * 12 + F.month(c)
    points = asked.withColumn("k", F.explode(keys_of(F.col(u)))).select(u, t, "k.kind", "k.key", month(F.col(t)).alias("month"))
    # keys that no list has go before they are shuffled, if the lists' keys are few enough to be sent to the rows
    listed = common.saved(lists.select("kind", "key").distinct(), "listed")
    if (listed.agg(F.coalesce(F.sum(F.octet_length("key") + 32), F.lit(0))).first()[0]) <= SENT_BYTES:
        points = points.join(F.broadcast(listed), ["kind", "key"], "left_semi")
    # an open end covers no month beyond the last capture
    last = captures.agg(F.max(F.col(f"`{fetched_at}`").cast("timestamp"))).first()[0]
    until = F.least(F.col("valid_to"), F.greatest(F.col("valid_from"), F.lit(last).cast("timestamp")))
    spans = lists.withColumn("month", F.explode(F.sequence(month(F.col("valid_from")), month(until))))
    met = points.join(spans, ["kind", "key", "month"]).where((F.col("valid_from") <= F.col(t)) & (F.col(t) < F.col("valid_to")))
    kind = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    rank = F.struct(kind.alias("kind_rank"), F.length("key").alias("length"), (F.col("verdict") == "allow").alias("allow"), "valid_from", "verdict", "kind", "key", "valid_to")
    best = met.groupBy(u, t).agg(F.max(rank).alias("best"))
    best = best.select(F.col(u).alias(f"{u}_b"), F.col(t).alias(f"{t}_b"), "best.verdict", F.col("best.kind").alias("entry_kind"), F.col("best.key").alias("entry_key"), "best.valid_from", "best.valid_to")
    rows = captures.select(*[F.col(f"`{c}`") for c in kept]).join(best, (F.col(f"`{url}`").cast("string") == F.col(f"{u}_b")) & (F.col(f"`{fetched_at}`").cast("timestamp") == F.col(f"{t}_b")), "left").drop(f"{u}_b", f"{t}_b")
    return rows.withColumn("verdict", F.coalesce("verdict", F.lit("none")))


#: The query's lists: for hosts whose digest is divisible by 5, blocked, cleared and blocked again; for
#: digests divisible by 7, an allowed section; and one domain blocked for a month.
CHANGES_SQL = """
SELECT 'host' AS kind, host AS key, 'block' AS verdict, TIMESTAMP '2024-01-01 00:00:00' + make_days(h % 200) AS changed_at FROM hosts WHERE h % 5 = 0
UNION ALL SELECT 'host', host, 'remove', TIMESTAMP '2024-01-01 00:00:00' + make_days(h % 200 + 40 + h % 90) FROM hosts WHERE h % 5 = 0
UNION ALL SELECT 'host', host, 'block', TIMESTAMP '2024-01-01 00:00:00' + make_days(h % 200 + 140) FROM hosts WHERE h % 5 = 0
UNION ALL SELECT 'prefix', concat(host, '/en'), 'allow', TIMESTAMP '2024-01-01 00:00:00' + make_days(h % 100) FROM hosts WHERE h % 7 = 0
UNION ALL SELECT 'domain', 'example.net', 'block', TIMESTAMP '2024-10-01 00:00:00' FROM hosts WHERE host LIKE '%.example.net'
UNION ALL SELECT 'domain', 'example.net', 'remove', TIMESTAMP '2024-11-01 00:00:00' FROM hosts WHERE host LIKE '%.example.net'
"""


def op10_temporal_url_filter(spark, sf_dir: str) -> DataFrame:
    """The verdict on every page as of its fetch time (days and hours of 2024 told by page_id)."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    fetched = F.expr("TIMESTAMP '2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(pmod(page_id * 37, 365) as int), cast(pmod(page_id, 24) as int))")
    captures = pages.withColumn("host", host_of(F.col("url"))).withColumn("fetched_at", fetched)
    hosts = captures.select("host").dropna().distinct().withColumn("h", F.conv(F.substring(F.md5("host"), 1, 6), 16, 10).cast("int"))
    sql = CHANGES_SQL.replace("make_days(", "make_interval(0, 0, 0, ")
    changes = spark.sql(sql.replace("FROM hosts", "FROM {hosts}"), hosts=hosts)
    return evaluate(captures, intervals(changes)).select("page_id", "host", "fetched_at", "verdict", "entry_kind", "entry_key", "valid_from", "valid_to")


ORACLE = r"""
WITH pages_at AS (
  SELECT page_id, url, nullif(rtrim(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '.'), '') AS host,
    TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(page_id * 37 % 365 AS INTEGER)) + to_hours(CAST(page_id % 24 AS INTEGER)) AS fetched_at
  FROM pages),
hosts AS (SELECT host, CAST('0x' || substr(md5(host), 1, 6) AS INTEGER) AS h FROM (SELECT DISTINCT host FROM pages_at WHERE host IS NOT NULL)),
changes AS (SELECT DISTINCT * FROM (""" + CHANGES_SQL.replace("make_days(", "to_days(") + r""")),
lists AS (
  SELECT kind, key, verdict, changed_at AS valid_from, coalesce(lead(changed_at) OVER (PARTITION BY kind, key ORDER BY changed_at), TIMESTAMP '9999-12-31 00:00:00') AS valid_to FROM changes),
met AS (
  SELECT p.page_id, l.*, row_number() OVER (PARTITION BY p.page_id ORDER BY CASE l.kind WHEN 'domain' THEN 1 WHEN 'host' THEN 2 ELSE 3 END DESC, length(l.key) DESC) AS r
  FROM pages_at p JOIN lists l ON l.verdict <> 'remove' AND l.valid_from <= p.fetched_at AND p.fetched_at < l.valid_to AND (
    l.kind = 'host' AND p.host = l.key
    OR l.kind = 'domain' AND (p.host = l.key OR ends_with(p.host, '.' || l.key))
    OR l.kind = 'prefix' AND starts_with(p.host || regexp_extract(p.url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) || '/', l.key || '/')))
SELECT p.page_id, p.host, p.fetched_at, coalesce(m.verdict, 'none') AS verdict, m.kind AS entry_kind, m.key AS entry_key, m.valid_from, m.valid_to
FROM pages_at p LEFT JOIN met m ON m.page_id = p.page_id AND m.r = 1
"""
