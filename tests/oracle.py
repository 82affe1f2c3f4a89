"""Spark queries and their SQL side by side: row counts and values without regard to order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows_of_sql(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    table = con.execute(sql).to_arrow_table() if hasattr(con, "to_arrow_table") else con.execute(sql).arrow()
    table = table.read_all() if hasattr(table, "read_all") else table
    names = sorted(table.column_names)
    return names, [tuple(plain(r[c]) for c in names) for r in table.select(names).to_pylist()]


def rows_of_spark(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, [tuple(plain(r[c]) for c in names) for r in df.select(names).collect()]


def key(row: tuple):
    return tuple((v is not None, str(type(v)), v if v is not None else 0) for v in row)


def difference(spark, sf_dir: str, query, sql: str) -> str:
    """Nothing if the two agree, else what doesn't."""
    (a_names, a), (b_names, b) = rows_of_spark(query(spark, sf_dir)), rows_of_sql(sf_dir, sql)
    if a_names != b_names:
        return f"columns {a_names} and {b_names}"
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    for x, y in zip(sorted(a, key=key), sorted(b, key=key)):
        if x != y:
            return f"{x} and {y}"
    return ""
