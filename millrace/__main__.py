"""python -m millrace QUERY FOLDER [ROWS]: run a registered query over the tables of a folder and show its first rows; without a query, list them."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from .plans import registry


def main(args: list[str]) -> int:
    if len(args) < 2:
        for name, f in sorted(registry.QUERIES.items()):
            print(f"{name:<28}{(f.__doc__ or '').strip().splitlines()[0]}")
        return 0 if not args else 2
    if args[0] not in registry.QUERIES:
        print(f"no query is named {args[0]}", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName(args[0]).getOrCreate()
    registry.QUERIES[args[0]](spark, args[1]).show(int(args[2]) if len(args) > 2 else 20, truncate=80)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
