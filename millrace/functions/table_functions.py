"""Table functions by name, for LATERAL joins in SQL: one source to many rows."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..shared import ship

#: Names and result types of the table functions.
TYPES = {
    "java_declarations": "kind string, name string, depth int, visibility string, first int, last int, params array<string>, returns string",
    "java_names": "name string, kind string, line int",
    "java_tests": "name string, first int, last int",
    "java_members": "owner string, name string, kind string, visibility string, params array<string>, returns string, decl string",
}


def _made() -> dict:
    # classes are made when they are registered, as workers get them by value and import what they need there
    class Declarations:
        def eval(self, source: str):
            from millrace.functions import syntax

            for d in syntax.nodes_of(source)["decls"] if source is not None else []:
                yield d["kind"], d["name"], d["depth"], d["visibility"], source.count("\n", 0, d["begin"]) + 1, source.count("\n", 0, max(d["begin"], d["end"] - 1)) + 1, d["params"], d["returns"]

    class Names:
        def eval(self, source: str):
            from millrace.functions import syntax

            for n in syntax.nodes_of(source)["names"] if source is not None else []:
                yield n["name"], n["kind"], source.count("\n", 0, n["begin"]) + 1

    class Tests:
        def eval(self, source: str):
            from millrace.functions import java

            yield from java.spans_of(source) if source is not None else []

    class Members:
        def eval(self, text: str):
            from millrace.functions import java

            for m in java.disassembled(text) if text is not None else []:
                yield m["owner"], m["name"], m["kind"], m["visibility"], m["params"], m["returns"], m["decl"]

    return {"java_declarations": Declarations, "java_names": Names, "java_tests": Tests, "java_members": Members}


def register(spark: SparkSession) -> list[str]:
    """Register all table functions for the session's SQL; their names. A null source gives no rows."""
    ship(spark)
    for name, made in _made().items():
        spark.udtf.register(name, udtf(made, returnType=TYPES[name]))
    return list(TYPES)
