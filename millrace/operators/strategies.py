"""Strategies of retrieval by name: functions from a project's tables to candidates."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import syntax
from ..shared import spread
from . import search, walks


@dataclass
class Project:
    """The tables of a project: sources (class, source), its class index, ancestors (src, dst), and (cut, fqn) of classes and
    those that build them (graph.builders); nested_ancestors goes through nested types too."""

    sources: DataFrame
    index: DataFrame
    ancestors: DataFrame
    built: DataFrame | None = None
    nested_ancestors: DataFrame | None = None


#: Strategies by name, each from a project to (cut, fqn).
STRATEGIES: dict[str, Callable[[Project], DataFrame]] = {}
DEFAULT = "v5"
#: Strategies that give (cut, n, n_hit) for a project and what is needed, without their pairs.
COUNTED: dict[str, Callable[[Project, DataFrame], DataFrame]] = {}


def strategy(*names: str, known: dict = STRATEGIES):
    """Register a function as a strategy under its names."""

    def register(f: Callable):
        known.update({n: f for n in names})
        return f

    return register


def _simple(name: str) -> Column:
    return F.regexp_extract(name, r"([^.$]*)$", 1)


@strategy("v1")
def by_text(project: Project) -> DataFrame:
    """Classes whose simple names a source holds anywhere, within longer names and comments too."""
    names = project.index.select(F.col("class").alias("fqn"), _simple("class").alias("text"))
    docs = project.sources.select(F.col("class").alias("cut"), F.col("source").alias("text"))
    return search.containing_texts(docs, names, "fqn", "cut").select("cut", "fqn")


@strategy("v2")
def by_types(project: Project) -> DataFrame:
    """Classes whose simple names stand for types in a source's code."""
    names = spread(project.sources).select(F.col("class").alias("cut"), F.explode(syntax.type_names(syntax.tree(F.col("source")), True)).alias("name"))
    return names.join(project.index.select(F.col("class").alias("fqn"), _simple("class").alias("name")), "name").select("cut", "fqn")


def _nested(project: Project) -> DataFrame:
    return project.nested_ancestors if project.nested_ancestors is not None else project.ancestors


@strategy("v4", "v5")
def by_walk(project: Project) -> DataFrame:
    """The walk over the class index. v5 renders otherwise, and retrieves the same."""
    return walks.candidates(project.index, project.ancestors, project.built).select("cut", "fqn")


@strategy("v6")
def by_nested_walk(project: Project) -> DataFrame:
    """The walk with ancestors through nested types."""
    return walks.candidates(project.index, _nested(project), project.built).select("cut", "fqn")


@strategy("v4", "v5", known=COUNTED)
def count_walk(project: Project, needed: DataFrame) -> DataFrame:
    return walks.counted(project.index, project.ancestors, project.built, needed)


@strategy("v6", known=COUNTED)
def count_nested_walk(project: Project, needed: DataFrame) -> DataFrame:
    return walks.counted(project.index, _nested(project), project.built, needed)


def retrieved(project: Project, *names: str) -> DataFrame:
    """(strategy, cut, fqn): what the named strategies give for the project's classes, without each class itself."""
    unknown = [n for n in names if n not in STRATEGIES]
    if unknown:
        raise ValueError(f"no strategy {', '.join(unknown)}: there are {', '.join(STRATEGIES)}")
    cuts, out = project.sources.select(F.col("class").alias("cut")).distinct(), None
    for name in names or (DEFAULT,):
        rows = STRATEGIES[name](project).where("cut <> fqn").select("cut", "fqn").join(cuts, "cut", "left_semi").distinct().select(F.lit(name).alias("strategy"), "cut", "fqn")
        out = rows if out is None else out.unionByName(rows)
    return out


def _summed(rows: DataFrame, needed: DataFrame) -> DataFrame:
    marked = rows.join(needed.select("cut", "fqn").distinct().withColumn("hit", F.lit(1)), ["cut", "fqn"], "left")
    return marked.groupBy("strategy", "cut").agg(F.count("*").alias("n"), F.count("hit").alias("n_hit"))


def compared(rows: DataFrame, needed: DataFrame) -> DataFrame:
    """By strategy and class: candidates, those that needed (cut, fqn) holds, and how many are needed in all."""
    return _with_needed(_summed(rows, needed), needed)


def _with_needed(sums: DataFrame, needed: DataFrame) -> DataFrame:
    all_needed = needed.select("cut", "fqn").distinct().groupBy("cut").agg(F.count("*").alias("n_needed"))
    return sums.join(all_needed, "cut", "left").withColumn("n_needed", F.coalesce("n_needed", F.lit(0)))


def measured(project: Project, needed: DataFrame, *names: str) -> DataFrame:
    """compared() of retrieved() strategies; those of COUNTED give their numbers without their pairs."""
    cuts, sums = project.sources.select(F.col("class").alias("cut")).distinct(), None
    for name in names:
        if name in COUNTED:
            rows = COUNTED[name](project, needed).join(cuts, "cut", "left_semi").select(F.lit(name).alias("strategy"), "cut", "n", "n_hit")
        else:
            rows = _summed(retrieved(project, name), needed)  # one by one, so a pair that is told once lies where it is marked
        sums = rows if sums is None else sums.unionByName(rows)
    return _with_needed(sums, needed)
