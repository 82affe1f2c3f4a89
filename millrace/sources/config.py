"""Settings: the environment over a file of NAME=value lines, with getters that refuse what makes no sense."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import SparkSession


def read_env(spark: SparkSession, path: str) -> dict[str, str]:
    """A file of NAME=value lines, from any file system that Spark reads; blank lines, comments and quotes around values are left out."""
    out = {}
    for row in spark.read.text(path).collect():  # a file of settings
        name, sign, value = row["value"].strip().partition("=")
        if sign and not name.startswith("#"):
            out[name.strip()] = value.strip().strip("\"'")
    return out


def layered(spark: SparkSession, path: str | None = None, environment: Mapping[str, str] | None = None) -> dict[str, str]:
    """The file's settings with those of the environment over them."""
    return (read_env(spark, path) if path else {}) | dict(os.environ if environment is None else environment)


def _number(settings: Mapping[str, str], name: str, kind: type):
    raw = settings.get(name)
    if not raw:
        raise ValueError(f"{name} is not set")
    try:
        value = kind(raw)
    except ValueError as e:
        raise ValueError(f"{name} must be {'an integer' if kind is int else 'a number'}, not {raw!r}") from e
    if value < 0:
        raise ValueError(f"{name} must not be negative")
    return value


def get_int(settings: Mapping[str, str], name: str) -> int:
    return _number(settings, name, int)


def get_float(settings: Mapping[str, str], name: str) -> float:
    return _number(settings, name, float)
