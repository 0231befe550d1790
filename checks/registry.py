"""Name -> (Spark query, check SQL)."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.views import Views

QUERIES: dict[str, Callable[[Views], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register the decorated function (Views -> DataFrame) under its own name."""

    def add(fn: Callable[[Views], DataFrame]):
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = sql
        return fn

    return add


def flat(df: DataFrame, *columns: str) -> DataFrame:
    """Times as ISO text, dates as text and string arrays joined, so both engines print alike."""
    out = []
    for name, kind in (df.select(*columns) if columns else df).dtypes:
        c = F.col(name)
        if kind == "timestamp":
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
        elif kind == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        elif kind == "array<string>":
            c = F.array_join(c, "|")
        elif kind in ("int", "smallint"):
            c = c.cast("long")
        out.append(c.alias(name))
    return df.select(*out)


def iso(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%dT%H:%M:%S.%gZ')"


def ymd(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d')"
