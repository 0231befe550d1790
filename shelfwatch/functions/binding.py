"""Naming an intermediate value inside a column expression."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row however often the body uses it.

    Spark does not share subexpressions across short-circuiting branches; a lambda
    over a one-element array does.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
