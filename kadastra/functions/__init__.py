"""Functions of the domain as Spark columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once however often f names it: a lambda's argument is bound, not repeated."""
    return F.get(F.transform(F.array(value), f), 0)
