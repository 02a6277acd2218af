"""Registration helpers for the query catalog."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Registry(dict):
    """name -> (query, oracle SQL or None)."""

    def add(self, name: str, sql: str | None = None):
        def wrap(fn: Query) -> Query:
            self[name] = (fn, sql)
            return fn

        return wrap


def r6(name: str):
    """One column to 6 digits, as ``rounded`` does it."""
    return F.round(F.col(name) + 1e-9, 6).alias(name)


def rounded(df: DataFrame, digits: int | None = None) -> DataFrame:
    """Round every double column, so that sums in another order compare equal.

    Without ``digits``: 6, after a shift far below them. Means of few values often lie exactly
    on a half, where the order of a sum decides the last digit.
    """
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.dataType.typeName() in ("double", "float"):
            c = F.round(c + 1e-9, 6) if digits is None else F.round(c, digits)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def joined_lists(df: DataFrame, sep: str = "|") -> DataFrame:
    """Array columns as one string, for comparison with SQL."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.dataType.typeName() == "array":
            c = F.concat_ws(sep, F.transform(c, lambda x: x.cast("string")))
        cols.append(c.alias(f.name))
    return df.select(*cols)
