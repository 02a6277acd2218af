"""Reference time and trailing windows."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, ts: str = "timestamp") -> datetime | None:
    """Newest timestamp of a table: one aggregated value, used as a literal afterwards."""
    return df.agg(F.max(ts)).first()[0]


def trailing(
    df: DataFrame, hours: float, as_of: datetime | None = None, ts: str = "timestamp"
) -> DataFrame:
    """Rows with as_of - hours <= ts <= as_of; ``as_of`` defaults to the newest row.

    The bounds are literals on the raw column, so they reach the scan and prune files.
    """
    if as_of is None:
        as_of = latest(df, ts)
        if as_of is None:
            return df.limit(0)
    return df.filter(F.col(ts).between(F.lit(as_of - timedelta(hours=hours)), F.lit(as_of)))


def between(df: DataFrame, start: datetime, end: datetime, ts: str = "timestamp") -> DataFrame:
    """Rows with start <= ts <= end."""
    return df.filter(F.col(ts).between(F.lit(start), F.lit(end)))
