"""Joins on keys that may be null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys are equal, as they are in a grouping.

    The result has the columns of ``left`` and the other columns of ``right``. ``how`` is inner,
    left, left_semi or left_anti. The optimizer joins null-safe equalities by hash or sort like
    plain ones.
    """
    keys = list(keys)
    names = {k: f"_right_{i}" for i, k in enumerate(keys)}
    right = right.withColumnsRenamed(names)
    same = F.lit(True)
    for k, name in names.items():
        same &= left[k].eqNullSafe(right[name])
    joined = left.join(right, same, how) if keys else left.join(right, how=how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*names.values())
