"""Pairwise co-moments of many columns in one pass, as a table of pairs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = 4_096

_SUMS = ("n", "sa", "sb", "saa", "sbb", "sab")


def _products(width: int, center: list[float]):
    """Sums over the rows of a task that have both values, for each pair of columns. Values are
    taken relative to a center, so that the sums do not cancel; matrices are of ``ROWS`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.triu_indices(width, 1)
        total = np.zeros((len(_SUMS), width, width))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in part.columns])
                there = ~np.isnan(x)
                x, m = np.where(there, x - center, 0.0), there.astype(float)
                sums, squares = x.T @ m, (x * x).T @ m
                total += [m.T @ m, sums, sums.T, squares, squares.T, x.T @ x]
        if total[0].any():
            columns = [pa.array(a, pa.int32()), pa.array(b, pa.int32()), *[pa.array(t[a, b]) for t in total]]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", *_SUMS])

    return run


def correlations(wide: DataFrame, columns: Sequence[str]) -> DataFrame:
    """metric1, metric2 and Pearson's r of every pair of columns, from the rows that have both;
    null where fewer than two rows have them or one is constant. A task sends one row per pair,
    and the plan does not grow with the number of columns."""
    spark = wide.sparkSession
    columns = list(columns)
    rows = wide.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    means = rows.agg(*[F.avg(f"c{i}") for i in range(len(columns))]).first()
    center = [0.0 if m is None else m for m in means]
    schema = "a int, b int, " + ", ".join(f"{c} double" for c in _SUMS)
    sums = rows.mapInArrow(_products(len(columns), center), schema)
    pair = sums.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in _SUMS])
    n = F.col("n")
    both = F.col("sab") - F.try_divide(F.col("sa") * F.col("sb"), n)
    va = F.col("saa") - F.try_divide(F.col("sa") * F.col("sa"), n)
    vb = F.col("sbb") - F.try_divide(F.col("sb") * F.col("sb"), n)
    # What rounding leaves of a constant column is no variance.
    varies = (va > 1e-14 * F.col("saa")) & (vb > 1e-14 * F.col("sbb")) & (n > 1)
    r = F.when(varies, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), both / F.sqrt(va * vb))))
    names = spark.createDataFrame(list(enumerate(columns)), "place int, name string")
    first = names.select(F.col("place").alias("a"), F.col("name").alias("metric1"))
    second = names.select(F.col("place").alias("b"), F.col("name").alias("metric2"))
    every = first.join(second, F.col("a") < F.col("b"))
    return every.join(pair.select("a", "b", r.alias("correlation")), ["a", "b"], "left").drop("a", "b")
