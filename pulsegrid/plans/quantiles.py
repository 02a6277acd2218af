"""Exact and approximate quantiles for groups of any size.

``percentile`` keeps every distinct value of a group in one buffer. The exact path here
first counts equal values (map-side combined), and only where that histogram is small
aggregates it per key. Otherwise it range-partitions the histogram by value, adds the
counts before each partition, and reads just the partitions that hold a wanted rank.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.plans.staging import stage

SMALL_HISTOGRAM_ROWS = 500_000


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Counts of equal values per key."""
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("_value"))
        .agg(F.count("*").alias("_count"))
    )


def quantiles_of_counts(
    counts: DataFrame,
    keys: Sequence[str],
    probs: Sequence[float],
    small_rows: int = SMALL_HISTOGRAM_ROWS,
) -> DataFrame:
    """Linear-interpolated quantiles from staged (key, _value, _count) rows.

    Result: keys and an array ``q`` in the order of ``probs``.
    """
    keys = list(keys)
    # The histogram is a written table, so its row count comes from the file footers.
    if counts.count() <= small_rows:
        wanted = ", ".join(f"{p}D" for p in probs)
        exact = F.expr(f"percentile(_value, array({wanted}), _count)")
        return counts.groupBy(*keys).agg(exact.alias("q"))
    return _ranked(counts, keys, probs)


def _ranked(counts: DataFrame, keys: list[str], probs: Sequence[float]) -> DataFrame:
    ranged = stage(
        counts.repartitionByRange(*[F.col(c) for c in keys + ["_value"]]).withColumn(
            "_chunk", F.spark_partition_id()
        ),
        "ranked",
    )
    by_key = Window.partitionBy(*keys)
    before = by_key.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(*keys, "_chunk").agg(F.sum("_count").alias("_rows"))
    offsets = sizes.withColumn(
        "_base", F.coalesce(F.sum("_rows").over(before), F.lit(0))
    ).withColumn("_n", F.sum("_rows").over(by_key))

    def ranks(p: float) -> tuple[Column, Column, Column]:
        h = (F.col("_n") - 1) * F.lit(float(p))
        return h, F.floor(h), F.ceil(h)

    holds = F.lit(False)
    for p in probs:
        for rank in ranks(p)[1:]:
            holds = holds | (
                (rank >= F.col("_base")) & (rank < F.col("_base") + F.col("_rows"))
            )
    offsets = stage(offsets.filter(holds), "rank_offsets")

    running = Window.partitionBy(*keys, "_chunk").orderBy("_value")
    cum = F.sum("_count").over(running.rowsBetween(Window.unboundedPreceding, 0))
    spans = (
        ranged.join(offsets, keys + ["_chunk"])
        .withColumn("_end", F.col("_base") + cum)
        .withColumn("_start", F.col("_end") - F.col("_count"))
    )
    picks = []
    for i, p in enumerate(probs):
        _, lo, hi = ranks(p)
        for side, rank in (("lo", lo), ("hi", hi)):
            inside = (rank >= F.col("_start")) & (rank < F.col("_end"))
            picks.append(F.max(F.when(inside, F.col("_value"))).alias(f"_{side}{i}"))
    picked = spans.groupBy(*keys).agg(F.max("_n").alias("_n"), *picks)
    parts = []
    for i, p in enumerate(probs):
        h, lo, _ = ranks(p)
        parts.append(F.col(f"_lo{i}") + (h - lo) * (F.col(f"_hi{i}") - F.col(f"_lo{i}")))
    return picked.select(*keys, F.array(*parts).alias("q"))


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    approx: bool = False,
    small_rows: int = SMALL_HISTOGRAM_ROWS,
) -> DataFrame:
    """Quantiles of ``value`` per key: exact, or one sketch pass with ``approx=True``."""
    if approx:
        points = F.percentile_approx(value, [float(p) for p in probs], 10_000)
        return df.groupBy(*keys).agg(points.alias("q"))
    return quantiles_of_counts(stage(value_counts(df, keys, value), "counts"), keys, probs, small_rows)
