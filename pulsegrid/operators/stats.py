"""Descriptive statistics and correlations per series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.comoments import correlations
from pulsegrid.plans.joins import join_keys
from pulsegrid.plans.ordering import with_position
from pulsegrid.plans.quantiles import group_quantiles, quantiles_of_counts, value_counts
from pulsegrid.plans.staging import stage

PERCENTILES = (5, 10, 25, 50, 75, 90, 95, 99)


def descriptive_stats(
    df: DataFrame, keys: Sequence[str] = ("metric_name",), value: str = "value", approx: bool = False
) -> DataFrame:
    """Count, moments (population), mode, quartiles and percentiles; groups under 2 rows drop."""
    keys = list(keys)
    v = F.col(value)
    counts = stage(value_counts(df, keys, value), "counts")
    # The lowest of the most frequent values.
    mode = counts.groupBy(*keys).agg(
        F.max(F.struct(F.col("_count"), (-F.col("_value")).alias("neg"))).alias("_m")
    ).select(*keys, (-F.col("_m.neg")).alias("mode"))
    moments = df.filter(v.isNotNull()).groupBy(*keys).agg(
        F.count(v).alias("count"),
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("std"),
        F.var_pop(v).alias("variance"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.skewness(v).alias("skewness"),
        F.kurtosis(v).alias("kurtosis"),
    )
    probs = [p / 100 for p in PERCENTILES]
    if approx:
        q = group_quantiles(df, keys, value, probs, approx=True)
    else:
        q = quantiles_of_counts(counts, keys, probs)
    points = [F.col("q")[i].alias(f"p{p}") for i, p in enumerate(PERCENTILES)]
    out = join_keys(join_keys(moments.filter("count >= 2"), q, keys), mode, keys)
    return out.select(
        *keys,
        "count",
        "mean",
        F.col("q")[3].alias("median"),
        "mode",
        "std",
        "variance",
        "min",
        "max",
        (F.col("max") - F.col("min")).alias("range"),
        F.col("q")[2].alias("q1"),
        F.col("q")[4].alias("q3"),
        (F.col("q")[4] - F.col("q")[2]).alias("iqr"),
        "skewness",
        "kurtosis",
        F.when(F.col("mean") != 0, F.col("std") / F.col("mean")).alias("cv"),
        *points,
    )


def summary_stats(
    df: DataFrame, keys: Sequence[str] = ("metric_name",), value: str = "value", approx: bool = False
) -> DataFrame:
    """Mean, sample standard deviation, extremes, p95 and p99."""
    keys = list(keys)
    moments = df.groupBy(*keys).agg(
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    q = group_quantiles(df, keys, value, [0.95, 0.99], approx)
    return join_keys(moments, q, keys).select(
        *keys,
        "mean",
        "std",
        "min",
        "max",
        F.col("q")[0].alias("percentile_95"),
        F.col("q")[1].alias("percentile_99"),
    )


def usage_stats(df: DataFrame, keys: Sequence[str] = ("metric_type",), value: str = "value") -> DataFrame:
    """Average, maximum and minimum per group."""
    return df.groupBy(*keys).agg(
        F.avg(value).alias("average"), F.max(value).alias("max"), F.min(value).alias("min")
    )


def positional_align(
    df: DataFrame,
    names: Sequence[str],
    name: str = "metric_name",
    value: str = "value",
    order: Sequence[str] = ("timestamp", "event_id"),
) -> DataFrame:
    """The i-th value of each series side by side, cut to the shortest series.

    Series with no rows are left out, as are names that never occur.
    """
    rows = df.filter(F.col(name).isin(*names)).select(name, *order, value)
    placed = with_position(rows, [name], order, "pos")
    sides = [F.max(F.when(F.col(name) == n, F.col(value))).alias(n) for n in names]
    wide = placed.groupBy("pos").agg(*sides)
    lengths = {r[0]: r[1] for r in placed.groupBy(name).agg(F.max("pos")).collect()}  # one row per name asked for
    present = [n for n in names if n in lengths]
    shortest = min((lengths[n] for n in present), default=-1)
    return wide.filter(F.col("pos") <= shortest).select("pos", *present)


def timestamp_align(
    df: DataFrame,
    names: Sequence[str],
    name: str = "metric_name",
    value: str = "value",
    ts: str = "timestamp",
    order: str = "event_id",
) -> DataFrame:
    """Outer alignment on exact timestamps: one shuffle, the first value per side wins."""
    sides = [
        F.min_by(F.when(F.col(name) == n, F.col(value)), F.when(F.col(name) == n, F.col(order))).alias(n)
        for n in names
    ]
    return df.filter(F.col(name).isin(*names)).groupBy(ts).agg(*sides)


def correlation_matrix(wide: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every column pair, from one pass over the wide rows."""
    return correlations(wide, columns)


def significant_correlations(matrix: DataFrame) -> DataFrame:
    """Pairs with |r| > 0.5, named strong above 0.7."""
    r = F.abs(F.col("correlation"))
    return matrix.filter(r > 0.5).withColumn(
        "strength", F.when(r > 0.7, "strong").otherwise("moderate")
    )


def correlation_summary(matrix: DataFrame) -> DataFrame:
    r = F.abs(F.col("correlation"))
    return matrix.agg(
        F.count_if(r > 0.5).alias("total_pairs"),
        F.count_if(r > 0.7).alias("strong_correlations"),
        F.count_if((r > 0.5) & (r <= 0.7)).alias("moderate_correlations"),
    )
