"""Outlier rules: group statistics written as a small table, then joined to the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.plans.joins import join_keys
from pulsegrid.plans.quantiles import group_quantiles, quantiles_of_counts, value_counts
from pulsegrid.plans.staging import stage

SERIES = ("metric_name",)


def _joined(df: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with their group's statistics.

    The statistics are written first: with their true size known the optimizer broadcasts them
    when they fit and otherwise joins by shuffle with its skew handling.
    """
    return join_keys(df, stage(stats, "group_stats"), list(keys))


def zscore_outliers(
    df: DataFrame, keys: Sequence[str] = SERIES, value: str = "value", threshold: float = 3.0
) -> DataFrame:
    """z by the sample std and a flag on every row; a constant series has z 0."""
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_std"))
    z = F.when(F.col("_std") == 0, 0.0).otherwise((F.col(value) - F.col("_mean")) / F.col("_std"))
    out = _joined(df, stats, keys).withColumn("z_score", z)
    flag = F.coalesce(F.abs("z_score") > threshold, F.lit(False))
    return out.withColumn("is_outlier", flag).drop("_mean", "_std")


def outliers_zscore(
    df: DataFrame, keys: Sequence[str] = SERIES, value: str = "value", threshold: float = 2.0
) -> DataFrame:
    """Rows with |z| above the threshold by the population std, in groups of at least 4."""
    stats = df.groupBy(*keys).agg(
        F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_std"), F.count(value).alias("_n")
    )
    z = F.abs((F.col(value) - F.col("_mean")) / F.nullif(F.col("_std"), F.lit(0.0)))
    rows = _joined(df, stats.filter("_n >= 4"), keys)
    return rows.filter(z > threshold).drop("_mean", "_std", "_n")


def outliers_iqr(
    df: DataFrame, keys: Sequence[str] = SERIES, value: str = "value", approx: bool = False
) -> DataFrame:
    """Rows outside q1 - 1.5 iqr .. q3 + 1.5 iqr, in groups of at least 4."""
    keys = list(keys)
    if approx:
        q = group_quantiles(df, keys, value, [0.25, 0.75], approx=True)
        n = df.groupBy(*keys).agg(F.count(value).alias("_n")).filter("_n >= 4")
    else:
        counts = stage(value_counts(df, keys, value), "counts")
        q = quantiles_of_counts(counts, keys, [0.25, 0.75])
        n = counts.groupBy(*keys).agg(F.sum("_count").alias("_n")).filter("_n >= 4")
    spread = 1.5 * (F.col("q")[1] - F.col("q")[0])
    bounds = join_keys(q, n, keys).select(
        *keys, (F.col("q")[0] - spread).alias("_low"), (F.col("q")[1] + spread).alias("_high")
    )
    rows = _joined(df, bounds, keys)
    outside = (F.col(value) < F.col("_low")) | (F.col(value) > F.col("_high"))
    return rows.filter(outside).drop("_low", "_high")


def outliers_modified_zscore(
    df: DataFrame, keys: Sequence[str] = SERIES, value: str = "value", threshold: float = 2.0
) -> DataFrame:
    """Rows with |0.6745 (v - median) / MAD| above the threshold; none where the MAD is 0.

    Both medians come from one histogram of the values.
    """
    keys = list(keys)
    counts = stage(value_counts(df, keys, value), "counts")
    median = stage(
        quantiles_of_counts(counts, keys, [0.5]).select(*keys, F.col("q")[0].alias("_median")), "medians"
    )
    deviations = (
        join_keys(counts, median, keys)
        .withColumn("_value", F.abs(F.col("_value") - F.col("_median")))
        .groupBy(*keys, "_value")
        .agg(F.sum("_count").alias("_count"))
    )
    mad = quantiles_of_counts(stage(deviations, "deviations"), keys, [0.5]).select(
        *keys, F.col("q")[0].alias("_mad")
    )
    n = counts.groupBy(*keys).agg(F.sum("_count").alias("_n")).filter("_n >= 4").drop("_n")
    stats = join_keys(join_keys(median, mad, keys), n, keys).filter("_mad > 0")
    rows = _joined(df, stats, keys)
    z = F.abs(0.6745 * (F.col(value) - F.col("_median")) / F.col("_mad"))
    return rows.filter(z > threshold).drop("_median", "_mad")


def outlier_summary(df: DataFrame, outliers: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Number and share of outliers per series."""
    keys = list(keys)
    n = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    hits = outliers.groupBy(*keys).agg(F.count("*").alias("outlier_count"))
    count = F.coalesce("outlier_count", F.lit(0))
    return join_keys(n, hits, keys, "left").select(
        *keys, count.alias("outlier_count"), (count / F.col("_n") * 100).alias("outlier_percentage")
    )
