"""Reports composed of the single analyses."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.timewin import trailing
from pulsegrid.operators import forecast, outliers, stats, timeseries
from pulsegrid.operators.timeseries import ORDER, SERIES
from pulsegrid.plans.joins import join_keys
from pulsegrid.plans.ordering import numbered
from pulsegrid.plans.staging import stage


def metric_report(
    metrics: DataFrame,
    hours: float | None = 24,
    as_of: datetime | None = None,
    keys: Sequence[str] = SERIES,
    order: Sequence[str] = ORDER,
) -> DataFrame:
    """Statistics, outliers, trend and forecasts of every series with at least 10 rows.

    The window is numbered and written once, and read by each analysis. The seasonal forecast (period 24,
    12 steps) needs 48 rows and is null below.
    """
    keys = list(keys)
    rows = metrics if hours is None else trailing(metrics, hours, as_of)
    rows = stage(numbered(rows.select(*keys, *order, "value"), keys, order), "report_rows")
    described = stats.descriptive_stats(rows, keys).filter("count >= 10").withColumnRenamed("count", "sample_count")
    hits = outliers.outlier_summary(rows, outliers.outliers_iqr(rows, keys), keys)
    trend = timeseries.linear_trend(rows, keys)
    season = timeseries.seasonality_strength(rows, keys).select(
        *keys, F.col("strength").alias("seasonality"), F.col("present").alias("seasonal")
    )
    stationary = timeseries.stationarity_simple(rows, keys, order)

    def as_list(points: DataFrame, name: str) -> DataFrame:
        # One row per forecast step, so the lists have the length of the horizon.
        listed = F.sort_array(F.collect_list(F.struct("step", "forecast")))
        return points.groupBy(*keys).agg(F.transform(listed, lambda x: x["forecast"]).alias(name))

    linear = as_list(forecast.linear_forecast(rows, 24, keys), "linear_forecast")
    flat = forecast.exp_smoothing_forecast(rows, 1, keys=keys, order=order).select(
        *keys, F.col("forecast").alias("exp_forecast"), "residual_std"
    )
    seasonal = as_list(forecast.seasonal_naive_forecast(rows, 24, 12, keys, order), "seasonal_forecast")
    out = described
    for part in (hits, trend.drop("n"), season, stationary, linear, flat):
        out = join_keys(out, part, keys)
    return join_keys(out, seasonal, keys, "left")


def cross_metric_analysis(
    metrics: DataFrame, names: Sequence[str], hours: float | None = 24, as_of: datetime | None = None,
    align: str = "position",
) -> tuple[DataFrame, DataFrame]:
    """Correlations of several metrics and their clusters, after alignment.

    ``align``: 'position' pairs the i-th values, 'timestamp' only values of the same instant.
    """
    from pulsegrid.operators.ml import performance_clustering

    rows = metrics if hours is None else trailing(metrics, hours, as_of)
    if align == "position":
        wide = stats.positional_align(rows, names)
    else:
        wide = stats.timestamp_align(rows, names)
    wide = stage(wide, "aligned")
    columns = [n for n in names if n in wide.columns]
    return stats.correlation_matrix(wide, columns), performance_clustering(wide, columns)
