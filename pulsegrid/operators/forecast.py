"""Forecasts and capacity planning."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.timewin import trailing
from pulsegrid.operators.timeseries import ORDER, SERIES, exponential_smoothing, ols_time, seconds
from pulsegrid.plans.joins import join_keys
from pulsegrid.plans.ordering import POS, TOTAL, last_n, numbered
from pulsegrid.plans.staging import stage

# Capacity advice by resource, shown within 30 days of exhaustion.
CAPACITY_ADVICE = {
    "cpu": [
        "Consider CPU upgrade or optimization",
        "Review and optimize CPU-intensive processes",
        "Consider load balancing across multiple cores/machines",
    ],
    "memory": [
        "Plan memory upgrade",
        "Identify and optimize memory-intensive applications",
        "Consider implementing memory caching strategies",
    ],
    "disk": [
        "Plan disk space expansion",
        "Implement data archival and cleanup policies",
        "Consider data compression techniques",
    ],
}
CAPACITY_LIMIT = 95.0


def _horizon(rows: DataFrame, periods: int) -> DataFrame:
    return rows.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(periods))))


def linear_fit(df: DataFrame, keys: Sequence[str] = SERIES, value: str = "value", min_rows: int = 10) -> DataFrame:
    """Written fit per series: slope, intercept at the first row, r2, mse, mean step, end."""
    fit = ols_time(df, keys, value).filter(F.col("n") >= min_rows)
    return stage(
        fit.withColumn("mse", F.col("sse") / F.col("n")).withColumn(
            "interval", (F.col("x_max") - F.col("x_min")) / (F.col("n") - 1)
        ),
        "linear_fit",
    )


def linear_forecast(
    df: DataFrame, periods: int = 24, keys: Sequence[str] = SERIES, value: str = "value"
) -> DataFrame:
    """Regression line continued for ``periods`` mean steps, with 1.96 rmse bounds (n >= 10)."""
    fit = linear_fit(df, keys, value)
    ahead = F.col("x_max") + F.col("step") * F.col("interval")
    point = F.col("intercept") + F.col("slope") * ahead
    margin = 1.96 * F.sqrt("mse")
    at = F.timestamp_micros((F.unix_micros("_t0") + F.round(ahead * 1e6)).cast("bigint"))
    return _horizon(fit, periods).select(
        *keys,
        "step",
        at.alias("forecast_time"),
        point.alias("forecast"),
        (point - margin).alias("lower"),
        (point + margin).alias("upper"),
    )


def linear_model_info(df: DataFrame, keys: Sequence[str] = SERIES, value: str = "value") -> DataFrame:
    """r2, mse and mae of the regression; the mean absolute error takes a second pass."""
    fit = linear_fit(df, keys, value)
    line = F.col("intercept") + F.col("slope") * (seconds("timestamp") - seconds("_t0"))
    mae = join_keys(df, fit, list(keys)).groupBy(*keys).agg(F.avg(F.abs(F.col(value) - line)).alias("mae"))
    return join_keys(fit.select(*keys, "r_squared", "mse"), mae, list(keys))


def exp_smoothing_forecast(
    df: DataFrame,
    periods: int = 24,
    alpha: float = 0.3,
    keys: Sequence[str] = SERIES,
    order: Sequence[str] = ORDER,
    value: str = "value",
) -> DataFrame:
    """Flat forecast at the last smoothed value; bounds widen with the step (n >= 10).

    The residual std is the population std of value minus smoothed value, the first row left out.
    """
    rows = exponential_smoothing(df, alpha, "_s", value, keys, order, keep_position=True)
    residual = F.when(F.col(POS) > 0, F.col(value) - F.col("_s"))
    agg = rows.groupBy(*keys).agg(
        F.count("*").alias("_rows"),
        F.max_by("_s", POS).alias("forecast"),
        F.stddev_pop(residual).alias("residual_std"),
    )
    width = 1.96 * F.col("residual_std") * F.sqrt(1 + F.col("step") * 0.1)
    return _horizon(agg.filter("_rows >= 10"), periods).select(
        *keys,
        "step",
        "forecast",
        (F.col("forecast") - width).alias("lower"),
        (F.col("forecast") + width).alias("upper"),
        "residual_std",
    )


def seasonal_naive_forecast(
    df: DataFrame,
    seasonal_period: int = 24,
    periods: int = 24,
    keys: Sequence[str] = SERIES,
    order: Sequence[str] = ORDER,
    value: str = "value",
) -> DataFrame:
    """The last season repeated, next to the mean of each season position (two seasons at least)."""
    keys = list(keys)
    placed = numbered(df, keys, order).filter(F.col(TOTAL) >= 2 * seasonal_period)
    place = F.col(POS) % seasonal_period
    last = F.col(TOTAL) - seasonal_period
    season = F.when(F.col(POS) >= last, F.col(POS) - last)
    # Position in the last season and position in the whole series number differently.
    pattern = placed.filter(season.isNotNull()).select(*keys, season.alias("place"), F.col(value).alias("forecast"))
    index = placed.groupBy(*keys, place.alias("place")).agg(F.avg(value).alias("seasonal_index"))
    steps = F.expr(f"sequence(0, {periods} - 1)")
    both = join_keys(pattern, index, [*keys, "place"])
    return (
        both.withColumn("_i", F.explode(F.filter(steps, lambda i: i % seasonal_period == F.col("place"))))
        .select(*keys, (F.col("_i") + 1).alias("step"), "forecast", "place", "seasonal_index")
    )


def hourly_means(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """One mean per series and hour."""
    return df.groupBy(*keys, F.date_trunc("hour", "timestamp").alias("timestamp")).agg(
        F.avg(value).alias("value")
    )


def _risk(peak: Column, days: Column) -> Column:
    return (
        F.when(days <= 7, "critical").when(days <= 30, "high").when(peak > 85, "medium").otherwise("low")
    )


def capacity_forecast(
    metrics: DataFrame,
    days_ahead: int = 30,
    history_days: int = 30,
    as_of: datetime | None = None,
    key: str = "metric_type",
    min_rows: int = 100,
) -> DataFrame:
    """Utilization outlook per resource from hourly means of the last ``history_days``.

    Days to exhaustion is the first forecast hour at or above 95 percent, counted from zero.
    The hourly table holds at most 24 * history_days rows per resource.
    """
    rows = trailing(metrics, history_days * 24, as_of)
    hourly = stage(hourly_means(rows, [key]), "hourly")
    fit = linear_fit(hourly, [key], min_rows=min_rows)
    newest = Window.partitionBy(key).orderBy(F.col("timestamp").desc())
    recent = hourly.withColumn("_rn", F.row_number().over(newest)).groupBy(key).agg(
        F.count("*").alias("_n"),
        F.avg(F.when(F.col("_rn") <= 24, F.col("value"))).alias("current"),
        F.avg(F.when(F.col("_rn").between(145, 168), F.col("value"))).alias("week_ago"),
    )
    steps = days_ahead * 24
    ahead = F.col("x_max") + F.col("step") * F.col("interval")
    points = _horizon(fit, steps).withColumn("_y", F.col("intercept") + F.col("slope") * ahead)
    outlook = points.groupBy(key).agg(
        F.max("_y").alias("peak"),
        F.min(F.when(F.col("_y") >= CAPACITY_LIMIT, F.col("step") - 1)).alias("_hit"),
    )
    days = F.col("_hit") / 24
    growth = F.when(
        (F.col("_n") >= 168) & (F.col("week_ago") != 0),
        (F.col("current") - F.col("week_ago")) / F.col("week_ago") * 100,
    ).otherwise(0.0)
    soon = F.coalesce(days <= 30, F.lit(False))
    advice = F.expr("array()").cast("array<string>")
    for kind, texts in CAPACITY_ADVICE.items():
        listed = F.array(*[F.lit(t) for t in texts])
        advice = F.when(soon & (F.col(key) == kind), listed).otherwise(advice)
    watch = F.when(
        F.col("peak") > 85,
        F.array(F.concat(F.lit("Monitor "), F.col(key), F.lit(" usage closely for performance degradation"))),
    ).otherwise(F.expr("array()").cast("array<string>"))
    return outlook.join(recent, key).select(
        key,
        F.round("current", 2).alias("current_utilization"),
        F.round("peak", 2).alias("max_forecast_utilization"),
        F.round(growth, 2).alias("weekly_growth_percent"),
        F.round(growth * 4.33, 2).alias("monthly_growth_percent"),
        F.round(days, 1).alias("days_to_exhaustion"),
        (F.col("peak") < CAPACITY_LIMIT).alias("capacity_sufficient"),
        _risk(F.col("peak"), days).alias("risk_level"),
        F.concat(advice, watch).alias("recommendations"),
    )


def short_horizon_predict(
    df: DataFrame,
    window: int = 100,
    min_rows: int = 20,
    minutes: int = 5,
    keys: Sequence[str] = SERIES,
    order: Sequence[str] = ORDER,
    value: str = "value",
) -> DataFrame:
    """Line through the last rows of each series, read off 1..5 minutes ahead.

    Series that are constant (within the usual closeness tolerance) give no prediction.
    """
    tail = last_n(df, keys, order, window)
    aggs = [
        F.min_by(value, F.struct(*order)).alias("_v0"),
        F.max(value).alias("_high"),
        F.min(value).alias("_low"),
    ]
    v0 = F.col("_v0")
    moved = F.greatest(F.col("_high") - v0, v0 - F.col("_low")) > 1e-8 + 1e-5 * F.abs(v0)
    fit = ols_time(tail, keys, value, aggs).filter((F.col("n") >= min_rows) & moved)
    slope = F.col("slope")
    preds = [
        (F.col("intercept") + slope * (F.col("x_max") + 60.0 * m)).alias(f"min_{m}")
        for m in range(1, minutes + 1)
    ]
    return fit.select(
        *keys,
        "slope",
        "intercept",
        "r_squared",
        *preds,
        F.when(slope > 0, "increasing").when(slope < 0, "decreasing").otherwise("flat").alias("trend"),
        F.when(F.col("r_squared") > 0.7, "high")
        .when(F.col("r_squared") > 0.4, "medium")
        .otherwise("low")
        .alias("confidence"),
    )
