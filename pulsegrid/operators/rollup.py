"""Time-bucket rollups, baselines and dimension aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.plans.joins import join_keys
from pulsegrid.plans.quantiles import group_quantiles, quantiles_of_counts
from pulsegrid.plans.staging import stage

LEVELS = ("hour", "day", "week", "month")


def _levels(ts: Column, levels: Sequence[str]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(level).alias("aggregation_level"),
                F.date_trunc(level, ts).alias("time_bucket"),
            )
            for level in levels
        ]
    )


def _hourly(metrics: DataFrame, series: Sequence[str]) -> DataFrame:
    """State of every series and hour: what coarser buckets are merged from. Rows are aggregated
    map-side and read once."""
    states = metrics.groupBy(*series, F.date_trunc("hour", "timestamp").alias("_hour")).agg(
        F.count("value").alias("_n"),
        F.avg("value").alias("_mean"),
        (F.var_pop("value") * F.count("value")).alias("_m2"),
        F.sum("value").alias("_sum"),
        F.min("value").alias("_min"),
        F.max("value").alias("_max"),
    )
    return stage(states, "hourly-states")


def _merged(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """States of larger buckets: counts, sums and bounds add up, and the squared deviations of
    a bucket are those inside its hours and those of the hours' means from its own."""
    got = F.col("_n") > 0
    part = F.when(got, F.struct("_n", "_mean", "_m2"))
    out = states.groupBy(*keys).agg(
        F.min("_min").alias("min_value"),
        F.max("_max").alias("max_value"),
        F.sum("_sum").alias("sum_value"),
        F.sum("_n").alias("count_value"),
        # Hours of a bucket: 744 of a month at most.
        F.collect_list(part).alias("_parts"),
    )
    mean = F.try_divide("sum_value", "count_value")
    out = out.withColumn("avg_value", mean)
    around = F.aggregate(
        F.col("_parts"),
        F.lit(0.0),
        lambda total, p: total + p["_m2"] + p["_n"] * (p["_mean"] - F.col("avg_value")) * (p["_mean"] - F.col("avg_value")),
    )
    std = F.when(F.col("count_value") > 1, F.sqrt(around / (F.col("count_value") - 1)))
    return out.withColumn("std_dev", std).drop("_parts")


def rollup_metrics(
    metrics: DataFrame, levels: Sequence[str] = LEVELS, approx: bool = False
) -> DataFrame:
    """Min, max, avg, sum, count, sample std, p95 and p99 per bucket and level.

    Rows are read once into hourly states, which are merged into the levels; the percentile
    histogram of the coarser levels is built from the hourly one, not from the rows again.
    """
    series = ["metric_type", "metric_name"]
    keys = ["aggregation_level", "time_bucket", *series]
    merged = _merged(_hourly(metrics, series).select("*", F.inline(_levels(F.col("_hour"), levels))), keys)
    basics = merged.select(
        *keys, "min_value", "max_value", "avg_value", "sum_value", "count_value", "std_dev"
    )
    if approx:
        spread = metrics.select(*series, "value", F.inline(_levels(F.col("timestamp"), levels)))
        q = group_quantiles(spread, keys, "value", [0.95, 0.99], approx=True)
    else:
        hourly = (
            metrics.filter(F.col("value").isNotNull())
            .groupBy(F.date_trunc("hour", "timestamp").alias("_hour"), *series, F.col("value").alias("_value"))
            .agg(F.count("*").alias("_count"))
        )
        counts = (
            hourly.select(*series, "_value", "_count", F.inline(_levels(F.col("_hour"), levels)))
            .groupBy(*keys, "_value")
            .agg(F.sum("_count").alias("_count"))
        )
        q = quantiles_of_counts(stage(counts, "rollup_counts"), keys, [0.95, 0.99])
    return join_keys(basics, q, keys).select(
        *basics.columns,
        F.col("q")[0].alias("percentile_95"),
        F.col("q")[1].alias("percentile_99"),
    )


BASELINES = ("hourly", "daily", "weekly")


def performance_baselines(
    metrics: DataFrame, approx: bool = False, kinds: Sequence[str] = BASELINES
) -> DataFrame:
    """Distribution per metric by hour of day, weekday and week of year; ``kinds`` picks some."""
    ts = F.col("timestamp")
    hour = F.hour(ts)
    periods = F.array(
        F.struct(
            F.lit("hourly").alias("baseline_type"),
            F.format_string("%02d:00-%02d:00", hour, (hour + 1) % 24).alias("time_period"),
        ),
        F.struct(
            F.lit("daily").alias("baseline_type"),
            F.lower(F.date_format(ts, "EEEE")).alias("time_period"),
        ),
        F.struct(
            F.lit("weekly").alias("baseline_type"),
            F.format_string("week_%02d", F.weekofyear(ts)).alias("time_period"),
        ),
    )
    keys = ["metric_name", "baseline_type", "time_period"]
    periods = F.filter(periods, lambda p: p["baseline_type"].isin(list(kinds)))
    spread = metrics.select("metric_name", "value", F.inline(periods))
    basics = spread.groupBy(*keys).agg(
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        F.avg("value").alias("avg_value"),
        F.stddev_samp("value").alias("std_dev"),
        F.count("value").alias("sample_count"),
    )
    q = group_quantiles(spread, keys, "value", [0.5, 0.9, 0.95, 0.99], approx)
    points = [F.col("q")[i].alias(f"percentile_{p}") for i, p in enumerate((50, 90, 95, 99))]
    return join_keys(basics, q, keys).select(*basics.columns, *points)


def baseline_join(anomalies: DataFrame, baselines: DataFrame) -> DataFrame:
    """Each anomaly with the hour-of-day baseline of its metric."""
    hour = F.hour("timestamp")
    period = F.format_string("%02d:00-%02d:00", hour, (hour + 1) % 24)
    hourly = baselines.filter(F.col("baseline_type") == "hourly").select(
        "metric_name", "time_period", F.col("avg_value").alias("expected_value"), "std_dev", "sample_count"
    )
    return anomalies.withColumn("time_period", period).join(hourly, ["metric_name", "time_period"])


def olap_cube_fetch(
    facts: DataFrame,
    dimensions: Sequence[str],
    metrics: Sequence[str],
    start: datetime | None = None,
    end: datetime | None = None,
    ts: str = "timestamp",
) -> DataFrame:
    """The chosen dimensions and metrics of a period; unknown columns are an error."""
    missing = [c for c in [*dimensions, *metrics] if c not in facts.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    if start is not None:
        facts = facts.filter(F.col(ts) >= F.lit(start))
    if end is not None:
        facts = facts.filter(F.col(ts) <= F.lit(end))
    return facts.select(*dimensions, *metrics)


def olap_aggregate(
    cube: DataFrame, by: Sequence[str], metrics: Sequence[str], mode: str = "group"
) -> DataFrame:
    """Mean, max and min of each metric by the chosen dimensions."""
    missing = [c for c in [*by, *metrics] if c not in cube.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.max(m).alias(f"{m}_max"), F.min(m).alias(f"{m}_min")]
    grouped = cube.cube(*by) if mode == "cube" else cube.groupBy(*by)
    return grouped.agg(*aggs)
