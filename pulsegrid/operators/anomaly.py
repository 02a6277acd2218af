"""Baselines, composite anomaly scores and their summaries."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.functions.columns import (
    severity_of_score,
    stream_severity,
    stream_threshold,
    threshold_score,
)
from pulsegrid.functions.timewin import trailing
from pulsegrid.operators.iforest import decide
from pulsegrid.operators.timeseries import ORDER, SERIES
from pulsegrid.plans.joins import join_keys
from pulsegrid.plans.ordering import (
    BLOCK_ROWS,
    POS,
    TOTAL,
    last_n,
    numbered,
    spread_blocks,
    with_computed,
    with_sliding_moments,
)

WINDOW = 100
MIN_SAMPLES = 50
SCORE_LIMIT = 0.5

# Rows of a block whose windows are kept sorted in one pass.
STATS_BLOCK_ROWS = 50_000

# Values of overlapping windows that are summed at once.
WINDOW_CELLS = 2_000_000

_STATS = ["mean", "std", "q1", "median", "q3", "min", "max"]


def usage_ratio(df: DataFrame) -> DataFrame:
    """Used share in percent and the total in GiB."""
    return df.withColumn("used_percent", F.col("used") / F.col("total") * 100).withColumn(
        "total_gb", F.col("total") / float(1024**3)
    )


def threshold_anomalies(events: DataFrame, thresholds=None) -> DataFrame:
    """System metrics at or above their type's warning bound (batch or stream)."""
    out = events.filter(F.col("event_type") == "system_metric").withColumn(
        "severity", stream_severity(F.col("metric_type"), F.col("value"), thresholds)
    )
    bound = stream_threshold(F.col("metric_type"), F.col("severity"), thresholds)
    return out.filter(F.col("severity").isNotNull()).withColumn("threshold", bound)


def threshold_lookup(metrics: DataFrame, thresholds=None) -> DataFrame:
    """Threshold part of the anomaly score; metrics without thresholds score 0."""
    score = threshold_score(F.col("metric_name"), F.col("value"), thresholds)
    return metrics.withColumn("threshold_score", score)


def ml_feature_project(raw: DataFrame) -> DataFrame:
    """Feature row per record: the type's primary value and its secondary measures."""
    kind = F.col("metric_type")

    def num(c: Column) -> Column:
        return F.coalesce(c, F.lit(0.0))

    disks = F.col("partitions")
    total = F.aggregate(disks, F.lit(0.0), lambda a, p: a + F.coalesce(p["usage_percent"], F.lit(0.0)))
    disk_mean = F.when(F.size(disks) > 0, total / F.size(disks)).otherwise(0.0)
    primary = (
        F.when(kind == "disk", disk_mean)
        .when(kind == "network", num(F.col("bytes_sent")) + num(F.col("bytes_recv")))
        .otherwise(num(F.col("usage_percent")))
    )
    load = num(F.try_element_at("load_average", F.lit(1)))
    return raw.select(
        "event_id",
        "metric_type",
        primary.alias("primary_value"),
        F.when(kind == "cpu", load).alias("load_avg_1m"),
        F.when(kind == "memory", num(F.col("swap.usage_percent"))).alias("swap_percent"),
        F.when(kind == "network", num(F.col("errors_in")) + num(F.col("errors_out"))).alias("network_errors"),
        F.when(kind == "network", num(F.col("drops_in")) + num(F.col("drops_out"))).alias("network_drops"),
    )


def _window_stats(values: pd.Series, window: int) -> pd.DataFrame:
    """Statistics of the last ``window`` values at every place; nulls do not count.

    Quantiles, minimum and maximum come from a sorted window that each step adds one value to and
    takes one from. Mean and deviation are taken relative to the window's largest value, so that a
    constant window has deviation 0.
    """
    rolled = values.rolling(window, min_periods=1)
    out = pd.DataFrame({n: rolled.quantile(q) for n, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))})
    out["min"], out["max"] = rolled.min(), rolled.max()
    out["samples"] = values.notna().rolling(window, min_periods=1).sum().astype("int64")
    padded = np.concatenate([np.full(window - 1, np.nan), values.to_numpy(float)])
    mean, std = np.full(len(values), np.nan), np.full(len(values), np.nan)
    step = max(1, WINDOW_CELLS // window)
    for at in range(0, len(values), step):
        part = sliding_window_view(padded[at : at + step + window - 1], window)
        n, top = out["samples"].to_numpy()[at : at + step], out["max"].to_numpy()[at : at + step]
        with np.errstate(invalid="ignore", divide="ignore"):
            off = part - top[:, None]
            shift = np.nansum(off, axis=1) / n
            mean[at : at + step] = top + shift
            std[at : at + step] = np.sqrt(np.nansum((off - shift[:, None]) ** 2, axis=1) / n)
    out["mean"], out["std"] = mean, std
    return out


def baseline_stats(
    df: DataFrame,
    window: int = WINDOW,
    keys: Sequence[str] = SERIES,
    order: Sequence[str] = ORDER,
    value: str = "value",
    block_rows: int = STATS_BLOCK_ROWS,
) -> DataFrame:
    """Statistics of the last ``window`` samples at every row, from the third row on.

    A block of a series is one task's frame, with the ``window`` - 1 rows before it.
    """
    keys = list(keys)
    rows = numbered(df, keys, order).withColumn(value, F.col(value).cast("double"))
    spread, own = spread_blocks(rows, window - 1, 0, POS, block_rows)
    added = ", ".join(f"{n} double" for n in _STATS) + ", samples bigint"
    schema = T.StructType([*spread.withColumn("_own", own).schema.fields, *T.StructType.fromDDL(added).fields])

    def measure(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(POS, ignore_index=True)
        stats = _window_stats(pdf[value], window)
        return pd.concat([pdf, stats], axis=1)[pdf["_own"] & (stats["samples"] >= 3)][schema.names]

    out = spread.withColumn("_own", own).groupBy(*keys, "_block").applyInPandas(measure, schema)
    return out.drop("_block", "_own", POS, TOTAL)


def composite_anomaly(
    df: DataFrame,
    window: int = WINDOW,
    min_samples: int = MIN_SAMPLES,
    limit: float = SCORE_LIMIT,
    ml_score: str | None = None,
    keys: Sequence[str] = SERIES,
    order: Sequence[str] = ORDER,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Rows whose score is above ``limit``: the largest of z/3, threshold and model score.

    The window of the last samples includes the row itself; scoring starts at ``min_samples``.
    """
    rows = with_sliding_moments(numbered(df, keys, order), keys, "value", window, POS, block_rows)
    std = F.sqrt(F.try_divide("_sq", "_sn"))
    z = F.abs((F.col("value") - F.col("_sm")) / F.nullif(std, F.lit(0.0)))
    parts = [
        F.coalesce(F.least(z / 3.0, F.lit(1.0)), F.lit(0.0)),
        threshold_score(F.col("metric_name"), F.col("value")),
    ]
    if ml_score:
        parts.append(F.coalesce(F.col(ml_score), F.lit(0.0)))
    out = with_computed(rows.filter(F.col("_sn") >= min_samples), {"anomaly_score": F.greatest(*parts)})
    return (
        out.filter(F.col("anomaly_score") > limit)
        .withColumn("severity", severity_of_score(F.col("anomaly_score")))
        .withColumnRenamed("_sm", "expected_value")
        .drop("_sn", "_sq", POS, TOTAL)
    )


def composite_with_forest(
    df: DataFrame,
    features_of: DataFrame,
    forest: DataFrame,
    features: Sequence[str],
    row_id: Sequence[str] = ("event_id",),
    keys: Sequence[str] = SERIES,
    contamination: float = 0.01,
    **options,
) -> DataFrame:
    """``composite_anomaly`` whose model score is that of an isolation forest.

    ``features_of`` holds feature rows by ``row_id``; rows without features have no model score
    and are judged by the other two terms. A score of 0.5 is the model's own bound.
    """
    judged = decide(features_of, forest, features, keys, row_id, contamination).select(*keys, *row_id, "ml_score")
    rows = join_keys(df, judged, [*keys, *row_id], "left")
    return composite_anomaly(rows, ml_score="ml_score", keys=keys, **options)


def expected_range(
    df: DataFrame,
    window: int = 20,
    keys: Sequence[str] = SERIES,
    order: Sequence[str] = ORDER,
    value: str = "value",
) -> DataFrame:
    """p25 and p75 of the last values of each series; 0..100 where all are null."""
    tail = last_n(df, keys, order, window)
    q = F.expr(f"percentile({value}, array(0.25D, 0.75D))")
    agg = tail.groupBy(*keys).agg(q.alias("q"))
    return agg.select(
        *keys,
        F.coalesce(F.col("q")[0], F.lit(0.0)).alias("expected_low"),
        F.coalesce(F.col("q")[1], F.lit(100.0)).alias("expected_high"),
    )


def anomaly_summary(anomalies: DataFrame, hours: float = 24, as_of: datetime | None = None) -> DataFrame:
    """Total, per severity and per metric counts of the last hours, in one shuffle."""
    rows = trailing(anomalies, hours, as_of).select(
        severity_of_score(F.col("anomaly_score")).alias("severity"), "metric_name"
    )
    grouped = rows.groupingSets(
        [[], [F.col("severity")], [F.col("metric_name")]], F.col("severity"), F.col("metric_name")
    ).agg(F.count("*").alias("anomalies"), F.grouping_id().alias("_gid"))
    kind = F.when(F.col("_gid") == 3, "total").when(F.col("_gid") == 1, "severity").otherwise("metric")
    label = F.coalesce("severity", "metric_name", F.lit("all"))
    return grouped.select(kind.alias("kind"), label.alias("name"), "anomalies")


def recent_anomalies(
    anomalies: DataFrame, hours: float = 24, count: int = 10, as_of: datetime | None = None
) -> DataFrame:
    """The newest anomalies of the period."""
    rows = trailing(anomalies, hours, as_of)
    return rows.orderBy(F.col("timestamp").desc(), F.col("event_id").desc()).limit(count)


def metric_health_score(
    metrics: DataFrame, anomalies: DataFrame, window: int = 10, order: Sequence[str] = ORDER
) -> DataFrame:
    """100 minus the mean of the last scores of each metric in percent; 100 without anomalies."""
    known = metrics.groupBy("metric_name").agg(F.count("*").alias("samples_collected"))
    recent = (
        last_n(anomalies, ["metric_name"], order, window)
        .groupBy("metric_name")
        .agg(F.avg("anomaly_score").alias("_mean"), F.count("*").alias("_n"))
    )
    score = F.greatest(F.lit(0), F.bround(100 - F.coalesce("_mean", F.lit(0.0)) * 100).cast("int"))
    return known.join(recent, "metric_name", "left").select(
        "metric_name",
        score.alias("health_score"),
        F.coalesce("_n", F.lit(0)).alias("recent_anomaly_count"),
        "samples_collected",
    )
