"""Aggregates over JSON snapshots: trends, reports and summaries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.columns import json_map, map_number, with_json_map
from pulsegrid.functions.timewin import latest, trailing


def parse_snapshots(snapshots: DataFrame) -> DataFrame:
    """Add the payload as ``record``; rows with unparsable payloads are dropped."""
    return with_json_map(snapshots, "data", "record")


def swap_percent(record: Column) -> Column:
    """Nested swap usage; a missing or empty swap object counts as 0."""
    swap = F.coalesce(json_map(record.getItem("swap")), F.expr("map()").cast("map<string,string>"))
    return map_number(swap, "usage_percent", 0.0)


def primary_value(metric_type: Column, record: Column) -> Column:
    """The value under a type's key, else under its second key; null when neither holds one."""

    def first(key: str, other: str) -> Column:
        return F.when(F.map_contains_key(record, key), map_number(record, key)).otherwise(
            map_number(record, other)
        )

    return (
        F.when(metric_type == "disk", first("total_usage_percent", "usage_percent"))
        .when(metric_type == "network", first("sent_rate_kbps", "recv_rate_kbps"))
        .otherwise(map_number(record, "usage_percent", 0.0))
    )


def extract_json_metric(snapshots: DataFrame) -> DataFrame:
    """Long metric rows from snapshots; rows without a usable number are skipped."""
    return (
        parse_snapshots(snapshots)
        .withColumn("value", primary_value(F.col("metric_type"), F.col("record")))
        .filter(F.col("value").isNotNull())
        .drop("record", "data")
    )


def _trend(value: Column, prefix: str = "") -> list[Column]:
    zero = F.lit(0.0)
    return [
        F.coalesce(F.avg(value), zero).alias(f"{prefix}average"),
        F.coalesce(F.min(value), zero).alias(f"{prefix}minimum"),
        F.coalesce(F.max(value), zero).alias(f"{prefix}maximum"),
    ]


def metric_trend(snapshots: DataFrame, metric_type: str, hours: float = 24, as_of: datetime | None = None) -> DataFrame:
    """Average, minimum, maximum and sample count of one type; zeros when there are no rows."""
    rows = trailing(snapshots, hours, as_of).filter(F.col("metric_type") == metric_type)
    return extract_json_metric(rows).agg(*_trend(F.col("value")), F.count("value").alias("samples"))


def cpu_trends(snapshots: DataFrame, hours: float = 24, as_of: datetime | None = None) -> DataFrame:
    return metric_trend(snapshots, "cpu", hours, as_of)


def memory_trends(snapshots: DataFrame, hours: float = 24, as_of: datetime | None = None) -> DataFrame:
    """Memory and swap trends side by side."""
    rows = trailing(snapshots, hours, as_of).filter(F.col("metric_type") == "memory")
    parsed = parse_snapshots(rows).select(
        map_number(F.col("record"), "usage_percent", 0.0).alias("mem"),
        swap_percent(F.col("record")).alias("swap"),
    )
    kept = F.when(F.col("mem").isNotNull(), F.col("swap"))
    return parsed.agg(
        *_trend(F.col("mem"), "memory_"), *_trend(kept, "swap_"), F.count("mem").alias("samples")
    )


def basic_stats(snapshots: DataFrame, hours: float = 24, as_of: datetime | None = None) -> DataFrame:
    """Average, extremes and samples of disk and network, with the second key as fallback."""
    rows = trailing(snapshots, hours, as_of).filter(F.col("metric_type").isin("disk", "network"))
    return extract_json_metric(rows).groupBy("metric_type").agg(
        F.avg("value").alias("average"),
        F.min("value").alias("minimum"),
        F.max("value").alias("maximum"),
        F.count("value").alias("samples"),
    )


def system_report(snapshots: DataFrame, hours: float = 24, as_of: datetime | None = None) -> DataFrame:
    """All four types (and swap) from one scan, one row per section."""
    rows = parse_snapshots(trailing(snapshots, hours, as_of))
    value = primary_value(F.col("metric_type"), F.col("record"))
    section = F.struct(F.col("metric_type").alias("section"), value.alias("value"))
    swap = F.struct(
        F.lit("swap").alias("section"),
        F.when(F.col("metric_type") == "memory", swap_percent(F.col("record"))).alias("value"),
    )
    return (
        rows.select(F.inline(F.array(section, swap)))
        .filter(F.col("value").isNotNull())
        .groupBy("section")
        .agg(*_trend(F.col("value")), F.count("value").alias("samples"))
    )


def aggregated_data(snapshots: DataFrame, hours: float = 1, as_of: datetime | None = None) -> DataFrame:
    """Per type: usage aggregates to 2 decimals, samples, periods above the type's limit, rates."""
    rows = parse_snapshots(trailing(snapshots, hours, as_of))
    rec, kind = F.col("record"), F.col("metric_type")
    usage = (
        F.when(kind == "disk", map_number(rec, "total_usage_percent", 0.0))
        .when(kind != "network", map_number(rec, "usage_percent", 0.0))
    )
    limit = F.when(kind == "cpu", 80).when(kind == "memory", 85).when(kind == "disk", 90)
    net = kind == "network"
    sent = F.when(net, map_number(rec, "sent_rate_kbps", 0.0))
    recv = F.when(net, map_number(rec, "recv_rate_kbps", 0.0))
    cols = rows.select(kind, usage.alias("usage"), limit.alias("limit"), sent.alias("sent"), recv.alias("recv"))
    return cols.groupBy("metric_type").agg(
        F.round(F.avg("usage"), 2).alias("average_usage"),
        F.round(F.min("usage"), 2).alias("min_usage"),
        F.round(F.max("usage"), 2).alias("max_usage"),
        F.count("*").alias("samples_count"),
        F.count_if(F.col("usage") > F.col("limit")).alias("high_usage_periods"),
        F.round(F.avg("sent"), 2).alias("average_sent_kbps"),
        F.round(F.avg("recv"), 2).alias("average_recv_kbps"),
        F.round(F.max("sent"), 2).alias("peak_sent_kbps"),
        F.round(F.max("recv"), 2).alias("peak_recv_kbps"),
    )


def system_summary(
    snapshots: DataFrame,
    summary_hours: float = 1,
    trend_hours: float = 24,
    as_of: datetime | None = None,
    order: str = "event_id",
) -> DataFrame:
    """Latest value per type with the short aggregate and the longer trend, in one pass."""
    as_of = as_of or latest(snapshots)
    rows = extract_json_metric(trailing(snapshots, max(summary_hours, trend_hours), as_of))
    ts, v = F.col("timestamp"), F.col("value")

    def inside(hours: float) -> Column:
        return F.when(ts >= F.lit(as_of) - F.make_interval(hours=F.lit(int(hours))), v)

    short, long = inside(summary_hours), inside(trend_hours)
    return rows.groupBy("metric_type").agg(
        F.max_by(v, F.struct(ts, F.col(order))).alias("current_value"),
        F.avg(short).alias("summary_average"),
        F.max(short).alias("summary_maximum"),
        F.count(short).alias("summary_samples"),
        F.avg(long).alias("trend_average"),
        F.min(long).alias("trend_minimum"),
        F.max(long).alias("trend_maximum"),
        F.count(long).alias("trend_samples"),
    )


def historical_summary(snapshots: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Data points, average cpu without zeros, and peak memory of a period."""
    rows = parse_snapshots(snapshots.filter(F.col("timestamp").between(F.lit(start), F.lit(end))))
    rec, kind = F.col("record"), F.col("metric_type")
    usage = map_number(rec, "usage_percent", 0.0)
    cpu = F.when((kind == "cpu") & (usage != 0), usage)
    memory = F.when(kind == "memory", usage)
    return rows.agg(
        F.count("*").alias("data_points"),
        F.coalesce(F.avg(cpu), F.lit(0.0)).alias("avg_cpu"),
        F.coalesce(F.max(memory), F.lit(0.0)).alias("peak_memory"),
    )
