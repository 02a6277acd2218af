"""Stream messages, results and events in batch form."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators.timeseries import framed
from pulsegrid.plans.joins import join_keys
from pulsegrid.plans.ordering import BLOCK_ROWS, CARRY_BLOCK_ROWS, last_n, with_position
from pulsegrid.plans.quantiles import group_quantiles
from pulsegrid.plans.staging import stage

STREAM = ("stream_name",)
ORDER = ("timestamp", "event_id")

# Event type -> processors that receive it.
ROUTES = {
    "system_metric": ["system_aggregator", "anomaly_detector"],
    "sensor_reading": ["performance_calculator"],
    "anomaly_detected": ["alert_generator"],
}


def route_column(event_type: Column, routes: dict[str, list[str]] | None = None) -> Column:
    """Processors of an event type as an array; null for an unrouted type."""
    table = ROUTES if routes is None else routes
    out = F.lit(None).cast("array<string>")
    for kind, names in table.items():
        out = F.when(event_type == kind, F.array(*[F.lit(n) for n in names])).otherwise(out)
    return out


def event_routing(events: DataFrame, routes: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per event and processor; unrouted events drop (batch or stream)."""
    return events.withColumn("processor", F.explode(route_column(F.col("event_type"), routes)))


def priority_split(messages: DataFrame) -> DataFrame:
    """Lane of each message: priority 3 and above at once, lower ones in batches."""
    return messages.withColumn("lane", F.when(F.col("priority") >= 3, "immediate").otherwise("batched"))


def recent_messages(
    messages: DataFrame, count: int = 10, since: datetime | None = None, keys: Sequence[str] = STREAM
) -> DataFrame:
    """The last messages of each stream, newer than ``since`` if given."""
    rows = messages if since is None else messages.filter(F.col("timestamp") > F.lit(since))
    return last_n(rows, keys, ORDER, count)


def delta_encode(
    messages: DataFrame,
    keys: Sequence[str] = STREAM,
    order: Sequence[str] = ORDER,
    data: str = "data",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """First message of a stream in full, later ones only with new or changed entries."""
    prev = lambda w: {"_prev": F.lag(data).over(w)}
    rows = framed(messages, prev, 1, keys=keys, order=order, block_rows=block_rows)
    old = F.col("_prev")
    changed = F.map_filter(
        F.col(data),
        lambda k, v: ~F.map_contains_key(old, k) | ~F.coalesce(old[k].eqNullSafe(v), F.lit(False)),
    )
    return (
        rows.withColumn("type", F.when(old.isNull(), "full").otherwise("delta"))
        .withColumn("delta", F.when(old.isNull(), F.col(data)).otherwise(changed))
        .drop("_prev")
    )


def delta_decode(
    encoded: DataFrame,
    fields: Sequence[str],
    keys: Sequence[str] = STREAM,
    order: Sequence[str] = ORDER,
    block_rows: int = CARRY_BLOCK_ROWS,
) -> DataFrame:
    """Payload fields at every message, rebuilt from the deltas since the last full one.

    Each block starts from the state the blocks before leave behind, which is one row per block.
    """
    keys = list(keys)
    placed = with_position(encoded, keys, order, "_pos").withColumn(
        "_block", F.expr(f"_pos div {block_rows}")
    )
    full = F.col("type") == "full"
    # A struct tells "set to null" from "not mentioned"; a full message sets every field.
    for f in fields:
        given = full | F.map_contains_key(F.col("delta"), f)
        placed = placed.withColumn(f"_set_{f}", F.when(given, F.struct(F.col("delta").getItem(f).alias("v"))))
    placed = stage(placed, "delta")
    ends = placed.groupBy(*keys, "_block").agg(
        *[
            F.max_by(F.col(f"_set_{f}"), F.when(F.col(f"_set_{f}").isNotNull(), F.col("_pos"))).alias(f"_end_{f}")
            for f in fields
        ]
    )
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    seeds = stage(
        ends.select(
            *keys, "_block", *[F.last(f"_end_{f}", ignorenulls=True).over(before).alias(f"_seed_{f}") for f in fields]
        ),
        "delta_seeds",
    )
    inside = (
        Window.partitionBy(*keys, "_block").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    )
    joined = join_keys(placed, seeds, [*keys, "_block"])
    state = {
        f: F.coalesce(F.last(f"_set_{f}", ignorenulls=True).over(inside), F.col(f"_seed_{f}")).getField("v")
        for f in fields
    }
    kept = [c for c in encoded.columns if c not in ("type", "delta")]
    return joined.select(*kept, *[c.alias(f) for f, c in state.items()])


def compression_stats(encoded: DataFrame, keys: Sequence[str] = STREAM, data: str = "data") -> DataFrame:
    """JSON sizes of the delta messages before and after encoding, and their ratio."""
    delta = encoded.filter(F.col("type") == "delta")
    sizes = delta.groupBy(*keys).agg(
        F.sum(F.length(F.to_json(data))).alias("original_size"),
        F.sum(F.length(F.to_json("delta"))).alias("compressed_size"),
    )
    return sizes.withColumn("compression_ratio", F.col("compressed_size") / F.col("original_size"))


def stream_aggregate(
    events: DataFrame, width: str = "1 hour", keys: Sequence[str] = ("metric_type",), approx: bool = False
) -> DataFrame:
    """Count, mean, extremes, sample std (0 for one row) and median per type and window."""
    start = F.window("timestamp", width).getField("start")
    rows = events.filter((F.col("event_type") == "system_metric") & F.col("value").isNotNull())
    rows = rows.withColumn("window_start", start)
    by = ["window_start", *keys]
    basics = rows.groupBy(*by).agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("stdev"),
    )
    median = group_quantiles(rows, by, "value", [0.5], approx)
    return join_keys(basics, median, by).select(*basics.columns, F.col("q")[0].alias("median"))


def latency_throughput(
    events: DataFrame, keys: Sequence[str] = ("source",), latency: str = "processing_latency_ms", approx: bool = False
) -> DataFrame:
    """Latency statistics of positive latencies, and events per second of the covered span."""
    keys = list(keys)
    x = F.when(F.col(latency) > 0, F.col(latency))
    span = (F.unix_micros(F.max("timestamp")) - F.unix_micros(F.min("timestamp"))) / 1e6
    basics = events.groupBy(*keys).agg(
        F.avg(x).alias("average_ms"),
        F.min(x).alias("min_ms"),
        F.max(x).alias("max_ms"),
        F.count("*").alias("total_events"),
        F.when(span == 0, 1.0).otherwise(span).alias("time_span_seconds"),
    )
    p95 = group_quantiles(events.filter(F.col(latency) > 0), keys, latency, [0.95], approx)
    rate = F.when(F.col("total_events") > 1, F.col("total_events") / F.col("time_span_seconds"))
    return join_keys(basics, p95, keys, "left").select(
        *basics.columns, F.col("q")[0].alias("percentile_95"), rate.alias("events_per_second")
    )


def stream_metrics(results: DataFrame, events: DataFrame, start: datetime, as_of: datetime) -> DataFrame:
    """Events per second since the start, mean latency of the last 1000 events, error rate."""
    tail = events.orderBy(F.col("timestamp").desc(), F.col("event_id").desc()).limit(1000)
    positive = F.when(F.col("processing_latency_ms") > 0, F.col("processing_latency_ms"))
    latency = tail.agg(F.coalesce(F.avg(positive), F.lit(0.0)).alias("average_latency_ms"), F.lit(1).alias("_one"))
    uptime = (as_of - start).total_seconds()
    done = F.coalesce(F.sum(F.when(~F.col("failed"), F.col("input_events"))), F.lit(0))
    agg = results.agg(
        done.alias("events_processed"), F.count_if("failed").alias("error_count"), F.lit(1).alias("_one")
    )
    # Two one-row aggregates side by side.
    return agg.join(latency, "_one").select(
        "events_processed",
        (F.col("events_processed") / uptime).alias("events_per_second"),
        "average_latency_ms",
        "error_count",
        (F.col("error_count") / F.greatest(F.lit(1), F.col("events_processed"))).alias("error_rate"),
    )


def event_summary(events: DataFrame) -> DataFrame:
    """Event counts by type, by source and in all."""
    grouped = events.groupingSets(
        [[], [F.col("event_type")], [F.col("source")]], F.col("event_type"), F.col("source")
    ).agg(F.count("*").alias("events"), F.grouping_id().alias("_gid"))
    kind = F.when(F.col("_gid") == 3, "total").when(F.col("_gid") == 1, "event_type").otherwise("source")
    label = F.coalesce("event_type", "source", F.lit("all"))
    return grouped.select(kind.alias("kind"), label.alias("name"), "events")


def processor_metrics(results: DataFrame) -> DataFrame:
    """Events processed, errors, mean time per event and last run of each processor."""
    ok = ~F.col("failed")
    processed = F.coalesce(F.sum(F.when(ok, F.col("input_events"))), F.lit(0))
    time = F.coalesce(F.sum(F.when(ok, F.col("processing_time_ms"))), F.lit(0.0))
    return results.groupBy("processor_name").agg(
        processed.alias("events_processed"),
        F.count_if("failed").alias("errors"),
        F.when(processed > 0, time / processed).otherwise(0.0).alias("average_processing_time_ms"),
        F.max(F.when(ok, F.col("timestamp"))).alias("last_processed"),
    )


def stream_stats(messages: DataFrame, buffer_size: int = 1000, keys: Sequence[str] = STREAM) -> DataFrame:
    """Messages, last message time and buffered messages (the newest ``buffer_size``) per stream."""
    agg = messages.groupBy(*keys).agg(
        F.count("*").alias("messages_processed"), F.max("timestamp").alias("last_message_time")
    )
    return agg.withColumn("current_buffer_size", F.least("messages_processed", F.lit(buffer_size)))


def series_span_stats(df: DataFrame, keys: Sequence[str] = ("metric_name",), value: str = "value") -> DataFrame:
    """Average and extremes to one decimal, rows, covered hours and last time."""
    span = (F.unix_micros(F.max("timestamp")) - F.unix_micros(F.min("timestamp"))) / 3.6e9
    return df.groupBy(*keys).agg(
        F.round(F.avg(value), 1).alias("average"),
        F.round(F.min(value), 1).alias("minimum"),
        F.round(F.max(value), 1).alias("maximum"),
        F.count("*").alias("rows"),
        F.round(span, 1).alias("span_hours"),
        F.max("timestamp").alias("last_time"),
    )
