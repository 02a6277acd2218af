"""Streaming jobs run to the end of the available input, checked against batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.catalog import sqlparts as S
from pulsegrid.catalog.alerting import COMPOSITE, ENC, RULES, SEV, _cooldown_sql, _recursive
from pulsegrid.catalog.registry import Registry, r6, rounded
from pulsegrid.catalog.series import FIT
from pulsegrid.catalog.sqlparts import K, r, with_
from pulsegrid.operators import alerts
from pulsegrid.plans.staging import stage_path
from pulsegrid.sources import adapters as A
from pulsegrid.streaming import jobs, stateful

Q = Registry()


def _source(spark, d):
    return jobs.event_stream(spark, d)


#: Streams in event order: how late rows may be, and the slots they wait in.
LATE = {"lateness": "1 hour", "slot_seconds": 6 * 3600}


def _released(rows: str, time: str = "timestamp") -> str:
    """Rows whose slot the watermark has passed when all input is read."""
    return f"time_bucket(INTERVAL 6 HOUR, {time}) + INTERVAL 6 HOUR <= (SELECT max(timestamp) FROM {rows}) - INTERVAL 1 HOUR"


def _in_parts(spark, d, job, name):
    """Result of a stream job that gets the events in three deliveries, up to 40 minutes out
    of order, and is stopped and started again between them."""
    events = spark.read.parquet(f"{d}/events.parquet")
    at = F.unix_micros(F.col("ts").cast("timestamp")) + F.pmod("event_id", F.lit(5)) * 600_000_000
    bounds = events.select(at.cast("double").alias("at")).approxQuantile("at", [1 / 3, 2 / 3], 0.01)
    folder, path, checkpoint = (stage_path(spark, f"{name}-{x}") for x in ("in", "out", "checkpoint"))
    out = None
    for low, high in zip([None, *bounds], [*bounds, None]):
        inside = F.lit(True) if low is None else at >= low
        inside = inside if high is None else inside & (at < high)
        events.filter(inside).write.mode("append").parquet(folder)
        out = jobs.run_available(job(jobs.event_stream(spark, folder, files="*.parquet")), path, checkpoint)
    return out


def _batches(spark, path):
    return spark.read.parquet(path).drop("batch")


@Q.add(
    "route_stream",
    with_(S.STREAM_EVENTS)
    + """SELECT event_id, event_type, processor FROM stream_events JOIN (VALUES ('system_metric', 'system_aggregator'), ('system_metric', 'anomaly_detector'),
  ('sensor_reading', 'performance_calculator'), ('anomaly_detected', 'alert_generator')) t(et, processor) ON et = event_type""",
)
def route_stream(spark, d):
    out = jobs.route_stream(A.stream_events_from(_source(spark, d)))
    return jobs.drain(out.select("event_id", "event_type", "processor"), "routed")


@Q.add(
    "windowed_stream_agg",
    with_(S.STREAM_EVENTS)
    + f"""SELECT * FROM (SELECT time_bucket(INTERVAL 1 HOUR, timestamp) AS window_start, time_bucket(INTERVAL 1 HOUR, timestamp) + INTERVAL 1 HOUR AS window_end, metric_type,
  count(*) AS count, {r('avg(value)')} AS mean, {r('min(value)')} AS min, {r('max(value)')} AS max, {r('coalesce(stddev_samp(value), 0)')} AS stdev, {r('median(value)')} AS median
FROM stream_events WHERE event_type = 'system_metric' GROUP BY 1, 2, 3)
WHERE window_end <= (SELECT max(timestamp) FROM stream_events WHERE event_type = 'system_metric') - INTERVAL 5 MINUTE""",
)
def windowed_stream_agg(spark, d):
    out = jobs.windowed_stream_agg(A.stream_events_from(_source(spark, d)), "1 hour")
    return rounded(jobs.drain(out, "windows"))


@Q.add(
    "sliding_stream_agg",
    with_(S.STREAM_EVENTS)
    + f"""SELECT * FROM (SELECT ws AS window_start, ws + INTERVAL 2 HOUR AS window_end, metric_type, count(*) AS count, {r('avg(value)')} AS mean,
  {r('min(value)')} AS min, {r('max(value)')} AS max, {r('coalesce(stddev_samp(value), 0)')} AS stdev, {r('median(value)')} AS median
FROM (SELECT *, unnest([time_bucket(INTERVAL 1 HOUR, timestamp), time_bucket(INTERVAL 1 HOUR, timestamp) - INTERVAL 1 HOUR]) AS ws FROM stream_events WHERE event_type = 'system_metric') GROUP BY 1, 2, 3)
WHERE window_end <= (SELECT max(timestamp) FROM stream_events WHERE event_type = 'system_metric') - INTERVAL 5 MINUTE""",
)
def sliding_stream_agg(spark, d):
    out = jobs.windowed_stream_agg(A.stream_events_from(_source(spark, d)), "2 hours", "1 hour")
    return rounded(jobs.drain(out, "sliding"))


@Q.add(
    "stream_threshold_anomaly",
    with_(S.STREAM_EVENTS)
    + """SELECT event_id, metric_type, value, severity, CASE severity WHEN 'critical' THEN c ELSE w END AS threshold FROM (
  SELECT event_id, metric_type, value, w, c, CASE WHEN value >= c THEN 'critical' WHEN value >= w THEN 'warning' END AS severity FROM stream_events
  JOIN (VALUES ('cpu', 80.0::DOUBLE, 95.0::DOUBLE), ('memory', 85.0, 95.0), ('disk', 90.0, 98.0), ('temperature', 70.0, 85.0)) t(mt, w, c) ON mt = metric_type
  WHERE event_type = 'system_metric') WHERE severity IS NOT NULL""",
)
def stream_threshold_anomaly(spark, d):
    out = jobs.stream_threshold_anomaly(A.stream_events_from(_source(spark, d)))
    return jobs.drain(out.select("event_id", "metric_type", "value", "severity", "threshold"), "tiers")


@Q.add(
    "stream_baseline_anomaly",
    with_(S.METRICS, COMPOSITE)
    + f"SELECT event_id, metric_name, value, {r('m')} AS expected_value, {r('score', 5)} AS anomaly_score, {SEV} AS severity FROM comp WHERE score > 0.5 AND "
    + _released("metrics_long"),
)
def stream_baseline_anomaly(spark, d):
    stateful.use_rocksdb(spark)
    job = lambda src: stateful.stream_baseline_anomaly(A.metrics_from_events(src), **LATE)
    out = _in_parts(spark, d, job, "baseline")
    return out.select(
        "event_id", "metric_name", "value", r6("expected_value"),
        F.round("anomaly_score", 5).alias("anomaly_score"), "severity",
    )


@Q.add(
    "stream_alert_cooldown",
    _recursive(with_(S.METRICS, RULES, _cooldown_sql("rule, source", "n.cooldown * 60")))
    + "SELECT rule, source, event_id FROM f WHERE fires AND " + _released("breaches", "fired"),
)
def stream_alert_cooldown(spark, d):
    stateful.use_rocksdb(spark)
    rules = alerts.rule_table(spark, [(*x[:5], x[5] * 60) for x in alerts.DEFAULT_RULES])
    hits = lambda src: alerts.rule_match(A.metrics_from_events(src), rules)
    out = _in_parts(spark, d, lambda src: stateful.stream_alert_cooldown(hits(src), **LATE), "cooldown")
    return out.select("rule", "source", "event_id")


@Q.add(
    "stream_delta",
    with_(S.MESSAGES, ENC)
    + "SELECT event_id, stream_name, type, d_kind, d_level, d_zone, (d_kind IS NOT NULL)::BIGINT + (d_level IS NOT NULL)::BIGINT + (d_zone IS NOT NULL)::BIGINT AS entries,"
    + " 0::BIGINT AS removed FROM enc JOIN stream_messages USING (event_id, stream_name) WHERE " + _released("stream_messages"),
)
def stream_delta(spark, d):
    stateful.use_rocksdb(spark)
    out = _in_parts(spark, d, lambda src: stateful.stream_delta(A.stream_messages_from(src), **LATE), "delta")
    return out.select(
        "event_id", "stream_name", "type", *[F.col("delta").getItem(f).alias(f"d_{f}") for f in ("kind", "level", "zone")],
        F.size("delta").cast("long").alias("entries"), F.size("removed").cast("long").alias("removed"),
    )


@Q.add(
    "stream_short_horizon",
    with_(S.METRICS)
    + """, tail AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY metric_name ORDER BY timestamp DESC, event_id DESC) AS rn FROM metrics_long) WHERE rn <= 100),
"""
    + FIT.format(k="metric_name", t="tail")
    + f"SELECT metric_name, (SELECT max(timestamp) FROM tail t WHERE t.metric_name = fit.metric_name) AS timestamp, {r('b')} AS slope, "
    + ", ".join(f"{r(f'a + b * (xmax + {60 * i})')} AS min_{i}" for i in range(1, 6))
    + " FROM fit WHERE n >= 20",
)
def stream_short_horizon(spark, d):
    stateful.use_rocksdb(spark)
    out = stateful.stream_short_horizon(A.metrics_from_events(_source(spark, d)))
    return rounded(jobs.drain(out, "short_horizon"))


@Q.add(
    "stream_stats_live",
    with_(S.MESSAGES)
    + "SELECT stream_name, count(*) AS messages_processed, max(timestamp) AS last_message_time FROM stream_messages GROUP BY 1",
)
def stream_stats_live(spark, d):
    stats = jobs.stream_stats(A.stream_messages_from(_source(spark, d)))
    path = stage_path(spark, "stream_stats")
    query = (
        stats.writeStream.outputMode("complete")
        .foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path))
        .option("checkpointLocation", stage_path(spark, "stream_stats-checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(path)


@Q.add(
    "stream_alerts",
    with_(S.STREAM_EVENTS)
    + "SELECT event_id AS source_event, upper(metric_type) || ' anomaly detected: ' || CAST(value AS VARCHAR) AS message, severity FROM stream_events WHERE event_type = 'anomaly_detected'",
)
def stream_alerts(spark, d):
    out = alerts.anomaly_to_alert(A.stream_events_from(_source(spark, d)))
    path = stage_path(spark, "outbox")
    jobs.alert_outbox(out, path, stage_path(spark, "outbox-checkpoint"))
    return _batches(spark, path).select("source_event", "message", "severity")


@Q.add(
    "microbatch_process",
    with_(S.STREAM_EVENTS)
    + """SELECT processor AS processor_name, CAST(count(*) AS BIGINT) AS input_events, false AS failed FROM stream_events JOIN (VALUES ('system_metric', 'system_aggregator'), ('system_metric', 'anomaly_detector'),
  ('sensor_reading', 'performance_calculator'), ('anomaly_detected', 'alert_generator')) t(et, processor) ON et = event_type GROUP BY 1""",
)
def microbatch_process(spark, d):
    path = stage_path(spark, "processors")
    events = A.stream_events_from(_source(spark, d))
    jobs.microbatch_process(events, jobs.builtin_processors(), path, stage_path(spark, "processors-checkpoint"))
    return _batches(spark, f"{path}/runs").select("processor_name", "input_events", "failed")


def _results(spark, d, name):
    """What one of the built-in processors wrote; all events are one micro-batch."""
    path = stage_path(spark, name)
    one = jobs.Processors()
    one.register(name, jobs.builtin_processors().get(name))
    events = A.stream_events_from(_source(spark, d))
    jobs.microbatch_process(events, one, path, stage_path(spark, f"{name}-checkpoint"), fail_fast=True)
    return _batches(spark, f"{path}/{name}")


@Q.add(
    "processor_aggregates",
    with_(S.STREAM_EVENTS)
    + f"""SELECT metric_type, count(value) AS count, {r('avg(value)')} AS mean, {r('min(value)')} AS min, {r('max(value)')} AS max,
  {r('coalesce(stddev_samp(value), 0)')} AS stdev, {r('median(value)')} AS median FROM stream_events WHERE event_type = 'system_metric' AND value IS NOT NULL GROUP BY 1""",
)
def processor_aggregates(spark, d):
    return rounded(_results(spark, d, "system_aggregator"))


@Q.add(
    "processor_anomalies",
    with_(S.STREAM_EVENTS)
    + """, t(metric_type, warning, critical) AS (VALUES ('cpu', 80.0, 95.0), ('memory', 85.0, 95.0), ('disk', 90.0, 98.0), ('temperature', 70.0, 85.0))
SELECT event_id, metric_type, value, CASE WHEN value >= critical THEN 'critical' ELSE 'warning' END AS severity,
  CASE WHEN value >= critical THEN critical ELSE warning END::DOUBLE AS threshold FROM stream_events JOIN t USING (metric_type)
WHERE event_type = 'system_metric' AND value >= warning""",
)
def processor_anomalies(spark, d):
    return _results(spark, d, "anomaly_detector").select("event_id", "metric_type", "value", "severity", "threshold")


@Q.add(
    "processor_performance",
    with_(S.STREAM_EVENTS)
    + f""", e AS (SELECT *, CASE WHEN processing_latency_ms > 0 THEN processing_latency_ms END AS x FROM stream_events WHERE event_type = 'sensor_reading'),
p AS (SELECT avg(x) AS a, min(x) AS lo, max(x) AS hi, quantile_cont(x, 0.95) AS q, count(*) AS n, (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1e6 AS span FROM e)
SELECT {r('a')} AS average_ms, {r('lo')} AS min_ms, {r('hi')} AS max_ms, {r('q')} AS percentile_95, n AS total_events, {r('CASE WHEN span = 0 THEN 1.0 ELSE span END')} AS time_span_seconds FROM p""",
)
def processor_performance(spark, d):
    return rounded(_results(spark, d, "performance_calculator"))


@Q.add(
    "processor_alerts",
    with_(S.STREAM_EVENTS)
    + """SELECT event_id AS source_event, 'anomaly' AS type, severity, upper(metric_type) || ' anomaly detected: ' || CAST(value AS VARCHAR) AS message, metric_type, value, timestamp
FROM stream_events WHERE event_type = 'anomaly_detected'""",
)
def processor_alerts(spark, d):
    return _results(spark, d, "alert_generator").drop("alert_id")


@Q.add(
    "batch_sink",
    f"""SELECT CASE event_type WHEN 'error' THEN 'alerts' WHEN 'purchase' THEN 'processes' ELSE 'metrics' END AS sink, event_id, value FROM events""",
)
def batch_sink(spark, d):
    kind = F.col("event_type")
    tables = {
        "alerts": kind == "error",
        "processes": kind == "purchase",
        "metrics": ~kind.isin("error", "purchase"),
    }
    path = stage_path(spark, "sinks")
    jobs.batch_sink(_source(spark, d), tables, path, stage_path(spark, "sinks-checkpoint"))
    out = None
    for name in tables:
        one = _batches(spark, f"{path}/{name}").select(F.lit(name).alias("sink"), "event_id", "value")
        out = one if out is None else out.unionByName(one)
    return out


@Q.add(
    "stream_store",
    f"""SELECT 'metrics' AS sink, event_id AS tick, value FROM events UNION ALL SELECT 'processes', event_id, {K}::DOUBLE FROM events WHERE event_id % 5 = 0""",
)
def stream_store(spark, d):
    k = F.get_json_object("props", "$.k").cast("double")
    ticks = _source(spark, d).select(
        F.col("event_id").alias("tick"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        "value",
        F.struct(k.alias("cpu_percent")).alias("process"),
    )
    path = stage_path(spark, "store")
    jobs.stream_store(ticks, path, stage_path(spark, "store-checkpoint"))
    metrics = _batches(spark, f"{path}/metrics").select(F.lit("metrics").alias("sink"), "tick", "value")
    procs = _batches(spark, f"{path}/processes").select(
        F.lit("processes").alias("sink"), "tick", F.col("cpu_percent").alias("value")
    )
    return metrics.unionByName(procs)


@Q.add(
    "priority_lanes",
    with_(S.MESSAGES) + "SELECT CASE WHEN priority >= 3 THEN 'immediate' ELSE 'batched' END AS lane, event_id, priority FROM stream_messages",
)
def priority_lanes(spark, d):
    urgent, rest = jobs.priority_lanes(A.stream_messages_from(_source(spark, d)))
    columns = ["event_id", "priority"]
    now = jobs.drain(urgent.select(*columns), "urgent").withColumn("lane", F.lit("immediate"))
    later = jobs.drain(rest.select(*columns), "batched").withColumn("lane", F.lit("batched"))
    return now.unionByName(later)
