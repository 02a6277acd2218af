"""Anomalies, alerts, messages and stream summaries in batch form."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from pulsegrid.catalog import sqlparts as S
from pulsegrid.catalog.registry import Registry, r6, rounded
from pulsegrid.catalog.sqlparts import r, with_
from pulsegrid.functions.timewin import latest
from pulsegrid.operators import alerts, anomaly, messages
from pulsegrid.plans.ordering import last_n
from pulsegrid.sources import adapters as A

Q = Registry()
M = ["event_id", "timestamp", "metric_type", "metric_name", "value", "source"]


def _metrics(spark, d):
    return A.metrics_long(spark, d).select(*M)


TH = """CASE metric_name WHEN 'cpu_percent' THEN CASE WHEN value >= 95 THEN 1.0 WHEN value >= 85 THEN 0.7 ELSE 0 END
  WHEN 'memory_percent' THEN CASE WHEN value >= 90 THEN 1.0 WHEN value >= 80 THEN 0.7 ELSE 0 END
  WHEN 'disk_percent' THEN CASE WHEN value >= 95 THEN 1.0 WHEN value >= 85 THEN 0.7 ELSE 0 END
  WHEN 'temperature' THEN CASE WHEN value >= 85 THEN 1.0 WHEN value >= 70 THEN 0.7 ELSE 0 END
  WHEN 'network_errors' THEN CASE WHEN value >= 100 THEN 1.0 WHEN value >= 10 THEN 0.7 ELSE 0 END ELSE 0 END::DOUBLE"""


@Q.add("threshold_lookup", with_(S.METRICS) + f"SELECT event_id, metric_name, value, {TH} AS threshold_score FROM metrics_long")
def threshold_lookup(spark, d):
    return anomaly.threshold_lookup(_metrics(spark, d)).select("event_id", "metric_name", "value", "threshold_score")


FRAME = "(PARTITION BY metric_name ORDER BY timestamp, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)"


@Q.add(
    "baseline_stats",
    with_(S.METRICS)
    + f"""SELECT event_id, metric_name, {r('m')} AS mean, {r('s', 5)} AS std, {r('q1')} AS q1, {r('md')} AS median, {r('q3')} AS q3, {r('lo')} AS min, {r('hi')} AS max, n AS samples
FROM (SELECT *, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s, quantile_cont(value, 0.25) OVER w AS q1, median(value) OVER w AS md,
  quantile_cont(value, 0.75) OVER w AS q3, min(value) OVER w AS lo, max(value) OVER w AS hi, count(*) OVER w AS n FROM metrics_long WINDOW w AS {FRAME}) WHERE n >= 3""",
)
def baseline_stats(spark, d):
    out = anomaly.baseline_stats(_metrics(spark, d)).select(
        "event_id", "metric_name", "mean", F.round("std", 5).alias("std"), "q1", "median", "q3", "min", "max", "samples"
    )
    return rounded(out)


COMPOSITE = f"""comp AS (SELECT *, greatest(least(coalesce(abs((value - m) / nullif(s, 0)) / 3.0, 0), 1.0), {TH}) AS score FROM (
  SELECT *, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s, count(*) OVER w AS n FROM metrics_long WINDOW w AS {FRAME}) WHERE n >= 50)"""
SEV = "CASE WHEN score >= 0.9 THEN 'critical' WHEN score >= 0.7 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END"


@Q.add(
    "composite_anomaly",
    with_(S.METRICS, COMPOSITE)
    + f"SELECT event_id, metric_name, value, {r('m')} AS expected_value, {r('score', 5)} AS anomaly_score, {SEV} AS severity FROM comp WHERE score > 0.5",
)
def composite_anomaly(spark, d):
    out = anomaly.composite_anomaly(_metrics(spark, d))
    return out.select(
        "event_id", "metric_name", "value", r6("expected_value"),
        F.round("anomaly_score", 5).alias("anomaly_score"), "severity",
    )


@Q.add(
    "expected_range",
    with_(S.METRICS)
    + f"""SELECT metric_name, {r('quantile_cont(value, 0.25)')} AS expected_low, {r('quantile_cont(value, 0.75)')} AS expected_high FROM (
  SELECT *, row_number() OVER (PARTITION BY metric_name ORDER BY timestamp DESC, event_id DESC) AS rn FROM metrics_long) WHERE rn <= 20 GROUP BY 1""",
)
def expected_range(spark, d):
    return rounded(anomaly.expected_range(_metrics(spark, d)))


SEV2 = SEV.replace("score", "anomaly_score")
A720 = "timestamp >= (SELECT max(timestamp) FROM anomaly_log) - INTERVAL 240 HOUR"


@Q.add(
    "anomaly_summary",
    with_(S.ANOMALIES)
    + f""", a AS (SELECT {SEV2} AS severity, metric_name FROM anomaly_log WHERE {A720})
SELECT 'total' AS kind, 'all' AS name, count(*) AS anomalies FROM a UNION ALL SELECT 'severity', severity, count(*) FROM a GROUP BY severity
UNION ALL SELECT 'metric', metric_name, count(*) FROM a GROUP BY metric_name""",
)
def anomaly_summary(spark, d):
    return anomaly.anomaly_summary(A.anomaly_log(spark, d), hours=240)


@Q.add(
    "recent_anomalies",
    with_(S.ANOMALIES) + "SELECT event_id, timestamp, metric_name, value, anomaly_score FROM anomaly_log ORDER BY timestamp DESC, event_id DESC LIMIT 10",
)
def recent_anomalies(spark, d):
    return anomaly.recent_anomalies(A.anomaly_log(spark, d), hours=240)


@Q.add(
    "metric_health_score",
    with_(S.ANOMALIES)
    + """, last10 AS (SELECT metric_name, avg(anomaly_score) AS m, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY metric_name ORDER BY timestamp DESC, event_id DESC) AS rn FROM anomaly_log) WHERE rn <= 10 GROUP BY 1)
SELECT k.metric_name, greatest(0, CAST(round_even(100 - coalesce(m, 0) * 100, 0) AS INTEGER)) AS health_score, coalesce(n, 0) AS recent_anomaly_count, samples_collected
FROM (SELECT metric_name, count(*) AS samples_collected FROM metrics_long GROUP BY 1) k LEFT JOIN last10 USING (metric_name)""",
)
def metric_health_score(spark, d):
    return anomaly.metric_health_score(_metrics(spark, d), A.anomaly_log(spark, d))


RULES = """rules(rule, metric_name, threshold, severity, cooldown) AS (VALUES ('high_cpu', 'cpu_percent', 80.0::DOUBLE, 'warning', 5), ('critical_cpu', 'cpu_percent', 95.0, 'critical', 2),
  ('high_memory', 'memory_percent', 85.0, 'warning', 5), ('critical_memory', 'memory_percent', 95.0, 'critical', 2), ('high_disk', 'disk_percent', 90.0, 'warning', 10),
  ('critical_disk', 'disk_percent', 98.0, 'critical', 5), ('high_temperature', 'temperature', 75.0, 'warning', 5), ('critical_temperature', 'temperature', 85.0, 'critical', 2)),
breaches AS (SELECT event_id, timestamp, source, m.metric_name, value, rule, r.severity, r.threshold, r.cooldown FROM metrics_long m JOIN rules r ON m.metric_name = r.metric_name WHERE value > threshold)"""


@Q.add(
    "rule_match",
    with_(S.METRICS, RULES)
    + "SELECT event_id, rule, severity, metric_name || ' is ' || CAST(value AS VARCHAR) || ' (threshold: > ' || CAST(threshold AS VARCHAR) || ')' AS message FROM breaches",
)
def rule_match(spark, d):
    out = alerts.rule_match(_metrics(spark, d), alerts.rule_table(spark))
    return out.select("event_id", "rule", "severity", "message")


@Q.add(
    "rule_predicate",
    with_(S.METRICS)
    + """SELECT event_id, condition, CASE condition WHEN '>' THEN value > 50 WHEN '<' THEN value < 50 WHEN '>=' THEN value >= 50 WHEN '<=' THEN value <= 50
  WHEN '==' THEN value = 50 WHEN '!=' THEN value <> 50 ELSE false END AND condition <> '<' AS fires
FROM (SELECT event_id, value, unnest(['>', '<', '>=', '<=', '==', '!=', '~']) AS condition FROM metrics_long)""",
)
def rule_predicate(spark, d):
    conditions = F.array(*[F.lit(c) for c in (">", "<", ">=", "<=", "==", "!=", "~")])
    rows = _metrics(spark, d).select("event_id", "value", F.explode(conditions).alias("condition"))
    rows = rows.withColumn("threshold", F.lit(50.0)).withColumn("enabled", F.col("condition") != "<")
    return alerts.rule_predicate(rows).select("event_id", "condition", "fires")


def _cooldown_sql(keys: str, minutes: str) -> str:
    on = " AND ".join(f"n.{k} = f.{k}" for k in keys.split(", "))
    return f"""num AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY timestamp, event_id) AS rn FROM breaches),
f AS (SELECT {keys}, rn, event_id, timestamp AS fired, true AS fires FROM num WHERE rn = 1
  UNION ALL SELECT {', '.join('n.' + k for k in keys.split(', '))}, n.rn, n.event_id,
    CASE WHEN n.timestamp >= f.fired + to_minutes({minutes}) THEN n.timestamp ELSE f.fired END,
    n.timestamp >= f.fired + to_minutes({minutes}) FROM f JOIN num n ON {on} AND n.rn = f.rn + 1)"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@Q.add(
    "alert_cooldown",
    _recursive(with_(S.METRICS, RULES, _cooldown_sql("rule, source", "n.cooldown * 60")))
    + "SELECT rule, source, event_id FROM f WHERE fires",
)
def alert_cooldown(spark, d):
    rules = alerts.rule_table(spark, [(*x[:5], x[5] * 60) for x in alerts.DEFAULT_RULES])
    hits = alerts.rule_match(_metrics(spark, d), rules).select("rule", "source", "timestamp", "event_id", "cooldown_minutes")
    return alerts.alert_cooldown(hits).select("rule", "source", "event_id")


@Q.add(
    "alert_cooldown_shared",
    _recursive(with_(S.METRICS, RULES, _cooldown_sql("rule", "n.cooldown * 60")))
    + "SELECT rule, event_id FROM f WHERE fires",
)
def alert_cooldown_shared(spark, d):
    rules = alerts.rule_table(spark, [(*x[:5], x[5] * 60) for x in alerts.DEFAULT_RULES])
    hits = alerts.rule_match(_metrics(spark, d), rules).select("rule", "source", "timestamp", "event_id", "cooldown_minutes")
    return alerts.alert_cooldown(hits, keys=["rule"], block_rows=50).select("rule", "event_id")


LIFE = """life AS (SELECT alert_id, any_value(metric_name) AS metric_name, any_value(value) AS value, any_value(severity) AS severity, any_value(source) AS source,
  min(timestamp) FILTER (WHERE action = 'trigger') AS timestamp, max(timestamp) FILTER (WHERE action = 'acknowledge') AS acknowledged_at,
  max(actor) FILTER (WHERE action = 'acknowledge') AS acknowledged_by, min(timestamp) FILTER (WHERE action = 'resolve') AS resolved_at FROM alert_log GROUP BY 1),
states AS (SELECT *, acknowledged_at IS NOT NULL AS acknowledged, resolved_at IS NOT NULL AS resolved FROM life)"""


@Q.add("alert_lifecycle", with_(S.ALERT_LOG, LIFE) + "SELECT * FROM states")
def alert_lifecycle(spark, d):
    return alerts.alert_lifecycle(A.alert_log(spark, d))


@Q.add(
    "alert_statistics",
    with_(S.ALERT_LOG, LIFE)
    + """SELECT 'total' AS kind, 'all' AS name, count(*) AS alerts, count(*) FILTER (WHERE NOT resolved) AS active FROM states
UNION ALL SELECT 'severity', severity, count(*), count(*) FILTER (WHERE NOT resolved) FROM states GROUP BY severity
UNION ALL SELECT 'metric', metric_name, count(*), count(*) FILTER (WHERE NOT resolved) FROM states GROUP BY metric_name""",
)
def alert_statistics(spark, d):
    return alerts.alert_statistics(alerts.alert_lifecycle(A.alert_log(spark, d)))


@Q.add("active_alerts", with_(S.ALERT_LOG, LIFE) + "SELECT alert_id, severity, timestamp FROM states WHERE NOT resolved")
def active_alerts(spark, d):
    out = alerts.active_alerts(alerts.alert_lifecycle(A.alert_log(spark, d)))
    return out.select("alert_id", "severity", "timestamp")


@Q.add(
    "alert_history",
    with_(S.ALERT_LOG, LIFE) + "SELECT alert_id, severity, timestamp FROM states WHERE timestamp >= (SELECT max(timestamp) FROM states) - INTERVAL 24 HOUR",
)
def alert_history(spark, d):
    out = alerts.alert_history(alerts.alert_lifecycle(A.alert_log(spark, d)))
    return out.select("alert_id", "severity", "timestamp")


@Q.add(
    "anomaly_to_alert",
    with_(S.STREAM_EVENTS)
    + """SELECT 'alert_' || CAST(epoch_us(timestamp) // 1000 AS VARCHAR) || '_' || metric_type AS alert_id, 'anomaly' AS type, severity,
  upper(metric_type) || ' anomaly detected: ' || CAST(value AS VARCHAR) AS message, metric_type, value, timestamp, event_id AS source_event FROM stream_events WHERE event_type = 'anomaly_detected'""",
)
def anomaly_to_alert(spark, d):
    return alerts.anomaly_to_alert(A.stream_events(spark, d))


@Q.add(
    "anomaly_escalation",
    with_(S.ANOMALIES)
    + "SELECT event_id, CASE WHEN anomaly_score > 0.9 THEN 'critical' ELSE 'warning' END AS level, printf('Anomaly detected in %s: %.2f%%', metric_name, value) AS message FROM anomaly_log",
)
def anomaly_escalation(spark, d):
    return alerts.escalated(A.anomaly_log(spark, d)).select("event_id", "level", "message")


@Q.add(
    "event_routing",
    with_(S.STREAM_EVENTS)
    + """SELECT event_id, event_type, processor FROM stream_events JOIN (VALUES ('system_metric', 'system_aggregator'), ('system_metric', 'anomaly_detector'),
  ('sensor_reading', 'performance_calculator'), ('anomaly_detected', 'alert_generator')) t(et, processor) ON et = event_type""",
)
def event_routing(spark, d):
    return messages.event_routing(A.stream_events(spark, d)).select("event_id", "event_type", "processor")


@Q.add("priority_split", with_(S.MESSAGES) + "SELECT event_id, priority, CASE WHEN priority >= 3 THEN 'immediate' ELSE 'batched' END AS lane FROM stream_messages")
def priority_split(spark, d):
    return messages.priority_split(A.stream_messages(spark, d)).select("event_id", "priority", "lane")


@Q.add("stream_filter", with_(S.MESSAGES) + "SELECT event_id, stream_name, priority FROM stream_messages WHERE message_type = 'error' AND priority >= 2")
def stream_filter(spark, d):
    """A subscriber's messages, delivered by a stream."""
    from pulsegrid.streaming import jobs

    stream = A.stream_messages_from(jobs.event_stream(spark, d))
    out = jobs.subscribe(stream, (F.col("message_type") == "error") & (F.col("priority") >= 2))
    return jobs.drain(out.select("event_id", "stream_name", "priority"), "subscribed")


@Q.add(
    "recent_messages",
    with_(S.MESSAGES)
    + """SELECT event_id, stream_name, message_type, timestamp FROM (SELECT *, row_number() OVER (PARTITION BY stream_name ORDER BY timestamp DESC, event_id DESC) AS rn
  FROM stream_messages WHERE timestamp > TIMESTAMP '2024-01-05') WHERE rn <= 10""",
)
def recent_messages(spark, d):
    out = messages.recent_messages(A.stream_messages(spark, d), 10, datetime(2024, 1, 5))
    return out.select("event_id", "stream_name", "message_type", "timestamp")


@Q.add(
    "latest_readings",
    with_(S.METRICS)
    + "SELECT event_id, timestamp, value FROM metrics_long WHERE metric_type = 'temperature' ORDER BY timestamp DESC, event_id DESC LIMIT 100",
)
def latest_readings(spark, d):
    rows = _metrics(spark, d).filter(F.col("metric_type") == "temperature")
    return last_n(rows, ["metric_type"], ["timestamp", "event_id"], 100).select("event_id", "timestamp", "value")


@Q.add(
    "last_n_per_key",
    with_(S.METRICS)
    + "SELECT event_id, metric_name, source, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY metric_name, source ORDER BY timestamp DESC, event_id DESC) AS rn FROM metrics_long) WHERE rn <= 25",
)
def last_n_per_key(spark, d):
    out = last_n(_metrics(spark, d), ["metric_name", "source"], ["timestamp", "event_id"], 25, rank="rank")
    return out.select("event_id", "metric_name", "source", "rank")


@Q.add(
    "recent_results",
    with_(S.RESULTS)
    + "SELECT result_id, processor_name FROM (SELECT *, row_number() OVER (PARTITION BY processor_name ORDER BY timestamp DESC, result_id DESC) AS rn FROM result_log) WHERE rn <= 1500",
)
def recent_results(spark, d):
    # Above the optimizer's window group limit, so this takes the positional path.
    out = last_n(A.result_log(spark, d), ["processor_name"], ["timestamp", "result_id"], 1500)
    return out.select("result_id", "processor_name")


ENC = """enc0 AS (SELECT *, lag(kind) OVER w AS pk, lag(level) OVER w AS pl, lag(zone) OVER w AS pz, row_number() OVER w AS rn FROM stream_messages WINDOW w AS (PARTITION BY stream_name ORDER BY timestamp, event_id)),
enc AS (SELECT event_id, stream_name, CASE WHEN rn = 1 THEN 'full' ELSE 'delta' END AS type, CASE WHEN rn = 1 OR kind <> pk THEN kind END AS d_kind,
  CASE WHEN rn = 1 OR level <> pl THEN level END AS d_level, CASE WHEN rn = 1 OR zone <> pz THEN zone END AS d_zone, kind, level, zone FROM enc0)"""


@Q.add("delta_encode", with_(S.MESSAGES, ENC) + "SELECT event_id, stream_name, type, d_kind, d_level, d_zone FROM enc")
def delta_encode(spark, d):
    out = messages.delta_encode(A.stream_messages(spark, d))
    return out.select("event_id", "stream_name", "type", *[F.col("delta").getItem(f).alias(f"d_{f}") for f in ("kind", "level", "zone")])


@Q.add("delta_decode", with_(S.MESSAGES) + "SELECT event_id, stream_name, kind, level, zone FROM stream_messages")
def delta_decode(spark, d):
    enc = messages.delta_encode(A.stream_messages(spark, d)).select("event_id", "stream_name", "timestamp", "type", "delta")
    out = messages.delta_decode(enc, ["kind", "level", "zone"])
    return out.select("event_id", "stream_name", "kind", "level", "zone")


def _json_len(fields: dict[str, str]) -> str:
    parts = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE {len(k) + 6} + length({c}) END" for k, c in fields.items())
    n = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 END" for c in fields.values())
    return f"(2 + {parts} + greatest(({n}) - 1, 0))"


@Q.add(
    "compression_stats",
    with_(S.MESSAGES, ENC)
    + f"""SELECT stream_name, CAST(sum(o) AS BIGINT) AS original_size, CAST(sum(c) AS BIGINT) AS compressed_size, {r('sum(c) / sum(o)::DOUBLE')} AS compression_ratio FROM (
  SELECT stream_name, {_json_len({'kind': 'kind', 'level': 'level', 'zone': 'zone'})} - 3 AS o, {_json_len({'kind': 'd_kind', 'level': 'd_level', 'zone': 'd_zone'})}
    - (CASE WHEN d_kind IS NULL THEN 0 ELSE 1 END + CASE WHEN d_level IS NULL THEN 0 ELSE 1 END + CASE WHEN d_zone IS NULL THEN 0 ELSE 1 END) AS c FROM enc WHERE type = 'delta') GROUP BY 1""",
)
def compression_stats(spark, d):
    return rounded(messages.compression_stats(messages.delta_encode(A.stream_messages(spark, d))))


@Q.add(
    "stream_aggregate",
    with_(S.STREAM_EVENTS)
    + f"""SELECT date_trunc('hour', timestamp)::TIMESTAMP AS window_start, metric_type, count(*) AS count, {r('avg(value)')} AS mean, {r('min(value)')} AS min, {r('max(value)')} AS max,
  {r('coalesce(stddev_samp(value), 0)')} AS stdev, {r('median(value)')} AS median FROM stream_events WHERE event_type = 'system_metric' GROUP BY 1, 2""",
)
def stream_aggregate(spark, d):
    return rounded(messages.stream_aggregate(A.stream_events(spark, d)))


@Q.add(
    "latency_throughput",
    with_(S.STREAM_EVENTS)
    + f"""SELECT source, {r('avg(x)')} AS average_ms, {r('min(x)')} AS min_ms, {r('max(x)')} AS max_ms, count(*) AS total_events, {r('any_value(sp)')} AS time_span_seconds,
  {r('quantile_cont(x, 0.95)')} AS percentile_95, {r('count(*) / any_value(sp)', 9)} AS events_per_second
FROM (SELECT *, CASE WHEN processing_latency_ms > 0 THEN processing_latency_ms END AS x,
  (epoch_us(max(timestamp) OVER (PARTITION BY source)) - epoch_us(min(timestamp) OVER (PARTITION BY source))) / 1e6 AS sp FROM stream_events) GROUP BY source""",
)
def latency_throughput(spark, d):
    out = messages.latency_throughput(A.stream_events(spark, d))
    return rounded(out.drop("events_per_second")).join(
        out.select("source", F.round("events_per_second", 9).alias("events_per_second")), "source"
    )


@Q.add(
    "stream_metrics",
    with_(S.RESULTS, S.STREAM_EVENTS)
    + f"""SELECT CAST(ep AS BIGINT) AS events_processed, {r('ep / up', 9)} AS events_per_second, {r('lat')} AS average_latency_ms, ec AS error_count, {r('ec / greatest(1, ep)', 9)} AS error_rate
FROM (SELECT sum(input_events) FILTER (WHERE NOT failed) AS ep, count(*) FILTER (WHERE failed) AS ec FROM result_log),
  (SELECT avg(processing_latency_ms) FILTER (WHERE processing_latency_ms > 0) AS lat FROM (SELECT * FROM stream_events ORDER BY timestamp DESC, event_id DESC LIMIT 1000)),
  (SELECT (epoch_us(max(timestamp)) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6 AS up FROM stream_events)""",
)
def stream_metrics(spark, d):
    e = A.stream_events(spark, d)
    out = messages.stream_metrics(A.result_log(spark, d), e, datetime(2024, 1, 1), latest(e))
    return rounded(out, 9).withColumn("average_latency_ms", r6("average_latency_ms"))


@Q.add(
    "event_summary",
    with_(S.STREAM_EVENTS)
    + """SELECT 'total' AS kind, 'all' AS name, count(*) AS events FROM stream_events UNION ALL SELECT 'event_type', event_type, count(*) FROM stream_events GROUP BY event_type
UNION ALL SELECT 'source', source, count(*) FROM stream_events GROUP BY source""",
)
def event_summary(spark, d):
    return messages.event_summary(A.stream_events(spark, d))


@Q.add(
    "processor_metrics",
    with_(S.RESULTS)
    + f"""SELECT processor_name, CAST(sum(input_events) FILTER (WHERE NOT failed) AS BIGINT) AS events_processed, count(*) FILTER (WHERE failed) AS errors,
  {r('sum(processing_time_ms) FILTER (WHERE NOT failed) / sum(input_events) FILTER (WHERE NOT failed)')} AS average_processing_time_ms, max(timestamp) FILTER (WHERE NOT failed) AS last_processed FROM result_log GROUP BY 1""",
)
def processor_metrics(spark, d):
    return rounded(messages.processor_metrics(A.result_log(spark, d)))


@Q.add(
    "stream_stats",
    with_(S.MESSAGES)
    + "SELECT stream_name, count(*) AS messages_processed, max(timestamp) AS last_message_time, least(count(*), 1000) AS current_buffer_size FROM stream_messages GROUP BY 1",
)
def stream_stats(spark, d):
    return messages.stream_stats(A.stream_messages(spark, d))


@Q.add(
    "series_span_stats",
    with_(S.METRICS)
    + f"""SELECT metric_name, {r('avg(value)', 1)} AS average, {r('min(value)', 1)} AS minimum, {r('max(value)', 1)} AS maximum, count(*) AS rows,
  {r('(epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 3.6e9', 1)} AS span_hours, max(timestamp) AS last_time FROM metrics_long GROUP BY 1""",
)
def series_span_stats(spark, d):
    return messages.series_span_stats(A.metrics_long(spark, d))


@Q.add(
    "latest_prediction",
    with_(S.PREDICTIONS)
    + f"SELECT metric_type, horizon_minutes, timestamp, {r('predicted_value')} AS predicted_value, {r('accuracy')} AS accuracy FROM (SELECT *, row_number() OVER (PARTITION BY metric_type, horizon_minutes ORDER BY timestamp DESC, event_id DESC) AS rn FROM prediction_log) WHERE rn = 1",
)
def latest_prediction(spark, d):
    from pulsegrid.operators.ml import latest_prediction as op

    return rounded(op(A.prediction_log(spark, d)))
