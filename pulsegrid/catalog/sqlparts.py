"""Telemetry tables as DuckDB common table expressions, same mapping as the adapters."""

from __future__ import annotations

HOST = "'host_' || CAST(user_id % 4 AS VARCHAR)"
K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"

METRICS = f"""metrics_long AS (
  SELECT event_id, ts AS timestamp,
    CASE event_type WHEN 'view' THEN 'cpu' WHEN 'click' THEN 'memory' WHEN 'purchase' THEN 'disk'
      WHEN 'signup' THEN 'network' ELSE 'temperature' END AS metric_type,
    CASE event_type WHEN 'view' THEN 'cpu_percent' WHEN 'click' THEN 'memory_percent'
      WHEN 'purchase' THEN 'disk_percent' WHEN 'signup' THEN 'network_errors'
      ELSE 'temperature' END AS metric_name,
    least(value + CASE event_type WHEN 'view' THEN 40.0 WHEN 'click' THEN 55.0 ELSE 0.0 END, 100.0)::DOUBLE AS value,
    props AS metadata, {HOST} AS source, event_type AS tag
  FROM events)"""

SYSTEM_EVENTS = f"""system_events AS (
  SELECT event_id, ts AS timestamp, event_type,
    CASE WHEN event_type = 'error' AND value > 150 THEN 'critical' WHEN event_type = 'error' THEN 'error'
      WHEN event_type = 'purchase' THEN 'warning' ELSE 'info' END AS severity,
    {HOST} AS source, 'event ' || event_type AS title, ({K} % 2) = 0 AS resolved,
    CAST(floor(least(value, 100.0)) AS INTEGER) AS impact_score
  FROM events)"""

PROCESS = """process_metrics AS (
  SELECT l_shipdate AS timestamp, l_partkey AS pid, p_brand AS name, l_discount * 1000 AS cpu_percent,
    l_tax * 1000 AS memory_percent, l_extendedprice AS memory_rss,
    'u' || CAST(l_suppkey % 5 AS VARCHAR) AS username, l_linestatus AS status,
    l_partkey // 2 AS parent_pid, l_orderkey, l_linenumber, l_suppkey
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

PROCESSES = """processes AS (
  SELECT p_partkey AS pid, p_name AS name, p_type AS status, p_partkey // 2 AS parent_pid FROM part)"""

SNAPSHOTS = f"""snap0 AS (
  SELECT event_id, ts AS timestamp, event_type, {K} AS k, CAST(value AS VARCHAR) AS v,
    CAST(least(value, 100.0)::DOUBLE AS VARCHAR) AS usage FROM events WHERE event_type <> 'error'),
snapshots AS (
  SELECT event_id, timestamp,
    CASE event_type WHEN 'view' THEN 'cpu' WHEN 'click' THEN 'memory' WHEN 'purchase' THEN 'disk' ELSE 'network' END AS metric_type,
    CASE WHEN k = 7 THEN '{{broken'
      WHEN event_type = 'view' AND k = 8 THEN '{{}}'
      WHEN event_type = 'view' THEN '{{"usage_percent": ' || usage || '}}'
      WHEN event_type = 'click' THEN '{{"usage_percent": ' || usage || ', "total": 17179869184, "swap": {{"usage_percent": ' || CAST(k AS VARCHAR) || '.0}}}}'
      WHEN event_type = 'purchase' AND k % 3 = 0 THEN '{{"usage_percent": ' || usage || '}}'
      WHEN event_type = 'purchase' THEN '{{"total_usage_percent": ' || usage || '}}'
      WHEN event_type = 'signup' AND k % 3 = 0 THEN '{{"recv_rate_kbps": ' || v || '}}'
      ELSE '{{"sent_rate_kbps": ' || v || ', "recv_rate_kbps": ' || CAST(k AS VARCHAR) || '.0}}' END AS data
  FROM snap0),
parsed AS (
  SELECT event_id, timestamp, metric_type, data,
    CASE WHEN json_valid(data) THEN CAST(json_extract_string(data, '$.usage_percent') AS DOUBLE) END AS usage_percent,
    CASE WHEN json_valid(data) THEN CAST(json_extract_string(data, '$.total_usage_percent') AS DOUBLE) END AS total_usage_percent,
    CASE WHEN json_valid(data) THEN CAST(json_extract_string(data, '$.swap.usage_percent') AS DOUBLE) END AS swap_percent,
    CASE WHEN json_valid(data) THEN CAST(json_extract_string(data, '$.total') AS DOUBLE) END AS total,
    CASE WHEN json_valid(data) THEN CAST(json_extract_string(data, '$.sent_rate_kbps') AS DOUBLE) END AS sent_rate_kbps,
    CASE WHEN json_valid(data) THEN CAST(json_extract_string(data, '$.recv_rate_kbps') AS DOUBLE) END AS recv_rate_kbps,
    json_valid(data) AS valid
  FROM snapshots)"""

COUNTERS = f"""counters AS (
  SELECT event_id, {HOST} AS source, ts AS timestamp,
    event_id * 4096 + CAST(floor(value) AS BIGINT) AS bytes_sent,
    event_id * 8192 + CAST(floor(value) AS BIGINT) AS bytes_recv,
    event_id * 3 AS packets_sent, event_id * 5 AS packets_recv FROM events)"""

CONNECTIONS = """connections AS (
  SELECT l_shipdate AS timestamp, l_returnflag || '_' || l_linestatus AS status,
    CASE l_suppkey % 3 WHEN 0 THEN 'AF_INET' WHEN 1 THEN 'AF_INET6' ELSE 'AF_UNIX' END AS family,
    CASE l_linenumber % 3 WHEN 0 THEN 'SOCK_STREAM' WHEN 1 THEN 'SOCK_DGRAM' ELSE 'SOCK_RAW' END AS type,
    CAST(l_suppkey % 50 + 8000 AS INTEGER) AS local_port, l_partkey AS pid FROM lineitem)"""

CALLS = """call_log AS (
  SELECT o_orderkey AS call_id, o_orderpriority AS function, o_totalprice / 1e5 AS execution_time,
    o_orderstatus <> 'F' AS success, o_orderdate AS timestamp FROM orders)"""

STREAM_EVENTS = f"""stream_events AS (
  SELECT event_id,
    CASE event_type WHEN 'signup' THEN 'sensor_reading' WHEN 'error' THEN 'anomaly_detected' ELSE 'system_metric' END AS event_type,
    {HOST} AS source,
    CASE event_type WHEN 'view' THEN 'cpu' WHEN 'click' THEN 'memory' WHEN 'purchase' THEN 'disk'
      WHEN 'signup' THEN 'network' ELSE 'temperature' END AS metric_type,
    least(value + CASE event_type WHEN 'view' THEN 40.0 WHEN 'click' THEN 55.0 ELSE 0.0 END, 100.0)::DOUBLE AS value,
    CASE WHEN value > 80 THEN 'critical' ELSE 'warning' END AS severity,
    ts AS timestamp, value - 1.0::DOUBLE AS processing_latency_ms FROM events)"""

MESSAGES = f"""stream_messages AS (
  SELECT event_id, {HOST} AS stream_name, event_type AS message_type, event_type AS kind,
    CAST({K} % 3 AS VARCHAR) AS level, CAST({K} % 2 AS VARCHAR) AS zone, ts AS timestamp,
    CAST({K} % 4 + 1 AS INTEGER) AS priority FROM events)"""

ALERT_LOG = f"""alert_src AS (
  SELECT 'alert-' || CAST(event_id AS VARCHAR) AS alert_id, 'temperature' AS metric_name, value,
    CASE WHEN value > 85 THEN 'critical' WHEN value > 40 THEN 'warning' ELSE 'info' END AS severity,
    {HOST} AS source, 'user_' || CAST(user_id % 3 AS VARCHAR) AS actor, ts, {K} AS k
  FROM events WHERE event_type = 'error'),
alert_log AS (
  SELECT alert_id, metric_name, value, severity, source, actor, 'trigger' AS action, ts AS timestamp FROM alert_src
  UNION ALL SELECT alert_id, metric_name, value, severity, source, actor, 'acknowledge', ts + INTERVAL 5 MINUTE FROM alert_src WHERE k % 2 = 0
  UNION ALL SELECT alert_id, metric_name, value, severity, source, actor, 'resolve', ts + INTERVAL 30 MINUTE FROM alert_src WHERE k % 3 = 0)"""

ANOMALIES = METRICS + """,
anomaly_log AS (
  SELECT event_id, timestamp, metric_name, value, value / 100 AS anomaly_score FROM metrics_long WHERE value > 50)"""

PREDICTIONS = METRICS + f""",
prediction_log AS (
  SELECT event_id, metric_type,
    CASE {K.replace('props', 'metadata')} % 4 WHEN 0 THEN 5 WHEN 1 THEN 15 WHEN 2 THEN 30 ELSE 60 END AS horizon_minutes,
    value AS predicted_value, value / 200 + 0.4 AS accuracy, timestamp FROM metrics_long)"""

RESULTS = f"""result_log AS (
  SELECT event_id AS result_id,
    CASE event_type WHEN 'signup' THEN 'performance_calculator' WHEN 'error' THEN 'alert_generator' ELSE 'system_aggregator' END AS processor_name,
    {K} % 10 + 1 AS input_events, value AS processing_time_ms, {K} = 13 AS failed, ts AS timestamp FROM events)"""

TICKS = f"""ticks AS (
  SELECT event_id AS tick_id, {HOST} AS host, ts AS timestamp, least(value + 30.0, 140.0)::DOUBLE AS cpu_percent,
    CAST({K} AS DOUBLE) AS memory_percent, 100.0::DOUBLE - CAST({K} AS DOUBLE) / 4 AS disk_percent,
    CAST({K} AS DOUBLE) * 0.7::DOUBLE AS swap_percent, value * 3 AS db_latency_ms,
    CAST(user_id % 3 AS INTEGER) AS volume FROM events)"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def r(expr: str, n: int | None = None) -> str:
    """Round and turn a negative zero into zero, as Spark's decimal rounding does.

    Without ``n``: 6 digits, moved off exact halves the way ``registry.rounded`` does.
    """
    if n is None:
        return f"(round(({expr}) + 1e-9::DOUBLE, 6) + 0.0::DOUBLE)"
    return f"(round({expr}, {n}) + 0.0::DOUBLE)"


RAW = METRICS.split("    least(value")[0] + "    value,\n    props AS metadata" + METRICS.split("props AS metadata")[1]
