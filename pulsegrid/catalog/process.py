"""Predicates, processes, connections, logs and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.catalog import sqlparts as S
from pulsegrid.catalog.registry import Registry, joined_lists, r6, rounded
from pulsegrid.catalog.sqlparts import K, r, with_
from pulsegrid.functions import columns as C
from pulsegrid.functions.timewin import between
from pulsegrid.operators import logs, process
from pulsegrid.sources import adapters as A

Q = Registry()


@Q.add(
    "validate_range",
    "SELECT event_id, CASE WHEN value BETWEEN 0 AND 100 THEN value ELSE 0 END AS value, value BETWEEN 0 AND 100 AS is_valid FROM events",
)
def validate_range(spark, d):
    v = F.col("value")
    return A.table(spark, d, "events").select(
        "event_id", C.validated_percent(v).alias("value"), C.valid_percent(v).alias("is_valid")
    )


@Q.add(
    "sanitize_numeric",
    f"""SELECT o_orderkey, {r('o_totalprice / 7', 2)} AS price, {r('o_totalprice / 3', 2)} AS nested_a, o_orderpriority AS nested_b,
  CAST({r('o_custkey / 7.0', 2)} AS VARCHAR) || '|' || CAST({r('o_custkey / 9.0', 2)} AS VARCHAR) AS series FROM orders""",
)
def sanitize_numeric(spark, d):
    o = A.table(spark, d, "orders").select(
        "o_orderkey",
        (F.col("o_totalprice") / 7).alias("price"),
        F.struct((F.col("o_totalprice") / 3).alias("a"), F.col("o_orderpriority").alias("b")).alias("nested"),
        F.array(F.col("o_custkey") / 7, F.col("o_custkey") / 9).alias("series"),
    )
    out = C.sanitize_numeric(o, ["price", "nested", "series"])
    return joined_lists(
        out.select("o_orderkey", "price", F.col("nested.a").alias("nested_a"), F.col("nested.b").alias("nested_b"), "series")
    )


@Q.add(
    "clamp_percent",
    f"SELECT l_orderkey, l_linenumber, l_partkey, {r('greatest(0.0, least(100.0, l_extendedprice / 500 - 20))')} AS cpu_percent FROM lineitem",
)
def clamp_percent(spark, d):
    li = A.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_extendedprice") / 500 - 20).alias("cpu_percent")
    )
    return rounded(process.clamp_percent(li))


@Q.add(
    "time_range_filter",
    with_(S.METRICS) + "SELECT event_id, timestamp, value FROM metrics_long WHERE timestamp BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12 12:00:00'",
)
def time_range_filter(spark, d):
    from datetime import datetime

    out = between(A.metrics_long(spark, d), datetime(2024, 1, 10), datetime(2024, 1, 12, 12))
    return out.select("event_id", "timestamp", "value")


@Q.add(
    "downsample_every_n",
    with_(S.METRICS)
    + """SELECT event_id, timestamp, metric_name, value FROM (SELECT *, row_number() OVER (PARTITION BY metric_name ORDER BY timestamp, event_id) - 1 AS pos,
  count(*) OVER (PARTITION BY metric_name) AS n FROM metrics_long) WHERE n <= 100 OR pos % 15 = 0""",
)
def downsample_every_n(spark, d):
    from pulsegrid.operators.timeseries import downsample_every_n as op

    return op(A.metrics_long(spark, d).select("event_id", "timestamp", "metric_name", "value"), "15min")


@Q.add(
    "filter_processes",
    with_(S.PROCESS)
    + f"""SELECT pid, name, {r('cpu_percent')} AS cpu_percent, {r('memory_percent')} AS memory_percent, username, status, l_orderkey, l_linenumber FROM process_metrics
WHERE lower(name) LIKE '%brand#1%' AND lower(username) = 'u2' AND cpu_percent >= 40 AND memory_percent >= 20 AND lower(status) = 'o'""",
)
def filter_processes(spark, d):
    out = process.filter_processes(
        A.process_metrics(spark, d), name="BRAND#1", user="U2", min_cpu=40, min_memory=20, status="O"
    )
    return rounded(out.select("pid", "name", "cpu_percent", "memory_percent", "username", "status", "l_orderkey", "l_linenumber"))


@Q.add(
    "severity_of_score",
    with_(S.ANOMALIES)
    + "SELECT event_id, CASE WHEN anomaly_score >= 0.9 THEN 'critical' WHEN anomaly_score >= 0.7 THEN 'high' WHEN anomaly_score >= 0.5 THEN 'medium' ELSE 'low' END AS severity FROM anomaly_log",
)
def severity_of_score(spark, d):
    return A.anomaly_log(spark, d).select("event_id", C.severity_of_score(F.col("anomaly_score")).alias("severity"))


@Q.add(
    "iforest_severity",
    """SELECT event_id, CASE WHEN abs(value / 100 - 0.5) > 0.8 THEN 'critical' WHEN abs(value / 100 - 0.5) > 0.5 THEN 'high'
  WHEN abs(value / 100 - 0.5) > 0.2 THEN 'medium' ELSE 'low' END AS severity FROM events""",
)
def iforest_severity(spark, d):
    score = F.col("value") / 100 - 0.5
    return A.table(spark, d, "events").select("event_id", C.isolation_severity(score).alias("severity"))


@Q.add(
    "threshold_tier_filter",
    with_(S.STREAM_EVENTS)
    + """SELECT event_id, metric_type, value, severity, CASE severity WHEN 'critical' THEN c ELSE w END AS threshold FROM (
  SELECT event_id, metric_type, value, w, c, CASE WHEN value >= c THEN 'critical' WHEN value >= w THEN 'warning' END AS severity FROM stream_events
  JOIN (VALUES ('cpu', 80.0::DOUBLE, 95.0::DOUBLE), ('memory', 85.0, 95.0), ('disk', 90.0, 98.0), ('temperature', 70.0, 85.0)) t(mt, w, c) ON mt = metric_type
  WHERE event_type = 'system_metric') WHERE severity IS NOT NULL""",
)
def threshold_tier_filter(spark, d):
    from pulsegrid.operators.anomaly import threshold_anomalies

    out = threshold_anomalies(A.stream_events(spark, d))
    return out.select("event_id", "metric_type", "value", "severity", "threshold")


FEATURES = f"""feat AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'cpu' WHEN 'click' THEN 'memory' WHEN 'purchase' THEN 'disk' ELSE 'network' END AS metric_type,
  value, {K}::DOUBLE AS k FROM events)"""


def _features(spark, d):
    e = A.table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int").cast("double")
    kind = F.col("event_type")
    metric_type = F.when(kind == "view", "cpu").when(kind == "click", "memory").when(kind == "purchase", "disk").otherwise("network")
    v = F.col("value")
    return e.select(
        "event_id",
        metric_type.alias("metric_type"),
        v.alias("usage_percent"),
        F.struct(v.alias("user"), k.alias("system")).alias("cpu_times"),
        F.array(k / 10, k / 20).alias("load_average"),
        F.struct(k.alias("usage_percent")).alias("swap"),
        F.array(F.struct(v.alias("usage_percent")), F.struct(k.alias("usage_percent"))).alias("partitions"),
        (v * 1000).alias("bytes_sent"),
        (k * 1000).alias("bytes_recv"),
        v.alias("errors_in"),
        k.alias("errors_out"),
        (k * 2).alias("drops_in"),
        F.when(k > 50, k).alias("drops_out"),
    )


@Q.add(
    "ml_feature_project",
    with_(FEATURES)
    + f"""SELECT event_id, metric_type, {r("CASE metric_type WHEN 'disk' THEN (value + k) / 2 WHEN 'network' THEN value * 1000 + k * 1000 ELSE value END")} AS primary_value,
  {r("CASE WHEN metric_type = 'cpu' THEN k / 10 END")} AS load_avg_1m, {r("CASE WHEN metric_type = 'memory' THEN k END")} AS swap_percent,
  {r("CASE WHEN metric_type = 'network' THEN value + k END")} AS network_errors,
  {r("CASE WHEN metric_type = 'network' THEN k * 2 + CASE WHEN k > 50 THEN k ELSE 0 END END")} AS network_drops FROM feat""",
)
def ml_feature_project(spark, d):
    from pulsegrid.operators.anomaly import ml_feature_project as op

    return rounded(op(_features(spark, d)))


def _fac(cond: str, name: str) -> str:
    return f"CASE WHEN {cond} THEN '{name}' END"


@Q.add(
    "contributing_factors",
    with_(FEATURES)
    + f"""SELECT event_id, metric_type, coalesce(concat_ws('|', {_fac("metric_type = 'cpu' AND value > 90", 'high_cpu_usage')}, {_fac("metric_type = 'cpu' AND k / 10 > 5", 'high_system_load')},
  {_fac("metric_type = 'memory' AND value > 90", 'high_memory_usage')}, {_fac("metric_type = 'memory' AND k > 50", 'high_swap_usage')},
  {_fac("metric_type = 'disk' AND (value + k) / 2 > 90", 'high_disk_usage')}, {_fac("metric_type = 'network' AND value + k > 100", 'network_errors')},
  {_fac("metric_type = 'network' AND k * 2 + CASE WHEN k > 50 THEN k ELSE 0 END > 100", 'network_packet_drops')}), '') AS factors FROM feat""",
)
def contributing_factors(spark, d):
    from pulsegrid.operators.anomaly import ml_feature_project as op

    f = op(_features(spark, d))
    factors = C.contributing_factors(
        F.col("metric_type"), F.col("primary_value"), F.col("load_avg_1m"),
        F.col("swap_percent"), F.col("network_errors"), F.col("network_drops"),
    )
    return joined_lists(f.select("event_id", "metric_type", factors.alias("factors")))


@Q.add(
    "calendar_features",
    """SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week, CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend FROM events""",
)
def calendar_features(spark, d):
    e = A.metrics_long(spark, d)
    return e.select("event_id", *[c.alias(n) for n, c in C.calendar(F.col("timestamp")).items()])


@Q.add(
    "memory_ratio",
    f"SELECT o_orderkey, {r('o_totalprice / (o_totalprice + o_custkey + 1) * 100')} AS used_percent, {r('(o_totalprice + o_custkey + 1) * 1e6 / 1073741824.0', 4)} AS total_gb FROM orders",
)
def memory_ratio(spark, d):
    from pulsegrid.operators.anomaly import usage_ratio

    total = F.col("o_totalprice") + F.col("o_custkey") + 1
    o = A.table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") * 1e6).alias("used"), (total * 1e6).alias("total"))
    out = usage_ratio(o)
    return out.select("o_orderkey", r6("used_percent"), F.round("total_gb", 4).alias("total_gb"))


def _fmt(i: int, unit: str) -> str:
    return f"printf('%.1f {unit}', b / {1024 ** i}::DOUBLE)"


@Q.add(
    "format_bytes",
    "SELECT o_orderkey, CASE "
    + " ".join(f"WHEN b < {1024 ** (i + 1)} THEN {_fmt(i, u)}" for i, u in enumerate(["B", "KB", "MB", "GB", "TB"]))
    + f" ELSE {_fmt(5, 'PB')} END AS size FROM (SELECT o_orderkey, CAST(o_custkey * o_custkey AS BIGINT) * (o_orderkey + 1) AS b FROM orders)",
)
def format_bytes(spark, d):
    b = F.col("o_custkey") * F.col("o_custkey") * (F.col("o_orderkey") + 1)
    return A.table(spark, d, "orders").select("o_orderkey", C.format_bytes(b).alias("size"))


@Q.add(
    "connection_process_join",
    with_(S.CONNECTIONS, S.PROCESSES)
    + "SELECT name, count(*) AS connections FROM connections JOIN processes USING (pid) WHERE processes.status <> 'SMALL' GROUP BY name",
)
def connection_process_join(spark, d):
    return process.connection_process_join(A.connections(spark, d), A.running_processes(spark, d))


@Q.add(
    "connection_breakdown",
    with_(S.CONNECTIONS)
    + """SELECT 'status' AS dimension, status AS value, count(*) AS connections FROM connections GROUP BY status
UNION ALL SELECT 'family', CASE family WHEN 'AF_INET' THEN 'IPv4' WHEN 'AF_INET6' THEN 'IPv6' ELSE 'Other' END AS f, count(*) FROM connections GROUP BY f
UNION ALL SELECT 'type', CASE type WHEN 'SOCK_STREAM' THEN 'TCP' WHEN 'SOCK_DGRAM' THEN 'UDP' ELSE 'Other' END AS t, count(*) FROM connections GROUP BY t
UNION ALL SELECT 'port', CAST(local_port AS VARCHAR) AS p, count(*) FROM connections GROUP BY p""",
)
def connection_breakdown(spark, d):
    return process.connection_breakdown(A.connections(spark, d))


@Q.add(
    "connection_change",
    with_(S.CONNECTIONS)
    + """, totals AS (SELECT family, timestamp, count(*) AS total FROM connections GROUP BY 1, 2)
SELECT family, timestamp, total AS current_connections, coalesce(total - prev, 0) AS connection_change FROM (
  SELECT *, lag(total) OVER (PARTITION BY family ORDER BY timestamp) AS prev, row_number() OVER (PARTITION BY family ORDER BY timestamp DESC) AS rn FROM totals) WHERE rn = 1""",
)
def connection_change(spark, d):
    return process.connection_change(A.connections(spark, d), ["family"])


TREE = with_(S.PROCESSES).replace("WITH ", "WITH RECURSIVE ", 1)


@Q.add(
    "process_tree",
    TREE.rstrip()
    + """, tree AS (SELECT pid, name, status, 0 AS depth, CAST(pid AS VARCHAR) AS path FROM processes WHERE pid = 0
  UNION ALL SELECT p.pid, p.name, p.status, depth + 1, path || '|' || CAST(p.pid AS VARCHAR) FROM processes p JOIN tree t ON p.parent_pid = t.pid AND p.pid <> t.pid)
SELECT pid, name, status, depth, path, 0 AS root FROM tree""",
)
def process_tree(spark, d):
    return joined_lists(process.process_tree(A.processes(spark, d), 0))


@Q.add(
    "process_history",
    with_(S.PROCESS)
    + f"SELECT timestamp, pid, {r('cpu_percent')} AS cpu_percent, {r('memory_percent')} AS memory_percent, l_orderkey FROM process_metrics WHERE pid = 42",
)
def process_history(spark, d):
    out = process.process_history(A.process_metrics(spark, d), 42)
    return rounded(out.select("timestamp", "pid", "cpu_percent", "memory_percent", "l_orderkey"))


@Q.add(
    "top_processes",
    with_(S.PROCESS)
    + f"SELECT pid, {r('max(memory_rss)')} AS memory_rss, any_value(name) AS name FROM process_metrics GROUP BY pid ORDER BY max(memory_rss) DESC, pid LIMIT 10",
)
def top_processes(spark, d):
    return rounded(process.top_processes(A.process_metrics(spark, d), "memory_rss", 10))


@Q.add("sort_processes", with_(S.PROCESSES) + "SELECT pid, name, status FROM processes ORDER BY name, pid LIMIT 50")
def sort_processes(spark, d):
    return process.sort_processes(A.processes(spark, d), "name", 50).select("pid", "name", "status")


@Q.add(
    "dedupe_pids",
    with_(S.PROCESS)
    + f"""SELECT pid, name, {r('cpu_percent')} AS cpu_percent, memory_rss FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY timestamp, l_orderkey, l_linenumber, l_suppkey, memory_rss) AS rn FROM process_metrics) WHERE rn = 1""",
)
def dedupe_pids(spark, d):
    p = A.process_metrics(spark, d)
    out = process.dedupe_pids(p, ["timestamp", "l_orderkey", "l_linenumber", "l_suppkey", "memory_rss"])
    return rounded(out.select("pid", "name", "cpu_percent", "memory_rss"))


@Q.add(
    "ping_latency_stats",
    f"""SELECT event_id AS run_id, 'host_' || CAST(user_id % 4 AS VARCHAR) AS host, CASE WHEN up THEN least(value, k + 0.5) END AS min_ms,
  CASE WHEN up THEN greatest(value, k + 0.5) END AS max_ms, {r('CASE WHEN up THEN (value + k + 0.5) / 2 END')} AS avg_ms,
  CASE WHEN up THEN 2 ELSE 0 END AS count, CASE WHEN up THEN 0 ELSE 100 END AS packet_loss_percent
FROM (SELECT *, event_type <> 'error' AS up, {K}::DOUBLE AS k FROM events)""",
)
def ping_latency_stats(spark, d):
    return rounded(logs.ping_latency_stats(A.ping_logs(spark, d)))


TIMING = f"""count(*) AS call_count, {r('avg(execution_time)', 4)} AS average_time, {r('min(execution_time)', 4)} AS min_time, {r('max(execution_time)', 4)} AS max_time,
  {r('sum(execution_time)', 4)} AS total_time, {r('count(*) FILTER (WHERE success) / count(*)::DOUBLE * 100', 2)} AS success_rate, count(*) FILTER (WHERE NOT success) AS error_count"""


@Q.add(
    "function_timing_summary",
    with_(S.CALLS)
    + f"SELECT function, {TIMING} FROM call_log GROUP BY function UNION ALL SELECT '(all)', {TIMING} FROM call_log",
)
def function_timing_summary(spark, d):
    return logs.function_timing_summary(A.call_log(spark, d))


@Q.add(
    "slow_functions",
    with_(S.CALLS)
    + f"""SELECT function, {r('max(execution_time)', 4)} AS max_time, count(*) AS call_count, {r('avg(execution_time)', 4)} AS average_time
FROM call_log GROUP BY function HAVING avg(execution_time) > 2.5""",
)
def slow_functions(spark, d):
    return logs.slow_functions(A.call_log(spark, d), 2.5)


LOGS = r"""ci AS (SELECT doc_id % 40 AS run_id, doc_id AS step_id, doc_id % 6 AS kind, doc_id AS n, text,
  CASE doc_id % 6 WHEN 0 THEN text || chr(10) || 'TOTAL 100 25 ' || CAST(doc_id % 101 AS VARCHAR) || '%' || chr(10)
    WHEN 2 THEN 'a.py:1:1: E501 long' || chr(10) || chr(10) || text
    WHEN 5 THEN '{not json' || chr(10) || text || chr(10) || '>> Issue: weak hash' || chr(10) || 'HIGH: fix it' || chr(10) END AS stdout FROM documents),
step_metrics AS (
  SELECT run_id, step_id, 'coverage_percentage' AS metric, (n % 101)::DOUBLE AS value FROM ci WHERE kind = 0
  UNION ALL SELECT run_id, step_id, 'pylint_score', (n % 10) + 0.5 FROM ci WHERE kind = 1
  UNION ALL SELECT run_id, step_id, 'pylint_issues', 0 FROM ci WHERE kind = 1
  UNION ALL SELECT run_id, step_id, 'flake8_issues', len(list_filter(string_split(stdout, chr(10)), lambda x: trim(x) <> '' AND contains(x, ':'))) FROM ci WHERE kind = 2
  UNION ALL SELECT run_id, step_id, 'tests_passed', n % 90 FROM ci WHERE kind = 3
  UNION ALL SELECT run_id, step_id, 'tests_failed', n % 4 FROM ci WHERE kind = 3
  UNION ALL SELECT run_id, step_id, 'tests_skipped', n % 3 FROM ci WHERE kind = 3
  UNION ALL SELECT run_id, step_id, 'tests_total', n % 90 + n % 4 + n % 3 FROM ci WHERE kind = 3
  UNION ALL SELECT run_id, step_id, 'security_issues', 2 FROM ci WHERE kind = 4
  UNION ALL SELECT run_id, step_id, 'security_high_issues', 1 FROM ci WHERE kind = 4
  UNION ALL SELECT run_id, step_id, 'security_issues', len(list_filter(string_split(stdout, chr(10)), lambda x: contains(x, 'Issue:') OR contains(x, 'CRITICAL:') OR contains(x, 'HIGH:'))) FROM ci WHERE kind = 5
  UNION ALL SELECT run_id, step_id, 'security_high_issues', 0 FROM ci WHERE kind = 5)"""


@Q.add("quality_log_metrics", with_(LOGS) + "SELECT run_id, step_id, metric, value::DOUBLE AS value FROM step_metrics")
def quality_log_metrics(spark, d):
    return logs.quality_log_metrics(A.ci_logs(spark, d))


def _m(name: str) -> str:
    return f"coalesce(arg_max(value, step_id) FILTER (WHERE metric = '{name}'), 0)::DOUBLE"


@Q.add(
    "quality_gates",
    with_(LOGS)
    + f""", runs AS (SELECT run_id, {_m('coverage_percentage')} AS cov, {_m('tests_total')} AS tt, {_m('tests_passed')} AS tp,
    {_m('security_issues')} AS si, {_m('security_high_issues')} AS sh, {_m('pylint_score')} AS ps FROM step_metrics GROUP BY 1),
gates AS (SELECT run_id, 'code_coverage' AS gate, 80.0::DOUBLE AS threshold, cov AS current_value FROM runs
  UNION ALL SELECT run_id, 'test_success_rate', 95.0, CASE WHEN tt > 0 THEN tp / tt * 100 ELSE 0 END FROM runs
  UNION ALL SELECT run_id, 'performance_score', 85.0, 85.0 FROM runs
  UNION ALL SELECT run_id, 'security_score', 90.0, greatest(0, 100 - si * 5 - sh * 10) FROM runs
  UNION ALL SELECT run_id, 'code_quality_score', 3.5, ps FROM runs)
SELECT run_id, gate, threshold, {r('current_value')} AS current_value, CASE WHEN current_value >= threshold THEN 'passed' ELSE 'failed' END AS status,
  CASE WHEN bool_and(current_value >= threshold) OVER (PARTITION BY run_id) THEN 'passed' ELSE 'failed' END AS overall_status FROM gates""",
)
def quality_gates(spark, d):
    return rounded(logs.quality_gates(logs.quality_log_metrics(A.ci_logs(spark, d))))
