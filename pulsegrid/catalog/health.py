"""Rollups, baselines, cubes, health and KPIs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from pulsegrid.catalog import sqlparts as S
from pulsegrid.catalog.registry import Registry, joined_lists, rounded
from pulsegrid.catalog.sqlparts import r, with_
from pulsegrid.operators import health, kpi, rollup
from pulsegrid.sources import adapters as A

Q = Registry()
H720 = "timestamp >= (SELECT max(timestamp) FROM {t}) - INTERVAL 720 HOUR"


def _score(avg: str) -> str:
    return f"""CASE WHEN metric_type IN ('cpu', 'memory', 'disk') THEN CASE WHEN {avg} > 90 THEN 0 WHEN {avg} > 80 THEN 30
  WHEN {avg} > 70 THEN 60 WHEN {avg} > 50 THEN 80 ELSE 100 END ELSE 80 END"""


def _status(s: str) -> str:
    return f"""CASE WHEN {s} >= 90 THEN 'excellent' WHEN {s} >= 70 THEN 'good' WHEN {s} >= 50 THEN 'fair'
  WHEN {s} >= 30 THEN 'poor' ELSE 'critical' END"""


SCORED = f"""agg AS (SELECT metric_type, metric_name, avg(value) AS avg_value, min(value) AS min_value, max(value) AS max_value,
  count(*) AS sample_count FROM metrics_long WHERE {H720.format(t='metrics_long')} GROUP BY 1, 2),
scored AS (SELECT *, {_score('avg_value')} AS score,
  CASE WHEN metric_type IN ('cpu', 'memory', 'disk') AND avg_value > 90 THEN printf('Critical %s usage: %.1f%%', metric_type, avg_value)
    WHEN metric_type IN ('cpu', 'memory', 'disk') AND avg_value > 80 THEN printf('High %s usage: %.1f%%', metric_type, avg_value) END AS alert FROM agg)"""


@Q.add(
    "metric_health",
    with_(S.METRICS, SCORED)
    + f"""SELECT metric_type, metric_name, {r('avg_value')} AS avg_value, {r('min_value')} AS min_value, {r('max_value')} AS max_value,
  sample_count, score, {_status('score')} AS status, alert FROM scored""",
)
def metric_health(spark, d):
    return rounded(health.metric_health(A.metrics_long(spark, d), hours=720))


@Q.add(
    "overall_health",
    with_(S.METRICS, SCORED)
    + f"SELECT {r('avg(score)', 1)} AS overall_health_score, {_status('avg(score)')} AS overall_status, count(alert) AS alert_count FROM scored",
)
def overall_health(spark, d):
    return health.overall_health(health.metric_health(A.metrics_long(spark, d), hours=720))


# Scores by host and metric give several rows below 50.
HOST_METRICS = """metrics_long AS (SELECT event_id, timestamp, metric_type, metric_name || '@' || source AS metric_name,
  least(value + 40, 100.0)::DOUBLE AS value FROM base)"""


@Q.add(
    "health_recommendations",
    with_(S.METRICS.replace("metrics_long AS", "base AS"), HOST_METRICS, SCORED)
    + """SELECT metric_type || '_' || metric_name AS metric,
  CASE WHEN metric_type || '_' || metric_name LIKE '%cpu%' THEN 'Consider optimizing CPU-intensive processes'
    WHEN metric_type || '_' || metric_name LIKE '%memory%' THEN 'Review memory usage and consider increasing available memory or optimizing usage'
    ELSE 'Clean up disk space or add storage capacity' END AS recommendation
FROM scored WHERE score < 50
UNION ALL SELECT 'all', 'Multiple performance issues detected - perform a comprehensive systems review'
FROM (SELECT count(alert) AS n FROM scored) WHERE n > 3""",
)
def health_recommendations(spark, d):
    m = A.metrics_long(spark, d)
    m = m.withColumn("metric_name", F.concat_ws("@", "metric_name", "source")).withColumn(
        "value", F.least(F.col("value") + 40, F.lit(100.0))
    )
    return health.health_recommendations(health.metric_health(m, hours=720))


@Q.add(
    "health_summary_view",
    with_(S.METRICS)
    + f"""SELECT metric_type, count(*) AS sample_count, {r('avg(value)')} AS avg_value, {r('min(value)')} AS min_value, {r('max(value)')} AS max_value
FROM metrics_long WHERE timestamp >= (SELECT max(timestamp) FROM metrics_long) - INTERVAL 24 HOUR GROUP BY 1""",
)
def health_summary_view(spark, d):
    return rounded(health.health_summary_view(A.metrics_long(spark, d), hours=24))


@Q.add(
    "top_resource_consumers",
    with_(S.PROCESS)
    + f"""SELECT name, pid, {r('avg(cpu_percent)')} AS avg_cpu, {r('avg(memory_percent)')} AS avg_memory, {r('max(memory_rss)')} AS peak_memory_rss,
  count(*) AS sample_count FROM process_metrics WHERE timestamp >= (SELECT max(timestamp) FROM process_metrics) - INTERVAL 24000 HOUR
GROUP BY name, pid HAVING count(*) > 5""",
)
def top_resource_consumers(spark, d):
    return rounded(health.top_resource_consumers(A.process_metrics(spark, d), hours=24000))


@Q.add(
    "events_summary",
    with_(S.SYSTEM_EVENTS)
    + f"""SELECT event_type, severity, count(*) AS event_count, count(*) FILTER (WHERE resolved) AS resolved_count,
  {r('avg(impact_score)')} AS avg_impact_score, max(timestamp) AS latest_event
FROM system_events WHERE {H720.format(t='system_events')} GROUP BY 1, 2""",
)
def events_summary(spark, d):
    return rounded(health.events_summary(A.system_events(spark, d), hours=720))


LEVELS = """lv AS (SELECT unnest(['hour', 'day', 'week', 'month']) AS aggregation_level),
spread AS (SELECT aggregation_level, date_trunc(aggregation_level, timestamp)::TIMESTAMP AS time_bucket, metric_type, metric_name, value FROM metrics_long, lv)"""


@Q.add(
    "rollup_metrics",
    with_(S.METRICS, LEVELS)
    + f"""SELECT aggregation_level, time_bucket, metric_type, metric_name, {r('min(value)')} AS min_value, {r('max(value)')} AS max_value,
  {r('avg(value)')} AS avg_value, {r('sum(value)')} AS sum_value, count(*) AS count_value, {r('stddev_samp(value)')} AS std_dev,
  {r('quantile_cont(value, 0.95)')} AS percentile_95, {r('quantile_cont(value, 0.99)')} AS percentile_99
FROM spread GROUP BY 1, 2, 3, 4""",
)
def rollup_metrics(spark, d):
    return rounded(rollup.rollup_metrics(A.metrics_long(spark, d)))


BASE = f"""periods AS (
  SELECT metric_name, value, 'hourly' AS baseline_type, printf('%02d:00-%02d:00', hour(timestamp), (hour(timestamp) + 1) % 24) AS time_period FROM metrics_long
  UNION ALL SELECT metric_name, value, 'daily', lower(dayname(timestamp)) FROM metrics_long
  UNION ALL SELECT metric_name, value, 'weekly', printf('week_%02d', weekofyear(timestamp)) FROM metrics_long),
baselines AS (SELECT metric_name, baseline_type, time_period, {r('min(value)')} AS min_value, {r('max(value)')} AS max_value, {r('avg(value)')} AS avg_value,
  {r('stddev_samp(value)')} AS std_dev, count(*) AS sample_count, {r('quantile_cont(value, 0.5)')} AS percentile_50, {r('quantile_cont(value, 0.9)')} AS percentile_90,
  {r('quantile_cont(value, 0.95)')} AS percentile_95, {r('quantile_cont(value, 0.99)')} AS percentile_99 FROM periods GROUP BY 1, 2, 3)"""


@Q.add("performance_baselines", with_(S.METRICS, BASE) + "SELECT * FROM baselines")
def performance_baselines(spark, d):
    return rounded(rollup.performance_baselines(A.metrics_long(spark, d)))


@Q.add(
    "baseline_join",
    with_(S.ANOMALIES, BASE)
    + f"""SELECT a.metric_name, time_period, event_id, timestamp, {r('value')} AS value, {r('anomaly_score')} AS anomaly_score,
  avg_value AS expected_value, std_dev, sample_count
FROM (SELECT *, printf('%02d:00-%02d:00', hour(timestamp), (hour(timestamp) + 1) % 24) AS period FROM anomaly_log) a
JOIN baselines b ON a.metric_name = b.metric_name AND b.baseline_type = 'hourly' AND b.time_period = a.period""",
)
def baseline_join(spark, d):
    base = rollup.performance_baselines(A.metrics_long(spark, d), kinds=("hourly",))
    return rounded(rollup.baseline_join(A.anomaly_log(spark, d), base))


def _facts(spark, d):
    return A.table(spark, d, "lineitem").select(
        F.col("l_shipdate").cast("timestamp").alias("timestamp"),
        "l_returnflag",
        "l_linestatus",
        F.date_format("l_shipdate", "yyyy-MM").alias("ship_month"),
        "l_quantity",
        "l_extendedprice",
    )


FACTS = """facts AS (SELECT l_shipdate AS timestamp, l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m') AS ship_month,
  l_quantity, l_extendedprice FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate <= TIMESTAMP '1999-12-31')"""


@Q.add("olap_cube_fetch", with_(FACTS) + "SELECT l_returnflag, ship_month, l_quantity, l_extendedprice FROM facts")
def olap_cube_fetch(spark, d):
    return rollup.olap_cube_fetch(
        _facts(spark, d), ["l_returnflag", "ship_month"], ["l_quantity", "l_extendedprice"],
        datetime(1997, 1, 1), datetime(1999, 12, 31),
    )


def _olap_sql(group: str) -> str:
    return (
        with_(FACTS)
        + f"""SELECT l_returnflag, l_linestatus, ship_month, {r('avg(l_quantity)')} AS l_quantity_mean, {r('max(l_quantity)')} AS l_quantity_max,
  {r('min(l_quantity)')} AS l_quantity_min, {r('avg(l_extendedprice)')} AS l_extendedprice_mean, {r('max(l_extendedprice)')} AS l_extendedprice_max,
  {r('min(l_extendedprice)')} AS l_extendedprice_min FROM facts GROUP BY {group}"""
    )


def _olap(spark, d, mode):
    dims, mets = ["l_returnflag", "l_linestatus", "ship_month"], ["l_quantity", "l_extendedprice"]
    cube = rollup.olap_cube_fetch(_facts(spark, d), dims, mets, datetime(1997, 1, 1), datetime(1999, 12, 31))
    return rounded(rollup.olap_aggregate(cube, dims, mets, mode))


@Q.add("olap_aggregate", _olap_sql("1, 2, 3"))
def olap_aggregate(spark, d):
    return _olap(spark, d, "group")


@Q.add("olap_aggregate_cube", _olap_sql("CUBE (l_returnflag, l_linestatus, ship_month)"))
def olap_aggregate_cube(spark, d):
    return _olap(spark, d, "cube")


@Q.add(
    "weighted_system_health",
    with_(S.TICKS)
    + f"""SELECT tick_id, {r('c')} AS cpu_health, {r('m')} AS memory_health, {r('k')} AS disk_health,
  {r('c * 0.25::DOUBLE + m * 0.25::DOUBLE + k * 0.20::DOUBLE + 0.15::DOUBLE * 0.9::DOUBLE + 0.15::DOUBLE * 0.95::DOUBLE')} AS overall_score
FROM (SELECT tick_id, greatest(0.0, 1 - cpu_percent / 100) AS c, greatest(0.0, 1 - memory_percent / 100) AS m,
  greatest(0.0, 1 - disk_percent / 100) AS k FROM ticks)""",
)
def weighted_system_health(spark, d):
    out = health.weighted_system_health(A.cpu_memory_ticks(spark, d))
    return rounded(out.select("tick_id", "cpu_health", "memory_health", "disk_health", "overall_score"))


@Q.add(
    "database_health_score",
    f"""SELECT o_orderkey AS sample_id, {r('greatest(0.0, 1 - CASE WHEN o_totalprice / 100 > 1000 THEN 0.1 ELSE 0 END - CASE WHEN o_totalprice / 1000 > 100 THEN 0.2 ELSE 0 END - CASE WHEN (o_custkey % 100) / 100.0 > 0.8 THEN 0.1 ELSE 0 END)')} AS health_score FROM orders""",
)
def database_health_score(spark, d):
    o = A.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("sample_id"),
        (F.col("o_totalprice") / 100).alias("db_size_mb"),
        (F.col("o_totalprice") / 1000).alias("avg_query_time"),
        ((F.col("o_custkey") % 100) / 100.0).alias("connection_pool_usage"),
    )
    return rounded(health.database_health_score(o).select("sample_id", "health_score"))


def _check(name: str, judged: str, m: str, warn: float, crit: float, floor: str | None = None) -> tuple[str, str]:
    healthy = f"1 - {m} / 100" if floor is None else f"greatest({floor}, 1 - {m} / 100)"
    return (
        f"CASE WHEN {judged} >= {crit} THEN 'critical' WHEN {judged} >= {warn} THEN 'warning' ELSE 'healthy' END",
        f"CASE WHEN {judged} >= {crit} THEN 0 WHEN {judged} >= {warn} THEN 0.5 ELSE {healthy} END",
    )


_cs, _cv = _check("cpu", "cpu_peak", "cpu", 80, 95)
_ms, _mv = _check("memory", "memory", "memory", 80, 95)
_ds, _dv = _check("disk", "disk", "disk", 85, 95)
_bs, _bv = _check("database", "db", "db", 100, 500, "0.1")
CHECKS = f"""hosts AS (SELECT host, max(cpu_percent) AS cpu_peak, avg(cpu_percent) AS cpu, avg(memory_percent) AS memory,
  avg(swap_percent) AS swap, avg(db_latency_ms) AS db FROM ticks GROUP BY 1),
volumes AS (SELECT host, volume, avg(disk_percent) AS disk FROM ticks GROUP BY 1, 2),
checks AS (
  SELECT host, 'cpu_health' AS "check", cpu AS measure, {_cs} AS status, ({_cv})::DOUBLE AS score FROM hosts
  UNION ALL SELECT host, 'memory_health', memory, CASE WHEN swap > 50 THEN 'warning' ELSE {_ms} END,
    (CASE WHEN swap > 50 THEN least({_mv}, 0.3) ELSE {_mv} END)::DOUBLE FROM hosts
  UNION ALL SELECT host, 'database_health', db, {_bs}, ({_bv})::DOUBLE FROM hosts
  UNION ALL SELECT host, 'disk_health_' || CAST(volume AS VARCHAR), disk, {_ds}, ({_dv})::DOUBLE FROM volumes)"""


@Q.add(
    "diagnostic_checks",
    with_(S.TICKS, CHECKS) + f'SELECT host, "check", {r("measure")} AS measure, status, {r("score")} AS score FROM checks',
)
def diagnostic_checks(spark, d):
    return rounded(health.diagnostic_checks(A.cpu_memory_ticks(spark, d)))


_ADVICE = " ".join(
    f"WHEN status = '{s}' AND \"check\" LIKE '%{c}%' THEN '{t}'" for (s, c), t in health.DIAGNOSTIC_ADVICE.items()
)


@Q.add(
    "diagnostics_overall",
    with_(S.TICKS, CHECKS)
    + f"""SELECT host, {r('avg(score)')} AS overall_score, coalesce(array_to_string(list_sort(list(DISTINCT advice) FILTER (WHERE advice IS NOT NULL)), '|'), '') AS recommendations,
  CASE WHEN avg(score) >= 0.8 THEN 'healthy' WHEN avg(score) >= 0.6 THEN 'warning' ELSE 'critical' END AS overall_health
FROM (SELECT *, CASE {_ADVICE} END AS advice FROM checks) GROUP BY host""",
)
def diagnostics_overall(spark, d):
    return joined_lists(rounded(health.diagnostics_overall(health.diagnostic_checks(A.cpu_memory_ticks(spark, d)))))


@Q.add(
    "freshness_check",
    with_(S.METRICS)
    + """SELECT metric_name, recent_metrics_count, last_metric_time, CASE WHEN recent_metrics_count < 10 THEN 'warning' ELSE 'healthy' END AS status,
  CASE WHEN recent_metrics_count = 0 THEN 'No recent metrics found' WHEN recent_metrics_count < 10 THEN 'Low metric collection rate' ELSE 'Metrics collection normal' END AS message
FROM (SELECT metric_name || '@' || source AS metric_name, count(*) FILTER (WHERE timestamp >= (SELECT max(timestamp) FROM metrics_long) - INTERVAL 6 HOUR) AS recent_metrics_count,
  max(timestamp) AS last_metric_time FROM metrics_long GROUP BY 1)""",
)
def freshness_check(spark, d):
    m = A.metrics_long(spark, d).withColumn("metric_name", F.concat_ws("@", "metric_name", "source"))
    return health.freshness_check(m, hours=6)


def _res(c: str, crit: int, warn: int) -> str:
    return f"CASE WHEN {c}_percent > {crit} THEN 'critical' WHEN {c}_percent > {warn} THEN 'warning' ELSE 'healthy' END AS {c}_status"


@Q.add(
    "resource_status",
    with_(S.TICKS) + f"SELECT tick_id, {_res('cpu', 90, 75)}, {_res('memory', 90, 80)}, {_res('disk', 95, 85)} FROM ticks",
)
def resource_status(spark, d):
    out = health.resource_status(A.cpu_memory_ticks(spark, d))
    return out.select("tick_id", "cpu_status", "memory_status", "disk_status")


@Q.add(
    "overall_status_fold",
    with_(S.TICKS, CHECKS)
    + """SELECT host, CASE WHEN bool_or(status = 'unhealthy') THEN 'unhealthy' WHEN bool_or(status IN ('warning', 'critical')) THEN 'warning' ELSE 'healthy' END AS overall_status,
  coalesce(string_agg(DISTINCT "check", '|' ORDER BY "check") FILTER (WHERE status = 'unhealthy'), '') AS unhealthy_checks,
  coalesce(string_agg(DISTINCT "check", '|' ORDER BY "check") FILTER (WHERE status IN ('warning', 'critical')), '') AS warning_checks,
  count(*) FILTER (WHERE status = 'healthy') AS healthy_checks
FROM (SELECT host, "check", CASE WHEN "check" = 'database_health' AND host = 'host_2' THEN 'unhealthy' ELSE status END AS status FROM checks) GROUP BY host""",
)
def overall_status_fold(spark, d):
    checks = health.diagnostic_checks(A.cpu_memory_ticks(spark, d))
    down = (F.col("check") == "database_health") & (F.col("host") == "host_2")
    checks = checks.withColumn("status", F.when(down, "unhealthy").otherwise(F.col("status")))
    return joined_lists(health.overall_status_fold(checks))


@Q.add(
    "resource_distribution",
    with_(S.TICKS)
    + f"""SELECT tick_id, {r('100 - greatest(cpu_percent, memory_percent, disk_percent)')} AS available, {r('least((db_latency_ms + swap_percent) / 10, 100.0)')} AS network_scaled FROM ticks""",
)
def resource_distribution(spark, d):
    t = A.cpu_memory_ticks(spark, d).withColumn("sent_kbps", F.col("db_latency_ms")).withColumn("recv_kbps", F.col("swap_percent"))
    return rounded(health.resource_distribution(t).select("tick_id", "available", "network_scaled"))


HOURS = 720
W = H720


def _kstat(kname: str, v: str) -> str:
    t, w, c, _, inv = kpi.KPIS[kname]
    op = "<=" if inv else ">="
    return f"CASE WHEN {v} {op} {t} THEN 'excellent' WHEN {v} {op} {w} THEN 'good' WHEN {v} {op} {c} THEN 'warning' ELSE 'critical' END"


def _kpi_select(kname: str, raw: str, digits: int, src: str, empty: str | None = None, group: str = "") -> str:
    t, _, _, unit, _ = kpi.KPIS[kname]
    val, st = r("raw", digits), _kstat(kname, "raw")
    if empty:
        v, s = empty.split(",")
        val, st = f"CASE WHEN raw IS NULL THEN {v} ELSE {val} END", f"CASE WHEN raw IS NULL THEN '{s}' ELSE {st} END"
    g = f"{group}, " if group else ""
    tail = f" GROUP BY {group.split(' AS ')[0] if group else ''}" if group else ""
    gname = f"{group.split(' AS ')[-1]}, " if group else ""
    return f"SELECT {gname}'{kname}' AS kpi_name, {val} AS value, {st} AS status, {float(t)}::DOUBLE AS target, '{unit}' AS unit FROM (SELECT {g}({raw})::DOUBLE AS raw FROM {src}{tail})"


def _kpi_sql(kname: str, mwhere: str, ewhere: str, hours: float, group: str = "") -> str:
    m, e = f"metrics_long WHERE {mwhere}", f"system_events WHERE {ewhere}"
    err = "count(*) FILTER (WHERE severity IN ('error', 'critical'))"
    if kname == "system_availability":
        raw = f"CASE WHEN count(*) = 0 THEN 100 ELSE greatest(0.0, ({hours * 60}::DOUBLE - {err} * 5) / {hours * 60}::DOUBLE * 100) END"
        return _kpi_select(kname, raw, 2, e, None, group)
    if kname == "error_rate":
        return _kpi_select(kname, f"{err} / {hours}::DOUBLE", 2, e, None, group)
    if kname == "average_response_time":
        raw = "CASE WHEN avg(value) IS NULL THEN NULL WHEN avg(value) > 90 THEN 5 WHEN avg(value) > 80 THEN 3 WHEN avg(value) > 70 THEN 2 WHEN avg(value) > 50 THEN 1.5 ELSE 1 END"
        return _kpi_select(kname, raw, 2, m + " AND metric_name LIKE '%cpu%'", "1.0,good", group)
    if kname == "cpu_efficiency":
        raw = """CASE WHEN avg(value) IS NULL THEN NULL ELSE greatest(0.0, least(100.0, CASE WHEN avg(value) > 95 THEN 20 WHEN avg(value) > 85 THEN 40
          WHEN avg(value) > 70 THEN 80 - (max(value) - avg(value)) * 2 WHEN avg(value) > 50 THEN 90 - (max(value) - avg(value)) * 1.5 ELSE 95 END)) END"""
        return _kpi_select(kname, raw, 1, m + " AND metric_type = 'cpu'", "50.0,fair", group)
    if kname == "memory_efficiency":
        return _kpi_select(kname, "avg(value)", 1, m + " AND metric_type = 'memory'", "50.0,fair", group)
    a = {k: f"avg(value) FILTER (WHERE metric_type = '{k}')" for k in ("cpu", "memory", "disk")}
    raw = f"""(coalesce({a['cpu']} * 0.4, 0) + coalesce({a['memory']} * 0.3, 0) + coalesce({a['disk']} * 0.3, 0))
      / nullif(CASE WHEN {a['cpu']} IS NULL THEN 0 ELSE 0.4 END + CASE WHEN {a['memory']} IS NULL THEN 0 ELSE 0.3 END + CASE WHEN {a['disk']} IS NULL THEN 0 ELSE 0.3 END, 0)"""
    return _kpi_select(kname, raw, 1, m, "50.0,fair", group)


_M, _E = H720.format(t="metrics_long"), H720.format(t="system_events")


def _register_kpi(kname: str, query: str) -> None:
    @Q.add(query, with_(S.METRICS, S.SYSTEM_EVENTS) + _kpi_sql(kname, _M, _E, HOURS))
    def one(spark, d):
        return kpi.calculate_kpi(kname, A.metrics_long(spark, d), A.system_events(spark, d), HOURS)


for _name, _query in {
    "system_availability": "kpi_availability",
    "average_response_time": "kpi_response_time",
    "cpu_efficiency": "kpi_cpu_efficiency",
    "memory_efficiency": "kpi_memory_efficiency",
    "error_rate": "kpi_error_rate",
    "capacity_utilization": "kpi_capacity_utilization",
}.items():
    _register_kpi(_name, _query)

ALL_KPIS = "kpis AS (" + " UNION ALL ".join(_kpi_sql(k, _M, _E, HOURS) for k in kpi.KPIS) + ")"


@Q.add(
    "kpi_status",
    with_(S.METRICS)
    + f"SELECT event_id, {_kstat('cpu_efficiency', 'value')} AS inverse_status, {_kstat('system_availability', 'value')} AS direct_status FROM metrics_long",
)
def kpi_status(spark, d):
    v = F.col("value")
    return A.metrics_long(spark, d).select(
        "event_id",
        kpi.kpi_status(v, "cpu_efficiency").alias("inverse_status"),
        kpi.kpi_status(v, "system_availability").alias("direct_status"),
    )


_EXEC = " ".join(f"WHEN kpi_name = '{k}' AND status = '{s}' THEN '{t}'" for (k, s), t in kpi.EXECUTIVE_ADVICE.items())
_ORDER = " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(kpi.KPIS))
_COUNTS = ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in kpi.STATUS_POINTS)


@Q.add(
    "executive_dashboard",
    with_(S.METRICS, S.SYSTEM_EVENTS, ALL_KPIS)
    + f""", texts AS (SELECT t, o FROM (SELECT CASE {_EXEC} END AS t, CASE kpi_name {_ORDER} END AS o FROM kpis) WHERE t IS NOT NULL
  UNION ALL SELECT '{kpi.MANY_CRITICAL}', -1 FROM (SELECT count(*) AS c FROM kpis WHERE status = 'critical') WHERE c >= 2
  UNION ALL SELECT '{kpi.DEGRADING}', 99 FROM (SELECT count(*) FILTER (WHERE status = 'critical') AS c, count(*) FILTER (WHERE status = 'warning') AS w FROM kpis) WHERE c = 1 AND w >= 2)
SELECT {_COUNTS}, {r("avg(CASE status WHEN 'excellent' THEN 100 WHEN 'good' THEN 80 WHEN 'warning' THEN 50 WHEN 'critical' THEN 20 ELSE 50 END)", 1)} AS overall_health_score,
  (SELECT coalesce(string_agg(t, '|' ORDER BY o), '') FROM (SELECT * FROM texts ORDER BY o LIMIT 5)) AS recommendations FROM kpis""",
)
def executive_dashboard(spark, d):
    k = kpi.dashboard_kpis(A.metrics_long(spark, d), A.system_events(spark, d), HOURS)
    return joined_lists(kpi.executive_dashboard(k))


_DM = "timestamp >= (SELECT max(timestamp) FROM metrics_long)::DATE - INTERVAL 7 DAY AND timestamp < (SELECT max(timestamp) FROM metrics_long)::DATE"
_DE = _DM


@Q.add(
    "kpi_by_day",
    with_(S.METRICS, S.SYSTEM_EVENTS)
    + " UNION ALL ".join(_kpi_sql(k, _DM, _DE, 24, "strftime(timestamp, '%Y-%m-%d') AS date") for k in kpi.KPIS),
)
def kpi_by_day(spark, d):
    m, e = A.metrics_long(spark, d), A.system_events(spark, d)
    from pulsegrid.functions.timewin import latest

    as_of, out = latest(m), None
    for k in kpi.KPIS:
        one = kpi.kpi_by_day(k, m, e, 7, as_of)
        out = one if out is None else out.unionByName(one)
    return out.withColumn("date", F.col("date").cast("string"))


@Q.add(
    "kpi_trend",
    with_(S.METRICS, S.SYSTEM_EVENTS)
    + f""", daily AS ({_kpi_sql('memory_efficiency', _DM, _DE, 24, 'timestamp::DATE AS date')})
SELECT 'memory_efficiency' AS kpi_name, count(*) AS days, CASE WHEN arg_max(value, date) > arg_min(value, date) THEN 'improving' ELSE 'declining' END AS direction,
  {r('(arg_max(value, date) - arg_min(value, date)) / arg_min(value, date) * 100', 2)} AS change_percent, arg_max(value, date) AS current_value, {r('avg(value)', 2)} AS average_value FROM daily""",
)
def kpi_trend(spark, d):
    return kpi.kpi_trend(kpi.kpi_by_day("memory_efficiency", A.metrics_long(spark, d), A.system_events(spark, d)))
