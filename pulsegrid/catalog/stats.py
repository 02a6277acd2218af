"""Statistics, trends and correlations."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from pulsegrid.catalog import sqlparts as S
from pulsegrid.catalog.registry import Registry, rounded
from pulsegrid.catalog.sqlparts import r, with_
from pulsegrid.operators import stats, trends
from pulsegrid.sources import adapters as A

Q = Registry()
NAMES = ["cpu_percent", "memory_percent", "disk_percent", "network_errors", "temperature"]
QC = "quantile_cont(value, {p})"


def _q(p: float) -> str:
    return r(QC.format(p=p))


@Q.add(
    "descriptive_stats",
    with_(S.METRICS)
    + f"""SELECT metric_name, count(*) AS count, {r('avg(value)')} AS mean, {_q(0.5)} AS median,
  {r('min(value) FILTER (WHERE c = cm)')} AS mode, {r('stddev_pop(value)')} AS std, {r('var_pop(value)')} AS variance,
  {r('min(value)')} AS min, {r('max(value)')} AS max, {r('max(value) - min(value)')} AS range,
  {_q(0.25)} AS q1, {_q(0.75)} AS q3, {r('quantile_cont(value, 0.75) - quantile_cont(value, 0.25)')} AS iqr,
  {r('skewness(value) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0))')} AS skewness,
  {r('kurtosis_pop(value)')} AS kurtosis, {r('stddev_pop(value) / avg(value)')} AS cv,
  {_q(0.05)} AS p5, {_q(0.1)} AS p10, {_q(0.25)} AS p25, {_q(0.5)} AS p50, {_q(0.75)} AS p75,
  {_q(0.9)} AS p90, {_q(0.95)} AS p95, {_q(0.99)} AS p99
FROM (SELECT *, max(c) OVER (PARTITION BY metric_name) AS cm
      FROM (SELECT *, count(*) OVER (PARTITION BY metric_name, value) AS c FROM metrics_long))
GROUP BY metric_name HAVING count(*) >= 2""",
)
def descriptive_stats(spark, d):
    return rounded(stats.descriptive_stats(A.metrics_long(spark, d)))


@Q.add(
    "summary_stats",
    with_(S.METRICS)
    + f"""SELECT metric_name, {r('avg(value)')} AS mean, {r('stddev_samp(value)')} AS std, {r('min(value)')} AS min,
  {r('max(value)')} AS max, {_q(0.95)} AS percentile_95, {_q(0.99)} AS percentile_99
FROM metrics_long GROUP BY metric_name""",
)
def summary_stats(spark, d):
    return rounded(stats.summary_stats(A.metrics_long(spark, d)))


@Q.add(
    "usage_stats",
    with_(S.METRICS)
    + f"""SELECT metric_type, {r('avg(value)')} AS average, {r('max(value)')} AS max, {r('min(value)')} AS min
FROM metrics_long WHERE metric_type IN ('cpu', 'memory', 'disk') GROUP BY metric_type""",
)
def usage_stats(spark, d):
    m = A.metrics_long(spark, d).filter(F.col("metric_type").isin("cpu", "memory", "disk"))
    return rounded(stats.usage_stats(m))


TREND = f"""{r('coalesce(avg(v), 0)')} AS average, {r('coalesce(min(v), 0)')} AS minimum,
  {r('coalesce(max(v), 0)')} AS maximum, count(v) AS samples"""
# Only the network rows with an error event are missing from snapshots, so the window is theirs.
RECENT = "timestamp >= (SELECT max(timestamp) FROM snapshots) - INTERVAL {h} HOUR"


@Q.add(
    "cpu_trends",
    with_(S.SNAPSHOTS)
    + f"""SELECT {TREND} FROM (SELECT coalesce(usage_percent, 0) AS v FROM parsed
WHERE valid AND metric_type = 'cpu' AND {RECENT.format(h=240)})""",
)
def cpu_trends(spark, d):
    return rounded(trends.cpu_trends(A.snapshots(spark, d), hours=240))


@Q.add(
    "memory_trends",
    with_(S.SNAPSHOTS)
    + f"""SELECT {r('avg(usage_percent)')} AS memory_average, {r('min(usage_percent)')} AS memory_minimum,
  {r('max(usage_percent)')} AS memory_maximum, {r('avg(swap_percent)')} AS swap_average,
  {r('min(swap_percent)')} AS swap_minimum, {r('max(swap_percent)')} AS swap_maximum, count(usage_percent) AS samples
FROM parsed WHERE valid AND metric_type = 'memory' AND {RECENT.format(h=240)}""",
)
def memory_trends(spark, d):
    return rounded(trends.memory_trends(A.snapshots(spark, d), hours=240))


DISK_NET = """CASE WHEN metric_type = 'disk' THEN coalesce(total_usage_percent, usage_percent)
  WHEN metric_type = 'network' THEN coalesce(sent_rate_kbps, recv_rate_kbps)
  ELSE coalesce(usage_percent, 0) END"""


@Q.add(
    "basic_stats",
    with_(S.SNAPSHOTS)
    + f"""SELECT metric_type, {r('avg(v)')} AS average, {r('min(v)')} AS minimum, {r('max(v)')} AS maximum, count(v) AS samples
FROM (SELECT metric_type, {DISK_NET} AS v FROM parsed WHERE valid AND {RECENT.format(h=240)})
WHERE metric_type IN ('disk', 'network') AND v IS NOT NULL GROUP BY metric_type""",
)
def basic_stats(spark, d):
    return rounded(trends.basic_stats(A.snapshots(spark, d), hours=240))


@Q.add(
    "system_report",
    with_(S.SNAPSHOTS)
    + f"""SELECT section, {TREND} FROM (
  SELECT metric_type AS section, {DISK_NET} AS v FROM parsed WHERE valid AND {RECENT.format(h=480)}
  UNION ALL SELECT 'swap', swap_percent FROM parsed WHERE valid AND metric_type = 'memory' AND {RECENT.format(h=480)})
GROUP BY section""",
)
def system_report(spark, d):
    return rounded(trends.system_report(A.snapshots(spark, d), hours=480))


@Q.add(
    "extract_json_metric",
    with_(S.SNAPSHOTS)
    + f"""SELECT event_id, timestamp, metric_type, {r('v')} AS value FROM (
SELECT *, {DISK_NET} AS v FROM parsed WHERE valid) WHERE v IS NOT NULL""",
)
def extract_json_metric(spark, d):
    return rounded(trends.extract_json_metric(A.snapshots(spark, d)))


@Q.add(
    "aggregated_data",
    with_(S.SNAPSHOTS)
    + f"""SELECT metric_type, {r('avg(u)', 2)} AS average_usage, {r('min(u)', 2)} AS min_usage, {r('max(u)', 2)} AS max_usage,
  count(*) AS samples_count,
  count(*) FILTER (WHERE u > CASE metric_type WHEN 'cpu' THEN 80 WHEN 'memory' THEN 85 ELSE 90 END) AS high_usage_periods,
  {r('avg(s)', 2)} AS average_sent_kbps, {r('avg(rc)', 2)} AS average_recv_kbps,
  {r('max(s)', 2)} AS peak_sent_kbps, {r('max(rc)', 2)} AS peak_recv_kbps
FROM (SELECT metric_type,
    CASE metric_type WHEN 'disk' THEN coalesce(total_usage_percent, 0) WHEN 'network' THEN NULL ELSE coalesce(usage_percent, 0) END AS u,
    CASE WHEN metric_type = 'network' THEN coalesce(sent_rate_kbps, 0) END AS s,
    CASE WHEN metric_type = 'network' THEN coalesce(recv_rate_kbps, 0) END AS rc
  FROM parsed WHERE valid AND {RECENT.format(h=720)}) GROUP BY metric_type""",
)
def aggregated_data(spark, d):
    return trends.aggregated_data(A.snapshots(spark, d), hours=720)


@Q.add(
    "system_summary",
    with_(S.SNAPSHOTS)
    + f"""SELECT metric_type, {r('arg_max(v, event_id)')} AS current_value,
  {r('avg(v) FILTER (WHERE h1)')} AS summary_average, {r('max(v) FILTER (WHERE h1)')} AS summary_maximum,
  count(v) FILTER (WHERE h1) AS summary_samples, {r('avg(v)')} AS trend_average, {r('min(v)')} AS trend_minimum,
  {r('max(v)')} AS trend_maximum, count(v) AS trend_samples
FROM (SELECT event_id, metric_type, {DISK_NET} AS v, {RECENT.format(h=48)} AS h1 FROM parsed
  WHERE valid AND {RECENT.format(h=240)}) WHERE v IS NOT NULL GROUP BY metric_type""",
)
def system_summary(spark, d):
    return rounded(trends.system_summary(A.snapshots(spark, d), summary_hours=48, trend_hours=240))


START, END = datetime(2024, 1, 5), datetime(2024, 1, 20)


@Q.add(
    "historical_summary",
    with_(S.SNAPSHOTS)
    + f"""SELECT count(*) AS data_points,
  {r("coalesce(avg(usage_percent) FILTER (WHERE metric_type = 'cpu' AND usage_percent <> 0), 0)")} AS avg_cpu,
  {r("coalesce(max(usage_percent) FILTER (WHERE metric_type = 'memory'), 0)")} AS peak_memory
FROM parsed WHERE valid AND timestamp BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'""",
)
def historical_summary(spark, d):
    return rounded(trends.historical_summary(A.snapshots(spark, d), START, END))


POS = """pos AS (SELECT metric_name, value, row_number() OVER (PARTITION BY metric_name ORDER BY timestamp, event_id) - 1 AS pos FROM metrics_long),
wide AS (SELECT pos, max(value) FILTER (WHERE metric_name = 'cpu_percent') AS cpu_percent,
  max(value) FILTER (WHERE metric_name = 'memory_percent') AS memory_percent,
  max(value) FILTER (WHERE metric_name = 'disk_percent') AS disk_percent,
  max(value) FILTER (WHERE metric_name = 'network_errors') AS network_errors,
  max(value) FILTER (WHERE metric_name = 'temperature') AS temperature
  FROM pos WHERE pos <= (SELECT min(m) FROM (SELECT max(pos) AS m FROM pos GROUP BY metric_name)) GROUP BY pos)"""


@Q.add("positional_align", with_(S.METRICS, POS) + "SELECT pos, cpu_percent, memory_percent, disk_percent, network_errors, temperature FROM wide")
def positional_align(spark, d):
    return stats.positional_align(A.metrics_long(spark, d), NAMES)


def _pairs() -> str:
    from itertools import combinations

    return " UNION ALL ".join(
        f"SELECT '{a}' AS metric1, '{b}' AS metric2, corr({a}, {b}) AS correlation FROM wide" for a, b in combinations(NAMES, 2)
    )


@Q.add(
    "correlation_matrix",
    with_(S.METRICS, POS) + f"SELECT metric1, metric2, {r('correlation')} AS correlation FROM ({_pairs()})",
)
def correlation_matrix(spark, d):
    wide = stats.positional_align(A.metrics_long(spark, d), NAMES)
    return rounded(stats.correlation_matrix(wide, NAMES))


HOURLY = """hourly AS (SELECT date_trunc('hour', timestamp) AS h, source,
  avg(value) FILTER (WHERE metric_name = 'cpu_percent') AS cpu, count(*) AS n, sum(value) AS s, max(value) AS m
  FROM metrics_long GROUP BY 1, 2)"""


@Q.add(
    "correlation_significant",
    with_(S.METRICS, HOURLY)
    + f"""SELECT metric1, metric2, {r('c')} AS correlation, CASE WHEN abs(c) > 0.7 THEN 'strong' ELSE 'moderate' END AS strength FROM (
  SELECT 'n' AS metric1, 's' AS metric2, corr(n, s) AS c FROM hourly UNION ALL
  SELECT 'n', 'm', corr(n, m) FROM hourly UNION ALL SELECT 's', 'm', corr(s, m) FROM hourly) WHERE abs(c) > 0.5""",
)
def correlation_significant(spark, d):
    m = A.metrics_long(spark, d)
    hourly = m.groupBy(F.date_trunc("hour", "timestamp").alias("h"), "source").agg(
        F.count("*").alias("n"), F.sum("value").alias("s"), F.max("value").alias("m")
    )
    matrix = stats.correlation_matrix(hourly, ["n", "s", "m"])
    return rounded(stats.significant_correlations(matrix))
