"""Sources, sinks, table maintenance, exports and payload flattening."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.catalog import sqlparts as S
from pulsegrid.catalog.registry import Registry, rounded
from pulsegrid.catalog.sqlparts import HOST, K, r, with_
from pulsegrid.functions.timewin import latest
from pulsegrid.operators import kpi
from pulsegrid.plans.staging import stage_path
from pulsegrid.sources import adapters as A
from pulsegrid.sources import payloads, storage, versioned
from pulsegrid.streaming import jobs

Q = Registry()


@Q.add(
    "append_metric_snapshots",
    f"""SELECT event_id, timestamp, metric_type, data FROM (
  SELECT event_id, ts AS timestamp, unnest([
    {{'metric_type': 'cpu', 'data': '{{"usage_percent":' || CAST(value AS VARCHAR) || '}}'}},
    {{'metric_type': 'memory', 'data': '{{"usage_percent":' || CAST({K} AS VARCHAR) || ',"host":"' || {HOST} || '"}}'}},
    {{'metric_type': 'disk', 'data': '{{"total_usage_percent":' || CAST({K} AS VARCHAR) || '}}'}},
    {{'metric_type': 'network', 'data': '{{"sent_rate_kbps":' || CAST(value AS VARCHAR) || ',"recv_rate_kbps":' || CAST({K} AS VARCHAR) || '}}'}}], recursive := true)
  FROM events)""",
)
def append_metric_snapshots(spark, d):
    e = A.table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    host = F.concat(F.lit("host_"), (F.col("user_id") % 4).cast("string"))
    ticks = e.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.struct(F.col("value").alias("usage_percent")).alias("cpu"),
        F.struct(k.alias("usage_percent"), host.alias("host")).alias("memory"),
        F.struct(k.alias("total_usage_percent")).alias("disk"),
        F.struct(F.col("value").alias("sent_rate_kbps"), k.alias("recv_rate_kbps")).alias("network"),
    )
    path = stage_path(spark, "system_metrics")
    storage.append_table(storage.metric_snapshot_rows(ticks), path)
    return spark.read.parquet(path).drop("date")


@Q.add(
    "clean_process_snapshots",
    """SELECT l_shipdate AS timestamp, l_partkey AS pid, 'p' || CAST(l_suppkey % 9 AS VARCHAR) AS name,
  CASE WHEN l_linenumber = 7 THEN 0 ELSE (round(l_discount * 1000, 6) + 0.0::DOUBLE) END AS cpu_percent, 0.0::DOUBLE AS memory_percent,
  l_quantity AS memory_mb, l_linestatus AS status, CAST(NULL AS VARCHAR) AS username
FROM lineitem WHERE l_partkey % 11 <> 0 AND l_linenumber <> 6""",
)
def clean_process_snapshots(spark, d):
    return rounded(storage.clean_process_snapshots(A.raw_processes(spark, d)))


@Q.add(
    "append_long_metric",
    with_(S.METRICS)
    + """SELECT event_id, timestamp, metric_type, metric_name, value, metadata, source, '["' || tag || '"]' AS tags FROM metrics_long""",
)
def append_long_metric(spark, d):
    path = stage_path(spark, "metrics_current")
    storage.append_table(storage.long_metric_rows(A.metrics_long(spark, d)), path)
    return spark.read.parquet(path).drop("date")


@Q.add(
    "append_system_event",
    with_(S.SYSTEM_EVENTS)
    + """SELECT event_id, timestamp, event_type, severity, source, title, resolved, impact_score,
  '["' || event_type || '"]' AS tags, '["cpu_percent"]' AS related_metrics FROM system_events""",
)
def append_system_event(spark, d):
    path = stage_path(spark, "system_events")
    storage.append_table(storage.system_event_rows(A.system_events(spark, d)), path)
    return spark.read.parquet(path).drop("date")


@Q.add(
    "append_process_metrics",
    with_(S.PROCESS)
    + f"""SELECT timestamp, pid, name, {r('cpu_percent')} AS cpu_percent, {r('memory_percent')} AS memory_percent, memory_rss, username, status, parent_pid,
  '{{"order":' || CAST(l_orderkey AS VARCHAR) || ',"line":' || CAST(l_linenumber AS VARCHAR) || '}}' AS io_counters FROM process_metrics""",
)
def append_process_metrics(spark, d):
    p = A.process_metrics(spark, d)
    p = p.withColumn("io_counters", F.struct(F.col("l_orderkey").alias("order"), F.col("l_linenumber").alias("line")))
    rows = storage.process_metric_rows(p.drop("l_orderkey", "l_linenumber", "l_suppkey"), ["io_counters"])
    path = stage_path(spark, "process_metrics")
    # Ship dates give thousands of date partitions; processes are kept by year.
    rows = rows.withColumn("year", F.year("timestamp"))
    rows.hint("rebalance", "year").write.mode("append").partitionBy("year").parquet(path)
    return rounded(spark.read.parquet(path).drop("year"))


@Q.add("scan_table", "SELECT * FROM orders")
def scan_table(spark, d):
    return storage.scan_table(spark, f"{d}/orders.parquet")


@Q.add(
    "historical_scan",
    with_(S.SNAPSHOTS)
    + f"""SELECT event_id, timestamp, metric_type, {r('usage_percent')} AS usage_percent, {r('swap_percent')} AS swap_percent FROM parsed
WHERE metric_type = 'memory' AND timestamp >= (SELECT max(timestamp) FROM parsed WHERE metric_type = 'memory') - INTERVAL 240 HOUR""",
)
def historical_scan(spark, d):
    schema = T.StructType.fromDDL("usage_percent DOUBLE, swap STRUCT<usage_percent: DOUBLE>")
    out = storage.historical_scan(A.snapshots(spark, d), "memory", schema, hours=240)
    return rounded(
        out.select(
            "event_id", "timestamp", "metric_type",
            F.col("payload.usage_percent").alias("usage_percent"),
            F.col("payload.swap.usage_percent").alias("swap_percent"),
        )
    )


START, END = datetime(2024, 1, 5), datetime(2024, 1, 20)
IN_RANGE = "timestamp BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'"


@Q.add(
    "load_time_series",
    with_(S.METRICS) + f"SELECT event_id, timestamp, value FROM metrics_long WHERE metric_name = 'cpu_percent' AND {IN_RANGE}",
)
def load_time_series(spark, d):
    out = storage.load_time_series(A.metrics_long(spark, d), "cpu_percent", START, END)
    return out.select("event_id", "timestamp", "value")


WEEK_OLD = "timestamp < (SELECT max(timestamp) FROM metrics_long) - INTERVAL 7 DAY"


@Q.add(
    "tier_route",
    with_(S.METRICS)
    + f"SELECT event_id, timestamp, value, CASE WHEN {WEEK_OLD} THEN 'historical' ELSE 'current' END AS tier FROM metrics_long",
)
def tier_route(spark, d):
    m = A.metrics_long(spark, d)
    return storage.tier_route(m, latest(m)).select("event_id", "timestamp", "value", "tier")


@Q.add(
    "all_metrics_view",
    with_(S.METRICS)
    + f"""SELECT event_id, timestamp, metric_type, metric_name, value, CASE WHEN {WEEK_OLD} THEN 'historical' ELSE 'current' END AS partition_type FROM metrics_long""",
)
def all_metrics_view(spark, d):
    m = A.metrics_long(spark, d)
    current, old = stage_path(spark, "current"), stage_path(spark, "historical")
    storage.write_tiers(m, current, old, latest(m))
    view = storage.all_metrics_view(spark.read.parquet(current), spark.read.parquet(old))
    return view.select("event_id", "timestamp", "metric_type", "metric_name", "value", "partition_type")


@Q.add(
    "derive_business_metrics",
    with_(S.METRICS)
    + """SELECT timestamp, 'performance' AS metric_category, metric_type || '_utilization' AS metric_name, value, 'percent' AS unit
FROM metrics_long WHERE metric_type IN ('cpu', 'memory', 'disk')""",
)
def derive_business_metrics(spark, d):
    return storage.derive_business_metrics(A.metrics_long(spark, d))


@Q.add(
    "retention_cleanup",
    with_(S.METRICS)
    + "SELECT event_id, timestamp, metric_name, value FROM metrics_long WHERE timestamp >= (SELECT max(timestamp) FROM metrics_long) - INTERVAL 7 DAY",
)
def retention_cleanup(spark, d):
    m = A.metrics_long(spark, d).select("event_id", "timestamp", "metric_name", "value")
    table = versioned.VersionedTable(spark, stage_path(spark, "retained"))
    # Two commits, so that dates have rows of both.
    late = F.col("event_id") % 7 == 0
    versioned.append_dated(table, m.filter(~late))
    versioned.append_dated(table, m.filter(late))
    versioned.retain(table, latest(m))
    table.vacuum()
    return table.read().drop("date")


STATS_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


@Q.add(
    "table_stats",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, (SELECT count(*) FROM {t}) AS row_count, CAST((SELECT count(*) FROM (DESCRIBE {t})) AS INTEGER) AS column_count, (SELECT string_agg(column_name, ', ' ORDER BY column_name) FROM (DESCRIBE {t})) AS column_names"
        for t in STATS_TABLES
    ),
)
def table_stats(spark, d):
    out = storage.table_stats(spark, {t: f"{d}/{t}.parquet" for t in STATS_TABLES})
    # Type names differ between engines.
    names = F.transform(F.split("columns", ", "), lambda c: F.split(c, " ")[0])
    return out.select("table_name", "row_count", "column_count", F.array_join(F.array_sort(names), ", ").alias("column_names"))


@Q.add("incremental_load", with_(S.METRICS) + "SELECT event_id, timestamp, metric_name, value FROM metrics_long")
def incremental_load(spark, d):
    m = A.metrics_long(spark, d).select("event_id", "timestamp", "metric_name", "value")
    path = stage_path(spark, "incremental")
    early = F.col("timestamp") < F.lit(START)
    # Every seventh early row comes late.
    storage.incremental_load(spark, m.filter(early & (F.col("event_id") % 7 != 0)), path)
    storage.incremental_load(spark, m, path)
    return storage.incremental_load(spark, m, path, row_id=["event_id"]).drop("date")


def _deliveries(spark, df, name):
    """Stream over three files of ``df``: late rows in the second, all rows again in the third."""
    path = stage_path(spark, name)
    for part in (F.col("event_id") % 7 != 0, F.col("event_id") % 7 == 0, F.lit(True)):
        df.filter(part).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


@Q.add("incremental_stream", with_(S.METRICS) + "SELECT event_id, timestamp, metric_name, value FROM metrics_long")
def incremental_stream(spark, d):
    m = A.metrics_long(spark, d).select("event_id", "timestamp", "metric_name", "value")
    table = versioned.VersionedTable(spark, stage_path(spark, "loaded"))
    jobs.incremental_stream(_deliveries(spark, m, "to-load"), table, stage_path(spark, "load-checkpoint"), ["event_id"])
    return table.read().drop("date")


@Q.add(
    "tier_stream",
    with_(S.METRICS)
    + f"""SELECT event_id, timestamp, metric_name, value, CASE WHEN {WEEK_OLD} THEN 'historical' ELSE 'current' END AS partition_type FROM metrics_long""",
)
def tier_stream(spark, d):
    m = A.metrics_long(spark, d).select("event_id", "timestamp", "metric_name", "value")
    source = stage_path(spark, "to-tier")
    m.repartition(3, "event_id").write.parquet(source)
    stream = spark.readStream.schema(m.schema).option("maxFilesPerTrigger", 1).parquet(source)
    current, old = (versioned.VersionedTable(spark, stage_path(spark, n)) for n in ("current", "historical"))
    jobs.tier_stream(stream, current, old, stage_path(spark, "tier-checkpoint"), latest(m))
    return storage.all_metrics_view(current.read(), old.read()).drop("date")


NEWEST_CHANGES = """WITH newest AS (SELECT * FROM (SELECT o_custkey AS c_custkey, o_totalprice AS c_acctbal, o_orderpriority AS c_mktsegment,
    CASE o_orderstatus WHEN 'F' THEN 'delete' WHEN 'O' THEN 'update' ELSE 'insert' END AS op,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1)
SELECT c_custkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM newest)
UNION ALL SELECT c_custkey, c_acctbal, c_mktsegment FROM newest WHERE op <> 'delete'"""


def _changes(spark, d):
    kind = F.when(F.col("o_orderstatus") == "F", "delete").when(F.col("o_orderstatus") == "O", "update")
    return A.table(spark, d, "orders").select(
        F.col("o_custkey").alias("c_custkey"),
        F.col("o_totalprice").alias("c_acctbal"),
        F.col("o_orderpriority").alias("c_mktsegment"),
        kind.otherwise("insert").alias("op"),
        "o_orderdate",
        "o_orderkey",
    )


@Q.add("cdc_apply", NEWEST_CHANGES)
def cdc_apply(spark, d):
    base = A.table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return storage.cdc_apply(base, _changes(spark, d), ["c_custkey"], ["o_orderdate", "o_orderkey"])


@Q.add("cdc_stream", NEWEST_CHANGES)
def cdc_stream(spark, d):
    """The change log in five deliveries, newest orders first, some delivered twice."""
    base = A.table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    changes, log = _changes(spark, d), stage_path(spark, "cdc-log")
    for part in (4, 2, 3, 0, 1):
        again = (F.col("o_orderkey") % 7 == 0) & (F.col("o_orderkey") % 5 == (part + 1) % 5)
        changes.filter((F.col("o_orderkey") % 5 == part) | again).coalesce(1).write.mode("append").parquet(log)
    table = versioned.ChangeTable(spark, stage_path(spark, "cdc-table"), ["c_custkey"], ["o_orderdate", "o_orderkey"], 8)
    table.load(base, changes)
    stream = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 1).parquet(log)
    jobs.for_each_batch(stream, lambda batch, n: table.apply(batch, n + 2), stage_path(spark, "cdc-checkpoint"))
    return table.read()


def _first(kind: str, col: str) -> str:
    return f"arg_min({{'v': {col}}}, event_id) FILTER (WHERE metric_type = '{kind}')['v']"


WIDE = f"""SELECT timestamp, {_first('cpu', 'usage_percent')} AS cpu_percent, {_first('memory', 'usage_percent')} AS memory_percent,
  {r("nullif(" + _first('memory', 'total') + ", 0) / 1073741824.0", 2)} AS memory_total_gb,
  {_first('network', 'sent_rate_kbps')} AS network_sent_kbps, {_first('network', 'recv_rate_kbps')} AS network_recv_kbps
FROM parsed WHERE valid AND metric_type IN ('cpu', 'memory', 'network') GROUP BY timestamp"""
WIDE = WIDE.replace("arg_min({'v': ", "(arg_min({'v': ").replace(")['v']", "))['v']")


@Q.add("export_wide_csv", with_(S.SNAPSHOTS) + WIDE)
def export_wide_csv(spark, d):
    out = storage.export_wide(A.snapshots(spark, d))
    path = stage_path(spark, "wide_csv")
    storage.write_csv(out, path, ["timestamp"])
    return storage.read_csv(spark, path, out.schema)


@Q.add("align_on_timestamp", with_(S.SNAPSHOTS) + WIDE)
def align_on_timestamp(spark, d):
    return storage.export_wide(A.snapshots(spark, d))


@Q.add(
    "timestamp_union",
    with_(S.SNAPSHOTS) + "SELECT DISTINCT timestamp FROM snapshots WHERE metric_type IN ('cpu', 'memory', 'network')",
)
def timestamp_union(spark, d):
    return storage.timestamp_union(A.snapshots(spark, d))


@Q.add(
    "export_single_csv",
    with_(S.SNAPSHOTS)
    + "SELECT timestamp, sent_rate_kbps, recv_rate_kbps FROM parsed WHERE valid AND metric_type = 'network'",
)
def export_single_csv(spark, d):
    fields = {"sent_rate_kbps": "DOUBLE", "recv_rate_kbps": "DOUBLE"}
    snaps = A.snapshots(spark, d).filter(F.get_json_object("data", "$").isNotNull())
    out = storage.export_single(snaps, "network", fields)
    path = stage_path(spark, "single_csv")
    storage.write_csv(out, path)
    return storage.read_csv(spark, path, out.schema)


@Q.add("export_json", with_(S.METRICS) + "SELECT event_id, timestamp, metric_name, value, source, metric_type FROM metrics_long")
def export_json(spark, d):
    out = A.metrics_long(spark, d).select("event_id", "timestamp", "metric_name", "value", "source", "metric_type")
    path = stage_path(spark, "json")
    storage.write_json(out, path, ["metric_type"])
    return spark.read.schema(out.schema).option("timestampFormat", storage.CSV_TIMESTAMP).json(path)


@Q.add(
    "export_manifest",
    with_(S.METRICS)
    + "SELECT TIMESTAMP '2024-01-31' AS exported_at, metric_type AS data_type, 720.0::DOUBLE AS time_range_hours, count(*) AS row_count FROM metrics_long GROUP BY metric_type",
)
def export_manifest(spark, d):
    return storage.export_manifest(A.metrics_long(spark, d), "metric_type", 720, datetime(2024, 1, 31))


def _kpi_rows_sql() -> str:
    from pulsegrid.catalog.health import ALL_KPIS

    return with_(S.METRICS, S.SYSTEM_EVENTS, ALL_KPIS) + "SELECT kpi_name, value, status, target, unit FROM kpis"


@Q.add("export_kpis", _kpi_rows_sql())
def export_kpis(spark, d):
    rows = kpi.dashboard_kpis(A.metrics_long(spark, d), A.system_events(spark, d), 720)
    path = stage_path(spark, "kpis_csv")
    storage.write_csv(rows, path)
    return storage.read_csv(spark, path, rows.schema)


DEVICES = f"""devices AS (SELECT event_id, 'dev_' || CAST(user_id % 25 AS VARCHAR) AS device_id, 'sensor_hub' AS device_type, ts AS timestamp, value, {K} AS k, event_type <> 'error' AS up FROM events),
readings AS (
  SELECT event_id, device_id, timestamp, 'temperature' AS sensor_type, value, 'C' AS unit, 0.9::DOUBLE AS quality_score FROM devices WHERE up AND k % 3 = 0
  UNION ALL SELECT event_id, device_id, timestamp, 'unknown', k::DOUBLE, '', 1.0 FROM devices WHERE up AND k % 3 = 0
  UNION ALL SELECT event_id, device_id, timestamp, 'temperature', value, '°C', 1.0 FROM devices WHERE up AND k % 3 = 1
  UNION ALL SELECT event_id, device_id, timestamp, 'humidity', k::DOUBLE, '%', 1.0 FROM devices WHERE up AND k % 3 = 1
  UNION ALL SELECT event_id, device_id, timestamp, 'motion', 1.0, 'bool', 1.0 FROM devices WHERE up AND k % 3 = 2
  UNION ALL SELECT event_id, device_id, timestamp, 'pressure', value, 'hPa', 1.0 FROM devices WHERE up AND k % 3 = 2)"""
READ_COLS = "event_id, device_id, sensor_type, value, unit, quality_score, device_id || '_' || sensor_type AS sensor_id"
READ_LIST = ["event_id", "device_id", "sensor_type", "value", "unit", "quality_score", "sensor_id"]


@Q.add("flatten_device_payload", with_(DEVICES) + f"SELECT {READ_COLS} FROM readings")
def flatten_device_payload(spark, d):
    return payloads.flatten_device_payload(A.device_payloads(spark, d)).select(*READ_LIST)


@Q.add("sensor_export_range", with_(DEVICES) + f"SELECT {READ_COLS} FROM readings WHERE {IN_RANGE}")
def sensor_export_range(spark, d):
    from pulsegrid.functions.timewin import between

    polls = between(A.device_payloads(spark, d), START, END)
    return payloads.flatten_device_payload(polls).select(*READ_LIST)


@Q.add(
    "device_status_latest",
    with_(DEVICES)
    + """SELECT device_id, device_type, CASE WHEN up THEN 'online' ELSE 'offline' END AS status, timestamp AS last_seen,
  CASE WHEN up AND k % 3 = 1 THEN k::DOUBLE END AS battery_level, CAST(NULL AS DOUBLE) AS signal_strength, CAST(NULL AS VARCHAR) AS firmware_version
FROM (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY timestamp DESC, event_id DESC) AS rn FROM devices) WHERE rn = 1""",
)
def device_status_latest(spark, d):
    return payloads.device_status_latest(A.device_payloads(spark, d))


GPUS = f"""gpus AS (SELECT event_id, {HOST} AS source, ts AS timestamp, least(value, 100.0)::DOUBLE AS v, {K} AS k FROM events)"""


@Q.add(
    "flatten_gpu_payload",
    with_(GPUS)
    + """SELECT event_id, source, timestamp, 0 AS gpu_index, 'g0' AS name, CASE WHEN k % 5 = 1 THEN 0 ELSE v END AS utilization FROM gpus WHERE k % 5 <> 0
UNION ALL SELECT event_id, source, timestamp, 1, 'g1', k::DOUBLE FROM gpus WHERE k % 5 > 1""",
)
def flatten_gpu_payload(spark, d):
    return payloads.flatten_gpu_payload(A.gpu_payloads(spark, d))


@Q.add(
    "gpu_utilization",
    with_(GPUS)
    + """SELECT event_id, source, timestamp, 'gpu' AS metric_type, 'gpu_utilization' AS metric_name, CASE WHEN k % 5 <= 1 THEN 0 ELSE v END AS value FROM gpus""",
)
def gpu_utilization(spark, d):
    return payloads.gpu_utilization(A.gpu_payloads(spark, d))


@Q.add(
    "flatten_temperature_payload",
    f"""SELECT event_id, ts AS timestamp, 'coretemp' AS sensor_name, 'Core 0' AS label, value AS current_celsius, 80.0::DOUBLE AS high_celsius, 100.0::DOUBLE AS critical_celsius FROM events
UNION ALL SELECT event_id, ts, 'coretemp', 'Unknown', {K}::DOUBLE, NULL, NULL FROM events
UNION ALL SELECT event_id, ts, 'acpitz', 'Unknown', 20.5, NULL, NULL FROM events""",
)
def flatten_temperature_payload(spark, d):
    return payloads.flatten_temperature_payload(A.temperature_payloads(spark, d))


@Q.add(
    "battery_hours",
    f"SELECT event_id, ts AS timestamp, {K}::DOUBLE AS percent, {r(f'{K} * 100 / 3600.0')} AS time_remaining_hours FROM events",
)
def battery_hours(spark, d):
    return rounded(payloads.battery_hours(A.temperature_payloads(spark, d)))


