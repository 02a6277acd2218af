"""Telemetry tables built from the star-schema test tables.

Each function is a narrow projection (one join at most), so column pruning and filters
reach the parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of the test data set."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(col: Column, mapping: dict[str, object], default: object) -> Column:
    chain = None
    for key, out in mapping.items():
        cond = col == key
        chain = F.when(cond, F.lit(out)) if chain is None else chain.when(cond, F.lit(out))
    return chain.otherwise(F.lit(default))


def metrics_from_events(events: DataFrame, value: str | None = None) -> DataFrame:
    """Long metric table from an events table (batch or stream), with capped values by default."""
    kind = F.col("event_type")
    metric_type = _pick(
        kind,
        {"view": "cpu", "click": "memory", "purchase": "disk", "signup": "network"},
        "temperature",
    )
    metric_name = _pick(
        kind,
        {
            "view": "cpu_percent",
            "click": "memory_percent",
            "purchase": "disk_percent",
            "signup": "network_errors",
        },
        "temperature",
    )
    offset = _pick(kind, {"view": 40.0, "click": 55.0}, 0.0)
    return events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("timestamp"),
        metric_type.alias("metric_type"),
        metric_name.alias("metric_name"),
        (F.col(value) if value else F.least(F.col("value") + offset, F.lit(100.0))).alias("value"),
        F.col("props").alias("metadata"),
        F.concat(F.lit("host_"), (F.col("user_id") % 4).cast("string")).alias("source"),
        F.array("event_type").alias("tags"),
    )


def raw_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long metric table with the uncapped values, whose tails hold outliers."""
    events = table(spark, sf_dir, "events")
    return metrics_from_events(events, "value")


def metrics_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics_from_events(table(spark, sf_dir, "events"))


def system_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    severity = (
        F.when((F.col("event_type") == "error") & (F.col("value") > 150), "critical")
        .when(F.col("event_type") == "error", "error")
        .when(F.col("event_type") == "purchase", "warning")
        .otherwise("info")
    )
    return e.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("timestamp"),
        "event_type",
        severity.alias("severity"),
        F.concat(F.lit("host_"), (F.col("user_id") % 4).cast("string")).alias("source"),
        F.concat(F.lit("event "), F.col("event_type")).alias("title"),
        ((F.get_json_object("props", "$.k").cast("int") % 2) == 0).alias("resolved"),
        F.floor(F.least(F.col("value"), F.lit(100.0))).cast("int").alias("impact_score"),
        F.array("event_type").alias("tags"),
        F.array(F.lit("cpu_percent")).alias("related_metrics"),
    )


def process_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return li.join(part, li.l_partkey == part.p_partkey).select(
        F.col("l_shipdate").cast("timestamp").alias("timestamp"),
        F.col("l_partkey").alias("pid"),
        F.col("p_brand").alias("name"),
        (F.col("l_discount") * 1000).alias("cpu_percent"),
        (F.col("l_tax") * 1000).alias("memory_percent"),
        F.col("l_extendedprice").alias("memory_rss"),
        F.concat(F.lit("u"), (F.col("l_suppkey") % 5).cast("string")).alias("username"),
        F.col("l_linestatus").alias("status"),
        F.floor(F.col("l_partkey") / 2).alias("parent_pid"),
        "l_orderkey",
        "l_linenumber",
        "l_suppkey",
    )


def processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per process: a binary tree over the part keys."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("pid"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("status"),
        F.expr("p_partkey div 2").alias("parent_pid"),
    )


def snapshots_from_events(events: DataFrame) -> DataFrame:
    """JSON snapshot table; every tenth payload of key 7 is broken, disk keys vary."""
    # A column of its own, so that the key is parsed once per row.
    events = events.withColumn("_k", F.get_json_object("props", "$.k").cast("int"))
    v, k, kind = F.col("value").cast("string"), F.col("_k"), F.col("event_type")
    usage = F.least(F.col("value"), F.lit(100.0)).cast("string")
    body = (
        F.when(k == 7, F.lit("{broken"))
        .when((kind == "view") & (k == 8), F.lit("{}"))
        .when(kind == "view", F.concat(F.lit('{"usage_percent": '), usage, F.lit("}")))
        .when(
            kind == "click",
            F.concat(
                F.lit('{"usage_percent": '),
                usage,
                F.lit(', "total": 17179869184, "swap": {"usage_percent": '),
                (k.cast("double")).cast("string"),
                F.lit("}}"),
            ),
        )
        .when(
            (kind == "purchase") & (k % 3 == 0),
            F.concat(F.lit('{"usage_percent": '), usage, F.lit("}")),
        )
        .when(
            kind == "purchase",
            F.concat(F.lit('{"total_usage_percent": '), usage, F.lit("}")),
        )
        .when(
            (kind == "signup") & (k % 3 == 0),
            F.concat(F.lit('{"recv_rate_kbps": '), v, F.lit("}")),
        )
        .when(
            kind == "signup",
            F.concat(
                F.lit('{"sent_rate_kbps": '),
                v,
                F.lit(', "recv_rate_kbps": '),
                k.cast("double").cast("string"),
                F.lit("}"),
            ),
        )
    )
    metric_type = _pick(
        kind, {"view": "cpu", "click": "memory", "purchase": "disk"}, "network"
    )
    return events.filter(kind != "error").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("timestamp"),
        metric_type.alias("metric_type"),
        body.alias("data"),
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots_from_events(table(spark, sf_dir, "events"))


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monotone byte and packet counters per host, one row per event."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        F.concat(F.lit("host_"), (F.col("user_id") % 4).cast("string")).alias("source"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        (F.col("event_id") * 4096 + F.floor(F.col("value"))).alias("bytes_sent"),
        (F.col("event_id") * 8192 + F.floor(F.col("value"))).alias("bytes_recv"),
        (F.col("event_id") * 3).alias("packets_sent"),
        (F.col("event_id") * 5).alias("packets_recv"),
    )


def connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open connections per snapshot day."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_shipdate").cast("timestamp").alias("timestamp"),
        F.concat_ws("_", "l_returnflag", "l_linestatus").alias("status"),
        F.when(F.col("l_suppkey") % 3 == 0, "AF_INET")
        .when(F.col("l_suppkey") % 3 == 1, "AF_INET6")
        .otherwise("AF_UNIX")
        .alias("family"),
        F.when(F.col("l_linenumber") % 3 == 0, "SOCK_STREAM")
        .when(F.col("l_linenumber") % 3 == 1, "SOCK_DGRAM")
        .otherwise("SOCK_RAW")
        .alias("type"),
        (F.col("l_suppkey") % 50 + 8000).cast("int").alias("local_port"),
        F.col("l_partkey").alias("pid"),
    )


def running_processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processes still known when connections are read: those of one type are gone."""
    return processes(spark, sf_dir).filter(F.col("status") != "SMALL")


def call_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("call_id"),
        F.col("o_orderpriority").alias("function"),
        (F.col("o_totalprice") / 1e5).alias("execution_time"),
        (F.col("o_orderstatus") != "F").alias("success"),
        F.col("o_orderdate").cast("timestamp").alias("timestamp"),
    )


def stream_events_from(events: DataFrame) -> DataFrame:
    """Typed stream events with processing latency."""
    kind = F.col("event_type")
    routed = _pick(kind, {"signup": "sensor_reading", "error": "anomaly_detected"}, "system_metric")
    return events.select(
        "event_id",
        routed.alias("event_type"),
        F.concat(F.lit("host_"), (F.col("user_id") % 4).cast("string")).alias("source"),
        _pick(
            kind,
            {"view": "cpu", "click": "memory", "purchase": "disk", "signup": "network"},
            "temperature",
        ).alias("metric_type"),
        F.least(
            F.col("value") + _pick(kind, {"view": 40.0, "click": 55.0}, 0.0), F.lit(100.0)
        ).alias("value"),
        F.when(F.col("value") > 80, "critical").otherwise("warning").alias("severity"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        (F.col("value") - 1.0).alias("processing_latency_ms"),
    )


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_events_from(table(spark, sf_dir, "events"))


def stream_messages_from(events: DataFrame) -> DataFrame:
    """Messages of a named stream with a string map payload and a priority."""
    events = events.withColumn("_k", F.get_json_object("props", "$.k").cast("int"))
    k = F.col("_k")
    return events.select(
        "event_id",
        F.concat(F.lit("host_"), (F.col("user_id") % 4).cast("string")).alias("stream_name"),
        F.col("event_type").alias("message_type"),
        F.create_map(
            F.lit("kind"),
            F.col("event_type"),
            F.lit("level"),
            (k % 3).cast("string"),
            F.lit("zone"),
            (k % 2).cast("string"),
        ).alias("data"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        (k % 4 + 1).cast("int").alias("priority"),
    )


def stream_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_messages_from(table(spark, sf_dir, "events"))


def device_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw device JSON: sensor lists, flat records and offline polls."""
    e = table(spark, sf_dir, "events")
    v = F.col("value").cast("string")
    k = F.get_json_object("props", "$.k").cast("int")
    payload = (
        F.when(
            k % 3 == 0,
            F.concat(
                F.lit('{"sensors": [{"type": "temperature", "value": '),
                v,
                F.lit(', "unit": "C", "quality": 0.9}, {"value": '),
                k.cast("string"),
                F.lit("}]}"),
            ),
        )
        .when(
            k % 3 == 1,
            F.concat(
                F.lit('{"temperature": '),
                v,
                F.lit(', "humidity": '),
                k.cast("string"),
                F.lit(', "battery_level": '),
                k.cast("string"),
                F.lit(', "vendor": "x"}'),
            ),
        )
        .otherwise(F.concat(F.lit('{"motion": 1, "pressure": '), v, F.lit("}")))
    )
    return e.select(
        "event_id",
        F.concat(F.lit("dev_"), (F.col("user_id") % 25).cast("string")).alias("device_id"),
        F.lit("sensor_hub").alias("device_type"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.when(F.col("event_type") == "error", F.lit(None)).otherwise(payload).alias("payload"),
    )


def gpu_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    v = F.least(F.col("value"), F.lit(100.0)).cast("string")
    k = F.get_json_object("props", "$.k").cast("int")
    body = (
        F.when(k % 5 == 0, F.lit('{"gpus": [], "total_gpus": 0}'))
        .when(
            k % 5 == 1,
            F.lit('{"gpus": [{"name": "g0"}], "total_gpus": 1}'),
        )
        .otherwise(
            F.concat(
                F.lit('{"gpus": [{"name": "g0", "utilization": '),
                v,
                F.lit('}, {"name": "g1", "utilization": '),
                k.cast("double").cast("string"),
                F.lit('}], "total_gpus": 2}'),
            )
        )
    )
    return e.select(
        "event_id",
        F.concat(F.lit("host_"), (F.col("user_id") % 4).cast("string")).alias("source"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        body.alias("payload"),
    )


def temperature_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    v = F.col("value").cast("string")
    k = F.get_json_object("props", "$.k").cast("int").cast("string")
    body = F.concat(
        F.lit('{"sensors": {"coretemp": [{"label": "Core 0", "current_celsius": '),
        v,
        F.lit(', "high_celsius": 80.0, "critical_celsius": 100.0}, {"current_celsius": '),
        k,
        F.lit(".0}], "),
        F.lit('"acpitz": [{"label": "", "current_celsius": 20.5}]}, '),
        F.lit('"battery": {"percent": '),
        k,
        F.lit(', "secsleft": '),
        (k.cast("int") * 100).cast("string"),
        F.lit("}}"),
    )
    return e.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("timestamp"),
        body.alias("payload"),
    )


def raw_processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Process records as JSON text, with malformed and partial ones."""
    li = table(spark, sf_dir, "lineitem")
    pid = F.when(F.col("l_partkey") % 11 == 0, F.lit('"invalid"')).otherwise(
        F.col("l_partkey").cast("string")
    )
    cpu = (
        F.when(F.col("l_linenumber") == 6, F.lit(', "cpu_percent": null'))
        .when(F.col("l_linenumber") == 7, F.lit(""))
        .otherwise(F.concat(F.lit(', "cpu_percent": '), (F.col("l_discount") * 1000).cast("string")))
    )
    record = F.concat(
        F.lit('{"pid": '),
        pid,
        F.lit(', "name": "p'),
        (F.col("l_suppkey") % 9).cast("string"),
        F.lit('"'),
        cpu,
        F.lit(', "memory_mb": "'),
        F.col("l_quantity").cast("string"),
        F.lit('", "status": "'),
        F.col("l_linestatus"),
        F.lit('"}'),
    )
    return li.select(F.col("l_shipdate").cast("timestamp").alias("timestamp"), record.alias("record"))


def alert_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert actions: each error event triggers, some are acknowledged or resolved later."""
    e = table(spark, sf_dir, "events").filter(F.col("event_type") == "error")
    k = F.get_json_object("props", "$.k").cast("int")
    steps = F.array(
        F.struct(F.lit("trigger").alias("action"), F.lit(0).alias("minutes"), F.lit(True).alias("on")),
        F.struct(F.lit("acknowledge").alias("action"), F.lit(5).alias("minutes"), (k % 2 == 0).alias("on")),
        F.struct(F.lit("resolve").alias("action"), F.lit(30).alias("minutes"), (k % 3 == 0).alias("on")),
    )
    rows = e.select(
        F.concat(F.lit("alert-"), F.col("event_id").cast("string")).alias("alert_id"),
        F.lit("temperature").alias("metric_name"),
        F.col("value"),
        F.when(F.col("value") > 85, "critical")
        .when(F.col("value") > 40, "warning")
        .otherwise("info")
        .alias("severity"),
        F.concat(F.lit("host_"), (F.col("user_id") % 4).cast("string")).alias("source"),
        F.concat(F.lit("user_"), (F.col("user_id") % 3).cast("string")).alias("actor"),
        F.col("ts").cast("timestamp").alias("_ts"),
        F.explode(steps).alias("step"),
    ).filter("step.on")
    at = F.col("_ts") + F.make_interval(mins=F.col("step.minutes"))
    return rows.select(
        "alert_id", "metric_name", "value", "severity", "source", "actor",
        F.col("step.action").alias("action"), at.alias("timestamp"),
    )


def anomaly_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected anomalies: capped metric values above 50 as scores in 0..1."""
    m = metrics_long(spark, sf_dir).filter(F.col("value") > 50)
    return m.select(
        "event_id", "timestamp", "metric_name", "value", (F.col("value") / 100).alias("anomaly_score")
    )


def prediction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored model predictions per metric type and horizon."""
    k = F.get_json_object("metadata", "$.k").cast("int")
    m = metrics_long(spark, sf_dir)
    return m.select(
        "event_id",
        "metric_type",
        F.element_at(F.array(*[F.lit(h) for h in (5, 15, 30, 60)]), (k % 4) + 1).alias(
            "horizon_minutes"
        ),
        F.col("value").alias("predicted_value"),
        (F.col("value") / 200 + 0.4).alias("accuracy"),
        "timestamp",
    )


def result_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processor runs: processor, events in the run, time taken, error flag."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("event_id").alias("result_id"),
        _pick(
            F.col("event_type"),
            {"signup": "performance_calculator", "error": "alert_generator"},
            "system_aggregator",
        ).alias("processor_name"),
        (k % 10 + 1).alias("input_events"),
        F.col("value").alias("processing_time_ms"),
        (k == 13).alias("failed"),
        F.col("ts").cast("timestamp").alias("timestamp"),
    )


def cpu_memory_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per tick and host with all resource percentages."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int").cast("double")
    v = F.least(F.col("value") + 30.0, F.lit(140.0))
    return e.select(
        F.col("event_id").alias("tick_id"),
        F.concat(F.lit("host_"), (F.col("user_id") % 4).cast("string")).alias("host"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        v.alias("cpu_percent"),
        k.alias("memory_percent"),
        (100.0 - k / 4).alias("disk_percent"),
        (k * 0.7).alias("swap_percent"),
        (F.col("value") * 3).alias("db_latency_ms"),
        (F.col("user_id") % 3).cast("int").alias("volume"),
    )


def ping_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text output of ping runs; some runs have no reply."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int").cast("string")
    head = F.concat(F.lit("PING host_"), (F.col("user_id") % 4).cast("string"), F.lit(" 56 bytes\n"))
    reply = F.concat(
        F.lit("64 bytes from host: icmp_seq=1 ttl=64 time="),
        F.col("value").cast("string"),
        F.lit(" ms\n64 bytes from host: icmp_seq=2 ttl=64 time="),
        k,
        F.lit(".5ms\n64 bytes from host: icmp_seq=3 ttl=64 time=bad ms\n"),
    )
    none = F.lit("Request timeout for icmp_seq 1\n")
    return e.select(
        F.col("event_id").alias("run_id"),
        F.concat(F.lit("host_"), (F.col("user_id") % 4).cast("string")).alias("host"),
        F.concat(head, F.when(F.col("event_type") == "error", none).otherwise(reply)).alias("output"),
    )


def ci_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CI command outputs built from whole document texts."""
    d = table(spark, sf_dir, "documents")
    n = F.col("doc_id")
    kind = n % 6
    text = F.col("text")
    body = (
        F.when(kind == 0, F.concat(text, F.lit("\nTOTAL 100 25 "), (n % 101).cast("string"), F.lit("%\n")))
        .when(
            kind == 1,
            F.concat(text, F.lit("\nYour code has been rated at "), (n % 10).cast("string"), F.lit(".50/10\n")),
        )
        .when(kind == 2, F.concat(F.lit("a.py:1:1: E501 long\n\n"), text))
        .when(
            kind == 3,
            F.concat(
                F.lit("== "), (n % 90).cast("string"), F.lit(" passed, "), (n % 4).cast("string"),
                F.lit(" failed, "), (n % 3).cast("string"), F.lit(" skipped in 2s =="),
            ),
        )
        .when(
            kind == 4,
            F.concat(
                F.lit('{"results": [{"issue_severity": "HIGH"}, {"issue_severity": "LOW"}], "n": '),
                n.cast("string"), F.lit("}"),
            ),
        )
        .otherwise(F.concat(F.lit("{not json\n"), text, F.lit("\n>> Issue: weak hash\nHIGH: fix it\n")))
    )
    command = (
        F.when(kind == 0, "coverage report")
        .when(kind == 1, "pylint src")
        .when(kind == 2, "flake8 src")
        .when(kind == 3, "pytest tests")
        .when(kind == 4, "bandit -r src -f json")
        .otherwise("bandit -r src")
    )
    return d.select(
        (n % 40).alias("run_id"), F.col("doc_id").alias("step_id"), command.alias("command"), body.alias("stdout")
    )
