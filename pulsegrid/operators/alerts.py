"""Alert rules, cooldown, lifecycle and statistics."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions.columns import compare
from pulsegrid.functions.timewin import trailing
from pulsegrid.operators.cooldown import BLOCK_ROWS, fire

# Name, metric, condition, threshold, severity, cooldown minutes.
DEFAULT_RULES = [
    ("high_cpu", "cpu_percent", ">", 80.0, "warning", 5),
    ("critical_cpu", "cpu_percent", ">", 95.0, "critical", 2),
    ("high_memory", "memory_percent", ">", 85.0, "warning", 5),
    ("critical_memory", "memory_percent", ">", 95.0, "critical", 2),
    ("high_disk", "disk_percent", ">", 90.0, "warning", 10),
    ("critical_disk", "disk_percent", ">", 98.0, "critical", 5),
    ("high_temperature", "temperature", ">", 75.0, "warning", 5),
    ("critical_temperature", "temperature", ">", 85.0, "critical", 2),
]


def rule_table(spark: SparkSession, rules: Sequence[tuple] = DEFAULT_RULES) -> DataFrame:
    """Rules as an inline table: its size is known to the optimizer, so it is broadcast."""
    rows = ", ".join(
        f"('{n}', '{m}', '{c}', {float(t)}D, '{s}', {int(cd)}, {str(en[0]).lower() if en else 'true'})"
        for n, m, c, t, s, cd, *en in rules
    )
    return spark.sql(
        f"SELECT * FROM VALUES {rows} AS t(rule, metric_name, condition, threshold, severity, cooldown_minutes, enabled)"
    )


def rule_predicate(rows: DataFrame) -> DataFrame:
    """Flag rows that carry a value, a rule's condition and threshold: disabled never fires."""
    hit = compare(F.col("value"), F.col("condition"), F.col("threshold"))
    return rows.withColumn("fires", F.col("enabled") & F.coalesce(hit, F.lit(False)))


def rule_match(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """Each breach of each enabled rule as an alert row (batch or stream)."""
    joined = metrics.join(rules.filter("enabled"), "metric_name")
    hit = compare(F.col("value"), F.col("condition"), F.col("threshold"))
    message = F.concat(
        F.col("metric_name"), F.lit(" is "), F.col("value").cast("string"), F.lit(" (threshold: "),
        F.col("condition"), F.lit(" "), F.col("threshold").cast("string"), F.lit(")"),
    )
    return joined.filter(hit).withColumn("message", message)


def alert_cooldown(
    breaches: DataFrame,
    keys: Sequence[str] = ("rule", "source"),
    order: Sequence[str] = ("timestamp", "event_id"),
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Breaches that fire: the first of each series, then the first at least a cooldown later.

    ``keys=("rule",)`` shares the cooldown over all sources. ``order`` begins with the time.
    """
    return fire(breaches, keys, order, "cooldown_minutes", block_rows)


def alert_lifecycle(log: DataFrame) -> DataFrame:
    """Current state of each alert from its trigger, acknowledge and resolve actions.

    Actions belong together by ``alert_id`` alone; the alert's attributes are those of its first
    trigger row. An acknowledgement after the alert is resolved has no effect.
    """
    action, ts = F.col("action"), F.col("timestamp")
    attributes = ["metric_name", "value", "severity", "source"]
    ends = log.filter(action == "resolve").groupBy("alert_id").agg(F.min("timestamp").alias("resolved_at"))
    open_log = log.join(ends, "alert_id", "left").filter(
        (action == "trigger") | F.col("resolved_at").isNull() | (ts <= F.col("resolved_at"))
    )
    ack = F.when(action == "acknowledge", ts)
    return (
        open_log.groupBy("alert_id")
        .agg(
            F.min(F.when(action == "trigger", F.struct(ts, *attributes))).alias("_first"),
            F.max(ack).alias("acknowledged_at"),
            F.max_by(F.col("actor"), ack).alias("acknowledged_by"),
            F.max("resolved_at").alias("resolved_at"),
        )
        .filter(F.col("_first").isNotNull())
        .select(
            "alert_id", *[f"_first.{c}" for c in [*attributes, "timestamp"]],
            "acknowledged_at", "acknowledged_by", "resolved_at",
        )
        .withColumn("acknowledged", F.col("acknowledged_at").isNotNull())
        .withColumn("resolved", F.col("resolved_at").isNotNull())
    )


def alert_statistics(alerts: DataFrame) -> DataFrame:
    """Counts in all, by severity, by metric and of unresolved alerts."""
    grouped = alerts.groupingSets(
        [[], [F.col("severity")], [F.col("metric_name")]], F.col("severity"), F.col("metric_name")
    ).agg(
        F.count("*").alias("alerts"),
        F.count_if(~F.col("resolved")).alias("active"),
        F.grouping_id().alias("_gid"),
    )
    kind = F.when(F.col("_gid") == 3, "total").when(F.col("_gid") == 1, "severity").otherwise("metric")
    label = F.coalesce("severity", "metric_name", F.lit("all"))
    return grouped.select(kind.alias("kind"), label.alias("name"), "alerts", "active")


def active_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.filter(~F.col("resolved"))


def alert_history(alerts: DataFrame, hours: float = 24, as_of: datetime | None = None) -> DataFrame:
    return trailing(alerts, hours, as_of)


def anomaly_to_alert(events: DataFrame) -> DataFrame:
    """Alert rows from anomaly events (batch or stream)."""
    metric = F.coalesce(F.col("metric_type"), F.lit("unknown"))
    value = F.coalesce(F.col("value"), F.lit(0.0))
    return events.filter(F.col("event_type") == "anomaly_detected").select(
        F.concat_ws("_", F.lit("alert"), F.unix_millis("timestamp").cast("string"), metric).alias("alert_id"),
        F.lit("anomaly").alias("type"),
        F.coalesce(F.col("severity"), F.lit("info")).alias("severity"),
        F.concat(F.upper(metric), F.lit(" anomaly detected: "), value.cast("string")).alias("message"),
        metric.alias("metric_type"),
        value.alias("value"),
        "timestamp",
        F.col("event_id").alias("source_event"),
    )


def escalated(alerts: DataFrame, resource: str = "metric_name") -> DataFrame:
    """Alert level and text of scored anomalies: critical above 0.9."""
    score = F.col("anomaly_score")
    return alerts.withColumn("level", F.when(score > 0.9, "critical").otherwise("warning")).withColumn(
        "message",
        F.concat(
            F.lit("Anomaly detected in "), F.col(resource), F.format_string(": %.2f%%", F.col("value"))
        ),
    )
