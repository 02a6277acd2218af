"""Health scores, status folds and view-like summaries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.columns import above, at_least, health_status, tiers
from pulsegrid.functions.timewin import trailing

# Recommendation texts by resource.
HEALTH_ADVICE = {
    "cpu": "Consider optimizing CPU-intensive processes",
    "memory": "Review memory usage and consider increasing available memory or optimizing usage",
    "disk": "Clean up disk space or add storage capacity",
}
MANY_ALERTS_ADVICE = "Multiple performance issues detected - perform a comprehensive systems review"

# Weights of the overall health score, and the two constant parts.
HEALTH_WEIGHTS = {"cpu": 0.25, "memory": 0.25, "disk": 0.20, "network": 0.15, "database": 0.15}
NETWORK_HEALTH, DATABASE_HEALTH = 0.9, 0.95

# Fixed values: (warning, critical) bounds of the diagnostic checks.
DIAGNOSTIC_BOUNDS = {"cpu": (80.0, 95.0), "memory": (80.0, 95.0), "disk": (85.0, 95.0), "database": (100.0, 500.0)}

# Diagnostic advice by status and check.
DIAGNOSTIC_ADVICE = {
    ("critical", "cpu"): "CRITICAL: Add CPU resources or optimize high-load applications immediately.",
    ("critical", "memory"): "CRITICAL: Increase system memory or identify and fix memory leaks.",
    ("critical", "disk"): "CRITICAL: Free up disk space urgently or add more storage.",
    ("critical", "database"): "CRITICAL: Optimize slow database queries and check connection pool health.",
    ("warning", "cpu"): "WARNING: Monitor CPU usage trends and identify processes causing high load.",
    ("warning", "memory"): "WARNING: Monitor memory usage closely and consider optimizing application memory footprints.",
    ("warning", "disk"): "WARNING: Plan for additional storage capacity or archive old data.",
}

# Fixed values: (critical, warning) bounds of the resource status.
RESOURCE_BOUNDS = {"cpu": (90, 75), "memory": (90, 80), "disk": (95, 85)}


def metric_health(metrics: DataFrame, hours: float = 1, as_of: datetime | None = None) -> DataFrame:
    """Score, status and alert text of every metric of the last hours."""
    avg = F.col("avg_value")
    resource = F.col("metric_type").isin("cpu", "memory", "disk")
    score = F.when(resource, above(avg, [(90, 0), (80, 30), (70, 60), (50, 80)], 100)).otherwise(80)
    level = F.when(avg > 90, "Critical").when(avg > 80, "High")
    alert = F.when(
        resource & level.isNotNull(),
        F.format_string("%s %s usage: %.1f%%", level, F.col("metric_type"), avg),
    )
    return (
        trailing(metrics, hours, as_of)
        .groupBy("metric_type", "metric_name")
        .agg(
            F.avg("value").alias("avg_value"),
            F.min("value").alias("min_value"),
            F.max("value").alias("max_value"),
            F.count("*").alias("sample_count"),
        )
        .withColumn("score", score)
        .withColumn("status", health_status(F.col("score")))
        .withColumn("alert", alert)
    )


def overall_health(scored: DataFrame) -> DataFrame:
    """Mean score over all metrics to one decimal, its status and the number of alerts."""
    mean = F.avg("score")
    return scored.agg(
        F.round(mean, 1).alias("overall_health_score"),
        health_status(mean).alias("overall_status"),
        F.count("alert").alias("alert_count"),
    )


def health_recommendations(scored: DataFrame) -> DataFrame:
    """One advice row per metric below 50, and one more when over three alerts fire.

    A metric is matched by its type and name together, cpu before memory before disk.
    """
    label = F.concat_ws("_", "metric_type", "metric_name")
    advice = tiers(label, [(label.contains(k), text) for k, text in HEALTH_ADVICE.items()], None)
    single = scored.filter(F.col("score") < 50).select(label.alias("metric"), advice.alias("recommendation"))
    many = (
        scored.agg(F.count("alert").alias("n"))
        .filter("n > 3")
        .select(F.lit("all").alias("metric"), F.lit(MANY_ALERTS_ADVICE).alias("recommendation"))
    )
    return single.filter(F.col("recommendation").isNotNull()).unionByName(many)


def health_summary_view(metrics: DataFrame, hours: float = 1, as_of: datetime | None = None) -> DataFrame:
    return (
        trailing(metrics, hours, as_of)
        .groupBy("metric_type")
        .agg(
            F.count("*").alias("sample_count"),
            F.avg("value").alias("avg_value"),
            F.min("value").alias("min_value"),
            F.max("value").alias("max_value"),
        )
    )


def top_resource_consumers(
    processes: DataFrame, hours: float = 1, min_samples: int = 5, as_of: datetime | None = None
) -> DataFrame:
    """Average load and peak memory per process with more than ``min_samples`` rows, busiest first."""
    return (
        trailing(processes, hours, as_of)
        .groupBy("name", "pid")
        .agg(
            F.avg("cpu_percent").alias("avg_cpu"),
            F.avg("memory_percent").alias("avg_memory"),
            F.max("memory_rss").alias("peak_memory_rss"),
            F.count("*").alias("sample_count"),
        )
        .filter(F.col("sample_count") > min_samples)
        .orderBy(F.col("avg_cpu").desc(), F.col("avg_memory").desc())
    )


def events_summary(events: DataFrame, hours: float = 24, as_of: datetime | None = None) -> DataFrame:
    """Counts, resolved counts, mean impact and latest time per type and severity."""
    return (
        trailing(events, hours, as_of)
        .groupBy("event_type", "severity")
        .agg(
            F.count("*").alias("event_count"),
            F.count_if("resolved").alias("resolved_count"),
            F.avg("impact_score").alias("avg_impact_score"),
            F.max("timestamp").alias("latest_event"),
        )
        .orderBy(F.col("avg_impact_score").desc(), F.col("event_count").desc())
    )


def weighted_system_health(ticks: DataFrame) -> DataFrame:
    """Per tick: health of each resource and the weighted overall score."""

    def part(col: str) -> Column:
        return F.greatest(F.lit(0.0), 1 - F.col(col) / 100)

    w = HEALTH_WEIGHTS
    overall = (
        F.col("cpu_health") * w["cpu"]
        + F.col("memory_health") * w["memory"]
        + F.col("disk_health") * w["disk"]
        + w["network"] * NETWORK_HEALTH
        + w["database"] * DATABASE_HEALTH
    )
    return (
        ticks.withColumn("cpu_health", part("cpu_percent"))
        .withColumn("memory_health", part("memory_percent"))
        .withColumn("disk_health", part("disk_percent"))
        .withColumn("overall_score", overall)
    )


def database_health_score(stats: DataFrame) -> DataFrame:
    """1 minus 0.1 for size > 1000 MB, 0.2 for slow queries, 0.1 for a full pool; at least 0."""
    score = (
        1.0
        - F.when(F.col("db_size_mb") > 1000, 0.1).otherwise(0.0)
        - F.when(F.col("avg_query_time") > 100, 0.2).otherwise(0.0)
        - F.when(F.col("connection_pool_usage") > 0.8, 0.1).otherwise(0.0)
    )
    return stats.withColumn("health_score", F.greatest(F.lit(0.0), score))


def diagnostic_checks(ticks: DataFrame) -> DataFrame:
    """Status and score of cpu, memory, disk and database checks per host.

    cpu is judged on its peak and scored on its mean; memory, swap and database latency on the
    mean of the samples; disk per volume.
    """
    per_host = ticks.groupBy("host").agg(
        F.max("cpu_percent").alias("cpu_peak"),
        F.avg("cpu_percent").alias("cpu"),
        F.avg("memory_percent").alias("memory"),
        F.avg("swap_percent").alias("swap"),
        F.avg("db_latency_ms").alias("database"),
    )

    def check(name: str, label: Column, judged: Column, measure: Column, floor: float | None = None) -> Column:
        warn, crit = DIAGNOSTIC_BOUNDS[name]
        healthy = 1.0 - measure / 100
        if floor is not None:
            healthy = F.greatest(F.lit(floor), healthy)
        status = at_least(judged, [(crit, "critical"), (warn, "warning")], "healthy")
        score = F.when(judged >= crit, 0.0).when(judged >= warn, 0.5).otherwise(healthy)
        if name == "memory":
            swapping = F.col("swap") > 50
            status = F.when(swapping, "warning").otherwise(status)
            score = F.when(swapping, F.least(score, F.lit(0.3))).otherwise(score)
        return F.struct(label.alias("check"), measure.alias("measure"), status.alias("status"), score.alias("score"))

    hosts = per_host.select(
        "host",
        F.inline(
            F.array(
                check("cpu", F.lit("cpu_health"), F.col("cpu_peak"), F.col("cpu")),
                check("memory", F.lit("memory_health"), F.col("memory"), F.col("memory")),
                check("database", F.lit("database_health"), F.col("database"), F.col("database"), 0.1),
            )
        ),
    )
    volumes = ticks.groupBy("host", "volume").agg(F.avg("disk_percent").alias("disk"))
    label = F.concat(F.lit("disk_health_"), F.col("volume").cast("string"))
    disks = volumes.select("host", F.inline(F.array(check("disk", label, F.col("disk"), F.col("disk")))))
    return hosts.unionByName(disks)


def diagnostics_overall(checks: DataFrame) -> DataFrame:
    """Mean score, its status and the distinct sorted advice per host."""
    name, status = F.col("check"), F.col("status")
    steps = [((status == s) & name.contains(c), text) for (s, c), text in DIAGNOSTIC_ADVICE.items()]
    return (
        checks.withColumn("advice", tiers(name, steps, None))
        .groupBy("host")
        .agg(F.avg("score").alias("overall_score"), F.sort_array(F.collect_set("advice")).alias("recommendations"))
        .withColumn(
            "overall_health", at_least(F.col("overall_score"), [(0.8, "healthy"), (0.6, "warning")], "critical")
        )
    )


def freshness_check(metrics: DataFrame, hours: float = 1, as_of: datetime | None = None) -> DataFrame:
    """Rows of the last hours per known metric: none and fewer than ten are warnings."""
    from pulsegrid.functions.timewin import latest

    as_of = as_of or latest(metrics)
    recent = F.col("timestamp") >= F.lit(as_of) - F.make_interval(mins=F.lit(int(hours * 60)))
    n = F.col("recent_metrics_count")
    return (
        metrics.filter(F.col("timestamp") <= F.lit(as_of))
        .groupBy("metric_name")
        .agg(
            F.count_if(recent).alias("recent_metrics_count"),
            F.max("timestamp").alias("last_metric_time"),
        )
        .withColumn("status", F.when(n < 10, "warning").otherwise("healthy"))
        .withColumn(
            "message",
            F.when(n == 0, "No recent metrics found")
            .when(n < 10, "Low metric collection rate")
            .otherwise("Metrics collection normal"),
        )
    )


def resource_status(ticks: DataFrame) -> DataFrame:
    """critical / warning / healthy for cpu, memory and disk of each tick."""
    for name, (crit, warn) in RESOURCE_BOUNDS.items():
        ticks = ticks.withColumn(
            f"{name}_status",
            above(F.col(f"{name}_percent"), [(crit, "critical"), (warn, "warning")], "healthy"),
        )
    return ticks


def overall_status_fold(checks: DataFrame, key: str = "host") -> DataFrame:
    """Worst status wins; names of unhealthy and of warning checks, count of the healthy ones."""
    status = F.col("status")
    bad, warn = status == "unhealthy", status.isin("warning", "critical")
    return checks.groupBy(key).agg(
        F.when(F.bool_or(bad), "unhealthy").when(F.bool_or(warn), "warning").otherwise("healthy").alias(
            "overall_status"
        ),
        F.sort_array(F.collect_set(F.when(bad, F.col("check")))).alias("unhealthy_checks"),
        F.sort_array(F.collect_set(F.when(warn, F.col("check")))).alias("warning_checks"),
        F.count_if(~bad & ~warn).alias("healthy_checks"),
    )


def resource_distribution(ticks: DataFrame) -> DataFrame:
    """Free share beside the busiest resource, and network traffic scaled to at most 100."""
    return ticks.withColumn(
        "available", 100 - F.greatest("cpu_percent", "memory_percent", "disk_percent")
    ).withColumn(
        "network_scaled", F.least((F.col("sent_kbps") + F.col("recv_kbps")) / 10, F.lit(100.0))
    )
