"""Business KPIs and the executive dashboard."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.columns import above, clamp
from pulsegrid.functions.timewin import latest, trailing

# KPI name -> (target, warning, critical, unit, lower is better).
KPIS = {
    "system_availability": (99.9, 99.0, 98.0, "percent", False),
    "average_response_time": (1.0, 2.0, 5.0, "seconds", True),
    "cpu_efficiency": (70.0, 85.0, 95.0, "percent", True),
    "memory_efficiency": (75.0, 85.0, 95.0, "percent", True),
    "error_rate": (0.0, 5.0, 20.0, "errors/hour", True),
    "capacity_utilization": (60.0, 80.0, 90.0, "percent", True),
}

# Share of each resource in the capacity KPI.
CAPACITY_WEIGHTS = {"cpu": 0.4, "memory": 0.3, "disk": 0.3}

# Points per status, and the points of any other status.
STATUS_POINTS = {"excellent": 100, "good": 80, "warning": 50, "critical": 20}
OTHER_POINTS = 50

# Executive advice by KPI and status, and the overall ones.
EXECUTIVE_ADVICE = {
    ("system_availability", "critical"): "URGENT: System availability is below acceptable levels. Investigate service interruptions.",
    ("cpu_efficiency", "critical"): "CPU resources are critically overutilized - consider scaling up or optimizing workloads.",
    ("memory_efficiency", "critical"): "Memory resources are critically low - immediate action required to prevent system crashes.",
    ("error_rate", "critical"): "System error rate is critically high - investigate root cause and deploy fixes.",
    ("capacity_utilization", "warning"): "Resource utilization approaching limits - plan for future capacity increases.",
    ("average_response_time", "warning"): "System response times are elevated - performance optimization is recommended.",
}
MANY_CRITICAL = "Multiple critical issues detected - comprehensive system review is required immediately."
DEGRADING = "System health degrading - proactive maintenance recommended to prevent further issues."


def kpi_status(value: Column, kpi: str) -> Column:
    """excellent / good / warning / critical against the KPI's three bounds."""
    target, warning, critical, _, inverse = KPIS[kpi]

    def ok(bound: float) -> Column:
        return value <= bound if inverse else value >= bound

    return (
        F.when(ok(target), "excellent")
        .when(ok(warning), "good")
        .when(ok(critical), "warning")
        .otherwise("critical")
    )


def _errors() -> Column:
    return F.count_if(F.col("severity").isin("error", "critical"))


def _row(agg: DataFrame, kpi: str, raw: Column, digits: int, empty: tuple[float, str] | None, has_rows: Column, keys=()) -> DataFrame:
    """KPI row: value to ``digits`` decimals, status of the unrounded value."""
    target, _, _, unit, _ = KPIS[kpi]
    value, status = F.round(raw, digits), kpi_status(raw, kpi)
    if empty is not None:
        value = F.when(has_rows, value).otherwise(F.lit(empty[0]))
        status = F.when(has_rows, status).otherwise(F.lit(empty[1]))
    return agg.select(
        *keys,
        F.lit(kpi).alias("kpi_name"),
        value.alias("value"),
        status.alias("status"),
        F.lit(target).alias("target"),
        F.lit(unit).alias("unit"),
    )


def _group(df: DataFrame, keys) -> DataFrame:
    return df.groupBy(*keys)


def availability(events: DataFrame, hours: float, keys=()) -> DataFrame:
    """Each error costs 5 minutes of the period; 100 when there are no events."""
    agg = _group(events, keys).agg(_errors().alias("errors"), F.count("*").alias("n"))
    minutes = float(hours) * 60
    raw = F.when(F.col("n") == 0, 100.0).otherwise(
        F.greatest(F.lit(0.0), (minutes - F.col("errors") * 5) / minutes * 100)
    )
    return _row(agg, "system_availability", raw, 2, None, F.lit(True), keys)


def response_time(metrics: DataFrame, keys=()) -> DataFrame:
    """Seconds estimated from the mean of all cpu metrics."""
    rows = metrics.filter(F.col("metric_name").like("%cpu%"))
    agg = _group(rows, keys).agg(F.avg("value").alias("cpu"))
    raw = above(F.col("cpu"), [(90, 5.0), (80, 3.0), (70, 2.0), (50, 1.5)], 1.0)
    return _row(agg, "average_response_time", raw, 2, (1.0, "good"), F.col("cpu").isNotNull(), keys)


def cpu_efficiency(metrics: DataFrame, keys=()) -> DataFrame:
    """High for steady low usage, reduced by the spread between peak and mean."""
    rows = metrics.filter(F.col("metric_type") == "cpu")
    agg = _group(rows, keys).agg(F.avg("value").alias("avg"), F.max("value").alias("max"))
    avg, spread = F.col("avg"), F.col("max") - F.col("avg")
    raw = clamp(
        F.when(avg > 95, 20.0)
        .when(avg > 85, 40.0)
        .when(avg > 70, 80 - spread * 2)
        .when(avg > 50, 90 - spread * 1.5)
        .otherwise(95.0)
    )
    return _row(agg, "cpu_efficiency", raw, 1, (50.0, "fair"), avg.isNotNull(), keys)


def memory_efficiency(metrics: DataFrame, keys=()) -> DataFrame:
    rows = metrics.filter(F.col("metric_type") == "memory")
    agg = _group(rows, keys).agg(F.avg("value").alias("avg"))
    return _row(agg, "memory_efficiency", F.col("avg"), 1, (50.0, "fair"), F.col("avg").isNotNull(), keys)


def error_rate(events: DataFrame, hours: float, keys=()) -> DataFrame:
    """Errors per hour of the period."""
    agg = _group(events, keys).agg(_errors().alias("errors"))
    raw = F.col("errors") / float(hours) if hours > 0 else F.lit(0.0)
    return _row(agg, "error_rate", raw, 2, None, F.lit(True), keys)


def capacity_utilization(metrics: DataFrame, keys=()) -> DataFrame:
    """Weighted mean of the resource averages that are present; 50 when none is."""
    kinds = list(CAPACITY_WEIGHTS)
    rows = metrics.filter(F.col("metric_type").isin(*kinds))
    agg = _group(rows, keys).agg(
        *[F.avg(F.when(F.col("metric_type") == k, F.col("value"))).alias(k) for k in kinds]
    )
    weighted = total = F.lit(0.0)
    for k, w in CAPACITY_WEIGHTS.items():
        weighted = weighted + F.coalesce(F.col(k) * w, F.lit(0.0))
        total = total + F.when(F.col(k).isNotNull(), w).otherwise(0.0)
    has = F.coalesce(*[F.col(k) for k in kinds]).isNotNull()
    return _row(agg, "capacity_utilization", weighted / F.nullif(total, F.lit(0.0)), 1, (50.0, "fair"), has, keys)


def calculate_kpi(
    kpi: str, metrics: DataFrame, events: DataFrame, hours: float = 24, as_of: datetime | None = None
) -> DataFrame:
    """One KPI over the trailing hours."""
    if kpi not in KPIS:
        raise ValueError(f"unknown KPI {kpi}")
    if kpi in ("system_availability", "error_rate"):
        rows = trailing(events, hours, as_of)
        return availability(rows, hours) if kpi == "system_availability" else error_rate(rows, hours)
    fn = {
        "average_response_time": response_time,
        "cpu_efficiency": cpu_efficiency,
        "memory_efficiency": memory_efficiency,
        "capacity_utilization": capacity_utilization,
    }[kpi]
    return fn(trailing(metrics, hours, as_of))


def dashboard_kpis(
    metrics: DataFrame, events: DataFrame, hours: float = 24, as_of: datetime | None = None
) -> DataFrame:
    """All six KPIs as rows. Both tables are cut to the window ending at ``as_of``."""
    as_of = as_of or latest(metrics)
    out = None
    for kpi in KPIS:
        one = calculate_kpi(kpi, metrics, events, hours, as_of)
        out = one if out is None else out.unionByName(one)
    return out


def executive_dashboard(kpis: DataFrame) -> DataFrame:
    """Status counts, mean status points and at most five recommendations, in KPI order."""
    status = F.col("status")
    points = F.lit(OTHER_POINTS)
    for s, p in STATUS_POINTS.items():
        points = F.when(status == s, p).otherwise(points)
    advice = F.lit(None).cast("string")
    for (kpi, s), text in EXECUTIVE_ADVICE.items():
        advice = F.when((F.col("kpi_name") == kpi) & (status == s), text).otherwise(advice)
    place = F.array_position(F.array(*[F.lit(k) for k in KPIS]), F.col("kpi_name"))
    texts = F.sort_array(F.collect_list(F.when(advice.isNotNull(), F.struct(place, advice.alias("text")))))
    crit, warn = F.count_if(status == "critical"), F.count_if(status == "warning")
    agg = kpis.agg(
        *[F.count_if(status == s).alias(s) for s in STATUS_POINTS],
        F.round(F.avg(points), 1).alias("overall_health_score"),
        F.transform(texts, lambda x: x.getField("text")).alias("texts"),
        crit.alias("_crit"),
        warn.alias("_warn"),
    )
    head = F.when(F.col("_crit") >= 2, F.array(F.lit(MANY_CRITICAL))).otherwise(F.expr("array()").cast("array<string>"))
    tail = F.when((F.col("_crit") == 1) & (F.col("_warn") >= 2), F.array(F.lit(DEGRADING))).otherwise(
        F.expr("array()").cast("array<string>")
    )
    return agg.select(
        *STATUS_POINTS,
        "overall_health_score",
        F.slice(F.concat(head, F.col("texts"), tail), 1, 5).alias("recommendations"),
    )


def kpi_by_day(
    kpi: str, metrics: DataFrame, events: DataFrame, days: int = 7, as_of: datetime | None = None
) -> DataFrame:
    """The KPI of each of the last calendar days, one grouped pass."""
    as_of = as_of or latest(metrics)
    day = [F.to_date("timestamp").alias("date")]

    def cut(df: DataFrame) -> DataFrame:
        first = F.date_sub(F.lit(as_of).cast("date"), days)
        # Bounds on the raw column keep file pruning; the last, partial day is left out.
        ts = F.col("timestamp")
        return df.filter((ts >= first.cast("timestamp")) & (ts < F.lit(as_of).cast("date").cast("timestamp")))

    if kpi in ("system_availability", "error_rate"):
        rows = cut(events).withColumn("date", day[0])
        fn = availability if kpi == "system_availability" else error_rate
        return fn(rows, 24, ["date"])
    rows = cut(metrics).withColumn("date", day[0])
    fn = {
        "average_response_time": response_time,
        "cpu_efficiency": cpu_efficiency,
        "memory_efficiency": memory_efficiency,
        "capacity_utilization": capacity_utilization,
    }[kpi]
    return fn(rows, ["date"])


def kpi_trend(daily: DataFrame) -> DataFrame:
    """Direction, change and average between the first and the last day."""
    agg = daily.agg(
        F.first("kpi_name").alias("kpi_name"),
        F.count("*").alias("days"),
        F.min_by("value", "date").alias("first_value"),
        F.max_by("value", "date").alias("current_value"),
        F.round(F.avg("value"), 2).alias("average_value"),
    )
    first, last = F.col("first_value"), F.col("current_value")
    change = F.when((F.col("days") < 2) | (first == 0), 0.0).otherwise((last - first) / first * 100)
    return agg.select(
        "kpi_name",
        "days",
        F.when(F.col("days") < 2, "stable")
        .when(last > first, "improving")
        .otherwise("declining")
        .alias("direction"),
        F.round(change, 2).alias("change_percent"),
        "current_value",
        "average_value",
    )
