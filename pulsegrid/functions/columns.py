"""Scalar rules as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Metric thresholds of the anomaly score, by metric name.
SCORE_THRESHOLDS = {
    "cpu_percent": {"high": 85, "critical": 95},
    "memory_percent": {"high": 80, "critical": 90},
    "disk_percent": {"high": 85, "critical": 95},
    "temperature": {"high": 70, "critical": 85},
    "network_errors": {"high": 10, "critical": 100},
}

# Stream thresholds, by metric type.
STREAM_THRESHOLDS = {
    "cpu": {"warning": 80, "critical": 95},
    "memory": {"warning": 85, "critical": 95},
    "disk": {"warning": 90, "critical": 98},
    "temperature": {"warning": 70, "critical": 85},
}

# Accepted range of percentages.
PERCENT_RANGE = (0.0, 100.0)


def tiers(value: Column, steps: list[tuple[Column, object]], default: object) -> Column:
    """First matching (condition, result) pair, else the default."""
    lit = F.lit
    chain = F.when(steps[0][0], lit(steps[0][1]))
    for cond, out in steps[1:]:
        chain = chain.when(cond, lit(out))
    return chain.otherwise(lit(default))


def above(value: Column, steps: list[tuple[float, object]], default: object) -> Column:
    """Result of the first bound that ``value`` exceeds."""
    return tiers(value, [(value > b, out) for b, out in steps], default)


def at_least(value: Column, steps: list[tuple[float, object]], default: object) -> Column:
    """Result of the first bound that ``value`` reaches."""
    return tiers(value, [(value >= b, out) for b, out in steps], default)


def valid_percent(value: Column) -> Column:
    return F.coalesce(value.between(*PERCENT_RANGE), F.lit(False))


def validated_percent(value: Column) -> Column:
    """Percentages outside 0..100 become 0."""
    return F.when(valid_percent(value), value).otherwise(F.lit(0.0))


def clamp(value: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def severity_of_score(score: Column) -> Column:
    return at_least(score, [(0.9, "critical"), (0.7, "high"), (0.5, "medium")], "low")


def isolation_severity(score: Column) -> Column:
    return above(F.abs(score), [(0.8, "critical"), (0.5, "high"), (0.2, "medium")], "low")


def threshold_score(metric: Column, value: Column, thresholds=None) -> Column:
    """1.0 from the critical bound, 0.7 from the high bound, else 0; unknown metrics 0."""
    table = SCORE_THRESHOLDS if thresholds is None else thresholds
    steps = []
    for name, t in table.items():
        if "critical" in t:
            steps.append(((metric == name) & (value >= t["critical"]), 1.0))
        if "high" in t:
            steps.append(((metric == name) & (value >= t["high"]), 0.7))
    return tiers(value, steps, 0.0) if steps else F.lit(0.0)


def stream_severity(metric_type: Column, value: Column, thresholds=None) -> Column:
    """critical / warning / null by the metric type's two bounds."""
    table = STREAM_THRESHOLDS if thresholds is None else thresholds
    steps = []
    for name, t in table.items():
        steps.append(((metric_type == name) & (value >= t["critical"]), "critical"))
        steps.append(((metric_type == name) & (value >= t["warning"]), "warning"))
    return tiers(value, steps, None)


def stream_threshold(metric_type: Column, severity: Column, thresholds=None) -> Column:
    """The bound that a severity of ``stream_severity`` stands for."""
    table = STREAM_THRESHOLDS if thresholds is None else thresholds
    steps = []
    for name, t in table.items():
        for level in ("critical", "warning"):
            steps.append(((metric_type == name) & (severity == level), float(t[level])))
    return tiers(severity, steps, None)


def compare(value: Column, condition: Column, threshold: Column) -> Column:
    """Comparator given as data; an unknown comparator is false."""
    return (
        F.when(condition == ">", value > threshold)
        .when(condition == "<", value < threshold)
        .when(condition == ">=", value >= threshold)
        .when(condition == "<=", value <= threshold)
        .when(condition == "==", value == threshold)
        .when(condition == "!=", value != threshold)
        .otherwise(F.lit(False))
    )


def health_status(score: Column) -> Column:
    steps = [(90, "excellent"), (70, "good"), (50, "fair"), (30, "poor")]
    return at_least(score, steps, "critical")


def format_bytes(size: Column) -> Column:
    """Bytes with the largest fitting unit and one decimal."""
    units = ["B", "KB", "MB", "GB", "TB", "PB"]
    chain = None
    for i, unit in enumerate(units):
        scaled = size.cast("double") / float(1024**i)
        text = F.format_string(f"%.1f {unit}", F.bround(scaled, 1))
        if i == len(units) - 1:
            return chain.otherwise(text)
        cond = scaled < 1024
        chain = F.when(cond, text) if chain is None else chain.when(cond, text)


def calendar(ts: Column) -> dict[str, Column]:
    """hour, day_of_week (Monday 0) and weekend flag."""
    dow = F.weekday(ts)
    return {
        "hour": F.hour(ts),
        "day_of_week": dow,
        "is_weekend": F.when(dow.isin(5, 6), 1).otherwise(0),
    }


def contributing_factors(
    metric_type: Column, primary: Column, load: Column, swap: Column, errors: Column, drops: Column
) -> Column:
    """Names of the rules that a feature row breaks."""
    rules = [
        ((metric_type == "cpu") & (primary > 90), "high_cpu_usage"),
        ((metric_type == "cpu") & (load > 5), "high_system_load"),
        ((metric_type == "memory") & (primary > 90), "high_memory_usage"),
        ((metric_type == "memory") & (swap > 50), "high_swap_usage"),
        ((metric_type == "disk") & (primary > 90), "high_disk_usage"),
        ((metric_type == "network") & (errors > 100), "network_errors"),
        ((metric_type == "network") & (drops > 100), "network_packet_drops"),
    ]
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in rules]))


def _round_type(col: Column, dtype: T.DataType, digits: int) -> Column:
    if isinstance(dtype, T.BooleanType):
        return col.cast("double")
    if isinstance(dtype, T.NumericType):
        return F.round(col.cast("double"), digits)
    if isinstance(dtype, T.ArrayType):
        element = dtype.elementType
        if isinstance(element, (T.NumericType, T.BooleanType)):
            return F.transform(col, lambda x: _round_type(x, element, digits))
        return col
    if isinstance(dtype, T.StructType):
        parts = [
            _round_type(col.getField(f.name), f.dataType, digits).alias(f.name)
            for f in dtype.fields
        ]
        return F.when(col.isNotNull(), F.struct(*parts))
    if isinstance(dtype, T.MapType) and isinstance(dtype.valueType, T.NumericType):
        return F.transform_values(col, lambda _, v: F.round(v.cast("double"), digits))
    return col


def sanitize_numeric(df: DataFrame, columns: list[str], digits: int = 2) -> DataFrame:
    """Round every number inside the given columns, nested structs and arrays included."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.select(
        *[
            _round_type(F.col(c), types[c], digits).alias(c) if c in columns else F.col(c)
            for c in df.columns
        ]
    )


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def json_map(text: Column) -> Column:
    """JSON object as string map, nested values as JSON text; null when unparsable."""
    return F.from_json(text, T.MapType(T.StringType(), T.StringType()))


def with_json_map(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add the parsed object; rows with unparsable text drop.

    explode makes the map a column of its own, so that no later filter parses the text again.
    """
    return df.withColumn(out, F.explode(F.array(json_map(F.col(text))))).filter(F.col(out).isNotNull())


def map_number(record: Column, key: str, missing: float | None = None) -> Column:
    """A number under ``key``; ``missing`` if the key is absent, null if it is no number."""
    value = record.getItem(key).try_cast("double")
    return F.when(~F.map_contains_key(record, key), F.lit(missing)).otherwise(value)
