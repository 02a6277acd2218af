"""Flattening of raw device, GPU and sensor payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.columns import json_map

# Unit of each reading that a flat device record may hold.
DEVICE_UNITS = {"temperature": "°C", "humidity": "%", "pressure": "hPa", "light": "lux", "motion": "bool"}

_SENSORS = (
    "sensors ARRAY<STRUCT<type: STRING, value: DOUBLE, unit: STRING, timestamp: TIMESTAMP, quality: DOUBLE>>"
)
_GPUS = "gpus ARRAY<STRUCT<name: STRING, utilization: DOUBLE>>, total_gpus INT"
_TEMPERATURES = (
    "sensors MAP<STRING, ARRAY<STRUCT<label: STRING, current_celsius: DOUBLE, high_celsius: DOUBLE,"
    " critical_celsius: DOUBLE>>>, battery STRUCT<percent: DOUBLE, secsleft: DOUBLE, power_plugged: BOOLEAN>"
)


def flatten_device_payload(polls: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per reading: from the sensor list if there is one, else from the known keys."""
    flat = json_map(F.col(payload))
    base = [c for c in polls.columns if c != payload]
    listed = F.transform(
        F.from_json(payload, _SENSORS).getField("sensors"),
        lambda s: F.struct(
            F.coalesce(s["type"], F.lit("unknown")).alias("sensor_type"),
            F.coalesce(s["value"], F.lit(0.0)).alias("value"),
            F.coalesce(s["unit"], F.lit("")).alias("unit"),
            F.coalesce(s["timestamp"], F.col("timestamp")).alias("reading_time"),
            F.coalesce(s["quality"], F.lit(1.0)).alias("quality_score"),
        ),
    )
    known = F.filter(
        F.array(
            *[
                F.struct(
                    F.lit(k).alias("sensor_type"),
                    flat.getItem(k).try_cast("double").alias("value"),
                    F.lit(unit).alias("unit"),
                    F.col("timestamp").alias("reading_time"),
                    F.lit(1.0).alias("quality_score"),
                )
                for k, unit in DEVICE_UNITS.items()
            ]
        ),
        lambda s: s["value"].isNotNull(),
    )
    readings = F.when(F.map_contains_key(flat, "sensors"), listed).otherwise(known)
    out = polls.filter(F.col(payload).isNotNull()).select(*base, F.inline(readings))
    return out.withColumn("sensor_id", F.concat_ws("_", "device_id", "sensor_type"))


def flatten_gpu_payload(records: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per GPU with its index."""
    base = [c for c in records.columns if c != payload]
    gpus = F.from_json(payload, _GPUS).getField("gpus")
    rows = records.select(*base, F.posexplode(gpus).alias("gpu_index", "gpu"))
    return rows.select(
        *base, "gpu_index", F.col("gpu.name").alias("name"), F.coalesce("gpu.utilization", F.lit(0.0)).alias("utilization")
    )


def gpu_utilization(records: DataFrame, payload: str = "payload") -> DataFrame:
    """The first GPU's utilization of each record as a long metric; 0 when unknown."""
    base = [c for c in records.columns if c != payload]
    first = F.try_element_at(F.from_json(payload, _GPUS).getField("gpus"), F.lit(1))
    return records.select(
        *base,
        F.lit("gpu").alias("metric_type"),
        F.lit("gpu_utilization").alias("metric_name"),
        F.coalesce(first.getField("utilization"), F.lit(0.0)).alias("value"),
    )


def flatten_temperature_payload(records: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per temperature reading; empty labels read 'Unknown'."""
    base = [c for c in records.columns if c != payload]
    sensors = F.from_json(payload, _TEMPERATURES).getField("sensors")
    rows = records.select(*base, F.explode(sensors).alias("sensor_name", "list"))
    rows = rows.select(*base, "sensor_name", F.inline("list"))
    label = F.when(F.coalesce(F.col("label"), F.lit("")) == "", "Unknown").otherwise(F.col("label"))
    return rows.withColumn("label", label)


def battery_hours(records: DataFrame, payload: str = "payload") -> DataFrame:
    """Battery percent and remaining hours; negative or missing seconds are unknown."""
    base = [c for c in records.columns if c != payload]
    battery = F.from_json(payload, _TEMPERATURES).getField("battery")
    seconds = battery.getField("secsleft")
    return records.select(
        *base,
        battery.getField("percent").alias("percent"),
        F.when(seconds >= 0, seconds / 3600).alias("time_remaining_hours"),
    ).filter(F.col("percent").isNotNull())


def device_status_latest(polls: DataFrame, order: str = "event_id", payload: str = "payload") -> DataFrame:
    """Last known state of each device: a poll without payload means offline."""
    newest = F.max_by(F.struct("device_type", "timestamp", payload), F.struct("timestamp", order))
    last = polls.groupBy("device_id").agg(newest.alias("s"))
    # Only the winning payload of each device is parsed.
    last = last.withColumn("rec", F.explode(F.array(json_map(F.col(f"s.{payload}")))))
    rec = F.col("rec")
    return last.select(
        "device_id",
        "s.device_type",
        F.when(rec.isNotNull(), "online").otherwise("offline").alias("status"),
        F.col("s.timestamp").alias("last_seen"),
        rec.getItem("battery_level").try_cast("double").alias("battery_level"),
        rec.getItem("signal_strength").try_cast("double").alias("signal_strength"),
        rec.getItem("firmware_version").alias("firmware_version"),
    )
