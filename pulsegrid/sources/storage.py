"""Table writes, tiering, retention, incremental and change loads, exports.

Telemetry tables are parquet partitioned by ``date``. Writers ask for a rebalance on the
date, so that small dates share files and a hot date is split over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.functions.columns import json_map, map_number, with_json_map
from pulsegrid.functions.timewin import latest, trailing
from pulsegrid.plans.joins import join_keys
from pulsegrid.plans.staging import stage

CSV_TIMESTAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def scan_table(spark: SparkSession, path: str) -> DataFrame:
    """The whole table; columns and filters are pruned by later operators."""
    return spark.read.parquet(path)


def append_table(df: DataFrame, path: str, ts: str = "timestamp") -> None:
    """Append rows to a table partitioned by date."""
    dated = df.withColumn("date", F.to_date(ts)).hint("rebalance", "date")
    dated.write.mode("append").partitionBy("date").parquet(path)


def metric_snapshot_rows(ticks: DataFrame, ts: str = "timestamp") -> DataFrame:
    """One tick with four payload columns becomes four rows of JSON text."""
    kinds = ["cpu", "memory", "disk", "network"]
    rows = F.array(
        *[F.struct(F.lit(k).alias("metric_type"), F.to_json(F.col(k)).alias("data")) for k in kinds]
    )
    others = [c for c in ticks.columns if c not in kinds]
    return ticks.select(*others, F.inline(rows))


def long_metric_rows(metrics: DataFrame, source: str = "system") -> DataFrame:
    """Rows of the long metric table: metadata and tags as JSON, the source defaulted."""

    def as_json(name: str) -> Column:
        dtype = metrics.schema[name].dataType
        return F.col(name) if isinstance(dtype, T.StringType) else F.to_json(F.col(name))

    return metrics.withColumns(
        {
            "metadata": as_json("metadata"),
            "tags": as_json("tags"),
            "source": F.coalesce(F.col("source"), F.lit(source)),
        }
    ).filter(F.col("value").isNotNull())


def system_event_rows(events: DataFrame) -> DataFrame:
    """Rows of the event table: lists as JSON, unresolved and impact 0 by default."""
    return events.withColumns(
        {
            "tags": F.to_json("tags"),
            "related_metrics": F.to_json("related_metrics"),
            "resolved": F.coalesce(F.col("resolved"), F.lit(False)),
            "impact_score": F.coalesce(F.col("impact_score"), F.lit(0)),
        }
    )


def process_metric_rows(processes: DataFrame, blobs: Sequence[str]) -> DataFrame:
    """Rows of the detailed process table: nested columns as JSON text."""
    return processes.withColumns({b: F.to_json(F.col(b)) for b in blobs})


def clean_process_snapshots(records: DataFrame, text: str = "record") -> DataFrame:
    """Typed process rows from JSON records.

    A missing number is 0; a null or non-numeric one drops the record.
    """
    numbers = ("cpu_percent", "memory_percent", "memory_mb")

    def typed(rec: Column) -> Column:
        return F.struct(
            map_number(rec, "pid", 0.0).cast("bigint").alias("pid"),
            rec.getItem("name").alias("name"),
            *[map_number(rec, c, 0.0).alias(c) for c in numbers],
            rec.getItem("status").alias("status"),
            rec.getItem("username").alias("username"),
        )

    # The lambda parses each record once; the filter stays above it.
    others = [c for c in records.columns if c != text]
    parsed = F.transform(F.array(json_map(F.col(text))), typed)
    return records.select(*others, F.inline(parsed)).na.drop(subset=["pid", *numbers])


def historical_scan(
    snapshots: DataFrame,
    metric_type: str,
    schema: T.StructType,
    hours: float = 1,
    as_of: datetime | None = None,
    sort: bool = True,
) -> DataFrame:
    """Parsed payloads of one type in the trailing hours, by time."""
    mine = snapshots.filter(F.col("metric_type") == metric_type)
    as_of = as_of or latest(mine)
    rows = trailing(mine, hours, as_of)
    if as_of is not None and "date" in snapshots.columns:
        # Prunes the partitions of a table written by append_table.
        rows = rows.filter(F.col("date") >= F.lit((as_of - timedelta(hours=hours)).date()))
    out = rows.withColumn("payload", F.from_json("data", schema)).drop("data")
    return out.orderBy("timestamp") if sort else out


def load_time_series(metrics: DataFrame, metric_name: str, start: datetime, end: datetime) -> DataFrame:
    """One series in [start, end], by time."""
    rows = metrics.filter(
        (F.col("metric_name") == metric_name) & F.col("timestamp").between(F.lit(start), F.lit(end))
    )
    return rows.orderBy("timestamp")


def tier_route(metrics: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """Mark rows older than ``days`` as historical, others as current."""
    old = F.col("timestamp") < F.lit(as_of - timedelta(days=days))
    return metrics.withColumn("tier", F.when(old, "historical").otherwise("current"))


def write_tiers(metrics: DataFrame, current: str, historical: str, as_of: datetime, days: int = 7) -> None:
    """Append each row to the table of its tier."""
    routed = tier_route(metrics, as_of, days)
    append_table(routed.filter("tier = 'current'").drop("tier"), current)
    append_table(routed.filter("tier = 'historical'").drop("tier"), historical)


def all_metrics_view(current: DataFrame, historical: DataFrame) -> DataFrame:
    """Both tiers together, each row tagged with its table."""
    return current.withColumn("partition_type", F.lit("current")).unionByName(
        historical.withColumn("partition_type", F.lit("historical"))
    )


def derive_business_metrics(metrics: DataFrame) -> DataFrame:
    """Utilization rows for cpu, memory and disk samples."""
    return metrics.filter(F.col("metric_type").isin("cpu", "memory", "disk")).select(
        "timestamp",
        F.lit("performance").alias("metric_category"),
        F.concat(F.col("metric_type"), F.lit("_utilization")).alias("metric_name"),
        "value",
        F.lit("percent").alias("unit"),
    )


def filesystem(spark: SparkSession, path: str):
    """Hadoop file system of a path, and the JVM view."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm


def retention_cleanup(spark: SparkSession, path: str, as_of: datetime, days: int = 7) -> DataFrame:
    """Delete rows older than ``days`` from a table partitioned by date.

    Only the partition of the cut is rewritten; older ones are dropped as directories. For tables
    that are read meanwhile, ``versioned.retain`` does it in one commit.
    """
    cutoff = as_of - timedelta(days=days)
    fs, jvm = filesystem(spark, path)
    edge = cutoff.date().isoformat()
    edge_path = jvm.org.apache.hadoop.fs.Path(f"{path}/date={edge}")
    if fs.exists(edge_path):
        kept = stage(
            spark.read.parquet(path)
            .filter((F.col("date") == F.lit(cutoff.date())) & (F.col("timestamp") >= F.lit(cutoff))),
            "kept",
        )
        if kept.isEmpty():
            fs.delete(edge_path, True)
        else:
            kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
                "date"
            ).parquet(path)
    for entry in fs.listStatus(jvm.org.apache.hadoop.fs.Path(path)):
        name = entry.getPath().getName()
        if name.startswith("date=") and name[5:] < edge:
            fs.delete(entry.getPath(), True)
    return spark.read.parquet(path)


def table_stats(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Rows, columns and bytes of each table, as one plan with one branch per table."""
    out = None
    for name, path in paths.items():
        df = spark.read.parquet(path)
        fs, jvm = filesystem(spark, path)
        size = fs.getContentSummary(jvm.org.apache.hadoop.fs.Path(path)).getLength()
        one = df.agg(F.count("*").alias("row_count")).select(
            F.lit(name).alias("table_name"),
            "row_count",
            F.lit(len(df.columns)).alias("column_count"),
            F.lit(", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)).alias("columns"),
            F.lit(int(size)).cast("bigint").alias("size_bytes"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def incremental_load(
    spark: SparkSession,
    source: DataFrame,
    path: str,
    ts: str = "timestamp",
    row_id: Sequence[str] | None = None,
    lateness: timedelta | None = None,
) -> DataFrame:
    """Append the rows that the table does not have yet, late ones and ties included. Running it
    again adds nothing.

    Rows are known by ``row_id``; without it by all their columns, and of equal rows as many are
    added as the table has too few. With ``lateness``, rows older than that before the table's
    newest row are not looked at, and the comparison reads only the table's later dates.
    """
    fs, jvm = filesystem(spark, path)
    fresh = source
    if fs.exists(jvm.org.apache.hadoop.fs.Path(path)):
        loaded = spark.read.parquet(path)
        newest = loaded.agg(F.max(ts)).first()[0] if lateness is not None else None
        if newest is not None:
            edge = F.lit(newest - lateness)
            source, loaded = source.filter(F.col(ts) >= edge), loaded.filter(F.col(ts) >= edge)
        if row_id is None:
            fresh = source.exceptAll(loaded.select(*source.columns))
        else:
            fresh = join_keys(source, loaded.select(*row_id).distinct(), list(row_id), "left_anti")
        # Written before the table grows: the plan reads the table it is appended to.
        fresh = stage(fresh, "fresh-rows")
    append_table(fresh, path, ts)
    return spark.read.parquet(path)


def cdc_apply(
    base: DataFrame, changes: DataFrame, key: Sequence[str], sequence: Sequence[str], op: str = "op"
) -> DataFrame:
    """Apply a change log: the newest change per key wins, ``delete`` removes the row.

    The newest change is a map-side combined aggregate, so a key with most of the log does
    not gather in one task. A redelivered change has no further effect.
    """
    payload = [c for c in base.columns if c not in key]
    newest = changes.groupBy(*key).agg(
        F.max_by(F.struct(*payload, op), F.struct(*sequence)).alias("_new")
    )
    kept = base.join(newest.select(*key), list(key), "left_anti")
    upserts = newest.filter(F.col(f"_new.{op}") != "delete").select(
        *[F.col(c) if c in key else F.col(f"_new.{c}") for c in base.columns]
    )
    return kept.unionByName(upserts)


# ---- exports -------------------------------------------------------------------------


def export_wide(snapshots: DataFrame, order: str = "event_id") -> DataFrame:
    """One row per timestamp with cpu, memory and network values side by side.

    The first snapshot of a type at a timestamp counts; total memory is in GiB to 2 decimals.
    """
    kind = F.col("metric_type")
    rows = with_json_map(snapshots.filter(kind.isin("cpu", "memory", "network")), "data", "rec")

    def first(metric: str, key: str) -> Column:
        mine = kind == metric
        value = F.struct(F.col("rec").getItem(key).try_cast("double").alias("v"))
        return F.min_by(F.when(mine, value), F.when(mine, F.col(order))).getField("v")

    total = F.nullif(first("memory", "total"), F.lit(0.0))
    return rows.groupBy("timestamp").agg(
        first("cpu", "usage_percent").alias("cpu_percent"),
        first("memory", "usage_percent").alias("memory_percent"),
        F.round(total / float(1024**3), 2).alias("memory_total_gb"),
        first("network", "sent_rate_kbps").alias("network_sent_kbps"),
        first("network", "recv_rate_kbps").alias("network_recv_kbps"),
    )


def timestamp_union(snapshots: DataFrame) -> DataFrame:
    """Distinct sorted timestamps of the cpu, memory and network series."""
    kinds = F.col("metric_type").isin("cpu", "memory", "network")
    return snapshots.filter(kinds).select("timestamp").distinct().orderBy("timestamp")


def write_csv(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """CSV part files with a header; ``order`` makes them globally sorted."""
    out = df.orderBy(*order) if order else df
    out.write.mode("error").option("header", True).option("timestampFormat", CSV_TIMESTAMP).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return (
        spark.read.schema(schema).option("header", True).option("timestampFormat", CSV_TIMESTAMP).csv(path)
    )


def export_single(snapshots: DataFrame, metric_type: str, fields: dict[str, str]) -> DataFrame:
    """One metric type with one column per payload field (name -> type)."""
    schema = T.StructType.fromDDL(", ".join(f"{k} {v}" for k, v in fields.items()))
    payload = F.from_json("data", schema)
    rows = snapshots.filter(F.col("metric_type") == metric_type).withColumn("_p", payload)
    return rows.filter(F.col("_p").isNotNull()).select("timestamp", *[F.col(f"_p.{k}") for k in fields])


def write_json(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """JSON lines with microsecond timestamps, in one folder per value of ``by``."""
    out = df.hint("rebalance", *by) if by else df
    out.write.mode("error").option("timestampFormat", CSV_TIMESTAMP).partitionBy(*by).json(path)


def export_manifest(df: DataFrame, by: str, hours: float, exported_at: datetime) -> DataFrame:
    """The description that goes with an export: one row per value of ``by``."""
    return df.groupBy(F.col(by).alias("data_type")).agg(F.count("*").alias("row_count")).select(
        F.lit(exported_at).alias("exported_at"),
        "data_type",
        F.lit(float(hours)).alias("time_range_hours"),
        "row_count",
    )
