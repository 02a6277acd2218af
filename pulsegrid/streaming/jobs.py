"""Streaming sources, sinks and stateless jobs.

Every job is a plain streaming DataFrame or a writer around one. Files are taken in bounded
batches, checkpoints go to the caller's folder, and batch writers are idempotent: a batch
that runs again overwrites what it wrote before.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pulsegrid.operators.alerts import anomaly_to_alert
from pulsegrid.operators.anomaly import threshold_anomalies
from pulsegrid.operators.messages import event_routing
from pulsegrid.plans.staging import stage_path
from pulsegrid.sources.storage import tier_route
from pulsegrid.sources.versioned import VersionedTable, append_dated, append_new

WATERMARK = "5 minutes"
MEDIAN_ACCURACY = 10_000
Processor = Callable[[DataFrame], DataFrame]

EVENTS_SCHEMA = (
    "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
)


def event_stream(
    spark: SparkSession,
    folder: str,
    schema: str = EVENTS_SCHEMA,
    files: str = "events.parquet",
    max_files: int = 1000,
) -> DataFrame:
    """Parquet files of a folder as a stream, ``max_files`` per micro-batch."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", files)
    return reader.option("maxFilesPerTrigger", max_files).parquet(folder)


def subscribe(messages: DataFrame, predicate: Column) -> DataFrame:
    """The messages one subscriber asked for (batch or stream)."""
    return messages.filter(predicate)


def start(
    stream: DataFrame, path: str, checkpoint: str, mode: str = "append", every: str | None = None
) -> StreamingQuery:
    """Start writing a stream to a parquet table: a micro-batch ``every`` so often ("10 seconds")
    until the caller stops the query, or, without it, all available input."""
    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    writer = stream.writeStream.format("parquet").outputMode(mode).option("path", path)
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def late_rows(query: StreamingQuery) -> int:
    """Rows that the stateful operators dropped behind the watermark, in the micro-batches that
    the query still reports (``spark.sql.streaming.numRecentProgressUpdates``)."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process all available input into a parquet table and return it."""
    start(stream, path, checkpoint, mode).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """``run_available`` into fresh folders of the shared staging area."""
    spark = stream.sparkSession
    return run_available(stream, stage_path(spark, name), stage_path(spark, f"{name}-checkpoint"), mode)


def for_each_batch(
    stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str
) -> None:
    """Run ``write`` on every micro-batch until the available input is used up."""
    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def incremental_stream(
    stream: DataFrame, table: VersionedTable, checkpoint: str, row_id: Sequence[str], ts: str = "timestamp"
) -> None:
    """Add the rows of every micro-batch that the table does not have yet, late ones included."""
    for_each_batch(stream, lambda batch, n: append_new(table, batch, row_id, ts, n + 1), checkpoint)


def tier_stream(
    stream: DataFrame,
    current: VersionedTable,
    historical: VersionedTable,
    checkpoint: str,
    as_of: datetime,
    days: int = 7,
) -> None:
    """Commit the rows of every micro-batch to the table of their tier."""

    def write(batch: DataFrame, batch_id: int) -> None:
        routed = tier_route(batch, as_of, days)
        for name, table in (("current", current), ("historical", historical)):
            append_dated(table, routed.filter(F.col("tier") == name).drop("tier"), version=batch_id + 1)

    for_each_batch(stream, write, checkpoint)


def _write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """One folder per micro-batch, replaced when the batch is run again."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


# ---- processors ----------------------------------------------------------------------


class Processors:
    """Named functions from a DataFrame of events to a DataFrame of results."""

    def __init__(self) -> None:
        self._functions: dict[str, Processor] = {}

    def register(self, name: str, fn: Processor) -> None:
        self._functions[name] = fn

    def names(self) -> list[str]:
        return list(self._functions)

    def get(self, name: str) -> Processor:
        return self._functions[name]


def batch_aggregate(events: DataFrame) -> DataFrame:
    """Aggregates of the system metrics of one micro-batch, in one pass; the median is exact."""
    rows = events.filter((F.col("event_type") == "system_metric") & F.col("value").isNotNull())
    return rows.groupBy("metric_type").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("stdev"),
        F.percentile("value", 0.5).alias("median"),
    )


def batch_performance(events: DataFrame) -> DataFrame:
    """Latency and throughput of one micro-batch."""
    x = F.when(F.col("processing_latency_ms") > 0, F.col("processing_latency_ms"))
    span = (F.unix_micros(F.max("timestamp")) - F.unix_micros(F.min("timestamp"))) / 1e6
    return events.agg(
        F.avg(x).alias("average_ms"),
        F.min(x).alias("min_ms"),
        F.max(x).alias("max_ms"),
        F.percentile(x, 0.95).alias("percentile_95"),
        F.count("*").alias("total_events"),
        F.when(span == 0, 1.0).otherwise(span).alias("time_span_seconds"),
    )


def builtin_processors() -> Processors:
    """The four processors that events are routed to by default."""
    out = Processors()
    out.register("system_aggregator", batch_aggregate)
    out.register("anomaly_detector", threshold_anomalies)
    out.register("performance_calculator", batch_performance)
    out.register("alert_generator", anomaly_to_alert)
    return out


def microbatch_process(
    stream: DataFrame,
    processors: Processors,
    path: str,
    checkpoint: str,
    attempts: int = 2,
    fail_fast: bool = False,
) -> None:
    """Run each processor on its routed events of every micro-batch.

    Results go to ``path/<processor>``, a log of the runs to ``path/runs``: events taken,
    milliseconds used, whether the processor failed, and its error. A processor gets ``attempts``
    tries at a batch. One that fails them all does not stop the others, and its batch is in the
    log; with ``fail_fast`` the stream stops instead, and the batch runs again when it is restarted.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        routed = event_routing(batch).persist()
        taken = {r[0]: r[1] for r in routed.groupBy("processor").count().collect()}  # one row per processor
        runs = []
        for name in processors.names():
            if not taken.get(name):
                continue
            started, error = time.monotonic(), None
            mine = routed.filter(F.col("processor") == name).drop("processor")
            for left in reversed(range(attempts)):
                try:
                    _write_batch(processors.get(name)(mine), f"{path}/{name}", batch_id)
                    error = None
                    break
                except Exception as ex:
                    if fail_fast and not left:
                        raise
                    error = f"{type(ex).__name__}: {ex}"
            spent = (time.monotonic() - started) * 1000
            runs.append((name, taken[name], spent, error is not None, error))
        routed.unpersist()
        log = "processor_name string, input_events bigint, processing_time_ms double, failed boolean, error string"
        _write_batch(spark.createDataFrame(runs, log), f"{path}/runs", batch_id)

    for_each_batch(stream, write, checkpoint)


def route_stream(events: DataFrame) -> DataFrame:
    """Events fanned out to their processors; write with ``partitionBy("processor")``."""
    return event_routing(events)


def windowed_stream_agg(
    events: DataFrame, width: str = "1 minute", slide: str | None = None, watermark: str = WATERMARK
) -> DataFrame:
    """Event-time aggregates per metric type; a window is final once the watermark passes it.

    The median is the middle between the lower and the upper one, each from a mergeable sketch:
    exact in windows of up to ``MEDIAN_ACCURACY / 2`` rows, and off by at most one in
    ``MEDIAN_ACCURACY`` ranks beyond, so the state stays small.
    """
    win = F.window("timestamp", width, slide) if slide else F.window("timestamp", width)
    rows = events.filter((F.col("event_type") == "system_metric") & F.col("value").isNotNull())
    agg = rows.withWatermark("timestamp", watermark).groupBy(win.alias("win"), "metric_type").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("stdev"),
        ((F.percentile_approx("value", 0.5, MEDIAN_ACCURACY) - F.percentile_approx(-F.col("value"), 0.5, MEDIAN_ACCURACY)) / 2).alias("median"),
    )
    return agg.select(
        F.col("win.start").alias("window_start"), F.col("win.end").alias("window_end"), *agg.columns[1:]
    )


def stream_threshold_anomaly(events: DataFrame) -> DataFrame:
    """Threshold anomalies, row by row."""
    return threshold_anomalies(events)


def stream_stats(messages: DataFrame) -> DataFrame:
    """Messages and last message time per stream, for complete mode."""
    return messages.groupBy("stream_name").agg(
        F.count("*").alias("messages_processed"), F.max("timestamp").alias("last_message_time")
    )


def priority_lanes(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Immediate (priority >= 3) and batched messages, for two queries with their own triggers."""
    urgent = F.col("priority") >= 3
    return messages.filter(urgent), messages.filter(~urgent)


def batch_sink(stream: DataFrame, tables: dict[str, Column], root: str, checkpoint: str) -> None:
    """Write every micro-batch to several tables, each taking the rows of its condition."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        for name, condition in tables.items():
            _write_batch(batch.filter(condition), f"{root}/{name}", batch_id)
        batch.unpersist()

    for_each_batch(stream, write, checkpoint)


def stream_store(
    metrics: DataFrame, root: str, checkpoint: str, every: int = 5, tick: str = "tick", process: str = "process"
) -> None:
    """Store every tick's metrics, and the process snapshot of each ``every``-th tick."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        _write_batch(batch.drop(process), f"{root}/metrics", batch_id)
        snapshots = batch.filter((F.col(tick) % every == 0) & F.col(process).isNotNull())
        _write_batch(snapshots.select(tick, "timestamp", F.col(f"{process}.*")), f"{root}/processes", batch_id)
        batch.unpersist()

    for_each_batch(metrics, write, checkpoint)


def alert_outbox(alerts: DataFrame, path: str, checkpoint: str) -> None:
    """Hand alerts over to delivery: one idempotent folder per micro-batch."""
    for_each_batch(alerts, lambda batch, batch_id: _write_batch(batch, path, batch_id), checkpoint)
