"""Streams over several micro-batches, compared with the batch operators."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import alerts, anomaly, messages
from pulsegrid.plans.staging import stage_path
from pulsegrid.sources import adapters as A
from pulsegrid.streaming import jobs, stateful

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module", autouse=True)
def rocksdb(spark):
    stateful.use_rocksdb(spark)


@pytest.fixture(scope="module")
def parts(spark, sf_dir):
    """The events table as five files in time order, read one file per micro-batch."""
    folder = stage_path(spark, "events")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    size = events.count() // 5 + 1
    for i in range(5):
        part = events.filter(F.col("event_id").between(i * size, (i + 1) * size - 1))
        part.coalesce(1).write.mode("append").parquet(folder)
    return folder, events


def stream(spark, parts):
    return jobs.event_stream(spark, parts[0], files="*.parquet", max_files=1)


def ids(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def released(df, rows, late=5, slot=60):
    """Rows of ``df`` that a stream over ``rows`` has given out at the end of its input."""
    top = rows.agg(F.max(F.unix_millis("timestamp"))).first()[0] - late * 60_000
    return df.filter(F.expr(f"(unix_millis(timestamp) div {slot * 1000} + 1) * {slot * 1000} <= {top}"))


def delivered(spark, name, batches, schema):
    """Lists of rows as files that a stream reads one by one."""
    folder = stage_path(spark, name)
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return jobs.event_stream(spark, folder, schema, "*.parquet", max_files=1)


def test_baseline_state_spans_batches(spark, parts):
    live = jobs.drain(stateful.stream_baseline_anomaly(A.metrics_from_events(stream(spark, parts))), "t")
    metrics = A.metrics_from_events(parts[1]).select("event_id", "timestamp", "metric_name", "value")
    batch = released(anomaly.composite_anomaly(metrics), metrics)
    cols = ("event_id", F.round("anomaly_score", 6))
    assert batch.count() > 0 and ids(live, *cols) == ids(batch, *cols)


def test_cooldown_state_spans_batches(spark, parts):
    rules = alerts.rule_table(spark, [(*x[:5], 60 * 24) for x in alerts.DEFAULT_RULES])
    live = jobs.drain(stateful.stream_alert_cooldown(alerts.rule_match(A.metrics_from_events(stream(spark, parts)), rules)), "t")
    hits = alerts.rule_match(A.metrics_from_events(parts[1]), rules)
    batch = alerts.alert_cooldown(hits.select("rule", "source", "timestamp", "event_id", "cooldown_minutes"), block_rows=7)
    batch = released(batch, hits)
    assert batch.count() > 0 and ids(live, "rule", "source", "event_id") == ids(batch, "rule", "source", "event_id")


def test_delta_state_spans_batches(spark, parts):
    live = jobs.drain(stateful.stream_delta(A.stream_messages_from(stream(spark, parts))), "t")
    sent = A.stream_messages_from(parts[1])
    entries = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("delta")))).alias("d")
    assert ids(live, "event_id", "type", entries) == ids(released(messages.delta_encode(sent), sent), "event_id", "type", entries)
    assert live.filter("size(removed) > 0").isEmpty()


def test_hot_key_out_of_order_in_chunks_and_late_rows(spark, monkeypatch):
    """One metric, five files that overlap by four minutes, read in chunks; then a late file."""
    rng = random.Random(2)
    schema = "event_id long, metric_name string, timestamp timestamp, value double"
    rows = [(i, None, T0 + timedelta(seconds=2 * i), None if i % 50 == 7 else float(rng.randrange(100))) for i in range(2000)]
    mixed = sorted(rows, key=lambda r: r[2] + timedelta(seconds=rng.randrange(240)))
    late = [(9000, None, T0, 1.0), (9001, None, T0 + timedelta(hours=2), 1.0)]
    files = [*(mixed[i : i + 400] for i in range(0, 2000, 400)), late[1:], late[:1], [(9002, None, T0 + timedelta(hours=3), 1.0)]]
    source = delivered(spark, "hot", files, schema)
    monkeypatch.setattr(stateful, "TAKE_ROWS", 100)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "150")
    try:
        path, check = stage_path(spark, "hot-out"), stage_path(spark, "hot-check")
        out = stateful.stream_baseline_anomaly(source, window=20, min_samples=5, limit=-1.0)
        query = jobs.start(out, path, check)
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert jobs.late_rows(query) == 1
    want, seen = {}, []
    for i, _, _, v in [*rows, late[1]]:
        seen.append(v)
        last = [x for x in seen[-20:] if x is not None]
        if v is not None and len(last) >= 5:
            want[i] = round(sum(last) / len(last), 6)
    assert {r.event_id: round(r.expected_value, 6) for r in spark.read.parquet(path).collect()} == want


def test_state_of_a_silent_key_goes(spark):
    schema = "event_id long, metric_name string, timestamp timestamp, value double"
    minutes = [list(range(10)), [200 + i for i in range(10)], [600]]
    files = [[(m, "a", T0 + timedelta(minutes=m), 5.0) for m in part] for part in minutes]
    files[0] += [(1000 + m, "b", T0 + timedelta(minutes=m), 5.0) for m in range(10)]
    check = stage_path(spark, "ttl-check")
    source = delivered(spark, "ttl", files, schema)
    out = stateful.stream_baseline_anomaly(source, min_samples=6, limit=-1.0, ttl_hours=1)
    got = jobs.run_available(out, stage_path(spark, "ttl-out"), check)
    # Six samples to begin with, and again after three silent hours.
    assert ids(got, "event_id") == [(i,) for i in [*range(5, 10), *range(205, 210), *range(1005, 1010)]]
    state = spark.read.format("statestore").option("stateVarName", "seen").load(check)
    assert state.isEmpty()


def test_cooldown_outlives_the_watermark_inside_a_slot(spark):
    """Rows wait in a slot of an hour while the watermark passes the end of a cooldown in it."""
    schema = "rule string, source string, timestamp timestamp, event_id long, severity string, message string, cooldown_minutes int"
    minutes = [55, 62, 70, 71, 80, 100, 300]
    rows = [[("r", "s", T0 + timedelta(minutes=m), m, "warning", "m", 20)] for m in minutes]
    source = delivered(spark, "slots", rows, schema)
    got = jobs.drain(stateful.stream_alert_cooldown(source, slot_seconds=3600), "t")
    assert ids(got, "event_id") == [(55,), (80,), (100,)]


def test_cooldown_of_zero_fires_at_every_breach(spark):
    schema = "rule string, source string, timestamp timestamp, event_id long, severity string, message string, cooldown_minutes int"
    rows = [("r", None, T0 + timedelta(minutes=i // 2), i, "warning", "m", 0) for i in range(20)]
    source = delivered(spark, "zero", [rows[:9], rows[9:], [("x", "y", T0 + timedelta(hours=1), 99, "warning", "m", 5)]], schema)
    got = jobs.drain(stateful.stream_alert_cooldown(source), "t")
    assert ids(got, "event_id") == [(i,) for i in range(20)]


def test_deltas_of_any_fields_decode_to_their_input(spark):
    """Fields come, go, change and are set to null; payloads are null or empty; five files."""
    rng = random.Random(5)
    schema = "event_id long, stream_name string, timestamp timestamp, data map<string,string>"

    def payload():
        if rng.random() < 0.05:
            return None
        return {f: rng.choice([None, "1", "2"]) for f in "abcdef" if rng.random() < 0.6}

    rows = [(i, rng.choice(["s", "t", None]), T0 + timedelta(seconds=20 * i), payload()) for i in range(300)]
    source = delivered(spark, "payloads", [rows[i : i + 60] for i in range(0, 300, 60)], schema)
    path = stage_path(spark, "encoded")
    encoded = jobs.run_available(stateful.stream_delta(source), path, stage_path(spark, "encoded-check"))
    again = spark.readStream.schema(encoded.schema).parquet(path)
    got = {r.event_id: r.data for r in jobs.drain(stateful.stream_delta_decode(again), "decoded").collect()}
    sent = {r[0]: r[3] for r in rows}
    assert len(got) > 250 and got == {i: sent[i] for i in got}
    full = {r.event_id: r.delta for r in encoded.filter("type = 'delta'").collect()}
    assert any(None in (d or {}).values() for d in full.values())
    assert any(len(d or {}) < len(sent[i] or {}) for i, d in full.items())


def test_a_stream_runs_on_until_it_is_stopped(spark, parts):
    routed = jobs.route_stream(A.stream_events_from(stream(spark, parts))).select("event_id", "processor")
    path = stage_path(spark, "on")
    query = jobs.start(routed, path, stage_path(spark, "on-check"), every="1 second")
    query.processAllAvailable()
    assert query.isActive
    query.stop()
    want = messages.event_routing(A.stream_events_from(parts[1]))
    assert ids(spark.read.parquet(path), "event_id", "processor") == ids(want, "event_id", "processor")


def test_routing_and_tiers(spark, parts):
    routed = jobs.drain(jobs.route_stream(A.stream_events_from(stream(spark, parts))), "t")
    assert ids(routed, "event_id", "processor") == ids(messages.event_routing(A.stream_events_from(parts[1])), "event_id", "processor")


def test_late_events_drop_past_the_watermark(spark):
    folder = stage_path(spark, "late")
    schema = "event_id long, event_type string, metric_type string, value double, timestamp timestamp"
    minutes = [[0, 1, 2], [30, 29], [31], [27, 3], [60]]
    for n, batch in enumerate(minutes):
        rows = [(n * 10 + i, "system_metric", "cpu", 1.0, T0 + timedelta(minutes=m)) for i, m in enumerate(batch)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    source = jobs.event_stream(spark, folder, schema, "*.parquet", max_files=1)
    got = jobs.drain(jobs.windowed_stream_agg(source, "1 minute"), "t")
    starts = {int((r.window_start - T0).total_seconds() // 60): r["count"] for r in got.collect()}
    # Spark drops late rows by the watermark of the batch before: 27 is within it, 3 is not.
    # The window of 60 is still open.
    assert starts == {0: 1, 1: 1, 2: 1, 27: 1, 29: 1, 30: 1, 31: 1}


def test_failing_processor_does_not_stop_the_others(spark, parts):
    processors = jobs.builtin_processors()

    def broken(df):
        raise ValueError("broken")

    processors.register("performance_calculator", broken)
    path = stage_path(spark, "runs")
    jobs.microbatch_process(A.stream_events_from(stream(spark, parts)), processors, path, stage_path(spark, "c"))
    runs = spark.read.parquet(f"{path}/runs")
    failed = {r.processor_name: r.f for r in runs.groupBy("processor_name").agg(F.bool_and("failed").alias("f")).collect()}
    assert failed == {"system_aggregator": False, "anomaly_detector": False, "performance_calculator": True, "alert_generator": False}
    assert runs.filter("failed").select("error").distinct().collect()[0].error == "ValueError: broken"
    assert runs.filter("not failed and error is not null").isEmpty()
    got = spark.read.parquet(f"{path}/anomaly_detector")
    want = anomaly.threshold_anomalies(A.stream_events_from(parts[1]))
    assert ids(got, "event_id", "severity") == ids(want, "event_id", "severity")


def test_rerun_of_a_batch_writes_nothing_twice(spark, parts):
    path, check = stage_path(spark, "outbox"), stage_path(spark, "outbox-check")
    for _ in range(2):
        jobs.alert_outbox(alerts.anomaly_to_alert(A.stream_events_from(stream(spark, parts))), path, check)
    want = parts[1].filter("event_type = 'error'").count()
    assert spark.read.parquet(path).count() == want


def test_store_takes_every_fifth_process_snapshot(spark, parts):
    ticks = stream(spark, parts).select(
        F.col("event_id").alias("tick"), F.col("ts").cast("timestamp").alias("timestamp"), "value", F.struct(F.col("value").alias("cpu")).alias("process")
    )
    root = stage_path(spark, "store")
    jobs.stream_store(ticks, root, stage_path(spark, "store-check"))
    n = parts[1].count()
    assert spark.read.parquet(f"{root}/metrics").count() == n
    assert spark.read.parquet(f"{root}/processes").count() == (n + 4) // 5


def test_processor_gets_another_try_and_fail_fast_repeats_the_batch(spark, parts):
    events, tries = A.stream_events_from(stream(spark, parts)), []

    def flaky(df):
        tries.append(1)
        if len(tries) == 1:
            raise ValueError("first try")
        return df.select("event_id")

    one = jobs.Processors()
    one.register("alert_generator", flaky)
    path = stage_path(spark, "flaky")
    jobs.microbatch_process(events, one, path, stage_path(spark, "c"))
    assert spark.read.parquet(f"{path}/runs").filter("failed").isEmpty()
    want = parts[1].filter("event_type = 'error'").count()
    assert spark.read.parquet(f"{path}/alert_generator").count() == want

    tries.clear()
    path, check = stage_path(spark, "strict"), stage_path(spark, "c")
    with pytest.raises(Exception, match="first try"):
        jobs.microbatch_process(events, one, path, check, attempts=1, fail_fast=True)
    # The batch was not committed: started again, the stream takes it from there.
    jobs.microbatch_process(events, one, path, check, attempts=1, fail_fast=True)
    assert spark.read.parquet(f"{path}/alert_generator").count() == want


def test_tiers_of_a_stream_that_is_stopped_and_started(spark, parts):
    from pulsegrid.sources import storage, versioned

    events = parts[1].select("event_id", F.col("ts").cast("timestamp").alias("timestamp"))
    as_of = events.agg(F.max("timestamp")).first()[0]
    current, old = (versioned.VersionedTable(spark, stage_path(spark, n)) for n in ("current", "old"))
    check = stage_path(spark, "c")
    for _ in range(2):
        rows = stream(spark, parts).select("event_id", F.col("ts").cast("timestamp").alias("timestamp"))
        jobs.tier_stream(rows, current, old, check, as_of)
    want = storage.tier_route(events, as_of)
    assert ids(current.read(), "event_id") == ids(want.filter("tier = 'current'"), "event_id")
    assert ids(old.read(), "event_id") == ids(want.filter("tier = 'historical'"), "event_id")
