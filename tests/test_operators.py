"""Edge cases on small hand-made tables."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.functions import columns as C
from pulsegrid.functions.distributions import t_two_sided
from pulsegrid.operators import alerts, anomaly, forecast, health, kpi, logs, messages, outliers, process, report, rollup, stats, timeseries, trends
from pulsegrid.sources import payloads, storage
from pulsegrid.plans.staging import stage_path

T0 = datetime(2024, 1, 1)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


# ---- statistics ----------------------------------------------------------------------


def test_constant_series(series):
    df = series(m=[5] * 60)
    s = one(stats.descriptive_stats(df))
    assert (s.count_ if hasattr(s, "count_") else s["count"]) == 60
    assert s["std"] == 0 and s["cv"] == 0 and s["mode"] == 5
    for fn in (outliers.outliers_iqr, outliers.outliers_zscore, outliers.outliers_modified_zscore):
        assert fn(df).count() == 0
    z = outliers.zscore_outliers(df)
    assert z.filter("z_score != 0 or is_outlier").count() == 0
    t = one(timeseries.linear_trend(df))
    assert t.slope == 0 and t.direction == "flat" and t.r_squared == 0
    assert forecast.short_horizon_predict(df).count() == 0


def test_short_series(series):
    df = series(one=[1], three=[1, 2, 3], nine=range(9), ten=range(10))
    assert {r.metric_name for r in stats.descriptive_stats(df).collect()} == {"three", "nine", "ten"}
    assert {r.metric_name for r in timeseries.linear_trend(df).collect()} == {"ten"}
    assert {r.metric_name for r in forecast.linear_forecast(df).collect()} == {"ten"}
    assert {r.metric_name for r in forecast.exp_smoothing_forecast(df).collect()} == {"ten"}
    assert forecast.seasonal_naive_forecast(df).count() == 0
    spikes = series(m=[1, 1, 100])
    assert outliers.outliers_iqr(spikes).count() == 0


def test_ramp_with_spike(series):
    df = series(m=[*range(1, 100), 10_000])
    for fn in (outliers.outliers_iqr, outliers.outliers_zscore, outliers.outliers_modified_zscore):
        assert [r.value for r in fn(df).collect()] == [10_000.0]
    assert [r.value for r in outliers.zscore_outliers(df).filter("is_outlier").collect()] == [10_000.0]
    hit = anomaly.composite_anomaly(df).filter("value = 10000").collect()
    assert len(hit) == 1 and hit[0].severity == "critical"


def test_mode_takes_the_lowest(series):
    assert one(stats.descriptive_stats(series(m=[2, 1, 1, 2, 3]))).mode == 1.0


def test_moments_equal_numpy(series):
    v = np.random.default_rng(3).gamma(2.0, size=200)
    s = one(stats.descriptive_stats(series(m=v)))
    d = v - v.mean()
    assert s.skewness == pytest.approx((d**3).mean() / (d**2).mean() ** 1.5)
    assert s.kurtosis == pytest.approx((d**4).mean() / (d**2).mean() ** 2 - 3)
    assert s.p95 == pytest.approx(np.percentile(v, 95))


def test_correlation_strength(spark):
    x = np.arange(50.0)
    noise = np.random.default_rng(0).normal(0, 1, 50)
    df = spark.createDataFrame([(float(a), float(-a), float(n)) for a, n in zip(x, noise)], "a double, b double, c double")
    m = stats.correlation_matrix(df, ["a", "b", "c"])
    strong = stats.significant_correlations(m).collect()
    assert [(r.metric1, r.metric2, r.strength) for r in strong] == [("a", "b", "strong")]
    assert one(stats.correlation_summary(m)).strong_correlations == 1


def test_positional_align_cuts_to_the_shortest(series):
    rows = stats.positional_align(series(a=range(10), b=range(4)), ["a", "b", "missing"])
    assert rows.columns == ["pos", "a", "b"] and rows.count() == 4


def test_timestamp_align_keeps_unmatched(series):
    df = series(a=[1, 2, 3], b=[4])
    rows = {r.timestamp: (r.a, r.b) for r in stats.timestamp_align(df, ["a", "b"]).collect()}
    assert rows[T0] == (1.0, 4.0) and rows[T0 + timedelta(minutes=2)] == (3.0, None)


# ---- trends and windows --------------------------------------------------------------


def test_p_value_known_points():
    # Two-sided tails of Student's t from published tables.
    assert t_two_sided(2.228, 10) == pytest.approx(0.05, abs=2e-4)
    assert t_two_sided(2.576, 1e7) == pytest.approx(0.01, abs=1e-4)
    assert t_two_sided(0.0, 5) == pytest.approx(1.0)
    assert t_two_sided(12.706, 1) == pytest.approx(0.05, abs=1e-4)


def test_trend_of_a_line(series):
    t = one(timeseries.linear_trend(series(m=[3 + 2 * i for i in range(20)])))
    assert t.slope * 60 == pytest.approx(2) and t.direction == "increasing" and t.strength == "strong"


def test_daily_season(series):
    v = [50 + 30 * np.sin(2 * np.pi * h / 24) for h in range(24 * 7)]
    df = series(step=timedelta(hours=1), m=v)
    s = one(timeseries.seasonality_strength(df))
    assert s.present
    f = forecast.seasonal_naive_forecast(df, 24, 30).orderBy("step").collect()
    assert [r.forecast for r in f] == pytest.approx(v[:24] + v[:6], abs=1e-9)
    assert [r.seasonal_index for r in f[:24]] == pytest.approx(v[:24], abs=1e-9)
    assert not one(timeseries.seasonality_strength(df.limit(24))).present


def test_smoothing_equals_the_recursion(series):
    v = np.random.default_rng(5).normal(50, 10, 400)
    want = [v[0]]
    for x in v[1:]:
        want.append(0.3 * x + 0.7 * want[-1])
    got = timeseries.exponential_smoothing(series(m=v), 0.3).orderBy("timestamp").collect()
    assert [r.smoothed for r in got] == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("block", [40, 100_000])
def test_rolling_blocks(series, block):
    v = np.random.default_rng(6).normal(size=300)
    got = timeseries.rolling_mean_std(series(m=v), block_rows=block).orderBy("timestamp").collect()
    assert [r.rolling_mean for r in got[:29]] == [None] * 29
    want = [v[i - 29 : i + 1].mean() for i in range(29, 300)]
    assert [r.rolling_mean for r in got[29:]] == pytest.approx(want)


def test_stationarity(series):
    noise = np.random.default_rng(7).normal(50, 1, 500)
    walk = 50 + np.cumsum(np.random.default_rng(8).normal(0, 1, 500))
    rows = {r.metric_name: r for r in timeseries.stationarity_df(series(noise=noise, walk=walk)).collect()}
    assert rows["noise"].is_stationary and not rows["walk"].is_stationary
    simple = {r.metric_name: r for r in timeseries.stationarity_simple(series(short=range(13))).collect()}
    assert not simple["short"].is_stationary


def test_counter_rate_skips_equal_times(spark):
    rows = [(1, "a", T0, 0), (2, "a", T0, 50), (3, "a", T0 + timedelta(seconds=10), 150), (4, "b", T0, 7)]
    df = spark.createDataFrame(rows, "event_id long, source string, timestamp timestamp, bytes long")
    got = timeseries.counter_rate(df, ["bytes"]).collect()
    assert [(r.event_id, r.bytes_per_sec) for r in got] == [(3, 10.0)]


def test_downsample_keeps_short_series(series):
    df = series(short=range(100), long=range(101))
    got = timeseries.downsample_every_n(df, "1hour").groupBy("metric_name").count().collect()
    assert {r.metric_name: r["count"] for r in got} == {"short": 100, "long": 2}


def test_capacity_exhaustion(spark):
    hours = [T0 + timedelta(hours=h) for h in range(720)]
    rows = [(i, t, "cpu", "cpu_percent", 40 + 54 * i / 719) for i, t in enumerate(hours)]
    rows += [(i, t, "disk", "disk_percent", 20.0) for i, t in enumerate(hours)]
    df = spark.createDataFrame(rows, "event_id long, timestamp timestamp, metric_type string, metric_name string, value double")
    got = {r.metric_type: r for r in forecast.capacity_forecast(df).collect()}
    cpu, disk = got["cpu"], got["disk"]
    # 94 percent at the end, one percent to go at 54/719 per hour.
    assert cpu.days_to_exhaustion == pytest.approx(round(13 / 24, 1)) and cpu.risk_level == "critical"
    assert not cpu.capacity_sufficient and len(cpu.recommendations) == 4
    assert disk.days_to_exhaustion is None and disk.risk_level == "low" and disk.recommendations == []


def test_metric_report_is_complete(series):
    df = series(step=timedelta(hours=1), long=[50 + (i % 24) for i in range(60)], short=range(12), tiny=range(9))
    rows = {r.metric_name: r for r in report.metric_report(df, hours=None).collect()}
    assert set(rows) == {"long", "short"}
    assert len(rows["long"].seasonal_forecast) == 12 and rows["short"].seasonal_forecast is None
    assert len(rows["long"].linear_forecast) == 24 and rows["long"].p_value is not None


# ---- anomalies and alerts ------------------------------------------------------------


def test_anomaly_needs_fifty_samples(series):
    assert anomaly.composite_anomaly(series(cpu_percent=[99] * 49)).count() == 0
    assert anomaly.composite_anomaly(series(cpu_percent=[99] * 51)).count() == 2


def breaches(spark, minutes, cooldown=5, source="h"):
    rows = [("r", source, T0 + timedelta(minutes=m), i, cooldown) for i, m in enumerate(minutes)]
    return spark.createDataFrame(rows, "rule string, source string, timestamp timestamp, event_id long, cooldown_minutes int")


@pytest.mark.parametrize("block", [1, 2, 3, 100])
def test_breach_burst(spark, block):
    got = alerts.alert_cooldown(breaches(spark, [0, 1, 4, 6, 11]), block_rows=block)
    assert sorted(r.event_id for r in got.collect()) == [0, 3, 4]


@pytest.mark.parametrize("block_rows", [7, 60, 100_000])
def test_cooldown_over_blocks_and_null_keys(spark, block_rows):
    """Ways over many blocks; blocks shorter and longer than a cooldown; null parts of keys."""
    rng, start, rows = random.Random(4), datetime(2024, 1, 1), []
    for rule, source, n, span, minutes in [("a", "x", 400, 4000, 5), ("a", None, 300, 9000, 5), (None, None, 200, 60, 1), ("b", "x", 3, 1, 0)]:
        rows += [(rule, source, start + timedelta(seconds=rng.randrange(span)), len(rows) + i, minutes) for i in range(n)]
    want, last = set(), {}
    for rule, source, ts, event, minutes in sorted(rows, key=lambda r: (r[2], r[3])):
        before = last.get((rule, source))
        if before is None or ts - before >= timedelta(minutes=minutes):
            want.add(event)
            last[(rule, source)] = ts
    schema = "rule string, source string, timestamp timestamp, event_id long, cooldown_minutes int"
    got = alerts.alert_cooldown(spark.createDataFrame(rows, schema), block_rows=block_rows)
    assert sorted(r["event_id"] for r in got.collect()) == sorted(want)


def test_process_tree_of_a_chain_with_cycles_and_orphans(spark):
    rows = [(i, i - 1 if i > 1 else None, f"n{i}", "s") for i in range(1, 80)]
    rows += [(100, 101, "c", "s"), (101, 100, "c", "s"), (102, 100, "c", "s"), (200, 30, None, None), (300, 999, "o", "s"), (None, 1, "x", "s")]
    table = spark.createDataFrame(rows, "pid int, parent_pid int, name string, status string")
    got = {r["pid"]: (r["depth"], r["path"]) for r in process.process_tree(table, 1).collect()}
    want = {i: (i - 1, list(range(1, i + 1))) for i in range(1, 80)} | {200: (30, [*range(1, 31), 200])}
    assert got == want
    assert process.process_tree(table, 12345).count() == 0


def test_cooldown_is_per_source(spark):
    both = breaches(spark, [0, 1], source="a").unionByName(breaches(spark, [0.5, 2], source="b"))
    assert alerts.alert_cooldown(both).count() == 2
    assert alerts.alert_cooldown(both.withColumn("event_id", F.xxhash64("source", "event_id")), keys=["rule"]).count() == 1


def test_disabled_rule_never_matches(spark, series):
    rules = alerts.rule_table(spark, [("on", "m", ">", 1, "warning", 5), ("off", "m", ">", 1, "warning", 5, False)])
    assert {r.rule for r in alerts.rule_match(series(m=[5]), rules).collect()} == {"on"}


def test_acknowledge_after_resolve_is_ignored(spark):
    rows = [
        ("a", "trigger", 0), ("a", "resolve", 10), ("a", "acknowledge", 20),
        ("b", "trigger", 0), ("b", "acknowledge", 5), ("c", "resolve", 1),
    ]
    log = spark.createDataFrame(
        [(i, "m", 1.0, "warning", "h", "u", a, T0 + timedelta(minutes=t)) for i, a, t in rows],
        "alert_id string, metric_name string, value double, severity string, source string, actor string, action string, timestamp timestamp",
    )
    got = {r.alert_id: r for r in alerts.alert_lifecycle(log).collect()}
    assert set(got) == {"a", "b"}
    assert got["a"].resolved and not got["a"].acknowledged
    assert got["b"].acknowledged and not got["b"].resolved


def test_actions_of_an_alert_need_only_its_id(spark):
    rows = [
        ("a", "m", 1.0, "warning", "h", None, "trigger", T0),
        ("a", None, None, None, None, "ann", "acknowledge", T0 + timedelta(minutes=5)),
        ("a", None, None, None, None, "bo", "resolve", T0 + timedelta(minutes=9)),
    ]
    log = spark.createDataFrame(
        rows,
        "alert_id string, metric_name string, value double, severity string, source string, actor string, action string, timestamp timestamp",
    )
    (got,) = alerts.alert_lifecycle(log).collect()
    assert (got.metric_name, got.value, got.severity, got.source) == ("m", 1.0, "warning", "h")
    assert got.acknowledged and got.acknowledged_by == "ann" and got.resolved


# ---- messages ------------------------------------------------------------------------


def test_delta_roundtrip_over_blocks(spark):
    data = [{"a": "1", "b": "x"}, {"a": "1", "b": "y"}, {"a": "2", "b": "y", "c": "new"}, {"a": "2", "b": "y", "c": None}]
    rows = [(i, "s", T0 + timedelta(seconds=i), m) for i, m in enumerate(data)]
    df = spark.createDataFrame(rows, "event_id long, stream_name string, timestamp timestamp, data map<string,string>")
    enc = messages.delta_encode(df, block_rows=2).orderBy("event_id").collect()
    assert [r.type for r in enc] == ["full", "delta", "delta", "delta"]
    assert [r.delta for r in enc[1:]] == [{"b": "y"}, {"a": "2", "c": "new"}, {"c": None}]
    encoded = messages.delta_encode(df).drop("data")
    dec = messages.delta_decode(encoded, ["a", "b", "c"], block_rows=1).orderBy("event_id").collect()
    assert [(r.a, r.b, r.c) for r in dec] == [("1", "x", None), ("1", "y", None), ("2", "y", "new"), ("2", "y", None)]


def test_full_message_resets_the_state(spark):
    rows = [
        (0, "s", T0, "full", {"a": "1", "b": "2"}),
        (1, "s", T0 + timedelta(seconds=1), "full", {"a": "9"}),
        (2, "s", T0 + timedelta(seconds=2), "delta", {}),
    ]
    df = spark.createDataFrame(rows, "event_id long, stream_name string, timestamp timestamp, type string, delta map<string,string>")
    dec = messages.delta_decode(df, ["a", "b"], block_rows=2).orderBy("event_id").collect()
    assert [(r.a, r.b) for r in dec] == [("1", "2"), ("9", None), ("9", None)]


def test_unrouted_events_drop(spark):
    df = spark.createDataFrame([(1, "system_metric"), (2, "other")], "event_id int, event_type string")
    assert messages.event_routing(df).count() == 2


# ---- storage -------------------------------------------------------------------------

TICK = "timestamp timestamp, cpu struct<usage_percent:double>, memory struct<usage_percent:double>, disk struct<total_usage_percent:double>, network struct<sent_rate_kbps:double,recv_rate_kbps:double>"


def test_store_and_retrieve(spark):
    now = datetime(2024, 3, 10, 12)
    tick = lambda ts, cpu: (ts, (cpu,), (50.0,), (50.0,), (1024.0, 2048.0))
    path = stage_path(spark, "t")
    rows = [tick(now, 45.5), tick(now - timedelta(days=2), 10.0), tick(now - timedelta(days=10), 5.0)]
    storage.append_table(storage.metric_snapshot_rows(spark.createDataFrame(rows, TICK)), path)
    table = spark.read.parquet(path)
    assert table.count() == 12
    schema = T.StructType([T.StructField("usage_percent", T.DoubleType())])
    got = storage.historical_scan(table, "cpu", schema, hours=24, as_of=now).collect()
    assert [r.payload.usage_percent for r in got] == [45.5]
    kept = storage.retention_cleanup(spark, path, now, days=7)
    assert kept.count() == 8
    assert storage.retention_cleanup(spark, path, now, days=1).count() == 4


def test_retention_cuts_inside_a_date(spark, series):
    path = stage_path(spark, "t")
    storage.append_table(series(step=timedelta(hours=1), m=range(48)), path)
    kept = storage.retention_cleanup(spark, path, datetime(2024, 1, 8, 12), days=7)
    assert kept.count() == 36 and kept.agg(F.min("timestamp")).first()[0] == datetime(2024, 1, 1, 12)


def test_malformed_processes_drop(spark):
    rows = [
        ('{"pid": 1234, "name": "python", "cpu_percent": 15.5, "memory_mb": "256.0"}',),
        ('{"pid": "invalid", "name": null, "cpu_percent": "high"}',),
        ('{"pid": 7, "cpu_percent": null}',),
        ("{broken",),
        ("{}",),
    ]
    got = storage.clean_process_snapshots(spark.createDataFrame(rows, "record string")).orderBy("pid").collect()
    assert [(r.pid, r.cpu_percent, r.memory_mb) for r in got] == [(0, 0.0, 0.0), (1234, 15.5, 256.0)]


def test_incremental_is_idempotent_and_takes_ties(spark, series):
    path = stage_path(spark, "t")
    df = series(m=range(10))
    storage.incremental_load(spark, df.limit(6), path, row_id=["event_id"])
    tie = spark.createDataFrame([(99, T0 + timedelta(minutes=5), "m", 1.0)], df.schema)
    for _ in range(2):
        out = storage.incremental_load(spark, df.unionByName(tie), path, row_id=["event_id"])
    assert sorted(r.event_id for r in out.collect()) == [*range(10), 99]


def test_cdc_log(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, v string")
    log = [
        (1, "a1", "update", 1), (2, None, "delete", 2), (4, "d", "insert", 3), (4, None, "delete", 4),
        (5, None, "delete", 5), (5, "e", "insert", 6), (1, "a1", "update", 1),
    ]
    changes = spark.createDataFrame(log, "id int, v string, op string, seq int")
    got = storage.cdc_apply(base, changes, ["id"], ["seq"])
    want = [(1, "a1"), (3, "c"), (5, "e")]
    assert sorted(tuple(r) for r in got.collect()) == want
    again = storage.cdc_apply(got, changes, ["id"], ["seq"])
    assert sorted(tuple(r) for r in again.collect()) == want


def test_wide_export_takes_the_first_and_leaves_gaps(spark):
    rows = [
        (1, T0, "cpu", '{"usage_percent": 1.0}'), (2, T0, "cpu", '{"usage_percent": 2.0}'),
        (3, T0, "memory", '{"usage_percent": 3.0, "total": 17179869184}'),
        (4, T0 + timedelta(seconds=1), "network", '{"recv_rate_kbps": 4.0}'), (5, T0, "cpu", "{bad"),
    ]
    df = spark.createDataFrame(rows, "event_id long, timestamp timestamp, metric_type string, data string")
    got = storage.export_wide(df).orderBy("timestamp").collect()
    assert tuple(got[0])[1:] == (1.0, 3.0, 16.0, None, None)
    assert tuple(got[1])[1:] == (None, None, None, None, 4.0)


def test_json_extraction_falls_back_and_skips(spark):
    rows = [
        (1, "disk", '{"total_usage_percent": 1}'), (2, "disk", '{"usage_percent": 2}'), (3, "disk", "{}"),
        (4, "network", '{"recv_rate_kbps": "5"}'), (5, "cpu", "{}"), (6, "cpu", '{"usage_percent": null}'), (7, "cpu", "nope"),
    ]
    df = spark.createDataFrame(rows, "event_id long, metric_type string, data string").withColumn("timestamp", F.lit(T0))
    got = {r.event_id: r.value for r in trends.extract_json_metric(df).collect()}
    assert got == {1: 1.0, 2: 2.0, 4: 5.0, 5: 0.0}


def test_empty_trends_are_zero(spark):
    df = spark.createDataFrame([(1, "disk", "{}", T0)], "event_id long, metric_type string, data string, timestamp timestamp")
    assert tuple(one(trends.cpu_trends(df))) == (0.0, 0.0, 0.0, 0)


def test_device_payload_defaults(spark):
    rows = [(1, "d", T0, '{"sensors": [{}]}'), (2, "d", T0, '{"light": "7", "other": 1}'), (3, "d", T0, None)]
    df = spark.createDataFrame(rows, "event_id long, device_id string, timestamp timestamp, payload string")
    got = [(r.sensor_type, r.value, r.unit, r.quality_score) for r in payloads.flatten_device_payload(df).orderBy("event_id").collect()]
    assert got == [("unknown", 0.0, "", 1.0), ("light", 7.0, "lux", 1.0)]


# ---- health, KPIs, logs, processes ---------------------------------------------------


def events(spark, rows):
    return spark.createDataFrame(
        [(T0 - timedelta(minutes=m), s) for m, s in rows], "timestamp timestamp, severity string"
    )


def test_kpis_without_rows(spark, series):
    none = series(m=[1]).limit(0).withColumn("metric_type", F.lit("x"))
    no_events = events(spark, [(1, "info")]).limit(0)
    got = {r.kpi_name: (r.value, r.status) for r in kpi.dashboard_kpis(none, no_events, 24, T0).collect()}
    assert got["system_availability"] == (100.0, "excellent") and got["error_rate"] == (0.0, "excellent")
    assert got["cpu_efficiency"] == (50.0, "fair") and got["capacity_utilization"] == (50.0, "fair")
    assert got["average_response_time"] == (1.0, "good")


def test_availability_counts_errors(spark):
    e = events(spark, [(1, "error"), (2, "critical"), (3, "info"), (60 * 30, "error")])
    got = one(kpi.calculate_kpi("system_availability", e, e, 24, T0))
    assert got.value == round((1440 - 10) / 1440 * 100, 2) and got.status == "good"


def test_executive_advice(spark):
    rows = [("cpu_efficiency", "critical"), ("error_rate", "critical"), ("capacity_utilization", "warning"), ("memory_efficiency", "good")]
    got = one(kpi.executive_dashboard(spark.createDataFrame(rows, "kpi_name string, status string")))
    assert got.overall_health_score == round((20 + 20 + 50 + 80) / 4, 1)
    assert got.recommendations[0] == kpi.MANY_CRITICAL and len(got.recommendations) == 4


def test_overall_health_statuses(spark, series):
    df = series(cpu_percent=[95], disk_percent=[10]).withColumn("metric_type", F.split("metric_name", "_")[0])
    scored = health.metric_health(df, hours=1)
    by = {r.metric_type: r for r in scored.collect()}
    assert by["cpu"].score == 0 and by["cpu"].status == "critical" and by["cpu"].alert == "Critical cpu usage: 95.0%"
    assert by["disk"].score == 100 and by["disk"].alert is None
    assert one(health.overall_health(scored)).overall_status == "fair"


def test_rollup_levels_agree(series):
    df = series(step=timedelta(minutes=10), m=range(500)).withColumn("metric_type", F.lit("cpu"))
    got = rollup.rollup_metrics(df)
    sums = {r.aggregation_level: r.s for r in got.groupBy("aggregation_level").agg(F.sum("sum_value").alias("s")).collect()}
    assert set(sums) == {"hour", "day", "week", "month"} and len(set(sums.values())) == 1
    near = rollup.rollup_metrics(df, ["month"], approx=True).first()
    assert near.percentile_95 == pytest.approx(474, abs=1)


def test_olap_missing_column(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    with pytest.raises(ValueError, match="missing"):
        rollup.olap_cube_fetch(df, ["a"], ["z"])


def test_process_tree_guards_cycles(spark):
    rows = [(1, 1), (2, 1), (3, 2), (4, 3), (9, 8), (3, 2)]
    rows = list(dict.fromkeys(rows)) + [(1, 4)]
    df = spark.createDataFrame([(p, q, "n", "s") for p, q in rows], "pid long, parent_pid long, name string, status string")
    got = process.process_tree(df.filter("not (pid = 1 and parent_pid = 4)"), 1)
    assert {r.pid: r.depth for r in got.collect()} == {1: 0, 2: 1, 3: 2, 4: 3}
    assert process.process_tree(df, 9).count() == 1


def test_process_tree_has_no_depth_limit(spark):
    chain = spark.range(1, 81).selectExpr("id AS pid", "id - 1 AS parent_pid", "'n' AS name", "'s' AS status")
    got = process.process_tree(chain, 1)
    assert got.count() == 80 and got.agg(F.max("depth")).first()[0] == 79


def test_top_and_dedupe(spark):
    rows = [(1, "a", 50.0, 1), (1, "a", 90.0, 2), (2, "b", 90.0, 1), (3, "c", 10.0, 1)]
    df = spark.createDataFrame(rows, "pid long, name string, cpu_percent double, t int")
    assert [r.pid for r in process.top_processes(df, "cpu_percent", 2).collect()] == [1, 2]
    assert {r.pid: r.cpu_percent for r in process.dedupe_pids(df, ["t"]).collect()} == {1: 50.0, 2: 90.0, 3: 10.0}
    with pytest.raises(ValueError):
        process.sort_processes(df, "nothing")


def test_quality_logs(spark):
    rows = [
        (1, 1, "coverage report", "a 1 2 50%\nTOTAL 100 25 75%\n"), (1, 2, "pytest", "3 passed, x failed\n== 5 passed, 2 failed in 1s =="),
        (1, 3, "safety check", '[{"a": 1}, {"b": 2}]'), (1, 4, "pylint", "Your code has been rated at 8.50/10"),
        (1, 5, "bandit", '{"results": [{"issue_severity": "HIGH"}]}'), (1, 6, "flake8", "x.py:1: bad\n\nok"), (1, 7, "make", "all"),
        (1, 8, "bandit", "plain Issue: text"),
    ]
    df = spark.createDataFrame(rows, "run_id int, step_id int, command string, stdout string")
    got = {(r.step_id, r.metric): r.value for r in logs.quality_log_metrics(df).collect()}
    assert got[(1, "coverage_percentage")] == 75 and got[(4, "pylint_score")] == 8.5
    assert got[(2, "tests_passed")] == 5 and got[(2, "tests_failed")] == 2 and got[(2, "tests_total")] == 7
    assert got[(3, "security_issues")] == 2 and got[(5, "security_high_issues")] == 1 and got[(6, "flake8_issues")] == 1
    assert got[(8, "security_issues")] == 0 and not any(s == 7 for s, _ in got)
    gates = {r.gate: r for r in logs.quality_gates(logs.quality_log_metrics(df)).collect()}
    assert gates["code_coverage"].status == "failed" and gates["code_quality_score"].status == "passed"
    assert {g.overall_status for g in gates.values()} == {"failed"}


def test_ping_without_replies(spark):
    df = spark.createDataFrame([(1, "timeout"), (2, "x time=3.5 ms\ny time=1ms")], "run_id int, output string")
    got = {r.run_id: r for r in logs.ping_latency_stats(df).collect()}
    assert got[1].packet_loss_percent == 100 and got[1].min_ms is None
    assert (got[2].min_ms, got[2].max_ms, got[2].avg_ms, got[2]["count"]) == (1.0, 3.5, 2.25, 2)


def test_column_rules(spark):
    df = spark.createDataFrame([(0,), (1023,), (1024,), (1536,), (10**15,), (2 * 10**18,)], "b long")
    got = [r[0] for r in df.select(C.format_bytes(F.col("b"))).collect()]
    assert got == ["0.0 B", "1023.0 B", "1.0 KB", "1.5 KB", "909.5 TB", "1776.4 PB"]
    v = spark.createDataFrame([(-1.0,), (50.0,), (101.0,), (None,)], "v double")
    assert [r[0] for r in v.select(C.validated_percent(F.col("v"))).collect()] == [0.0, 50.0, 0.0, 0.0]
    nested = spark.createDataFrame([(({"x": 1.239},), [1.555, 2.0], None)], "s struct<m:map<string,double>>, a array<double>, n struct<z:int>")
    r = one(C.sanitize_numeric(nested, ["s", "a", "n"]))
    assert r.s.m == {"x": 1.24} and r.a == [1.56, 2.0] and r.n is None


# ---- null keys -----------------------------------------------------------------------


def test_a_null_key_is_a_key_like_any_other(spark):
    """The same series under a name and under none gives the same numbers."""
    start = datetime(2024, 1, 1)
    values = [50.0 + (i % 24) + (300 if i == 77 else 0) for i in range(240)]
    rows = [(k * 1000 + i, start + timedelta(hours=i), name, v) for k, name in enumerate(["a", None]) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "event_id long, timestamp timestamp, metric_name string, value double")
    keys, order = ["metric_name"], ["timestamp", "event_id"]
    shared = {
        "smoothing": timeseries.exponential_smoothing(df, 0.3, "s", "value", keys, order),
        "seasonal": forecast.seasonal_naive_forecast(df, 24, 30, keys=keys),
        "mae": forecast.linear_model_info(df, keys),
        "zscore": outliers.zscore_outliers(df, keys=keys),
        "iqr": outliers.outliers_iqr(df, keys=keys),
        "modified": outliers.outliers_modified_zscore(df, keys=keys),
        "stats": stats.descriptive_stats(df, keys),
        "summary": stats.summary_stats(df, keys),
    }
    for name, out in shared.items():
        got = {"a": [], None: []}
        for r in out.drop("event_id", "indices").collect():
            r = r.asDict()
            got[r.pop("metric_name")].append(str(sorted(r.items(), key=str)))
        assert sorted(got["a"]) == sorted(got[None]) and got["a"], name


def test_incremental_load_takes_late_rows_and_ties(spark):
    rows = [(1, T0, 1.0), (2, T0 + timedelta(hours=5), 2.0), (2, T0 + timedelta(hours=5), 2.0)]
    late = [(3, T0 + timedelta(hours=1), 3.0), (4, T0 + timedelta(hours=5), None), (5, T0 + timedelta(hours=9), 5.0)]
    schema = "event_id long, timestamp timestamp, value double"
    path = stage_path(spark, "late-rows")
    storage.incremental_load(spark, spark.createDataFrame(rows[:2], schema), path)
    for _ in range(2):
        out = storage.incremental_load(spark, spark.createDataFrame(rows + late, schema), path)
        assert sorted(r["event_id"] for r in out.collect()) == [1, 2, 2, 3, 4, 5]
    very_late = spark.createDataFrame([(6, T0 - timedelta(days=1), 6.0), (7, T0 + timedelta(hours=8), 7.0)], schema)
    out = storage.incremental_load(spark, very_late, path, row_id=["event_id"], lateness=timedelta(hours=3))
    assert sorted(r["event_id"] for r in out.collect()) == [1, 2, 2, 3, 4, 5, 7]


def test_correlations_of_many_columns(spark):
    rng = np.random.default_rng(3)
    x = 1e6 + rng.normal(size=(300, 200)).cumsum(axis=1)
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 7] = 4.0
    names = [f"m{i}" for i in range(x.shape[1])]
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in x]
    wide = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(3)
    got = {(r["metric1"], r["metric2"]): r["correlation"] for r in stats.correlation_matrix(wide, names).collect()}
    assert len(got) == 200 * 199 // 2
    for i, j in [(0, 1), (3, 150), (198, 199), (20, 21)]:
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        assert abs(got[(names[i], names[j])] - np.corrcoef(x[both, i], x[both, j])[0, 1]) < 1e-9
    assert got[("m6", "m7")] is None


@pytest.mark.parametrize("block_rows", [7, 50_000])
def test_sliding_order_statistics_by_hand(spark, series, block_rows):

    rng = np.random.default_rng(3)
    values = [None if rng.random() < 0.1 else float(rng.integers(0, 9)) for _ in range(60)]
    df = series(a=values, b=[4.1] * 20)
    out = {r.event_id: r for r in anomaly.baseline_stats(df, window=10, block_rows=block_rows).collect()}
    seen = 0
    for i in range(60):
        frame = [v for v in values[max(0, i - 9) : i + 1] if v is not None]
        if len(frame) < 3:
            assert i not in out
            continue
        r, seen = out[i], seen + 1
        want = [np.mean(frame), np.std(frame), *np.quantile(frame, [0.25, 0.5, 0.75]), min(frame), max(frame)]
        assert [r["mean"], r["std"], r.q1, r.median, r.q3, r["min"], r["max"]] == pytest.approx(want)
        assert r.samples == len(frame)
    flat = [r for i, r in out.items() if i >= 60]
    assert len(flat) == 18 and all(r["std"] == 0 and r["mean"] == 4.1 for r in flat)
    assert len(out) == seen + 18


def test_stream_stats_report_the_buffer(spark):
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1)
    rows = [("a", t0 + timedelta(seconds=i)) for i in range(12)] + [("b", t0), (None, t0)]
    df = spark.createDataFrame(rows, "stream_name string, timestamp timestamp")
    got = {r.stream_name: r for r in messages.stream_stats(df, buffer_size=10).collect()}
    assert {k: (r.messages_processed, r.current_buffer_size) for k, r in got.items()} == {"a": (12, 10), "b": (1, 1), None: (1, 1)}
    assert got["a"].last_message_time == t0 + timedelta(seconds=11)
