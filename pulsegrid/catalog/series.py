"""Windows, outliers, trends and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.catalog import sqlparts as S
from pulsegrid.catalog.registry import Registry, joined_lists, r6, rounded
from pulsegrid.catalog.sqlparts import r, with_
from pulsegrid.operators import forecast, outliers, timeseries
from pulsegrid.sources import adapters as A

Q = Registry()
W = "PARTITION BY metric_name ORDER BY timestamp, event_id"
M = ["event_id", "timestamp", "metric_name", "value"]


def _metrics(spark, d):
    return A.metrics_long(spark, d).select(*M)


def _raw(spark, d):
    return A.raw_metrics(spark, d).select(*M)


ROLL = """rolled AS (SELECT event_id, timestamp, metric_name, value,
  CASE WHEN count(*) OVER w = {n} THEN avg(value) OVER w END AS rolling_mean,
  CASE WHEN count(*) OVER w = {n} THEN stddev_samp(value) OVER w END AS rolling_std
  FROM metrics_long WINDOW w AS (PARTITION BY metric_name ORDER BY timestamp, event_id ROWS BETWEEN {b} PRECEDING AND CURRENT ROW))"""


@Q.add(
    "rolling_mean_std",
    with_(S.METRICS, ROLL.format(n=30, b=29))
    + f"SELECT event_id, metric_name, {r('rolling_mean')} AS rolling_mean, {r('rolling_std')} AS rolling_std FROM rolled",
)
def rolling_mean_std(spark, d):
    out = timeseries.rolling_mean_std(_metrics(spark, d))
    return rounded(out.select("event_id", "metric_name", "rolling_mean", "rolling_std"))


@Q.add(
    "rolling_features",
    with_(S.METRICS, ROLL.format(n=10, b=9))
    + f"""SELECT event_id, metric_name, {r('value')} AS value, {r('rolling_mean')} AS rolling_mean, {r('rolling_std')} AS rolling_std,
  CAST(hour(timestamp) AS INTEGER) AS hour, CAST(isodow(timestamp) - 1 AS INTEGER) AS day_of_week FROM rolled WHERE rolling_mean IS NOT NULL""",
)
def rolling_features(spark, d):
    return rounded(timeseries.rolling_features(_metrics(spark, d)).drop("timestamp"))


@Q.add(
    "lag_features",
    with_(S.METRICS)
    + f"""SELECT event_id, metric_name, value, lag_1, lag_2, lag_3, lag_5, lag_10, target, CAST(hour(timestamp) AS INTEGER) AS hour,
  CAST(isodow(timestamp) - 1 AS INTEGER) AS day_of_week, CASE WHEN isodow(timestamp) >= 6 THEN 1 ELSE 0 END AS is_weekend
FROM (SELECT *, lag(value, 1) OVER ({W}) AS lag_1, lag(value, 2) OVER ({W}) AS lag_2, lag(value, 3) OVER ({W}) AS lag_3,
  lag(value, 5) OVER ({W}) AS lag_5, lag(value, 10) OVER ({W}) AS lag_10, lead(value, 5) OVER ({W}) AS target FROM metrics_long)
WHERE lag_10 IS NOT NULL AND target IS NOT NULL""",
)
def lag_features(spark, d):
    return timeseries.lag_features(_metrics(spark, d), 5).drop("timestamp")


ZS = """st AS (SELECT metric_name, avg(value) AS m, stddev_samp(value) AS s, stddev_pop(value) AS p, median(value) AS md,
  quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM metrics_long GROUP BY 1)"""


@Q.add(
    "zscore_outliers",
    with_(S.RAW, ZS)
    + f"SELECT event_id, metric_name, {r('(value - m) / s')} AS z_score, abs((value - m) / s) > 3 AS is_outlier FROM metrics_long JOIN st USING (metric_name)",
)
def zscore_outliers(spark, d):
    out = outliers.zscore_outliers(_raw(spark, d))
    return rounded(out.select("event_id", "metric_name", "z_score", "is_outlier"))


@Q.add(
    "outliers_zscore",
    with_(S.RAW, ZS) + "SELECT event_id, metric_name, value FROM metrics_long JOIN st USING (metric_name) WHERE abs((value - m) / p) > 2",
)
def outliers_zscore(spark, d):
    return outliers.outliers_zscore(_raw(spark, d)).select("event_id", "metric_name", "value")


IQR = "value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)"


@Q.add(
    "outliers_iqr",
    with_(S.RAW, ZS) + f"SELECT event_id, metric_name, value FROM metrics_long JOIN st USING (metric_name) WHERE {IQR}",
)
def outliers_iqr(spark, d):
    return outliers.outliers_iqr(_raw(spark, d)).select("event_id", "metric_name", "value")


@Q.add(
    "outlier_summary",
    with_(S.RAW, ZS)
    + f"""SELECT metric_name, count(*) FILTER (WHERE {IQR}) AS outlier_count, {r(f'count(*) FILTER (WHERE {IQR}) * 100.0 / count(*)')} AS outlier_percentage
FROM metrics_long JOIN st USING (metric_name) GROUP BY metric_name""",
)
def outlier_summary(spark, d):
    m = _raw(spark, d)
    return rounded(outliers.outlier_summary(m, outliers.outliers_iqr(m)))


@Q.add(
    "outliers_modified_zscore",
    with_(S.RAW, ZS)
    + """, dev AS (SELECT metric_name, median(abs(value - md)) AS mad FROM metrics_long JOIN st USING (metric_name) GROUP BY 1)
SELECT event_id, metric_name, value FROM metrics_long JOIN st USING (metric_name) JOIN dev USING (metric_name)
WHERE mad > 0 AND abs(0.6745 * (value - md) / mad) > 2""",
)
def outliers_modified_zscore(spark, d):
    return outliers.outliers_modified_zscore(_raw(spark, d)).select("event_id", "metric_name", "value")


FIT = """t0 AS (SELECT {k}, min(timestamp) AS t0 FROM {t} GROUP BY 1),
fit AS (SELECT {k}, any_value(t0) AS t0, count(*) AS n, regr_slope(value, x) AS b, regr_intercept(value, x) AS a, regr_r2(value, x) AS r2,
  regr_sxx(value, x) AS sxx, regr_sxy(value, x) AS sxy, regr_syy(value, x) AS syy, max(x) AS xmax, min(x) AS xmin
  FROM (SELECT {k}, value, t0, epoch_us(timestamp) / 1e6 - epoch_us(t0) / 1e6 AS x FROM {t} JOIN t0 USING ({k})) GROUP BY 1)"""
MFIT = FIT.format(k="metric_name", t="metrics_long")
TREND = f"""SELECT metric_name, n, {r('b', 12)} AS slope, {r('a - b * epoch_us(t0) / 1e6', 4)} AS intercept, {r('r2', 9)} AS r_squared,
  {r('sqrt(greatest(0, syy - b * sxy) / (n - 2) / sxx)', 12)} AS standard_error,
  CASE WHEN b > 0 THEN 'increasing' WHEN b < 0 THEN 'decreasing' ELSE 'flat' END AS direction,
  CASE WHEN sqrt(r2) > 0.7 THEN 'strong' WHEN sqrt(r2) > 0.4 THEN 'moderate' ELSE 'weak' END AS strength FROM fit WHERE n >= 10"""


def _trend_rounded(df):
    digits = {"slope": 12, "intercept": 4, "r_squared": 9, "standard_error": 12}
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


@Q.add("linear_trend", with_(S.METRICS, MFIT) + TREND)
def linear_trend(spark, d):
    return _trend_rounded(timeseries.linear_trend(_metrics(spark, d), p_value=False))


@Q.add("linear_trend_p_value")
def linear_trend_p_value(spark, d):
    return timeseries.linear_trend(_metrics(spark, d)).select("metric_name", "p_value")


@Q.add(
    "seasonality_strength",
    with_(S.METRICS)
    + f"""SELECT metric_name, {r('s')} AS strength, s > 0.1 AS present FROM (SELECT metric_name,
  CASE WHEN sum(n) > 24 AND sum(hn) > 24 AND avg(v) <> 0 THEN stddev_samp(v) / avg(v) ELSE 0 END AS s
  FROM (SELECT metric_name, hour(h) AS hh, avg(v) AS v, sum(n) AS n, count(*) AS hn
    FROM (SELECT metric_name, date_trunc('hour', timestamp) AS h, avg(value) AS v, count(*) AS n FROM metrics_long GROUP BY 1, 2) GROUP BY 1, 2) GROUP BY 1)""",
)
def seasonality_strength(spark, d):
    return rounded(timeseries.seasonality_strength(_metrics(spark, d)))


@Q.add(
    "stationarity_simple",
    with_(S.METRICS, ROLL.format(n=12, b=11))
    + f"""SELECT metric_name, {r('m')} AS mean_stability, {r('s')} AS std_stability, m < 0.1 AND s < 0.1 AS is_stationary FROM (
  SELECT metric_name, stddev_samp(rolling_mean) / avg(rolling_mean) AS m, stddev_samp(rolling_std) / avg(rolling_std) AS s FROM rolled GROUP BY 1)""",
)
def stationarity_simple(spark, d):
    return rounded(timeseries.stationarity_simple(_metrics(spark, d)))


@Q.add(
    "stationarity_df",
    with_(S.METRICS)
    + f""", ch AS (SELECT metric_name, value - p AS y, p AS x FROM (SELECT metric_name, value, lag(value) OVER ({W}) AS p FROM metrics_long) WHERE p IS NOT NULL),
f AS (SELECT metric_name, count(*) AS n, regr_slope(y, x) AS b, regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy, regr_syy(y, x) AS syy FROM ch GROUP BY 1),
g AS (SELECT *, b / sqrt((syy - b * sxy) / (n - 2) / sxx) AS t, -3.43035 - 6.5393 / n - 16.786 / n ** 2 - 79.433 / n ** 3 AS c1,
  -2.86154 - 2.8903 / n - 4.234 / n ** 2 - 40.040 / n ** 3 AS c5, -2.56677 - 1.5384 / n - 2.809 / n ** 2 AS c10 FROM f)
SELECT metric_name, n, {r('t', 5)} AS adf_statistic, {r('c1', 5)} AS critical_1, {r('c5', 5)} AS critical_5, {r('c10', 5)} AS critical_10, t < c5 AS is_stationary FROM g""",
)
def stationarity_df(spark, d):
    return rounded(timeseries.stationarity_df(_metrics(spark, d)), 5)


RATE = """prev AS (SELECT *, lag(timestamp) OVER w AS pt, lag(bytes_sent) OVER w AS ps, lag(bytes_recv) OVER w AS pr,
  lag(packets_sent) OVER w AS pps, lag(packets_recv) OVER w AS ppr FROM counters WINDOW w AS (PARTITION BY source ORDER BY timestamp, event_id)),
rates AS (SELECT event_id, source, timestamp, epoch_us(timestamp) / 1e6 - epoch_us(pt) / 1e6 AS seconds, (bytes_sent - ps) AS ds, (bytes_recv - pr) AS dr,
  packets_sent - pps AS dps, packets_recv - ppr AS dpr FROM prev WHERE pt IS NOT NULL AND timestamp > pt)"""
COUNTERS = ["bytes_sent", "bytes_recv", "packets_sent", "packets_recv"]


@Q.add(
    "counter_rate",
    with_(S.COUNTERS, RATE)
    + f"""SELECT event_id, source, {r('seconds', 5)} AS seconds, {r('ds / seconds', 3)} AS bytes_sent_per_sec, {r('dr / seconds', 3)} AS bytes_recv_per_sec,
  {r('dps / seconds', 3)} AS packets_sent_per_sec, {r('dpr / seconds', 3)} AS packets_recv_per_sec FROM rates""",
)
def counter_rate(spark, d):
    out = timeseries.counter_rate(A.counters(spark, d), COUNTERS)
    rates = [F.round(f"{c}_per_sec", 3).alias(f"{c}_per_sec") for c in COUNTERS]
    return out.select("event_id", "source", F.round("seconds", 5).alias("seconds"), *rates)


@Q.add(
    "counter_delta_kb",
    with_(S.COUNTERS, RATE.replace("AND timestamp > pt", ""))
    + f"SELECT event_id, source, {r('ds / 1024.0', 2)} AS sent_rate_kbps, {r('dr / 1024.0', 2)} AS recv_rate_kbps FROM rates",
)
def counter_delta_kb(spark, d):
    out = timeseries.counter_delta_kb(A.counters(spark, d), {"bytes_sent": "sent_rate_kbps", "bytes_recv": "recv_rate_kbps"})
    return out.select("event_id", "source", "sent_rate_kbps", "recv_rate_kbps")


@Q.add(
    "bandwidth_trend",
    with_(S.COUNTERS, RATE)
    + f"""SELECT source, count(*) AS samples, {r('avg(ds / seconds)', 3)} AS sent_avg, {r('max(ds / seconds)', 3)} AS sent_max, {r('min(ds / seconds)', 3)} AS sent_min,
  {r('sum(ds) / 1048576.0', 3)} AS sent_mb, {r('avg(dr / seconds)', 3)} AS recv_avg, {r('max(dr / seconds)', 3)} AS recv_max,
  {r('min(dr / seconds)', 3)} AS recv_min, {r('sum(dr) / 1048576.0', 3)} AS recv_mb
FROM rates WHERE timestamp >= (SELECT max(timestamp) FROM rates) - INTERVAL 14400 MINUTE GROUP BY source""",
)
def bandwidth_trend(spark, d):
    rates = timeseries.counter_rate(A.counters(spark, d), COUNTERS)
    return rounded(timeseries.bandwidth_trend(rates, minutes=14400), 3)


@Q.add(
    "linear_forecast",
    with_(S.METRICS, MFIT)
    + f""", h AS (SELECT *, xmax + step * (xmax - xmin) / (n - 1) AS x, 1.96 * sqrt(greatest(0, syy - b * sxy) / n) AS m FROM fit, (SELECT unnest(range(1, 25)) AS step) WHERE n >= 10)
SELECT metric_name, CAST(step AS INTEGER) AS step, {r('a + b * x')} AS forecast, {r('a + b * x - m')} AS lower, {r('a + b * x + m')} AS upper,
  CAST(round(x) AS BIGINT) AS offset_seconds FROM h""",
)
def linear_forecast(spark, d):
    m = _metrics(spark, d)
    t0 = m.groupBy("metric_name").agg(F.min("timestamp").alias("t0"))
    out = rounded(forecast.linear_forecast(m)).join(t0, "metric_name")
    offset = F.round((F.unix_micros("forecast_time") - F.unix_micros("t0")) / 1e6).cast("bigint")
    return out.select("metric_name", "step", "forecast", "lower", "upper", offset.alias("offset_seconds"))


@Q.add(
    "linear_model_info",
    with_(S.METRICS, MFIT)
    + f"""SELECT metric_name, {r('any_value(r2)', 9)} AS r_squared, {r('any_value(greatest(0, syy - b * sxy) / n)')} AS mse,
  {r('avg(abs(value - a - b * (epoch_us(timestamp) / 1e6 - epoch_us(t0) / 1e6)))')} AS mae FROM metrics_long JOIN fit USING (metric_name) GROUP BY 1""",
)
def linear_model_info(spark, d):
    out = forecast.linear_model_info(_metrics(spark, d))
    return out.select("metric_name", F.round("r_squared", 9).alias("r_squared"), r6("mse"), r6("mae"))


def _smooth(alpha: float, src: str, key: str, value: str) -> str:
    return f"""num AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY timestamp, event_id) AS rn FROM {src}),
sm AS (SELECT {key}, event_id, rn, {value} AS v, {value}::DOUBLE AS s FROM num WHERE rn = 1
  UNION ALL SELECT n.{key}, n.event_id, n.rn, n.{value}, {alpha}::DOUBLE * n.{value} + {1 - alpha}::DOUBLE * sm.s FROM sm JOIN num n ON n.{key} = sm.{key} AND n.rn = sm.rn + 1)"""


@Q.add(
    "exp_smoothing_forecast",
    with_(S.METRICS, _smooth(0.3, "metrics_long", "metric_name", "value")).replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", f AS (SELECT metric_name, count(*) AS n, arg_max(s, rn) AS fc, stddev_pop(v - s) FILTER (WHERE rn > 1) AS sd FROM sm GROUP BY 1)
SELECT metric_name, CAST(step AS INTEGER) AS step, {r('fc')} AS forecast, {r('fc - 1.96 * sd * sqrt(1 + step * 0.1)')} AS lower,
  {r('fc + 1.96 * sd * sqrt(1 + step * 0.1)')} AS upper, {r('sd')} AS residual_std FROM f, (SELECT unnest(range(1, 25)) AS step)""",
)
def exp_smoothing_forecast(spark, d):
    return rounded(forecast.exp_smoothing_forecast(_metrics(spark, d)))


@Q.add(
    "ema_latency",
    with_(S.STREAM_EVENTS, _smooth(0.1, "stream_events", "source", "processing_latency_ms")).replace("WITH ", "WITH RECURSIVE ", 1)
    + f"SELECT event_id, source, {r('s')} AS ema FROM sm",
)
def ema_latency(spark, d):
    out = timeseries.ema_latency(A.stream_events(spark, d))
    return rounded(out.select("event_id", "source", "ema"))


@Q.add(
    "seasonal_naive_forecast",
    with_(S.METRICS)
    + f""", p AS (SELECT metric_name, value, row_number() OVER ({W}) - 1 AS pos, count(*) OVER (PARTITION BY metric_name) AS n FROM metrics_long),
pat AS (SELECT metric_name, pos - (n - 24) AS place, value FROM p WHERE pos >= n - 24 AND n >= 48),
idx AS (SELECT metric_name, pos % 24 AS place, avg(value) AS ix FROM p GROUP BY 1, 2)
SELECT pat.metric_name, CAST(i + 1 AS INTEGER) AS step, {r('value')} AS forecast, pat.place, {r('ix')} AS seasonal_index
FROM pat JOIN idx ON pat.metric_name = idx.metric_name AND pat.place = idx.place, (SELECT unnest(range(0, 36)) AS i) WHERE i % 24 = pat.place""",
)
def seasonal_naive_forecast(spark, d):
    return rounded(forecast.seasonal_naive_forecast(_metrics(spark, d), 24, 36))


@Q.add(
    "capacity_forecast",
    with_(S.METRICS)
    + """, hourly AS (SELECT metric_type, date_trunc('hour', timestamp) AS timestamp, avg(value) AS value FROM metrics_long
    WHERE timestamp >= (SELECT max(timestamp) FROM metrics_long) - INTERVAL 720 HOUR GROUP BY 1, 2),
"""
    + FIT.format(k="metric_type", t="hourly")
    + f""", rec AS (SELECT metric_type, count(*) AS n, avg(value) FILTER (WHERE rn <= 24) AS cur, avg(value) FILTER (WHERE rn BETWEEN 145 AND 168) AS wk
  FROM (SELECT *, row_number() OVER (PARTITION BY metric_type ORDER BY timestamp DESC) AS rn FROM hourly) GROUP BY 1),
o AS (SELECT metric_type, max(y) AS peak, min(step - 1) FILTER (WHERE y >= 95) / 24.0 AS days FROM (
  SELECT metric_type, step, a + b * (xmax + step * (xmax - xmin) / (n - 1)) AS y FROM fit, (SELECT unnest(range(1, 721)) AS step) WHERE n >= 100) GROUP BY 1),
c AS (SELECT *, CASE WHEN n >= 168 AND wk <> 0 THEN (cur - wk) / wk * 100 ELSE 0 END AS g FROM o JOIN rec USING (metric_type))
SELECT metric_type, {r('cur', 2)} AS current_utilization, {r('peak', 2)} AS max_forecast_utilization, {r('g', 2)} AS weekly_growth_percent,
  {r('g * 4.33', 2)} AS monthly_growth_percent, {r('days', 1)} AS days_to_exhaustion, peak < 95 AS capacity_sufficient,
  CASE WHEN days <= 7 THEN 'critical' WHEN days <= 30 THEN 'high' WHEN peak > 85 THEN 'medium' ELSE 'low' END AS risk_level,
  CASE WHEN peak > 85 THEN 'Monitor ' || metric_type || ' usage closely for performance degradation' ELSE '' END AS recommendations FROM c""",
)
def capacity_forecast(spark, d):
    return joined_lists(forecast.capacity_forecast(_metrics_typed(spark, d)))


def _metrics_typed(spark, d):
    return A.metrics_long(spark, d).select("event_id", "timestamp", "metric_type", "metric_name", "value")


@Q.add(
    "short_horizon_predict",
    with_(S.METRICS)
    + """, tail AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY metric_name ORDER BY timestamp DESC, event_id DESC) AS rn FROM metrics_long) WHERE rn <= 100),
"""
    + FIT.format(k="metric_name", t="tail")
    + "SELECT metric_name, "
    + ", ".join(
        [f"{r('b', 9)} AS slope, {r('a')} AS intercept, {r('r2', 9)} AS r_squared"]
        + [f"{r(f'a + b * (xmax + {60 * i})')} AS min_{i}" for i in range(1, 6)]
    )
    + """, CASE WHEN b > 0 THEN 'increasing' WHEN b < 0 THEN 'decreasing' ELSE 'flat' END AS trend,
  CASE WHEN r2 > 0.7 THEN 'high' WHEN r2 > 0.4 THEN 'medium' ELSE 'low' END AS confidence FROM fit WHERE n >= 20""",
)
def short_horizon_predict(spark, d):
    out = forecast.short_horizon_predict(_metrics(spark, d))
    fine = out.select("metric_name", F.round("slope", 9).alias("slope"), F.round("r_squared", 9).alias("r_squared"), "trend", "confidence")
    rest = rounded(out.drop("slope", "r_squared", "trend", "confidence"))
    return fine.join(rest, "metric_name")


REPORT = f"""rep AS (SELECT metric_name, count(*) AS sample_count, avg(value) AS mean, stddev_pop(value) AS std, median(value) AS median FROM metrics_long GROUP BY 1 HAVING count(*) >= 10)"""


@Q.add(
    "metric_report",
    with_(S.METRICS, ZS, MFIT, REPORT, _smooth(0.3, "metrics_long", "metric_name", "value")).replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", sea AS (SELECT metric_name, value AS v, rn FROM (SELECT metric_name, value, row_number() OVER ({W}) AS rn, count(*) OVER (PARTITION BY metric_name) AS n FROM metrics_long) WHERE rn = n - 23)
SELECT metric_name, sample_count, {r('mean')} AS mean, {r('std')} AS std, {r('median')} AS median,
  (SELECT count(*) FROM metrics_long m JOIN st USING (metric_name) WHERE m.metric_name = rep.metric_name AND ({IQR})) AS outlier_count,
  CASE WHEN b > 0 THEN 'increasing' WHEN b < 0 THEN 'decreasing' ELSE 'flat' END AS direction,
  {r('a + b * (xmax + 24 * (xmax - xmin) / (fit.n - 1))')} AS linear_forecast_last,
  {r('(SELECT arg_max(s, sm.rn) FROM sm WHERE sm.metric_name = rep.metric_name)')} AS exp_forecast, {r('sea.v')} AS seasonal_forecast_first
FROM rep JOIN fit USING (metric_name) JOIN sea USING (metric_name)""",
)
def metric_report(spark, d):
    from pulsegrid.operators.report import metric_report as op

    out = op(_metrics(spark, d), hours=None)
    return rounded(
        out.select(
            "metric_name", "sample_count", "mean", "std", "median", "outlier_count", "direction",
            F.element_at("linear_forecast", 24).alias("linear_forecast_last"), "exp_forecast",
            F.element_at("seasonal_forecast", 1).alias("seasonal_forecast_first"),
        )
    )
