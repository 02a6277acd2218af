"""Rolling windows, lags, rates, trends and stationarity.

Ordered operators take ``keys`` (the series) and ``order`` (unique within a series) and run on
blocks of equal size, see ``plans.ordering``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pulsegrid.functions.columns import calendar
from pulsegrid.functions.distributions import t_p_value
from pulsegrid.plans.joins import join_keys
from pulsegrid.plans.ordering import BLOCK_ROWS, POS, TOTAL, numbered, with_frames, with_sliding_moments

SERIES = ("metric_name",)
ORDER = ("timestamp", "event_id")

# Rows to step over per granularity.
GRANULARITY_STEPS = {"1min": 1, "5min": 5, "15min": 15, "1hour": 60}
DEFAULT_STEP = 5
UNSAMPLED_ROWS = 100

# Epoch seconds near which regressions on time are taken.
ORIGIN = 1_700_000_000


def framed(
    df: DataFrame,
    build: Callable[[WindowSpec], dict[str, Column]],
    before: int,
    after: int = 0,
    keys: Sequence[str] = SERIES,
    order: Sequence[str] = ORDER,
    block_rows: int = BLOCK_ROWS,
    keep_total: bool = False,
    keep_position: bool = False,
) -> DataFrame:
    """Number the rows of each series, unless they are, and add frame columns."""
    out = with_frames(numbered(df, keys, order), keys, build, before, after, POS, block_rows)
    if keep_position:
        return out
    return out.drop(POS) if keep_total else out.drop(POS, TOTAL)


def downsample_every_n(
    df: DataFrame, granularity: str = "5min", keys: Sequence[str] = SERIES, order: Sequence[str] = ORDER
) -> DataFrame:
    """Every n-th row of a series of more than 100 rows, from the first on."""
    step = GRANULARITY_STEPS.get(granularity, DEFAULT_STEP)
    if step == 1:
        return df
    keep = (F.col(TOTAL) <= UNSAMPLED_ROWS) | (F.col(POS) % step == 0)
    return numbered(df, keys, order).filter(keep).drop(POS, TOTAL)


def rolling_mean_std(
    df: DataFrame,
    value: str = "value",
    window: int = 30,
    keys: Sequence[str] = SERIES,
    order: Sequence[str] = ORDER,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Rolling mean and sample std; null until the window is full."""

    out = with_sliding_moments(numbered(df, keys, order), keys, value, window, POS, block_rows)
    full = F.col("_sn") == window
    return out.withColumns(
        {
            "rolling_mean": F.when(full, F.col("_sm")),
            "rolling_std": F.when(full, F.sqrt(F.col("_sq") / (window - 1))),
        }
    ).drop("_sn", "_sm", "_sq", POS, TOTAL)


def lag_features(
    df: DataFrame,
    horizon: int = 5,
    lags: Sequence[int] = (1, 2, 3, 5, 10),
    value: str = "value",
    keys: Sequence[str] = SERIES,
    order: Sequence[str] = ORDER,
    block_rows: int = BLOCK_ROWS,
    keep_last: bool = False,
) -> DataFrame:
    """Value, calendar and lagged values with the value ``horizon`` rows later as target.

    Incomplete rows are dropped; ``keep_last`` keeps rows whose target is not known yet.
    """

    def build(w: WindowSpec) -> dict[str, Column]:
        cols = {f"lag_{n}": F.lag(value, n).over(w) for n in lags}
        cols["target"] = F.lead(value, horizon).over(w)
        return cols

    out = framed(df, build, max(lags), horizon, keys, order, block_rows=block_rows)
    out = out.withColumns(calendar(F.col("timestamp")))
    needed = [value, *[f"lag_{n}" for n in lags]]
    return out.na.drop(subset=needed if keep_last else [*needed, "target"])


def rolling_features(
    df: DataFrame,
    value: str = "value",
    window: int = 10,
    keys: Sequence[str] = SERIES,
    order: Sequence[str] = ORDER,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Value, rolling mean and std, hour and weekday; rows before the first full window drop."""
    out = rolling_mean_std(df, value, window, keys, order, block_rows)
    cal = calendar(F.col("timestamp"))
    out = out.withColumns({"hour": cal["hour"], "day_of_week": cal["day_of_week"]})
    return out.na.drop(subset=[value, "rolling_mean", "rolling_std"])


def seconds(ts: str | Column) -> Column:
    return F.unix_micros(F.col(ts) if isinstance(ts, str) else ts) / 1e6


def counter_rate(
    df: DataFrame,
    counters: Sequence[str],
    keys: Sequence[str] = ("source",),
    order: Sequence[str] = ORDER,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Counter differences per second to the row before; rows without elapsed time drop."""

    def build(w: WindowSpec) -> dict[str, Column]:
        cols = {f"_prev_{c}": F.lag(c).over(w) for c in counters}
        cols["_prev_ts"] = F.lag("timestamp").over(w)
        return cols

    out = framed(df, build, 1, keys=keys, order=order, block_rows=block_rows)
    out = out.withColumn("seconds", seconds("timestamp") - seconds("_prev_ts")).filter("seconds > 0")
    rates = {f"{c}_per_sec": (F.col(c) - F.col(f"_prev_{c}")) / F.col("seconds") for c in counters}
    return out.withColumns(rates).drop("_prev_ts", *[f"_prev_{c}" for c in counters])


def counter_delta_kb(
    df: DataFrame,
    counters: dict[str, str],
    keys: Sequence[str] = ("source",),
    order: Sequence[str] = ORDER,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Counter differences in KiB to 2 decimals, not divided by time; the first row drops."""

    def build(w: WindowSpec) -> dict[str, Column]:
        return {out: F.round((F.col(c) - F.lag(c).over(w)) / 1024, 2) for c, out in counters.items()}

    out = framed(df, build, 1, keys=keys, order=order, block_rows=block_rows)
    return out.na.drop(subset=list(counters.values()))


def bandwidth_trend(rates: DataFrame, minutes: float = 10, as_of=None, keys: Sequence[str] = ("source",)) -> DataFrame:
    """Extremes and mean of the rates of the last minutes, and the volume as rate times time."""
    from pulsegrid.functions.timewin import trailing

    rows = trailing(rates, minutes / 60, as_of)
    aggs = [F.count("*").alias("samples")]
    for side in ("sent", "recv"):
        rate = F.col(f"bytes_{side}_per_sec")
        aggs += [
            F.avg(rate).alias(f"{side}_avg"),
            F.max(rate).alias(f"{side}_max"),
            F.min(rate).alias(f"{side}_min"),
            (F.sum(rate * F.col("seconds")) / float(1024**2)).alias(f"{side}_mb"),
        ]
    return rows.groupBy(*keys).agg(*aggs)


def ols(df: DataFrame, keys: Sequence[str], x: Column, y: str = "value", also: Sequence[Column] = ()) -> DataFrame:
    """Least squares of y on x per key, in one map-side combined pass.

    Spark's variances and covariances are updated around the running mean, so an offset of x
    costs no precision. ``also`` adds aggregates to the same pass.
    """
    both = F.when(x.isNotNull() & F.col(y).isNotNull(), x)
    fit = df.withColumn("_x", both).withColumn("_y", F.when(both.isNotNull(), F.col(y))).groupBy(*keys).agg(
        F.count("_x").alias("n"),
        F.avg("_x").alias("_mx"),
        F.avg("_y").alias("_my"),
        F.var_pop("_x").alias("_vx"),
        F.var_pop("_y").alias("_vy"),
        F.covar_pop("_x", "_y").alias("_c"),
        F.max("_x").alias("x_max"),
        F.min("_x").alias("x_min"),
        *also,
    )
    slope = F.col("_c") / F.nullif(F.col("_vx"), F.lit(0.0))
    fit = fit.withColumn("slope", slope).withColumns(
        {
            "intercept": F.col("_my") - F.col("slope") * F.col("_mx"),
            "sxx": F.col("n") * F.col("_vx"),
            "syy": F.col("n") * F.col("_vy"),
            "sse": F.greatest(F.lit(0.0), F.col("n") * (F.col("_vy") - F.col("slope") * F.col("_c"))),
            "r_squared": F.when(F.col("_vy") == 0, 1.0).otherwise(
                F.col("slope") * F.col("_c") / F.nullif(F.col("_vy"), F.lit(0.0))
            ),
        }
    )
    se = F.sqrt(F.try_divide(F.col("sse"), (F.col("n") - 2) * F.col("sxx")))
    return fit.withColumn("standard_error", se).drop("_mx", "_my", "_vx", "_vy", "_c")


def ols_time(
    df: DataFrame, keys: Sequence[str] = SERIES, value: str = "value", also: Sequence[Column] = ()
) -> DataFrame:
    """Least squares on time, one pass: x counts seconds from the series' first row ``_t0``."""
    fit = ols(df, keys, seconds("timestamp") - ORIGIN, value, [F.min("timestamp").alias("_t0"), *also])
    return fit.withColumns(
        {
            "intercept": F.col("intercept") + F.col("slope") * F.col("x_min"),
            "x_max": F.col("x_max") - F.col("x_min"),
            "x_min": F.lit(0.0),
        }
    )


def linear_trend(
    df: DataFrame, keys: Sequence[str] = SERIES, value: str = "value", p_value: bool = True
) -> DataFrame:
    """Slope per second, intercept at the epoch, fit quality, direction and strength (n >= 10)."""
    fit = ols_time(df, keys, value).filter("n >= 10")
    # A constant series explains nothing: r2 0, where SQL's regr_r2 says 1.
    constant = F.col("syy") == 0
    r2 = F.when(constant, 0.0).otherwise(F.col("r_squared"))
    r, slope, se = F.sqrt(r2), F.col("slope"), F.col("standard_error")
    t = F.when(constant, 0.0).when(se > 0, slope / se).otherwise(F.lit(float("inf")))
    out = fit.select(
        *keys,
        "n",
        "slope",
        (F.col("intercept") - slope * seconds("_t0")).alias("intercept"),
        r2.alias("r_squared"),
        "standard_error",
        F.when(slope > 0, "increasing").when(slope < 0, "decreasing").otherwise("flat").alias("direction"),
        F.when(r > 0.7, "strong").when(r > 0.4, "moderate").otherwise("weak").alias("strength"),
        t.alias("_t"),
    )
    if p_value:
        out = out.withColumn("p_value", t_p_value("_t", (F.col("n") - 2).cast("double")))
    return out.drop("_t")


def seasonality_strength(df: DataFrame, keys: Sequence[str] = SERIES, value: str = "value") -> DataFrame:
    """Spread of the hour-of-day means relative to their mean.

    0 unless there are more than 24 rows and more than 24 hours with data.
    """
    hourly = df.groupBy(*keys, F.date_trunc("hour", "timestamp").alias("_h")).agg(
        F.avg(value).alias("_v"), F.count(value).alias("_n")
    )
    by_hour = hourly.groupBy(*keys, F.hour("_h").alias("_hour")).agg(
        F.avg("_v").alias("_v"), F.sum("_n").alias("_n"), F.count("_v").alias("_hours")
    )
    agg = by_hour.groupBy(*keys).agg(
        F.stddev_samp("_v").alias("_std"),
        F.avg("_v").alias("_mean"),
        F.sum("_n").alias("_rows"),
        F.sum("_hours").alias("_hours"),
    )
    enough = (F.col("_rows") > 24) & (F.col("_hours") > 24) & (F.col("_mean") != 0)
    strength = F.when(enough, F.col("_std") / F.col("_mean")).otherwise(0.0)
    return agg.select(*keys, strength.alias("strength")).withColumn("present", F.col("strength") > 0.1)


def stationarity_simple(
    df: DataFrame,
    keys: Sequence[str] = SERIES,
    order: Sequence[str] = ORDER,
    value: str = "value",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Relative spread of the rolling mean and std; stationary when both are below 0.1.

    The window is a quarter of the rows, between 3 and 12.
    """
    widest = 12
    frame = lambda w: {"_last": F.collect_list(value).over(w.rowsBetween(-(widest - 1), 0))}
    rows = framed(df, frame, widest - 1, keys=keys, order=order, block_rows=block_rows, keep_total=True)
    width = F.least(F.lit(widest), F.greatest(F.lit(3), F.expr(f"{TOTAL} div 4"))).cast("int")
    tail = F.when(F.size("_last") >= width, F.slice("_last", -width, width))
    add = lambda a, x: a + x
    rows = rows.select(*keys, width.alias("_w"), tail.alias("_t")).filter(F.col("_t").isNotNull())
    rows = rows.withColumn("_m", F.aggregate("_t", F.lit(0.0), add) / F.col("_w"))
    squares = F.aggregate("_t", F.lit(0.0), lambda a, x: a + (x - F.col("_m")) * (x - F.col("_m")))
    rows = rows.withColumn("_s", F.sqrt(squares / (F.col("_w") - 1)))
    agg = rows.groupBy(*keys).agg(
        (F.stddev_samp("_m") / F.nullif(F.avg("_m"), F.lit(0.0))).alias("mean_stability"),
        (F.stddev_samp("_s") / F.nullif(F.avg("_s"), F.lit(0.0))).alias("std_stability"),
    )
    stable = (F.col("mean_stability") < 0.1) & (F.col("std_stability") < 0.1)
    return agg.withColumn("is_stationary", F.coalesce(stable, F.lit(False)))


def stationarity_df(
    df: DataFrame,
    keys: Sequence[str] = SERIES,
    order: Sequence[str] = ORDER,
    value: str = "value",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Dickey-Fuller test with a constant: t of the level in the regression of the change.

    Critical values are MacKinnon's published response surfaces.
    """
    prev = lambda w: {"_prev": F.lag(value).over(w)}
    rows = framed(df, prev, 1, keys=keys, order=order, block_rows=block_rows)
    rows = rows.filter(F.col("_prev").isNotNull()).withColumn("_change", F.col(value) - F.col("_prev"))
    fit = ols(rows, keys, F.col("_prev"), "_change")
    n = F.col("n")

    # MacKinnon (2010) coefficients, one variable, constant only.
    surface = {
        "critical_1": (-3.43035, -6.5393, -16.786, -79.433),
        "critical_5": (-2.86154, -2.8903, -4.234, -40.040),
        "critical_10": (-2.56677, -1.5384, -2.809, 0.0),
    }
    cols = {k: F.lit(a) + b / n + c / (n * n) + d / (n * n * n) for k, (a, b, c, d) in surface.items()}
    out = fit.withColumn("adf_statistic", F.col("slope") / F.col("standard_error")).withColumns(cols)
    out = out.withColumn("is_stationary", F.col("adf_statistic") < F.col("critical_5"))
    return out.select(*keys, "n", "adf_statistic", *cols, "is_stationary")


def smoothing_rows(alpha: float, tolerance: float = 1e-16) -> int:
    """Rows back after which a smoothing weight is below the tolerance."""
    if alpha >= 1:
        return 1
    return math.ceil(math.log(tolerance) / math.log(1 - alpha))


def exponential_smoothing(
    df: DataFrame,
    alpha: float,
    out: str = "smoothed",
    value: str = "value",
    keys: Sequence[str] = SERIES,
    order: Sequence[str] = ORDER,
    keep_position: bool = False,
) -> DataFrame:
    """s = alpha * value + (1 - alpha) * previous s, the first value as start.

    A series is cut into runs so long that a run forgets what came before the run ahead of it
    (weight below 1e-16). Inside a run the recursion is a running sum of growing weights; the
    run before enters through one aggregated number. Runs are independent of each other.
    """
    keys, length, keep = list(keys), smoothing_rows(alpha), 1 - alpha
    rows = numbered(df, keys, order)
    rows = rows.withColumn("_run", F.expr(f"{POS} div {length}")).withColumn("_i", F.col(POS) % length)
    start = F.when(F.col(POS) == 0, 1.0).otherwise(alpha)
    grown = F.col(value) * start * F.pow(F.lit(keep), -F.col("_i"))
    carry = rows.groupBy(*keys, (F.col("_run") + 1).alias("_run")).agg(
        (F.sum(grown) * keep ** (length - 1)).alias("_carry")
    )
    inside = Window.partitionBy(*keys, "_run").orderBy(POS).rowsBetween(Window.unboundedPreceding, 0)
    before = F.coalesce(F.col("_carry"), F.lit(0.0)) * keep
    smoothed = F.pow(F.lit(keep), F.col("_i")) * (F.sum(grown).over(inside) + before)
    result = join_keys(rows, carry, [*keys, "_run"], "left").withColumn(out, smoothed)
    result = result.select(*rows.columns, out).drop("_run", "_i")
    return result if keep_position else result.drop(POS, TOTAL)


def ema_latency(
    df: DataFrame,
    value: str = "processing_latency_ms",
    keys: Sequence[str] = ("source",),
    order: Sequence[str] = ORDER,
) -> DataFrame:
    """Exponential moving average with weight 0.1 on the new latency."""
    return exponential_smoothing(df, 0.1, "ema", value, keys, order)
