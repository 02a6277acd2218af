"""Stateful operators with bounded state per key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pulsegrid.functions.columns import severity_of_score, threshold_score

WINDOW, MIN_SAMPLES, LIMIT = 100, 50, 0.5
LATENESS = "5 minutes"
SLOT_SECONDS = 60
TAKE_ROWS = 10_000
TTL_HOURS = 24 * 30

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark) -> None:
    """State store that these processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _sorted(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    """The rows of one key in this micro-batch, which the source's batch size bounds."""
    return pd.concat(list(rows), ignore_index=True).sort_values(by, ignore_index=True)


class _InEventOrder(StatefulProcessor):
    """Hands a key's rows to ``take`` in event order, whatever order and batches they come in.

    Rows wait in state, by slots of event time, until the watermark passes their slot; then one
    slot after the other is sorted, and taken with the next ones up to ``TAKE_ROWS`` rows. Memory
    is that, or one slot of one key. Each key has
    one timer: the end of its first waiting slot, or, with nothing waiting, the time from which
    its state no longer matters (``expires``). Rows behind the watermark never get here: Spark
    drops and counts them (``jobs.late_rows``).
    """

    by = ["micros", "event_id"]

    def __init__(self, slot_seconds: int) -> None:
        self.slot = slot_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "slot_end BIGINT", "rows BINARY")
        self.timer = handle.getValueState("timer", "at BIGINT")

    def take(self, rows: pd.DataFrame) -> pd.DataFrame:
        """Results of rows that follow all rows taken before; keeps what later ones need."""
        raise NotImplementedError

    def expires(self) -> int | None:
        """Milliseconds of event time from which the state may go; None: it stays."""
        return None

    def forget(self) -> None:
        """Remove the state of a key."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = {k[0] for k in self.waiting.keys()}
        new = set()
        for pdf in rows:
            ends = (pdf["micros"] // 1000) // self.slot * self.slot + self.slot
            for end, part in pdf.groupby(ends):
                end = int(end)
                if end in held or end in new:
                    part = pd.concat([self._waiting(end), part], ignore_index=True)
                self.waiting.updateValue((end,), (_packed(part),))
                new.add(end)
        if new:
            self._wake(min(new) - 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        now = timerValues.getCurrentWatermarkInMs()
        ends = sorted(k[0] for k in self.waiting.keys())
        due = [e for e in ends if e - 1 <= now]
        parts: list[pd.DataFrame] = []
        for end in due:
            parts.append(self._waiting(end).sort_values(self.by))
            self.waiting.removeKey((end,))
            if end == due[-1] or sum(map(len, parts)) >= TAKE_ROWS:
                yield self.take(pd.concat(parts, ignore_index=True))
                parts = []
        rest = ends[len(due) :]
        at = self.expires()
        # Rows to come are not behind the watermark; waiting ones may be, by part of a slot.
        if at is not None and at <= min([now, *(end - self.slot for end in rest[:1])]):
            self.forget()
            at = None
        if rest:
            self._wake(rest[0] - 1)
        elif at is not None:
            self._wake(at)

    def _waiting(self, end: int) -> pd.DataFrame:
        return _unpacked(self.waiting.getValue((end,))[0])

    def _wake(self, at: int) -> None:
        """One timer a key, the earliest one asked for."""
        if self.timer.exists():
            set_for = self.timer.get()[0]
            if set_for <= at:
                return
            self.handle.deleteTimer(set_for)
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def close(self) -> None:
        pass


def _packed(rows: pd.DataFrame) -> bytes:
    batch = pa.RecordBatch.from_pandas(rows, preserve_index=False)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as writer:
        writer.write_batch(batch)
    return out.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(data)).read_all().to_pandas()


def _timed(rows: DataFrame, lateness: str) -> DataFrame:
    """Rows with a time, their microseconds, and a watermark."""
    known = rows.filter(F.col("timestamp").isNotNull()).withWatermark("timestamp", lateness)
    return known.withColumn("micros", F.unix_micros("timestamp"))


class _Baseline(_InEventOrder):
    """Keeps the last samples of a metric and scores each new one against them."""

    def __init__(self, window: int, ttl_micros: int, slot_seconds: int) -> None:
        super().__init__(slot_seconds)
        self.window, self.ttl = window, ttl_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.history = handle.getListState("history", "value DOUBLE")
        self.seen = handle.getValueState("seen", "micros BIGINT")

    def take(self, rows: pd.DataFrame) -> pd.DataFrame:
        at = rows["micros"].to_numpy("int64")
        before = self.seen.get()[0] if self.seen.exists() else at[0]
        gaps = np.diff(at, prepend=before) > self.ttl
        old = np.array([r[0] for r in self.history.get()], float) if self.history.exists() else np.zeros(0)
        cuts = [0, *np.flatnonzero(gaps).tolist(), len(rows)]
        parts = []
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if k:
                old = old[:0]  # silent for longer than the time to live
            values = rows["value"].to_numpy(float)[a:b]
            series = np.concatenate([np.full(self.window, np.nan), old, values])
            # The frame of a value ends at it; those of the values before are left out.
            frames = np.lib.stride_tricks.sliding_window_view(series, self.window)[len(old) + 1 :]
            parts.append(_moments(frames))
            old = series[self.window :][-(self.window - 1) :] if self.window > 1 else series[:0]
        mean, std, n = (np.concatenate(x) for x in zip(*parts))
        self.history.put([(float(v),) for v in old])
        self.seen.update((int(at[-1]),))
        out = rows[["event_id", "timestamp", "metric_name", "value"]].copy()
        return out.assign(expected_value=mean, std=std, samples=n)

    def expires(self) -> int | None:
        return (self.seen.get()[0] + self.ttl) // 1000 + 1 if self.seen.exists() else None

    def forget(self) -> None:
        self.history.clear()
        self.seen.clear()


def _moments(frames: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, population deviation and number of the known values of each frame."""
    known = ~np.isnan(frames)
    n = known.sum(axis=1)
    some = np.maximum(n, 1)
    mean = np.where(known, frames, 0.0).sum(axis=1) / some
    off = np.where(known, frames - mean[:, None], 0.0)
    std = np.sqrt((off * off).sum(axis=1) / some)
    return np.where(n > 0, mean, np.nan), np.where(n > 0, std, np.nan), n


def stream_baseline_anomaly(
    metrics: DataFrame,
    window: int = WINDOW,
    min_samples: int = MIN_SAMPLES,
    limit: float = LIMIT,
    lateness: str = LATENESS,
    slot_seconds: int = SLOT_SECONDS,
    ttl_hours: float = TTL_HOURS,
) -> DataFrame:
    """Composite anomaly score of each sample against the last ones of its metric.

    Samples count in event order. Those later than ``lateness`` are dropped and counted. A metric
    that is silent for more than ``ttl_hours`` starts anew, and its state goes. Null values are
    no samples."""
    out = (
        "event_id BIGINT, timestamp TIMESTAMP, metric_name STRING, value DOUBLE,"
        " expected_value DOUBLE, std DOUBLE, samples BIGINT"
    )
    rows = _timed(metrics.select("event_id", "timestamp", "metric_name", "value"), lateness)
    processor = _Baseline(window, int(ttl_hours * 3_600_000_000), slot_seconds)
    scored = rows.groupBy("metric_name").transformWithStateInPandas(
        processor, out, outputMode="Append", timeMode="EventTime"
    )
    z = F.abs((F.col("value") - F.col("expected_value")) / F.nullif(F.col("std"), F.lit(0.0)))
    score = F.greatest(
        F.coalesce(F.least(z / 3.0, F.lit(1.0)), F.lit(0.0)),
        threshold_score(F.col("metric_name"), F.col("value")),
    )
    return (
        scored.filter((F.col("samples") >= min_samples) & F.col("value").isNotNull())
        .withColumn("anomaly_score", score)
        .filter(F.col("anomaly_score") > limit)
        .withColumn("severity", severity_of_score(F.col("anomaly_score")))
        .drop("std", "samples")
    )


class _Cooldown(_InEventOrder):
    """Keeps the time from which a rule and source may fire again, until that time is past."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.free = handle.getValueState("free", "micros BIGINT")

    def take(self, rows: pd.DataFrame) -> pd.DataFrame:
        at = rows["micros"].to_numpy("int64")
        cooldown = int(rows["cooldown_minutes"].iloc[0]) * 60_000_000
        i = int(np.searchsorted(at, self.free.get()[0], side="left")) if self.free.exists() else 0
        hits = []
        while i < len(at):
            hits.append(i)
            # Firing takes the row itself out, also without a cooldown.
            i = max(i + 1, int(np.searchsorted(at, at[i] + cooldown, side="left")))
        if hits:
            self.free.update((int(at[hits[-1]]) + cooldown,))
        return rows.iloc[hits][["rule", "source", "timestamp", "event_id", "severity", "message"]]

    def expires(self) -> int | None:
        return self.free.get()[0] // 1000 + 1 if self.free.exists() else None

    def forget(self) -> None:
        self.free.clear()


def stream_alert_cooldown(
    breaches: DataFrame, lateness: str = LATENESS, slot_seconds: int = SLOT_SECONDS
) -> DataFrame:
    """Alerts of the breaches that are not inside their rule's cooldown, by event time and in
    event order. Breaches later than ``lateness`` are dropped and counted; the state of a rule and
    source goes with its cooldown."""
    out = (
        "rule STRING, source STRING, timestamp TIMESTAMP, event_id BIGINT, severity STRING, message STRING"
    )
    columns = ["rule", "source", "timestamp", "event_id", "severity", "message", "cooldown_minutes"]
    rows = _timed(breaches.select(*columns), lateness)
    return rows.groupBy("rule", "source").transformWithStateInPandas(
        _Cooldown(slot_seconds), out, outputMode="Append", timeMode="EventTime"
    )


def _entries(keys, values) -> dict | None:
    return None if keys is None else dict(zip(keys, values))


class _Delta(_InEventOrder):
    """Keeps the last payload of a stream, whatever its fields."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "keys ARRAY<STRING>, vals ARRAY<STRING>")

    def _known(self) -> dict | None:
        return _entries(*self.last.get()) if self.last.exists() else None

    def _keep(self, payload: dict | None) -> None:
        if payload is None:
            self.last.clear()
        else:
            self.last.update((list(payload), list(payload.values())))

    def take(self, rows: pd.DataFrame) -> pd.DataFrame:
        previous = self._known()
        kinds, keys, vals, removed = [], [], [], []
        for k, v in zip(rows["names"], rows["vals"]):
            current = _entries(k, v)
            full = previous is None
            delta, gone = current, []
            if not full and current is not None:
                delta = {f: x for f, x in current.items() if f not in previous or previous[f] != x}
                gone = [f for f in previous if f not in current]
            kinds.append("full" if full else "delta")
            keys.append(None if delta is None else list(delta))
            vals.append(None if delta is None else list(delta.values()))
            removed.append(gone)
            previous = current
        self._keep(previous)
        out = rows[["event_id", "stream_name", "timestamp"]].copy()
        return out.assign(type=kinds, names=keys, vals=vals, removed=removed)


class _Undelta(_Delta):
    """Keeps the payload that the deltas so far make up."""

    def take(self, rows: pd.DataFrame) -> pd.DataFrame:
        state = self._known()
        keys, vals = [], []
        for kind, k, v, gone in zip(rows["type"], rows["names"], rows["vals"], rows["removed"]):
            given = _entries(k, v)
            if kind != "full" and given is not None:
                given = {**(state or {}), **given}
                for f in gone:
                    given.pop(f, None)
            state = given
            keys.append(None if state is None else list(state))
            vals.append(None if state is None else list(state.values()))
        self._keep(state)
        return rows[["event_id", "stream_name", "timestamp"]].assign(names=keys, vals=vals)


def _payload(name: str) -> Column:
    return F.map_from_arrays("names", "vals").alias(name)


def stream_delta(
    messages: DataFrame, data: str = "data", lateness: str = LATENESS, slot_seconds: int = SLOT_SECONDS
) -> DataFrame:
    """Delta encoding of a message stream with payloads of any fields (a map of strings).

    ``delta`` has the new and changed entries: a field that is set to null is in it with a null,
    an unchanged one is not; ``removed`` names the fields that the payload no longer has. The
    first message of a stream, and one after a null payload, is given in full. Messages count in
    event order; those later than ``lateness`` are dropped and counted."""
    rows = messages.select(
        "event_id", "stream_name", "timestamp", F.map_keys(data).alias("names"), F.map_values(data).alias("vals")
    )
    out = (
        "event_id BIGINT, stream_name STRING, timestamp TIMESTAMP, type STRING,"
        " names ARRAY<STRING>, vals ARRAY<STRING>, removed ARRAY<STRING>"
    )
    encoded = _timed(rows, lateness).groupBy("stream_name").transformWithStateInPandas(
        _Delta(slot_seconds), out, outputMode="Append", timeMode="EventTime"
    )
    return encoded.select("event_id", "stream_name", "timestamp", "type", _payload("delta"), "removed")


def stream_delta_decode(
    encoded: DataFrame, lateness: str = LATENESS, slot_seconds: int = SLOT_SECONDS
) -> DataFrame:
    """The payloads (``data``) of a stream of deltas as ``stream_delta`` makes them."""
    rows = encoded.select(
        "event_id", "stream_name", "timestamp", "type",
        F.map_keys("delta").alias("names"), F.map_values("delta").alias("vals"), "removed",
    )
    out = (
        "event_id BIGINT, stream_name STRING, timestamp TIMESTAMP, names ARRAY<STRING>, vals ARRAY<STRING>"
    )
    decoded = _timed(rows, lateness).groupBy("stream_name").transformWithStateInPandas(
        _Undelta(slot_seconds), out, outputMode="Append", timeMode="EventTime"
    )
    return decoded.select("event_id", "stream_name", "timestamp", _payload("data"))


class _Tail(StatefulProcessor):
    """Keeps the last rows of a series for a short trend line."""

    def __init__(self, window: int, minutes: int) -> None:
        self.window, self.minutes = window, minutes

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = T.StructType([T.StructField("micros", T.LongType()), T.StructField("value", T.DoubleType())])
        self.tail = handle.getListState("tail", schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _sorted(rows, ["timestamp", "event_id"])
        ts = pdf["timestamp"].to_numpy().astype("datetime64[us]").astype("int64")
        new = list(zip(ts.tolist(), pdf["value"].astype(float)))
        old = [(r[0], r[1]) for r in self.tail.get()] if self.tail.exists() else []
        last = (old + new)[-self.window :]
        self.tail.put([(int(t), float(v)) for t, v in last])
        x = np.array([t for t, _ in last], float) / 1e6
        x = x - x[0]
        y = np.array([v for _, v in last])
        if len(y) < 20 or np.allclose(y, y[0]):
            return
        slope, intercept = np.polyfit(x, y, 1)
        row = {"metric_name": [key[0]], "timestamp": [pdf["timestamp"].iloc[-1]], "slope": [slope]}
        for m in range(1, self.minutes + 1):
            row[f"min_{m}"] = [slope * (x[-1] + 60.0 * m) + intercept]
        yield pd.DataFrame(row)

    def close(self) -> None:
        pass


def stream_short_horizon(metrics: DataFrame, window: int = 100, minutes: int = 5) -> DataFrame:
    """Trend line of each metric's last samples after every micro-batch, 1..5 minutes ahead."""
    out = (
        "metric_name STRING, timestamp TIMESTAMP, slope DOUBLE, "
        + ", ".join(f"min_{m} DOUBLE" for m in range(1, minutes + 1))
    )
    rows = metrics.select("event_id", "timestamp", "metric_name", "value")
    return rows.groupBy("metric_name").transformWithStateInPandas(
        _Tail(window, minutes), out, outputMode="Append", timeMode="None"
    )
