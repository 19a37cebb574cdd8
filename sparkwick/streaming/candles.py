"""Structured Streaming: candles from ticks, incremental indicators, resolution, sessions, drift."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwick.operators import monitor as Q

C = F.col


def streaming_candles(
    ticks: DataFrame, step: str = "1 hour", lateness: str = "10 minutes", timeframe: str = "H1"
) -> DataFrame:
    """Closed candles only: in append mode a bar appears once the watermark has passed its end,
    and later ticks are dropped, so an unfinished bar is never seen.

    ``ticks`` needs symbol, ts, price, tick_id (a tie break) and volume.
    """
    order = F.struct("ts", "tick_id")
    bars = (
        ticks.withWatermark("ts", lateness)
        .groupBy("symbol", F.window("ts", step).alias("w"))
        .agg(
            F.min_by("price", order).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", order).alias("close"),
            F.sum("volume").alias("volume"),
            F.count("*").cast("double").alias("tick_volume"),
        )
    )
    return bars.select(
        "symbol",
        F.lit(timeframe).alias("timeframe"),
        C("w.start").alias("ts"),
        "open",
        "high",
        "low",
        "close",
        "volume",
        "tick_volume",
    )


STATE = "n long, ema_fast double, ema_slow double, atr double, prev_close double, cum_v double, cum_pv double"
LIVE = (
    "symbol string, ts timestamp, close double, ema_fast double, ema_slow double, atr double, "
    "vwap double, n long"
)


def _smoothed(x: np.ndarray, alpha: float, before: float | None) -> np.ndarray:
    """Exponential smoothing of ``x`` that goes on from ``before`` (None: starts at x[0])."""
    seeded = x if before is None else np.concatenate([[before], x])
    y = pd.Series(seeded).ewm(alpha=alpha, adjust=False).mean().to_numpy()
    return y if before is None else y[1:]


def _advance(fast: int, slow: int, atr_period: int):
    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, f, s, a, pc, cv, cpv = state.get if state.exists else (0, None, None, None, None, 0.0, 0.0)
        rows = pd.concat(list(batches)).sort_values("ts")
        high, low, close, volume = (rows[c].to_numpy(float) for c in ("high", "low", "close", "volume"))
        before = np.concatenate([[close[0] if pc is None else pc], close[:-1]])
        ranges = np.maximum(high - low, np.maximum(np.abs(high - before), np.abs(low - before)))
        fasts = _smoothed(close, 2.0 / (fast + 1), f)
        slows = _smoothed(close, 2.0 / (slow + 1), s)
        atrs = _smoothed(ranges, 1.0 / atr_period, a)
        typical = (high + low + close) / 3.0
        volumes = cv + np.cumsum(volume)
        paid = cpv + np.cumsum(typical * volume)
        count = n + 1 + np.arange(len(rows))
        last = (int(count[-1]), *(float(x[-1]) for x in (fasts, slows, atrs, close, volumes, paid)))
        state.update(last)
        yield pd.DataFrame({
            "symbol": key[0], "ts": rows["ts"].to_numpy(), "close": close, "ema_fast": fasts,
            "ema_slow": slows, "atr": np.where(count >= atr_period, atrs, np.nan),
            "vwap": np.where(volumes > 0, paid / np.where(volumes > 0, volumes, 1.0), typical), "n": count,
        })

    return run


def live_indicators(
    bars: DataFrame, fast: int = 12, slow: int = 26, atr_period: int = 14
) -> DataFrame:
    """EMA, ATR and VWAP carried from bar to bar per symbol.

    The state is seven numbers. Bars must come in time order from one micro-batch to the next; the
    rows of one symbol in a micro-batch are sorted and advanced together, so the first batch over a
    long backlog should be cut by the source's own limit (``maxFilesPerTrigger`` and the like).
    """
    return bars.groupBy("symbol").applyInPandasWithState(
        _advance(fast, slow, atr_period), LIVE, STATE, "append", "NoTimeout"
    )


WAITING = (
    "p_id array<string>, p_ts array<long>, p_value array<double>, p_left array<long>, "
    "b_ts array<long>, b_close array<double>"
)


def _settle(outputs: list[str], n_keys: int):
    """One step of ``resolve_stream`` for one series; times are microseconds.

    A bar is settled when the watermark has reached it: no earlier bar can come any more, so its
    place in the count of bars is final.
    """

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kept = state.get if state.exists else ([], [], [], [], [], [])
        ids, at, value, horizon, bar, close = (
            np.array(x, dtype=t) for x, t in zip(kept, (object, "i8", "f8", "i8", "i8", "f8"), strict=True)
        )
        for rows in batches:
            p, b = rows[rows["is_bar"] == 0], rows[rows["is_bar"] == 1]
            ids = np.concatenate([ids, p["id"].to_numpy(object)])
            at = np.concatenate([at, p["us"].to_numpy("i8")])
            value = np.concatenate([value, p["value"].to_numpy("f8")])
            horizon = np.concatenate([horizon, p["horizon"].to_numpy("i8")])
            bar = np.concatenate([bar, b["us"].to_numpy("i8")])
            close = np.concatenate([close, b["value"].to_numpy("f8")])
        # a bar sent again takes the place of the one before
        bar, last = np.unique(bar[::-1], return_index=True)
        close = close[::-1][last]
        mark = max(0, state.getCurrentWatermarkMs())
        place = np.searchsorted(bar, at, side="right") + horizon - 1
        done = place < np.searchsorted(bar, mark * 1000, side="right")
        if done.any():
            end = place[done]
            out = [*([k] * len(end) for k in key[:n_keys]), ids[done], pd.to_datetime(at[done], unit="us"),
                   value[done], pd.to_datetime(bar[end], unit="us"), close[end], close[end] - value[done]]
            yield pd.DataFrame(dict(zip(outputs, out, strict=True)))
        ids, at, value, horizon, place = (x[~done] for x in (ids, at, value, horizon, place))
        # later predictions are newer than the watermark, so older bars matter to waiting ones only
        needed = bar > min(int(at.min(initial=mark * 1000)), mark * 1000)
        known = bar[place[place < len(bar)]]
        bar, close = bar[needed], close[needed]
        if not len(at) and not len(bar):
            state.remove()
            return
        state.update(tuple(x.tolist() for x in (ids, at, value, horizon, bar, close)))
        if len(known):
            state.setTimeoutTimestamp(max(int(known.min()) // 1000, mark + 1))

    return run


def resolve_stream(
    predictions: DataFrame,
    bars: DataFrame,
    horizon: int | str = "horizon",
    series: tuple[str, ...] = ("symbol",),
    lateness: str = "10 minutes",
) -> DataFrame:
    """Predictions with the close of the bar that ends their horizon, counted in bars that exist.

    ``predictions`` (series, ts, prediction_id, predicted_value) were made on the bar at ``ts``;
    the outcome is the ``horizon``-th bar after it (a number, or a column of predictions), however
    much time a gap takes. A row appears once the watermark has passed that bar, so a bar that
    comes late in between is still counted. Waiting predictions and the bars after the oldest of
    them are the state of a series; a timer settles a series that has no new rows. Rows without a
    time, and predictions without a horizon of one or more, are left out.
    """
    ahead = F.lit(horizon) if isinstance(horizon, int) else C(horizon)
    keys = [C(k) for k in series]
    nothing = F.lit(None)

    def rows(df: DataFrame, is_bar: int, own: Column, value: Column, left: Column) -> DataFrame:
        df = df.withWatermark("ts", lateness).where(C("ts").isNotNull())
        return df.select(
            *keys, "ts", F.unix_micros("ts").alias("us"), F.lit(is_bar).alias("is_bar"),
            own.cast("string").alias("id"), value.cast("double").alias("value"), left.cast("long").alias("horizon"),
        )

    made = rows(predictions, 0, C("prediction_id"), C("predicted_value"), ahead).where("horizon >= 1")
    both = made.unionByName(rows(bars, 1, nothing, C("close"), nothing))
    kinds = dict(predictions.dtypes)
    schema = [f"`{k}` {kinds[k]}" for k in series] + [
        "prediction_id string", "ts timestamp", "predicted_value double", "outcome_ts timestamp",
        "actual_value double", "error double",
    ]
    names = [*series, "prediction_id", "ts", "predicted_value", "outcome_ts", "actual_value", "error"]
    return both.groupBy(*series).applyInPandasWithState(
        _settle(names, len(series)), ", ".join(schema), WAITING, "append", "EventTimeTimeout"
    )


def activity_sessions(ticks: DataFrame, gap: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Stretches of activity per symbol that are separated by silence."""
    return (
        ticks.withWatermark("ts", lateness)
        .groupBy("symbol", F.session_window("ts", gap).alias("s"))
        .agg(F.count("*").alias("n_ticks"), F.avg("price").alias("mean_price"))
        .select("symbol", C("s.start").alias("start"), C("s.end").alias("end"), "n_ticks", "mean_price")
    )


def drift_batches(
    baseline: DataFrame, by, sink: Callable[[DataFrame, int], None]
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: drift of each micro-batch against a stored baseline.

    Both sides are long (by, feature, value).
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            if not batch.isEmpty():
                sink(Q.feature_drift(baseline, batch, by).withColumn("batch_id", F.lit(batch_id)), batch_id)
        finally:
            batch.unpersist()

    return run


def tick_columns(symbol: Column, ts: Column, price: Column, tick_id: Column, volume: Column | None = None):
    """Select list that turns any event table into the tick layout."""
    v = volume if volume is not None else F.lit(1)
    return [
        symbol.alias("symbol"),
        ts.cast("timestamp").alias("ts"),
        price.cast("double").alias("price"),
        tick_id.alias("tick_id"),
        v.cast("double").alias("volume"),
    ]
