"""Streams give the same bars and indicators as the batch over closed windows."""

import datetime as dt
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkwick.operators import monitor
from sparkwick.streaming import candles as live

C = F.col
T0 = dt.datetime(2024, 1, 1)
SCHEMA = "symbol string, ts timestamp, price double, tick_id long, volume double"


@pytest.fixture()
def ticks(spark, tmp_path):
    r = random.Random(8)
    rows = [("A", T0 + dt.timedelta(minutes=7 * i), 100 + r.gauss(0, 2), i, 1.0) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    df.coalesce(1).write.parquet(str(tmp_path / "ticks"))
    return df, spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "ticks"))


def run(df, name, tmp_path, mode="append"):
    q = (
        df.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    )
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_closed_candles_and_live_indicators(ticks, tmp_path):
    batch, stream = ticks
    got = run(live.streaming_candles(stream), "bars", tmp_path).orderBy("ts").collect()
    want = (
        batch.groupBy("symbol", F.date_trunc("hour", "ts").alias("ts"))
        .agg(F.min_by("price", "ts").alias("open"), F.max_by("price", "ts").alias("close"))
        .orderBy("ts").collect()
    )
    assert 0 < len(got) < len(want)  # the bar that is still open is missing
    for g, w in zip(got, want, strict=False):
        assert (g["ts"], g["open"], g["close"]) == (w["ts"], w["open"], w["close"])


def test_live_state(spark, ticks, tmp_path):
    batch, _ = ticks
    bars = batch.groupBy("symbol", F.date_trunc("hour", "ts").alias("ts")).agg(
        F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"),
        F.count("*").cast("double").alias("volume"),
    )
    bars.coalesce(1).write.parquet(str(tmp_path / "bars"))
    stream = spark.readStream.schema(bars.schema).parquet(str(tmp_path / "bars"))
    got = run(live.live_indicators(stream), "live", tmp_path).orderBy("ts").collect()
    level = None
    for g in got:
        level = g["close"] if level is None else level + 2 / 13 * (g["close"] - level)
        assert g["ema_fast"] == pytest.approx(level)
    assert len(got) == bars.count()


def test_sessions(ticks, tmp_path):
    _, stream = ticks
    got = run(live.activity_sessions(stream, "5 minutes"), "sessions", tmp_path).collect()
    assert got and all(r["n_ticks"] == 1 for r in got)


def parts(spark, path, rows, schema, n):
    """A stream that reads ``rows`` (in order) in ``n`` micro-batches."""
    size = -(-len(rows) // n)
    os.makedirs(path)
    for k in range(n):
        df = spark.createDataFrame(rows[k * size : (k + 1) * size], schema)
        df.toPandas().to_parquet(f"{path}/{k}.parquet", coerce_timestamps="us")
        os.utime(f"{path}/{k}.parquet", (1000 + k, 1000 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def hourly(n):
    """Bars of two symbols in time order; B starts later, A lacks some hours."""
    r = random.Random(3)
    rows = []
    for i in range(n):
        at = T0 + dt.timedelta(hours=i)
        for s in ("A", "B"):
            c, up, down = 100 + r.gauss(0, 2), r.random(), r.random()
            if not (s == "A" and i % 7 in (3, 4)) and not (s == "B" and i < 5):
                rows.append((s, at, c + up, c - down, c, float(r.randint(0, 3))))
    return rows


BARS = "symbol string, ts timestamp, high double, low double, close double, volume double"


def test_live_state_goes_on_over_batches(spark, tmp_path):
    rows = hourly(40)
    stream = parts(spark, tmp_path / "in", rows, BARS, 5)
    got = run(live.live_indicators(stream), "live_parts", tmp_path).toPandas()
    want = pd.DataFrame(rows, columns=["symbol", "ts", "high", "low", "close", "volume"])
    for symbol, w in want.groupby("symbol"):
        g = got[got.symbol == symbol].sort_values("ts")
        assert g.n.tolist() == list(range(1, len(w) + 1))
        before = w.close.shift().fillna(w.close)
        tr = pd.concat([w.high - w.low, (w.high - before).abs(), (w.low - before).abs()], axis=1).max(axis=1)
        atr = tr.ewm(alpha=1 / 14, adjust=False).mean()
        atr[: 13] = None
        typical = (w.high + w.low + w.close) / 3
        paid = (typical * w.volume).cumsum()
        for name, x in {
            "ema_fast": w.close.ewm(span=12, adjust=False).mean(), "atr": atr,
            "ema_slow": w.close.ewm(span=26, adjust=False).mean(),
            "vwap": (paid / w.volume.cumsum()).where(w.volume.cumsum() > 0, typical),
        }.items():
            assert g[name].tolist() == pytest.approx(x.tolist(), nan_ok=True), name


def resolved_by_batch(spark, bars, predictions):
    index = {}
    numbered = []
    for s, at, _, _, close, _ in bars:
        index[s, at] = n = sum(1 for k in index if k[0] == s)
        numbered.append((s, at, n, close))
    candles = spark.createDataFrame(numbered, "symbol string, outcome_ts timestamp, bar_idx int, close double")
    made = [(p, s, index[s, at], h, v) for p, s, at, v, h in predictions]
    made = spark.createDataFrame(
        made, "prediction_id string, symbol string, decision_idx int, horizon int, predicted_value double"
    )
    done, _ = monitor.resolve(made, candles, ("symbol",))
    times = {(s, n): at for s, at, n, _ in numbered}
    return {
        r.prediction_id: (times[r.symbol, r.decision_idx + r.horizon], r.outcome_close, r.outcome_close - r.predicted_value)
        for r in done.collect()
    }


PREDICTIONS = "prediction_id string, symbol string, ts timestamp, predicted_value double, horizon int"


@pytest.mark.parametrize("shuffled", [False, True])
def test_resolution_counts_bars(spark, tmp_path, shuffled):
    bars = hourly(60)
    made = [(f"p{i}", b[0], b[1], b[4] + 0.5, 1 + i % 4) for i, b in enumerate(bars)]
    made += [("twin", *made[10][1:])]
    made.sort(key=lambda p: p[2])
    want = resolved_by_batch(spark, bars, made)
    sent = list(bars)
    if shuffled:  # bars come late within the watermark's delay
        r = random.Random(1)
        sent.sort(key=lambda b: b[1] + dt.timedelta(hours=r.random() * 3))
    b = parts(spark, tmp_path / "bars", sent, BARS, 6)
    p = parts(spark, tmp_path / "made", made, PREDICTIONS, 4)
    got = run(live.resolve_stream(p, b, lateness="4 hours"), f"resolved_{shuffled}", tmp_path).collect()
    ids = [g.prediction_id for g in got]
    assert len(set(ids)) == len(ids)
    mark = min(max(x[1] for x in bars), max(x[2] for x in made)) - dt.timedelta(hours=4)
    settled = {k: v for k, v in want.items() if v[0] < mark}
    assert len(settled) > 80 and "twin" in settled
    assert set(settled) <= set(ids) <= {k for k, v in want.items() if v[0] <= mark}
    for g in got:
        at, close, error = want[g.prediction_id]
        assert (g.outcome_ts, g.actual_value) == (at, close) and g.error == pytest.approx(error)


def test_resolution_without_rows(spark, tmp_path):
    b = parts(spark, tmp_path / "bars", hourly(6)[:1], BARS, 1)
    made = [("none", "A", None, 1.0, 1), ("zero", "A", T0, 1.0, 0), ("never", "Z", T0, 1.0, 2)]
    p = parts(spark, tmp_path / "made", made, PREDICTIONS, 1)
    assert run(live.resolve_stream(p, b), "resolved_none", tmp_path).count() == 0


def test_drift_of_batches(spark):
    schema = "model string, feature string, value double"
    r = random.Random(5)
    rows = lambda shift: [("m", f, r.gauss(shift, 1)) for f in ("x", "y") for _ in range(80)]
    base, now = spark.createDataFrame(rows(0), schema), spark.createDataFrame(rows(2), schema)
    seen = {}
    step = live.drift_batches(base, ["model"], lambda df, k: seen.update({k: sorted(df.collect())}))
    step(now, 4)
    step(now.where("false"), 5)
    want = monitor.feature_drift(base, now, ["model"]).withColumn("batch_id", F.lit(4))
    assert list(seen) == [4] and [r.feature for r in seen[4]] == ["x", "y"]
    for got, row in zip(seen[4], sorted(want.collect()), strict=True):
        for name, x in row.asDict().items():  # sums come in any order, so the last digits may differ
            same = pytest.approx(x, nan_ok=True) if isinstance(x, float) else x
            assert got[name] == same, name
