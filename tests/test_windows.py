"""Window and prefix features against snapshots of copied windows and prefixes."""

import datetime as dt
import random

import brute
import pytest
from pyspark.sql import functions as F

from sparkwick.config import Layout
from sparkwick.operators import asof, features, windowed
from sparkwick.operators import scan as S
from sparkwick.sources import candles as src
from sparkwick.sources.staging import stage

CHUNKED = Layout(chunk=64, back=64, fwd=16)
T0 = dt.datetime(2024, 1, 1)


def coarse(n, seed):
    """A walk on a grid so coarse that equal highs, lows and closes are common; flat in parts."""
    r = random.Random(seed)
    out, price = [], 50.0
    for i in range(n):
        o = price
        c = o if n // 2 < i < n // 2 + 30 else max(5.0, o + r.choice([-2.0, -1.0, -1.0, 0.0, 0.0, 1.0, 1.0, 2.0]))
        h = max(o, c) + r.choice([0.0, 0.0, 1.0])
        low = min(o, c) - r.choice([0.0, 0.0, 1.0])
        if i < 20:  # nothing to find before there is an ATR
            c, h, low = o, o + 3.0, o - 3.0
        out.append((o, h, low, c, float(r.randint(1, 9))))
        price = c
    return out


def frame(spark, series):
    rows = [
        (name, "H1", T0 + dt.timedelta(hours=i), *bar, float(1 + i % 7), float(i % 5))
        for name, bars in series.items()
        for i, bar in enumerate(bars)
    ]
    return stage(S.index_bars(spark.createDataFrame(rows, src.CANDLE_SCHEMA), CHUNKED, span_seconds=5 * 86400))


def same(got, want, names, key):
    got, want = ({r[key]: r for r in x} for x in (got, want))
    assert got.keys() == want.keys() and got
    for k, r in want.items():
        for n in names:
            a, b = got[k][n], r[n]
            assert (a is None) == (b is None), (k, n, a, b)
            assert a is None or abs(a - b) <= 1e-7 * max(1.0, abs(b)), (k, n, a, b)


def test_windows_equal_copies_on_coarse_prices(spark):
    b = frame(spark, {"A": coarse(180, 9), "C": brute.walk(30, 3)})
    names = features.feature_names("union")
    got = windowed.window_features(b, 80, 3, 1, "union", layout=CHUNKED).collect()
    want = features.copied_window_features(b, 80, 3, 1, "union", layout=CHUNKED).collect()
    assert len(want) == 180 - 3 - 79
    same(got, want, names, "decision_idx")
    assert all(r.window_start_idx == r.decision_idx - 79 and r.label_idx == r.decision_idx + 3 for r in got)


def test_window_arguments(spark):
    b = frame(spark, {"A": coarse(90, 2)})
    short = windowed.window_features(b, 20, 1, 30, "v185", layout=CHUNKED)
    assert sorted(r.decision_idx for r in short.collect()) == [19, 49, 79]
    with pytest.raises(ValueError):
        windowed.window_features(b, 80, 0)


def test_states_equal_snapshots_of_prefixes(spark, monkeypatch):
    monkeypatch.setattr(asof, "CELL", 16)
    monkeypatch.setattr(asof, "EPOCH", 64)
    b = frame(spark, {"A": coarse(260, 5), "B": coarse(120, 6)})
    got = asof.state_features(b, 60, 13, layout=CHUNKED).collect()
    # every prefix as a series of its own
    at = b.where("bar_idx >= 60 AND (bar_idx - 60) % 13 = 0").select("symbol", "timeframe", F.col("bar_idx").alias("d"))
    fan = b.join(at, ["symbol", "timeframe"]).where("bar_idx <= d")
    fan = stage(fan.withColumn("symbol", F.concat_ws("@", "symbol", "d")).drop("d"))
    short = Layout(bounded=True, chunk=2048)
    want = features.snapshot_features(fan, "union", layout=short).withColumn("k", F.col("symbol")).collect()
    keyed = [{**r.asDict(), "k": f"{r.symbol}@{r.bar_idx}"} for r in got]
    same(keyed, want, features.feature_names("union"), "k")


def test_last_k_carries_lists_across_buckets(spark):
    r = random.Random(7)
    rows = [(s, i, r.choice([None, i])) for s in "ab" for i in range(200) if r.random() < 0.3]
    df = spark.createDataFrame(rows, "s string, i long, v long").withColumn("b", F.floor(F.col("i") / 7))
    for bucket in (None, "b"):
        got = S.last_k(df, ["s"], ["i"], F.col("i"), 4, "near", bucket).collect()
        for x in got:
            own = sorted(i for s, i, _ in rows if s == x.s and i <= x.i)
            assert x.near == own[-4:]
