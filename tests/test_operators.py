"""Operators against sequential brute force, and long series against short-series plans."""

import datetime as dt

import brute
import pytest
from pyspark.sql import functions as F

from sparkwick.config import Layout
from sparkwick.operators import dataset, diagnostics, gram, imbalance, levels, structure, windowed
from sparkwick.operators import features as X
from sparkwick.operators import scan as S
from sparkwick.operators.indicators import INDICATORS, indicators
from sparkwick.operators.patterns import PATTERNS, patterns
from sparkwick.sources import candles as src
from sparkwick.sources.staging import stage

CHUNKED = Layout(chunk=128)
SHORT = Layout(bounded=True, chunk=S.SHORT_SERIES)
T0 = dt.datetime(2024, 1, 1)


def frame(spark, series, hours=1):
    rows = [
        (name, "H1", T0 + dt.timedelta(hours=hours * i), *bar, float(1 + i % 7), float(i % 5))
        for name, bars in series.items()
        for i, bar in enumerate(bars)
    ]
    return spark.createDataFrame(rows, src.CANDLE_SCHEMA)


@pytest.fixture(scope="module")
def data():
    return {"A": brute.walk(700, 1), "B": brute.walk(333, 2, drift=0.1), "C": brute.walk(40, 3)}


@pytest.fixture(scope="module")
def bars(spark, data):
    return stage(S.index_bars(frame(spark, data), CHUNKED, span_seconds=5 * 86400))


def rows(df, *order):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: tuple(r[o] for o in order))


def close(a, b, tol=1e-9):
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for k in x:
            if isinstance(x[k], float) and isinstance(y[k], float):
                assert abs(x[k] - y[k]) <= tol * max(1.0, abs(y[k])), (k, x, y)
            else:
                assert x[k] == y[k], (k, x, y)


def test_bar_index_counts_per_series(bars, data):
    got = rows(bars.groupBy("symbol").agg(F.count("*").alias("n"), F.max("bar_idx").alias("m"),
                                          F.count_distinct("bar_idx").alias("d")), "symbol")
    assert [(r["n"], r["m"], r["d"]) for r in got] == [(len(b), len(b) - 1, len(b)) for b in data.values()]


def test_indicators_same_for_every_layout(bars):
    keep = ["symbol", "bar_idx", *INDICATORS]
    a = rows(indicators(bars, layout=CHUNKED).select(*keep), "symbol", "bar_idx")
    b = rows(indicators(bars, layout=SHORT).select(*keep), "symbol", "bar_idx")
    close(a, b, 1e-8)


def test_recurrences_match_a_loop(bars, data):
    got = rows(indicators(bars, ["ema_20", "ema_200", "atr", "rsi"], layout=CHUNKED), "symbol", "bar_idx")
    for name, series in data.items():
        mine = [r for r in got if r["symbol"] == name]
        closes = [b[3] for b in series]
        for p in (20, 200):
            want = brute.smoothed(closes, 2 / (p + 1))
            assert max(abs(r[f"ema_{p}"] - w) for r, w in zip(mine, want, strict=True)) < 1e-9
        atr = brute.smoothed(brute.true_ranges(series), 1 / 14)
        assert all(r["atr"] is None for r in mine[:13])
        assert max(abs(r["atr"] - w) for r, w in list(zip(mine, atr, strict=True))[13:]) < 1e-9
        assert all(r["rsi"] == 100.0 for r in mine[:13])
        assert all(0 <= r["rsi"] <= 100 for r in mine)


def test_short_periods_use_a_finite_sum(bars, data):
    from sparkwick.config import AnalysisConfig

    got = rows(indicators(bars, ["ema_2"], AnalysisConfig(ema_periods=(2,)), CHUNKED), "symbol", "bar_idx")
    want = brute.smoothed([b[3] for b in data["A"]], 2 / 3)
    mine = [r["ema_2"] for r in got if r["symbol"] == "A"]
    assert max(abs(x - y) for x, y in zip(mine, want, strict=True)) < 1e-9


def test_patterns_same_for_every_layout(bars):
    keep = ["symbol", "bar_idx", *PATTERNS, "bullish_score", "bearish_score"]
    a = rows(patterns(bars, CHUNKED).select(*keep), "symbol", "bar_idx")
    close(a, rows(patterns(bars, SHORT).select(*keep), "symbol", "bar_idx"))


@pytest.mark.parametrize("layout", [CHUNKED, SHORT])
def test_swings_and_breaks_match_a_loop(bars, data, layout):
    sb = stage(structure.swing_bars(bars, layout=layout))
    sw = rows(structure.swings_from(sb, layout), "symbol", "bar_idx", "side_order")
    br = rows(structure.breaks_from(sb, layout), "symbol", "bar_idx", "side_order")
    for name, series in data.items():
        mine = [(r["bar_idx"], r["kind"], r["price"]) for r in sw if r["symbol"] == name]
        assert mine == brute.pivots(series)
        got = [(r["bar_idx"], r["direction"], r["swing_index"]) for r in br if r["symbol"] == name]
        assert got == brute.level_breaks(series)


@pytest.mark.parametrize("layout", [CHUNKED, SHORT])
def test_pools_and_first_hits_match_a_loop(bars, data, layout):
    sb = stage(structure.swing_bars(bars, layout=layout))
    sw = stage(structure.swings_from(sb, layout))
    now = stage(structure.atr_now(sb, layout.keys))
    t = rows(levels.sweeps(bars, levels.pools(sw, now, layout=layout), layout=layout), "symbol", "side", "price")
    for name in ("A", "B"):
        mine = {(r["side"], r["first_index"], r["last_index"]): r["hit_idx"] for r in t if r["symbol"] == name}
        assert mine == brute.pool_hits(data[name])


def test_first_hit_search_climbs_the_tree(spark, monkeypatch):
    monkeypatch.setattr(levels, "RADIX", 4)
    series = {"A": brute.walk(60, 9)}
    b = stage(S.index_bars(frame(spark, series), CHUNKED))
    probes = [("A", "H1", i, s, series["A"][i][1 if s == "buy_side" else 2], i) for i in range(0, 60, 3)
              for s in ("buy_side", "sell_side")]
    p = spark.createDataFrame(probes, "symbol string, timeframe string, pid long, side string, price double, last_index long")
    for r in levels.first_beyond(b, p, CHUNKED).collect():
        later = range(r["last_index"] + 1, 60)
        want = [t for t in later if (series["A"][t][1] > r["price"] if r["side"] == "buy_side" else series["A"][t][2] < r["price"])]
        assert r["hit_idx"] == (want[0] if want else None)


def test_first_hit_search_is_as_deep_as_the_series(spark, monkeypatch):
    """More bars than three levels of four children hold: a hit beyond them is found."""
    monkeypatch.setattr(levels, "RADIX", 4)
    bars = [(10.0, 11.0, 9.0, 10.0, 1.0)] * 300
    bars[270] = (10.0, 20.0, 9.0, 10.0, 1.0)
    b = stage(S.index_bars(frame(spark, {"A": bars}), CHUNKED))
    p = spark.createDataFrame(
        [("A", "H1", 0, "buy_side", 15.0, 3), ("A", "H1", 1, "sell_side", 5.0, 3)],
        "symbol string, timeframe string, pid long, side string, price double, last_index long",
    )
    got = {r["pid"]: r["hit_idx"] for r in levels.first_beyond(b, p, CHUNKED).collect()}
    assert got == {0: 270, 1: None}


def test_bounded_groups_may_be_long(spark):
    series = {"A": brute.walk(6000, 21)}
    b = stage(S.index_bars(frame(spark, series), CHUNKED))
    long_group = Layout(bounded=True)
    df = S.recur(
        S.extend(b, long_group), long_group,
        [S.ema(f"e{n}", F.col("close"), n) for n in (9, 50, 200)] + [S.Affine("s", F.col("volume"), 1.0)],
    )
    got = rows(df.select("bar_idx", "e9", "e50", "e200", "s"), "bar_idx")
    closes, total = [x[3] for x in series["A"]], 0.0
    want = {n: brute.smoothed(closes, 2.0 / (n + 1)) for n in (9, 50, 200)}
    for i, r in enumerate(got):
        total += series["A"][i][4]
        assert abs(r["s"] - total) < 1e-6
        for n in (9, 50, 200):
            assert abs(r[f"e{n}"] - want[n][i]) < 1e-8 * abs(want[n][i])


def test_load_is_strict_unless_told(spark):
    good = [("A", "H1", T0 + dt.timedelta(hours=i), 10.0, 11.0, 9.0, 10.5, 1.0) for i in range(4)]
    schema = "symbol string, timeframe string, ts timestamp, open double, high double, low double, close double, volume double"
    make = lambda extra: spark.createDataFrame(good + extra, schema).coalesce(1)
    assert src.load_series(make([])).count() == 4
    again = make([(*good[1][:6], 9.5, 2.0)])
    assert src.load_series(again).where("close = 9.5").count() == 1  # the later copy stays
    at = T0 + dt.timedelta(hours=9)
    for bad in [
        ("A", "H1", at, None, 11.0, 9.0, 10.0, 1.0),
        ("A", "H1", at, 10.0, 8.0, 9.0, 10.0, 1.0),
        ("A", "H1", at, -1.0, 11.0, -2.0, 10.0, 1.0),
        ("B", "H1", at, 10.0, 11.0, 9.0, 10.0, 1.0),
    ]:
        with pytest.raises(src.CandleError):
            src.load_series(make([bad]))
        assert src.load_series(make([bad]), strict=False).count() == 4


def test_features_of_a_window_equal_the_window_alone(spark, data):
    series = {"A": data["A"][:260]}
    b = stage(S.index_bars(frame(spark, series), CHUNKED))
    t = windowed.window_features(b, window=120, horizon=5, stride=60, feature_set="v185", layout=CHUNKED)
    got = rows(t, "decision_idx")
    assert [r["decision_idx"] for r in got] == [119, 179, 239]
    inside = b.where("bar_idx BETWEEN 60 AND 179").drop("bar_idx")
    alone = stage(S.index_bars(inside, SHORT))
    want = X.snapshot_features(alone, "v185", layout=SHORT).collect()[0].asDict()
    for n in X.feature_names("v185"):
        assert abs(got[1][n] - want[n]) < 1e-8, n
    assert dataset.leakage_violations(t).isEmpty()


def test_feature_counts():
    assert len(X.feature_names("v156")) == 156
    assert len(X.feature_names("v185")) == 185
    assert len(set(X.feature_names("union"))) == len(X.feature_names("union"))
    assert X.schema_issues(["a", "b"], ["b", "a"]) == ["order"]
    assert X.schema_issues(["a", "b"], ["a", "c", "d"]) == ["count:2!=3", "missing:b", "extra:c", "extra:d"]


def test_gap_fill_and_state(bars):
    a = imbalance.fair_value_gaps(bars, layout=CHUNKED)
    b = imbalance.fair_value_gaps(bars, layout=SHORT)
    order = ("symbol", "bar_idx", "direction")
    close(rows(a, *order), rows(b, *order))


def test_fill_gaps_keeps_the_grid(spark):
    base = brute.walk(30, 4)
    df = frame(spark, {"A": base}).where("hour(ts) % 7 <> 3 OR day(ts) > 1")
    got = rows(src.fill_gaps(df), "ts")
    assert len(got) == 30
    for prev, r in zip(got, got[1:], strict=False):
        if r["is_filled"]:
            assert r["volume"] == 0 and r["open"] == r["close"] == prev["close"]


def test_bad_rows_are_quarantined(spark):
    raw = spark.createDataFrame(
        [("A", "H1", "2024-01-01 00:00:00", "1", "2", "0.5", "1.5", "x"), ("A", "H1", "2024-01-01 01:00:00", "?", "2", "1", "1", "3")],
        "symbol string, timeframe string, ts string, open string, high string, low string, close string, volume string",
    )
    good, bad = src.split_bad(raw)
    assert [(r["close"], r["volume"]) for r in good.collect()] == [(1.5, 0.0)]
    assert bad.count() == 1
    with pytest.raises(src.CandleError):
        src.split_bad(raw, strict=True)
    with pytest.raises(src.CandleError):
        src.require_columns(raw.drop("close"))


def test_round_trip(spark, data, tmp_path):
    df = frame(spark, {"C": data["C"]})
    for fmt in ("csv", "parquet"):
        src.write_table(df, str(tmp_path / fmt), fmt)
        back = src.conform(src.read_candles(spark, str(tmp_path / fmt), fmt)).drop("bad_prices")
        key = lambda r: r["ts"]
        a = sorted((r.asDict() for r in df.select("ts", "close", "volume").collect()), key=key)
        b = sorted((r.asDict() for r in back.select("ts", "close", "volume").collect()), key=key)
        assert a == b


def test_quantiles_are_exact_with_a_hot_value(spark):
    vals = [5.0] * 400 + [float(i) for i in range(200)] + [0.25, 7.5]
    df = spark.createDataFrame([("k", v) for v in vals], "k string, v double")
    got = S.quantiles(df, ["k"], "v", {"a": 0.1, "m": 0.5, "z": 0.93}).first()
    want = df.groupBy("k").agg(*[F.percentile("v", F.lit(x)).alias(n) for n, x in (("a", 0.1), ("m", 0.5), ("z", 0.93))]).first()
    assert [got[c] for c in "amz"] == pytest.approx([want[c] for c in "amz"])


def test_gram_regression_by_key(spark):
    pts = [(k, float(x), float(z), 2.0 * x - z + (3 if k == "a" else -1)) for k in "ab" for x in range(20) for z in (x % 3, x % 5)]
    df = spark.createDataFrame(pts, "k string, x double, z double, y double")
    got = {(r["k"], r["term"]): r["coefficient"] for r in gram.ols_by_key(df, ["k"], ["x", "z"], "y").collect()}
    assert got[("a", "intercept")] == pytest.approx(3.0)
    assert got[("b", "x")] == pytest.approx(2.0)
    assert got[("b", "z")] == pytest.approx(-1.0)


def test_unit_root_tells_noise_from_a_walk(spark):
    import random

    r, level, out = random.Random(5), 0.0, []
    for i in range(600):
        e = r.gauss(0, 1)
        level += e
        out += [("noise", i, e), ("walk", i, level)]
    df = spark.createDataFrame(out, "k string, bar_idx long, y double")
    t = diagnostics.unit_root(df, ["k"], "y", Layout(keys=("k",), chunk=128))
    got = {x["k"]: x for x in t.collect()}
    assert got["noise"]["is_stationary_5pct"] and not got["walk"]["is_stationary_5pct"]


def test_normal_quantile(spark):
    p = [0.001, 0.02, 0.3, 0.5, 0.8, 0.999]
    df = spark.createDataFrame([(x,) for x in p], "p double")
    from statistics import NormalDist

    got = [r[0] for r in df.select(diagnostics.normal_quantile(F.col("p"))).collect()]
    assert got == pytest.approx([NormalDist().inv_cdf(x) for x in p], abs=1e-7)


def test_attach_is_the_same_join_beyond_the_broadcast_limit(spark, monkeypatch):
    df = spark.range(1000).select(F.when(F.col("id") < 700, 0).otherwise(F.col("id") % 5).alias("k"), "id")
    facts = df.groupBy("k").agg(F.count("*").alias("n"))
    key = lambda t: sorted(map(tuple, t.select("k", "id", "n").collect()))
    small = key(S.attach(df, facts, ["k"], "id"))
    monkeypatch.setattr(S, "BROADCAST_BYTES", 2)
    assert key(S.attach(df, facts, ["k"], "id")) == small == key(df.join(facts, "k"))
