"""Assembly of the flat feature table and its schema checks."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwick.config import DEFAULT, DEFAULT_LAYOUT, AnalysisConfig, Layout
from sparkwick.functions.columns import (
    add,
    body,
    flag,
    lower_wick,
    or_default,
    safe_divide,
    session_columns,
    upper_wick,
)
from sparkwick.operators import imbalance, levels, structure
from sparkwick.operators import scan as S
from sparkwick.operators.indicators import INDICATORS, indicators
from sparkwick.operators.patterns import PATTERNS, patterns
from sparkwick.operators.structure import MICRO
from sparkwick.sources.staging import stage

C = F.col

# Feature groups in vector order.
TREND = (
    "direction", "higher_highs", "higher_lows", "lower_highs", "lower_lows", "strength",
    "duration_bars", "momentum",
)
STRUCTURE = (
    "last_bos_direction", "last_bos_strength", "bars_since_bos", "bullish_bos_count",
    "bearish_bos_count", "last_choch_direction", "last_choch_strength", "bars_since_choch",
    "choch_count",
)
PRICE_ACTION = (
    "current_close", "previous_close", "price_change", "price_return", "percentage_return",
    "body_size", "upper_wick", "lower_wick", "body_ratio", "candle_range", "atr_ratio", "gap_up",
    "gap_down", "distance_from_ema20", "distance_from_ema50", "distance_from_ema200",
    "distance_from_vwap",
)
VOLATILITY = (
    "rolling_volatility", "atr", "true_range", "historical_volatility", "average_candle_size",
    "average_wick_size", "expansion", "compression",
)
SESSION = (
    "is_sydney", "is_asian", "is_london", "is_newyork", "session_overlap", "hour", "minute",
    "day_of_week", "month",
)
ZONE = (
    "support_zone_count", "resistance_zone_count", "nearest_support_strength",
    "nearest_support_touches", "nearest_support_width", "nearest_resistance_strength",
    "nearest_resistance_touches", "nearest_resistance_width", "distance_to_support",
    "distance_to_resistance",
)
LIQUIDITY = (
    "equal_highs", "equal_lows", "pool_count", "sweep_count", "buy_side", "sell_side",
    "last_sweep_direction", "last_sweep_size",
)
GAP = (
    "bullish_count", "bearish_count", "unfilled_count", "nearest_direction", "nearest_size_atr",
    "nearest_age", "distance_to_nearest",
)
BLOCK = (
    "bullish_count", "bearish_count", "unmitigated_count", "nearest_direction",
    "nearest_strength", "nearest_freshness", "nearest_age", "distance_to_nearest",
)
SPREAD = imbalance.SPREAD

# Bars an indicator needs before it is valid (default periods).
WARMUP = {
    "adx": 14, "atr": 14, "bb_lower": 20, "bb_upper": 20, "cci": 20, "ema_100": 100,
    "ema_20": 20, "ema_200": 200, "ema_50": 50, "macd": 26, "macd_signal": 35, "momentum": 10,
    "relative_volume": 20, "roc": 10, "rolling_median": 20, "rsi": 14, "sma": 20, "std_dev": 20,
    "stoch_d": 17, "stoch_k": 14, "true_range": 1, "volatility": 21, "volume_delta": 20,
    "volume_ma": 20, "volume_ratio": 2, "volume_spike": 20, "volume_trend": 40, "vwap": 1,
    "williams_r": 14,
}
# What the reduced feature set leaves out.
DROPPED = {
    "vol_atr", "vol_true_range", "vol_rolling_volatility", "ind_macd_histogram",
    "ind_rolling_mean", "ind_bb_middle", "ind_rolling_variance", "pa_percentage_return",
    "pat_harami", "pat_marubozu", "pat_pin_bar", "pat_bullish_score", "pat_bearish_score",
    "session_session_overlap",
}


def _prefixed(prefix: str, names) -> list[str]:
    return [f"{prefix}_{n}" for n in names]


def feature_names(feature_set: str = "v156") -> list[str]:
    """Ordered names: ``v156``, ``v185`` (fewer duplicates, validity flags) or ``union``."""
    validity = {
        "trend": ["trend_valid"],
        "vol": ["vol_valid"],
        "micro": ["micro_valid"],
        "sr": ["sr_support_valid", "sr_resistance_valid"],
    }
    ind = []
    for n in INDICATORS:
        ind.append(f"ind_{n}")
        if n in WARMUP or n == "tick_volume":
            ind.append(f"ind_{n}_valid")
    groups = [
        ("n", ["n_candles"]),
        ("trend", _prefixed("trend", TREND)),
        ("structure", _prefixed("structure", STRUCTURE)),
        ("pa", _prefixed("pa", PRICE_ACTION)),
        ("vol", _prefixed("vol", VOLATILITY)),
        ("micro", _prefixed("micro", MICRO)),
        ("session", _prefixed("session", SESSION)),
        ("spread", _prefixed("spread", SPREAD)),
        ("sr", _prefixed("sr", ZONE)),
        ("liq", _prefixed("liq", LIQUIDITY)),
        ("fvg", _prefixed("fvg", GAP)),
        ("ob", _prefixed("ob", BLOCK)),
        ("ind", ind),
        ("pat", [*_prefixed("pat", PATTERNS), "pat_bullish_score", "pat_bearish_score"]),
    ]
    union = [n for g, names in groups for n in [*names, *validity.get(g, [])]]
    if feature_set == "union":
        return union
    if feature_set == "v185":
        return [n for n in union if n not in DROPPED]
    if feature_set == "v156":
        return [n for n in union if not n.endswith("_valid") and not n.startswith("spread_")]
    raise ValueError(f"unknown feature set {feature_set!r}")


# --------------------------------------------------------------------------- per-bar features


def _ahead_columns(cfg: AnalysisConfig, w) -> dict[str, Column]:
    """Window columns that need no recurrence, evaluated on the extended chunk."""
    recent = w.rowsBetween(-(cfg.hist_vol_window - 1), 0)
    log_c = F.ln(F.greatest("close", F.lit(1e-12)))
    prev = lambda c: F.coalesce(F.lag(c).over(w), C(c))
    return {
        "_lret": F.when(
            C("bar_idx") > 0, log_c - F.ln(F.greatest(F.lag("close").over(w), F.lit(1e-12)))
        ),
        "_prev_close": prev("close"),
        "_prev_high": prev("high"),
        "_prev_low": prev("low"),
        "_size": F.avg(C("high") - C("low")).over(recent),
        "_wick": F.avg(upper_wick() + lower_wick()).over(recent),
    }


def _flags(cfg: AnalysisConfig) -> dict[str, Column]:
    n = C("bar_idx") + 1
    out = {f"ind_{k}_valid": flag(n >= need) for k, need in WARMUP.items()}
    out["ind_tick_volume_valid"] = flag(C("_has_tick"))
    out["vol_valid"] = flag(n >= cfg.hist_vol_window)
    return out


def bar_features(
    bars: DataFrame, cfg: AnalysisConfig = DEFAULT, layout: Layout = DEFAULT_LAYOUT
) -> DataFrame:
    """Every feature that is a function of the bar and its past windows, as of each bar.

    Groups n, pa, vol, session, spread, ind and pat; ``bar_idx`` counts from the series start.
    """
    w = S.bar_window(layout)
    extra = {
        **_ahead_columns(cfg, w),
        **imbalance.spread_columns(cfg, layout),
        "_has_tick": C("tick_volume").isNotNull(),
    }
    rows = indicators(bars, None, cfg, layout, extended=True, extra=extra)
    recent = w.rowsBetween(-(cfg.hist_vol_window - 1), 0)
    rows = rows.withColumns(
        {
            "_atr_mean": F.avg("atr").over(recent),
            "_hv": F.when(F.count("_lret").over(recent) >= 2, F.stddev_pop("_lret").over(recent)),
        }
    )
    rows = S.core_rows(patterns(rows, layout, extended=True))
    stats = structure.series_stats(bars, layout)
    rows = S.attach(rows, stats, layout.keys, "bar_idx", layout.bounded)
    atr = F.coalesce(C("atr"), F.lit(0.0))
    unit = F.greatest(atr, F.lit(1e-12))
    close, prev = C("close"), C("_prev_close")
    change = close - prev
    away = lambda c: (close - C(c)) / unit
    ratio = F.when(C("_atr_mean") != 0, atr / C("_atr_mean")).otherwise(1.0)
    pa = {
        "current_close": close,
        "previous_close": prev,
        "price_change": change,
        "price_return": safe_divide(change, prev),
        "percentage_return": safe_divide(change, prev) * 100.0,
        "body_size": body(),
        "upper_wick": upper_wick(),
        "lower_wick": lower_wick(),
        "body_ratio": body() / F.greatest(C("high") - C("low"), F.lit(1e-12)),
        "candle_range": C("high") - C("low"),
        "atr_ratio": (C("high") - C("low")) / unit,
        "gap_up": flag(F.least("open", "low") > C("_prev_high")),
        "gap_down": flag(F.greatest("open", "high") < C("_prev_low")),
        "distance_from_ema20": away("ema_20"),
        "distance_from_ema50": away("ema_50"),
        "distance_from_ema200": away("ema_200"),
        "distance_from_vwap": away("vwap"),
    }
    vol = {
        "rolling_volatility": C("volatility"),
        "atr": atr,
        "true_range": C("true_range"),
        "historical_volatility": C("_hv"),
        "average_candle_size": C("_size"),
        "average_wick_size": C("_wick"),
        "expansion": flag(ratio >= cfg.expansion_ratio),
        "compression": flag(ratio <= cfg.compression_ratio),
    }
    out = {
        "n_candles": (C("bar_idx") + 1).cast("double"),
        **{f"pa_{k}": or_default(v) for k, v in pa.items()},
        **{f"vol_{k}": or_default(v) for k, v in vol.items()},
        **session_columns(C("ts"), cfg),
        **imbalance.spread_values(cfg, F.coalesce(C("atr"), C("atr_fallback"))),
        **{f"ind_{n}": or_default(C(n)) for n in INDICATORS},
        **{f"pat_{n}": C(n) for n in (*PATTERNS, "bullish_score", "bearish_score")},
        **_flags(cfg),
    }
    passed = [c for c in bars.columns if c not in INDICATORS]
    return rows.select(*passed, "n_bars", *[v.alias(k) for k, v in out.items()])


# --------------------------------------------------------------------------- snapshots


def event_tables(
    bars: DataFrame, cfg: AnalysisConfig = DEFAULT, layout: Layout = DEFAULT_LAYOUT
) -> dict[str, DataFrame]:
    """The event tables and per-series summaries behind the snapshot features.

    Tables that several others read are staged, so none of them is computed twice.
    """
    keys = list(layout.keys)
    rows = stage(structure.swing_bars(bars, cfg, layout))
    now = stage(structure.atr_now(rows, keys))
    sw = stage(structure.swings_from(rows, layout))
    tr = stage(structure.trend(sw, now, cfg, layout))
    br = structure.breaks_from(rows, layout)
    zn = levels.zones(sw, now, cfg, layout)
    pl = levels.sweeps(bars, levels.pools(sw, now, cfg, layout), cfg, layout)
    fv = imbalance.fair_value_gaps(bars, cfg, layout)
    ob = imbalance.order_blocks(bars, now, cfg, layout)
    return {
        "now": now,
        "swings": sw,
        "trend": tr,
        "breaks": br,
        "structure": structure.structure_summary(br, now, layout),
        "micro": structure.microstructure(sw, tr, layout),
        "zones": zn,
        "sr": levels.nearest_zones(zn, now, layout),
        "pools": pl,
        "liq": levels.liquidity_summary(pl, now, layout),
        "gaps": fv,
        "fvg": imbalance.gap_summary(fv, now, layout),
        "blocks": ob,
        "ob": imbalance.block_summary(ob, now, layout),
    }


def snapshot_features(
    bars: DataFrame,
    feature_set: str = "v156",
    cfg: AnalysisConfig = DEFAULT,
    layout: Layout = DEFAULT_LAYOUT,
) -> DataFrame:
    """One row per series: the full feature vector as of its last bar."""
    ev = event_tables(bars, cfg, layout)
    last = bar_features(bars, cfg, layout).where(C("bar_idx") == C("n_bars") - 1)
    return assembled(stage(last), ev, feature_set, layout)


def assembled(
    last: DataFrame, ev: dict[str, DataFrame], feature_set: str, layout: Layout = DEFAULT_LAYOUT
) -> DataFrame:
    """Features of one bar per key next to the summaries of its events, in vector order."""
    keys = list(layout.keys)

    def group(table: str, prefix: str, names, more=()):
        cols = [or_default(C(n).cast("double")).alias(f"{prefix}_{n}") for n in names]
        return ev[table].select(*keys, *cols, *more)

    moves = add([C(n) for n in TREND[1:5]])
    parts = [
        group(
            "trend",
            "trend",
            TREND,
            [flag(moves > 0).alias("trend_valid"), flag(C("n_swings") >= 3).alias("micro_valid")],
        ),
        group("structure", "structure", STRUCTURE),
        group("micro", "micro", MICRO),
        group(
            "sr",
            "sr",
            ZONE,
            [
                flag(C("has_support")).alias("sr_support_valid"),
                flag(C("has_resistance")).alias("sr_resistance_valid"),
            ],
        ),
        group(
            "liq", "liq", LIQUIDITY, [C("bars_since_sweep").alias("liq_bars_since_sweep")]
        ),
        group("fvg", "fvg", GAP),
        group("ob", "ob", BLOCK),
    ]
    wide = last
    for p in parts:
        wide = wide.join(p, keys, "left")
    more = ["liq_bars_since_sweep"] if feature_set == "union" else []
    return wide.select(*keys, "ts", *feature_names(feature_set), *more)


def series_features(
    bars: DataFrame,
    cfg: AnalysisConfig = DEFAULT,
    layout: Layout = DEFAULT_LAYOUT,
    rows: DataFrame | None = None,
    sw: DataFrame | None = None,
) -> DataFrame:
    """Per-bar features (continuous from the series start) plus the structure state as of the bar.

    A swing counts once it is confirmed and a break from its own bar on; the state is computed on
    the event tables and carried forward to the bars, so the cost stays linear in the bars.
    """
    keys = list(layout.keys)
    k = cfg.swing_window
    rows = rows if rows is not None else stage(structure.swing_bars(bars, cfg, layout))
    sw = sw if sw is not None else structure.swings_from(rows, layout)
    br = structure.breaks_from(rows, layout)
    feats = bar_features(bars, cfg, layout).drop("n_bars")
    at_conf = sw.groupBy(*keys, (C("bar_idx") + k).alias("bar_idx")).agg(F.count("*").alias("_sw"))
    flips = C("prev_direction") != C("direction")
    at_break = br.groupBy(*keys, "bar_idx").agg(
        F.count_if(C("direction") == "bullish").alias("_bull"),
        F.count_if(C("direction") == "bearish").alias("_bear"),
        F.count_if(flips).alias("_flip"),
        F.max_by(F.struct("direction", "strength", "bar_idx"), "side_order").alias("_brk"),
        F.max_by(
            F.struct("direction", "strength", "bar_idx"), F.when(flips, C("side_order"))
        ).alias("_chg"),
    )
    t = feats.join(at_conf, [*keys, "bar_idx"], "left").join(at_break, [*keys, "bar_idx"], "left")
    bucket = None
    if not layout.bounded:
        bucket = "_xb"
        t = t.withColumn("_xb", F.floor(C("bar_idx") / layout.chunk))
    zero = lambda c: F.coalesce(C(c), F.lit(0))
    t = S.scan(
        t,
        keys,
        ["bar_idx"],
        [
            S.Scan("_n_sw", "sum", zero("_sw")),
            S.Scan("_n_bull", "sum", zero("_bull")),
            S.Scan("_n_bear", "sum", zero("_bear")),
            S.Scan("_n_flip", "sum", zero("_flip")),
            S.Scan("_l_brk", "last", C("_brk")),
            S.Scan("_l_chg", "last", C("_chg")),
        ],
        bucket,
    )
    sign = lambda e: F.coalesce(
        F.when(C(e)["direction"] == "bullish", 1.0).when(C(e).isNotNull(), -1.0), F.lit(0.0)
    )
    dbl = lambda c: C(c).cast("double")
    state = {
        "structure_last_bos_direction": sign("_l_brk"),
        "structure_last_bos_strength": F.coalesce(C("_l_brk")["strength"], F.lit(0.0)),
        "structure_bars_since_bos": F.coalesce(
            (C("bar_idx") - C("_l_brk")["bar_idx"]).cast("double"), F.lit(-1.0)
        ),
        "structure_bullish_bos_count": dbl("_n_bull"),
        "structure_bearish_bos_count": dbl("_n_bear"),
        "structure_last_choch_direction": sign("_l_chg"),
        "structure_last_choch_strength": F.coalesce(C("_l_chg")["strength"], F.lit(0.0)),
        "structure_bars_since_choch": F.coalesce(
            (C("bar_idx") - C("_l_chg")["bar_idx"]).cast("double"), F.lit(-1.0)
        ),
        "structure_choch_count": dbl("_n_flip"),
        "swing_count": dbl("_n_sw"),
    }
    return t.select(*feats.columns, *[v.alias(n) for n, v in state.items()])


# --------------------------------------------------------------------------- windows


def decision_windows(
    bars: DataFrame,
    window: int,
    horizon: int = 1,
    stride: int = 1,
    layout: Layout = DEFAULT_LAYOUT,
) -> tuple[DataFrame, Layout]:
    """Copy every bar into the trailing windows that contain it.

    Each window becomes its own short series keyed by ``decision_idx``, so every operator runs on
    it unchanged and in parallel; no window is longer than ``window`` bars.
    """
    if window < 3 or horizon < 1 or stride < 1:
        raise ValueError("window >= 3, horizon >= 1 and stride >= 1 are required")
    keys = list(layout.keys)
    n = bars.groupBy(*keys).agg(F.max("bar_idx").alias("_last"))
    t = S.attach(bars, n, keys, "bar_idx", layout.bounded)
    first = F.greatest(F.ceil((C("bar_idx") - (window - 1)) / stride), F.lit(0)).cast("long")
    last = F.least(
        F.floor(C("bar_idx") / stride), F.floor((C("_last") - horizon - (window - 1)) / stride)
    ).cast("long")
    t = t.withColumns({"_a": first, "_z": last}).where(C("_a") <= C("_z"))
    t = t.withColumn("_j", F.explode(F.sequence("_a", "_z")))
    t = t.withColumn("decision_idx", C("_j") * stride + (window - 1)).drop("_j")
    t = t.withColumn("bar_idx", C("bar_idx") - (C("decision_idx") - (window - 1)))
    return t.drop("_a", "_z", "_last"), layout.per("decision_idx")


def copied_window_features(
    bars: DataFrame,
    window: int = 500,
    horizon: int = 1,
    stride: int = 1,
    feature_set: str = "v156",
    cfg: AnalysisConfig = DEFAULT,
    layout: Layout = DEFAULT_LAYOUT,
) -> DataFrame:
    """``windowed.window_features`` by the definition: a snapshot of a copy of every window."""
    fan, short = decision_windows(bars, window, horizon, stride, layout)
    out = snapshot_features(stage(fan), feature_set, cfg, short)
    return out.withColumns(
        {
            "window_end_idx": C("decision_idx"),
            "window_start_idx": C("decision_idx") - (window - 1),
            "label_idx": C("decision_idx") + horizon,
        }
    )


# --------------------------------------------------------------------------- schema


def completeness(columns) -> Column:
    """Mean of the validity flags of a row (1 when there are none)."""
    flags = [c for c in columns if c.endswith("_valid")]
    return add([C(c) for c in flags]) / len(flags) if flags else F.lit(1.0)


def fingerprint(names) -> str:
    """SHA-256 over the ordered names."""
    return hashlib.sha256("\n".join(names).encode()).hexdigest()


def schema_issues(expected: list[str], actual: list[str]) -> list[str]:
    """Codes for every way two ordered feature lists differ."""
    out = []
    if len(expected) != len(actual):
        out.append(f"count:{len(expected)}!={len(actual)}")
    if list(expected) != list(actual):
        if sorted(expected) == sorted(actual):
            out.append("order")
        out += [f"missing:{n}" for n in sorted(set(expected) - set(actual))]
        out += [f"extra:{n}" for n in sorted(set(actual) - set(expected))]
    return out


def require_schema(expected: list[str], df: DataFrame) -> DataFrame:
    """The features of ``df`` in the expected order; raises when one is missing."""
    missing = [n for n in expected if n not in df.columns]
    if missing:
        raise ValueError(f"missing features: {missing}")
    rest = [c for c in df.columns if c not in set(expected)]
    return df.select(*rest, *expected)
