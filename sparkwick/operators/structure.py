"""Market structure events: swings, trend, breaks of structure, changes of character."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwick.config import DEFAULT, DEFAULT_LAYOUT, AnalysisConfig, Layout
from sparkwick.functions.columns import safe_divide
from sparkwick.operators import scan as S
from sparkwick.operators.indicators import indicators

C = F.col
# events are bucketed by this many bars, so that event windows stay bounded as well
EVENT_BUCKET = 65536


def event_bucket(idx: str = "bar_idx") -> Column:
    return F.floor(C(idx) / EVENT_BUCKET)


def series_stats(bars: DataFrame, layout: Layout = DEFAULT_LAYOUT) -> DataFrame:
    """Bars per series, the last close, and the median bar range that replaces a missing ATR."""
    tail = bars.groupBy(*layout.keys).agg(
        F.count("*").alias("n_bars"), F.max_by("close", "bar_idx").alias("last_close")
    )
    med = S.quantiles(
        bars.withColumn("_hl", C("high") - C("low")),
        layout.keys,
        "_hl",
        {"_med": 0.5},
        layout.bounded,
    )
    fallback = F.when(C("_med") == 0.0, 1.0).otherwise(C("_med")).alias("atr_fallback")
    return tail.join(med, list(layout.keys)).select(
        *layout.keys, "n_bars", "last_close", fallback
    )


def with_atr(
    bars: DataFrame, cfg: AnalysisConfig = DEFAULT, layout: Layout = DEFAULT_LAYOUT, **more
) -> DataFrame:
    """Add ``atr`` and ``atr_eff`` (the fallback where ATR is missing or zero)."""
    rows = indicators(bars, ["atr"], cfg, layout, **more)
    return _effective(rows, series_stats(bars, layout), layout)


def _effective(rows: DataFrame, stats: DataFrame, layout: Layout) -> DataFrame:
    rows = S.attach(rows, stats, layout.keys, "bar_idx", layout.bounded)
    return rows.withColumn("atr_eff", F.when(C("atr") > 0, C("atr")).otherwise(C("atr_fallback")))


def atr_now(rows: DataFrame, keys) -> DataFrame:
    """Last known ATR per series, the median range when there is none, and series facts.

    ``atr_last`` is the same at the last bar only, with the median range for a zero as well.
    """
    return rows.groupBy(*keys).agg(
        F.max_by("atr_eff", "bar_idx").alias("atr_last"),
        F.coalesce(
            F.max_by("atr", F.when(C("atr").isNotNull(), C("bar_idx"))), F.max("atr_fallback")
        ).alias("atr_now"),
        F.max("n_bars").alias("n_bars"),
        F.max("last_close").alias("last_close"),
    )


# --------------------------------------------------------------------------- swings


def _pivot_flags(df: DataFrame, cfg: AnalysisConfig, layout: Layout) -> DataFrame:
    """Mark bars that are the extreme of a centered window, without repeats on a plateau."""
    k, w = cfg.swing_window, S.bar_window(layout)
    around = w.rowsBetween(-k, k)
    full = F.count("*").over(around) == 2 * k + 1
    df = df.withColumns(
        {
            "_cand_high": full & (C("high") >= F.max("high").over(around)),
            "_cand_low": full & (C("low") <= F.min("low").over(around)),
        }
    )
    out = {}
    for side, price in (("high", "high"), ("low", "low")):
        one = F.coalesce(F.lag(f"_cand_{side}", 1).over(w), F.lit(False))
        two = F.coalesce(F.lag(f"_cand_{side}", 2).over(w), F.lit(False))
        same1 = F.lag(price, 1).over(w) == C(price)
        same2 = F.lag(price, 2).over(w) == C(price)
        # only the candidate right before counts: two bars back when the bar between is none
        repeat = (one & same1) | (~one & two & same2)
        out[f"is_{side}"] = C(f"_cand_{side}") & ~repeat
    left, right = w.rowsBetween(-k, -1), w.rowsBetween(1, k)
    beside_high = F.greatest(F.max("high").over(left), F.max("high").over(right))
    beside_low = F.least(F.min("low").over(left), F.min("low").over(right))
    out["_prom_high"] = F.coalesce(C("high") - beside_high, F.lit(0.0))
    out["_prom_low"] = F.coalesce(beside_low - C("low"), F.lit(0.0))
    return df.withColumns(out)


def swing_bars(
    bars: DataFrame, cfg: AnalysisConfig = DEFAULT, layout: Layout = DEFAULT_LAYOUT
) -> DataFrame:
    """Bars with swing flags, ATR and the last confirmed high and low swing as of each bar.

    The as-of levels ride on the same carry join as the ATR.
    """
    df = _pivot_flags(S.extend(bars, layout), cfg, layout)
    k = cfg.swing_window
    level = lambda side: F.when(
        C(f"is_{side}"), F.struct(C("bar_idx").alias("idx"), C(side).alias("price"))
    )
    w = S.bar_window(layout)
    prev_close = F.coalesce(F.lag("close").over(w), C("close"))
    df = df.withColumn(
        "_tr",
        F.greatest(
            C("high") - C("low"), F.abs(C("high") - prev_close), F.abs(C("low") - prev_close)
        ),
    )
    df = S.recur(
        df,
        layout,
        [S.wilder("_tr_s", C("_tr"), cfg.atr_period)],
        [S.Fill("level_high", level("high"), k), S.Fill("level_low", level("low"), k)],
    )
    df = df.withColumn("atr", F.when(C("bar_idx") >= cfg.atr_period - 1, C("_tr_s")))
    kept = [*bars.columns, "is_high", "is_low", "_prom_high", "_prom_low", "atr"]
    df = S.core_rows(df).select(*kept, "level_high", "level_low")
    return _effective(df, series_stats(bars, layout), layout)


def swings_from(rows: DataFrame, layout: Layout = DEFAULT_LAYOUT) -> DataFrame:
    """Long event table of swings; the high comes first when a bar is both."""
    sides = [
        F.when(
            C(f"is_{s}"),
            F.struct(
                F.lit(s).alias("kind"),
                F.lit(o).alias("side_order"),
                C(s).alias("price"),
                safe_divide(F.greatest(C(f"_prom_{s}"), F.lit(0.0)), C("atr_eff")).alias(
                    "strength"
                ),
            ),
        )
        for o, s in enumerate(("high", "low"))
    ]
    ev = rows.where(C("is_high") | C("is_low")).select(
        *layout.keys, "bar_idx", "ts", F.explode(F.array_compact(F.array(*sides))).alias("e")
    )
    ev = ev.select(*layout.keys, "bar_idx", "ts", "e.*")
    bucket = None if layout.bounded else "_eb"
    ev = ev if layout.bounded else ev.withColumn("_eb", event_bucket())
    same_kind = S.scan(
        ev,
        [*layout.keys, "kind"],
        ["bar_idx"],
        [
            S.Scan("prev_idx", "prev", C("bar_idx")),
            S.Scan("prev_price", "prev", C("price")),
        ],
        bucket,
    )
    gap = F.coalesce(C("bar_idx") - C("prev_idx"), F.lit(0)).cast("long")
    return same_kind.withColumn("distance_from_previous", gap).drop("_eb")


def swings(
    bars: DataFrame, cfg: AnalysisConfig = DEFAULT, layout: Layout = DEFAULT_LAYOUT
) -> DataFrame:
    return swings_from(swing_bars(bars, cfg, layout), layout)


# --------------------------------------------------------------------------- trend


def _latest(df: DataFrame, keys, order, n: int, name: str = "rn") -> DataFrame:
    """The last ``n`` rows per key (a top-n: cut per task before the shuffle)."""
    w = Window.partitionBy(*keys).orderBy(*[C(o).desc() for o in order])
    return df.withColumn(name, F.row_number().over(w)).where(C(name) <= n)


def trend(
    swing_events: DataFrame,
    stats: DataFrame,
    cfg: AnalysisConfig = DEFAULT,
    layout: Layout = DEFAULT_LAYOUT,
) -> DataFrame:
    """Trend state per series from its swings; ``stats`` has n_bars and last_close."""
    keys = list(layout.keys)
    recent = _latest(swing_events, [*keys, "kind"], ["bar_idx"], cfg.trend_swing_lookback)
    step = F.when(C("rn") < cfg.trend_swing_lookback, C("price") - C("prev_price"))
    n = lambda kind, cond: F.count_if((C("kind") == kind) & cond)
    counts = recent.groupBy(*keys).agg(
        n("high", step > 0).alias("higher_highs"),
        n("low", step > 0).alias("higher_lows"),
        n("high", step < 0).alias("lower_highs"),
        n("low", step < 0).alias("lower_lows"),
        F.regr_slope("price", C("bar_idx").cast("double")).alias("_slope"),
        F.count("*").alias("_n_recent"),
    )
    up, dn = C("prev_price") < C("price"), C("prev_price") >= C("price")
    kind_is = lambda k: C("kind") == k
    anchors = swing_events.groupBy(*keys).agg(
        F.count("*").alias("n_swings"),
        F.max("bar_idx").alias("last_swing"),
        F.min("bar_idx").alias("first_swing"),
        F.max(F.when(kind_is("high") & dn, C("bar_idx"))).alias("_bull_turn"),
        F.min(F.when(kind_is("high"), C("bar_idx"))).alias("_first_high"),
        F.count_if(kind_is("high")).alias("_n_high"),
        F.max(F.when(kind_is("low") & up, C("bar_idx"))).alias("_bear_turn"),
        F.min(F.when(kind_is("low"), C("bar_idx"))).alias("_first_low"),
        F.count_if(kind_is("low")).alias("_n_low"),
    )
    t = stats.join(anchors, keys, "left").join(counts, keys, "left")
    zero = lambda c: F.coalesce(C(c), F.lit(0))
    moves = {c: zero(c) for c in ("higher_highs", "higher_lows", "lower_highs", "lower_lows")}
    t = t.withColumns({**moves, "n_swings": zero("n_swings")})
    ups, downs = C("higher_highs") + C("higher_lows"), C("lower_highs") + C("lower_lows")
    t = t.withColumn("_score", safe_divide(ups - downs, (ups + downs).cast("double")))
    cut = cfg.sideways_threshold
    t = t.withColumn(
        "direction", F.when(C("_score") > cut, 1).when(C("_score") < -cut, -1).otherwise(0)
    )
    anchor = (
        F.when(C("direction") == 0, C("last_swing"))
        .when(
            C("direction") == 1,
            F.when(C("_n_high") >= 2, F.coalesce("_bull_turn", "_first_high")).otherwise(
                C("first_swing")
            ),
        )
        .otherwise(
            F.when(C("_n_low") >= 2, F.coalesce("_bear_turn", "_first_low")).otherwise(
                C("first_swing")
            )
        )
    )
    duration = F.greatest(C("n_bars") - 1 - anchor, F.lit(0))
    momentum = F.when(C("_n_recent") >= 2, safe_divide(C("_slope"), C("last_close")))
    return t.select(
        *keys,
        "direction",
        *moves,
        F.abs("_score").alias("strength"),
        F.coalesce(F.when(C("n_swings") > 0, duration), F.lit(0)).cast("long").alias("duration_bars"),
        F.coalesce(momentum, F.lit(0.0)).alias("momentum"),
        "n_swings",
    )


# --------------------------------------------------------------------------- breaks


def breaks_from(rows: DataFrame, layout: Layout = DEFAULT_LAYOUT) -> DataFrame:
    """First close beyond each active swing level.

    The active level of a bar is an as-of lookup carried by ``swing_bars``; the first break of a
    level is then a min-by that combines before its shuffle.
    """
    keys = list(layout.keys)
    hit = lambda o, d, lv, cond, gap: F.when(
        cond,
        F.struct(
            F.lit(o).alias("side_order"),
            F.lit(d).alias("direction"),
            C(lv)["idx"].alias("swing_index"),
            C(lv)["price"].alias("price"),
            safe_divide(gap, C("atr_eff")).alias("strength"),
        ),
    )
    high, low, c = C("level_high")["price"], C("level_low")["price"], C("close")
    hits = F.array_compact(
        F.array(
            hit(0, "bullish", "level_high", c > high, c - high),
            hit(1, "bearish", "level_low", c < low, low - c),
        )
    )
    long = rows.select(*keys, "bar_idx", "ts", "close", F.explode(hits).alias("e"))
    long = long.select(*keys, "bar_idx", "ts", "close", "e.*")
    first = long.groupBy(*keys, "direction", "side_order", "swing_index").agg(
        F.min_by(F.struct("bar_idx", "ts", "price", "close", "strength"), "bar_idx").alias("b")
    )
    ev = first.select(*keys, "direction", "side_order", "swing_index", "b.*")
    bucket = None if layout.bounded else "_eb"
    ev = ev if layout.bounded else ev.withColumn("_eb", event_bucket())
    ev = S.scan(
        ev,
        keys,
        ["bar_idx", "side_order"],
        [S.Scan("prev_direction", "prev", C("direction"))],
        bucket,
    )
    return ev.drop("_eb")


def breaks(
    bars: DataFrame, cfg: AnalysisConfig = DEFAULT, layout: Layout = DEFAULT_LAYOUT
) -> DataFrame:
    return breaks_from(swing_bars(bars, cfg, layout), layout)


def changes_of_character(break_events: DataFrame) -> DataFrame:
    """Breaks against the direction of the break before."""
    return break_events.where(C("prev_direction") != C("direction"))


def structure_summary(
    break_events: DataFrame, stats: DataFrame, layout: Layout = DEFAULT_LAYOUT
) -> DataFrame:
    """Counts and the last break and change of character per series."""
    keys = list(layout.keys)
    flip = C("prev_direction") != C("direction")
    order = F.struct("bar_idx", "side_order")
    facts = F.struct("direction", "strength", "bar_idx")
    agg = break_events.groupBy(*keys).agg(
        F.count_if(C("direction") == "bullish").alias("_bull"),
        F.count_if(C("direction") == "bearish").alias("_bear"),
        F.max_by(facts, order).alias("_b"),
        F.count_if(flip).alias("_flips"),
        F.max_by(facts, F.when(flip, order)).alias("_f"),
    )
    t = stats.select(*keys, "n_bars").join(agg, keys, "left")
    sign = lambda e: F.when(C(e)["direction"] == "bullish", 1.0).when(
        C(e).isNotNull(), -1.0
    )
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    since = lambda e: F.coalesce(
        (C("n_bars") - 1 - C(e)["bar_idx"]).cast("double"), F.lit(-1.0)
    )
    return t.select(
        *keys,
        zero(sign("_b")).alias("last_bos_direction"),
        zero(C("_b")["strength"]).alias("last_bos_strength"),
        since("_b").alias("bars_since_bos"),
        zero(C("_bull").cast("double")).alias("bullish_bos_count"),
        zero(C("_bear").cast("double")).alias("bearish_bos_count"),
        zero(sign("_f")).alias("last_choch_direction"),
        zero(C("_f")["strength"]).alias("last_choch_strength"),
        since("_f").alias("bars_since_choch"),
        zero(C("_flips").cast("double")).alias("choch_count"),
    )


# --------------------------------------------------------------------------- microstructure

MICRO = (
    "impulse_length", "correction_length", "impulse_ratio", "retracement_pct", "extension_pct",
    "swing_velocity", "swing_acceleration", "time_between_swings", "average_swing_length",
)


def microstructure(
    swing_events: DataFrame, trend_state: DataFrame, layout: Layout = DEFAULT_LAYOUT
) -> DataFrame:
    """Leg statistics over the combined swing stream of each series."""
    keys = list(layout.keys)
    bucket = None if layout.bounded else "_eb"
    ev = swing_events if layout.bounded else swing_events.withColumn("_eb", event_bucket())
    ev = S.scan(
        ev,
        keys,
        ["bar_idx", "side_order"],
        [S.Scan("_pp", "prev", C("price")), S.Scan("_pi", "prev", C("bar_idx"))],
        bucket,
    )
    legs = (
        ev.where(C("_pp").isNotNull())
        .withColumns({"leg": C("price") - C("_pp"), "bars": C("bar_idx") - C("_pi")})
        .join(trend_state.select(*keys, "direction"), keys)
    )
    size = F.abs("leg")
    legs = legs.withColumns(
        {
            "_len": size,
            "impulse": F.when(C("direction") >= 0, C("leg") > 0).otherwise(C("leg") < 0),
        }
    )
    overall = legs.groupBy(*keys).agg(
        F.avg("_len").alias("average_swing_length"), F.count("*").alias("n_legs")
    )
    order = ["bar_idx", "side_order"]
    same = _latest(legs, [*keys, "impulse"], order, 3)
    kinds = same.groupBy(*keys).agg(
        F.avg(F.when(C("impulse"), C("_len"))).alias("_imp"),
        F.avg(F.when(~C("impulse"), C("_len"))).alias("_cor"),
    )
    speed = safe_divide(C("_len"), C("bars").cast("double"))
    last = _latest(legs, keys, order, 3)
    nth = lambda x, i: F.max(F.when(C("rn") == i, x))
    recent = last.groupBy(*keys).agg(
        nth(C("_len"), 1).alias("_l1"),
        nth(C("_len"), 2).alias("_l2"),
        nth(speed, 1).alias("_v1"),
        nth(speed, 2).alias("_v2"),
        F.avg("bars").alias("time_between_swings"),
    )
    t = trend_state.select(*keys).join(overall, keys, "left").join(kinds, keys, "left")
    t = t.join(recent, keys, "left")
    imp, cor = F.coalesce("_imp", F.lit(0.0)), F.coalesce("_cor", F.lit(0.0))
    ret = safe_divide(C("_l1"), C("_l2")) * 100.0
    values = {
        "impulse_length": imp,
        "correction_length": cor,
        "impulse_ratio": safe_divide(imp, cor),
        "retracement_pct": F.least(ret, F.lit(100.0)),
        "extension_pct": F.greatest(ret - 100.0, F.lit(0.0)),
        "swing_velocity": C("_v1"),
        "swing_acceleration": C("_v1") - C("_v2"),
        "time_between_swings": C("time_between_swings"),
        "average_swing_length": C("average_swing_length"),
    }
    enough = C("n_legs") >= 2
    return t.select(
        *keys, *[F.coalesce(F.when(enough, v), F.lit(0.0)).alias(k) for k, v in values.items()]
    )
