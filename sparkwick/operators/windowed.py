"""Feature vectors of trailing windows, without a copy of any bar.

A window is a short series of its own: recurrences start at its first bar, and swings, breaks, gaps
and blocks are those a reader of the window alone would find. None of that needs the window's bars:

* A linear recurrence seeded at the window's first bar differs from the one that runs through the
  whole series by a term that decays from there, so each is corrected by one value looked up at
  the first bar. The directional index is not linear and is folded over its frame.
* Events (swings, first breaks, gaps, blocks) are found once per series, with what they need to be
  judged under any window's own ATR. A bounded join brings each decision bar those in its window;
  bars are numbered in blocks of one window length, so a window meets two blocks at most.
* The joined events are short series keyed by decision, and the summaries of the snapshot apply.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwick.config import DEFAULT, DEFAULT_LAYOUT, AnalysisConfig, Layout
from sparkwick.functions.columns import flag, or_default, safe_divide
from sparkwick.operators import features, imbalance, levels, structure
from sparkwick.operators import scan as S
from sparkwick.sources.staging import stage

C = F.col
#: Finite frames of the bar features reach back less far than this; shorter windows are copied.
LEAST_WINDOW = 64
#: Below this part of the correction a corrected value is rounding noise of an exact zero.
NOISE = 1e-12


def ahead_of_blocks(df: DataFrame, cfg: AnalysisConfig, w) -> DataFrame:
    """Add what judges a bar as an order block: the bars after it and the least ATR (needs _tr)."""
    ahead = lambda c: F.array(*(F.lead(c, i).over(w) for i in range(1, cfg.ob_horizon + 2)))
    p = cfg.atr_period
    weights = [1.0 / p * (1.0 - 1.0 / p) ** i for i in range(p - 1)]
    df = df.withColumns(
        {
            "_trs": F.collect_list("_tr").over(w.rowsBetween(-(p - 2), 0)),
            "highs": ahead("high"),
            "lows": ahead("low"),
            "next_open": F.lead("open").over(w),
            "next_close": F.lead("close").over(w),
        }
    )
    # no window's ATR at this bar can be lower than what its last bars alone give
    newest = F.zip_with(F.reverse("_trs"), F.lit(weights), lambda x, y: F.coalesce(x, F.lit(0.0)) * y)
    least = F.aggregate(newest, F.lit(0.0), lambda a, x: a + x)
    return df.withColumn("atr_least", least).drop("_trs")


def _annotated(
    bars: DataFrame, window: int, stride: int, cfg: AnalysisConfig, layout: Layout
) -> DataFrame:
    """Core bars with swing flags, look-ahead values, and everything seeded at the window start.

    One exchange serves all frames, recurrences and lookups of the pass.
    """
    m, w = cfg, S.bar_window(layout)
    full, inner = w.rowsBetween(-(window - 1), 0), w.rowsBetween(-(window - 2), 0)
    lag = lambda c, n=1: F.lag(c, n).over(w)
    df = structure._pivot_flags(S.extend(bars, layout), cfg, layout)
    prev = {c: F.coalesce(lag(c), C(c)) for c in ("close", "high", "low")}
    rise, fall = C("high") - prev["high"], prev["low"] - C("low")
    off = lambda side: F.coalesce(lag(f"_cand_{side}"), F.lit(False))

    def muted(side: str) -> Column:
        """Why a candidate is no swing: 1 the bar before, 2 the one before that; 0 otherwise."""
        return F.when(~C(f"_cand_{side}") | C(f"is_{side}"), 0).when(off(side), 1).otherwise(2)

    df = df.withColumns(
        {
            "_tr": F.greatest(
                C("high") - C("low"), F.abs(C("high") - prev["close"]), F.abs(C("low") - prev["close"])
            ),
            "_delta": C("close") - prev["close"],
            "_up": F.when((rise > fall) & (rise > 0), rise).otherwise(0.0),
            "_down": F.when((fall > rise) & (fall > 0), fall).otherwise(0.0),
            "_tp": (C("high") + C("low") + C("close")) / 3.0,
            "muted_high": muted("high"),
            "muted_low": muted("low"),
            "_h2": lag("high", 2),
            "_l2": lag("low", 2),
            "_hl": C("high") - C("low"),
        }
    )
    decides = (C("bar_idx") >= window - 1) & ((C("bar_idx") - (window - 1)) % stride == 0)
    keep = 1.0 - 1.0 / m.adx_period

    def dx_step(a, x):
        up = a["up"] * keep + x["_up"] / m.adx_period
        down = a["down"] * keep + x["_down"] / m.adx_period
        dx = F.when((a["i"] >= m.adx_period - 2) & (up + down > 0), F.abs(up - down) / (up + down) * 100.0)
        adx = a["adx"] * keep + F.coalesce(dx, F.lit(0.0)) / m.adx_period
        return F.struct(
            (a["i"] + 1).alias("i"), up.alias("up"), down.alias("down"), adx.alias("adx")
        )

    zero = F.struct(
        F.lit(0).alias("i"), F.lit(0.0).alias("up"), F.lit(0.0).alias("down"), F.lit(0.0).alias("adx")
    )
    adx = F.aggregate("_moves", zero, dx_step, lambda a: a["adx"])
    df = ahead_of_blocks(df, cfg, w)
    df = df.withColumns(
        {
            "_moves": F.collect_list(F.struct("_up", "_down")).over(inner),
            "_median": F.percentile("_hl", 0.5).over(full),
            "_top": F.max("high").over(full),
            "_bottom": F.min("low").over(full),
            "_fell": F.max(-C("_delta")).over(inner) > 0,
            "_volume": F.sum("volume").over(full),
            "_traded": F.sum(C("_tp") * C("volume")).over(full),
        }
    )
    df = df.withColumn("adx_w", F.when(decides, adx)).drop("_moves")
    level = lambda side: F.when(
        C(f"is_{side}"), F.struct(C("bar_idx").alias("idx"), C(side).alias("price"))
    )
    smooth = {"tr_s": S.wilder("tr_s", C("_tr"), m.atr_period)}
    smooth["gain_s"] = S.wilder("gain_s", F.greatest("_delta", F.lit(0.0)), m.rsi_period)
    smooth["loss_s"] = S.wilder("loss_s", F.greatest(-C("_delta"), F.lit(0.0)), m.rsi_period)
    for name, p in {"fast": m.macd_fast, "slow": m.macd_slow, **{f"ema_{p}": p for p in m.ema_periods}}.items():
        smooth[name] = S.ema(name, C("close"), p)
    k = cfg.swing_window
    df = S.recur(
        df, layout, list(smooth.values()),
        [S.Fill("level_high", level("high"), k), S.Fill("level_low", level("low"), k)],
    )
    df = df.withColumn("_macd", C("fast") - C("slow"))
    df = S.recur(df, layout, [S.ema("signal", C("_macd"), m.macd_signal)])

    # values at the window's first bar, and what they leave of their difference after n bars
    n = window - 1
    at = F.lag(F.struct("close", "_hl", "signal", *smooth), n).over(w)
    recent = w.rowsBetween(-(m.hist_vol_window - 1), 0)
    df = df.withColumns(
        {"_s": at, "next_tr": F.lead("tr_s").over(w), "_tr_mean": F.avg("tr_s").over(recent)}
    )

    def left(name: str, seed: Column) -> Column:
        return (seed - C("_s")[name]) * smooth[name].decay**n

    fast, slow, g = smooth["fast"].decay, smooth["slow"].decay, 1.0 - 2.0 / (m.macd_signal + 1.0)
    carried = lambda d: (1 - g) * sum(g ** (n - j) * d**j for j in range(1, n + 1))
    seed = C("_s")["close"]
    d_atr = smooth["tr_s"].decay
    c = C("_s")["_hl"] - C("_s")["tr_s"]
    mean_left = sum(d_atr ** (n - j) for j in range(m.hist_vol_window)) / m.hist_vol_window
    moves = C("_top") > C("_bottom")
    gain, loss = C("gain_s") + left("gain_s", F.lit(0.0)), C("loss_s") + left("loss_s", F.lit(0.0))
    macd = C("_macd") + left("fast", seed) - left("slow", seed)
    signal = (
        C("signal") - C("_s")["signal"] * g**n
        + (seed - C("_s")["fast"]) * carried(fast) - (seed - C("_s")["slow"]) * carried(slow)
    )
    df = df.withColumns(
        {
            "drift": c,
            "atr_w": F.when(moves, F.greatest(C("tr_s") + c * d_atr**n, F.lit(0.0))).otherwise(0.0),
            "atr_mean_w": F.when(moves, C("_tr_mean") + c * mean_left).otherwise(0.0),
            "median_w": F.when(C("_median") == 0.0, 1.0).otherwise(C("_median")),
            "rsi_w": F.when(~C("_fell"), 100.0).otherwise(100.0 - 100.0 / (1.0 + gain / loss)),
            "macd_w": macd,
            "signal_w": signal,
            "vwap_w": F.when(C("_volume") > 0, C("_traded") / C("_volume")).otherwise(C("_tp")),
            **{f"ema_{p}_w": C(f"ema_{p}") + left(f"ema_{p}", seed) for p in m.ema_periods},
        }
    )
    kept = [
        *layout.keys, "bar_idx", "ts", "open", "high", "low", "close", "is_high", "is_low",
        "muted_high", "muted_low", "_prom_high", "_prom_low", "level_high", "level_low", "_h2",
        "_l2", "highs", "lows", "next_open", "next_close", "next_tr", "tr_s", "atr_least", "drift",
        "atr_w", "atr_mean_w", "median_w", "rsi_w", "macd_w", "signal_w", "vwap_w", "adx_w",
        *(f"ema_{p}_w" for p in m.ema_periods),
    ]
    return S.core_rows(df).select(*kept)


def _own_atr(offset: Column, smoothed: Column, cfg: AnalysisConfig) -> Column:
    """The effective ATR a window gives its bar at ``offset``; needs drift and median_w."""
    decay = 1.0 - 1.0 / cfg.atr_period
    v = smoothed + C("drift") * F.pow(F.lit(decay), offset)
    known = (offset >= cfg.atr_period - 1) & (v > F.abs("drift") * NOISE) & (v > 0)
    return F.when(known, v).otherwise(C("median_w"))


def _in_windows(
    events: DataFrame, decisions: DataFrame, window: int, keys: list[str]
) -> DataFrame:
    """Every decision with the events of its window; ``off`` counts from the window's first bar."""
    start = C("decision_idx") - (window - 1)
    blocks = F.array_distinct(F.array(F.floor(start / window), F.floor(C("decision_idx") / window)))
    d = decisions.withColumn("_block", F.explode(blocks))
    e = events.withColumn("_block", F.floor(C("bar_idx") / window))
    off = C("bar_idx") - start
    return (
        d.join(e, [*keys, "_block"])
        .withColumn("off", off)
        .where((C("off") >= 0) & (C("bar_idx") <= C("decision_idx")))
        .drop("_block")
    )


def _swings(rows, decisions, window, cfg, keys) -> DataFrame:
    side = lambda o, s: F.when(
        C(f"is_{s}") | (C(f"muted_{s}") > 0),
        F.struct(
            F.lit(s).alias("kind"), F.lit(o).alias("side_order"), C(s).alias("price"),
            F.greatest(C(f"_prom_{s}"), F.lit(0.0)).alias("prom"), C(f"muted_{s}").alias("muted"),
        ),
    )
    ev = rows.select(
        *keys, "bar_idx", "tr_s", F.explode(F.array_compact(F.array(side(0, "high"), side(1, "low")))).alias("e")
    ).select(*keys, "bar_idx", "tr_s", "e.*")
    return _in_windows(ev, decisions, window, keys)


def _counts_as_swing(offset: Column, muted: Column, k: int) -> Column:
    """A muted candidate is a swing where the window has no room for the one that mutes it."""
    return (offset >= k) & ((muted == 0) | (offset == k) | ((offset == k + 1) & (muted == 2)))


def _breaks(rows, bars, decisions, window, cfg, layout) -> DataFrame:
    """First close beyond each level of each window, with the direction of the break before."""
    keys, k = list(layout.keys), cfg.swing_window
    hit = lambda o, d, lv, beyond: F.when(
        beyond > 0,
        F.struct(F.lit(o).alias("side_order"), F.lit(d).alias("direction"),
                 C(lv)["idx"].alias("swing_index"), beyond.alias("gap")),
    )
    over = C("close") - C("level_high")["price"]
    under = C("level_low")["price"] - C("close")
    hits = F.array_compact(
        F.array(hit(0, "bullish", "level_high", over), hit(1, "bearish", "level_low", under))
    )
    facts = F.struct("bar_idx", "gap", "tr_s")
    first = rows.select(*keys, "bar_idx", "tr_s", F.explode(hits).alias("e")).select(
        *keys, "bar_idx", "tr_s", "e.*"
    )
    first = first.groupBy(*keys, "direction", "side_order", "swing_index").agg(
        F.min_by(facts, "bar_idx").alias("b")
    )
    first = first.select(*keys, "direction", "side_order", "swing_index", "b.*", F.lit(0).alias("muted"))
    # muted candidates can be levels of the few windows that begin right before them; they hold
    # until the next swing of their kind is known
    side = lambda o, d, s: F.when(
        C(f"muted_{s}") > 0,
        F.struct(F.lit(o).alias("side_order"), F.lit(d).alias("direction"), C(s).alias("price"),
                 C(f"muted_{s}").alias("muted")),
    )
    quiet = rows.select(
        *keys, C("bar_idx").alias("swing_index"),
        F.explode(F.array_compact(F.array(side(0, "bullish", "high"), side(1, "bearish", "low")))).alias("q"),
    ).select(*keys, "swing_index", "q.*")
    quiet = quiet.withColumn(
        "_block",
        F.explode(F.sequence(F.floor(C("swing_index") / window), F.floor(C("swing_index") / window) + 1)),
    )
    seen = rows.select(
        *keys, "bar_idx", "tr_s", "close", C("level_high")["idx"].alias("_lh"), C("level_low")["idx"].alias("_ll"),
        F.floor(C("bar_idx") / window).alias("_block"),
    )
    up = C("direction") == "bullish"
    level = F.when(up, C("_lh")).otherwise(C("_ll"))
    gap = F.when(up, C("close") - C("price")).otherwise(C("price") - C("close"))
    later = quiet.join(seen, [*keys, "_block"]).where(
        (C("bar_idx") >= C("swing_index") + k)
        & (F.coalesce(level, F.lit(-1)) <= C("swing_index")) & (gap > 0)
    ).withColumn("gap", gap)
    later = later.groupBy(*keys, "direction", "side_order", "swing_index", "muted").agg(
        F.min_by(facts, "bar_idx").alias("b")
    )
    later = later.select(*keys, "direction", "side_order", "swing_index", "b.*", "muted")
    ev = _in_windows(first.unionByName(later), decisions, window, keys)
    at = C("swing_index") - (C("decision_idx") - (window - 1))
    ev = ev.where(_counts_as_swing(at, C("muted"), k))
    short = layout.per("decision_idx")
    ev = ev.select(
        *short.keys, "direction", "side_order", C("off").alias("bar_idx"),
        safe_divide(C("gap"), _own_atr(C("off"), C("tr_s"), cfg)).alias("strength"),
    )
    return S.scan(
        ev, short.keys, ["bar_idx", "side_order"], [S.Scan("prev_direction", "prev", C("direction"))]
    )


def _gaps(rows, bars, decisions, window, cfg, layout) -> DataFrame:
    keys = list(layout.keys)
    side = lambda d, p, upper, lower, price: F.struct(
        F.lit(d).alias("direction"), F.lit(p).alias("side"), upper.alias("upper"),
        lower.alias("lower"), price.alias("price"),
    )
    up, down = C("low") > C("_h2"), C("high") < C("_l2")
    g = rows.withColumn(
        "_g",
        F.when(up, side("bullish", "sell_side", C("low"), C("_h2"), C("_h2"))).when(
            down, side("bearish", "buy_side", C("_l2"), C("high"), C("_l2"))
        ),
    ).where(C("_g").isNotNull())
    g = g.select(*keys, "bar_idx", C("bar_idx").alias("last_index"), C("bar_idx").alias("pid"), "tr_s", "_g.*")
    g = levels.first_beyond(bars, stage(g), layout, touching=True)
    ev = _in_windows(
        g.select(*keys, "bar_idx", "tr_s", "direction", "upper", "lower", "hit_idx"), decisions, window, keys
    )
    own = _own_atr(C("off"), C("tr_s"), cfg)
    size = C("upper") - C("lower")
    edge = F.least(F.abs(C("last_close") - C("upper")), F.abs(C("last_close") - C("lower")))
    return ev.where((C("off") >= 2) & (size >= own * cfg.fvg_min_atr)).select(
        *keys, "decision_idx", C("off").alias("bar_idx"), "direction",
        safe_divide(size, own).alias("size_atr"), (F.lit(window - 1) - C("off")).alias("age"),
        F.coalesce(C("hit_idx") <= C("decision_idx"), F.lit(False)).alias("filled"), edge.alias("edge_distance"),
    )


def blocks(rows, decisions, window, cfg, layout, whole: bool = False) -> DataFrame:
    """Order blocks of each window with retests and mitigation up to its last bar.

    With ``whole`` the series itself gives the ATR and the window only bounds the age of a block.
    """
    keys, h, need = list(layout.keys), cfg.ob_horizon, cfg.ob_displacement_atr
    down, up = C("close") < C("open"), C("close") > C("open")
    reach = F.when(down, F.array_max(F.slice("highs", 1, h)) - C("high")).otherwise(
        C("low") - F.array_min(F.slice("lows", 1, h))
    )
    cand = rows.where((down | up) & (reach > 0)).select(
        *keys, "bar_idx", "tr_s", F.when(down, "bullish").otherwise("bearish").alias("direction"),
        "high", "low", "highs", "lows", "next_open", "next_close", "next_tr",
        (reach >= C("atr_least") * need).alias("wide"),
    )
    cand = stage(cand)
    # what happens to a block after it stands, up to the end of the last window that holds it
    after = cand.select(*keys, "bar_idx", "direction", "high", "low").withColumn(
        "_block",
        F.explode(F.sequence(F.floor((C("bar_idx") + h + 1) / window), F.floor((C("bar_idx") + window - 1) / window))),
    )
    bar = rows.select(
        *keys, C("bar_idx").alias("_i"), C("high").alias("_h"), C("low").alias("_l"), F.floor(C("bar_idx") / window).alias("_block")
    )
    bull = C("direction") == "bullish"
    enters = F.when(bull, (C("_l") <= C("high")) & (C("_l") > C("low"))).otherwise(
        (C("_h") >= C("low")) & (C("_h") < C("high"))
    )
    ends = F.when(bull, C("_l") <= C("low")).otherwise(C("_h") >= C("high"))
    met = (
        after.join(bar, [*keys, "_block"])
        .where((C("_i") > C("bar_idx") + h) & (C("_i") < C("bar_idx") + window) & (enters | ends))
        .groupBy(*keys, "bar_idx")
        .agg(
            F.collect_list(F.when(enters, C("_i"))).alias("retests"),
            F.min(F.when(ends, C("_i"))).alias("mitigated_at"),
        )
    )
    ev = stage(cand.join(met, [*keys, "bar_idx"], "left"))
    # a move below the least ATR only counts where a window has no ATR yet: in its first bars
    warm = cfg.atr_period - 1
    start = C("decision_idx") - (window - 1)

    def own_atr(offset: Column, smoothed: Column) -> Column:
        if not whole:
            return _own_atr(offset, smoothed, cfg)
        return F.when((start + offset >= warm) & (smoothed > 0), smoothed).otherwise(C("median_w"))

    early = ev.where(~C("wide")).withColumn("off", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(warm - 1).cast("long"))))
    early = early.withColumn("decision_idx", C("bar_idx") - C("off") + (window - 1))
    early = early.join(decisions, [*keys, "decision_idx"])
    if whole:
        ev = _in_windows(ev.where(C("wide") | (C("bar_idx") < warm)), decisions, window, keys)
    else:
        ev = _in_windows(ev.where("wide"), decisions, window, keys).unionByName(early)

    left = (F.lit(window - 1) - C("off")).cast("int")
    own, nxt = own_atr(C("off"), C("tr_s")), own_atr(C("off") + 1, C("next_tr"))

    def move(at: int) -> Column:
        """Reach of the bar (0) or the one after it (1) inside the window."""
        n = F.greatest(F.least(left - at, F.lit(h)), F.lit(1))
        here_h = C("high") if at == 0 else F.get("highs", F.lit(0))
        here_l = C("low") if at == 0 else F.get("lows", F.lit(0))
        far = F.when(bull, F.array_max(F.slice("highs", 1 + at, n)) - here_h).otherwise(
            here_l - F.array_min(F.slice("lows", 1 + at, n))
        )
        return F.when(left > at, far)

    same_turn = F.when(bull, C("next_close") < C("next_open")).otherwise(C("next_close") > C("next_open"))
    again = F.coalesce(same_turn & (move(1) >= nxt * need), F.lit(False))
    ev = ev.where((move(0) >= own * need) & ~again & (left <= cfg.ob_max_age))
    retested = F.size(F.filter(F.coalesce("retests", F.array().cast("array<long>")), lambda i: i <= C("decision_idx")))
    away = F.when(bull, C("last_close") - C("high")).otherwise(C("low") - C("last_close"))
    return ev.select(
        *keys, "decision_idx", C("off").alias("bar_idx"), "direction",
        safe_divide(move(0), own).alias("strength"), left.cast("long").alias("age"),
        (1.0 / (1.0 + retested)).alias("freshness"),
        F.coalesce(C("mitigated_at") <= C("decision_idx"), F.lit(False)).alias("mitigated"),
        safe_divide(away, C("atr_last"), None).alias("distance"),
    )


def swept_pools(pl, bars, start: Column, cfg, layout) -> DataFrame:
    """Pools per decision with their first piercing bar up to it; bars count from ``start``."""
    keys = list(layout.keys)
    probes = pl.withColumns(
        {"pid": F.struct("decision_idx", "cluster"), "last_index": C("last_index") + start}
    )
    t = levels.first_beyond(bars, stage(probes), layout).drop("pid")
    t = t.withColumn("hit_idx", F.when(C("hit_idx") <= C("decision_idx"), C("hit_idx")))
    at = bars.select(*keys, C("bar_idx").alias("hit_idx"), "ts", "high", "low", "close")
    t = t.join(at, [*keys, "hit_idx"], "left")
    return levels.graded(t, pl.columns, cfg).withColumn("hit_idx", C("hit_idx") - start)


def window_features(
    bars: DataFrame,
    window: int = 500,
    horizon: int = 1,
    stride: int = 1,
    feature_set: str = "v156",
    cfg: AnalysisConfig = DEFAULT,
    layout: Layout = DEFAULT_LAYOUT,
) -> DataFrame:
    """The feature vector of each decision bar from its own trailing window.

    Decision bars are ``window - 1, window - 1 + stride, ...`` as long as a bar lies ``horizon``
    ahead. Equal to a snapshot of every window alone; the bars are read once, and what is joined
    per decision are the events of its window.
    """
    if window < LEAST_WINDOW:
        return features.copied_window_features(bars, window, horizon, stride, feature_set, cfg, layout)
    if horizon < 1 or stride < 1:
        raise ValueError("horizon >= 1 and stride >= 1 are required")
    keys = list(layout.keys)
    wide = layout if layout.bounded else replace(
        layout, chunk=max(layout.chunk, 2 * window), back=max(layout.back, window + 2 * S.WARM)
    )
    rows = stage(_annotated(bars, window, stride, cfg, wide))
    per_bar = features.bar_features(bars, cfg, layout)
    due = (C("bar_idx") >= window - 1) & ((C("bar_idx") - (window - 1)) % stride == 0)
    own = ["drift", "atr_w", "atr_mean_w", "median_w", "rsi_w", "macd_w", "signal_w", "vwap_w", "adx_w",
           *(f"ema_{p}_w" for p in cfg.ema_periods)]
    last = per_bar.where(due & (C("bar_idx") + horizon < C("n_bars"))).join(
        rows.select(*keys, "bar_idx", *own), [*keys, "bar_idx"]
    )
    last = stage(last.withColumn("decision_idx", C("bar_idx")))
    decisions = stage(
        last.select(
            *keys, "decision_idx", "drift", "median_w", C("close").alias("last_close"), C("atr_w").alias("atr_now"),
            F.when(C("atr_w") > 0, C("atr_w")).otherwise(C("median_w")).alias("atr_last"),
            F.lit(window).cast("long").alias("n_bars"),
        )
    )
    short = layout.per("decision_idx")
    now = decisions.drop("drift", "median_w")
    sw = _swings(rows, decisions, window, cfg, keys)
    inside = C("off") <= window - 1 - cfg.swing_window
    sw = sw.where(inside & _counts_as_swing(C("off"), C("muted"), cfg.swing_window)).select(
        *short.keys, C("off").alias("bar_idx"), "kind", "side_order", "price",
        safe_divide(C("prom"), _own_atr(C("off"), C("tr_s"), cfg)).alias("strength"),
    )
    before = [S.Scan("prev_price", "prev", C("price"))]
    sw = stage(S.scan(sw, [*short.keys, "kind"], ["bar_idx"], before))
    tr = stage(structure.trend(sw, now, cfg, short))
    tables = {
        "trend": tr,
        "structure": structure.structure_summary(_breaks(rows, bars, decisions, window, cfg, layout), now, short),
        "micro": structure.microstructure(sw, tr, short),
        "sr": levels.nearest_zones(levels.zones(sw, now, cfg, short), now, short),
        "liq": levels.liquidity_summary(
            swept_pools(levels.pools(sw, now, cfg, short), bars, C("decision_idx") - (window - 1), cfg, layout),
            now, short,
        ),
        "fvg": imbalance.gap_summary(_gaps(rows, bars, decisions, window, cfg, layout), now, short),
        "ob": imbalance.block_summary(blocks(rows, decisions, window, cfg, layout), now, short),
    }
    unit = F.greatest("atr_w", F.lit(1e-12))
    away = lambda c: or_default((C("close") - C(c)) / unit)
    ratio = F.when(C("atr_mean_w") != 0, C("atr_w") / C("atr_mean_w")).otherwise(1.0)
    seeded = {
        "n_candles": F.lit(float(window)),
        "pa_atr_ratio": or_default((C("high") - C("low")) / unit),
        **{f"pa_distance_from_ema{p}": away(f"ema_{p}_w") for p in (20, 50, 200)},
        "pa_distance_from_vwap": away("vwap_w"),
        "vol_atr": C("atr_w"),
        "vol_expansion": flag(ratio >= cfg.expansion_ratio),
        "vol_compression": flag(ratio <= cfg.compression_ratio),
        "spread_atr_ratio": F.coalesce(
            F.when(C("spread").isNotNull(), safe_divide(C("spread"), C("atr_w"))), F.lit(0.0)
        ),
        "ind_atr": C("atr_w"),
        "ind_adx": or_default(C("adx_w")),
        "ind_rsi": C("rsi_w"),
        "ind_macd": C("macd_w"),
        "ind_macd_signal": C("signal_w"),
        "ind_macd_histogram": C("macd_w") - C("signal_w"),
        "ind_vwap": C("vwap_w"),
        **{f"ind_ema_{p}": C(f"ema_{p}_w") for p in cfg.ema_periods},
        **{f"ind_{k}_valid": flag(F.lit(window >= need)) for k, need in features.WARMUP.items()},
        "vol_valid": flag(F.lit(window >= cfg.hist_vol_window)),
    }
    last = last.withColumns(seeded)
    out = features.assembled(last, tables, feature_set, short)
    return out.withColumns(
        {
            "window_end_idx": C("decision_idx"),
            "window_start_idx": C("decision_idx") - (window - 1),
            "label_idx": C("decision_idx") + horizon,
        }
    )
