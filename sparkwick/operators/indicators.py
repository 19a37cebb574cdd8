"""The indicator series: finite windows and recurrences over candles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwick.config import DEFAULT, DEFAULT_LAYOUT, AnalysisConfig, Layout
from sparkwick.functions.columns import flag, safe_divide, true_range
from sparkwick.operators import scan as S

C = F.col

# The emitted series, in alphabetical order of the flattened feature names.
INDICATORS = (
    "adx", "atr", "bb_lower", "bb_middle", "bb_upper", "cci", "ema_100", "ema_20", "ema_200",
    "ema_50", "macd", "macd_histogram", "macd_signal", "momentum", "relative_volume", "roc",
    "rolling_mean", "rolling_median", "rolling_variance", "rsi", "sma", "std_dev", "stoch_d",
    "stoch_k", "tick_volume", "true_range", "volatility", "volume_delta", "volume_ma",
    "volume_ratio", "volume_spike", "volume_trend", "vwap", "williams_r",
)


def needs(cfg: AnalysisConfig) -> dict[str, set[str]]:
    """Which helper recurrences each indicator reads."""
    out = {"atr": {"tr_s"}, "rsi": {"gain_s", "loss_s"}, "vwap": {"cum_v", "cum_pv"}}
    out |= {f"ema_{p}": {f"ema_{p}"} for p in cfg.ema_periods}
    out["macd"] = {"ema_fast", "ema_slow"}
    out["macd_signal"] = out["macd_histogram"] = out["macd"] | {"signal"}
    out["adx"] = {"trx_s", "up_s", "down_s", "dx_s"}
    return out


class _Columns:
    """Named column definitions, planned only when used and layered by what they read."""

    def __init__(self, given):
        self.level = {c: 0 for c in given}
        self.exprs: dict[str, Column] = {}
        self.defs: dict = {}
        self._reads: list[int] = [0]

    def use(self, name: str) -> Column:
        if name not in self.level:
            self._reads.append(0)
            self.exprs[name] = self.defs[name]()
            self.level[name] = self._reads.pop() + 1
        self._reads[-1] = max(self._reads[-1], self.level[name])
        return C(name)

    def named(self, name: str, make) -> Column:
        """A shared helper column, such as one rolling aggregate read by several indicators."""
        self.defs.setdefault(name, make)
        return self.use(name)

    def apply(self, df: DataFrame, done: set[str]) -> DataFrame:
        todo = [n for n in self.exprs if n not in done]
        for lv in sorted({self.level[n] for n in todo}):
            df = df.withColumns({n: self.exprs[n] for n in todo if self.level[n] == lv})
        done.update(todo)
        return df


def _definitions(k: _Columns, m: AnalysisConfig, w) -> None:
    """Definitions of everything that is not a recurrence."""
    idx, c, v = C("bar_idx"), C("close"), C("volume")
    use = k.use

    def roll(fn: str, col: str, n: int) -> Column:
        frame = w.rowsBetween(-(n - 1), 0)
        use(col)
        return k.named(f"_{fn}{n}_{col}", lambda: getattr(F, fn)(use(col)).over(frame))

    def lag(col: str, n: int = 1) -> Column:
        return k.named(f"_lag{n}_{col}", lambda: F.lag(use(col), n).over(w))

    def position(low: Column, high: Column, at: Column, flat: float) -> Column:
        return safe_divide(at, high - low, flat)

    def middle() -> Column:
        """Median of the recent closes, from a sorted array of at most one window."""
        near = F.collect_list("close").over(w.rowsBetween(-(m.rolling_window - 1), 0))
        box = k.named("_sorted", lambda: F.array_sort(near))
        size = F.size(box)
        lo = F.element_at(box, F.floor((size + 1) / 2).cast("int"))
        hi = F.element_at(box, (F.floor(size / 2) + 1).cast("int"))
        return (lo + hi) / 2.0

    def band(sign: float) -> Column:
        std = F.sqrt(roll("var_pop", "close", m.bollinger_period))
        return roll("avg", "close", m.bollinger_period) + sign * m.bollinger_std * std

    def mean_gap() -> Column:
        k.named("_tp_gap", lambda: F.abs(use("_tp") - roll("avg", "_tp", m.cci_period)))
        return roll("avg", "_tp_gap", m.cci_period)

    def volume_trend() -> Column:
        ma = use("volume_ma")
        before = lag("volume_ma", m.volume_ma_period)
        return F.when(idx < m.volume_ma_period, 0.0).otherwise(safe_divide(ma - before, before))

    def directional(up: bool) -> Column:
        rise = C("high") - F.coalesce(lag("high"), C("high"))
        fall = F.coalesce(lag("low"), C("low")) - C("low")
        mine, other = (rise, fall) if up else (fall, rise)
        return F.when((mine > other) & (mine > 0), mine).otherwise(0.0)

    ago = lambda n: lag("close", n)
    zero = F.lit(0.0)
    hh = lambda n: roll("max", "high", n)
    ll = lambda n: roll("min", "low", n)
    k.defs |= {
        "_pc": lambda: F.coalesce(lag("close"), c),
        "true_range": lambda: true_range(use("_pc")),
        "_tp": lambda: (C("high") + C("low") + c) / 3.0,
        "_delta": lambda: c - use("_pc"),
        "_ret": lambda: safe_divide(c - use("_pc"), use("_pc")),
        "_updm": lambda: directional(True),
        "_downdm": lambda: directional(False),
        "sma": lambda: roll("avg", "close", m.sma_period),
        "momentum": lambda: F.coalesce(c - ago(m.momentum_period), zero),
        "roc": lambda: F.coalesce(
            safe_divide(c - ago(m.roc_period), ago(m.roc_period)) * 100.0, zero
        ),
        "cci": lambda: safe_divide(
            use("_tp") - roll("avg", "_tp", m.cci_period), 0.015 * mean_gap()
        ),
        # a flat range counts as 50 before the scaling to percent, hence 5000
        "stoch_k": lambda: position(ll(m.stoch_k), hh(m.stoch_k), c - ll(m.stoch_k), 50.0) * 100.0,
        "stoch_d": lambda: roll("avg", "stoch_k", m.stoch_d),
        "williams_r": lambda: position(
            ll(m.williams_period), hh(m.williams_period), hh(m.williams_period) - c, 0.5
        )
        * -100.0,
        "bb_upper": lambda: band(1.0),
        "bb_middle": lambda: roll("avg", "close", m.bollinger_period),
        "bb_lower": lambda: band(-1.0),
        "rolling_mean": lambda: roll("avg", "close", m.rolling_window),
        "rolling_median": middle,
        "rolling_variance": lambda: roll("var_pop", "close", m.rolling_window),
        "std_dev": lambda: F.sqrt(roll("var_pop", "close", m.rolling_window)),
        "volatility": lambda: roll("stddev_pop", "_ret", m.rolling_window),
        "volume_ma": lambda: roll("avg", "volume", m.volume_ma_period),
        "relative_volume": lambda: safe_divide(v, use("volume_ma"), 1.0),
        "volume_spike": lambda: flag(use("relative_volume") >= m.volume_spike_multiple),
        "volume_trend": volume_trend,
        "_signed_volume": lambda: v * F.signum(c - C("open")),
        "volume_delta": lambda: roll("sum", "_signed_volume", m.volume_ma_period),
        "volume_ratio": lambda: F.when(idx == 0, 1.0).otherwise(
            safe_divide(v, lag("volume"), 1.0)
        ),
    }


def indicators(
    bars: DataFrame,
    names=None,
    cfg: AnalysisConfig = DEFAULT,
    layout: Layout = DEFAULT_LAYOUT,
    extended: bool = False,
    fills: list[S.Fill] = (),
    extra: dict | None = None,
) -> DataFrame:
    """Add indicator columns to indexed bars (``bar_idx``).

    Only what ``names`` needs is planned. With ``extended=True`` the result keeps the halo bars,
    for operators that need further windows over the new columns. ``extra`` columns are computed
    on the extended bars.
    """
    names = list(names) if names is not None else list(INDICATORS)
    need = needs(cfg)
    helper = set().union(*[need.get(n, set()) for n in names]) if names else set()
    df = S.extend(bars, layout)
    w = S.bar_window(layout)
    idx, c, m = C("bar_idx"), C("close"), cfg
    warm = lambda p: idx >= p - 1
    k = _Columns([*df.columns, *(extra or {})])
    _definitions(k, m, w)
    if extra:
        df = df.withColumns(extra)

    plain = [n for n in names if n in k.defs]
    for n in plain:
        k.use(n)
    drives = {
        "tr_s": ("true_range", lambda: S.wilder("_tr_s", C("true_range"), m.atr_period)),
        "gain_s": (
            "_delta",
            lambda: S.wilder("_gain_s", F.greatest(C("_delta"), F.lit(0.0)), m.rsi_period),
        ),
        "loss_s": (
            "_delta",
            lambda: S.wilder("_loss_s", F.greatest(-C("_delta"), F.lit(0.0)), m.rsi_period),
        ),
        "ema_fast": (None, lambda: S.ema("_ema_fast", c, m.macd_fast)),
        "ema_slow": (None, lambda: S.ema("_ema_slow", c, m.macd_slow)),
        "trx_s": ("true_range", lambda: S.wilder("_trx_s", C("true_range"), m.adx_period)),
        "up_s": ("_updm", lambda: S.wilder("_up_s", C("_updm"), m.adx_period)),
        "down_s": ("_downdm", lambda: S.wilder("_down_s", C("_downdm"), m.adx_period)),
        "cum_v": (None, lambda: S.Affine("_cum_v", C("volume"), 1.0)),
        "cum_pv": ("_tp", lambda: S.Affine("_cum_pv", C("_tp") * C("volume"), 1.0)),
    }
    for p in m.ema_periods:
        drives[f"ema_{p}"] = (None, lambda p=p: S.ema(f"ema_{p}", c, p))
    chosen = []
    for h in drives:
        if h in helper:
            drive, make = drives[h]
            if drive:
                k.use(drive)
            chosen.append(make())
    df = k.apply(df, set())
    if chosen or fills:
        df = S.recur(df, layout, chosen, list(fills))
    if "ema_fast" in helper:
        df = df.withColumn("macd", C("_ema_fast") - C("_ema_slow"))
    if "dx_s" in helper:
        ready = warm(m.adx_period)
        di = lambda n: F.when(ready, safe_divide(C(n), C("_trx_s"))).otherwise(0.0) * 100.0
        df = df.withColumns({"_pdi": di("_up_s"), "_mdi": di("_down_s")})
        df = df.withColumn(
            "_dx", safe_divide(F.abs(C("_pdi") - C("_mdi")), C("_pdi") + C("_mdi")) * 100.0
        )
    two = []
    if "signal" in helper:
        two.append(S.ema("macd_signal", C("macd"), m.macd_signal))
    if "dx_s" in helper:
        two.append(S.wilder("_dx_s", C("_dx"), m.adx_period))
    if two:
        df = S.recur(df, layout, two)
    done = {}
    if "tr_s" in helper:
        done["atr"] = F.when(warm(m.atr_period), C("_tr_s"))
    if "gain_s" in helper:
        calm = ~warm(m.rsi_period) | (C("_loss_s") == 0.0)
        done["rsi"] = F.when(calm, 100.0).otherwise(
            100.0 - 100.0 / (1.0 + C("_gain_s") / C("_loss_s"))
        )
    if "cum_v" in helper:
        done["vwap"] = F.when(
            C("_cum_v") > 0, C("_cum_pv") / F.greatest(C("_cum_v"), F.lit(1e-12))
        ).otherwise((C("high") + C("low") + c) / 3.0)
    if "signal" in helper:
        done["macd_histogram"] = C("macd") - C("macd_signal")
    if "dx_s" in helper:
        done["adx"] = F.when(warm(m.adx_period), C("_dx_s"))
    if "tick_volume" in names:
        done["tick_volume"] = F.coalesce(C("tick_volume"), F.lit(0.0))
    df = df.withColumns(done) if done else df

    kept = list(dict.fromkeys([*bars.columns, *names, *(extra or {}), *[f.name for f in fills]]))
    if extended:
        system = ["core", "_off", "_end"] + ([] if layout.bounded else ["chunk"])
        return df.select(*kept, *system)
    return S.core_rows(df).select(*kept)


def snapshot(rows: DataFrame, names, keys) -> DataFrame:
    """Last finite value of each column per series (0 when there is none)."""
    picks = [
        F.coalesce(
            F.max_by(n, F.when(C(n).isNotNull() & ~F.isnan(n), C("bar_idx"))), F.lit(0.0)
        ).alias(n)
        for n in names
    ]
    return rows.groupBy(*keys).agg(*picks)
