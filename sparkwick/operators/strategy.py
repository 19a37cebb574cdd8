"""Rule-based strategies scored over a feature table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwick.functions.columns import Registry, clip, safe_divide

C = F.col
PASS, FAIL, NA = "PASS", "FAIL", "NOT_APPLICABLE"
RULES = Registry()
# Category of each rule and category weights of the overall score.
CATEGORY = {
    "trend": "technical", "ema_alignment": "technical", "swing_structure": "technical",
    "break_of_structure": "technical", "choch": "technical", "support": "market_quality",
    "resistance": "market_quality", "liquidity_sweep": "technical", "fair_value_gap": "technical",
    "order_block": "technical", "volume": "market_quality", "atr": "risk", "rsi": "technical",
    "macd": "technical", "session": "market_quality", "spread": "risk", "volatility": "risk",
    "momentum": "technical", "risk": "risk",
}
OVERALL = {"technical": 0.5, "market_quality": 0.3, "risk": 0.2}


def _on(c: str) -> Column:
    return C(c) >= 0.5


def _sign(x: Column) -> Column:
    return F.when(x > 0, 1).when(x < 0, -1).otherwise(0)


def _verdict(applies, passed, score, confidence, direction=None, note=None) -> dict[str, Column]:
    """One rule outcome by field; everything is zero where the rule does not apply."""
    where = direction if direction is not None else F.lit(0)
    sure = confidence if isinstance(confidence, Column) else F.lit(confidence)
    return {
        "status": F.when(~F.coalesce(applies, F.lit(False)), NA).when(passed, PASS).otherwise(FAIL),
        "score": F.when(applies, clip(score)).otherwise(0.0).cast("double"),
        "confidence": F.when(applies, clip(sure)).otherwise(0.0).cast("double"),
        "direction": F.when(applies, where).otherwise(0).cast("int"),
        "note": note if note is not None else F.lit(""),
    }


def _fresh(bars: Column, limit: int, slope: float, stale: float) -> tuple[Column, Column]:
    """(is fresh, base score decaying with age)."""
    fresh = (bars >= 0) & (bars <= limit)
    return fresh, F.when(fresh, F.greatest(F.lit(0.0), 100.0 - bars / max(limit, 1) * slope)).otherwise(stale)


@RULES.register("trend")
def _trend(min_strength: float = 0.3):
    d, s = C("trend_direction"), C("trend_strength")
    score = F.when(d == 0, F.least(s * 100.0, F.lit(40.0))).otherwise(s * 100.0)
    note = F.format_string("trend strength %.2f for %d bars", s, C("trend_duration_bars").cast("int"))
    return _verdict(
        _on("trend_valid"),
        (d != 0) & (s >= min_strength),
        score,
        50.0 + C("trend_duration_bars") * 2.0,
        d,
        note,
    )


@RULES.register("ema_alignment")
def _ema():
    c, a, b, z = C("pa_current_close"), C("ind_ema_20"), C("ind_ema_50"), C("ind_ema_200")
    up, down = (c > a) & (a > b) & (b > z), (c < a) & (a < b) & (b < z)
    stacked = up | down
    side = F.when(up, 1).when(down, -1).otherwise(_sign(a - b))
    return _verdict(
        _on("ind_ema_20_valid") & _on("ind_ema_50_valid") & _on("ind_ema_200_valid"),
        stacked,
        F.when(stacked, 100.0).otherwise(45.0),
        F.when(stacked, 90.0).otherwise(50.0),
        side,
        F.when(stacked, "averages stacked").otherwise("averages mixed"),
    )


@RULES.register("swing_structure")
def _swing(min_impulse_ratio: float = 1.2, max_retracement_pct: float = 70.0):
    imp, ret = C("micro_impulse_ratio"), C("micro_retracement_pct")
    clean = (imp >= min_impulse_ratio) & (ret <= max_retracement_pct)
    poor = F.greatest(F.lit(0.0), 50.0 - F.greatest(F.lit(0.0), ret - max_retracement_pct))
    return _verdict(
        _on("micro_valid") & _on("trend_valid"),
        clean,
        F.when(clean, 60.0 + imp * 10.0).otherwise(poor),
        F.when(clean, 80.0).otherwise(55.0),
        C("trend_direction"),
        F.format_string("impulse ratio %.2f, retracement %.1f%%", imp, ret),
    )


@RULES.register("break_of_structure")
def _bos(max_bars_since: int = 15):
    d, n, s = (C(f"structure_{x}") for x in ("last_bos_direction", "bars_since_bos", "last_bos_strength"))
    fresh, base = _fresh(n, max_bars_since, 60.0, 25.0)
    return _verdict(
        d != 0,
        fresh & (s > 0),
        base + F.least(s, F.lit(2.0)) * 15.0,
        F.when(fresh, 85.0).otherwise(45.0),
        d,
        F.format_string("break %d bars ago, %.2f ATR", n.cast("int"), s),
    )


@RULES.register("choch")
def _choch(max_bars_since: int = 20):
    d, n, s = (
        C(f"structure_{x}") for x in ("last_choch_direction", "bars_since_choch", "last_choch_strength")
    )
    fresh, base = _fresh(n, max_bars_since, 70.0, 20.0)
    return _verdict(
        d != 0,
        fresh,
        base + F.least(s, F.lit(2.0)) * 10.0,
        F.when(fresh, 75.0).otherwise(40.0),
        d,
        F.format_string("character changed %d bars ago", n.cast("int")),
    )


def _zone(side: str, sign: int, limit: float) -> dict[str, Column]:
    dist = C(f"sr_distance_to_{side}")
    near = (dist >= 0) & (dist <= limit)
    base = F.when(near, F.greatest(F.lit(0.0), 100.0 - dist / max(limit, 0.01) * 60.0)).otherwise(30.0)
    return _verdict(
        _on(f"sr_{side}_valid"),
        near,
        base + F.least(C(f"sr_nearest_{side}_strength"), F.lit(5.0)) * 5.0,
        50.0 + C(f"sr_nearest_{side}_touches") * 10.0,
        F.lit(sign),
        F.format_string(f"{side} %.2f ATR away", dist),
    )


@RULES.register("support")
def _support(max_distance_atr: float = 1.5):
    return _zone("support", 1, max_distance_atr)


@RULES.register("resistance")
def _resistance(max_distance_atr: float = 1.5):
    return _zone("resistance", -1, max_distance_atr)


@RULES.register("liquidity_sweep")
def _sweep(max_bars_since: int = 10):
    d, n = C("liq_last_sweep_direction"), C("liq_bars_since_sweep")
    fresh, base = _fresh(n, max_bars_since, 70.0, 20.0)
    return _verdict(
        d != 0,
        fresh,
        base + F.least(C("liq_last_sweep_size"), F.lit(2.0)) * 15.0,
        F.when(fresh, 80.0).otherwise(40.0),
        -d,  # a sweep above is a bearish signal
        F.format_string("liquidity swept %d bars ago", n.cast("int")),
    )


@RULES.register("fair_value_gap")
def _gap(max_distance_atr: float = 2.0):
    dist = C("fvg_distance_to_nearest")
    near = dist <= max_distance_atr
    base = F.greatest(F.lit(0.0), 100.0 - dist / max(max_distance_atr, 0.01) * 70.0)
    return _verdict(
        C("fvg_nearest_direction") != 0,
        near,
        F.when(near, base).otherwise(20.0) + F.least(C("fvg_nearest_size_atr"), F.lit(2.0)) * 10.0,
        F.when(near, 70.0).otherwise(40.0),
        C("fvg_nearest_direction"),
        F.format_string("unfilled gap %.2f ATR away", dist),
    )


@RULES.register("order_block")
def _block(max_distance_atr: float = 2.0, min_freshness: float = 0.5):
    dist, fr = C("ob_distance_to_nearest"), C("ob_nearest_freshness")
    near = dist <= max_distance_atr
    base = F.greatest(F.lit(0.0), 100.0 - dist / max(max_distance_atr, 0.01) * 60.0)
    return _verdict(
        C("ob_nearest_direction") != 0,
        near & (fr >= min_freshness),
        F.when(near, base).otherwise(25.0)
        + fr * 30.0
        + F.least(C("ob_nearest_strength"), F.lit(2.0)) * 5.0,
        40.0 + fr * 60.0,
        C("ob_nearest_direction"),
        F.format_string("order block %.2f ATR away", dist),
    )


@RULES.register("volume")
def _volume(min_relative_volume: float = 0.8):
    rel = C("ind_relative_volume")
    note = F.format_string("relative volume %.2f", rel)
    return _verdict(
        _on("ind_relative_volume_valid"), rel >= min_relative_volume, rel * 50.0, 70.0, None, note
    )


@RULES.register("atr")
def _atr():
    wide, tight = C("vol_expansion") != 0, C("vol_compression") != 0
    score = F.when(wide, 35.0).when(tight, 65.0).otherwise(85.0)
    note = F.when(wide, "ranges expanding").when(tight, "ranges compressed").otherwise("ranges normal")
    return _verdict(_on("ind_atr_valid") & (C("vol_valid") != 0), ~wide, score, 75.0, None, note)


@RULES.register("rsi")
def _rsi(oversold: float = 30.0, overbought: float = 70.0):
    r = C("ind_rsi")
    hot, cold = r >= overbought, r <= oversold
    score = (
        F.when(hot, 100.0 - (r - overbought) * 2.0)
        .when(cold, 100.0 - (oversold - r) * 2.0)
        .otherwise(60.0 + F.abs(r - 50.0))
    )
    side = F.when(hot, -1).when(cold, 1).otherwise(F.when(r >= 50, 1).otherwise(-1))
    return _verdict(
        _on("ind_rsi_valid"), ~(hot | cold), score, 70.0, side, F.format_string("RSI %.1f", r)
    )


@RULES.register("macd")
def _macd():
    line, sig = C("ind_macd"), C("ind_macd_signal")
    hist = line - sig
    size = F.abs(hist) / F.greatest(F.abs(line), F.abs(sig), F.lit(1e-9))
    moving = hist != 0
    return _verdict(
        _on("ind_macd_valid") & _on("ind_macd_signal_valid"),
        moving,
        F.when(moving, 50.0 + size * 200.0).otherwise(50.0),
        65.0,
        _sign(hist),
        F.format_string("MACD histogram %+.6f", hist),
    )


@RULES.register("session")
def _session(preferred: tuple[str, ...] = ("is_london", "is_newyork")):
    both = _on("session_is_london") & _on("session_is_newyork")
    liked = F.lit(False)
    for p in preferred:
        liked = liked | _on(f"session_{p}")
    score = F.when(both, 100.0).when(liked, 75.0).otherwise(30.0)
    note = F.format_string("hour %d UTC", C("session_hour").cast("int"))
    return _verdict(C("session_hour").isNotNull(), both | liked, score, 90.0, None, note)


@RULES.register("spread")
def _spread(max_percentile: float = 0.8):
    spike, pct = _on("spread_spike"), C("spread_percentile")
    calm = ~spike & (pct <= max_percentile)
    score = F.when(spike, 20.0).when(calm, 100.0 - pct * 50.0).otherwise(45.0)
    note = F.format_string("spread percentile %.0f", pct * 100.0)
    return _verdict(C("spread_valid") != 0, calm, score, 80.0, None, note)


@RULES.register("volatility")
def _volatility(min_hv: float = 5e-5, max_hv: float = 0.01):
    hv = C("vol_historical_volatility")
    inside = (hv >= min_hv) & (hv <= max_hv)
    score = F.when(inside, 85.0).when(hv > max_hv, 30.0).otherwise(40.0)
    note = F.format_string("historical volatility %.6f", hv)
    return _verdict(C("vol_valid") != 0, inside, score, 70.0, None, note)


@RULES.register("momentum")
def _momentum():
    roc = C("ind_roc")
    return _verdict(
        _on("ind_momentum_valid") & _on("ind_roc_valid"),
        roc != 0,
        50.0 + F.abs(roc) * 20.0,
        60.0,
        _sign(roc),
        F.format_string("rate of change %+.2f%%", roc),
    )


@RULES.register("risk")
def _risk():
    sydney_only = _on("session_is_sydney")
    for s in ("asian", "london", "newyork"):
        sydney_only = sydney_only & (C(f"session_is_{s}") < 0.5)
    issues = F.array_compact(
        F.array(
            F.when((C("spread_valid") != 0) & _on("spread_spike"), "spread spike"),
            F.when((C("vol_valid") != 0) & (C("vol_expansion") != 0), "volatility expansion"),
            F.when(sydney_only, "low-liquidity session"),
        )
    )
    n = F.size(issues)
    score = F.when(n > 0, F.greatest(F.lit(10.0), 70.0 - n * 25.0)).otherwise(90.0)
    return _verdict(F.lit(True), n == 0, score, 75.0, None, F.array_join(issues, ", "))


# --------------------------------------------------------------------------- strategies


@dataclass(frozen=True)
class Strategy:
    name: str
    weights: dict[str, float]
    params: dict[str, dict] = field(default_factory=dict)
    disabled: tuple[str, ...] = ()
    compliance_threshold: float = 70.0
    confidence_threshold: float = 60.0
    overall: dict[str, float] = field(default_factory=lambda: dict(OVERALL))

    def issues(self) -> list[str]:
        """Codes of configuration problems (empty when valid)."""
        out = [] if self.weights else ["empty_weights"]
        out += [f"unknown_rule:{r}" for r in self.weights if r not in RULES]
        out += [f"weight_range:{r}" for r, w in self.weights.items() if not 0 <= w <= 100]
        if self.weights and abs(sum(self.weights.values()) - 100.0) > 0.01:
            out.append("weight_sum")
        out += [f"unknown_disabled:{r}" for r in self.disabled if r not in self.weights]
        for t in ("compliance_threshold", "confidence_threshold"):
            if not 0 <= getattr(self, t) <= 100:
                out.append(f"threshold_range:{t}")
        return out


# The five preset strategies.
PRESETS = (
    Strategy(
        "ict",
        {"trend": 20, "break_of_structure": 15, "liquidity_sweep": 15, "order_block": 15,
         "ema_alignment": 10, "rsi": 10, "macd": 5, "session": 5, "spread": 5},
    ),
    Strategy(
        "trend_following",
        {"trend": 30, "ema_alignment": 20, "momentum": 15, "macd": 15, "swing_structure": 10,
         "atr": 5, "session": 5},
        {"trend": {"min_strength": 0.4}},
        compliance_threshold=65.0,
    ),
    Strategy(
        "london_breakout",
        {"session": 25, "break_of_structure": 20, "volatility": 15, "spread": 15, "atr": 10,
         "liquidity_sweep": 10, "trend": 5},
        {"session": {"preferred": ("is_london",)}},
        confidence_threshold=55.0,
    ),
    Strategy(
        "scalping",
        {"spread": 25, "volatility": 20, "momentum": 15, "session": 15, "rsi": 10, "volume": 10,
         "atr": 5},
        {"spread": {"max_percentile": 0.6}},
        compliance_threshold=75.0,
        confidence_threshold=65.0,
    ),
    Strategy(
        "swing",
        {"swing_structure": 20, "support": 15, "resistance": 15, "trend": 15, "rsi": 10,
         "order_block": 10, "fair_value_gap": 10, "volatility": 5},
        {"support": {"max_distance_atr": 2.5}, "resistance": {"max_distance_atr": 2.5}},
        compliance_threshold=65.0,
        confidence_threshold=55.0,
    ),
)


def _outcomes(s: Strategy, made: dict) -> list[Column]:
    """Rule outcomes of a strategy; ``made`` shares a rule's columns between strategies."""
    out = []
    for i, (rule, weight) in enumerate(s.weights.items()):
        if rule in s.disabled:
            continue
        params = s.params.get(rule, {})
        key = (rule, repr(sorted(params.items())))
        if key not in made:
            made[key] = [c.alias(n) for n, c in RULES[rule](**params).items()]
        out.append(
            F.struct(
                F.lit(i).alias("pos"),
                F.lit(rule).alias("rule_name"),
                F.lit(CATEGORY[rule]).alias("category"),
                F.lit(float(weight)).alias("weight"),
                *made[key],
            )
        )
    return out


def with_results(features: DataFrame, strategies=PRESETS) -> DataFrame:
    """One row per feature row and strategy with the array of its rule outcomes.

    Everything stays in the row: no rule needs a join or a shuffle.
    """
    for s in strategies:
        if s.issues():
            raise ValueError(f"{s.name}: {s.issues()}")
    made: dict = {}
    per = [
        F.struct(F.lit(s.name).alias("strategy"), F.array(*_outcomes(s, made)).alias("results"))
        for s in strategies
    ]
    t = features.withColumn("_s", F.explode(F.array(*per)))
    return t.select(*features.columns, "_s.strategy", "_s.results")


def rule_results(features: DataFrame, keys, strategies=PRESETS) -> DataFrame:
    """Long form: one row per rule outcome."""
    t = with_results(features, strategies).select(*keys, "strategy", F.explode("results").alias("r"))
    weighted = (C("r.weight") / 100.0 * C("r.score")).alias("weighted_score")
    return t.select(*keys, "strategy", "r.*", weighted)


def _total(rows: Column, value) -> Column:
    return F.aggregate(rows, F.lit(0.0), lambda acc, r: acc + value(r))


def _mean(rows: Column, value) -> Column:
    return safe_divide(_total(rows, lambda r: r["weight"] * value(r)), _total(rows, lambda r: r["weight"]))


def evaluate(features: DataFrame, keys, strategies=PRESETS) -> DataFrame:
    """Compliance, scores, confidence, bias and recommendation per row and strategy."""
    t = with_results(features, strategies)
    r = C("results")
    live = F.filter(r, lambda x: x["status"] != NA)
    t = t.withColumn("_live", live)
    live = C("_live")
    in_cat = lambda c: F.filter(live, lambda x: x["category"] == c)
    directed = F.filter(live, lambda x: x["direction"] != 0)
    by_strategy = lambda f: F.coalesce(
        *[F.when(C("strategy") == s.name, F.lit(float(f(s)))) for s in strategies]
    )
    count = lambda status: F.size(F.filter(r, lambda x: x["status"] == status))
    t = t.withColumns(
        {
            "compliance": _mean(live, lambda x: x["score"]),
            "technical_score": _mean(in_cat("technical"), lambda x: x["score"]),
            "market_quality_score": _mean(in_cat("market_quality"), lambda x: x["score"]),
            "risk_quality_score": _mean(in_cat("risk"), lambda x: x["score"]),
            "weighted_score": safe_divide(
                _total(live, lambda x: x["weight"] * x["score"]), _total(r, lambda x: x["weight"])
            ),
            "net": _mean(directed, lambda x: x["direction"] * x["score"] / 100.0),
            "rules_passed": count(PASS),
            "rules_failed": count(FAIL),
            "rules_not_applicable": count(NA),
            "_sides": F.transform(directed, lambda x: x["direction"]),
            "risk_failed": F.exists(r, lambda x: (x["rule_name"] == "risk") & (x["status"] == FAIL)),
        }
    )
    names = {"technical": "technical_score", "market_quality": "market_quality_score", "risk": "risk_quality_score"}
    overall = sum(C(c) * by_strategy(lambda s, k=k: s.overall.get(k, 0.0)) for k, c in names.items())
    n = C("net")
    bias = (
        F.when(n >= 0.6, "STRONG_BULLISH")
        .when(n >= 0.2, "BULLISH")
        .when(n <= -0.6, "STRONG_BEARISH")
        .when(n <= -0.2, "BEARISH")
        .otherwise("NEUTRAL")
    )
    sides = C("_sides")
    major = F.when(F.aggregate(sides, F.lit(0), lambda a, x: a + x) >= 0, 1).otherwise(-1)
    agree = F.size(F.filter(sides, lambda x: x == C("_major"))) / F.size(sides) * 100.0
    t = t.withColumns({"overall_score": overall, "bias": bias, "_major": major})
    valid, direction = _on("trend_valid"), C("trend_direction")
    broke = C("structure_last_bos_direction")
    age = 1.0 - F.least(C("structure_bars_since_bos"), F.lit(50.0)) / 50.0
    push = F.least(F.lit(1.0), C("structure_last_bos_strength") / 2.0)
    calm = F.when(C("vol_expansion") != 0, 40.0).when(C("vol_compression") != 0, 70.0).otherwise(90.0)
    t = t.withColumns(
        {
            "rule_certainty": safe_divide(
                _total(live, lambda x: x["confidence"]), F.size(live).cast("double")
            ),
            "indicator_agreement": F.when(F.size(sides) == 0, 50.0).otherwise(agree),
            "trend_consistency": F.when(valid, F.least(F.lit(100.0), C("trend_strength") * 100.0)).otherwise(50.0),
            "volatility_stability": F.when(C("vol_valid") != 0, calm).otherwise(50.0),
            "structure_quality": F.when(broke == 0, 40.0).otherwise(
                (0.5 * F.greatest(F.lit(0.0), age) + 0.5 * push) * 100.0
            ),
            "signal_stability": F.when(~valid | (broke == 0), 50.0).otherwise(
                F.when(direction == broke, 85.0).otherwise(35.0)
            ),
        }
    )
    parts = {
        "rule_certainty": 0.25, "indicator_agreement": 0.2, "trend_consistency": 0.15,
        "volatility_stability": 0.15, "structure_quality": 0.15, "signal_stability": 0.1,
    }
    confidence = clip(sum(C(k) * w for k, w in parts.items()))
    neutral = (_sign(n) == 0) | ~valid | (direction == 0)
    agreement = F.when(neutral, 50.0).otherwise(
        F.when(direction == _sign(n), 50.0 + C("trend_strength") * 50.0).otherwise(
            50.0 - C("trend_strength") * 50.0
        )
    )
    t = t.withColumns({"confidence": confidence, "structure_agreement": agreement})
    ready = (C("compliance") >= by_strategy(lambda s: s.compliance_threshold)) & (
        C("confidence") >= by_strategy(lambda s: s.confidence_threshold)
    )
    up = C("bias").isin("BULLISH", "STRONG_BULLISH")
    recommendation = (
        F.when((C("bias") == "NEUTRAL") | C("risk_failed"), "NO_TRADE")
        .when(C("structure_agreement") < 70.0, "WAIT")
        .when(ready, F.when(up, "BUY").otherwise("SELL"))
        .otherwise("WAIT")
    )
    t = t.withColumn("recommendation", recommendation)
    t = t.withColumns({"warnings": _warnings(), "explanations": _explanations()})
    kept = [
        "bias", "recommendation", "compliance", "confidence", "structure_agreement", "net",
        "technical_score", "market_quality_score", "risk_quality_score", "overall_score",
        "weighted_score", "rules_passed", "rules_failed", "rules_not_applicable", *parts,
        "warnings", "explanations",
    ]
    return t.select(*keys, "strategy", *kept)


def _warnings() -> Column:
    r = C("results")
    idle = F.filter(r, lambda x: x["status"] == NA)
    risk = F.get(F.filter(r, lambda x: (x["rule_name"] == "risk") & (x["status"] == FAIL)), F.lit(0))
    return F.array_compact(
        F.array(
            F.when(C("n_candles") < 50, F.format_string("only %d candles", C("n_candles").cast("int"))),
            F.when(
                F.size(idle) > F.size(r) / 2,
                F.concat(
                    F.lit("mostly not applicable: "),
                    F.array_join(F.transform(idle, lambda x: x["rule_name"]), ", "),
                ),
            ),
            F.when(risk.isNotNull(), F.concat(F.lit("risk: "), risk["note"])),
            F.when(
                (C("bias") != "NEUTRAL") & (C("structure_agreement") < 70.0),
                F.format_string("structure agreement only %.0f%%", C("structure_agreement")),
            ),
        )
    )


def _explanations() -> Column:
    """Passing rules by weight, up to three caveats, and the headline percentages."""

    def ordered(status):
        rows = F.transform(
            F.filter(C("results"), lambda x: x["status"] == status),
            lambda x: F.struct((-x["weight"]).alias("w"), x["pos"].alias("p"), x["note"].alias("n")),
        )
        return F.transform(F.array_sort(rows), lambda x: x["n"])

    caveats = F.transform(F.slice(ordered(FAIL), 1, 3), lambda n: F.concat(F.lit("caveat: "), n))
    head = F.array(F.concat(F.lower(F.translate("bias", "_", " ")), F.lit(" bias")))
    tail = F.array(
        F.format_string("compliance %.0f%%", C("compliance")),
        F.format_string("confidence %.0f%%", C("confidence")),
        F.format_string("structure agreement %.0f%%", C("structure_agreement")),
    )
    return F.concat(head, ordered(PASS), caveats, tail)
