"""Decision table: strategy evaluation blended with forecasts and class probabilities."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = F.col
BULLISH, BEARISH = ("BULLISH", "STRONG_BULLISH"), ("BEARISH", "STRONG_BEARISH")


# The defaults define the results.
@dataclass(frozen=True)
class DecisionConfig:
    pip_size: float = 1e-4
    stop_atr: float = 1.5
    take_profit: tuple[float, float, float] = (1.0, 2.0, 3.0)
    downgrade_at: float = 0.5
    confidence_weights: dict = field(
        default_factory=lambda: {"strategy": 0.4, "regression": 0.3, "classification": 0.3}
    )
    opportunity_weights: dict = field(
        default_factory=lambda: {
            "compliance": 0.3, "overall_score": 0.3, "consensus": 0.25, "forecast_strength": 0.15,
        }
    )
    quality_weights: dict = field(
        default_factory=lambda: {
            "consensus": 0.25, "opportunity": 0.35, "target_feasibility": 0.25, "risk_reward": 0.15,
        }
    )

    def __post_init__(self):
        tp = self.take_profit
        if self.pip_size <= 0 or self.stop_atr <= 0 or not 0 <= self.downgrade_at <= 1:
            raise ValueError("pip_size and stop_atr must be positive, downgrade_at in [0, 1]")
        if len(tp) != 3 or list(tp) != sorted(tp):
            raise ValueError("take_profit needs three increasing multiples")


DECISION = DecisionConfig()


def _sign(x: Column) -> Column:
    return F.when(x > 0, 1).when(x < 0, -1).otherwise(0)


def blend(values: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted mean of the values that are present."""
    num, den = F.lit(0.0), F.lit(0.0)
    for k, v in values.items():
        w = weights.get(k, 0.0)
        num = num + F.when(v.isNotNull(), v * w).otherwise(0.0)
        den = den + F.when(v.isNotNull(), w).otherwise(0.0)
    return F.when(den > 0, num / den).otherwise(0.0)


def _net(votes) -> Column:
    num, den = F.lit(0.0), F.lit(0.0)
    for d, w in votes:
        num, den = num + F.coalesce(d * w, F.lit(0.0)), den + F.coalesce(w, F.lit(0.0))
    return F.when(den > 0, num / den).otherwise(0.0)


def _alignment(a: Column, b: Column, present: Column) -> Column:
    p = a * b
    return F.when(~present, 50.0).otherwise(F.when(p > 0, 100.0).when(p < 0, 0.0).otherwise(50.0))


FORECAST = (
    "expected_close", "expected_high", "expected_low", "expected_return", "expected_pip_movement",
    "expected_volatility", "expected_mfe", "expected_mae",
)


def decide(
    strategy: DataFrame,
    forecast: DataFrame,
    classes: DataFrame,
    on,
    cfg: DecisionConfig = DECISION,
) -> DataFrame:
    """Join the three tables on ``on`` and add votes, scores and the final recommendation.

    ``strategy`` may hold several strategies per key; a missing forecast or class drops out of
    every blend. Equi left joins: AQE picks the strategy from the real sizes.
    """
    t = strategy.join(forecast, list(on), "left").join(classes, list(on), "left")
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), C(c) / 100.0))
    has_f = C("forecast_confidence").isNotNull()
    has_c = C("predicted_class").isNotNull() & C("class_confidence").isNotNull()
    value = F.coalesce("expected_return", "expected_pip_movement")
    t = t.withColumns(
        {
            "_sd": F.when(C("bias").isin(*BULLISH), 1).when(C("bias").isin(*BEARISH), -1).otherwise(0),
            "_fd": F.when(has_f, F.coalesce(_sign(value), F.lit(0))),
            "_cd": F.when(
                has_c, F.when(C("predicted_class") == "BUY", 1).when(C("predicted_class") == "SELL", -1).otherwise(0)
            ),
            "_sw": unit("confidence"),
            "_fw": F.when(has_f, unit("forecast_confidence")),
            "_cw": F.when(has_c, unit("class_confidence")),
        }
    )
    votes = [(C("_sd"), C("_sw")), (C("_fd"), C("_fw")), (C("_cd"), C("_cw"))]
    t = t.withColumns(
        {
            "model_net": _net(votes[1:]),
            "consensus_score": F.abs(_net(votes)) * 100.0,
            "forecast_alignment": _alignment(C("_sd"), C("_fd"), has_f),
            "probability_alignment": _alignment(C("_sd"), C("_cd"), has_c),
        }
    )
    opposed = (C("model_net") * C("_sd") < 0) & (F.abs("model_net") >= cfg.downgrade_at)
    tradable = C("recommendation").isin("BUY", "SELL")
    final = F.when(tradable & opposed, "WAIT").otherwise(C("recommendation"))
    t = t.withColumns(
        {
            "final_recommendation": final,
            "decision_confidence": blend(
                {
                    "strategy": C("confidence"),
                    "regression": C("forecast_confidence"),
                    "classification": C("class_confidence"),
                },
                cfg.confidence_weights,
            ),
            "strategy_validation_score": (C("compliance") + C("confidence") + C("overall_score")) / 3.0,
            "opportunity_score": blend(
                {
                    "compliance": C("compliance"),
                    "overall_score": C("overall_score"),
                    "consensus": C("consensus_score"),
                    "forecast_strength": C("forecast_alignment"),
                },
                cfg.opportunity_weights,
            ),
        }
    )
    return t.drop("_sd", "_fd", "_cd", "_sw", "_fw", "_cw")


def trade_plan(t: DataFrame, cfg: DecisionConfig = DECISION) -> DataFrame:
    """Add the plan columns. Reads pa_current_close, ind_atr and ind_atr_valid as well."""
    trade = C("final_recommendation").isin("BUY", "SELL")
    side = F.when(C("final_recommendation") == "BUY", 1).otherwise(-1)
    entry, atr = C("pa_current_close"), C("ind_atr")
    full = trade & (atr > 0) & (C("ind_atr_valid") >= 1)
    stop = atr * cfg.stop_atr
    when = lambda x: F.when(full, x)
    tp = [entry + side * stop * r for r in cfg.take_profit]
    planned = F.abs(tp[1] - entry)
    pips = C("expected_pip_movement")
    same = pips.isNotNull() & C("forecast_confidence").isNotNull() & ((pips > 0) == (side > 0))
    gain = F.when(same, F.abs(pips)).otherwise(planned / cfg.pip_size)
    drawdown = F.coalesce(F.abs("expected_mae"), stop) / cfg.pip_size
    feasible = F.when(
        C("expected_mfe") > 0, F.least(F.lit(100.0), C("expected_mfe") * 100.0 / planned)
    ).otherwise(C("consensus_score"))
    base = {"consensus": C("consensus_score"), "opportunity": C("opportunity_score")}
    rr = min(100.0, cfg.take_profit[1] / 3.0 * 100.0)
    quality = blend(
        {**base, "target_feasibility": feasible, "risk_reward": F.lit(rr)}, cfg.quality_weights
    )
    return t.withColumns(
        {
            "plan_direction": F.when(trade, C("final_recommendation")).otherwise("NONE"),
            "entry_price": F.when(trade, entry),
            "stop_loss": when(entry - side * stop),
            **{f"take_profit_{i + 1}": when(p) for i, p in enumerate(tp)},
            "risk_reward_ratio": when(F.lit(float(cfg.take_profit[1]))),
            "expected_pip_gain": when(gain),
            "expected_maximum_drawdown": when(drawdown),
            "target_feasibility": F.coalesce(when(feasible), F.lit(0.0)),
            "trade_quality_score": F.when(full, quality).otherwise(blend(base, cfg.quality_weights)),
        }
    )


def market_analysis(t: DataFrame) -> DataFrame:
    """Qualitative buckets. Reads the volatility and trend features as well."""
    c, f = C("consensus_score"), C("forecast_confidence")
    valid = C("vol_valid") != 0
    known = [s for s in ("forecast_stability", "class_stability") if s in t.columns]
    mean = blend({k: C(k) for k in known}, dict.fromkeys(known, 1.0)) if known else F.lit(50.0)
    some = F.coalesce(*[C(k) for k in known]).isNotNull() if known else F.lit(False)
    return t.withColumns(
        {
            "agreement_level": F.when(c >= 75, "Strong Agreement")
            .when(c >= 40, "Partial Agreement")
            .when(c > 0, "Weak Agreement")
            .otherwise("No Clear Signal"),
            "forecast_quality": F.when(f.isNull(), "Unavailable")
            .when(f >= 70, "High")
            .when(f >= 40, "Moderate")
            .otherwise("Low"),
            "prediction_stability": F.when(some, mean).otherwise(50.0),
            "market_regime": F.when(valid & (C("vol_expansion") != 0), "High Volatility")
            .when(valid & (C("vol_compression") != 0), "Low Volatility")
            .when((C("trend_valid") >= 0.5) & (C("trend_strength") >= 0.5), "Trending")
            .otherwise("Ranging"),
            "current_trend": F.when(C("trend_direction") > 0, "BULLISH")
            .when(C("trend_direction") < 0, "BEARISH")
            .otherwise("SIDEWAYS"),
        }
    )


def strategy_verdict(t: DataFrame) -> DataFrame:
    c, s = C("compliance"), C("consensus_score")
    return t.withColumns(
        {
            "live_market_alignment": (c + C("market_quality_score")) / 2.0,
            "model_alignment": (C("forecast_alignment") + C("probability_alignment")) / 2.0,
            "validation_status": F.when((c >= 70) & (s >= 60), "Validated")
            .when((c >= 70) & (s < 40), "Conflicting")
            .when(c < 40, "Not Validated")
            .otherwise("Partially Validated"),
        }
    )


def explain(t: DataFrame) -> DataFrame:
    """Supporting and opposing reason codes and a one-line summary."""
    fa, pa, sa = C("forecast_alignment"), C("probability_alignment"), C("structure_agreement")
    biased = C("bias") != "NEUTRAL"
    code = lambda cond, name: F.when(cond, F.lit(name))
    pct = lambda c: F.format_string("%.1f%%", C(c) * 100.0)
    has_class = C("predicted_class").isNotNull()
    probs = {k: f"p_{k.lower()}" for k in ("BUY", "SELL", "NO_TRADE") if f"p_{k.lower()}" in t.columns}
    prob_text = F.concat_ws(", ", *[F.concat(F.lit(f"{k} "), pct(v)) for k, v in probs.items()])
    return t.withColumns(
        {
            "supporting": F.array_compact(
                F.array(
                    code(fa == 100, "forecast_agrees"),
                    code(pa == 100, "class_agrees"),
                    code(biased & (sa >= 70), "structure_confirms"),
                    code(C("compliance") >= 70, "high_compliance"),
                )
            ),
            "opposing": F.array_compact(
                F.array(
                    code(fa == 0, "forecast_opposes"),
                    code(pa == 0, "class_opposes"),
                    code(biased & (sa < 70), "structure_not_confirming"),
                    code(C("compliance") < 40, "low_compliance"),
                    code(C("final_recommendation") != C("recommendation"), "downgraded"),
                )
            ),
            "summary": F.format_string(
                "%s (strategy %s), consensus %.1f",
                C("final_recommendation"),
                C("recommendation"),
                C("consensus_score"),
            ),
            "forecast_note": F.when(C("forecast_confidence").isNull(), "no forecast")
            .when(
                C("expected_pip_movement").isNotNull(),
                F.format_string(
                    "%+.1f pips, confidence %.1f%%", C("expected_pip_movement"), C("forecast_confidence")
                ),
            )
            .otherwise(F.format_string("confidence %.1f%%", C("forecast_confidence"))),
            "class_note": F.when(~has_class, "no classification").otherwise(
                F.concat_ws("; ", F.concat(F.lit("class "), C("predicted_class")), prob_text)
            ),
        }
    )


def documents(t: DataFrame, on, sections: dict[str, list[str]]) -> DataFrame:
    """Nested document per decision, and its JSON text."""
    parts = [F.struct(*[C(c) for c in cols if c in t.columns]).alias(s) for s, cols in sections.items()]
    d = F.struct(C("final_recommendation").alias("recommendation"), *parts)
    return t.select(*on, "strategy", d.alias("decision"), F.to_json(d).alias("document"))


def shape_issues(t: DataFrame) -> DataFrame:
    """Rows whose decision breaks the output contract."""
    ok = C("final_recommendation").isin("BUY", "SELL", "WAIT", "NO_TRADE")
    scores = ["consensus_score", "decision_confidence", "opportunity_score"]
    bad = ~F.coalesce(ok, F.lit(False))
    for s in scores:
        bad = bad | C(s).isNull()
    return t.where(bad)
