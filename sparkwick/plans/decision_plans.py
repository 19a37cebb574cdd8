"""Queries over strategies and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkwick.operators import decision as X
from sparkwick.operators import windowed
from sparkwick.operators import strategy as R
from sparkwick.operators.scan import fit_layout
from sparkwick.plans.base import H1, bars_sql, h1_bars, q, qcols, qs, query, with_sql
from sparkwick.sources.staging import stage

C = F.col
# One expression text per feature, evaluated by both engines over the hourly bars: simple stand-ins
# for the pipeline's features, so that every rule branch is reached and has an exact counterpart.
FEATURES = {
    "n_candles": "idx + 1.0D",
    "pa_current_close": "close",
    "trend_direction": "CASE WHEN close > c10 * 1.1D THEN 1 WHEN close < c10 * 0.9D THEN -1 ELSE 0 END",
    "trend_strength": "least(1.0D, abs(close - c10) / 100.0D)",
    "trend_duration_bars": "idx % 40",
    "trend_valid": "CASE WHEN idx >= 10 THEN 1.0D ELSE 0.0D END",
    "ind_ema_20": "m5",
    "ind_ema_50": "m10",
    "ind_ema_200": "m20",
    "ind_ema_20_valid": "1.0D",
    "ind_ema_50_valid": "CASE WHEN idx >= 10 THEN 1.0D ELSE 0.0D END",
    "ind_ema_200_valid": "CASE WHEN idx >= 20 THEN 1.0D ELSE 0.0D END",
    "micro_impulse_ratio": "high / close",
    "micro_retracement_pct": "least(100.0D, high - low)",
    "micro_valid": "CASE WHEN idx % 7 = 0 THEN 0.0D ELSE 1.0D END",
    "structure_last_bos_direction": "CASE WHEN idx % 3 = 0 THEN 0 WHEN close > open THEN 1 ELSE -1 END",
    "structure_bars_since_bos": "idx % 30",
    "structure_last_bos_strength": "abs(close - open) / 50.0D",
    "structure_last_choch_direction": "CASE WHEN idx % 5 = 0 THEN 0 WHEN close > pc THEN 1 ELSE -1 END",
    "structure_bars_since_choch": "idx % 35",
    "structure_last_choch_strength": "abs(close - pc) / 50.0D",
    "sr_distance_to_support": "(close - low) / 30.0D",
    "sr_distance_to_resistance": "(high - close) / 30.0D",
    "sr_support_valid": "CASE WHEN idx % 11 = 0 THEN 0.0D ELSE 1.0D END",
    "sr_resistance_valid": "CASE WHEN idx % 13 = 0 THEN 0.0D ELSE 1.0D END",
    "sr_nearest_support_strength": "(idx % 9) * 1.0D",
    "sr_nearest_support_touches": "idx % 6",
    "sr_nearest_resistance_strength": "(idx % 8) * 1.0D",
    "sr_nearest_resistance_touches": "idx % 5",
    "liq_last_sweep_direction": "CASE WHEN idx % 4 = 0 THEN 0 WHEN high - close > close - low THEN 1 ELSE -1 END",
    "liq_bars_since_sweep": "idx % 20",
    "liq_last_sweep_size": "(high - close) / 40.0D",
    "fvg_nearest_direction": "CASE WHEN idx % 6 = 0 THEN 0 WHEN low > pl THEN 1 ELSE -1 END",
    "fvg_distance_to_nearest": "abs(low - pl) / 5.0D",
    "fvg_nearest_size_atr": "abs(high - ph) / 40.0D",
    "ob_nearest_direction": "CASE WHEN idx % 8 = 0 THEN 0 WHEN open > pc THEN 1 ELSE -1 END",
    "ob_distance_to_nearest": "abs(open - pc) / 20.0D",
    "ob_nearest_freshness": "1.0D / (1 + idx % 4)",
    "ob_nearest_strength": "(high - low) / 60.0D",
    "ind_relative_volume": "volume / 3.0D",
    "ind_relative_volume_valid": "CASE WHEN idx >= 20 THEN 1.0D ELSE 0.0D END",
    "ind_atr": "tr",
    "ind_atr_valid": "CASE WHEN idx >= 14 THEN 1.0D ELSE 0.0D END",
    "vol_valid": "CASE WHEN idx >= 20 THEN 1.0D ELSE 0.0D END",
    "vol_expansion": "CASE WHEN tr > 80 THEN 1.0D ELSE 0.0D END",
    "vol_compression": "CASE WHEN tr < 25 THEN 1.0D ELSE 0.0D END",
    "vol_historical_volatility": "abs(ret) / 50.0D",
    "ind_rsi": "least(100.0D, close)",
    "ind_rsi_valid": "CASE WHEN idx >= 14 THEN 1.0D ELSE 0.0D END",
    "ind_macd": "m5 - m10",
    "ind_macd_signal": "m10 - m20",
    "ind_macd_valid": "CASE WHEN idx >= 10 THEN 1.0D ELSE 0.0D END",
    "ind_macd_signal_valid": "CASE WHEN idx >= 20 THEN 1.0D ELSE 0.0D END",
    "session_hour": "hour(ts)",
    "session_is_sydney": "CASE WHEN hour(ts) >= 21 OR hour(ts) < 6 THEN 1.0D ELSE 0.0D END",
    "session_is_asian": "CASE WHEN hour(ts) < 9 THEN 1.0D ELSE 0.0D END",
    "session_is_london": "CASE WHEN hour(ts) >= 7 AND hour(ts) < 16 THEN 1.0D ELSE 0.0D END",
    "session_is_newyork": "CASE WHEN hour(ts) >= 12 AND hour(ts) < 21 THEN 1.0D ELSE 0.0D END",
    "spread_spike": "CASE WHEN spread > 9 THEN 1.0D ELSE 0.0D END",
    "spread_percentile": "least(1.0D, spread / 10.0D)",
    "spread_valid": "CASE WHEN idx >= 19 THEN 1.0D ELSE 0.0D END",
    "ind_momentum_valid": "CASE WHEN idx >= 10 THEN 1.0D ELSE 0.0D END",
    "ind_roc": "(close - c10) / c10",
    "ind_roc_valid": "CASE WHEN idx >= 10 THEN 1.0D ELSE 0.0D END",
}
_AVG = {"m5": 4, "m10": 9, "m20": 19}


def feature_table(spark, sf):
    from sparkwick.operators import scan as S
    from sparkwick.operators.indicators import indicators

    bars = h1_bars(spark, sf)
    layout = fit_layout(bars)
    w = S.bar_window(layout)
    lag = lambda c, n=1: F.coalesce(F.lag(c, n).over(w), C(c))
    extra = {"pc": lag("close"), "ph": lag("high"), "pl": lag("low"), "c10": lag("close", 10)}
    extra |= {k: F.avg("close").over(w.rowsBetween(-n, 0)) for k, n in _AVG.items()}
    x = indicators(bars, ["true_range"], layout=layout, extra=extra)
    x = x.withColumnsRenamed({"bar_idx": "idx", "true_range": "tr"})
    x = x.withColumn("ret", F.expr("CASE WHEN pc <> 0 THEN (close - pc) / pc ELSE 0.0D END"))
    return stage(
        x.select("symbol", "idx", *[F.expr(e).cast("double").alias(n) for n, e in FEATURES.items()])
    )


def _duck(e: str) -> str:
    import re

    return re.sub(r"(\d+\.\d+)D\b", r"\1::DOUBLE", e)


FT = f"""ft AS MATERIALIZED (SELECT symbol, idx, {', '.join(f'({_duck(e)})::DOUBLE AS {n}' for n, e in FEATURES.items())}
  FROM (SELECT *, coalesce(lag(close, 10) OVER w, close) AS c10,
    {', '.join(f'avg(close) OVER (PARTITION BY symbol ORDER BY idx ROWS BETWEEN {n} PRECEDING AND CURRENT ROW) AS {k}' for k, n in _AVG.items())}
    FROM b WINDOW w AS (PARTITION BY symbol ORDER BY idx)))"""


def _fresh(n, limit, slope, stale):
    return f"(CASE WHEN {n} BETWEEN 0 AND {limit} THEN greatest(0, 100 - {n} / {limit} * {slope}) ELSE {stale} END)"


def rule_sql(rule: str, p: dict) -> tuple[str, str, str, str, str]:
    """(applies, passes, score, confidence, direction) of a rule, written for SQL."""
    if rule == "trend":
        return (
            "trend_valid >= 0.5", f"trend_direction <> 0 AND trend_strength >= {p.get('min_strength', 0.3)}::DOUBLE",
            "CASE WHEN trend_direction = 0 THEN least(trend_strength * 100, 40) ELSE trend_strength * 100 END",
            "50 + trend_duration_bars * 2", "trend_direction",
        )
    if rule == "ema_alignment":
        up = "(pa_current_close > ind_ema_20 AND ind_ema_20 > ind_ema_50 AND ind_ema_50 > ind_ema_200)"
        dn = "(pa_current_close < ind_ema_20 AND ind_ema_20 < ind_ema_50 AND ind_ema_50 < ind_ema_200)"
        return (
            "ind_ema_20_valid >= 0.5 AND ind_ema_50_valid >= 0.5 AND ind_ema_200_valid >= 0.5", f"{up} OR {dn}",
            f"CASE WHEN {up} OR {dn} THEN 100 ELSE 45 END", f"CASE WHEN {up} OR {dn} THEN 90 ELSE 50 END",
            f"CASE WHEN {up} THEN 1 WHEN {dn} THEN -1 ELSE sign(ind_ema_20 - ind_ema_50) END",
        )
    if rule == "swing_structure":
        ok = "(micro_impulse_ratio >= 1.2 AND micro_retracement_pct <= 70)"
        return (
            "micro_valid >= 0.5 AND trend_valid >= 0.5", ok,
            f"CASE WHEN {ok} THEN 60 + micro_impulse_ratio * 10 ELSE 50 - greatest(0, micro_retracement_pct - 70) END",
            f"CASE WHEN {ok} THEN 80 ELSE 55 END", "trend_direction",
        )
    if rule == "break_of_structure":
        n, s = "structure_bars_since_bos", "structure_last_bos_strength"
        return (
            "structure_last_bos_direction <> 0", f"{n} <= 15 AND {s} > 0",
            f"{_fresh(n, 15, 60, 25)} + least({s}, 2) * 15", f"CASE WHEN {n} <= 15 THEN 85 ELSE 45 END",
            "structure_last_bos_direction",
        )
    if rule in ("support", "resistance"):
        lim = p.get("max_distance_atr", 1.5)
        d = f"sr_distance_to_{rule}"
        near = f"({d} >= 0 AND {d} <= {lim})"
        return (
            f"sr_{rule}_valid >= 0.5", near,
            f"(CASE WHEN {near} THEN greatest(0, 100 - {d} / {lim}::DOUBLE * 60) ELSE 30 END) "
            f"+ least(sr_nearest_{rule}_strength, 5) * 5",
            f"50 + sr_nearest_{rule}_touches * 10", "1" if rule == "support" else "-1",
        )
    if rule == "liquidity_sweep":
        n = "liq_bars_since_sweep"
        return (
            "liq_last_sweep_direction <> 0", f"{n} <= 10", f"{_fresh(n, 10, 70, 20)} + least(liq_last_sweep_size, 2) * 15",
            f"CASE WHEN {n} <= 10 THEN 80 ELSE 40 END", "-liq_last_sweep_direction",
        )
    if rule == "fair_value_gap":
        d = "fvg_distance_to_nearest"
        return (
            "fvg_nearest_direction <> 0", f"{d} <= 2",
            f"(CASE WHEN {d} <= 2 THEN greatest(0, 100 - {d} / 2 * 70) ELSE 20 END) + least(fvg_nearest_size_atr, 2) * 10",
            f"CASE WHEN {d} <= 2 THEN 70 ELSE 40 END", "fvg_nearest_direction",
        )
    if rule == "order_block":
        d, f = "ob_distance_to_nearest", "ob_nearest_freshness"
        return (
            "ob_nearest_direction <> 0", f"{d} <= 2 AND {f} >= 0.5",
            f"(CASE WHEN {d} <= 2 THEN greatest(0, 100 - {d} / 2 * 60) ELSE 25 END) + {f} * 30 + least(ob_nearest_strength, 2) * 5",
            f"40 + {f} * 60", "ob_nearest_direction",
        )
    if rule == "volume":
        r = "ind_relative_volume"
        return f"{r}_valid >= 0.5", f"{r} >= 0.8", f"{r} * 50", "70", "0"
    if rule == "atr":
        return (
            "ind_atr_valid >= 0.5 AND vol_valid <> 0", "vol_expansion = 0",
            "CASE WHEN vol_expansion <> 0 THEN 35 WHEN vol_compression <> 0 THEN 65 ELSE 85 END", "75", "0",
        )
    if rule == "rsi":
        return (
            "ind_rsi_valid >= 0.5", "ind_rsi < 70 AND ind_rsi > 30",
            "CASE WHEN ind_rsi >= 70 THEN 100 - (ind_rsi - 70) * 2 WHEN ind_rsi <= 30 THEN 100 - (30 - ind_rsi) * 2 "
            "ELSE 60 + abs(ind_rsi - 50) END", "70",
            "CASE WHEN ind_rsi >= 70 THEN -1 WHEN ind_rsi <= 30 THEN 1 WHEN ind_rsi >= 50 THEN 1 ELSE -1 END",
        )
    if rule == "macd":
        h = "(ind_macd - ind_macd_signal)"
        return (
            "ind_macd_valid >= 0.5 AND ind_macd_signal_valid >= 0.5", f"{h} <> 0",
            f"CASE WHEN {h} <> 0 THEN 50 + abs({h}) / greatest(abs(ind_macd), abs(ind_macd_signal), 1e-9) * 200 ELSE 50 END",
            "65", f"sign({h})",
        )
    if rule == "session":
        liked = " OR ".join(f"session_{s} >= 0.5" for s in p.get("preferred", ("is_london", "is_newyork")))
        both = "(session_is_london >= 0.5 AND session_is_newyork >= 0.5)"
        return "true", f"{both} OR {liked}", f"CASE WHEN {both} THEN 100 WHEN {liked} THEN 75 ELSE 30 END", "90", "0"
    if rule == "spread":
        m = p.get("max_percentile", 0.8)
        return (
            "spread_valid <> 0", f"spread_spike < 0.5 AND spread_percentile <= {m}::DOUBLE",
            f"CASE WHEN spread_spike >= 0.5 THEN 20 WHEN spread_percentile <= {m}::DOUBLE THEN 100 - spread_percentile * 50 ELSE 45 END",
            "80", "0",
        )
    if rule == "volatility":
        hv = "vol_historical_volatility"
        ok = f"({hv} >= 5e-5 AND {hv} <= 0.01::DOUBLE)"
        return "vol_valid <> 0", ok, f"CASE WHEN {ok} THEN 85 WHEN {hv} > 0.01::DOUBLE THEN 30 ELSE 40 END", "70", "0"
    if rule == "momentum":
        return (
            "ind_momentum_valid >= 0.5 AND ind_roc_valid >= 0.5", "ind_roc <> 0", "50 + abs(ind_roc) * 20", "60", "sign(ind_roc)",
        )
    if rule == "choch":
        n, s = "structure_bars_since_choch", "structure_last_choch_strength"
        return (
            "structure_last_choch_direction <> 0", f"{n} <= 20", f"{_fresh(n, 20, 70, 20)} + least({s}, 2) * 10",
            f"CASE WHEN {n} <= 20 THEN 75 ELSE 40 END", "structure_last_choch_direction",
        )
    n = (
        "((spread_valid <> 0 AND spread_spike >= 0.5)::INT + (vol_valid <> 0 AND vol_expansion <> 0)::INT + (session_is_sydney >= 0.5"
        " AND session_is_asian < 0.5 AND session_is_london < 0.5 AND session_is_newyork < 0.5)::INT)"
    )
    return "true", f"{n} = 0", f"CASE WHEN {n} > 0 THEN greatest(10, 70 - {n} * 25) ELSE 90 END", "75", "0"


# a sixth strategy that holds the rules no preset uses
EXTRA = R.Strategy("rest", {"risk": 40, "choch": 30, "volume": 30})
ALL = (*R.PRESETS, EXTRA)


def _results_sql() -> str:
    parts = []
    for s in ALL:
        for rule, weight in s.weights.items():
            a, ok, sc, cf, d = rule_sql(rule, s.params.get(rule, {}))
            parts.append(
                f"""SELECT symbol, idx, '{s.name}' AS strategy, '{rule}' AS rule_name, '{R.CATEGORY[rule]}' AS category,
  {float(weight)}::DOUBLE AS weight, CASE WHEN NOT ({a}) THEN 'NOT_APPLICABLE' WHEN {ok} THEN 'PASS' ELSE 'FAIL' END AS status,
  CASE WHEN {a} THEN greatest(0, least(100, {sc}))::DOUBLE ELSE 0 END AS score,
  CASE WHEN {a} THEN greatest(0, least(100, {cf}))::DOUBLE ELSE 0 END AS confidence,
  CASE WHEN {a} THEN ({d})::INT ELSE 0 END AS direction FROM ft"""
            )
    return "rr AS MATERIALIZED (" + "\nUNION ALL ".join(parts) + ")"


RS = [H1, bars_sql("h1"), FT, _results_sql()]
KEYS = ["symbol", "idx"]


@query(
    "r_rules",
    with_sql(*RS)
    + f"""SELECT symbol, idx, strategy, rule_name, category, status, direction, {qs('weight')} AS weight, {qs('score')} AS score,
  {qs('confidence')} AS confidence, {qs('weight / 100 * score')} AS weighted_score FROM rr""",
)
def rules(spark, sf):
    t = R.rule_results(feature_table(spark, sf), KEYS, ALL)
    return t.select(*KEYS, "strategy", "rule_name", "category", "status", "direction",
                    *qcols(["weight", "score", "confidence", "weighted_score"]))


_TH = {s.name: (s.compliance_threshold, s.confidence_threshold) for s in ALL}
_CASE = lambda i: "CASE strategy " + " ".join(f"WHEN '{k}' THEN {v[i]}" for k, v in _TH.items()) + " END"


def _cat(c: str) -> str:
    w = f"sum(weight) FILTER (status <> 'NOT_APPLICABLE' AND category = '{c}')"
    v = f"sum(weight * score) FILTER (status <> 'NOT_APPLICABLE' AND category = '{c}')"
    return f"coalesce({v} / nullif({w}, 0), 0)"


EVAL = f"""ev0 AS (
  SELECT symbol, idx, strategy,
    coalesce(sum(weight * score) FILTER (status <> 'NOT_APPLICABLE') / nullif(sum(weight) FILTER (status <> 'NOT_APPLICABLE'), 0), 0) AS compliance,
    {_cat('technical')} AS technical_score, {_cat('market_quality')} AS market_quality_score, {_cat('risk')} AS risk_quality_score,
    coalesce(sum(weight * score) FILTER (status <> 'NOT_APPLICABLE'), 0) / sum(weight) AS weighted_score,
    coalesce(sum(weight * direction * score / 100) FILTER (direction <> 0) / nullif(sum(weight) FILTER (direction <> 0), 0), 0) AS net,
    count(*) FILTER (status = 'PASS') AS np, count(*) FILTER (status = 'FAIL') AS nf, count(*) FILTER (status = 'NOT_APPLICABLE') AS nn,
    coalesce(avg(confidence) FILTER (status <> 'NOT_APPLICABLE'), 0) AS certainty,
    CASE WHEN coalesce(sum(direction), 0) >= 0 THEN 1 ELSE -1 END AS maj, count(*) FILTER (direction <> 0) AS nd,
    count(*) FILTER (direction = 1) AS n_up, count(*) FILTER (direction = -1) AS n_dn,
    bool_or(rule_name = 'risk' AND status = 'FAIL') AS risk_failed
  FROM rr GROUP BY 1, 2, 3),
ev1 AS (
  SELECT ev0.*, ft.* EXCLUDE (symbol, idx), technical_score * 0.5::DOUBLE + market_quality_score * 0.3::DOUBLE + risk_quality_score * 0.2::DOUBLE AS overall_score,
    CASE WHEN net >= 0.6 THEN 'STRONG_BULLISH' WHEN net >= 0.2 THEN 'BULLISH' WHEN net <= -0.6 THEN 'STRONG_BEARISH'
      WHEN net <= -0.2 THEN 'BEARISH' ELSE 'NEUTRAL' END AS bias,
    greatest(0, least(100, 0.25::DOUBLE * certainty
      + 0.2::DOUBLE * (CASE WHEN nd = 0 THEN 50 ELSE (CASE WHEN maj = 1 THEN n_up ELSE n_dn END) * 100.0::DOUBLE / nd END)
      + 0.15::DOUBLE * (CASE WHEN trend_valid >= 0.5 THEN least(100, trend_strength * 100) ELSE 50 END)
      + 0.15::DOUBLE * (CASE WHEN vol_valid = 0 THEN 50 WHEN vol_expansion <> 0 THEN 40 WHEN vol_compression <> 0 THEN 70 ELSE 90 END)
      + 0.15::DOUBLE * (CASE WHEN structure_last_bos_direction = 0 THEN 40 ELSE
        (0.5::DOUBLE * (1 - least(structure_bars_since_bos, 50) / 50) + 0.5::DOUBLE * least(1, structure_last_bos_strength / 2)) * 100 END)
      + 0.1::DOUBLE * (CASE WHEN trend_valid < 0.5 OR structure_last_bos_direction = 0 THEN 50
        WHEN trend_direction = structure_last_bos_direction THEN 85 ELSE 35 END))) AS confidence,
    CASE WHEN sign(net) = 0 OR trend_valid < 0.5 OR trend_direction = 0 THEN 50
      WHEN trend_direction = sign(net) THEN 50 + trend_strength * 50 ELSE 50 - trend_strength * 50 END AS agreement
  FROM ev0 JOIN ft USING (symbol, idx)),
ev AS MATERIALIZED (
  SELECT *, CASE WHEN bias = 'NEUTRAL' OR risk_failed THEN 'NO_TRADE' WHEN agreement < 70 THEN 'WAIT'
    WHEN compliance >= {_CASE(0)} AND confidence >= {_CASE(1)} THEN (CASE WHEN net > 0 THEN 'BUY' ELSE 'SELL' END)
    ELSE 'WAIT' END AS recommendation FROM ev1)"""
_SCORES = ["technical_score", "market_quality_score", "risk_quality_score", "weighted_score"]


@query(
    "r09_compliance",
    with_sql(*RS, EVAL)
    + f"""SELECT symbol, idx, strategy, {qs('compliance')} AS compliance, {', '.join(f'{qs(s)} AS {s}' for s in _SCORES)},
  {qs('overall_score')} AS overall_score, np::INT AS rules_passed, nf::INT AS rules_failed, nn::INT AS rules_not_applicable FROM ev""",
)
def compliance(spark, sf):
    t = R.evaluate(feature_table(spark, sf), KEYS, ALL)
    return t.select(*KEYS, "strategy", *qcols(["compliance", "overall_score", *_SCORES]),
                    "rules_passed", "rules_failed", "rules_not_applicable")


@query(
    "r14_recommendation",
    with_sql(*RS, EVAL)
    + f"""SELECT symbol, idx, strategy, bias, recommendation, {qs('confidence')} AS confidence, {qs('net')} AS net,
  {qs('agreement')} AS structure_agreement FROM ev""",
)
def recommendation(spark, sf):
    t = R.evaluate(feature_table(spark, sf), KEYS, ALL)
    return t.select(*KEYS, "strategy", "bias", "recommendation", *qcols(["confidence", "net", "structure_agreement"]))


@query("r15_explanations")
def explanations(spark, sf):
    t = R.evaluate(feature_table(spark, sf), KEYS, R.PRESETS)
    return t.select(*KEYS, "strategy", "warnings", "explanations")


@query("r17_presets_on_features")
def presets_on_features(spark, sf):
    """The five presets over the pipeline's own window features."""
    f = windowed.window_features(h1_bars(spark, sf), window=200, horizon=5, stride=50, feature_set="union")
    keys = ["symbol", "decision_idx"]
    t = R.evaluate(stage(f), keys)
    return t.select(*keys, "strategy", "bias", "recommendation", "compliance", "confidence")


# --------------------------------------------------------------------------- decisions

FC = """fc AS (SELECT symbol, idx, CASE WHEN idx % 9 <> 0 THEN ind_roc * 10 END AS pips, CASE WHEN idx % 9 <> 0 THEN least(100, 20 + volume_) END AS fconf,
    (pa_current_close - ind_ema_20) / 100 AS mfe, ind_atr / 500 AS mae FROM (SELECT *, ind_relative_volume * 10 AS volume_ FROM ft)),
cl AS (SELECT symbol, idx, CASE WHEN ind_roc > 0.2 THEN 'SELL' WHEN ind_roc < -0.2 THEN 'BUY' ELSE 'NO_TRADE' END AS cls,
    least(100, 30 + ind_atr) AS cconf FROM ft WHERE idx % 6 <> 0)"""
DEC = """dv AS (
  SELECT ev.*, pips, fconf, mfe, mae, cls, cconf,
    CASE WHEN bias LIKE '%BULLISH' THEN 1 WHEN bias LIKE '%BEARISH' THEN -1 ELSE 0 END AS sd,
    CASE WHEN fconf IS NOT NULL THEN sign(pips) END AS fd,
    CASE WHEN cls = 'BUY' THEN 1 WHEN cls = 'SELL' THEN -1 WHEN cls IS NOT NULL THEN 0 END AS cd
  FROM ev LEFT JOIN fc USING (symbol, idx) LEFT JOIN cl USING (symbol, idx)),
dw AS (
  SELECT *, (sd * confidence + coalesce(fd * fconf, 0) + coalesce(cd * cconf, 0))
      / nullif(confidence + coalesce(fconf, 0) + coalesce(cconf, 0), 0) AS net_all,
    coalesce((coalesce(fd * fconf, 0) + coalesce(cd * cconf, 0)) / nullif(coalesce(fconf, 0) + coalesce(cconf, 0), 0), 0) AS net_m,
    CASE WHEN fd IS NULL THEN 50 WHEN sd * fd > 0 THEN 100 WHEN sd * fd < 0 THEN 0 ELSE 50 END AS fa,
    CASE WHEN cd IS NULL THEN 50 WHEN sd * cd > 0 THEN 100 WHEN sd * cd < 0 THEN 0 ELSE 50 END AS pa FROM dv),
de AS MATERIALIZED (
  SELECT *, coalesce(abs(net_all), 0) * 100 AS consensus,
    CASE WHEN recommendation IN ('BUY', 'SELL') AND net_m * sd < 0 AND abs(net_m) >= 0.5 THEN 'WAIT' ELSE recommendation END AS final,
    (0.4::DOUBLE * confidence + coalesce(0.3::DOUBLE * fconf, 0) + coalesce(0.3::DOUBLE * cconf, 0))
      / (0.4::DOUBLE + CASE WHEN fconf IS NULL THEN 0 ELSE 0.3::DOUBLE END + CASE WHEN cconf IS NULL THEN 0 ELSE 0.3::DOUBLE END) AS dconf,
    0.3::DOUBLE * compliance + 0.3::DOUBLE * overall_score + 0.25::DOUBLE * coalesce(abs(net_all), 0) * 100 + 0.15::DOUBLE * fa AS opp FROM dw)"""


def decisions(spark, sf):
    f = feature_table(spark, sf)
    strat = R.evaluate(f, KEYS, ALL)
    volume = C("ind_relative_volume") * 10.0
    known = C("idx") % 9 != 0
    fc = f.select(
        *KEYS,
        F.lit(None).cast("double").alias("expected_return"),
        F.when(known, C("ind_roc") * 10.0).alias("expected_pip_movement"),
        F.when(known, F.least(F.lit(100.0), 20.0 + volume)).alias("forecast_confidence"),
        ((C("pa_current_close") - C("ind_ema_20")) / 100.0).alias("expected_mfe"),
        (C("ind_atr") / 500.0).alias("expected_mae"),
    )
    cls = F.when(C("ind_roc") > 0.2, "SELL").when(C("ind_roc") < -0.2, "BUY").otherwise("NO_TRADE")
    cl = f.where(C("idx") % 6 != 0).select(
        *KEYS, cls.alias("predicted_class"), F.least(F.lit(100.0), 30.0 + C("ind_atr")).alias("class_confidence")
    )
    need = ["pa_current_close", "ind_atr", "ind_atr_valid", "vol_valid", "vol_expansion", "vol_compression",
            "trend_valid", "trend_strength", "trend_direction"]
    return X.decide(strat, fc, cl, KEYS).join(f.select(*KEYS, *need), KEYS)


@query(
    "x04_decision",
    with_sql(*RS, EVAL, FC, DEC)
    + f"""SELECT symbol, idx, strategy, final AS final_recommendation, {qs('consensus')} AS consensus_score, {qs('net_m')} AS model_net,
  fa::DOUBLE AS forecast_alignment, pa::DOUBLE AS probability_alignment, {qs('dconf')} AS decision_confidence,
  {qs('opp')} AS opportunity_score FROM de""",
)
def decision(spark, sf):
    t = decisions(spark, sf)
    cols = ["consensus_score", "model_net", "decision_confidence", "opportunity_score"]
    return t.select(*KEYS, "strategy", "final_recommendation", *qcols(cols), "forecast_alignment", "probability_alignment")


@query(
    "x05_trade_plan",
    with_sql(*RS, EVAL, FC, DEC, """pl AS (SELECT *, final IN ('BUY', 'SELL') AND ind_atr > 0 AND ind_atr_valid >= 1 AS ok,
    CASE WHEN final = 'BUY' THEN 1 ELSE -1 END AS side, ind_atr * 1.5::DOUBLE AS st FROM de),
pm AS (SELECT *, CASE WHEN mfe > 0 THEN least(100, mfe * 100 / abs((pa_current_close + side * st * 2) - pa_current_close)) ELSE consensus END AS feas FROM pl)""")
    + f"""SELECT symbol, idx, strategy, CASE WHEN final IN ('BUY', 'SELL') THEN final ELSE 'NONE' END AS plan_direction,
  CASE WHEN ok THEN {qs('pa_current_close - side * st')} END AS stop_loss, CASE WHEN ok THEN {qs('pa_current_close + side * st * 3')} END AS take_profit_3,
  CASE WHEN ok THEN {qs('CASE WHEN fconf IS NOT NULL AND pips IS NOT NULL AND (pips > 0) = (side > 0) THEN abs(pips) ELSE abs((pa_current_close + side * st * 2) - pa_current_close) / 0.0001::DOUBLE END', 3)} END AS expected_pip_gain,
  CASE WHEN ok THEN {qs('mae / 0.0001::DOUBLE', 3)} END AS expected_maximum_drawdown,
  {qs('CASE WHEN ok THEN feas ELSE 0 END')} AS target_feasibility,
  {qs('CASE WHEN ok THEN 0.25::DOUBLE * consensus + 0.35::DOUBLE * opp + 0.25::DOUBLE * feas + 0.15::DOUBLE * (200.0::DOUBLE / 3) ELSE (0.25::DOUBLE * consensus + 0.35::DOUBLE * opp) / 0.6::DOUBLE END')} AS trade_quality_score
FROM pm""",
)
def trade_plan(spark, sf):
    t = X.trade_plan(decisions(spark, sf))
    opt = lambda c, d=6: F.when(C(c).isNotNull(), q(c, d)).alias(c)
    return t.select(
        *KEYS, "strategy", "plan_direction", opt("stop_loss"), opt("take_profit_3"), opt("expected_pip_gain", 3),
        opt("expected_maximum_drawdown", 3), *qcols(["target_feasibility", "trade_quality_score"]),
    )


@query(
    "x06_market_analysis",
    with_sql(*RS, EVAL, FC, DEC)
    + """SELECT symbol, idx, strategy, CASE WHEN consensus >= 75 THEN 'Strong Agreement' WHEN consensus >= 40 THEN 'Partial Agreement'
  WHEN consensus > 0 THEN 'Weak Agreement' ELSE 'No Clear Signal' END AS agreement_level,
  CASE WHEN fconf IS NULL THEN 'Unavailable' WHEN fconf >= 70 THEN 'High' WHEN fconf >= 40 THEN 'Moderate' ELSE 'Low' END AS forecast_quality,
  CASE WHEN vol_valid <> 0 AND vol_expansion <> 0 THEN 'High Volatility' WHEN vol_valid <> 0 AND vol_compression <> 0 THEN 'Low Volatility'
    WHEN trend_valid >= 0.5 AND trend_strength >= 0.5 THEN 'Trending' ELSE 'Ranging' END AS market_regime,
  CASE WHEN compliance >= 70 AND consensus >= 60 THEN 'Validated' WHEN compliance >= 70 AND consensus < 40 THEN 'Conflicting'
    WHEN compliance < 40 THEN 'Not Validated' ELSE 'Partially Validated' END AS validation_status FROM de""",
)
def market_analysis(spark, sf):
    t = X.strategy_verdict(X.market_analysis(decisions(spark, sf)))
    return t.select(*KEYS, "strategy", "agreement_level", "forecast_quality", "market_regime", "validation_status")


@query("x08_documents")
def documents(spark, sf):
    t = X.explain(X.strategy_verdict(X.market_analysis(X.trade_plan(decisions(spark, sf)))))
    sections = {
        "strategy": ["bias", "recommendation", "compliance", "confidence", "consensus_score"],
        "forecast": ["expected_pip_movement", "forecast_confidence"],
        "classification": ["predicted_class", "class_confidence"],
        "trade_plan": ["plan_direction", "entry_price", "stop_loss", "take_profit_1", "take_profit_2", "take_profit_3"],
        "market": ["agreement_level", "market_regime", "current_trend"],
        "reasoning": ["supporting", "opposing", "summary", "forecast_note", "class_note"],
    }
    return X.documents(t, KEYS, sections).select(*KEYS, "strategy", "document")
