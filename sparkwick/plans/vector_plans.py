"""Queries over whole feature vectors, with SQL composed of the checks of their parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkwick.operators import features as X
from sparkwick.operators import asof, windowed
from sparkwick.operators.scan import fit_layout
from sparkwick.plans.base import ATR, D1, EFF, H1, NOW, ORACLES, bars_sql, h1_bars, q, query
from sparkwick.plans.structure_plans import SWINGS

C = F.col
#: Digits to compare; 6 unless listed (products of large sums, steep ratios).
DIGITS = {
    "trend_momentum": 8, "ind_macd": 4, "ind_macd_signal": 4, "ind_macd_histogram": 4, "ind_rolling_variance": 1,
}
#: Registered checks of values as of every bar, and the features they give.
PER_BAR = {
    "f01_price_action": "", "f02_volatility": "", "e22_spread": "", "p05_sessions": "", "k_patterns": "pat_",
    **{n: "ind_" for n in (
        "i01_ema", "i02_sma", "i04_atr", "i05_rsi", "i06_macd", "i07_adx", "i08_momentum", "i09_cci",
        "i10_stochastic", "i11_williams", "i12_bollinger", "i13_vwap", "i14_rolling", "i15_volatility", "i16_volume")},
}
#: Registered checks of the state at the last bar.
STATES = {
    "e04_trend": "trend_", "e09_structure_summary": "structure_", "f03_microstructure": "micro_",
    "e12_nearest_zones": "sr_", "e15_liquidity": "liq_", "e18_fvg_summary": "fvg_", "e21_block_summary": "ob_",
}


def _alone(name: str) -> str:
    """A check without its candles and what all of them share, which stand once in front."""
    sql = ORACLES[name].removeprefix("WITH RECURSIVE ")
    for shared in (H1, D1, bars_sql("h1"), bars_sql("d1"), ATR, EFF, NOW, SWINGS):
        sql = sql.removeprefix(shared).removeprefix(",\n")
    sql = sql.strip()
    if name == "p05_sessions":
        sql = sql.replace("SELECT symbol,", "SELECT symbol, idx,", 1).replace("FROM h1)", "FROM b)")
    return sql if sql.startswith("SELECT") else f"WITH RECURSIVE {sql}"


def vector_sql(source: str, names: list[str], key: str, effective: str = EFF) -> str:
    """The feature vector of the last bar of every series of ``source``, a relation ``fan``."""
    pieces, column = [], {}
    for piece, prefix in {**PER_BAR, **STATES}.items():
        pieces.append(f"{piece} AS MATERIALIZED (SELECT * FROM ({_alone(piece)}))")
        for n in names:
            bare = n.removeprefix(prefix)
            if n.startswith(prefix) and (f" AS {bare}," in pieces[-1] or f" AS {bare} " in pieces[-1]
                                         or f" AS {bare}\n" in pieces[-1] or f" AS {bare})" in pieces[-1]):
                default = -1.0 if "bars_since" in n else 0.0
                column.setdefault(n, f"coalesce({piece}.{bare}, {default})::DOUBLE")
    for n in names:
        if n.endswith("_valid") and n != "spread_valid":
            need = X.WARMUP.get(n.removeprefix("ind_").removesuffix("_valid"), 20 if n == "vol_valid" else None)
            if need:
                column[n] = f"CASE WHEN nw.n >= {need} THEN 1.0 ELSE 0.0 END::DOUBLE"
    moves = " + ".join(f"coalesce(e04_trend.{c}, 0)" for c in ("higher_highs", "higher_lows", "lower_highs", "lower_lows"))
    column |= {
        "n_candles": "nw.n::DOUBLE",
        "trend_duration_bars": "coalesce(e04_trend.duration_bars, 0)::DOUBLE",
        "trend_valid": f"CASE WHEN {moves} > 0 THEN 1.0 ELSE 0.0 END::DOUBLE",
        "micro_valid": "CASE WHEN coalesce(e04_trend.n_swings, 0) >= 3 THEN 1.0 ELSE 0.0 END::DOUBLE",
        "sr_support_valid": "CASE WHEN e12_nearest_zones.support_zone_count > 0 THEN 1.0 ELSE 0.0 END::DOUBLE",
        "sr_resistance_valid": "CASE WHEN e12_nearest_zones.resistance_zone_count > 0 THEN 1.0 ELSE 0.0 END::DOUBLE",
        "ind_tick_volume_valid": "1.0::DOUBLE",
        "structure_last_choch_direction": "coalesce(turn.d, 0.0)::DOUBLE",
        "structure_last_choch_strength": "coalesce(round(turn.s + 1.37e-9, 6), 0.0)::DOUBLE",
    }
    missing = [n for n in names if n not in column]
    if missing:
        raise ValueError(f"no check of {missing}")
    breaks = _alone("e09_structure_summary").rpartition("SELECT symbol")[0]
    turn = f"""turn AS MATERIALIZED (SELECT * FROM ({breaks} SELECT symbol,
    CASE arg_max(direction, (idx, so)) WHEN 'bullish' THEN 1.0 ELSE -1.0 END AS d, arg_max(strength, (idx, so)) AS s
  FROM br WHERE pdir <> direction GROUP BY 1))"""
    shared = [bars_sql("fan"), ATR, effective, NOW, SWINGS]
    joins = [f"JOIN {p} ON {p}.symbol = nw.symbol AND {p}.idx = nw.n - 1" for p in PER_BAR]
    joins += [f"LEFT JOIN {p} ON {p}.symbol = nw.symbol" for p in (*STATES, "turn")]
    listed = ",\n  ".join(f"{column[n]} AS {n}" for n in names)
    return (
        "WITH RECURSIVE " + ",\n".join([H1, source, *shared, *pieces, turn])
        + f"\nSELECT {key},\n  {listed}\nFROM nw " + "\n".join(joins)
    )


def compared(names) -> list:
    return [q(n, DIGITS.get(n, 6)).alias(n) for n in names]


V185, UNION = X.feature_names("v185"), X.feature_names("union")
WINDOW, HORIZON = 200, 5
#: Every trailing window as a series of its own, named after its decision bar.
FAN = f"""fan AS MATERIALIZED (
  SELECT h.symbol || '@' || d.i AS symbol, h.* EXCLUDE (symbol, i, m)
  FROM (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY symbol) AS m
        FROM h1 WINDOW w AS (PARTITION BY symbol ORDER BY ts)) h
  JOIN (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i,
          count(*) OVER (PARTITION BY symbol) AS m FROM h1) d
    ON d.symbol = h.symbol AND h.i BETWEEN d.i - {WINDOW - 1} AND d.i
      AND d.i >= {WINDOW - 1} AND d.i + {HORIZON} < d.m)"""
WHOLE = "fan AS MATERIALIZED (SELECT * FROM h1)"


@query("f04_snapshot_features", vector_sql(WHOLE, UNION, "nw.symbol AS symbol"))
def snapshot_features(spark, sf):
    """The full feature vector per series as of its last bar."""
    bars = h1_bars(spark, sf)
    t = X.snapshot_features(bars, "union", layout=fit_layout(bars))
    return t.select("symbol", *compared(UNION))


@query(
    "d01_window_features",
    vector_sql(
        FAN, V185,
        "split_part(nw.symbol, '@', 1) AS symbol, split_part(nw.symbol, '@', 2)::BIGINT AS decision_idx",
    ),
)
def window_features(spark, sf):
    """The feature vector of the trailing window of every bar."""
    t = windowed.window_features(h1_bars(spark, sf), WINDOW, HORIZON, 1, "v185")
    return t.select("symbol", "decision_idx", *compared(V185))


WARMUP, STEP = 300, 5
#: Every sampled prefix as a series of its own.
PREFIXES = f"""fan AS MATERIALIZED (
  SELECT h.symbol || '@' || d.i AS symbol, h.* EXCLUDE (symbol, i)
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i FROM h1) h
  JOIN (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i FROM h1) d
    ON d.symbol = h.symbol AND h.i <= d.i AND d.i >= {WARMUP} AND (d.i - {WARMUP}) % {STEP} = 0)"""


@query(
    "d25_expanding_features",
    vector_sql(
        PREFIXES, UNION,
        "split_part(nw.symbol, '@', 1) AS symbol, split_part(nw.symbol, '@', 2)::BIGINT AS idx",
        EFF.replace("FROM b GROUP BY 1", "FROM b WHERE idx < 13 GROUP BY 1"),
    ),
)
def expanding(spark, sf):
    """Features of every fifth bar as its prefix gives them."""
    t = asof.state_features(h1_bars(spark, sf), WARMUP, STEP)
    return t.select("symbol", C("bar_idx").alias("idx"), *compared(UNION))
