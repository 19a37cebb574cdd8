"""Fair value gaps, order blocks and spread statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwick.config import DEFAULT, DEFAULT_LAYOUT, AnalysisConfig, Layout
from sparkwick.functions.columns import clip, flag, safe_divide
from sparkwick.operators import scan as S
from sparkwick.operators.indicators import indicators
from sparkwick.operators.structure import _effective, series_stats

C = F.col


def _chunk(layout: Layout):
    return F.floor(C("bar_idx") / layout.chunk)


# --------------------------------------------------------------------------- fair value gaps


def gap_bars(
    bars: DataFrame, cfg: AnalysisConfig = DEFAULT, layout: Layout = DEFAULT_LAYOUT
) -> DataFrame:
    """Bars with the high and low two bars earlier and the effective ATR."""
    w = S.bar_window(layout)
    extra = {"_h2": F.lag("high", 2).over(w), "_l2": F.lag("low", 2).over(w)}
    rows = indicators(bars, ["atr"], cfg, layout, extra=extra)
    return _effective(rows, series_stats(bars, layout), layout)


def fair_value_gaps(
    bars: DataFrame,
    cfg: AnalysisConfig = DEFAULT,
    layout: Layout = DEFAULT_LAYOUT,
    rows: DataFrame | None = None,
) -> DataFrame:
    """Three-bar gaps with the state they reached by the last bar of the series.

    Whether a gap was filled only needs the extreme of the bars after it: a suffix minimum and
    maximum, scanned per chunk with a carry.
    """
    keys = list(layout.keys)
    rows = rows if rows is not None else gap_bars(bars, cfg, layout)
    bucket = None
    if not layout.bounded:
        bucket = "_fb"
        rows = rows.withColumn("_fb", _chunk(layout))
    rows = S.scan(
        rows,
        keys,
        ["bar_idx"],
        [
            S.Scan("_low_after", "suffix_min", C("low")),
            S.Scan("_high_after", "suffix_max", C("high")),
        ],
        bucket,
    )
    least = C("atr_eff") * cfg.fvg_min_atr
    up = (C("low") > C("_h2")) & (C("low") - C("_h2") >= least)
    down = (C("high") < C("_l2")) & (C("_l2") - C("high") >= least)
    side = lambda d, upper, lower: F.struct(
        F.lit(d).alias("direction"), upper.alias("upper"), lower.alias("lower")
    )
    g = rows.withColumn(
        "_g",
        F.when(up, side("bullish", C("low"), C("_h2"))).when(
            down, side("bearish", C("_l2"), C("high"))
        ),
    ).where(C("_g").isNotNull())
    g = g.select(
        *keys, "bar_idx", "ts", "n_bars", "last_close", "atr_eff", "_low_after", "_high_after", "_g.*"
    )
    size = C("upper") - C("lower")
    bull = C("direction") == "bullish"
    filled = F.when(bull, C("_low_after") <= C("lower")).otherwise(C("_high_after") >= C("upper"))
    reach = F.when(bull, C("upper") - C("_low_after")).otherwise(C("_high_after") - C("lower"))
    return g.select(
        *keys,
        "bar_idx",
        "ts",
        "direction",
        "upper",
        "lower",
        size.alias("size"),
        safe_divide(size, C("atr_eff")).alias("size_atr"),
        (C("n_bars") - 1 - C("bar_idx")).alias("age"),
        F.coalesce(filled, F.lit(False)).alias("filled"),
        F.coalesce(clip(reach / size, 0.0, 1.0), F.lit(0.0)).alias("fill_ratio"),
        F.least(
            F.abs(C("last_close") - C("upper")), F.abs(C("last_close") - C("lower"))
        ).alias("edge_distance"),
    )


def gap_summary(gaps: DataFrame, now: DataFrame, layout: Layout = DEFAULT_LAYOUT) -> DataFrame:
    """Counts and the nearest unfilled gap per series (``now`` has atr_last)."""
    keys = list(layout.keys)
    order = F.struct(
        "edge_distance", "bar_idx", (C("direction") == "bearish").cast("int").alias("s")
    )
    agg = gaps.groupBy(*keys).agg(
        F.count_if(C("direction") == "bullish").alias("_b"),
        F.count_if(C("direction") == "bearish").alias("_s"),
        F.count_if(~C("filled")).alias("_u"),
        F.min_by(
            F.struct("direction", "size_atr", "age", "edge_distance"), F.when(~C("filled"), order)
        ).alias("_n"),
    )
    t = now.select(*keys, "atr_last").join(agg, keys, "left")
    zero = lambda x: F.coalesce(x.cast("double"), F.lit(0.0))
    sign = F.when(C("_n")["direction"] == "bullish", 1.0).when(C("_n").isNotNull(), -1.0)
    return t.select(
        *keys,
        zero(C("_b")).alias("bullish_count"),
        zero(C("_s")).alias("bearish_count"),
        zero(C("_u")).alias("unfilled_count"),
        zero(sign).alias("nearest_direction"),
        zero(C("_n")["size_atr"]).alias("nearest_size_atr"),
        zero(C("_n")["age"]).alias("nearest_age"),
        zero(safe_divide(C("_n")["edge_distance"], C("atr_last"), None)).alias("distance_to_nearest"),
    )


# --------------------------------------------------------------------------- order blocks


def block_candidates(
    bars: DataFrame, cfg: AnalysisConfig = DEFAULT, layout: Layout = DEFAULT_LAYOUT
) -> DataFrame:
    """Opposite candles right before a strong move, last of a run, no older than the limit."""
    keys = list(layout.keys)
    w = S.bar_window(layout)
    ahead = w.rowsBetween(1, cfg.ob_horizon)
    extra = {"_fmax": F.max("high").over(ahead), "_fmin": F.min("low").over(ahead)}
    rows = indicators(bars, ["atr"], cfg, layout, extended=True, extra=extra)
    rows = _effective(rows, series_stats(bars, layout), layout)
    final = C("bar_idx") == C("n_bars") - 1
    rows = rows.withColumns(
        {
            "_fmax": F.when(final, C("high")).otherwise(C("_fmax")),
            "_fmin": F.when(final, C("low")).otherwise(C("_fmin")),
        }
    )
    need = C("atr_eff") * cfg.ob_displacement_atr
    rows = rows.withColumns(
        {
            "_bull": (C("close") < C("open")) & (C("_fmax") - C("high") >= need),
            "_bear": (C("close") > C("open")) & (C("low") - C("_fmin") >= need),
        }
    )
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.lit(False))
    rows = rows.withColumns({"_bull1": C("_bull") & ~nxt("_bull"), "_bear1": C("_bear") & ~nxt("_bear")})
    rows = S.core_rows(rows)
    recent = C("n_bars") - 1 - C("bar_idx") <= cfg.ob_max_age
    bull = rows.where(C("_bull1") & recent).withColumn("direction", F.lit("bullish"))
    bear = rows.where(C("_bear1") & recent).withColumn("direction", F.lit("bearish"))
    move = F.when(C("direction") == "bullish", C("_fmax") - C("high")).otherwise(
        C("low") - C("_fmin")
    )
    return bull.unionByName(bear).select(
        *keys,
        "bar_idx",
        "ts",
        "direction",
        C("high").alias("upper"),
        C("low").alias("lower"),
        safe_divide(move, C("atr_eff")).alias("strength"),
        (C("n_bars") - 1 - C("bar_idx")).alias("age"),
        "last_close",
    )


def order_blocks(
    bars: DataFrame,
    now: DataFrame,
    cfg: AnalysisConfig = DEFAULT,
    layout: Layout = DEFAULT_LAYOUT,
) -> DataFrame:
    """Order blocks with retests, freshness and mitigation as of the last bar.

    Only the last ``ob_max_age`` bars of a series can matter, so both sides of the range join are
    cut to them first: at most that many bars per block.
    """
    keys = list(layout.keys)
    blocks = block_candidates(bars, cfg, layout)
    sizes = now.select(*keys, "n_bars")
    tail = S.attach(bars, sizes, keys, "bar_idx", layout.bounded).where(C("bar_idx") >= C("n_bars") - cfg.ob_max_age)
    tail = tail.select(*keys, C("bar_idx").alias("_i"), C("high").alias("_h"), C("low").alias("_l"))
    b = blocks.join(tail, keys).where(C("_i") > C("bar_idx") + cfg.ob_horizon)
    bull = C("direction") == "bullish"
    enters = F.when(bull, (C("_l") <= C("upper")) & (C("_l") > C("lower"))).otherwise(
        (C("_h") >= C("lower")) & (C("_h") < C("upper"))
    )
    breaks = F.when(bull, C("_l") <= C("lower")).otherwise(C("_h") >= C("upper"))
    seen = b.groupBy(*keys, "direction", "bar_idx").agg(
        F.count_if(enters).alias("_ret"), (F.count_if(breaks) > 0).alias("_mit")
    )
    t = blocks.join(seen, [*keys, "direction", "bar_idx"], "left")
    t = t.join(now.select(*keys, C("atr_last").alias("_atr")), keys)
    away = F.when(bull, C("last_close") - C("upper")).otherwise(C("lower") - C("last_close"))
    return t.select(
        *keys,
        "bar_idx",
        "ts",
        "direction",
        "upper",
        "lower",
        "strength",
        "age",
        (1.0 / (1.0 + F.coalesce("_ret", F.lit(0)))).alias("freshness"),
        F.coalesce("_mit", F.lit(False)).alias("mitigated"),
        F.coalesce("_ret", F.lit(0)).alias("retested"),
        safe_divide(away, C("_atr"), None).alias("distance"),
    )


def block_summary(blocks: DataFrame, now: DataFrame, layout: Layout = DEFAULT_LAYOUT) -> DataFrame:
    keys = list(layout.keys)
    order = F.struct(
        F.abs("distance").alias("d"), "bar_idx", (C("direction") == "bearish").cast("int").alias("s")
    )
    facts = F.struct("direction", "strength", "freshness", "age", "distance")
    agg = blocks.groupBy(*keys).agg(
        F.count_if(C("direction") == "bullish").alias("_b"),
        F.count_if(C("direction") == "bearish").alias("_s"),
        F.count_if(~C("mitigated")).alias("_u"),
        F.min_by(facts, F.when(~C("mitigated"), order)).alias("_n"),
    )
    t = now.select(*keys).join(agg, keys, "left")
    zero = lambda x: F.coalesce(x.cast("double"), F.lit(0.0))
    sign = F.when(C("_n")["direction"] == "bullish", 1.0).when(C("_n").isNotNull(), -1.0)
    return t.select(
        *keys,
        zero(C("_b")).alias("bullish_count"),
        zero(C("_s")).alias("bearish_count"),
        zero(C("_u")).alias("unmitigated_count"),
        zero(sign).alias("nearest_direction"),
        zero(C("_n")["strength"]).alias("nearest_strength"),
        zero(C("_n")["freshness"]).alias("nearest_freshness"),
        zero(C("_n")["age"]).alias("nearest_age"),
        zero(F.abs(C("_n")["distance"])).alias("distance_to_nearest"),
    )


# --------------------------------------------------------------------------- spread

SPREAD = (
    "current", "rolling_avg", "spike", "atr_ratio", "percentile", "volatility",
    "distance_from_avg", "valid",
)


def spread_columns(cfg: AnalysisConfig, layout: Layout) -> dict:
    """Window columns behind the spread statistics (``_sp_*``)."""
    w = S.bar_window(layout).rowsBetween(-(cfg.spread_window - 1), 0)
    recent = F.collect_list("spread").over(w)
    return {
        "_sp_avg": F.avg("spread").over(w),
        "_sp_std": F.coalesce(F.stddev_pop("spread").over(w), F.lit(0.0)),
        "_sp_le": F.size(F.filter(recent, lambda x: x <= C("spread"))) / F.count("*").over(w),
    }


def spread_values(cfg: AnalysisConfig, atr) -> dict:
    """Spread statistics of a bar from the ``_sp_*`` columns; all zero until a window is full."""
    ok = C("spread").isNotNull() & (C("bar_idx") >= cfg.spread_window - 1)
    cur, avg = C("spread"), C("_sp_avg")
    values = {
        "current": cur,
        "rolling_avg": avg,
        "spike": flag((avg > 0) & (cur / avg >= cfg.spread_spike_multiple)),
        "atr_ratio": safe_divide(cur, atr),
        "percentile": C("_sp_le"),
        "volatility": C("_sp_std"),
        "distance_from_avg": safe_divide(cur - avg, avg),
        "valid": F.lit(1.0),
    }
    return {f"spread_{k}": F.coalesce(F.when(ok, v), F.lit(0.0)) for k, v in values.items()}


def spread_stats(
    bars: DataFrame, cfg: AnalysisConfig = DEFAULT, layout: Layout = DEFAULT_LAYOUT
) -> DataFrame:
    """Spread statistics as of every bar."""
    rows = indicators(bars, ["atr"], cfg, layout, extra=spread_columns(cfg, layout))
    rows = S.attach(rows, series_stats(bars, layout), layout.keys, "bar_idx", layout.bounded)
    rows = rows.withColumns(spread_values(cfg, F.coalesce(C("atr"), C("atr_fallback"))))
    return rows.select(*bars.columns, *[f"spread_{n}" for n in SPREAD])
