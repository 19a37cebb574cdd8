"""Queries over candles: sources, cleaning, scalar columns, indicators and patterns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwick.functions import columns as P
from sparkwick.operators import imbalance
from sparkwick.operators.indicators import INDICATORS, indicators, snapshot
from sparkwick.operators.patterns import PATTERNS, patterns
from sparkwick.operators.scan import fit_layout
from sparkwick.plans.base import (
    ATR,
    D1,
    EFF,
    H1,
    LONG,
    YEAR,
    bars_sql,
    d1,
    d1_bars,
    h1,
    h1_bars,
    q,
    qcols,
    qs,
    qsql,
    query,
    smooth_sql,
    supplier_bars,
    supplier_days,
    table,
    with_sql,
)
from sparkwick.sources import candles as src

C = F.col
OHLC = ["open", "high", "low", "close"]
FMT = "yyyy-MM-dd HH:mm:ss"


def at():
    return F.date_format("ts", FMT).alias("at")


AT = "strftime(ts, '%Y-%m-%d %H:%M:%S') AS at"
WIN = "(PARTITION BY symbol ORDER BY idx)"


def roll(expr: str, n: int) -> str:
    return (
        f"{expr} OVER (PARTITION BY symbol ORDER BY idx ROWS BETWEEN {n - 1} PRECEDING "
        "AND CURRENT ROW)"
    )


# --------------------------------------------------------------------------- sources


@query(
    "s03_candles_hourly",
    with_sql(H1)
    + f"SELECT symbol, {AT}, {qsql([*OHLC, 'volume', 'spread', 'tick_volume'])} FROM h1",
)
def candles_hourly(spark, sf):
    return h1(spark, sf).select("symbol", at(), *qcols([*OHLC, "volume", "spread", "tick_volume"]))


@query(
    "s03_candles_daily_brand",
    with_sql(D1) + f"SELECT symbol, {AT}, {qsql([*OHLC, 'volume', 'tick_volume'])} FROM d1",
)
def candles_daily(spark, sf):
    return d1(spark, sf).select("symbol", at(), *qcols([*OHLC, "volume", "tick_volume"]))


@query(
    "s03_candles_supplier",
    f"""SELECT l_suppkey::VARCHAR AS symbol, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS at,
  {qs('max(floor(l_extendedprice * 100.0::DOUBLE / l_quantity) / 100.0::DOUBLE)')} AS high,
  {qs('min(floor(l_extendedprice * 100.0::DOUBLE / l_quantity) / 100.0::DOUBLE)')} AS low,
  {qs('sum(l_quantity)')} AS volume FROM lineitem GROUP BY 1, 2""",
)
def candles_supplier(spark, sf):
    days = supplier_days(table(spark, sf, "lineitem"))
    return days.select("symbol", at(), *qcols(["high", "low", "volume"]))


@query(
    "s03_closed_bars",
    with_sql(H1)
    + """SELECT symbol, count(*) AS n_closed FROM h1
WHERE ts + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) GROUP BY 1""",
)
def closed_bars(spark, sf):
    """Bars still forming at the newest event are left out."""
    newest = table(spark, sf, "events").agg(F.max("ts")).first()[0]
    return src.closed_only(h1(spark, sf), F.lit(newest), 3600).groupBy("symbol").agg(
        F.count("*").alias("n_closed")
    )


def dirty(spark, sf) -> DataFrame:
    """Candles with repeats, missing hours and swapped extremes, in ingest order."""
    b = h1_bars(spark, sf).where(C("bar_idx") % 97 != 96)
    swap = C("bar_idx") % 101 == 100
    b = b.withColumns(
        {
            "high": F.when(swap, C("low")).otherwise(C("high")),
            "low": F.when(swap, C("high")).otherwise(C("low")),
        }
    ).withColumn("ingest_seq", C("bar_idx") * 10)
    again = b.where(C("bar_idx") % 50 == 49).withColumns(
        {"close": C("close") + 0.01, "ingest_seq": C("ingest_seq") + 5}
    )
    return b.unionByName(again).drop("bar_idx")


DIRTY = """dirty AS MATERIALIZED (
  WITH i AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS idx FROM h1),
  k AS (SELECT symbol, ts, open, CASE WHEN idx % 101 = 100 THEN low ELSE high END AS high,
      CASE WHEN idx % 101 = 100 THEN high ELSE low END AS low, close, volume, idx, idx * 10 AS seq
    FROM i WHERE idx % 97 <> 96)
  SELECT * FROM k
  UNION ALL SELECT symbol, ts, open, high, low, close + 0.01::DOUBLE, volume, idx, seq + 5
    FROM k WHERE idx % 50 = 49)"""


@query(
    "s05_conform",
    """SELECT event_type AS symbol, count(*) AS n_rows,
  count(*) FILTER (event_id % 13 = 0 OR event_id % 17 = 0) AS n_bad,
  sum(CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END)::BIGINT AS n_volume_filled
FROM events GROUP BY 1""",
)
def conform(spark, sf):
    """Text prices: unreadable ones are quarantined, unreadable volumes become 0."""
    ev = table(spark, sf, "events")
    text = C("value").cast("string")
    broken = F.when(C("event_id") % 13 == 0, "n/a").when(C("event_id") % 17 == 0, "NaN")
    raw = ev.select(
        C("event_type").alias("symbol"),
        F.lit("T").alias("timeframe"),
        C("ts").cast("string").alias("ts"),
        *[F.coalesce(broken, text).alias(c) for c in OHLC],
        F.when(C("event_id") % 7 == 0, "?").otherwise("3").alias("volume"),
    )
    m = src.conform(raw)
    return m.groupBy("symbol").agg(
        F.count("*").alias("n_rows"),
        F.count_if("bad_prices").alias("n_bad"),
        F.count_if(C("volume") == 0.0).alias("n_volume_filled"),
    )


@query(
    "s06_dedup_last",
    with_sql(H1, DIRTY)
    + f"""SELECT symbol, {AT}, {qs('close')} AS close FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY seq DESC) AS rn FROM dirty)
WHERE rn = 1""",
)
def dedup(spark, sf):
    return src.dedup_last(dirty(spark, sf)).select("symbol", at(), q("close").alias("close"))


@query(
    "s07_geometry",
    with_sql(H1, DIRTY)
    + """SELECT symbol, count(*) AS n_rows, count(*) FILTER (high < low) AS high_below_low,
  count(*) FILTER (high < greatest(open, close) OR low > least(open, close)) AS body_outside_range,
  count(*) FILTER (least(open, high, low, close) <= 0) AS non_positive_price
FROM dirty GROUP BY 1""",
)
def geometry(spark, sf):
    return src.geometry_report(dirty(spark, sf)).drop("timeframe")


FILLED = """filled AS (
  WITH g AS (SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts
    FROM h1 GROUP BY 1)
  SELECT g.symbol, g.ts, h1.open IS NULL AS gap, h1.open AS o, h1.high AS h, h1.low AS l,
    last_value(h1.close IGNORE NULLS) OVER w AS pc, h1.volume AS v,
    last_value(h1.spread IGNORE NULLS) OVER w AS spread,
    last_value(h1.tick_volume IGNORE NULLS) OVER w AS tick_volume
  FROM g LEFT JOIN h1 ON g.symbol = h1.symbol AND g.ts = h1.ts
  WINDOW w AS (PARTITION BY g.symbol ORDER BY g.ts))"""


@query(
    "s08_gap_fill",
    with_sql(H1, FILLED)
    + f"""SELECT symbol, {AT}, gap AS is_filled, {qs('coalesce(o, pc)')} AS open,
  {qs('coalesce(h, pc)')} AS high, {qs('coalesce(l, pc)')} AS low, {qs('pc')} AS close,
  {qs('coalesce(v, 0)')} AS volume, {qs('spread')} AS spread, {qs('tick_volume')} AS tick_volume
FROM filled""",
)
def gap_fill(spark, sf):
    t = src.fill_gaps(h1(spark, sf), span_seconds=YEAR)
    return t.select(
        "symbol", at(), "is_filled", *qcols([*OHLC, "volume", "spread", "tick_volume"])
    )


@query(
    "s09_audit",
    with_sql(H1, DIRTY)
    + """, d AS (SELECT *, date_diff('second', lag(ts) OVER (PARTITION BY symbol ORDER BY seq), ts)
    AS step FROM dirty),
m AS (SELECT symbol, arg_max(step, (c, -step)) AS modal FROM
    (SELECT symbol, step, count(*) AS c FROM d WHERE step IS NOT NULL GROUP BY 1, 2) GROUP BY 1)
SELECT d.symbol, count(*) AS n_rows, count(*) - count(DISTINCT ts) AS duplicate_timestamps,
  bool_or(coalesce(step < 0, false)) AS is_unsorted, max(modal)::DOUBLE AS modal_step_seconds,
  count(*) FILTER (step > modal) AS gap_count
FROM d JOIN m ON d.symbol = m.symbol GROUP BY 1""",
)
def audit(spark, sf):
    return src.audit(dirty(spark, sf), "ingest_seq").drop("timeframe")


# --------------------------------------------------------------------------- scalar columns


@query(
    "p01_candle_parts",
    with_sql(D1)
    + f"""SELECT symbol, {AT}, {qs('abs(close - open)')} AS body, {qs('high - low')} AS "range",
  {qs('high - greatest(open, close)')} AS upper_wick, {qs('least(open, close) - low')} AS lower_wick,
  close > open AS is_bullish FROM d1""",
)
def candle_parts(spark, sf):
    return d1(spark, sf).select(
        "symbol",
        at(),
        q(P.body()).alias("body"),
        q(P.candle_range()).alias("range"),
        q(P.upper_wick()).alias("upper_wick"),
        q(P.lower_wick()).alias("lower_wick"),
        P.is_bullish().alias("is_bullish"),
    )


_HOURS = {"sydney": "hr >= 21 OR hr < 6", "asian": "hr < 9", "london": "hr >= 7 AND hr < 16"}
_HOURS["newyork"] = "hr >= 12 AND hr < 21"


@query(
    "p05_sessions",
    with_sql(H1)
    + f"""SELECT symbol, {AT}, {', '.join(
        f'CASE WHEN {c} THEN 1.0::DOUBLE ELSE 0.0 END AS session_is_{n}' for n, c in _HOURS.items())},
  CASE WHEN {' + '.join(f'({c})::INT' for c in _HOURS.values())} >= 2 THEN 1.0::DOUBLE ELSE 0.0 END
    AS session_session_overlap, hr::DOUBLE AS session_hour, minute(ts)::DOUBLE AS session_minute,
  (isodow(ts) - 1)::DOUBLE AS session_day_of_week, month(ts)::DOUBLE AS session_month
FROM (SELECT *, hour(ts) AS hr FROM h1)""",
)
def sessions(spark, sf):
    cols = P.session_columns(C("ts"))
    return h1(spark, sf).select("symbol", at(), *[v.alias(k) for k, v in cols.items()])


@query(
    "p06_encodings",
    f"""SELECT event_id, {', '.join(
        f"{qs(f'{fn}(2 * pi() * {x} / {p})')} AS session_{n}_{fn}"
        for n, x, p in (('hour', 'hour(ts)', 24), ('minute', 'minute(ts)', 60),
                        ('day_of_week', '(isodow(ts) - 1)', 7), ('month', 'month(ts)', 12))
        for fn in ('sin', 'cos'))},
  CASE WHEN value < 20 THEN 1.0::DOUBLE ELSE 0.0 END AS trend_direction_neg,
  CASE WHEN value >= 20 AND value <= 60 THEN 1.0::DOUBLE ELSE 0.0 END AS trend_direction_zero,
  CASE WHEN value > 60 THEN 1.0::DOUBLE ELSE 0.0 END AS trend_direction_pos FROM events""",
)
def encodings(spark, sf):
    from sparkwick.operators.dataset import encode

    ev = table(spark, sf, "events")
    sign = F.when(C("value") < 20, -1.0).when(C("value") > 60, 1.0).otherwise(0.0)
    df = ev.select(
        "event_id",
        sign.alias("trend_direction"),
        *[v.alias(k) for k, v in P.session_columns(C("ts")).items() if k in P.CYCLES],
    )
    df, names = encode(df, ["trend_direction", *P.CYCLES], cyclic=True, categories=True)
    return df.select("event_id", *qcols(names))


# --------------------------------------------------------------------------- indicators


def series(spark, sf, names, base=d1_bars, layout=None, digits=6):
    bars = base(spark, sf)
    rows = indicators(bars, names, layout=layout or fit_layout(bars))
    return rows.select("symbol", C("bar_idx").alias("idx"), *qcols(names, digits))


def series_sql(select: str, *ctes: str, src_name: str = "d1", tail: str = "b") -> str:
    source = {"d1": D1, "h1": H1}[src_name]
    return (
        with_sql(source, bars_sql(src_name), *ctes) + f"SELECT symbol, idx, {select} FROM {tail}"
    )


EMAS = {f"ema_{p}": ("close", 2 / (p + 1)) for p in (20, 50, 100, 200)}


@query("i01_ema", series_sql(qsql(EMAS), smooth_sql("sm", "b", EMAS), tail="sm"))
def i01(spark, sf):
    return series(spark, sf, list(EMAS), layout=LONG)


@query("i02_sma", series_sql(f"{qs(roll('avg(close)', 20))} AS sma"))
def i02(spark, sf):
    return series(spark, sf, ["sma"])


@query(
    "i04_atr",
    series_sql(
        f"{qs('tr')} AS true_range, CASE WHEN atr IS NULL THEN NULL ELSE {qs('atr')} END AS atr",
        ATR, EFF, tail="a",
    ),
)
def i04(spark, sf):
    return series(spark, sf, ["true_range", "atr"], layout=LONG)


GAINS = {"g": ("greatest(delta, 0)", 1 / 14), "l": ("greatest(-delta, 0)", 1 / 14)}


@query(
    "i05_rsi",
    series_sql(
        f"CASE WHEN idx < 13 OR l = 0 THEN 100.0::DOUBLE ELSE {qs('100 - 100 / (1 + g / l)')} END AS rsi",
        smooth_sql("sm", "b", GAINS), tail="sm",
    ),
)
def i05(spark, sf):
    return series(spark, sf, ["rsi"], layout=LONG)


MACD = ["macd", "macd_signal", "macd_histogram"]


@query(
    "i06_macd",
    series_sql(
        f"{qs('macd', 4)} AS macd, {qs('s', 4)} AS macd_signal, {qs('macd - s', 4)} AS macd_histogram",
        smooth_sql("sm", "b", {"f": ("close", 2 / 13), "w": ("close", 2 / 27)}),
        "m AS MATERIALIZED (SELECT *, f - w AS macd FROM sm)",
        smooth_sql("sg", "m", {"s": ("macd", 0.2)}),
        tail="m JOIN sg USING (symbol, idx)",
    ),
)
def i06(spark, sf):
    return series(spark, sf, MACD, layout=LONG, digits=4)


DM = {
    "t": ("tr", 1 / 14),
    "u": ("CASE WHEN high - ph > pl - low AND high > ph THEN high - ph ELSE 0 END", 1 / 14),
    "d": ("CASE WHEN pl - low > high - ph AND pl > low THEN pl - low ELSE 0 END", 1 / 14),
}


@query(
    "i07_adx",
    series_sql(
        f"CASE WHEN idx >= 13 THEN {qs('adx')} END AS adx",
        smooth_sql("sm", "b", DM),
        """di AS (SELECT symbol, idx,
    CASE WHEN idx >= 13 AND t <> 0 THEN 100 * u / t ELSE 0 END AS pdi,
    CASE WHEN idx >= 13 AND t <> 0 THEN 100 * d / t ELSE 0 END AS mdi FROM sm)""",
        """m AS MATERIALIZED (SELECT symbol, idx,
    CASE WHEN pdi + mdi <> 0 THEN 100 * abs(pdi - mdi) / (pdi + mdi) ELSE 0 END AS dx FROM di)""",
        smooth_sql("sx", "m", {"adx": ("dx", 1 / 14)}),
        src_name="h1", tail="sx",
    ),
)
def i07(spark, sf):
    return series(spark, sf, ["adx"], h1_bars, LONG)


AGO = f"lag(close, 10) OVER {WIN}"


@query(
    "i08_momentum",
    series_sql(
        f"{qs(f'coalesce(close - {AGO}, 0)')} AS momentum, "
        f"{qs(f'coalesce((close - {AGO}) / {AGO} * 100, 0)')} AS roc"
    ),
)
def i08(spark, sf):
    return series(spark, sf, ["momentum", "roc"])


@query(
    "i09_cci",
    series_sql(
        f"CASE WHEN mad <> 0 THEN {qs('(tp - ma) / (0.015::DOUBLE * mad)')} ELSE 0.0 END AS cci",
        f"m1 AS (SELECT *, {roll('avg(tp)', 20)} AS ma FROM b)",
        f"m2 AS (SELECT *, {roll('avg(abs(tp - ma))', 20)} AS mad FROM m1)",
        tail="m2",
    ),
)
def i09(spark, sf):
    return series(spark, sf, ["cci"])


_LL, _HH = roll("min(low)", 14), roll("max(high)", 14)


@query(
    "i10_stochastic",
    series_sql(
        f"{qs('k')} AS stoch_k, {qs(roll('avg(k)', 3))} AS stoch_d",
        f"""k0 AS (SELECT symbol, idx, close, {_LL} AS ll, {_HH} AS hh FROM b),
k1 AS (SELECT *, CASE WHEN hh <> ll THEN 100 * (close - ll) / (hh - ll) ELSE 5000 END AS k FROM k0)""",
        tail="k1",
    ),
)
def i10(spark, sf):
    return series(spark, sf, ["stoch_k", "stoch_d"], layout=LONG)


@query(
    "i11_williams",
    series_sql(
        f"CASE WHEN hh <> ll THEN {qs('-100 * (hh - close) / (hh - ll)')} ELSE -50.0::DOUBLE END AS williams_r",
        f"k0 AS (SELECT symbol, idx, close, {_LL} AS ll, {_HH} AS hh FROM b)",
        tail="k0",
    ),
)
def i11(spark, sf):
    return series(spark, sf, ["williams_r"])


@query(
    "i12_bollinger",
    series_sql(
        f"{qs('m + 2 * s')} AS bb_upper, {qs('m')} AS bb_middle, {qs('m - 2 * s')} AS bb_lower",
        f"k0 AS (SELECT symbol, idx, {roll('avg(close)', 20)} AS m, {roll('stddev_pop(close)', 20)} AS s FROM b)",
        tail="k0",
    ),
)
def i12(spark, sf):
    return series(spark, sf, ["bb_upper", "bb_middle", "bb_lower"])


@query(
    "i13_vwap",
    series_sql(
        f"{qs(f'sum(tp * volume) OVER {WIN} / sum(volume) OVER {WIN}')} AS vwap"
    ),
)
def i13(spark, sf):
    return series(spark, sf, ["vwap"], layout=LONG)


@query(
    "i14_rolling",
    series_sql(
        f"{qs(roll('avg(close)', 20))} AS rolling_mean, {qs(roll('median(close)', 20))} AS rolling_median, "
        f"{qs(roll('var_pop(close)', 20), 1)} AS rolling_variance, {qs(roll('stddev_pop(close)', 20))} AS std_dev"
    ),
)
def i14(spark, sf):
    names = ["rolling_mean", "rolling_median", "rolling_variance", "std_dev"]
    bars = d1_bars(spark, sf)
    rows = indicators(bars, names, layout=fit_layout(bars))
    return rows.select(
        "symbol",
        C("bar_idx").alias("idx"),
        *[q(n, 1 if n == "rolling_variance" else 6).alias(n) for n in names],
    )


@query("i15_volatility", series_sql(f"{qs(roll('stddev_pop(ret)', 20))} AS volatility"))
def i15(spark, sf):
    return series(spark, sf, ["volatility"])


_MA20 = f"lag(ma, 20) OVER {WIN}"


@query(
    "i16_volume",
    series_sql(
        f"""{qs('ma')} AS volume_ma, {qs('CASE WHEN ma <> 0 THEN volume / ma ELSE 1 END')} AS relative_volume,
  CASE WHEN ma <> 0 AND volume / ma >= 2 THEN 1.0::DOUBLE ELSE 0.0 END AS volume_spike,
  {qs(f'CASE WHEN idx < 20 THEN 0 ELSE (ma - {_MA20}) / {_MA20} END')} AS volume_trend,
  {qs(roll('sum(volume * sign(close - open))', 20))} AS volume_delta,
  {qs(f'CASE WHEN idx = 0 THEN 1 ELSE volume / lag(volume) OVER {WIN} END')} AS volume_ratio,
  {qs('tick_volume')} AS tick_volume""",
        f"k0 AS (SELECT *, {roll('avg(volume)', 20)} AS ma FROM b)",
        tail="k0",
    ),
)
def i16(spark, sf):
    names = ["volume_ma", "relative_volume", "volume_spike", "volume_trend", "volume_delta"]
    return series(spark, sf, [*names, "volume_ratio", "tick_volume"])


@query(
    "i20_snapshot",
    with_sql(H1, bars_sql("h1"), smooth_sql("sm", "b", {**EMAS, "t": ("tr", 1 / 14), **GAINS}))
    + f"""SELECT symbol, {', '.join(f'{qs(f"arg_max({k}, idx)")} AS {k}' for k in EMAS)},
  {qs('arg_max(t, idx)')} AS atr, {qs('100 - 100 / (1 + arg_max(g, idx) / arg_max(l, idx))')} AS rsi
FROM sm GROUP BY 1""",
)
def i20(spark, sf):
    names = [*EMAS, "atr", "rsi"]
    bars = h1_bars(spark, sf)
    rows = indicators(bars, names, layout=fit_layout(bars))
    return snapshot(rows, names, ["symbol"]).select("symbol", *qcols(names))


@query("i00_all_indicators")
def all_indicators(spark, sf):
    """Every series at once over the supplier candles (checked piecewise by the i* queries)."""
    found = [indicators(b, layout=layout) for b, layout in supplier_bars(spark, sf)]
    rows = [f.select("symbol", "bar_idx", *INDICATORS) for f in found]
    return reduce(DataFrame.unionByName, rows)


# --------------------------------------------------------------------------- patterns

_PAT = {
    "doji": "bd <= 0.1 * r",
    "dragonfly_doji": "bd <= 0.1 * r AND dn >= 0.6 * r AND up <= 0.1 * r",
    "gravestone_doji": "bd <= 0.1 * r AND up >= 0.6 * r AND dn <= 0.1 * r",
    "hammer": "bd <= 0.35 * r AND dn >= 2 * greatest(bd, 1e-12) AND up <= 0.3 * bd + 0.1 * r",
    "inverted_hammer": "bd <= 0.35 * r AND up >= 2 * greatest(bd, 1e-12) AND dn <= 0.3 * bd + 0.1 * r",
    "shooting_star": "bd <= 0.35 * r AND up >= 2 * greatest(bd, 1e-12) AND dn <= 0.3 * bd + 0.1 * r "
    "AND c1 > o1",
    "bullish_engulfing": "c > o AND c1 < o1 AND c >= o1 AND o <= c1 AND bd > b1",
    "bearish_engulfing": "c < o AND c1 > o1 AND c <= o1 AND o >= c1 AND bd > b1",
    "bullish_harami": "c > o AND c1 < o1 AND o >= c1 AND c <= o1 AND bd < b1",
    "bearish_harami": "c < o AND c1 > o1 AND o <= c1 AND c >= o1 AND bd < b1",
    "piercing_line": "c > o AND c1 < o1 AND o < l1 AND c > (o1 + c1) / 2 AND c < o1",
    "dark_cloud_cover": "c < o AND c1 > o1 AND o > h1 AND c < (o1 + c1) / 2 AND c > o1",
    "morning_star": "c2 < o2 AND b2 > ab AND b1 < 0.3 * b2 AND c > o AND c > (o2 + c2) / 2",
    "evening_star": "c2 > o2 AND b2 > ab AND b1 < 0.3 * b2 AND c < o AND c < (o2 + c2) / 2",
    "three_white_soldiers": "c > o AND c1 > o1 AND c2 > o2 AND c > c1 AND c1 > c2 AND bd >= 0.6 * r",
    "three_black_crows": "c < o AND c1 < o1 AND c2 < o2 AND c < c1 AND c1 < c2 AND bd >= 0.6 * r",
    "inside_bar": "h <= h1 AND l >= l1",
    "outside_bar": "h > h1 AND l < l1",
    "bullish_pin_bar": "dn >= 0.66 * r AND up <= 0.15 * r",
    "bearish_pin_bar": "up >= 0.66 * r AND dn <= 0.15 * r",
    "bullish_marubozu": "c > o AND bd / r >= 0.95",
    "bearish_marubozu": "c < o AND bd / r >= 0.95",
    "spinning_top": "bd <= 0.35 * r AND up >= 0.25 * r AND dn >= 0.25 * r AND NOT bd <= 0.1 * r",
}
_DBL = {
    "0.1 ": "0.1::DOUBLE ", "0.6 ": "0.6::DOUBLE ", "0.35": "0.35::DOUBLE", "0.3 ": "0.3::DOUBLE ",
    "0.66": "0.66::DOUBLE", "0.15": "0.15::DOUBLE", "0.95": "0.95::DOUBLE", "0.25": "0.25::DOUBLE",
}


def _doubles(sql: str) -> str:
    for a, b in _DBL.items():
        sql = sql.replace(a, b)
    return sql


_BITS = ", ".join(
    f"CASE WHEN {_doubles(c)} THEN 1.0::DOUBLE ELSE 0.0 END AS {n}" for n, c in _PAT.items()
)


@query(
    "k_patterns",
    with_sql(
        D1,
        bars_sql("d1"),
        """k0 AS (SELECT symbol, idx, open AS o, high AS h, low AS l, close AS c, abs(close - open) AS bd,
    greatest(high - low, 1e-12) AS r, high - greatest(open, close) AS up, least(open, close) - low AS dn,
    lag(open) OVER w AS o1, lag(high) OVER w AS h1, lag(low) OVER w AS l1, lag(close) OVER w AS c1,
    lag(open, 2) OVER w AS o2, lag(close, 2) OVER w AS c2,
    lag(abs(close - open)) OVER w AS b1, lag(abs(close - open), 2) OVER w AS b2
  FROM b WINDOW w AS (PARTITION BY symbol ORDER BY idx))""",
        f"k1 AS (SELECT *, {roll('avg(bd)', 14)} AS ab FROM k0)",
        f"k2 AS (SELECT symbol, idx, {_BITS} FROM k1)",
    )
    + f"""SELECT *, greatest(bullish_harami, bearish_harami) AS harami,
  greatest(bullish_marubozu, bearish_marubozu) AS marubozu,
  greatest(bullish_pin_bar, bearish_pin_bar) AS pin_bar,
  {' + '.join(("hammer", "inverted_hammer", "dragonfly_doji", "bullish_engulfing", "morning_star",
               "piercing_line", "three_white_soldiers", "bullish_harami", "bullish_pin_bar",
               "bullish_marubozu"))} AS bullish_score,
  {' + '.join(("shooting_star", "gravestone_doji", "bearish_engulfing", "evening_star",
               "dark_cloud_cover", "three_black_crows", "bearish_harami", "bearish_pin_bar",
               "bearish_marubozu"))} AS bearish_score FROM k2""",
)
def k_patterns(spark, sf):
    t = patterns(d1_bars(spark, sf), LONG)
    return t.select(
        "symbol", C("bar_idx").alias("idx"), *PATTERNS, "bullish_score", "bearish_score"
    )


@query(
    "e22_spread",
    with_sql(
        H1,
        bars_sql("h1"),
        ATR,
        EFF,
        f"""s0 AS (SELECT *, {roll('avg(spread)', 20)} AS av, {roll('stddev_pop(spread)', 20)} AS sd,
    {roll('list(spread)', 20)} AS ls, coalesce(atr, med) AS at0 FROM a)""",
    )
    + f"""SELECT symbol, idx, {', '.join(
        f"CASE WHEN idx >= 19 THEN {e} ELSE 0.0 END AS spread_{n}" for n, e in (
            ('current', qs('spread')), ('rolling_avg', qs('av')),
            ('spike', 'CASE WHEN av > 0 AND spread / av >= 2 THEN 1.0::DOUBLE ELSE 0.0 END'),
            ('atr_ratio', qs('CASE WHEN at0 <> 0 THEN spread / at0 ELSE 0 END')),
            ('percentile', qs('len(list_filter(ls, lambda x: x <= spread)) / 20.0::DOUBLE')),
            ('volatility', qs('sd')),
            ('distance_from_avg', qs('CASE WHEN av <> 0 THEN (spread - av) / av ELSE 0 END')),
            ('valid', '1.0::DOUBLE')))} FROM s0""",
)
def e22(spark, sf):
    bars = h1_bars(spark, sf)
    t = imbalance.spread_stats(bars, layout=fit_layout(bars))
    return t.select(
        "symbol", C("bar_idx").alias("idx"), *qcols([f"spread_{n}" for n in imbalance.SPREAD])
    )
