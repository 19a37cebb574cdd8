"""Query registry, the candle tables derived from the given tables, and shared oracle SQL."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwick.config import DEFAULT_LAYOUT, Layout
from sparkwick.operators import scan as S
from sparkwick.sources.candles import DAY, candles_from_ticks
from sparkwick.sources.staging import stage

C = F.col
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TIE = 1.37e-9
YEAR = 365 * DAY


def query(name: str, oracle: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return keep


def q(c, digits: int = 6) -> Column:
    """Rounded for comparison; values on a rounding tie go up on both sides."""
    c = C(c) if isinstance(c, str) else c
    return F.when(F.abs(c) < 0.4 * 10.0**-digits, 0.0).otherwise(F.round(c + TIE, digits))


def qs(expr: str, digits: int = 6) -> str:
    """The SQL of ``q``."""
    return (
        f"(CASE WHEN abs({expr}) < {0.4 * 10.0**-digits:.10f} THEN 0.0::DOUBLE "
        f"ELSE round(({expr})::DOUBLE + {TIE}::DOUBLE, {digits}) END)"
    )


def qcols(names, digits: int = 6) -> list[Column]:
    return [q(n, digits).alias(n) for n in names]


def qsql(names, digits: int = 6) -> str:
    return ", ".join(f"{qs(n, digits)} AS {n}" for n in names)


# --------------------------------------------------------------------------- inputs


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf}/{name}.parquet")


def h1(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly candles of the event values, one series per event type."""
    ev = table(spark, sf, "events")
    bars = candles_from_ticks(
        ev, C("event_type"), "H1", C("ts"), C("value"), "hour", C("event_id"), users=C("user_id")
    )
    return bars.withColumn("spread", F.round(C("high") - C("low"), 2) / 10)


def unit_price() -> Column:
    return F.floor(C("l_extendedprice") * 100.0 / C("l_quantity")) / 100.0


def d1(spark: SparkSession, sf: str) -> DataFrame:
    """Daily candles of unit prices, one series per brand."""
    part = table(spark, sf, "part").select("p_partkey", "p_brand")
    items = table(spark, sf, "lineitem").join(part, C("l_partkey") == C("p_partkey"))
    tie = F.struct(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"
    )
    return candles_from_ticks(
        items, C("p_brand"), "D1", C("l_shipdate"), unit_price(), None, tie, volume=C("l_quantity")
    )


def supplier_days(items: DataFrame, parts: int = 0) -> DataFrame:
    """Daily candles per supplier: the number of series grows with the data."""
    tie = F.struct(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"
    )
    return candles_from_ticks(
        items,
        C("l_suppkey").cast("string"),
        "D1",
        C("l_shipdate"),
        unit_price(),
        None,
        tie,
        volume=C("l_quantity"),
        parts=parts,
    )


#: Ticks of one task where series are gathered whole.
TASK_TICKS = 1 << 18


def supplier_bars(spark: SparkSession, sf: str) -> list[tuple[DataFrame, Layout]]:
    """Indexed daily candles per supplier with the layout that fits them, short and long series.

    The ticks of a supplier are counted first, as no series has more bars than ticks. One shuffle
    of the ticks brings every short series to its task; it is combined, indexed and read there and
    nothing is stored. Longer ones (few, as each holds many ticks) are combined before the shuffle.
    """
    # an item without supplier or date has no place in a series
    items = table(spark, sf, "lineitem").dropna(subset=["l_suppkey", "l_shipdate"])
    sizes = items.groupBy("l_suppkey").count()
    is_long = C("count") > S.SHORT_SERIES
    n_long, ticks = sizes.agg(
        F.count_if(is_long), F.coalesce(F.sum(F.when(~is_long, C("count"))), F.lit(0))
    ).first()
    long = F.broadcast(sizes.where(is_long).select("l_suppkey"))
    out = []
    if ticks or not n_long:
        short = items.join(long, "l_suppkey", "left_anti") if n_long else items
        parts = max(spark.sparkContext.defaultParallelism, math.ceil(ticks / TASK_TICKS))
        layout = S.short_layout()
        out.append((S.index_bars(supplier_days(short, parts), layout), layout))
    if n_long:
        days = supplier_days(items.join(long, "l_suppkey", "left_semi"))
        bars = stage(S.index_bars(days, replace(DEFAULT_LAYOUT, keys=("symbol",)), 20 * YEAR))
        out.append((bars, S.fit_layout(bars)))
    return out


# chunks this small are exercised by the checks even on short series
LONG = Layout(chunk=256)


def h1_bars(spark: SparkSession, sf: str) -> DataFrame:
    return stage(S.index_bars(h1(spark, sf), span_seconds=YEAR))


def d1_bars(spark: SparkSession, sf: str) -> DataFrame:
    return stage(S.index_bars(d1(spark, sf), span_seconds=20 * YEAR))


# --------------------------------------------------------------------------- oracle SQL

H1 = """h1 AS MATERIALIZED (
  SELECT event_type AS symbol, date_trunc('hour', ts) AS ts,
    first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
    last(value ORDER BY ts, event_id) AS close, count(*)::DOUBLE AS volume,
    round(max(value) - min(value), 2) / 10::DOUBLE AS spread,
    count(DISTINCT user_id)::DOUBLE AS tick_volume
  FROM events GROUP BY 1, 2)"""
_ITEM_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity"
D1 = f"""d1 AS MATERIALIZED (
  SELECT symbol, ts, first(p ORDER BY {_ITEM_ORDER}) AS open, max(p) AS high, min(p) AS low,
    last(p ORDER BY {_ITEM_ORDER}) AS close, sum(l_quantity) AS volume,
    NULL::DOUBLE AS spread, count(*)::DOUBLE AS tick_volume
  FROM (SELECT p_brand AS symbol, l_shipdate AS ts,
          floor(l_extendedprice * 100.0::DOUBLE / l_quantity) / 100.0::DOUBLE AS p, *
        FROM lineitem JOIN part ON l_partkey = p_partkey)
  GROUP BY 1, 2)"""


def bars_sql(src: str) -> str:
    """Indexed bars ``b`` with previous values, true range and typical price."""
    return f"""b AS MATERIALIZED (
  SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr,
    (high + low + close) / 3.0::DOUBLE AS tp, close - pc AS delta,
    CASE WHEN pc <> 0 THEN (close - pc) / pc ELSE 0.0 END AS ret
  FROM (SELECT *, coalesce(lag(close) OVER w, close) AS pc,
          coalesce(lag(high) OVER w, high) AS ph, coalesce(lag(low) OVER w, low) AS pl,
          row_number() OVER w - 1 AS idx, count(*) OVER (PARTITION BY symbol) AS n
        FROM {src} WINDOW w AS (PARTITION BY symbol ORDER BY ts)))"""


def smooth_sql(name: str, src: str, terms: dict[str, tuple[str, float]]) -> str:
    """Sequential exponential smoothing: ``{out: (expression, alpha)}`` over ``src`` rows."""
    seed = ", ".join(f"({x})::DOUBLE AS {k}" for k, (x, _) in terms.items())
    step = ", ".join(
        f"{name}.{k} * {1.0 - a!r}::DOUBLE + ({x}) * {a!r}::DOUBLE" for k, (x, a) in terms.items()
    )
    return f"""{name} AS (
  SELECT symbol, idx, {seed} FROM {src} WHERE idx = 0
  UNION ALL
  SELECT {src}.symbol, {src}.idx, {step}
  FROM {name} JOIN {src} ON {src}.symbol = {name}.symbol AND {src}.idx = {name}.idx + 1)"""


def with_sql(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


ATR = smooth_sql("sm", "b", {"trs": ("tr", 1 / 14)})
# bars with the ATR, its fallback and the effective value
EFF = """a AS MATERIALIZED (
  SELECT b.*, CASE WHEN b.idx >= 13 THEN sm.trs END AS atr, m.med,
    CASE WHEN b.idx >= 13 AND sm.trs > 0 THEN sm.trs ELSE m.med END AS ae
  FROM b JOIN sm ON b.symbol = sm.symbol AND b.idx = sm.idx
  JOIN (SELECT symbol, CASE WHEN quantile_cont(high - low, 0.5) = 0 THEN 1.0::DOUBLE
          ELSE quantile_cont(high - low, 0.5) END AS med FROM b GROUP BY 1) m
    ON m.symbol = b.symbol)"""
NOW = """nw AS MATERIALIZED (
  SELECT symbol, max(n) AS n, arg_max(close, idx) AS lc, arg_max(ae, idx) AS atr_last,
    coalesce(arg_max(atr, CASE WHEN atr IS NOT NULL THEN idx END), max(med)) AS atr_now
  FROM a GROUP BY 1)"""
