"""Reading, building, cleaning and writing candle tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkwick.config import SERIES_KEYS
from sparkwick.functions.columns import epoch_us
from sparkwick.operators.scan import Scan, attach, scan, time_bucket

PRICES = ("open", "high", "low", "close")
REQUIRED = ("ts", *PRICES, "volume")
OPTIONAL = ("spread", "tick_volume")
CANDLE_SCHEMA = T.StructType(
    [T.StructField(k, T.StringType()) for k in SERIES_KEYS]
    + [T.StructField("ts", T.TimestampType())]
    + [T.StructField(c, T.DoubleType()) for c in (*PRICES, "volume", *OPTIONAL)]
)
DAY = 86400


class CandleError(ValueError):
    """The input is not a usable candle table."""


# --------------------------------------------------------------------------- sources


def read_candles(
    spark: SparkSession, path: str, fmt: str | None = None, columns: dict[str, str] | None = None
) -> DataFrame:
    """Read CSV or Parquet candles; ``columns`` renames the source's columns."""
    fmt = fmt or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if fmt == "csv":
        text = T.StructType([T.StructField(f.name, T.StringType()) for f in CANDLE_SCHEMA])
        # permissive strings: conform() decides what is bad, so no row is lost silently
        df = spark.read.option("header", True).schema(_renamed(text, columns)).csv(path)
    elif fmt in ("parquet", "pq"):
        df = spark.read.parquet(path)
    else:
        raise CandleError(f"unsupported format {fmt!r}: use csv or parquet")
    for source, target in (columns or {}).items():
        df = df.withColumnRenamed(source, target)
    return df


def _renamed(schema: T.StructType, columns: dict[str, str] | None) -> T.StructType:
    back = {t: s for s, t in (columns or {}).items()}
    return T.StructType([T.StructField(back.get(f.name, f.name), f.dataType) for f in schema])


def from_rows(spark: SparkSession, rows, symbol: str = "X", timeframe: str = "M5") -> DataFrame:
    """Candles from (ts, open, high, low, close, volume[, spread, tick_volume]) tuples, for tests."""
    full = [(symbol, timeframe, *r, *([None] * (8 - len(r)))) for r in rows]
    return spark.createDataFrame(full, CANDLE_SCHEMA)


def candles_from_ticks(
    ticks: DataFrame,
    symbol: Column,
    timeframe: str,
    ts: Column,
    price: Column,
    step: str | None,
    tie_break: Column,
    volume: Column | None = None,
    users: Column | None = None,
    spread: Column | None = None,
    parts: int = 0,
) -> DataFrame:
    """OHLCV bars per symbol and time step.

    Every aggregate combines on the map side, so a symbol or a bar that holds most of the ticks
    costs no more than any other. ``tie_break`` makes first and last tick deterministic.

    ``parts`` is for series known to be short: their ticks are shuffled as they are by symbol into
    so many tasks and combined there. A partial bar is wider than a tick, and every later step by
    series finds the bars in place.
    """
    bar = F.date_trunc(step, ts) if step else ts
    if parts:
        ticks = ticks.repartition(parts, symbol)
    src = ticks.select(
        symbol.alias("symbol"),
        bar.cast("timestamp").alias("ts"),
        price.cast("double").alias("_p"),
        F.struct(ts.alias("t"), tie_break.alias("k")).alias("_o"),
        (volume if volume is not None else F.lit(1)).cast("double").alias("_v"),
        *([users.alias("_u")] if users is not None else []),
    )
    aggs = [
        F.min_by("_p", "_o").alias("open"),
        F.max("_p").alias("high"),
        F.min("_p").alias("low"),
        F.max_by("_p", "_o").alias("close"),
        F.sum("_v").alias("volume"),
    ]
    if users is None:
        tick = F.count("*").cast("double")
    else:
        # two-step distinct: one row per user of a bar first, so a hot bar is spread over tasks
        src = src.groupBy("symbol", "ts", "_u").agg(
            F.min_by(F.struct("_p", "_o"), "_o").alias("_first"),
            F.max_by(F.struct("_p", "_o"), "_o").alias("_last"),
            F.max("_p").alias("_hi"),
            F.min("_p").alias("_lo"),
            F.sum("_v").alias("_v"),
        )
        aggs = [
            F.min_by("_first._p", "_first._o").alias("open"),
            F.max("_hi").alias("high"),
            F.min("_lo").alias("low"),
            F.max_by("_last._p", "_last._o").alias("close"),
            F.sum("_v").alias("volume"),
        ]
        tick = F.count("_u").cast("double")
    bars = src.groupBy("symbol", "ts").agg(*aggs, tick.alias("tick_volume"))
    wide = spread if spread is not None else F.lit(None)
    return bars.select(
        "symbol",
        F.lit(timeframe).alias("timeframe"),
        "ts",
        *PRICES,
        "volume",
        wide.cast("double").alias("spread"),
        "tick_volume",
    )


def closed_only(candles: DataFrame, now: Column, step_seconds: int) -> DataFrame:
    """Drop the bar that is still forming at ``now``."""
    end_us = epoch_us(F.col("ts")) + F.lit(step_seconds * 1_000_000)
    return candles.where(end_us <= epoch_us(now))


# --------------------------------------------------------------------------- validation


def require_columns(df: DataFrame) -> DataFrame:
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise CandleError(f"missing columns: {missing}")
    return df


def long_enough(df: DataFrame, keys=SERIES_KEYS, at_least: int = 3) -> DataFrame:
    """Keep series with enough candles."""
    sizes = df.groupBy(*keys).count().where(F.col("count") >= at_least).drop("count")
    return df.join(sizes, list(keys), "left_semi")


def conform(df: DataFrame) -> DataFrame:
    """Cast to the candle schema; ``bad_prices`` marks rows whose prices are not numbers."""
    require_columns(df)
    as_num = lambda c: F.expr(f"try_cast(`{c}` AS DOUBLE)")
    clean = lambda c: F.when(~F.isnan(as_num(c)), as_num(c))
    casts = {c: clean(c) for c in (*PRICES, "volume", *OPTIONAL) if c in df.columns}
    casts["volume"] = F.coalesce(casts["volume"], F.lit(0.0))
    df = df.withColumns({**casts, "ts": F.expr("try_cast(ts AS TIMESTAMP)")})
    for c in OPTIONAL:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("double"))
    bad = F.col("ts").isNull()
    for c in PRICES:
        bad = bad | F.col(c).isNull()
    return df.withColumn("bad_prices", bad)


def split_bad(df: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(usable rows, quarantined rows); ``strict`` raises when anything is quarantined."""
    marked = conform(df)
    bad = marked.where("bad_prices").drop("bad_prices")
    if strict and not bad.isEmpty():
        raise CandleError("some price or timestamp is missing or not a number")
    return marked.where("NOT bad_prices").drop("bad_prices"), bad


def dedup_last(df: DataFrame, seq: str = "ingest_seq", keys=SERIES_KEYS) -> DataFrame:
    """One candle per timestamp: the one ingested last.

    An aggregate, not a window: copies of one timestamp are combined before the shuffle.
    """
    rest = [c for c in df.columns if c not in (*keys, "ts")]
    last = df.groupBy(*keys, "ts").agg(F.max_by(F.struct(*rest), F.col(seq)).alias("r"))
    return last.select(*keys, "ts", "r.*").drop(seq)


GEOMETRY_RULES = {
    "high_below_low": lambda: F.col("high") < F.col("low"),
    "body_outside_range": lambda: (F.col("high") < F.greatest("open", "close"))
    | (F.col("low") > F.least("open", "close")),
    "non_positive_price": lambda: F.least(*PRICES) <= 0,
}


def geometry_report(df: DataFrame, keys=SERIES_KEYS) -> DataFrame:
    """Rows breaking each geometry rule, per series."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("n_rows"),
        *[F.count_if(rule()).alias(name) for name, rule in GEOMETRY_RULES.items()],
    )


def assert_geometry(df: DataFrame) -> DataFrame:
    """Raise when a candle is impossible, else return the input."""
    bad = F.lit(False)
    for rule in GEOMETRY_RULES.values():
        bad = bad | rule()
    found = df.where(bad).limit(1).collect()
    if found:
        raise CandleError(f"impossible candle: {found[0]}")
    return df


# --------------------------------------------------------------------------- gaps


def with_steps(df: DataFrame, keys=SERIES_KEYS, span_seconds: int = 30 * DAY) -> DataFrame:
    """Add ``step_us``, the microseconds since the previous row of the series in time order."""
    df = df.withColumns(
        {"_us": epoch_us(F.col("ts")), "_tb": time_bucket(F.col("ts"), span_seconds)}
    )
    df = scan(df, keys, ["_us"], [Scan("_prev_us", "prev", F.col("_us"))], bucket="_tb")
    return df.withColumn("step_us", F.col("_us") - F.col("_prev_us")).drop("_prev_us", "_tb")


def modal_step(stepped: DataFrame, keys=SERIES_KEYS) -> DataFrame:
    """The most frequent step per series (the shortest one on ties) and the series' first bar."""
    counts = stepped.groupBy(*keys, "step_us").agg(
        F.count("*").alias("n"), F.min("_us").alias("lo")
    )
    best = F.max_by(
        "step_us", F.when(F.col("step_us").isNotNull(), F.struct("n", (-F.col("step_us")).alias("s")))
    )
    return counts.groupBy(*keys).agg(best.alias("modal_us"), F.min("lo").alias("first_us"))


def fill_gaps(df: DataFrame, keys=SERIES_KEYS, span_seconds: int = 30 * DAY) -> DataFrame:
    """Regular grid at the modal step: missing bars repeat the previous close with zero volume.

    Rows off the grid are dropped, as on a reindex. Each bar emits the missing bars that follow
    it, so nothing has to be joined or gathered per series.
    """
    stepped = with_steps(df, keys, span_seconds)
    step = modal_step(stepped, keys)
    grid = attach(stepped.drop("step_us"), step, keys, "_us")
    usable = F.col("modal_us") > 0
    on_grid = ~usable | ((F.col("_us") - F.col("first_us")) % F.col("modal_us") == 0)
    grid = grid.where(F.coalesce(on_grid, F.lit(True)))
    grid = grid.withColumn("_tb", time_bucket(F.col("ts"), span_seconds))
    scans = [Scan("_next_us", "next", F.col("_us"))]
    scans += [Scan(f"_ff_{c}", "last", F.col(c)) for c in OPTIONAL]
    grid = scan(grid, keys, ["_us"], scans, bucket="_tb")
    missing = F.coalesce(
        F.when(usable, F.floor((F.col("_next_us") - F.col("_us")) / F.col("modal_us")) - 1),
        F.lit(0),
    ).cast("long")
    # two explodes: a very long gap never becomes one huge array
    block = 4096
    grid = grid.withColumn("_missing", missing)
    grid = grid.withColumn("_b", F.explode(F.sequence(F.lit(0), F.floor(F.col("_missing") / block))))
    lo = F.col("_b") * block
    hi = F.least(F.col("_missing"), lo + block - 1)
    grid = grid.withColumn("_k", F.explode(F.sequence(lo, hi)))
    filled = F.col("_k") > 0
    out = {c: F.when(filled, F.col("close")).otherwise(F.col(c)) for c in PRICES}
    out["volume"] = F.when(filled, 0.0).otherwise(F.col("volume"))
    out |= {c: F.col(f"_ff_{c}") for c in OPTIONAL}
    at = F.col("_us") + F.col("_k") * F.coalesce(F.col("modal_us"), F.lit(0))
    out["ts"] = F.when(filled, F.timestamp_micros(at)).otherwise(F.col("ts").cast("timestamp"))
    named = [out[c].alias(c) if c in out else F.col(c) for c in df.columns]
    return grid.select(*named, filled.alias("is_filled"))


def audit(df: DataFrame, seq: str, keys=SERIES_KEYS, span_seconds: int = 30 * DAY) -> DataFrame:
    """Input audit in ingest order: duplicates, order, and gaps longer than the modal step.

    Like the check it mirrors, steps are taken between consecutively *ingested* rows.
    """
    us = epoch_us(F.col("ts"))
    rows = df.select(*keys, F.col(seq).alias("_seq"), us.alias("_us"))
    rows = rows.withColumn("_sb", F.floor(F.col("_seq") / 65536))
    rows = scan(rows, keys, ["_seq"], [Scan("_prev", "prev", F.col("_us"))], bucket="_sb")
    rows = rows.withColumn("step_us", F.col("_us") - F.col("_prev"))
    step = modal_step(rows, keys)
    per_ts = rows.groupBy(*keys, "_us").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("step_us") < 0).alias("back"),
    )
    dups = per_ts.groupBy(*keys).agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.col("n") - 1).alias("duplicate_timestamps"),
        (F.sum("back") > 0).alias("is_unsorted"),
    )
    gaps = (
        attach(rows, step, keys, "_us")
        .groupBy(*keys, "modal_us")
        .agg(
            F.count_if(
                (F.col("modal_us") > 0) & (F.col("step_us") > F.col("modal_us"))
            ).alias("gap_count"),
            F.count("step_us").alias("n_steps"),
        )
    )
    return dups.join(gaps, list(keys)).select(
        *keys,
        "n_rows",
        "duplicate_timestamps",
        "is_unsorted",
        F.coalesce(F.col("modal_us") / 1e6, F.lit(0.0)).alias("modal_step_seconds"),
        F.when(F.col("n_steps") >= 2, F.col("gap_count")).otherwise(0).alias("gap_count"),
    )


# --------------------------------------------------------------------------- sinks


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "error") -> None:
    """Write a flat table partitioned by series."""
    writer = df.write.mode(mode).partitionBy(*[k for k in SERIES_KEYS if k in df.columns])
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise CandleError(f"unsupported format {fmt!r}: use csv or parquet")


def load_series(
    df: DataFrame, seq: str | None = None, fill: bool = False, strict: bool = True
) -> DataFrame:
    """The usual way in: conform, keep the last copy of each bar, check, optionally fill gaps.

    ``strict`` raises CandleError on unreadable or impossible rows and on series of fewer than
    three candles; otherwise such rows and series are left out (``split_bad`` and
    ``geometry_report`` show which). Without ``seq`` the stored row order decides which copy of a
    bar is the last.
    """
    if not seq:
        seq, df = "_row", df.withColumn("_row", F.monotonically_increasing_id())
    good, _ = split_bad(df, strict)
    good = dedup_last(good, seq)
    if strict:
        good = assert_geometry(good)
        short = good.groupBy(*SERIES_KEYS).count().where("count < 3").limit(1).collect()
        if short:
            raise CandleError(f"fewer than three candles: {short[0]}")
    else:
        for rule in GEOMETRY_RULES.values():
            good = good.where(~rule())
        good = long_enough(good)
    if fill:
        good = fill_gaps(good).drop("is_filled")
    return good
