"""The state of a series as of every bar: what its prefix up to the bar would show.

Nothing is computed per prefix. Swings, breaks, gaps and blocks are found once; each changes the
state at the bar from which it is known, and the state is carried forward:

* Trend and leg statistics depend on the last few swings. They are kept as lists of the last k
  events, an associative carry across chunks, and evaluated at the bar.
* A gap lives from its bar to the bar that fills it: counts are running sums of births and fills. The
  nearest open one is looked for among those alive in the bar's cell of bars; of gaps that stay open
  through the cell only those near enough to its closes to be nearest to any of them are kept.
* Order blocks have a greatest age, so a bounded join brings those of the bars before.
* Levels are islands of swing prices under a tolerance that moves with the ATR. Bars are taken in
  epochs: swings known before an epoch are merged once into price cells as narrow as its least
  tolerance, which no tolerance of the epoch would split, so there are as many as the price range
  has tolerances and not as many as swings. Later swings of the epoch join one by one; islands of
  cells and swings in price order, with the running top of what lies below, are the clusters.

Where there is no ATR yet, the median range of the first bars stands in for it, so no value depends
on later bars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwick.config import DEFAULT, DEFAULT_LAYOUT, AnalysisConfig, Layout
from sparkwick.functions.columns import flag, or_default, safe_divide, significant
from sparkwick.operators import features, imbalance, levels, structure, windowed
from sparkwick.operators import scan as S
from sparkwick.operators.indicators import indicators
from sparkwick.operators.windowed import swept_pools
from sparkwick.sources.staging import stage

C = F.col
#: Bars that share one list of candidate gaps.
CELL = 256
#: Bars that share one list of price cells.
EPOCH = 1024


def warm_range(bars: DataFrame, cfg: AnalysisConfig, layout: Layout) -> DataFrame:
    """Median range of the bars before the first ATR (1 for a flat start): a bounded group a series."""
    early = bars.where(C("bar_idx") < cfg.atr_period - 1)
    median = early.groupBy(*layout.keys).agg(F.percentile(C("high") - C("low"), 0.5).alias("_m"))
    return median.select(*layout.keys, F.when(C("_m") == 0.0, 1.0).otherwise(C("_m")).alias("warm_range"))


def _bucketed(ev: DataFrame, layout: Layout) -> tuple[DataFrame, str | None]:
    if layout.bounded:
        return ev, None
    return ev.withColumn("_eb", structure.event_bucket()), "_eb"


def swing_changes(sw: DataFrame, cfg: AnalysisConfig, layout: Layout) -> DataFrame:
    """What every bar that confirms swings adds to the state: lists of the last swings and legs."""
    keys, k = list(layout.keys), cfg.swing_window
    n = cfg.trend_swing_lookback
    ev, bucket = _bucketed(sw, layout)
    near = S.last_k(
        ev, [*keys, "kind"], ["bar_idx"], F.struct("bar_idx", "price", "prev_price"), n, "recent", bucket
    )
    high = C("kind") == "high"
    known = (C("bar_idx") + k).alias("bar_idx")
    kinds = near.groupBy(*keys, known).agg(
        F.max(F.when(high, C("recent"))).alias("highs"),
        F.max(F.when(~high, C("recent"))).alias("lows"),
        F.max(F.when(high & (C("prev_price") >= C("price")), C("bar_idx"))).alias("bull_turn"),
        F.max(F.when(~high & (C("prev_price") < C("price")), C("bar_idx"))).alias("bear_turn"),
        F.count_if(high).alias("n_high"),
        F.count_if(~high).alias("n_low"),
    )
    order = ["bar_idx", "side_order"]
    legs = S.scan(
        ev, keys, order, [S.Scan("_pp", "prev", C("price")), S.Scan("_pi", "prev", C("bar_idx"))], bucket
    ).where(C("_pp").isNotNull())
    leg = C("price") - C("_pp")
    legs = legs.withColumns({"len": F.abs(leg), "bars": C("bar_idx") - C("_pi"), "leg": leg})
    last = S.last_k(legs, keys, order, F.struct("len", "bars"), 3, "recent", bucket)
    last = last.groupBy(*keys, known).agg(
        F.max_by("recent", "side_order").alias("legs"), F.sum("len").alias("len"), F.count("*").alias("n_legs")
    )
    # an impulse is a leg up, or down in a downtrend: four lists serve both cases
    sides = F.when(leg > 0, F.array(F.lit("up"), F.lit("not_down"))).when(
        leg < 0, F.array(F.lit("down"), F.lit("not_up"))
    ).otherwise(F.array(F.lit("not_up"), F.lit("not_down")))
    sided = legs.withColumn("side", F.explode(sides))
    sided = S.last_k(sided, [*keys, "side"], order, C("len"), 3, "recent", bucket)
    sided = sided.groupBy(*keys, known).agg(
        *(F.max_by("recent", F.when(C("side") == s, C("side_order"))).alias(s) for s in SIDES)
    )
    return kinds.join(last, [*keys, "bar_idx"], "left").join(sided, [*keys, "bar_idx"], "left")


SIDES = ("up", "not_up", "down", "not_down")


def _mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(values) > 0, total / F.size(values))


def _slope(points: Column) -> Column:
    """Least-squares slope of price over position of a short list of swings."""
    x = F.transform(points, lambda p: p["bar_idx"].cast("double"))
    y = F.transform(points, lambda p: p["price"])
    mx, my = _mean(x), _mean(y)
    xy = F.aggregate(F.zip_with(x, y, lambda a, b: (a - mx) * (b - my)), F.lit(0.0), lambda a, v: a + v)
    xx = F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - mx) * (v - mx))
    return F.when(xx > 0, xy / xx)


def _trend_and_legs(t: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """``trend_*`` and ``micro_*`` from the carried lists."""
    n = cfg.trend_swing_lookback
    none = lambda c: F.coalesce(C(c), F.array().cast(dict(t.dtypes)[c]))
    t = t.withColumns({c: none(c) for c in ("highs", "lows", "legs", *SIDES)})
    newest = lambda c: F.slice(c, F.greatest(F.size(c) - n + 2, F.lit(1)), n - 1)
    up = lambda c: F.size(F.filter(newest(c), lambda s: s["price"] > s["prev_price"]))
    down = lambda c: F.size(F.filter(newest(c), lambda s: s["price"] < s["prev_price"]))
    t = t.withColumns(
        {
            "trend_higher_highs": up("highs"), "trend_higher_lows": up("lows"),
            "trend_lower_highs": down("highs"), "trend_lower_lows": down("lows"),
            "_points": F.concat("highs", "lows"),
        }
    )
    ups, downs = C("trend_higher_highs") + C("trend_higher_lows"), C("trend_lower_highs") + C("trend_lower_lows")
    t = t.withColumn("_score", safe_divide(ups - downs, (ups + downs).cast("double")))
    cut = cfg.sideways_threshold
    t = t.withColumns(
        {
            "_dir": F.when(C("_score") > cut, 1).when(C("_score") < -cut, -1).otherwise(0),
            "_slope": F.when(F.size("_points") >= 2, _slope(C("_points"))),
            "n_swings": C("n_high") + C("n_low"),
        }
    )
    tail = lambda c: F.element_at(C(c), -1)["bar_idx"]
    first = F.least("first_high", "first_low")
    anchor = (
        F.when(C("_dir") == 0, F.greatest(F.when(F.size("highs") > 0, tail("highs")), F.when(F.size("lows") > 0, tail("lows"))))
        .when(C("_dir") == 1, F.when(C("n_high") >= 2, F.coalesce("bull_turn", "first_high")).otherwise(first))
        .otherwise(F.when(C("n_low") >= 2, F.coalesce("bear_turn", "first_low")).otherwise(first))
    )
    moves = ups + downs
    trend = {
        "trend_direction": C("_dir"),
        "trend_strength": F.abs("_score"),
        "trend_duration_bars": F.when(C("n_swings") > 0, F.greatest(C("bar_idx") - anchor, F.lit(0))),
        "trend_momentum": safe_divide(C("_slope"), C("close")),
        "trend_valid": flag(moves > 0),
        "micro_valid": flag(C("n_swings") >= 3),
    }
    rising = C("_dir") >= 0
    imp = F.coalesce(_mean(F.when(rising, C("up")).otherwise(C("down"))), F.lit(0.0))
    cor = F.coalesce(_mean(F.when(rising, C("not_up")).otherwise(C("not_down"))), F.lit(0.0))
    nth = lambda i: F.get("legs", F.size("legs") - i)
    speed = lambda i: safe_divide(nth(i)["len"], nth(i)["bars"].cast("double"))
    back = safe_divide(nth(1)["len"], nth(2)["len"]) * 100.0
    micro = {
        "impulse_length": imp,
        "correction_length": cor,
        "impulse_ratio": safe_divide(imp, cor),
        "retracement_pct": F.least(back, F.lit(100.0)),
        "extension_pct": F.greatest(back - 100.0, F.lit(0.0)),
        "swing_velocity": speed(1),
        "swing_acceleration": speed(1) - speed(2),
        "time_between_swings": _mean(F.transform("legs", lambda x: x["bars"].cast("double"))),
        "average_swing_length": C("len") / C("n_legs"),
    }
    enough = C("n_legs") >= 2
    return t.withColumns(
        {
            **{k: or_default(v.cast("double")) for k, v in trend.items()},
            **{f"micro_{k}": or_default(F.when(enough, v)) for k, v in micro.items()},
            **{c: C(c).cast("double") for c in t.columns if c.startswith("trend_")},
        }
    )


def gap_lives(
    bars: DataFrame, warm: DataFrame, cfg: AnalysisConfig, layout: Layout
) -> DataFrame:
    """Every gap with its size in ATR and the bar that fills it (null while open)."""
    keys = list(layout.keys)
    w = S.bar_window(layout)
    extra = {"_h2": F.lag("high", 2).over(w), "_l2": F.lag("low", 2).over(w)}
    rows = indicators(bars, ["atr"], cfg, layout, extra=extra)
    rows = S.attach(rows, warm, keys, "bar_idx", layout.bounded)
    own = F.when(C("atr") > 0, C("atr")).otherwise(C("warm_range"))
    up, down = C("low") > C("_h2"), C("high") < C("_l2")
    side = lambda d, p, upper, lower, price: F.struct(
        F.lit(d).alias("direction"), F.lit(p).alias("side"), upper.alias("upper"), lower.alias("lower"),
        price.alias("price"),
    )
    g = rows.withColumn(
        "_g",
        F.when(up, side("bullish", "sell_side", C("low"), C("_h2"), C("_h2"))).when(
            down, side("bearish", "buy_side", C("_l2"), C("high"), C("_l2"))
        ),
    ).where(C("_g").isNotNull())
    size = C("_g")["upper"] - C("_g")["lower"]
    g = g.where(size >= own * cfg.fvg_min_atr).select(
        *keys, "bar_idx", C("bar_idx").alias("last_index"), C("bar_idx").alias("pid"), "_g.*",
        safe_divide(size, own).alias("size_atr"),
    )
    return stage(levels.first_beyond(bars, stage(g), layout, touching=True).drop("pid", "last_index", "side", "price"))


def nearest_gaps(gaps: DataFrame, at: DataFrame, layout: Layout) -> DataFrame:
    """The nearest open gap of each row of ``at`` (keys, bar_idx, close): ``gap`` (struct)."""
    keys = list(layout.keys)
    cell = F.floor(C("bar_idx") / CELL).alias("cell")
    asked = at.select(*keys, "bar_idx", "close", cell)
    cells = asked.groupBy(*keys, "cell").agg(
        F.min("close").alias("lo"), F.max("close").alias("hi"), F.max("bar_idx").alias("end"), F.min("bar_idx").alias("start")
    )
    ends = cells.groupBy(*keys).agg(F.max("cell").alias("last_cell"))
    alive = S.attach(gaps, ends, keys, "bar_idx", layout.bounded)
    until = F.least(F.coalesce(F.floor(C("hit_idx") / CELL), C("last_cell")), C("last_cell"))
    born = F.floor(C("bar_idx") / CELL)
    alive = alive.where(born <= until).withColumn("cell", F.explode(F.sequence(born, until)))
    alive = alive.drop("last_cell").withColumnRenamed("bar_idx", "born").join(cells, [*keys, "cell"])
    beyond = lambda e: F.greatest(C("lo") - C(e), C(e) - C("hi"), F.lit(0.0))
    most = lambda e: F.greatest(F.abs(C("lo") - C(e)), F.abs(C("hi") - C(e)))
    through = (C("born") <= C("start")) & (C("hit_idx").isNull() | (C("hit_idx") > C("end")))
    alive = alive.withColumns(
        {
            "_least": F.least(beyond("upper"), beyond("lower")),
            "_most": F.when(through, F.least(most("upper"), most("lower"))),
        }
    )
    bound = alive.groupBy(*keys, "cell").agg(F.min("_most").alias("_bound"))
    alive = alive.join(bound, [*keys, "cell"]).where(
        C("_bound").isNull() | (C("_least") <= C("_bound"))
    )
    met = asked.join(alive.drop("lo", "hi", "start", "end", "_least", "_most", "_bound"), [*keys, "cell"]).where(
        (C("born") <= C("bar_idx")) & (C("hit_idx").isNull() | (C("hit_idx") > C("bar_idx")))
    )
    edge = F.least(F.abs(C("close") - C("upper")), F.abs(C("close") - C("lower")))
    met = met.withColumn("edge", edge)
    order = F.struct("edge", "born", (C("direction") == "bearish").cast("int").alias("s"))
    return met.groupBy(*keys, "bar_idx").agg(
        F.min_by(F.struct("direction", "size_atr", "born", "edge"), order).alias("gap")
    )


def prefix_clusters(
    sw: DataFrame, decisions: DataFrame, tolerance: float, cfg: AnalysisConfig, layout: Layout
) -> DataFrame:
    """``levels.clusters`` of the swings known at each decision (keys, decision_idx, atr_now)."""
    keys = list(layout.keys)
    d = decisions.select(*keys, "decision_idx", "atr_now", F.floor(C("decision_idx") / EPOCH).alias("epoch"))
    epochs = d.groupBy(*keys, "epoch").agg(
        (F.min("atr_now") * tolerance).alias("wide"), F.min("decision_idx").alias("start")
    )
    ends = d.groupBy(*keys).agg(F.max("epoch").alias("last_epoch"))
    known = C("bar_idx") + cfg.swing_window
    ev = S.attach(sw, ends, keys, "bar_idx", layout.bounded).withColumn("known", known)
    ev = ev.where(F.floor(C("known") / EPOCH) <= C("last_epoch")).withColumn(
        "epoch", F.explode(F.sequence(F.floor(C("known") / EPOCH), C("last_epoch")))
    )
    ev = ev.join(epochs, [*keys, "epoch"])
    old = C("known") <= C("start")
    # a swing of the epoch itself is a cell of its own
    ev = ev.withColumns(
        {
            "_cell": F.when(old & (C("wide") > 0), F.floor(C("price") / C("wide"))),
            "_same": F.when(old & ~(C("wide") > 0), C("price")),
            "_own": F.when(~old, C("bar_idx")),
            "known": F.when(~old, C("known")),
        }
    )
    cells = ev.groupBy(*keys, "epoch", "kind", "_cell", "_same", "_own").agg(
        F.max("known").alias("known"),
        F.min("price").alias("lower"),
        F.max("price").alias("upper"),
        F.sum("price").alias("total"),
        F.count("*").alias("touches"),
        F.sum("strength").alias("strength"),
        F.min("bar_idx").alias("first_index"),
        F.max("bar_idx").alias("last_index"),
    )
    cells = cells.drop("_cell", "_same", "_own")
    t = d.join(cells, [*keys, "epoch"]).where(C("known").isNull() | (C("known") <= C("decision_idx")))
    part = [*keys, "decision_idx", "kind"]
    t = t.repartition(*part)
    w = Window.partitionBy(*part).orderBy("lower", "upper", "first_index")
    top = F.max("upper").over(w.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.coalesce((C("lower") - top > C("atr_now") * tolerance).cast("int"), F.lit(1))
    t = t.withColumn("_new", apart)
    t = t.withColumn("cluster", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = t.groupBy(*part, "cluster").agg(
        F.max("atr_now").alias("atr_now"),
        F.min("lower").alias("lower"),
        F.max("upper").alias("upper"),
        significant(F.sum("total") / F.sum("touches")).alias("center"),
        F.sum("touches").alias("touches"),
        F.sum("strength").alias("swing_strength"),
        F.min("first_index").alias("first_index"),
        F.max("last_index").alias("last_index"),
    )
    return out.withColumn("width", C("upper") - C("lower"))


def _block_rows(bars: DataFrame, cfg: AnalysisConfig, layout: Layout) -> DataFrame:
    w = S.bar_window(layout)
    df = S.extend(bars, layout)
    prev = F.coalesce(F.lag("close").over(w), C("close"))
    tr = F.greatest(C("high") - C("low"), F.abs(C("high") - prev), F.abs(C("low") - prev))
    df = windowed.ahead_of_blocks(df.withColumn("_tr", tr), cfg, w)
    df = S.recur(df, layout, [S.wilder("tr_s", C("_tr"), cfg.atr_period)])
    df = df.withColumn("next_tr", F.lead("tr_s").over(w))
    return S.core_rows(df).select(
        *layout.keys, "bar_idx", "open", "high", "low", "close", "highs", "lows", "next_open", "next_close",
        "next_tr", "tr_s", "atr_least",
    )


def state_features(
    bars: DataFrame,
    warmup: int = 300,
    step: int = 5,
    cfg: AnalysisConfig = DEFAULT,
    layout: Layout = DEFAULT_LAYOUT,
) -> DataFrame:
    """Features of every ``step``-th bar from ``warmup`` on, as of that bar.

    The whole feature vector, equal to what the series up to the bar alone gives (with the range of
    the first bars where that lacks an ATR).
    """
    keys = list(layout.keys)
    warm = stage(warm_range(bars, cfg, layout))
    rows = structure.swing_bars(bars, cfg, layout).drop("atr_eff")
    rows = S.attach(rows, warm, keys, "bar_idx", layout.bounded)
    rows = stage(rows.withColumn("atr_eff", F.when(C("atr") > 0, C("atr")).otherwise(C("warm_range"))))
    sw = stage(structure.swings_from(rows, layout))
    feats = features.series_features(bars, cfg, layout, rows=rows, sw=sw)
    feats = feats.join(rows.select(*keys, "bar_idx", "atr", "atr_eff", "warm_range"), [*keys, "bar_idx"])
    gaps = gap_lives(bars, warm, cfg, layout)
    born = gaps.groupBy(*keys, "bar_idx").agg(
        F.count_if(C("direction") == "bullish").alias("g_bull"), F.count_if(C("direction") == "bearish").alias("g_bear")
    )
    gone = gaps.where("hit_idx is not null").groupBy(*keys, C("hit_idx").alias("bar_idx")).agg(F.count("*").alias("g_filled"))
    changes = swing_changes(sw, cfg, layout)
    t = feats
    for other in (changes, born, gone):
        t = t.join(other, [*keys, "bar_idx"], "left")
    bucket = None
    if not layout.bounded:
        bucket = "_xb"
        t = t.withColumn("_xb", F.floor(C("bar_idx") / layout.chunk))
    sums = ("n_high", "n_low", "len", "n_legs", "g_bull", "g_bear", "g_filled")
    lists = ("highs", "lows", "legs", *SIDES, "bull_turn", "bear_turn")
    scans = [S.Scan(f"_a_{c}", "sum", F.coalesce(c, F.lit(0))) for c in sums]
    scans += [S.Scan(f"_a_{c}", "last", C(c)) for c in lists]
    t = S.scan(t, keys, ["bar_idx"], scans, bucket)
    t = t.drop(*sums, *lists, "_xb").withColumnsRenamed({f"_a_{c}": c for c in (*sums, *lists)})
    pick = (C("bar_idx") >= warmup) & ((C("bar_idx") - warmup) % step == 0)
    firsts = sw.groupBy(*keys).agg(
        F.min(F.when(C("kind") == "high", C("bar_idx"))).alias("first_high"),
        F.min(F.when(C("kind") == "low", C("bar_idx"))).alias("first_low"),
    )
    firsts = bars.select(*keys).distinct().join(firsts, keys, "left")
    t = S.attach(t.where(pick), firsts, keys, "bar_idx", layout.bounded)
    seen = lambda c: F.when(C(c) + cfg.swing_window <= C("bar_idx"), C(c))
    t = t.withColumns({c: seen(c) for c in ("first_high", "first_low")})
    t = stage(_trend_and_legs(t, cfg))

    decisions = t.select(
        *keys, C("bar_idx").alias("decision_idx"), C("warm_range").alias("median_w"), C("close").alias("last_close"),
        C("atr_eff").alias("atr_last"), F.coalesce("atr", C("warm_range")).alias("atr_now"),
        (C("bar_idx") + 1).alias("n_bars"),
    )
    decisions = stage(decisions)
    short = layout.per("decision_idx")
    zones = prefix_clusters(sw, decisions, cfg.zone_merge_atr, cfg, layout)
    sr = levels.nearest_zones(levels.zones(sw, decisions, cfg, short, found=zones), decisions, short)
    pools = prefix_clusters(sw, decisions, cfg.equal_level_atr, cfg, layout)
    pools = levels.pools(sw, decisions, cfg, short, found=pools)
    liq = levels.liquidity_summary(
        swept_pools(pools, bars, F.lit(0), cfg, layout), decisions, short
    )
    sr = sr.select(
        *keys, C("decision_idx").alias("bar_idx"), *(C(n).alias(f"sr_{n}") for n in features.ZONE),
        flag(C("has_support")).alias("sr_support_valid"), flag(C("has_resistance")).alias("sr_resistance_valid"),
    )
    liq = liq.select(*keys, C("decision_idx").alias("bar_idx"), *(C(n).alias(f"liq_{n}") for n in features.LIQUIDITY))
    found = windowed.blocks(_block_rows(bars, cfg, layout), decisions, cfg.ob_max_age + 1, cfg, layout, whole=True)
    ob = imbalance.block_summary(found, decisions, short)
    ob = ob.select(*keys, C("decision_idx").alias("bar_idx"), *(C(n).alias(f"ob_{n}") for n in features.BLOCK))
    near = nearest_gaps(gaps, t, layout)
    for other in (sr, liq, ob):
        t = t.join(other, [*keys, "bar_idx"], "left")
    t = t.join(near, [*keys, "bar_idx"], "left")
    gap = C("gap")
    sign = F.when(gap["direction"] == "bullish", 1.0).when(gap.isNotNull(), -1.0)
    fvg = {
        "bullish_count": C("g_bull"),
        "bearish_count": C("g_bear"),
        "unfilled_count": C("g_bull") + C("g_bear") - C("g_filled"),
        "nearest_direction": sign,
        "nearest_size_atr": gap["size_atr"],
        "nearest_age": C("bar_idx") - gap["born"],
        "distance_to_nearest": safe_divide(gap["edge"], C("atr_eff"), None),
    }
    t = t.withColumns({f"fvg_{k}": or_default(v.cast("double")) for k, v in fvg.items()})
    passed = [c for c in bars.columns if c in t.columns]
    return t.select(*passed, *features.feature_names("union"))
