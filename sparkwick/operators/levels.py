"""Price levels from swings: support/resistance zones, liquidity pools and their sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwick.config import DEFAULT, DEFAULT_LAYOUT, AnalysisConfig, Layout
from sparkwick.functions.columns import safe_divide, significant
from sparkwick.operators import scan as S
from sparkwick.operators.structure import _latest
from sparkwick.sources.staging import stage

C = F.col
CELL_BUCKET = 4096


def clusters(
    swing_events: DataFrame, now: DataFrame, tolerance: float, layout: Layout = DEFAULT_LAYOUT
) -> DataFrame:
    """Single-link clusters of swing prices per series and kind.

    Prices within one tolerance-wide cell always belong together, so swings are first combined
    per cell (map-side); only the cells are put in price order and split where the gap to the
    cell below is wider than the tolerance.
    """
    keys = [*layout.keys, "kind"]
    facts = now.select(*layout.keys, "atr_now")
    ev = S.attach(swing_events, facts, layout.keys, "bar_idx", layout.bounded)
    tol = C("atr_now") * tolerance
    ev = ev.withColumn("_cell", F.when(tol > 0, F.floor(C("price") / tol)))
    # without a tolerance only equal prices belong together
    part = [*keys, "_cell", "_same"]
    ev = ev.withColumn("_same", F.when(C("_cell").isNull(), C("price")))
    cell = ev.groupBy(*part).agg(
        F.max("atr_now").alias("atr_now"),
        F.min("price").alias("lower"),
        F.max("price").alias("upper"),
        F.sum("price").alias("_sum"),
        F.count("*").alias("touches"),
        F.sum("strength").alias("_strength"),
        F.min("bar_idx").alias("first_index"),
        F.max("bar_idx").alias("last_index"),
    )
    bucket = None
    if not layout.bounded:
        bucket = "_cb"
        cell = stage(cell.withColumn("_cb", F.floor(F.coalesce("_cell", F.lit(0)) / CELL_BUCKET)))
    cell = S.scan(cell, keys, ["lower"], [S.Scan("_below", "prev", C("upper"))], bucket)
    gap = C("lower") - C("_below") > C("atr_now") * tolerance
    cell = cell.withColumn("_new", F.coalesce(gap.cast("int"), F.lit(1)))
    cell = S.scan(cell, keys, ["lower"], [S.Scan("cluster", "sum", C("_new"))], bucket)
    out = cell.groupBy(*keys, "cluster").agg(
        F.max("atr_now").alias("atr_now"),
        F.min("lower").alias("lower"),
        F.max("upper").alias("upper"),
        # a bar that just touches the level must not pierce it by the order of the sum
        significant(F.sum("_sum") / F.sum("touches")).alias("center"),
        F.sum("touches").alias("touches"),
        F.sum("_strength").alias("swing_strength"),
        F.min("first_index").alias("first_index"),
        F.max("last_index").alias("last_index"),
    )
    return out.withColumn("width", C("upper") - C("lower"))


# --------------------------------------------------------------------------- zones


def zones(
    swing_events: DataFrame,
    now: DataFrame,
    cfg: AnalysisConfig = DEFAULT,
    layout: Layout = DEFAULT_LAYOUT,
    found: DataFrame | None = None,
) -> DataFrame:
    """The strongest support and resistance zones per series (a top-k per side).

    ``found`` are clusters made elsewhere; else those of ``swing_events``.
    """
    keys = list(layout.keys)
    z = found if found is not None else clusters(swing_events, now, cfg.zone_merge_atr, layout)
    z = z.join(now.select(*keys, "n_bars", "last_close"), keys)
    recency = 0.5 + 0.5 * (C("last_index") / F.greatest(C("n_bars") - 1, F.lit(1)))
    z = z.withColumns(
        {
            "strength": (C("touches") + C("swing_strength") * 0.25) * recency,
            "side": F.when(C("kind") == "high", "resistance").otherwise("support"),
        }
    )
    # equal strengths keep their price order
    z = z.withColumn("_low_first", -C("center"))
    z = _latest(z, [*keys, "side"], ["strength", "_low_first"], cfg.max_zones, "rank")
    return z.drop("_low_first", "kind", "cluster", "swing_strength", "first_index")


def nearest_zones(zone_table: DataFrame, now: DataFrame, layout: Layout = DEFAULT_LAYOUT):
    """Zone counts and the nearest zone on each side (any zone when none is on that side)."""
    keys = list(layout.keys)
    gap = F.abs(C("center") - C("last_close"))
    proper = F.when(C("side") == "support", C("center") <= C("last_close")).otherwise(
        C("center") >= C("last_close")
    )
    order = F.struct(F.when(proper, 0).otherwise(1).alias("o"), gap.alias("g"), C("rank"))
    facts = F.struct("center", "strength", "touches", "width")
    pick = lambda side: F.min_by(facts, F.when(C("side") == side, order))
    agg = zone_table.groupBy(*keys).agg(
        F.count_if(C("side") == "support").alias("_ns"),
        F.count_if(C("side") == "resistance").alias("_nr"),
        pick("support").alias("_s"),
        pick("resistance").alias("_r"),
    )
    t = now.select(*keys, "atr_now", "last_close").join(agg, keys, "left")
    zero = lambda x: F.coalesce(x.cast("double"), F.lit(0.0))
    side = lambda e, name: {
        f"nearest_{name}_{f}": zero(C(e)[f]) for f in ("strength", "touches", "width")
    }
    out = {
        "support_zone_count": zero(C("_ns")),
        "resistance_zone_count": zero(C("_nr")),
        **side("_s", "support"),
        **side("_r", "resistance"),
        "distance_to_support": zero(
            safe_divide(C("last_close") - C("_s")["center"], C("atr_now"), None)
        ),
        "distance_to_resistance": zero(
            safe_divide(C("_r")["center"] - C("last_close"), C("atr_now"), None)
        ),
        "has_support": C("_s").isNotNull(),
        "has_resistance": C("_r").isNotNull(),
    }
    return t.select(*keys, *[v.alias(k) for k, v in out.items()])


# --------------------------------------------------------------------------- pools


def pools(
    swing_events: DataFrame,
    now: DataFrame,
    cfg: AnalysisConfig = DEFAULT,
    layout: Layout = DEFAULT_LAYOUT,
    found: DataFrame | None = None,
) -> DataFrame:
    """Levels touched at least twice within a tight tolerance (``found``: as for ``zones``)."""
    t = found if found is not None else clusters(swing_events, now, cfg.equal_level_atr, layout)
    t = t.where(C("touches") >= 2)
    tol = C("atr_now") * cfg.equal_level_atr
    tight = F.when(tol > 0, 1.0 - F.least(C("width") / tol, F.lit(1.0)) * 0.5).otherwise(1.0)
    return t.select(
        *layout.keys,
        F.when(C("kind") == "high", "buy_side").otherwise("sell_side").alias("side"),
        "cluster",
        C("center").alias("price"),
        "touches",
        (C("touches") * tight).alias("strength"),
        "first_index",
        "last_index",
        "atr_now",
    )


#: Children of a node of the bar tree; its depth follows from the longest series.
RADIX = 1024


def first_beyond(
    bars: DataFrame, probes: DataFrame, layout: Layout = DEFAULT_LAYOUT, touching: bool = False
) -> DataFrame:
    """For each probe the first bar after ``last_index`` that pierces (or touches) its price.

    ``probes`` needs the series keys, ``pid``, ``side``, ``price`` and ``last_index``; adds
    ``hit_idx`` (NULL when no bar does).

    A bar tree answers it with equi-joins only: a node holds the extremes of its ``RADIX`` children
    and there are as many levels as the longest series needs.
    Climbing joins each probe to the nodes above its start (one per level) and finds the lowest
    one with a piercing child to the right; descending follows that child down.
    """
    keys = list(layout.keys)
    # the signed extreme makes both sides the same search: largest high, or largest -low
    ext = bars.select(
        *keys,
        C("bar_idx").alias("node"),
        F.explode(
            F.array(
                F.struct(F.lit("buy_side").alias("side"), C("high").alias("x")),
                F.struct(F.lit("sell_side").alias("side"), (-C("low")).alias("x")),
            )
        ).alias("e"),
    ).select(*keys, "node", "e.*")
    # only the sides and series that are probed
    ext = ext.join(probes.select(*keys, "side").distinct(), [*keys, "side"], "left_semi")
    last = bars.agg(F.max("bar_idx")).first()[0] or 0
    depth = 1
    while RADIX**depth <= last:
        depth += 1
    levels = []
    for lv in range(depth):
        kids = ext.withColumns(
            {"slot": F.pmod(C("node"), F.lit(RADIX)), "parent": F.floor(C("node") / RADIX)}
        )
        ext = kids.groupBy(*keys, "side", C("parent").alias("node")).agg(
            F.sort_array(F.collect_list(F.struct("slot", "x"))).alias("kids")
        )
        ext = stage(ext)
        levels.append(ext.withColumn("lv", F.lit(lv)))
        ext = ext.select(
            *keys, "side", "node", F.array_max(F.transform("kids", lambda k: k["x"])).alias("x")
        )
    tree = levels[0]
    for t in levels[1:]:
        tree = tree.unionByName(t)
    target = F.when(C("side") == "buy_side", C("price")).otherwise(-C("price"))
    base = probes.select(*keys, "pid", "side", "last_index", target.alias("t"))
    climb = base.withColumn("lv", F.explode(F.array(*[F.lit(i) for i in range(depth)])))
    span = F.pow(F.lit(RADIX), C("lv") + 1).cast("long")
    own_slot = F.floor(F.pmod(C("last_index"), span) / (span / RADIX).cast("long"))
    climb = climb.withColumns(
        {"node": F.floor(C("last_index") / span), "own": own_slot.cast("long")}
    )
    climb = climb.join(tree, [*keys, "side", "lv", "node"])

    def right_child(after: Column) -> Column:
        beyond = lambda x: (x >= C("t")) if touching else (x > C("t"))
        hits = F.filter("kids", lambda k: (k["slot"] > after) & beyond(k["x"]))
        return F.get(hits, F.lit(0))["slot"]

    climb = climb.withColumn("slot", right_child(C("own"))).where(C("slot").isNotNull())
    found = climb.groupBy(*keys, "side", "pid").agg(
        F.first("t").alias("t"),
        F.min_by(F.struct("lv", (C("node") * RADIX + C("slot")).alias("node")), "lv").alias("f"),
    )
    at = found.select(*keys, "side", "pid", "t", "f.lv", "f.node")
    for lv in range(depth - 1, 0, -1):
        nodes = levels[lv - 1].drop("lv").withColumn("lv", F.lit(lv))
        down = at.join(nodes, [*keys, "side", "lv", "node"], "left")
        step = down["kids"].isNotNull()
        at = down.select(
            *keys,
            "side",
            "pid",
            "t",
            F.when(step, C("node") * RADIX + right_child(F.lit(-1)))
            .otherwise(C("node"))
            .alias("node"),
            F.when(step, C("lv") - 1).otherwise(C("lv")).alias("lv"),
        )
    hit = at.select(*keys, "side", "pid", C("node").alias("hit_idx"))
    return probes.join(hit, [*keys, "side", "pid"], "left")


def sweeps(
    bars: DataFrame,
    pool_table: DataFrame,
    cfg: AnalysisConfig = DEFAULT,
    layout: Layout = DEFAULT_LAYOUT,
) -> DataFrame:
    """Pools with their first piercing bar; ``is_sweep`` when it closes back far enough."""
    keys = list(layout.keys)
    if layout.bounded:
        later = bars.select(*keys, "bar_idx", "ts", "high", "low", "close")
        cand = pool_table.join(later, keys).where(
            (C("bar_idx") > C("last_index"))
            & F.when(C("side") == "buy_side", C("high") > C("price")).otherwise(
                C("low") < C("price")
            )
        )
        hit = cand.groupBy(*keys, "side", "cluster").agg(
            F.min_by(F.struct("bar_idx", "ts", "high", "low", "close"), "bar_idx").alias("h")
        )
        t = pool_table.join(hit, [*keys, "side", "cluster"], "left")
        t = t.select(*pool_table.columns, "h.*").withColumnRenamed("bar_idx", "hit_idx")
    else:
        pool_table = stage(pool_table)
        t = first_beyond(bars, pool_table.withColumn("pid", C("cluster")), layout).drop("pid")
        at = bars.select(
            *keys, C("bar_idx").alias("hit_idx"), "ts", "high", "low", "close"
        )
        t = t.join(at, [*keys, "hit_idx"], "left")
    return graded(t, pool_table.columns, cfg)


def graded(t: DataFrame, columns, cfg: AnalysisConfig = DEFAULT) -> DataFrame:
    """Pools joined with their piercing bar: how far it went and whether it closed back."""
    buy = C("side") == "buy_side"
    depth = F.when(buy, C("high") - C("price")).otherwise(C("price") - C("low"))
    give = (1.0 - cfg.sweep_close_back_ratio) * depth
    back = F.when(buy, C("close") <= C("price") + give).otherwise(C("close") >= C("price") - give)
    return t.select(
        *columns,
        "hit_idx",
        "ts",
        C("hit_idx").isNotNull().alias("swept"),
        F.coalesce(back & (depth > 0), F.lit(False)).alias("is_sweep"),
        F.when(buy, "above").otherwise("below").alias("direction"),
        safe_divide(depth, C("atr_now"), None).alias("size"),
    )


def liquidity_summary(
    swept_pools: DataFrame, now: DataFrame, layout: Layout = DEFAULT_LAYOUT
) -> DataFrame:
    """Open liquidity around the last close, touch counts and the last sweep."""
    keys = list(layout.keys)
    t = swept_pools.join(now.select(*keys, "last_close"), keys)
    buy, sell = C("side") == "buy_side", C("side") == "sell_side"
    open_ = ~C("swept")
    # ties on the bar: sell-side pools come later, then higher prices
    order = F.struct("hit_idx", sell.cast("int").alias("s"), "cluster")
    agg = t.groupBy(*keys).agg(
        F.sum(F.when(buy, C("touches"))).alias("_eh"),
        F.sum(F.when(sell, C("touches"))).alias("_el"),
        F.count("*").alias("_np"),
        F.count_if("is_sweep").alias("_nsw"),
        F.sum(F.when(buy & open_ & (C("price") > C("last_close")), C("strength"))).alias("_bsl"),
        F.sum(F.when(sell & open_ & (C("price") < C("last_close")), C("strength"))).alias("_ssl"),
        F.max_by(F.struct("direction", "size", "hit_idx"), F.when(C("is_sweep"), order)).alias("_l"),
    )
    out = now.select(*keys, "n_bars").join(agg, keys, "left")
    zero = lambda x: F.coalesce(x.cast("double"), F.lit(0.0))
    last = F.when(C("_l")["direction"] == "above", 1.0).when(C("_l").isNotNull(), -1.0)
    return out.select(
        *keys,
        zero(C("_eh")).alias("equal_highs"),
        zero(C("_el")).alias("equal_lows"),
        zero(C("_np")).alias("pool_count"),
        zero(C("_nsw")).alias("sweep_count"),
        zero(C("_bsl")).alias("buy_side"),
        zero(C("_ssl")).alias("sell_side"),
        zero(last).alias("last_sweep_direction"),
        zero(C("_l")["size"]).alias("last_sweep_size"),
        (C("n_bars") - 1 - C("_l")["hit_idx"]).cast("double").alias("bars_since_sweep"),
    )
