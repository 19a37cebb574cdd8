"""Ordered computations over series of any length.

A window over a whole series would run in one task. Everything here works on buckets (a bounded,
ordered part of a series): a local window per bucket plus a carry from a table that has one row
per bucket. Both parts join on the bucket, so the rows themselves are shuffled once.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwick.config import DEFAULT_LAYOUT, Layout
from sparkwick.functions.columns import col, epoch_us
from sparkwick.sources.staging import stage

FORWARD, BACKWARD = "asc", "desc"


@dataclass(frozen=True)
class Scan:
    """One scanned column. ``kind``: prev, next, sum, last, before, suffix_max, suffix_min."""

    name: str
    kind: str
    value: Column


def _spec(keys, order, direction):
    terms = [F.col(o).asc() if direction == FORWARD else F.col(o).desc() for o in order]
    return Window.partitionBy(*keys).orderBy(*terms)


def scan(df: DataFrame, keys, order, scans: list[Scan], bucket: str | None = None) -> DataFrame:
    """Add the scanned columns to ``df``.

    ``order`` columns must be a total order inside ``keys`` and agree with ``bucket`` order.
    ``bucket=None`` means the groups are short and one window is enough.
    """
    keys, order = list(keys), list(order)
    rank = F.struct(*order)
    part = [*keys, bucket] if bucket else keys
    if bucket:
        # one exchange serves the local windows, the bucket ends and the join
        df = df.repartition(*part)
    fwd, rev = _spec(part, order, FORWARD), _spec(part, order, BACKWARD)
    past = (Window.unboundedPreceding, -1)
    local, tails = {}, {}
    for s in scans:
        v = f"_v_{s.name}"
        df = df.withColumn(v, s.value)
        c = F.col(v)
        known = F.when(c.isNotNull(), rank)
        local[s.name], tails[s.name] = {
            "prev": lambda: (F.lag(c).over(fwd), F.max_by(F.struct(c.alias("v")), rank)),
            "next": lambda: (F.lag(c).over(rev), F.min_by(F.struct(c.alias("v")), rank)),
            "sum": lambda: (F.sum(c).over(fwd.rowsBetween(Window.unboundedPreceding, 0)), F.sum(c)),
            "last": lambda: (
                F.last(c, True).over(fwd.rowsBetween(Window.unboundedPreceding, 0)),
                F.max_by(c, known),
            ),
            "before": lambda: (F.last(c, True).over(fwd.rowsBetween(*past)), F.max_by(c, known)),
            "suffix_max": lambda: (F.max(c).over(rev.rowsBetween(*past)), F.max(c)),
            "suffix_min": lambda: (F.min(c).over(rev.rowsBetween(*past)), F.min(c)),
        }[s.kind]()
    helpers = [f"_v_{s.name}" for s in scans]
    if not bucket:
        return df.withColumns(local).drop(*helpers)

    ends = df.groupBy(*part).agg(*[a.alias(n) for n, a in tails.items()])
    up, down = _spec(keys, [bucket], FORWARD), _spec(keys, [bucket], BACKWARD)
    carry = {
        "prev": lambda n: F.lag(n).over(up),
        "next": lambda n: F.lag(n).over(down),
        "sum": lambda n: F.sum(n).over(up.rowsBetween(*past)),
        "last": lambda n: F.last(n, True).over(up.rowsBetween(*past)),
        "before": lambda n: F.last(n, True).over(up.rowsBetween(*past)),
        "suffix_max": lambda n: F.max(n).over(down.rowsBetween(*past)),
        "suffix_min": lambda n: F.min(n).over(down.rowsBetween(*past)),
    }
    ends = ends.select(*part, *[carry[s.kind](s.name).alias(f"_c_{s.name}") for s in scans])
    edge = {}
    if any(s.kind == "prev" for s in scans):
        edge["_first"] = F.row_number().over(fwd) == 1
    if any(s.kind == "next" for s in scans):
        edge["_last"] = F.row_number().over(rev) == 1
    df = df.withColumns({**{f"_l_{n}": c for n, c in local.items()}, **edge})
    df = df.join(ends, part, "left")
    out = {}
    for s in scans:
        here, far = F.col(f"_l_{s.name}"), F.col(f"_c_{s.name}")
        out[s.name] = {
            "prev": lambda: F.when(F.col("_first"), far["v"]).otherwise(here),
            "next": lambda: F.when(F.col("_last"), far["v"]).otherwise(here),
            "sum": lambda: F.coalesce(here, 0 * far, F.lit(0)) + F.coalesce(far, F.lit(0)),
            "last": lambda: F.coalesce(here, far),
            "before": lambda: F.coalesce(here, far),
            "suffix_max": lambda: F.greatest(here, far),
            "suffix_min": lambda: F.least(here, far),
        }[s.kind]()
    df = df.withColumns(out)
    return df.drop(*helpers, *edge, *[f"_l_{n}" for n in local], *[f"_c_{n}" for n in local])


def last_k(
    df: DataFrame, keys, order, value: Column, k: int, name: str, bucket: str | None = None
) -> DataFrame:
    """Add the list of the last ``k`` values up to each row, oldest first.

    The list is an associative carry: a bucket passes on its own last values, and as every bucket
    that exists has a row, the last ``k`` buckets before hold what is missing.
    """
    keys, order = list(keys), list(order)
    part = [*keys, bucket] if bucket else keys
    df = df.withColumn(f"_v_{name}", value)
    if bucket:
        df = df.repartition(*part)
    w = _spec(part, order, FORWARD)
    df = df.withColumn(name, F.collect_list(f"_v_{name}").over(w.rowsBetween(-(k - 1), 0)))
    if not bucket:
        return df.drop(f"_v_{name}")
    tails = df.groupBy(*part).agg(F.max_by(name, F.struct(*order)).alias("_tail"))
    before = _spec(keys, [bucket], FORWARD).rowsBetween(-k, -1)
    tails = tails.select(*part, F.flatten(F.collect_list("_tail").over(before)).alias("_tail"))
    both = F.concat("_tail", name)
    df = df.join(tails, part, "left").withColumn(
        name, F.slice(both, F.greatest(F.size(both) - k + 1, F.lit(1)), k)
    )
    return df.drop(f"_v_{name}", "_tail")


# --------------------------------------------------------------------------- small facts

BROADCAST_BYTES = 8 << 20
SALTS = 32


def attach(df: DataFrame, facts: DataFrame, keys, salt: str, bounded: bool = False) -> DataFrame:
    """Join one fact row per key onto many rows per key.

    The facts are computed once and measured: a table of proven small size is broadcast, a larger
    one is joined on the key and a salt from the ``salt`` column, so a key that holds a large part
    of the rows is spread over tasks. ``bounded`` groups cannot be hot and take a plain join.
    """
    keys = list(keys)
    if bounded:
        return df.join(facts, keys)
    facts = stage(facts)
    size = F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("size")
    if (facts.agg(size).first().size or 0) <= BROADCAST_BYTES:
        return df.join(F.broadcast(facts), keys)
    spread = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    at = F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int")
    return df.withColumn("_salt", at).join(spread, [*keys, "_salt"]).drop("_salt")


# --------------------------------------------------------------------------- bar positions


def time_bucket(ts: Column, span_seconds: int) -> Column:
    return F.floor(epoch_us(ts) / F.lit(span_seconds * 1_000_000)).cast("long")


def index_bars(
    df: DataFrame, layout: Layout = DEFAULT_LAYOUT, span_seconds: int = 30 * 86400
) -> DataFrame:
    """Add ``bar_idx``, the position of a bar in its series (timestamps are unique per series)."""
    if layout.bounded:
        w = Window.partitionBy(*layout.keys).orderBy("ts")
        return df.withColumn("bar_idx", F.row_number().over(w).cast("long") - 1)
    df = df.withColumn("_bucket", time_bucket(F.col("ts"), span_seconds))
    part = [*layout.keys, "_bucket"]
    df = df.repartition(*part)
    base = df.groupBy(*part).agg(F.count("*").alias("_n"))
    before = _spec(layout.keys, ["_bucket"], FORWARD).rowsBetween(Window.unboundedPreceding, -1)
    base = base.select(*part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    local = F.row_number().over(Window.partitionBy(*part).orderBy("ts"))
    df = df.withColumn("_rn", local).join(base, part)
    return df.withColumn("bar_idx", (F.col("_base") + F.col("_rn") - 1).cast("long")).drop(
        "_bucket", "_rn", "_base"
    )


# The first bars of a halo only complete the frames of the drives; recurrences start after them,
# at offset 0, and are carried from the bar before (``_end`` of the previous chunk).
WARM = 16


# a series this short fits one window partition, and decay ** -offset stays in range
SHORT_SERIES = 2048


def fit_layout(bars: DataFrame, layout: Layout = DEFAULT_LAYOUT) -> Layout:
    """One window per series when every series is short (checked), chunks otherwise.

    Runs one small job; give it staged bars.
    """
    longest = bars.groupBy(*layout.keys).count().agg(F.max("count")).first()[0] or 0
    return short_layout(layout) if longest <= SHORT_SERIES else layout


def short_layout(layout: Layout = DEFAULT_LAYOUT) -> Layout:
    """The layout of series known to have at most ``SHORT_SERIES`` bars."""
    return replace(layout, bounded=True, single=True, chunk=SHORT_SERIES)


def extend(df: DataFrame, layout: Layout = DEFAULT_LAYOUT) -> DataFrame:
    """Copy each chunk's neighbour bars into it; ``core`` marks a bar's own chunk."""
    if layout.bounded:
        pos = F.pmod(F.col("bar_idx"), F.lit(layout.chunk))
        return df.withColumns(
            {"core": F.lit(True), "_off": pos, "_end": pos == layout.chunk - 1}
        )
    b, back, fwd = layout.chunk, layout.back, layout.fwd
    own = F.floor(F.col("bar_idx") / b).cast("long")
    pos = F.pmod(F.col("bar_idx"), F.lit(b))
    homes = F.array_compact(
        F.array(own, F.when(pos >= b - back, own + 1), F.when((own > 0) & (pos < fwd), own - 1))
    )
    # everything derived is added after the exchange, so the carry pass and the row pass share it
    df = df.withColumn("chunk", F.explode(homes)).repartition(*layout.keys, "chunk")
    return df.withColumns(
        {
            "core": F.floor(F.col("bar_idx") / b) == F.col("chunk"),
            "_off": F.col("bar_idx") - (F.col("chunk") * b - back + WARM),
            "_end": F.col("bar_idx") == (F.col("chunk") + 1) * b - back + WARM - 1,
        }
    )


def bar_window(layout: Layout = DEFAULT_LAYOUT):
    return Window.partitionBy(*layout.window_keys).orderBy("bar_idx")


def core_rows(df: DataFrame) -> DataFrame:
    return df.where("core").drop("core", "chunk", "_off", "_end")


# --------------------------------------------------------------------------- recurrences


@dataclass(frozen=True)
class Affine:
    """y[t] = decay * y[t-1] + drive[t]."""

    name: str
    drive: Column
    decay: float


@dataclass(frozen=True)
class Fill:
    """Last non-null ``value`` up to ``lag`` bars before the current one."""

    name: str
    value: Column
    lag: int = 0


def ema(name: str, x: Column, period: int) -> Affine:
    return smooth(name, x, 2.0 / (period + 1.0))


def wilder(name: str, x: Column, period: int) -> Affine:
    return smooth(name, x, 1.0 / period)


def smooth(name: str, x: Column, alpha: float) -> Affine:
    """Exponential smoothing seeded with the first value."""
    drive = F.when(F.col("bar_idx") == 0, x).otherwise(x * alpha)
    return Affine(name, drive, 1.0 - alpha)


def _fold(values: Column, decay: float) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc * decay + x)


# exp(-41) is below the resolution of a double next to the terms that are kept
_NEGLIGIBLE = 41.0


def recur(
    df: DataFrame, layout: Layout, affine: list[Affine] = (), fills: list[Fill] = ()
) -> DataFrame:
    """Run recurrences over extended chunks (see ``extend``); valid from offset 0 on.

    An affine recurrence composes associatively: inside a chunk it is a running sum of
    ``drive * decay**-offset``; across chunks only the value at one bar per chunk is carried.
    A bounded layout has one window per group, but the powers restart every ``chunk`` bars there
    too, so a group may be of any length.
    """
    w = bar_window(layout)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    # a window per segment sorts the rows, by now wide, once more: only for groups that need it
    part_upto = upto
    if layout.bounded and not layout.single:
        segment = F.floor(F.col("bar_idx") / layout.chunk)
        part_upto = (
            Window.partitionBy(*layout.window_keys, segment)
            .orderBy("bar_idx")
            .rowsBetween(Window.unboundedPreceding, 0)
        )
    rows = layout.chunk + layout.back + layout.fwd
    off = F.col("_off").cast("double")
    local, linear = {}, []
    for a in affine:
        if a.decay == 0.0:
            local[a.name] = a.drive
        elif a.decay < 1.0 and rows * math.log10(1.0 / a.decay) > 280:
            reach = math.ceil(_NEGLIGIBLE / math.log(1.0 / a.decay))
            if not layout.bounded and reach > layout.back:
                raise ValueError(f"{a.name}: widen Layout.back to at least {reach}")
            recent = F.collect_list(a.drive).over(w.rowsBetween(-reach, 0))
            local[a.name] = _fold(recent, a.decay)
        else:
            live = F.when(off >= 0, a.drive * F.pow(F.lit(a.decay), -off)).otherwise(0.0)
            scaled = F.sum(live).over(part_upto)
            local[a.name] = scaled * F.pow(F.lit(a.decay), off)
            linear.append(a)
    fill_src = {f"_f_{f.name}": F.when(off >= 0, f.value) for f in fills}
    df = df.withColumns(fill_src) if fill_src else df
    for f in fills:
        frame = w.rowsBetween(Window.unboundedPreceding, -f.lag) if f.lag else upto
        local[f.name] = F.last(F.col(f"_f_{f.name}"), True).over(frame)
    df = df.withColumns(local)
    if layout.single:
        return df.drop(*fill_src)
    if layout.bounded:
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        whole = {}
        for a in linear:
            if a.decay == 1.0:
                carry = F.sum(F.when(F.col("_end"), F.col(a.name))).over(before)
            else:
                # values at earlier segment ends, folded; the window skips the nulls in between
                ends = F.collect_list(F.when(F.col("_end"), F.col(a.name))).over(before)
                carry = _fold(ends, a.decay**layout.chunk)
            grown = F.coalesce(carry, F.lit(0.0)) * F.pow(F.lit(a.decay), off + 1.0)
            whole[a.name] = F.col(a.name) + grown
        return (df.withColumns(whole) if whole else df).drop(*fill_src)
    if not (linear or fills):
        return df.drop(*fill_src)

    part = [*layout.keys, "chunk"]
    own_segment = (off >= 0) & (off < layout.chunk)
    ends = [F.max(F.when(F.col("_end"), F.col(a.name))).alias(a.name) for a in linear]
    for f in fills:
        v = F.col(f"_f_{f.name}")
        known = F.when(v.isNotNull() & own_segment, F.col("bar_idx"))
        ends.append(F.max_by(v, known).alias(f.name))
    table = df.groupBy(*part).agg(*ends)
    up = _spec(layout.keys, ["chunk"], FORWARD)
    carried = []
    for a in linear:
        if a.decay == 1.0:
            c = F.sum(a.name).over(up.rowsBetween(Window.unboundedPreceding, -1))
        else:
            whole = a.decay**layout.chunk
            depth = max(1, math.ceil(_NEGLIGIBLE / (layout.chunk * math.log(1.0 / a.decay))))
            c = _fold(F.collect_list(a.name).over(up.rowsBetween(-depth, -1)), whole)
        carried.append(F.coalesce(c, F.lit(0.0)).alias(f"_c_{a.name}"))
    for f in fills:
        c = F.last(f.name, True).over(up.rowsBetween(Window.unboundedPreceding, -1))
        carried.append(c.alias(f"_c_{f.name}"))
    df = df.join(table.select(*part, *carried), part, "left")
    joined = {
        a.name: F.col(a.name) + F.col(f"_c_{a.name}") * F.pow(F.lit(a.decay), off + 1.0)
        for a in linear
    }
    joined |= {f.name: F.coalesce(F.col(f.name), F.col(f"_c_{f.name}")) for f in fills}
    return df.withColumns(joined).drop(*fill_src, *[f"_c_{n}" for n in joined])


# --------------------------------------------------------------------------- order by value


#: Ordered buckets of a value: this many at least, more when a key has many different values.
PARTS, PART_VALUES, MOST_PARTS = 64, 1_000_000, 4_096


def value_buckets(df: DataFrame, keys, value: str, parts: int = PARTS) -> DataFrame:
    """Add ``_vb``: an ordered bucket of ``value`` inside ``keys``, from approximate quantiles.

    Results built on it are exact; the quantiles only balance the buckets.
    """
    fractions = [i / parts for i in range(1, parts)]
    cuts = df.groupBy(*keys).agg(
        F.array_distinct(
            F.percentile_approx(value, fractions, parts * 20)
        ).alias("_cuts")
    )
    rank = F.size(F.filter(F.col("_cuts"), lambda c: c < F.col(value)))
    return attach(df, cuts, keys, value).withColumn("_vb", rank).drop("_cuts")


def value_counts(df: DataFrame, keys, value, sums: dict[str, Column] | None = None) -> DataFrame:
    """Rows per distinct value with running totals: ``n``, ``upto`` and ``<sum>``, ``<sum>_upto``."""
    keys = list(keys)
    sums = sums or {}
    base = df.select(*keys, col(value).alias("value"), *[c.alias(n) for n, c in sums.items()])
    base = base.where(F.col("value").isNotNull())
    counts = base.groupBy(*keys, "value").agg(
        F.count("*").alias("n"), *[F.sum(n).alias(n) for n in sums]
    )
    # counted once; cuts, totals and ranks all start from the stored counts
    counts = stage(counts)
    most = counts.groupBy(*keys).count().agg(F.max("count")).first()[0] if keys else counts.count()
    parts = min(MOST_PARTS, max(PARTS, math.ceil((most or 0) / PART_VALUES)))
    counts = value_buckets(counts, keys, "value", parts)
    scans = [Scan(f"{n}_upto" if n != "n" else "upto", "sum", F.col(n)) for n in ["n", *sums]]
    return scan(counts, keys, ["value"], scans, bucket="_vb").drop("_vb")


def quantiles(
    df: DataFrame, keys, value, fractions: dict[str, float], bounded: bool = False
) -> DataFrame:
    """Exact linearly interpolated quantiles per key, without gathering a group in one place."""
    keys = list(keys)
    if bounded:
        return df.groupBy(*keys).agg(
            *[F.percentile(col(value), F.lit(q)).alias(n) for n, q in fractions.items()]
        )
    counts = value_counts(df, keys, value)
    total = counts.groupBy(*keys).agg(F.sum("n").alias("_total"))
    counts = attach(counts, total, keys, "value")
    picks = []
    for n, q in fractions.items():
        at = (F.col("_total") - 1) * F.lit(q)
        for side, pos in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            picks.append(F.min(F.when(F.col("upto") > pos, F.col("value"))).alias(f"_{n}_{side}"))
    got = counts.groupBy(*keys).agg(F.first("_total").alias("_total"), *picks)
    out = []
    for n, q in fractions.items():
        at = (F.col("_total") - 1) * F.lit(q)
        lo, hi = F.col(f"_{n}_lo"), F.col(f"_{n}_hi")
        out.append((lo + (hi - lo) * (at - F.floor(at))).alias(n))
    return got.select(*keys, *out)
