"""Column builders shared by every operator."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkwick.config import DEFAULT, AnalysisConfig


def num(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def finite(x: Column) -> Column:
    """NaN and infinities become NULL."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def safe_divide(n: Column, d: Column, fill: float | Column | None = 0.0) -> Column:
    ok = d.isNotNull() & ~F.isnan(d) & (d != 0.0) & (F.abs(d) != float("inf"))
    return F.when(ok, n / d).otherwise(num(fill) if fill is not None else F.lit(None))


def or_default(x: Column, default: float = 0.0) -> Column:
    return F.coalesce(finite(x), F.lit(float(default)))


def significant(x: Column, digits: int = 12) -> Column:
    """``x`` to so many significant digits: what the order of a sum leaves behind is dropped."""
    scale = F.pow(F.lit(10.0), F.lit(digits) - F.ceil(F.log10(F.abs(x))))
    return F.when(x == 0, 0.0).otherwise(F.round(x * scale) / scale)


def clip(x: Column, lo: float = 0.0, hi: float = 100.0) -> Column:
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x))


def flag(c: Column) -> Column:
    """1.0 when true, 0.0 when false or unknown."""
    return F.when(c, 1.0).otherwise(0.0)


def add(cols) -> Column:
    return reduce(lambda a, b: a + b, cols)


def body() -> Column:
    return F.abs(F.col("close") - F.col("open"))


def candle_range() -> Column:
    return F.col("high") - F.col("low")


def upper_wick() -> Column:
    return F.col("high") - F.greatest("open", "close")


def lower_wick() -> Column:
    return F.least("open", "close") - F.col("low")


def is_bullish() -> Column:
    return F.col("close") > F.col("open")


def true_range(prev_close: Column) -> Column:
    return F.greatest(
        F.col("high") - F.col("low"),
        F.abs(F.col("high") - prev_close),
        F.abs(F.col("low") - prev_close),
    )


def epoch_us(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def session_columns(ts: Column, cfg: AnalysisConfig = DEFAULT) -> dict[str, Column]:
    """Trading sessions by UTC hour; a session whose end is before its start wraps midnight."""
    hour = F.hour(ts)

    def inside(bounds):
        start, end = bounds
        if start <= end:
            return (hour >= start) & (hour < end)
        return (hour >= start) | (hour < end)

    active = {
        "session_is_sydney": flag(inside(cfg.session_sydney)),
        "session_is_asian": flag(inside(cfg.session_asian)),
        "session_is_london": flag(inside(cfg.session_london)),
        "session_is_newyork": flag(inside(cfg.session_newyork)),
    }
    return {
        **active,
        "session_session_overlap": flag(add(active.values()) >= 2.0),
        "session_hour": hour.cast("double"),
        "session_minute": F.minute(ts).cast("double"),
        "session_day_of_week": F.weekday(ts).cast("double"),
        "session_month": F.month(ts).cast("double"),
    }


# Encoded time features and their periods, and the three-way categorical features.
CYCLES = {"session_hour": 24, "session_minute": 60, "session_day_of_week": 7, "session_month": 12}
SIGNED_CATEGORIES = (
    "trend_direction",
    "structure_last_bos_direction",
    "structure_last_choch_direction",
    "liq_last_sweep_direction",
    "fvg_nearest_direction",
    "ob_nearest_direction",
)
SIGN_SUFFIXES = {"neg": -1.0, "zero": 0.0, "pos": 1.0}


def cyclical(name: str) -> dict[str, Column]:
    angle = F.col(name) * F.lit(2.0 * 3.141592653589793) / F.lit(float(CYCLES[name]))
    return {f"{name}_sin": F.sin(angle), f"{name}_cos": F.cos(angle)}


def one_hot(name: str) -> dict[str, Column]:
    near = lambda code: F.abs(F.col(name) - code) <= 1e-8 + 1e-5 * abs(code)
    return {f"{name}_{s}": flag(near(code)) for s, code in SIGN_SUFFIXES.items()}


class Registry(dict):
    """Name -> function returning a Column (the user's extension point)."""

    def register(self, name: str) -> Callable:
        def keep(fn):
            self[name] = fn
            return fn

        return keep
