"""Isotonic regression per key, fitted and applied without gathering values in one place.

Pooling adjacent violators is associative over ordered runs of values: a run may be pooled alone and
what is left of it, a list of blocks, be pooled with its neighbours'. Values are pooled once, then
per value bucket, then per key over what the buckets left. For 0/1 outcomes of n rows that is at most
of the order of n**(2/3) blocks, as neighbouring blocks have different fractions as means.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwick.functions.columns import col
from sparkwick.operators import scan as S
from sparkwick.sources.staging import stage

C = F.col


def pooled(lo: Iterable[float], hi: Iterable[float], w: Iterable[float], s: Iterable[float]) -> list[tuple]:
    """Blocks (lo, hi, weight, sum) of increasing means from blocks in order of their values."""
    out: list[list[float]] = []
    for a, b, weight, total in zip(lo, hi, w, s, strict=True):
        block = [a, b, weight, total]
        while out and out[-1][3] * block[2] >= block[3] * out[-1][2]:
            before = out.pop()
            block = [before[0], block[1], before[2] + block[2], before[3] + block[3]]
        out.append(block)
    return [tuple(x) for x in out]


def _pool(keys: list[str]):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("lo")
        blocks = pooled(*(g[c].to_numpy(dtype=np.float64).tolist() for c in ("lo", "hi", "w", "s")))
        out = pd.DataFrame(blocks, columns=["lo", "hi", "w", "s"])
        for i, k in enumerate(keys):
            out.insert(i, k, group[k].iloc[0])
        return out

    return run


def fit(df: DataFrame, keys, x, y, weight: Column | None = None) -> DataFrame:
    """Blocks of the isotonic regression of ``y`` on ``x`` per key: keys, lo, hi, w, value.

    Rows with a null ``x`` or ``y`` are left out; equal ``x`` are pooled first. An empty table has
    no blocks.
    """
    keys = list(keys)
    w = weight if weight is not None else F.lit(1.0)
    rows = df.select(*keys, col(x).cast("double").alias("lo"), col(y).cast("double").alias("_y"), w.cast("double").alias("w"))
    rows = rows.where(C("lo").isNotNull() & ~F.isnan("lo") & C("_y").isNotNull() & (C("w") > 0))
    values = rows.groupBy(*keys, "lo").agg(F.sum("w").alias("w"), F.sum(C("w") * C("_y")).alias("s"))
    values = stage(values.withColumn("hi", C("lo")))
    schema = values.select(*keys, "lo", "hi", "w", "s").schema
    runs = S.value_buckets(values, keys, "lo").groupBy(*keys, "_vb").applyInPandas(_pool(keys), schema)
    blocks = runs.groupBy(*keys).applyInPandas(_pool(keys), schema)
    return stage(blocks.select(*keys, "lo", "hi", "w", (C("s") / C("w")).alias("value")))


def apply(df: DataFrame, blocks: DataFrame, keys, x, name: str = "fitted") -> DataFrame:
    """``df`` with the fitted curve at ``x``: flat in and outside blocks, straight between them.

    An as-of join: rows and the curve's corners are put in order of value inside value buckets and
    the last corner is carried over, so neither side is broadcast and no key gathers. Null where
    ``x`` is null or the key has no blocks; a column called ``name`` is replaced.
    """
    keys = list(keys)
    columns = [c for c in df.columns if c != name]
    ends = F.array_distinct(F.array(F.struct(C("lo").alias("x"), "value"), F.struct(C("hi").alias("x"), "value")))
    corners = blocks.select(*keys, F.explode(ends).alias("p")).select(*keys, "p.x", C("p.value").alias("y"))
    ahead = Window.partitionBy(*keys).orderBy("x")
    corners = corners.select(
        *keys, C("x").alias("_x"), F.lit(0).alias("_r"), F.lit(None).cast(df.select(F.struct(*columns)).schema[0].dataType).alias("_row"),
        F.struct(C("x").alias("x0"), C("y").alias("y0"), F.lead("x").over(ahead).alias("x1"), F.lead("y").over(ahead).alias("y1")).alias("_c"),
    )
    at = col(x).cast("double")
    rows = df.select(*keys, at.alias("_x"), F.lit(1).alias("_r"), F.struct(*columns).alias("_row"), F.lit(None).cast(corners.schema["_c"].dataType).alias("_c"))
    both = stage(corners.unionByName(rows))
    order = ["_x", "_r"]
    both = S.value_buckets(both.where("_x is not null"), keys, "_x").unionByName(
        both.where("_x is null").withColumn("_vb", F.lit(-1))
    )
    both = S.scan(both, keys, order, [S.Scan("_last", "last", C("_c"))], "_vb").where("_r = 1")
    first = blocks.groupBy(*keys).agg(F.min_by("value", "lo").alias("_first"))
    left = both.select(*keys).distinct().join(first, keys, "left")
    both = S.attach(both, left, keys, "_x")
    step = (C("_x") - C("_last")["x0"]) / (C("_last")["x1"] - C("_last")["x0"])
    inside = C("_last")["y0"] + (C("_last")["y1"] - C("_last")["y0"]) * step
    value = (
        F.when(C("_x").isNull(), None)
        .when(C("_last").isNull(), C("_first"))
        .when(C("_last")["x1"].isNull(), C("_last")["y0"])
        .otherwise(inside)
    )
    return both.select(*(C("_row")[c].alias(c) for c in columns), value.alias(name))
