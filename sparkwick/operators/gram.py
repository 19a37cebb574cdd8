"""Cross-product sums: one pass over the rows, p x p numbers out.

Everything linear (correlations, least squares, ridge, bootstrap, inflation factors, unit-root
regressions) is solved from these sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

C = F.col
FLUSH_CELLS = 4_000_000


def _partial(keys, p: int, weights: int):
    """Sum x x' per key inside a task; rows of x are the array column ``x``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def flush():
            if held:
                out = pd.DataFrame(list(held.keys()), columns=list(keys))
                out["g"] = [a.ravel().tolist() for a in held.values()]
                held.clear()
                yield out

        for pdf in batches:
            for key, part in pdf.groupby(list(keys), sort=False):
                x = np.array(part["x"].tolist(), dtype=float).reshape(-1, p)
                if weights:
                    w = np.array(part["w"].tolist(), dtype=float).reshape(-1, weights)
                    g = np.stack([x.T @ (x * w[:, [b]]) for b in range(weights)])
                else:
                    g = (x.T @ x)[None]
                held[key] = held[key] + g if key in held else g
            if len(held) * p * p * max(weights, 1) > FLUSH_CELLS:
                yield from flush()
        yield from flush()

    return run


def gram_by_key(df: DataFrame, keys, columns, weights=None) -> DataFrame:
    """(keys, g array<double>): row-major sums of products of ``[1, *columns]`` per key.

    With ``weights`` (column expressions) the array holds one weighted matrix per weight.
    """
    keys = list(keys)
    x = F.array(F.lit(1.0), *[C(c).cast("double") for c in columns]).alias("x")
    src = df.select(*keys, x, *([F.array(*weights).alias("w")] if weights else []))
    p, n_w = len(columns) + 1, len(weights) if weights else 0
    schema = ", ".join([*(f"`{k}` {src.schema[k].dataType.simpleString()}" for k in keys)])
    part = src.mapInPandas(_partial(keys, p, n_w), f"{schema}, g array<double>")
    cells = part.select(*keys, F.posexplode("g").alias("i", "v"))
    cells = cells.groupBy(*keys, "i").agg(F.sum("v").alias("v"))
    return cells.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("g")
    )


class Gram:
    """The sums for named columns on the driver (p x p numbers)."""

    def __init__(self, names, flat):
        self.names = ["_one", *names]
        p = len(self.names)
        self.m = np.asarray(flat, dtype=float).reshape(-1, p, p)

    def block(self, rows, cols, b: int = 0) -> np.ndarray:
        i = [self.names.index(r) for r in rows]
        j = [self.names.index(c) for c in cols]
        return self.m[b][np.ix_(i, j)]


def gram_matrix(df: DataFrame, features, *targets: str, weights=None) -> Gram:
    names = [*features, *targets]
    row = gram_by_key(df.withColumn("_k", F.lit(1)), ["_k"], names, weights).first()
    if row is None:
        raise ValueError("no rows")
    return Gram(names, row["g"])


def solve_normal(g: Gram, features, target: str | None = None, alpha: float = 0.0, b: int = 0):
    """(coefficients, intercept) of least squares with an unpenalised intercept."""
    target = target or g.names[-1]
    n = g.block(["_one"], ["_one"], b)[0, 0]
    mx = g.block(["_one"], features, b)[0] / n
    my = g.block(["_one"], [target], b)[0, 0] / n
    a = g.block(features, features, b) - n * np.outer(mx, mx)
    r = g.block(features, [target], b)[:, 0] - n * mx * my
    a = a + alpha * np.eye(len(features))
    coef = np.linalg.solve(a, r) if alpha > 0 else np.linalg.lstsq(a, r, rcond=None)[0]
    return coef, my - mx @ coef


def correlation_matrix(df: DataFrame, features):
    """(names, correlations, standard deviations); columns are centred first for accuracy."""
    features = list(features)
    means = df.agg(*[F.avg(f).alias(f) for f in features]).first()
    centred = df.select(*[(C(f) - F.lit(means[f] or 0.0)).alias(f) for f in features])
    g = gram_matrix(centred, features)
    n = g.block(["_one"], ["_one"])[0, 0]
    m = g.block(["_one"], features)[0] / n
    cov = g.block(features, features) / n - np.outer(m, m)
    std = np.sqrt(np.clip(np.diag(cov), 0.0, None))
    safe = np.where(std > 0, std, np.nan)
    corr = np.nan_to_num(cov / np.outer(safe, safe))
    return features, corr, std


def ols_by_key(df: DataFrame, keys, features, target: str, alpha: float = 0.0) -> DataFrame:
    """One least-squares (or ridge) model per key: (keys, term, coefficient), all in one pass."""
    features, keys = list(features), list(keys)
    names = [*features, target]
    g = gram_by_key(df, keys, names)

    @F.pandas_udf("array<double>")
    def solve(flat: pd.Series) -> pd.Series:
        out = []
        for row in flat:
            coef, intercept = solve_normal(Gram(names, row), features, target, alpha)
            out.append([float(intercept), *map(float, coef)])
        return pd.Series(out)

    terms = F.array(*[F.lit(t) for t in ["intercept", *features]])
    t = g.select(*keys, F.explode(F.arrays_zip(terms.alias("term"), solve("g").alias("coef"))).alias("e"))
    return t.select(*keys, F.col("e.term").alias("term"), F.col("e.coef").alias("coefficient"))
