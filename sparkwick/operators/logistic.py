"""Multinomial logistic models for many keys and ensemble members at once.

Newton's method needs, per model, the loss, the gradient and the Hessian: sums over rows. Each scan
adds them up for all keys and all bootstrap members inside the tasks, packed as one triangle, and
combines them per cell; the steps are solved per model in tasks. A key's number of rows, the number
of keys and the number of members change the work of a scan, not the number of scans.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwick.functions.columns import col
from sparkwick.operators import scan as S
from sparkwick.operators.models import poisson_weight
from sparkwick.sources.staging import stage

C = F.col
STEPS, TOLERANCE = 60, 1e-12
#: Cells of packed sums that a task holds before it passes them on.
HELD_CELLS = 4_000_000


def _softmax(x: np.ndarray, coef: np.ndarray) -> np.ndarray:
    m = x @ coef.T
    p = np.exp(m - m.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _sums(x: np.ndarray, y: np.ndarray, w: np.ndarray, coef: np.ndarray) -> np.ndarray:
    """Weighted loss, gradient and upper triangle of the Hessian, class by class, in one array."""
    k, q = coef.shape
    p = _softmax(x, coef)
    loss = -(w * np.log(np.maximum(p[np.arange(len(y)), y], 1e-300))).sum()
    gap = p.copy()
    gap[np.arange(len(y)), y] -= 1.0
    grad = (gap * w[:, None]).T @ x
    hess = np.empty((k, q, k, q))
    for a in range(k):
        for b in range(a, k):
            v = w * (p[:, a] * ((a == b) - p[:, b]))
            hess[a, :, b, :] = (x * v[:, None]).T @ x
            hess[b, :, a, :] = hess[a, :, b, :].T
    full = hess.reshape(k * q, k * q)
    return np.concatenate([[loss], grad.ravel(), full[np.triu_indices(k * q)]])


def _scan(
    batches: Iterator[pd.DataFrame], keys: list[str], q: int, classes: int
) -> Iterator[pd.DataFrame]:
    held: dict[tuple, np.ndarray] = {}

    def out():
        names = list(held)
        t = pd.DataFrame([n[:-1] for n in names], columns=keys)
        t["member"], t["g"] = [n[-1] for n in names], [g.tolist() for g in held.values()]
        held.clear()
        return t

    for pdf in batches:
        for key, part in pdf.groupby(keys, sort=False, dropna=False):
            x = np.array(part["x"].tolist(), dtype=float).reshape(-1, q)
            w = np.array(part["w"].tolist(), dtype=float)
            y = part["y"].to_numpy()
            for member, coef in enumerate(part["coefs"].iloc[0]):
                if coef is None:  # this model stands
                    continue
                on = w[:, member] > 0
                g = _sums(x[on], y[on], w[on, member], np.array(coef, dtype=float).reshape(classes, q))
                name = (*key, member)
                held[name] = held[name] + g if name in held else g
        if sum(len(g) for g in held.values()) > HELD_CELLS:
            yield out()
    if held:
        yield out()


def _advance(state: pd.DataFrame, q: int, classes: int, c: float) -> pd.DataFrame:
    """One Newton step of every model whose sums are given; a step that raised the loss is halved."""
    size = classes * q
    free = np.ones(size, dtype=bool)
    free[::q] = False  # intercepts are not penalised
    out = []
    for r in state.itertuples():
        coef, before = np.array(r.coef, dtype=float), r.before
        if r.g is None or r.done:
            out.append((r.coef, r.before, r.loss, r.done))
            continue
        g = np.array(r.g, dtype=float)
        loss = g[0] + (coef[free] ** 2).sum() / (2.0 * c)
        if before is not None and loss > r.loss + 1e-9 * max(1.0, abs(r.loss)):
            out.append((((coef + np.array(before)) / 2.0).tolist(), before, r.loss, False))
            continue
        hess = np.zeros((size, size))
        hess[np.triu_indices(size)] = g[1 + size :]
        hess = hess + np.triu(hess, 1).T + np.diag(free / c)
        grad = g[1 : 1 + size] + np.where(free, coef / c, 0.0)
        step = np.linalg.lstsq(hess, grad, rcond=None)[0]
        # what the step can still gain; coefficients themselves may be ill determined
        small = grad @ step <= TOLERANCE * (1.0 + abs(loss))
        out.append(((coef - step).tolist(), coef.tolist(), float(loss), bool(small)))
    return pd.DataFrame(out, columns=["coef", "before", "loss", "done"])


def fit_by_key(
    df: DataFrame, keys, features, label, classes: int, c: float = 1.0, members: int = 0,
    balanced: bool = True, row: str = "sample_idx",
) -> DataFrame:
    """One model per key, and ``members`` more on bootstrap draws: keys, member, coef.

    ``label`` is a class number from 0; ``coef`` holds per class the intercept and one coefficient
    per feature, with a ridge penalty of strength 1 / c on the latter. ``balanced`` weighs classes
    by n / (k n_c) within the key. Member 0 takes every row, the others Poisson draws from a hash of
    ``row``. Rows with a null feature or label are left out, and so are keys that miss a class: they
    have no model. Raises when a model has not settled after 60 scans.
    """
    keys, q = list(keys), len(features) + 1
    x = F.array(F.lit(1.0), *[C(f).cast("double") for f in features])
    rows = df.select(*keys, x.alias("x"), col(label).cast("int").alias("y"), C(row).alias("_row"))
    rows = rows.where(C("y").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v)))
    sizes = rows.groupBy(*keys, "y").agg(F.count("*").alias("_nc"))
    total = sizes.groupBy(*keys).agg(F.sum("_nc").alias("_n"), F.count("*").alias("_k")).where(C("_k") == classes)
    weight = C("_n") / (classes * C("_nc")) if balanced else F.lit(1.0)
    per_class = sizes.join(total, keys).select(*keys, "y", weight.alias("_w"))
    rows = S.attach(rows, per_class, [*keys, "y"], "_row")
    draws = [F.lit(1.0), *(poisson_weight(C("_row"), i) for i in range(members))]
    rows = stage(rows.select(*keys, "x", "y", "_row", F.array(*(C("_w") * d for d in draws)).alias("w")))

    number = F.explode(F.sequence(F.lit(0), F.lit(members))).alias("member")
    state = total.select(*keys, number).select(
        *keys, "member", F.array_repeat(F.lit(0.0), classes * q).alias("coef"),
        F.lit(None).cast("array<double>").alias("before"), F.lit(None).cast("double").alias("loss"), F.lit(False).alias("done"),
    )
    state = stage(state)
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    size = classes * q
    for _ in range(STEPS):
        live = F.when(~C("done"), C("coef"))
        listed = F.array_sort(F.collect_list(F.struct("member", live.alias("coef"))))
        coefs = state.groupBy(*keys).agg(F.transform(listed, lambda m: m["coef"]).alias("coefs"))
        part = S.attach(rows, coefs, keys, "_row").drop("_row").mapInPandas(
            partial(_scan, keys=keys, q=q, classes=classes), f"{kinds}, member int, g array<double>"
        )
        cells = part.select(*keys, "member", F.posexplode("g").alias("i", "v"))
        cells = cells.groupBy(*keys, "member", "i").agg(F.sum("v").alias("v"))
        g = F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"])
        sums = cells.groupBy(*keys, "member").agg(g.alias("g"))

        def advance(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                new = _advance(pdf, q, classes, c)
                yield pd.concat([pdf[[*keys, "member"]].reset_index(drop=True), new], axis=1)

        schema = f"{kinds}, member int, coef array<double>, before array<double>, loss double, done boolean"
        state = stage(state.join(sums, [*keys, "member"], "left").mapInPandas(advance, schema))
        if state.where(~C("done")).isEmpty():
            break
    else:
        raise ArithmeticError(f"logistic models have not settled after {STEPS} scans")
    return state.select(*keys, "member", "coef").where(F.size("coef") == size)


def _probabilities(coef, features, classes: int):
    q = len(features) + 1
    x = [F.lit(1.0), *[C(f).cast("double") for f in features]]
    margin = [
        sum((x[j] * F.get(coef, F.lit(i * q + j)) for j in range(1, q)), F.get(coef, F.lit(i * q)))
        for i in range(classes)
    ]
    top = F.greatest(*margin)
    raw = [F.exp(m - top) for m in margin]
    total = sum(raw[1:], raw[0])
    return F.array(*(r / total for r in raw))


def score_by_key(df: DataFrame, models: DataFrame, keys, features, classes: int, salt: str) -> DataFrame:
    """``df`` with ``probabilities``, ``predicted`` and ``agreement`` of its key's models.

    ``agreement`` is the share of bootstrap members that predict member 0's class (null without
    members); ties go to the lower class. Rows of keys without a model are left out. ``salt`` names
    a column that tells rows of a key apart.
    """
    keys = list(keys)
    listed = F.array_sort(F.collect_list(F.struct("member", "coef")))
    per_key = models.groupBy(*keys).agg(F.transform(listed, lambda m: m["coef"]).alias("_coefs"))
    t = S.attach(df, per_key, keys, salt)
    all_p = F.transform("_coefs", lambda coef: _probabilities(coef, features, classes))
    best = lambda p: (F.array_position(p, F.array_max(p)) - 1).cast("int")
    t = t.withColumn("_p", all_p).withColumn("_best", F.transform("_p", best))
    own = F.get("_best", F.lit(0))
    others = F.slice("_best", 2, F.greatest(F.size("_best") - 1, F.lit(1)))
    hits = F.size(F.filter(others, lambda b: b == own))
    return t.withColumns(
        {
            "probabilities": F.get("_p", F.lit(0)),
            "predicted": own,
            "agreement": F.when(F.size("_best") > 1, hits / (F.size("_best") - 1)),
        }
    ).drop("_coefs", "_p", "_best")
