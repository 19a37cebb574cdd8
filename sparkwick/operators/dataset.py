"""Labels, targets, splits, imputation, scaling and feature selection for supervised data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwick.config import DEFAULT_LAYOUT, SERIES_KEYS, Layout
from sparkwick.functions.columns import (
    CYCLES,
    SIGNED_CATEGORIES,
    Registry,
    cyclical,
    one_hot,
    safe_divide,
    true_range,
)
from sparkwick.operators import scan as S
from sparkwick.operators.features import fingerprint, schema_issues
from sparkwick.operators.gram import correlation_matrix, solve_normal
from sparkwick.sources.staging import stage

C = F.col
# Class order defines the integer codes.
CLASSES = ("SELL", "NO_TRADE", "BUY")

# --------------------------------------------------------------------------- targets

TARGETS = Registry()


class _Ahead:
    """Columns of the bars after the decision bar, for target functions."""

    def __init__(self, layout: Layout, horizon: int, pip_size: float):
        self.w = S.bar_window(layout)
        self.h = horizon
        self.pip = pip_size
        self.future = self.w.rowsBetween(1, horizon)

    def lead(self, c: str) -> Column:
        return F.lead(c, self.h).over(self.w)

    def over(self, agg: Column) -> Column:
        return agg.over(self.future)


@TARGETS.register("next_close")
def _next_close(a):
    return a.lead("close")


@TARGETS.register("next_open")
def _next_open(a):
    return a.lead("open")


@TARGETS.register("next_high")
def _next_high(a):
    return a.lead("high")


@TARGETS.register("next_low")
def _next_low(a):
    return a.lead("low")


@TARGETS.register("next_return")
def _next_return(a):
    return safe_divide(a.lead("close") - C("close"), C("close"))


@TARGETS.register("next_log_return")
def _next_log_return(a):
    positive = (C("close") > 0) & (a.lead("close") > 0)
    return F.when(positive, F.ln(a.lead("close") / C("close"))).otherwise(0.0)


@TARGETS.register("expected_pip_movement")
def _pips(a):
    return safe_divide(a.lead("close") - C("close"), F.lit(float(a.pip)))


@TARGETS.register("expected_percentage_change")
def _percent(a):
    return _next_return(a) * 100.0


@TARGETS.register("future_atr")
def _future_atr(a):
    return a.over(F.avg("_tr"))


@TARGETS.register("future_volatility")
def _future_volatility(a):
    return a.over(F.stddev_pop("_lr"))


@TARGETS.register("maximum_favorable_excursion")
def _mfe(a):
    return a.over(F.max("high")) - C("close")


@TARGETS.register("maximum_adverse_excursion")
def _mae(a):
    return C("close") - a.over(F.min("low"))


@TARGETS.register("average_future_price")
def _average_future(a):
    return a.over(F.avg("close"))


@TARGETS.register("future_range")
def _future_range(a):
    return a.over(F.max("high")) - a.over(F.min("low"))


@TARGETS.register("future_midpoint")
def _future_midpoint(a):
    return (a.over(F.max("high")) + a.over(F.min("low"))) / 2.0


def with_targets(
    bars: DataFrame,
    horizon: int = 1,
    names=None,
    pip_size: float = 1e-4,
    layout: Layout = DEFAULT_LAYOUT,
) -> DataFrame:
    """Add ``target_reg_<name>``; the last ``horizon`` bars have no label and are dropped.

    Targets read ``horizon`` bars ahead, so the chunk's forward halo grows with it.
    """
    names = list(names) if names is not None else list(TARGETS)
    unknown = [n for n in names if n not in TARGETS]
    if unknown or horizon < 1:
        raise ValueError(f"unknown targets {unknown} or horizon {horizon} < 1")
    layout = _reach(layout, horizon)
    df = S.extend(bars, layout)
    w = S.bar_window(layout)
    prev = F.coalesce(F.lag("close").over(w), C("close"))
    ahead = _Ahead(layout, horizon, pip_size)
    floor = lambda c: F.greatest(c, F.lit(1e-12))
    df = df.withColumns(
        {
            "_tr": true_range(prev),
            "_lr": F.ln(floor(C("close"))) - F.ln(floor(prev)),
            "_has_label": F.lead("bar_idx", horizon).over(w).isNotNull(),
        }
    )
    df = df.withColumns({f"target_reg_{n}": TARGETS[n](ahead) for n in names})
    df = S.core_rows(df).where("_has_label")
    return df.select(*bars.columns, *[f"target_reg_{n}" for n in names])


def _reach(layout: Layout, fwd: int) -> Layout:
    from dataclasses import replace

    if layout.bounded or fwd <= layout.fwd:
        return layout
    if fwd > layout.chunk:
        return replace(layout, fwd=fwd, chunk=2 * fwd)
    return replace(layout, fwd=fwd)


def attach_targets(dataset: DataFrame, targets: DataFrame, strict: bool = True) -> DataFrame:
    """Equi-join targets onto dataset rows by series and decision time."""
    on = [*SERIES_KEYS, "ts"]
    names = [c for c in targets.columns if c.startswith("target_")]
    if strict:
        lost = dataset.join(targets, on, "left_anti")
        if not lost.isEmpty():
            raise ValueError("a decision timestamp has no target: use the same candles for both")
    return dataset.join(targets.select(*on, *names), on, "left")


def threshold_label(ret: Column, buy: float = 5e-4, sell: float = -5e-4) -> Column:
    if buy <= 0 or sell >= 0:
        raise ValueError("buy must be positive and sell negative")
    return F.when(ret > buy, "BUY").when(ret < sell, "SELL").otherwise("NO_TRADE")


def risk_reward_label(
    ret: Column,
    pips: Column,
    mfe: Column,
    mae: Column,
    min_pips: float = 5.0,
    min_return: float = 0.0,
    ratio: float = 1.5,
    max_adverse_pips: float | None = None,
    pip_size: float = 1e-4,
) -> Column:
    """BUY or SELL when exactly one side moves far enough with enough reward per risk."""
    zero = F.lit(0.0)
    gain, pain = F.greatest(mfe, zero), F.greatest(mae, zero)

    def side(move, r, good, bad):
        enough = F.when(bad > 1e-12, good / bad >= ratio).otherwise((good > 0) | F.lit(ratio <= 0))
        ok = (move >= min_pips) & (r >= min_return) & enough
        if max_adverse_pips is not None:
            ok = ok & (bad / pip_size <= max_adverse_pips)
        return ok

    long_ok, short_ok = side(pips, ret, gain, pain), side(-pips, -ret, pain, gain)
    return (
        F.when(long_ok & ~short_ok, "BUY").when(short_ok & ~long_ok, "SELL").otherwise("NO_TRADE")
    )


def class_code(label: Column, classes=CLASSES) -> Column:
    out = F.lit(None).cast("long")
    for i, c in enumerate(classes):
        out = F.when(label == c, F.lit(i)).otherwise(out)
    return out.cast("long")


def leakage_violations(dataset: DataFrame) -> DataFrame:
    """Rows whose feature window reaches past the decision or whose label is not after it."""
    bad = (
        (C("window_end_idx") > C("decision_idx"))
        | (C("window_start_idx") > C("window_end_idx"))
        | (C("label_idx") <= C("decision_idx"))
    )
    return dataset.where(bad)


# --------------------------------------------------------------------------- splits


def chronological_split(
    df: DataFrame,
    keys=SERIES_KEYS,
    index: str = "sample_idx",
    train: float = 0.7,
    val: float = 0.15,
) -> DataFrame:
    """Add ``split`` from the sample position (0-based, contiguous per series)."""
    if not (0 < train < 1 and 0 <= val < 1 and train + val < 1):
        raise ValueError("need 0 < train < 1, 0 <= val < 1 and train + val < 1")
    n = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    t = S.attach(df, n, keys, index)
    n_train = F.greatest(F.floor(C("_n") * train), F.lit(1))
    n_val = F.floor(C("_n") * val)
    n_val = F.when(n_train + n_val >= C("_n"), F.greatest(C("_n") - n_train - 1, F.lit(0))).otherwise(
        n_val
    )
    t = t.withColumn(
        "split",
        F.when(C(index) < n_train, "train")
        .when(C(index) < n_train + n_val, "val")
        .otherwise("test"),
    )
    return t.drop("_n")


def walk_forward(
    df: DataFrame,
    keys=SERIES_KEYS,
    index: str = "sample_idx",
    n_folds: int = 5,
    rolling: bool = False,
    train_size: int | None = None,
    test_size: int | None = None,
) -> DataFrame:
    """One row per sample, fold and role. Fold limits are arithmetic, so no join is needed."""
    n = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    t = S.attach(df, n, keys, index)
    test = (
        F.lit(test_size)
        if test_size
        else F.greatest(F.floor(C("_n") / (n_folds + 1)), F.lit(1)).cast("long")
    )
    t = t.withColumn("_test", test)
    t = t.withColumn("_min", F.lit(train_size) if train_size else C("_test"))
    possible = F.greatest(F.floor((C("_n") - C("_min")) / C("_test")), F.lit(0))
    t = t.withColumn("_folds", F.least(F.lit(n_folds), possible))
    folds = []
    for f in range(n_folds):
        start = C("_min") + f * C("_test")
        begin = F.greatest(start - C("_min"), F.lit(0)) if rolling else F.lit(0)
        stop = F.least(start + C("_test"), C("_n"))
        role = F.when((C(index) >= begin) & (C(index) < start), "train").when(
            (C(index) >= start) & (C(index) < stop), "test"
        )
        one = F.struct(F.lit(f).cast("long").alias("fold"), role.alias("role"))
        folds.append(F.when((C("_folds") > f) & role.isNotNull(), one))
    t = t.withColumn("_f", F.explode(F.array_compact(F.array(*folds))))
    return t.select(*df.columns, "_f.fold", "_f.role")


def split_check(
    df: DataFrame, keys=SERIES_KEYS, index: str = "sample_idx", split: str = "split"
) -> DataFrame:
    """``ordered``: every train sample precedes every val sample, and val precedes test."""
    at = lambda fn, s: fn(F.when(C(split) == s, C(index)))
    t = df.groupBy(*keys).agg(
        *[F.count_if(C(split) == s).alias(f"n_{s}") for s in ("train", "val", "test")],
        at(F.max, "train").alias("_tr"),
        at(F.min, "val").alias("_v0"),
        at(F.max, "val").alias("_v1"),
        at(F.min, "test").alias("_te"),
        (F.count("*") == F.count_distinct(index)).alias("disjoint"),
    )
    before = lambda a, b: F.coalesce(a < b, F.lit(True))
    ok = before(C("_tr"), C("_v0")) & before(C("_v1"), C("_te")) & before(C("_tr"), C("_te"))
    return t.select(*keys, "n_train", "n_val", "n_test", "disjoint", ok.alias("ordered"))


# --------------------------------------------------------------------------- report


def melt(df: DataFrame, keys, columns) -> DataFrame:
    """Long form (keys, feature, value), a narrow transformation."""
    cells = [F.struct(F.lit(c).alias("feature"), C(c).cast("double").alias("value")) for c in columns]
    t = df.select(*keys, F.explode(F.array(*cells)).alias("e"))
    return t.select(*keys, "e.feature", "e.value")


def column_report(df: DataFrame, columns, keys=SERIES_KEYS) -> DataFrame:
    """Counts of missing and infinite values and basic statistics, one row per column."""
    t = melt(df, keys, columns)
    ok = ~F.isnan("value") & (F.abs("value") != float("inf"))
    v = F.when(ok, C("value"))
    stats = t.groupBy(*keys, "feature").agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.isnan("value") | C("value").isNull()).alias("nan_count"),
        F.count_if(F.abs("value") == float("inf")).alias("inf_count"),
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    )
    med = S.quantiles(t.withColumn("value", v), [*keys, "feature"], "value", {"median": 0.5})
    return stats.join(med, [*keys, "feature"], "left")


def class_balance(df: DataFrame, label: str = "target_cls_name", keys=SERIES_KEYS) -> DataFrame:
    n = df.groupBy(*keys, label).agg(F.count("*").alias("n"))
    total = n.groupBy(*keys).agg(F.sum("n").alias("_t"))
    return n.join(total, list(keys)).select(
        *keys, C(label).alias("class"), "n", (C("n") / C("_t")).alias("fraction")
    )


def dataset_checks(df: DataFrame, keys=SERIES_KEYS) -> DataFrame:
    """Rows, repeated decision times and leakage violations per series."""
    per_ts = df.groupBy(*keys, "ts").agg(
        F.count("*").alias("_n"),
        F.count_if(
            (C("window_end_idx") > C("decision_idx")) | (C("label_idx") <= C("decision_idx"))
        ).alias("_bad"),
    )
    return per_ts.groupBy(*keys).agg(
        F.sum("_n").alias("n_samples"),
        F.sum(C("_n") - 1).alias("duplicate_decision_times"),
        F.sum("_bad").alias("leakage_violations"),
    )


# --------------------------------------------------------------------------- preprocessing


def impute_values(train: DataFrame, features) -> dict[str, float]:
    """Median of the valid rows per gated feature (of all rows when none is valid).

    The result has one number per feature, so it is safe to hold on the driver.
    """
    pairs = [f for f in features if f"{f}_valid" in features and not f.endswith("_valid")]
    if not pairs:
        return {}
    cells = [
        F.struct(
            F.lit(f).alias("feature"),
            C(f).cast("double").alias("value"),
            (C(f"{f}_valid") >= 0.5).alias("ok"),
        )
        for f in pairs
    ]
    t = train.select(F.explode(F.array(*cells)).alias("e")).select("e.*")
    both = t.where("ok").withColumn("which", F.lit("valid")).unionByName(
        t.withColumn("which", F.lit("all"))
    )
    got = S.quantiles(both, ["feature", "which"], "value", {"median": 0.5}).collect()
    table = {(r["feature"], r["which"]): r["median"] for r in got}
    return {f: table.get((f, "valid"), table.get((f, "all"), 0.0)) for f in pairs}


def impute(df: DataFrame, values: dict[str, float]) -> DataFrame:
    """Replace features whose validity flag is off by the fitted value."""
    return df.withColumns(
        {f: F.when(C(f"{f}_valid") < 0.5, F.lit(v)).otherwise(C(f)) for f, v in values.items()}
    )


def encode(df: DataFrame, features, cyclic: bool = False, categories: bool = False):
    """Replace time features by sin/cos and signed categories by three flags: (df, features)."""
    names, out = list(features), {}
    if cyclic:
        for c in [c for c in CYCLES if c in names]:
            out |= cyclical(c)
            names.remove(c)
    if categories:
        for c in [c for c in SIGNED_CATEGORIES if c in names]:
            out |= one_hot(c)
            names.remove(c)
    return (df.withColumns(out) if out else df), [*names, *out]


def non_finite_count(df: DataFrame, features) -> int:
    bad = lambda c: C(c).isNull() | F.isnan(c) | (F.abs(C(c)) == float("inf"))
    row = df.agg(*[F.count_if(bad(c)).alias(c) for c in features]).first()
    return sum(row)


def fit_scaler(train: DataFrame, features, method: str = "standard") -> dict[str, tuple]:
    """(center, scale) per feature; one pass, population statistics."""
    if method == "none":
        return {f: (0.0, 1.0) for f in features}
    if method == "robust":
        q = S.quantiles(
            melt(train, [], features), ["feature"], "value", {"a": 0.25, "m": 0.5, "b": 0.75}
        ).collect()
        got = {r["feature"]: (r["m"], r["b"] - r["a"]) for r in q}
    elif method in ("standard", "minmax"):
        aggs = []
        for f in features:
            if method == "standard":
                aggs += [F.avg(f), F.stddev_pop(f)]
            else:
                aggs += [F.min(f), F.max(f)]
        row = train.agg(*aggs).first()
        got = {}
        for i, f in enumerate(features):
            a, b = row[2 * i], row[2 * i + 1]
            got[f] = (a, b) if method == "standard" else (a, b - a)
    else:
        raise ValueError(f"unknown scaler {method!r}")
    return {f: (c, s if s else 1.0) for f, (c, s) in got.items()}


def scale(df: DataFrame, fitted: dict[str, tuple], inverse: bool = False) -> DataFrame:
    if inverse:
        return df.withColumns({f: C(f) * s + c for f, (c, s) in fitted.items()})
    return df.withColumns({f: (C(f) - c) / s for f, (c, s) in fitted.items()})


# --------------------------------------------------------------------------- selection


def select_by_variance(train: DataFrame, features, threshold: float = 0.0) -> list[str]:
    row = train.agg(*[F.var_pop(f).alias(f) for f in features]).first()
    return [f for f in features if row[f] is not None and row[f] > threshold]


def select_by_correlation(train: DataFrame, features, threshold: float = 0.95) -> list[str]:
    """Keep the first of each correlated group; constants go. Only p x p numbers reach the driver."""
    names, corr, std = correlation_matrix(train, features)
    kept: list[int] = []
    for j in range(len(names)):
        if std[j] <= 1e-12:
            continue
        if all(abs(corr[i, j]) < threshold for i in kept):
            kept.append(j)
    return [names[j] for j in kept]


def select_k_best(
    train: DataFrame, features, target: str, k: int = 50, classification: bool = False
) -> list[str]:
    """Univariate F test (ANOVA for classes), via Spark's own selector."""
    from pyspark.ml.feature import UnivariateFeatureSelector, VectorAssembler

    v = VectorAssembler(inputCols=list(features), outputCol="_x").transform(train)
    picker = UnivariateFeatureSelector(featuresCol="_x", labelCol=target, outputCol="_y")
    picker = picker.setFeatureType("continuous").setSelectionThreshold(min(k, len(features)))
    picker = picker.setLabelType("categorical" if classification else "continuous")
    return [features[i] for i in sorted(picker.fit(v).selectedFeatures)]


def binned(df: DataFrame, columns, bins: int = 16) -> DataFrame:
    """Replace each column by the number of its quantile bin (``<col>_bin``)."""
    cuts = [i / bins for i in range(1, bins)]
    row = df.agg(*[F.percentile_approx(c, cuts, 10000).alias(c) for c in columns]).first()
    out = {}
    for c in columns:
        edges = sorted(set(row[c] or []))
        at = F.lit(0)
        for e in edges:
            at = at + F.when(C(c) > e, 1).otherwise(0)
        out[f"{c}_bin"] = at
    return df.withColumns(out)


def mutual_information(
    train: DataFrame, features, target: str, bins: int = 16, discrete_target: bool = False
) -> DataFrame:
    """Binned mutual information (nats) of each feature with the target.

    From joint bin counts: the estimator of the same quantity that a cluster can compute.
    """
    cols = [*features] if discrete_target else [*features, target]
    b = binned(train, cols, bins)
    y = C(target) if discrete_target else C(f"{target}_bin")
    cells = [F.struct(F.lit(f).alias("feature"), C(f"{f}_bin").alias("x")) for f in features]
    t = b.select(y.alias("y"), F.explode(F.array(*cells)).alias("e")).select("y", "e.*")
    joint = t.groupBy("feature", "x", "y").agg(F.count("*").alias("n"))
    nx = joint.groupBy("feature", "x").agg(F.sum("n").alias("nx"))
    ny = joint.groupBy("feature", "y").agg(F.sum("n").alias("ny"))
    nt = joint.groupBy("feature").agg(F.sum("n").alias("nt"))
    j = joint.join(nx, ["feature", "x"]).join(ny, ["feature", "y"]).join(nt, "feature")
    mi = F.sum(C("n") / C("nt") * F.ln(C("n") * C("nt") / (C("nx") * C("ny"))))
    return j.groupBy("feature").agg(F.greatest(mi, F.lit(0.0)).alias("mutual_information"))


def select_by_information(
    train: DataFrame, features, target: str, k: int = 50, discrete_target: bool = False
) -> list[str]:
    rows = mutual_information(train, features, target, discrete_target=discrete_target).collect()
    score = {r["feature"]: r["mutual_information"] for r in rows}
    best = sorted(features, key=lambda f: -score.get(f, 0.0))[:k]
    return [f for f in features if f in set(best)]


def select_recursively(
    train: DataFrame, features, target: str, k: int = 50, classification: bool = False
) -> list[str]:
    """Drop the feature with the smallest coefficient until ``k`` are left.

    For regression the rows are read once: every refit solves a sub-block of one Gram matrix.
    """
    names = list(features)
    if not classification:
        from sparkwick.operators.gram import gram_matrix

        g = gram_matrix(train, names, target)
        while len(names) > k:
            coef, _ = solve_normal(g, names)
            weakest = min(range(len(names)), key=lambda i: coef[i] ** 2)
            names.pop(weakest)
        return names
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    train = train.cache()
    while len(names) > k:
        v = VectorAssembler(inputCols=names, outputCol="_x").transform(train)
        lr = LogisticRegression(
            featuresCol="_x", labelCol=target, family="multinomial", standardization=False,
            regParam=1.0 / max(v.count(), 1), maxIter=200,
        )
        m = (lr.fit(v).coefficientMatrix.toArray() ** 2).sum(axis=0)
        names.pop(int(m.argmin()))
    train.unpersist()
    return names


# --------------------------------------------------------------------------- fitted preprocessing


@dataclass
class Preprocessor:
    """Impute, encode, scale and select as fitted on training rows; applied unchanged to others.

    ``expected`` are the input features in order and ``names`` the output ones; ``schema`` is the
    fingerprint that rows to be transformed must match.
    """

    expected: list[str]
    medians: dict[str, float]
    cyclic: bool
    categories: bool
    scaler: dict[str, tuple]
    names: list[str]

    @property
    def schema(self) -> str:
        return fingerprint(self.expected)

    def apply(self, df: DataFrame, features=None) -> DataFrame:
        """``df`` with the fitted steps applied; other columns pass through.

        ``features`` names the features of ``df`` in its order (those expected that it has, if not
        given); a missing, extra or reordered one raises.
        """
        if features is None:
            features = [c for c in df.columns if c in set(self.expected)]
        issues = schema_issues(self.expected, list(features))
        if issues:
            raise ValueError(f"features do not match the fitted schema: {issues}")
        out, encoded = encode(impute(df, self.medians), self.expected, self.cyclic, self.categories)
        out = scale(out, {f: self.scaler[f] for f in self.names})
        dropped = (set(self.expected) | set(encoded)) - set(self.names)
        return out.drop(*dropped)


def fit_preprocessor(
    train: DataFrame,
    features,
    scaler: str = "standard",
    cyclic: bool = False,
    categories: bool = False,
    max_correlation: float | None = None,
) -> Preprocessor:
    """Fit all steps on ``train`` alone. Constants, and with ``max_correlation`` all but the first
    of each correlated group, are left out."""
    features = list(features)
    medians = impute_values(train, features)
    rows, names = encode(impute(train, medians), features, cyclic, categories)
    rows = stage(rows.select(*names))
    fitted = fit_scaler(rows, names, scaler)
    if max_correlation is None:
        kept = select_by_variance(rows, names)
    else:
        kept = select_by_correlation(rows, names, max_correlation)
    return Preprocessor(features, medians, cyclic, categories, fitted, kept)


def sample_index(df: DataFrame, keys=SERIES_KEYS, order: str = "bar_idx") -> DataFrame:
    """0-based contiguous ``sample_idx`` by ``order``, without a whole-series window."""
    t = df.withColumn("_ib", F.floor(C(order) / 65536))
    t = S.scan(t, keys, [order], [S.Scan("sample_idx", "sum", F.lit(1))], "_ib").drop("_ib")
    return t.withColumn("sample_idx", C("sample_idx").cast("long") - 1)


def flat_dataset(
    features: DataFrame, targets: DataFrame, label: Column | None = None, classes=CLASSES
) -> DataFrame:
    """Features, targets, class code and name and meta columns in one wide table."""
    names = [c for c in targets.columns if c.startswith("target_reg_")]
    t = features.join(targets.select(*SERIES_KEYS, "ts", *names), [*SERIES_KEYS, "ts"])
    if label is not None:
        t = t.withColumn("target_cls_name", label)
        t = t.withColumn("target_cls", class_code(C("target_cls_name"), classes))
    return t
