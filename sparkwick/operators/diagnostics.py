"""Target, feature and residual diagnostics."""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwick.config import DEFAULT_LAYOUT, Layout
from sparkwick.functions.columns import clip, col
from sparkwick.operators import scan as S
from sparkwick.operators.dataset import melt
from sparkwick.operators.gram import correlation_matrix, gram_by_key

C = F.col
# Critical values of the unit-root statistic and verdict limits.
ADF_CRITICAL = {"1%": -3.43, "5%": -2.86, "10%": -2.57}
POOR_R2, MARGINAL_R2, TRIVIAL_R = 0.05, 0.15, 0.999
HIGH_CORRELATION, HIGH_VIF, LOW_VARIANCE, IMBALANCE = 0.95, 10.0, 1e-8, 0.99
PRICE_LEVELS = ("next_close", "next_open", "average_future_price", "future_midpoint")
RETURNS = (
    "next_return", "next_log_return", "expected_pip_movement", "expected_percentage_change",
)
DISPERSIONS = (
    "future_volatility", "future_atr", "future_range", "maximum_favorable_excursion",
    "maximum_adverse_excursion",
)


# --------------------------------------------------------------------------- targets


def profile(df: DataFrame, by, value) -> DataFrame:
    """Moments, exact quartiles, share of missing values and of outliers beyond 3 sigma."""
    by = list(by)
    v = col(value)
    v = F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
    t = df.select(*by, v.alias("v"))
    m = t.groupBy(*by).agg(
        F.count("v").alias("n_samples"),
        F.avg("v").alias("mean"),
        F.stddev_pop("v").alias("std"),
        F.var_pop("v").alias("variance"),
        F.min("v").alias("minimum"),
        F.max("v").alias("maximum"),
        F.skewness("v").alias("skewness"),
        F.kurtosis("v").alias("kurtosis"),
        (F.count_if(C("v").isNull()) / F.count("*") * 100.0).alias("missing_percentage"),
    )
    far = F.abs((C("v") - C("mean")) / C("std")) > 3
    out = S.attach(t, m.select(*by, "mean", "std"), by, "v").groupBy(*by).agg(
        (F.count_if((C("std") >= 1e-15) & far) / F.count("v") * 100.0).alias("outlier_percentage")
    )
    qs = S.quantiles(t, by, "v", {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return m.join(out, by).join(qs, by)


def unit_root(df: DataFrame, keys, value, layout: Layout = DEFAULT_LAYOUT) -> DataFrame:
    """Augmented Dickey-Fuller t statistic per series (``bar_idx`` orders it from 0).

    The design (constant, level, lagged differences) differs in width by series length; its
    cross products are summed in one pass and each small system is solved in its own task.
    """
    keys = list(keys)
    t = df.select(*keys, "bar_idx", col(value).alias("y"))
    n = t.groupBy(*keys).agg(F.count("*").alias("n"))
    lags = F.greatest(F.lit(1), F.floor(12 * F.pow(C("n") / 100, F.lit(0.25))))
    n = n.withColumn(
        "n_lags", F.least(lags, F.greatest(F.lit(1), F.floor(C("n") / 4))).cast("int")
    )
    most = n.agg(F.max("n_lags")).first()[0] or 1
    lay = replace(layout, keys=tuple(keys), back=max(layout.back, most + 2 + S.WARM))
    lay = replace(lay, chunk=max(lay.chunk, 2 * lay.back))
    x = S.extend(t, lay)
    w = S.bar_window(lay)
    prev = F.lag("y").over(w)
    x = x.withColumns({"_level": prev, "_dy": C("y") - prev})
    past = [F.lag("_dy", i).over(w) for i in range(1, most + 1)]
    names = [f"_d{i}" for i in range(1, most + 1)]
    x = S.core_rows(x.withColumns(dict(zip(names, past, strict=True)))).join(n, keys)
    # lags a shorter series does not use become zero columns
    used = {m: F.when(C("n_lags") >= i + 1, C(m)).otherwise(0.0) for i, m in enumerate(names)}
    x = x.where(C("bar_idx") >= C("n_lags") + 1).withColumns(used)
    g = gram_by_key(x, keys, ["_level", *names, "_dy"]).join(n, keys)

    @F.pandas_udf("adf_statistic double, n_effective long")
    def solve(flat: pd.Series, n_lags: pd.Series, size: pd.Series) -> pd.DataFrame:
        rows = []
        for a, p, m in zip(flat, n_lags, size, strict=True):
            full = np.asarray(a, dtype=float)
            k = int(round(math.sqrt(full.size)))
            full = full.reshape(k, k)
            keep = list(range(2 + int(p)))
            xx, xy, yy = full[np.ix_(keep, keep)], full[keep, -1], full[-1, -1]
            n_eff = full[0, 0]
            dof = n_eff - len(keep)
            if m < 20 or n_eff < 10 or dof <= 0:
                rows.append((None, int(n_eff) if m >= 20 else 0))
                continue
            inv = np.linalg.pinv(xx)
            b = inv @ xy
            s2 = max(yy - b @ xy, 0.0) / dof
            se = math.sqrt(max(s2 * inv[1, 1], 0.0))
            rows.append((float(b[1] / se) if se > 0 else None, int(n_eff)))
        return pd.DataFrame(rows, columns=["adf_statistic", "n_effective"])

    out = g.select(*keys, "n_lags", solve("g", "n_lags", "n").alias("r"))
    return out.select(
        *keys,
        "n_lags",
        "r.*",
        F.coalesce(C("r.adf_statistic") < ADF_CRITICAL["5%"], F.lit(False)).alias(
            "is_stationary_5pct"
        ),
    )


# --------------------------------------------------------------------------- features


def pearson(df: DataFrame, by, features, target: str) -> DataFrame:
    """Correlation of every feature with the target in one aggregation (0 for constants)."""
    cells = [F.struct(F.lit(f).alias("feature"), C(f).cast("double").alias("x")) for f in features]
    t = df.select(*by, C(target).alias("y"), F.explode(F.array(*cells)).alias("e"))
    flat = (F.stddev_pop("e.x") < 1e-15) | (F.stddev_pop("y") < 1e-15)
    r = F.when(flat, 0.0).otherwise(F.coalesce(F.nanvl(F.corr("e.x", "y"), F.lit(0.0)), F.lit(0.0)))
    return t.groupBy(*by, C("e.feature").alias("feature")).agg(r.alias("pearson"))


def average_ranks(df: DataFrame, keys, value: str) -> DataFrame:
    """Add ``rank`` (ties share their mean rank) of ``value`` within ``keys``.

    The join back is salted by the remaining columns, so one frequent value fills no task.
    """
    counts = S.value_counts(df, keys, value)
    ranks = counts.select(
        *keys, C("value").alias(value), (C("upto") - (C("n") - 1) / 2.0).alias("rank")
    )
    rest = [c for c in df.columns if c not in (*keys, value)]
    if not rest:
        return df.join(ranks, [*keys, value])
    salted = df.withColumn("_at", F.xxhash64(*rest))
    return S.attach(salted.where(C(value).isNotNull()), ranks, [*keys, value], "_at").drop("_at")


def spearman(df: DataFrame, by, features, target: str, row_id: str) -> DataFrame:
    """Rank correlation of every feature with the target."""
    by = list(by)
    long = melt(df, [*by, row_id], [*features, target])
    r = average_ranks(long, [*by, "feature"], "value").drop("value")
    y = r.where(C("feature") == target).select(*by, row_id, C("rank").alias("_y"))
    x = r.where(C("feature") != target)
    rho = F.coalesce(F.nanvl(F.corr("rank", "_y"), F.lit(0.0)), F.lit(0.0))
    return x.join(y, [*by, row_id]).groupBy(*by, "feature").agg(rho.alias("spearman"))


def inflation_factors(df: DataFrame, features) -> list[tuple[str, float | None]]:
    """Variance inflation factor of each feature from one correlation pass (None for constants)."""
    names, corr, std = correlation_matrix(df, features)
    live = [i for i in range(len(names)) if std[i] > 1e-10]
    out: dict[str, float | None] = dict.fromkeys(names)
    if live:
        r = corr[np.ix_(live, live)]
        np.fill_diagonal(r, 1.0)
        inv = np.diag(np.linalg.pinv(r, hermitian=True))
        for i, v in zip(live, inv, strict=True):
            out[names[i]] = float(min(max(v, 1.0), 1e9))
    return [(n, out[n]) for n in names]


def near_constant(df: DataFrame, by, features) -> DataFrame:
    """Features with almost no variance, or 0/1 features with an overwhelming majority."""
    t = melt(df, by, features)
    keys = [*by, "feature"]
    m = t.groupBy(*keys).agg(
        F.var_pop("value").alias("variance"),
        F.count("*").alias("_n"),
        F.count_if(C("value") == 0).alias("_zeros"),
        F.count_if(C("value") == 1).alias("_ones"),
    )
    binary = C("_zeros") + C("_ones") == C("_n")
    share = F.greatest("_zeros", "_ones") / C("_n")
    bad = (C("variance") < LOW_VARIANCE) | (binary & (share >= IMBALANCE))
    return m.select(
        *keys,
        "variance",
        binary.alias("is_binary"),
        F.when(binary, share).alias("majority_fraction"),
        bad.alias("near_constant"),
    )


def correlated_pairs(df: DataFrame, features, threshold: float = HIGH_CORRELATION) -> list[tuple]:
    """(a, b, r) with |r| at or above the threshold, strongest first."""
    names, corr, std = correlation_matrix(df, features)
    out = [
        (names[i], names[j], float(corr[i, j]))
        for i in range(len(names))
        for j in range(i + 1, len(names))
        if std[i] > 1e-10 and std[j] > 1e-10 and abs(corr[i, j]) >= threshold
    ]
    return sorted(out, key=lambda t: -abs(t[2]))


def feature_findings(df: DataFrame, features, target: str, bins: int = 16) -> DataFrame:
    """Coded findings per feature: near_constant, redundant, high_vif, low_information."""
    from sparkwick.operators.dataset import mutual_information

    spark = df.sparkSession
    mi = {
        r["feature"]: r["mutual_information"]
        for r in mutual_information(df, features, target, bins).collect()
    }
    r = {x["feature"]: x["pearson"] for x in pearson(df, [], features, target).collect()}
    const = {
        x["feature"] for x in near_constant(df, [], features).where("near_constant").collect()
    }
    found = [(f, "near_constant", None, None) for f in features if f in const]
    for a, b, c in correlated_pairs(df, features):
        weak, strong = (a, b) if mi.get(a, 0.0) < mi.get(b, 0.0) else (b, a)
        found.append((weak, "redundant", strong, c))
    found += [(f, "high_vif", None, v) for f, v in inflation_factors(df, features) if v and v > HIGH_VIF]
    for f in features:
        if f not in const and abs(r.get(f, 0.0)) < 0.02 and mi.get(f, 0.0) < 0.01:
            found.append((f, "low_information", None, mi.get(f, 0.0)))
    return spark.createDataFrame(found, "feature string, code string, other string, value double")


# --------------------------------------------------------------------------- residuals


def normal_quantile(p: Column) -> Column:
    """Inverse of the normal distribution (rational approximation, error below 1.2e-9)."""
    # Published coefficients of the approximation.
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
         1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
         6.680131188771972e01, -1.328068155288572e01, 1.0)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
         -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
         3.754408661907416e00, 1.0)

    def horner(coeffs, x):
        out = F.lit(coeffs[0])
        for k in coeffs[1:]:
            out = out * x + k
        return out

    lo = F.sqrt(-2.0 * F.ln(F.least(p, 1.0 - p)))
    tail = horner(c, lo) / horner(d, lo)
    x = p - 0.5
    mid = horner(a, x * x) * x / horner(b, x * x)
    return F.when(p < 0.02425, tail).when(p > 1 - 0.02425, -tail).otherwise(mid)


def qq_correlation(df: DataFrame, by, value) -> DataFrame:
    """Correlation of sorted residuals with normal quantiles.

    Equal values form a run of plotting positions. A run is cut into blocks that are spread over
    the tasks before they are expanded, so one very frequent value does not end in one task.
    """
    by = list(by)
    counts = S.value_counts(df, by, value)
    total = counts.groupBy(*by).agg(F.sum("n").alias("_t"))
    t = S.attach(counts, total, by, "value")
    first = C("upto") - C("n") + 1
    block = 4096
    t = t.withColumn("_b", F.explode(F.sequence(F.lit(0), F.floor((C("n") - 1) / block))))
    t = t.repartition(*by, "value", "_b")
    start = first + C("_b") * block
    t = t.withColumn("_k", F.explode(F.sequence(start, F.least(C("upto"), start + block - 1))))
    z = normal_quantile((C("_k") - 0.5) / C("_t"))
    r = F.corr("value", z)
    ok = (F.count("*") >= 3) & (F.stddev_pop("value") >= 1e-15)
    return t.groupBy(*by).agg(
        F.when(ok, r).alias("qq_correlation"), F.count("*").alias("n_points")
    )


def normality(df: DataFrame, by, value) -> DataFrame:
    """Jarque-Bera statistic with its chi-squared(2) p-value."""
    v = col(value)
    stat = F.count(v) / 6.0 * (
        F.skewness(v) * F.skewness(v) + F.kurtosis(v) * F.kurtosis(v) / 4.0
    )
    return df.groupBy(*by).agg(
        stat.alias("jarque_bera"),
        F.exp(-stat / 2.0).alias("p_value"),
        (F.exp(-stat / 2.0) > 0.05).alias("is_normal_5pct"),
    )


def chi2_1_tail(x: Column) -> Column:
    """P(chi-squared(1) > x) by a rational approximation of erfc (error below 1.2e-7)."""
    z = F.sqrt(x / 2.0)
    t = 1.0 / (1.0 + 0.5 * z)
    # Published coefficients of the approximation.
    poly = (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806,
            0.09678418, 0.37409196, 1.00002368, -1.26551223)
    s = F.lit(poly[0])
    for k in poly[1:]:
        s = s * t + k
    return t * F.exp(-z * z + s)


def heteroscedasticity(df: DataFrame, by, residual, fitted) -> DataFrame:
    """Breusch-Pagan test with the fitted value as the only regressor."""
    e2 = col(residual) * col(residual)
    f = col(fitted)
    r2 = F.coalesce(F.regr_r2(e2, f), F.lit(0.0))
    flat = F.var_pop(e2) * F.count("*") <= 1e-12
    lm = F.count("*") * F.when(flat, 0.0).otherwise(
        F.least(F.greatest(r2, F.lit(0.0)), F.lit(1 - 1e-12))
    )
    t = df.groupBy(*by).agg(lm.alias("lm_statistic"))
    t = t.withColumn("lm_pvalue", chi2_1_tail(C("lm_statistic")))
    return t.withColumn("is_heteroscedastic_5pct", C("lm_pvalue") < 0.05)


def serial_correlation(
    df: DataFrame, keys, residual, max_lag: int = 10, layout: Layout = DEFAULT_LAYOUT
) -> DataFrame:
    """Durbin-Watson and autocorrelations per series (``bar_idx`` orders it)."""
    keys = list(keys)
    t = df.select(*keys, "bar_idx", col(residual).alias("e"))
    mean = t.groupBy(*keys).agg(F.avg("e").alias("_m"))
    t = S.attach(t, mean, keys, "bar_idx")
    lay = replace(layout, keys=tuple(keys), back=max(layout.back, max_lag + S.WARM))
    x = S.extend(t, lay)
    w = S.bar_window(lay)
    x = x.withColumns({f"_e{i}": F.lag("e", i).over(w) for i in range(1, max_lag + 1)})
    x = S.core_rows(x)
    step = C("e") - C("_e1")
    dev = lambda c: C(c) - C("_m")
    var = F.sum(dev("e") * dev("e"))
    dw = F.when(F.sum(C("e") * C("e")) >= 1e-15, F.sum(step * step) / F.sum(C("e") * C("e")))
    acf = {
        f"acf_{i}": F.when(
            F.count("*") > i,
            F.when(var > 0, F.coalesce(F.sum(dev("e") * dev(f"_e{i}")), F.lit(0.0)) / var).otherwise(0.0),
        )
        for i in range(1, max_lag + 1)
    }
    return x.groupBy(*keys).agg(dw.alias("durbin_watson"), *[v.alias(k) for k, v in acf.items()])


# Regimes of the residual breakdown; a row can be in several.
def regime_conditions() -> dict[str, Column]:
    trending = (C("trend_strength") >= 0.5) & (C("trend_direction") != 0)
    return {
        "trending": trending,
        "ranging": ~trending,
        "high_volatility": C("vol_expansion") >= 1.0,
        "low_volatility": C("vol_compression") >= 1.0,
        "london_session": C("session_is_london") >= 1.0,
        "newyork_session": C("session_is_newyork") >= 1.0,
        "asian_session": C("session_is_asian") >= 1.0,
        "sydney_session": C("session_is_sydney") >= 1.0,
    }


def regime_breakdown(df: DataFrame, by, residual, min_samples: int = 10) -> DataFrame:
    tags = [F.when(cond, F.lit(n)) for n, cond in regime_conditions().items()]
    e = col(residual)
    t = df.select(*by, e.alias("e"), F.explode(F.array_compact(F.array(*tags))).alias("regime"))
    enough = F.count("*") >= min_samples
    return t.groupBy(*by, "regime").agg(
        F.count("*").alias("n_samples"),
        F.when(enough, F.avg(F.abs("e"))).alias("mae"),
        F.when(enough, F.sqrt(F.avg(C("e") * C("e")))).alias("rmse"),
    )


# --------------------------------------------------------------------------- verdicts


def target_suitability(facts: DataFrame) -> DataFrame:
    """Verdict and reason codes from one row of facts per target.

    Needs target, r2, cv_mean_r2, max_abs_pearson, max_mutual_information, n_high_vif,
    is_stationary, is_heteroscedastic and is_normal.
    """
    r2 = F.coalesce("cv_mean_r2", "r2")
    verdict = F.when(r2.isNull() | (r2 < POOR_R2), "poor").when(r2 < MARGINAL_R2, "marginal")
    verdict = verdict.otherwise("suitable")
    t = facts.withColumn("verdict", verdict)
    level = C("target").isin(*PRICE_LEVELS)
    trivial = level & (C("max_abs_pearson") > TRIVIAL_R)
    weak = C("verdict") != "suitable"
    code = lambda cond, name: F.when(cond, F.lit(name))
    reasons = F.array_compact(
        F.array(
            code(trivial, "trivial_price_level"),
            code(weak, "low_r2"),
            code(
                weak & (C("max_abs_pearson") < 0.05) & (C("max_mutual_information") < 0.01),
                "no_feature_signal",
            ),
            code(
                weak & (C("n_high_vif") > 0) & (C("max_abs_pearson") >= 0.05), "multicollinearity"
            ),
            code(weak & ~C("is_stationary"), "non_stationary"),
            code(C("is_heteroscedastic"), "heteroscedastic"),
            code(~C("is_normal"), "non_normal"),
        )
    )
    advice = (
        F.when(trivial, "use_return_target")
        .when(C("verdict") == "suitable", F.lit(None))
        .when(C("target").isin(*RETURNS), "classify_direction")
        .when(C("target").isin(*DISPERSIONS), "log_transform")
        .when(level, "use_return_target")
        .otherwise("feature_driven")
    )
    return t.withColumns({"reasons": reasons, "suggestion": advice})


def model_scores(t: DataFrame) -> DataFrame:
    """0-100 scores per model row.

    Needs train_r2, holdout_r2, cv_mean_r2, cv_std_r2, non_constant_fraction and
    mean_abs_correlation.
    """
    one = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    gap = C("train_r2") - C("holdout_r2")
    both_bad = (C("train_r2") <= 0) & (C("holdout_r2") <= 0)
    known = C("cv_mean_r2").isNotNull() & C("cv_std_r2").isNotNull()
    steady = 1.0 - F.least(C("cv_std_r2") / 0.5, F.lit(1.0))
    signal = F.least(C("mean_abs_correlation") / 0.15, F.lit(1.0))
    t = t.withColumns(
        {
            "generalization_score": F.when(both_bad, 60.0).otherwise(100.0 * (1.0 - one(gap / 0.5))),
            "cross_validation_score": F.when(
                known, clip(60.0 * one(C("cv_mean_r2")) + 40.0 * steady)
            ).otherwise(60.0),
            "feature_quality_score": clip(50.0 * C("non_constant_fraction") + 50.0 * signal),
            "target_reliability": 100.0 * one(F.coalesce("cv_mean_r2", "holdout_r2")),
        }
    )
    parts = ["generalization_score", "cross_validation_score", "feature_quality_score"]
    mean = (C(parts[0]) + C(parts[1]) + C(parts[2]) + C("target_reliability")) / 4.0
    return t.withColumn("model_health_score", clip(mean))


