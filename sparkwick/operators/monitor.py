"""Model monitoring: drift, calibration, health, retraining and lifecycle, keyed by model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwick.functions.columns import clip, safe_divide
from sparkwick.operators import metrics as M
from sparkwick.operators import scan as S
from sparkwick.operators.gram import gram_by_key
from sparkwick.sources.staging import stage

C = F.col
EPS = 1e-12
# Severity limits, health weights, metric directions and severities.
SEVERITY = ((0.15, "low"), (0.35, "moderate"), (0.6, "high"))
HEALTH_WEIGHTS = {
    "prediction_accuracy": 0.2, "prediction_stability": 0.1, "confidence_calibration": 0.1,
    "feature_drift": 0.15, "target_drift": 0.08, "residual_drift": 0.08, "rolling_error": 0.1,
    "market_regime_change": 0.09, "training_age": 0.05, "prediction_coverage": 0.05,
}
LOWER_IS_BETTER = ("rmse", "mae", "mape", "log_loss", "brier_score", "calibration_error")
HIGHER_IS_BETTER = (
    "r2", "explained_variance", "accuracy", "balanced_accuracy", "f1", "roc_auc", "pr_auc",
)
SEVERITY_ORDER = {"info": 0, "warning": 1, "critical": 2}


def severity_label(x: Column) -> Column:
    out = F.lit("severe")
    for limit, name in reversed(SEVERITY):
        out = F.when(x < limit, name).otherwise(out)
    return out


# --------------------------------------------------------------------------- regimes

REGIMES = ("trend_state", "volatility_state", "session", "liquidity_state")


def classify_regime(df: DataFrame, strength: float = 0.5) -> DataFrame:
    strong, d = C("trend_strength") >= strength, C("trend_direction")
    session = F.lit("none")
    for s in ("newyork", "london", "asian", "sydney"):
        session = F.when(C(f"session_is_{s}") >= 1, s).otherwise(session)
    wide = (C("spread_spike") >= 1) | (C("spread_percentile") >= 0.9)
    return df.withColumns(
        {
            "trend_state": F.when((d > 0) & strong, "trending_up")
            .when((d < 0) & strong, "trending_down")
            .otherwise("ranging"),
            "volatility_state": F.when(C("vol_expansion") >= 1, "high_volatility")
            .when(C("vol_compression") >= 1, "low_volatility")
            .otherwise("normal"),
            "session": session,
            "liquidity_state": F.when(wide, "widened_spread").otherwise("normal"),
        }
    )


def _shares(df: DataFrame, by, name: str) -> DataFrame:
    cells = [F.struct(F.lit(d).alias("dimension"), C(d).alias("state")) for d in REGIMES]
    t = df.select(*by, F.explode(F.array(*cells)).alias("e")).select(*by, "e.*")
    n = t.groupBy(*by, "dimension", "state").agg(F.count("*").alias("n"))
    total = n.groupBy(*by, "dimension").agg(F.sum("n").alias("t"))
    return n.join(total, [*by, "dimension"]).select(
        *by, "dimension", "state", (C("n") / C("t")).alias(name)
    )


def regime_drift(baseline: DataFrame, live: DataFrame, by, threshold: float = 0.3) -> DataFrame:
    """Total variation distance per dimension between two regime tables."""
    by = list(by)
    on = [*by, "dimension", "state"]
    both = _shares(baseline, by, "p").join(_shares(live, by, "q"), on, "full_outer")
    p, v = F.coalesce("p", F.lit(0.0)), F.coalesce("q", F.lit(0.0))
    shift = F.sum(F.abs(p - v)) / 2.0
    return both.groupBy(*by, "dimension").agg(
        shift.alias("shift"),
        (shift > threshold).alias("differs"),
        F.max_by("state", F.struct(v.alias("q"), C("state"))).alias("dominant_state"),
    )


# --------------------------------------------------------------------------- distributions


def ks_test(baseline: DataFrame, live: DataFrame, keys, value: str = "value") -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic and asymptotic p-value (null for a key that only
    one side has)."""
    keys = list(keys)
    one, zero = F.lit(1), F.lit(0)
    b = baseline.select(*keys, C(value), one.alias("b"), zero.alias("l"))
    both = b.unionByName(live.select(*keys, C(value), zero.alias("b"), one.alias("l")))
    t = S.value_counts(both, keys, value, {"b": C("b"), "l": C("l")})
    n = t.groupBy(*keys).agg(F.sum("b").alias("nb"), F.sum("l").alias("nl"))
    t = S.attach(t, n, keys, "value")
    gap = F.abs(F.try_divide("b_upto", "nb") - F.try_divide("l_upto", "nl"))
    t = t.groupBy(*keys).agg(
        F.max(gap).alias("ks_statistic"), F.max("nb").alias("nb"), F.max("nl").alias("nl")
    )
    lam = F.sqrt(C("nb") * C("nl") / (C("nb") + C("nl"))) * C("ks_statistic")
    tail = F.lit(0.0)
    for j in range(1, 51):
        tail = tail + F.exp(-2.0 * j * j * lam * lam) * (2.0 if j % 2 else -2.0)
    p = F.when(lam < 0.2, 1.0).when(lam.isNotNull(), clip(tail, 0.0, 1.0))
    return t.select(*keys, "ks_statistic", p.alias("ks_pvalue"))


def psi(baseline: DataFrame, live: DataFrame, keys, value: str = "value", bins: int = 10):
    """Population stability index over the baseline's exact quantile bins."""
    keys = list(keys)
    fr = {f"e{i}": i / bins for i in range(bins + 1)}
    edges = S.quantiles(baseline, keys, value, fr)
    edges = stage(edges.select(*keys, F.array_distinct(F.array(*fr)).alias("edges")))

    def counts(df: DataFrame, name: str) -> DataFrame:
        t = S.attach(df.select(*keys, C(value).alias("v")), edges, keys, "v")
        below = F.size(F.filter("edges", lambda e: e <= C("v")))
        last = F.size("edges") - 1
        inside = (C("v") >= F.element_at("edges", 1)) & (C("v") <= F.element_at("edges", -1))
        t = t.where(inside).select(*keys, F.least(below, last).alias("bin"))
        return t.groupBy(*keys, "bin").agg(F.count("*").alias(name))

    grid = edges.where(F.size("edges") >= 2).select(
        *keys, F.explode(F.sequence(F.lit(1), F.size("edges") - 1)).alias("bin")
    )
    t = grid.join(counts(baseline, "nb"), [*keys, "bin"], "left")
    t = t.join(counts(live, "nl"), [*keys, "bin"], "left").fillna(0, ["nb", "nl"])
    total = t.groupBy(*keys).agg(F.sum("nb").alias("tb"), F.sum("nl").alias("tl"))
    share = lambda n, d: F.greatest(C(n) / F.greatest(C(d), F.lit(1)), F.lit(EPS))
    p, r = share("nb", "tb"), share("nl", "tl")
    score = t.join(total, keys).groupBy(*keys).agg(F.sum((r - p) * F.ln(r / p)).alias("psi"))
    return edges.select(*keys).join(score, keys, "left").fillna(0.0, ["psi"])


def _moments(df: DataFrame, keys, value, prefix) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.avg(value).alias(f"{prefix}_mean"),
        F.stddev_pop(value).alias(f"{prefix}_std"),
        F.count(value).alias(f"{prefix}_n"),
        (F.min(value) != F.max(value)).alias(f"{prefix}_varies"),
    )


def _third(x: Column) -> Column:
    return F.least(x / 3.0, F.lit(1.0))


def distribution_shift(baseline: DataFrame, live: DataFrame, keys, value: str = "value"):
    """Mean and spread shift, KS statistic and severity of a target or residual series."""
    keys = list(keys)
    live_side = _moments(live, keys, value, "live")
    t = _moments(baseline, keys, value, "baseline").join(live_side, keys, "full")
    t = t.join(ks_test(baseline, live, keys, value), keys, "left")
    unit = F.when(C("baseline_std") > EPS, C("baseline_std")).otherwise(1.0)
    ks = F.when(C("live_varies"), C("ks_statistic")).otherwise(0.0)
    t = t.withColumns(
        {
            "mean_shift": F.abs(C("live_mean") - C("baseline_mean")) / unit,
            "variance_shift": F.abs(C("live_std") - C("baseline_std")) / unit,
            "ks_statistic": ks,
            "ks_pvalue": F.when(C("live_varies"), C("ks_pvalue")).otherwise(1.0),
        }
    )
    sev = clip(
        0.45 * _third(C("mean_shift")) + 0.25 * _third(C("variance_shift")) + 0.3 * C("ks_statistic"),
        0.0,
        1.0,
    )
    return t.withColumn("severity", sev).withColumn("severity_label", severity_label(C("severity")))


def feature_drift(
    baseline: DataFrame, live: DataFrame, by, outlier_z: float = 3.0, valid: str | None = None
) -> DataFrame:
    """Drift per feature; both inputs are long (by, feature, value[, valid]).

    ``presence`` tells features that both sides have from those missing in the live rows (all
    missing, full drift) and those unexpected there (listed without figures: there is nothing to
    compare them with).
    """
    keys = [*by, "feature"]
    z = F.abs((C("value") - C("train_mean")) / C("_unit")) > outlier_z
    base = _moments(baseline, keys, "value", "train")
    base = base.withColumn("_unit", F.when(C("train_std") < EPS, 1.0).otherwise(C("train_std")))
    missing = F.avg(F.when(C(valid), 0.0).otherwise(1.0)) if valid else F.lit(0.0)
    facts = base.select(*keys, "train_mean", "_unit")
    names = live.select(*keys).distinct().withColumn("_live", F.lit(True))
    seen = S.attach(live, facts, keys, "value").groupBy(*keys).agg(
        F.avg("value").alias("live_mean"),
        F.stddev_pop("value").alias("live_std"),
        (F.min("value") != F.max("value")).alias("_varies"),
        F.avg(F.when(z, 1.0).otherwise(0.0)).alias("outlier_frequency"),
        missing.alias("missing_frequency"),
    )
    t = base.withColumn("_base", F.lit(True)).join(names, keys, "full").join(seen, keys, "left")
    t = t.join(psi(baseline, live, keys), keys, "left")
    t = t.join(ks_test(baseline, live, keys), keys, "left")
    gone = C("_live").isNull()
    t = t.withColumns(
        {
            "mean_shift": F.abs(C("live_mean") - C("train_mean")) / C("_unit"),
            "variance_shift": F.abs(C("live_std") - C("_unit")) / C("_unit"),
            "ks_statistic": F.when(C("_varies"), C("ks_statistic")).otherwise(0.0),
            "ks_pvalue": F.when(C("_varies"), C("ks_pvalue")).otherwise(1.0),
        }
    )
    score = clip(
        0.3 * _third(C("mean_shift"))
        + 0.2 * _third(C("variance_shift"))
        + 0.25 * F.least(C("psi") / 0.25, F.lit(1.0))
        + 0.1 * C("outlier_frequency")
        + 0.15 * C("missing_frequency"),
        0.0,
        1.0,
    )
    zero = lambda c: F.when(gone, 0.0).otherwise(C(c)).alias(c)
    return t.select(
        *keys,
        "train_mean",
        C("_unit").alias("train_std"),
        *[zero(c) for c in ("live_mean", "live_std", "mean_shift", "variance_shift", "psi")],
        zero("ks_statistic"),
        "ks_pvalue",
        zero("outlier_frequency"),
        F.when(gone, 1.0).otherwise(C("missing_frequency")).alias("missing_frequency"),
        F.when(gone, 1.0).when(C("_base"), score).alias("drift_score"),
        F.when(gone, "missing").when(C("_base"), "both").otherwise("unexpected").alias("presence"),
    )


def correlation_drift(baseline: DataFrame, live: DataFrame, by, features) -> DataFrame:
    """Half the mean absolute difference of the two correlation matrices, per key."""
    by, p = list(by), len(list(features)) + 1

    def corr(df: DataFrame, name: str) -> DataFrame:
        means = df.groupBy(*by).agg(*[F.avg(f).alias(f"_m_{f}") for f in features])
        c = df.join(means, by).select(*by, *[(C(f) - C(f"_m_{f}")).alias(f) for f in features])
        g = gram_by_key(c, by, features)
        at = lambda i, j: F.get("g", F.lit(i * p + j))
        out = []
        for i in range(1, p):
            for j in range(i + 1, p):
                d = F.sqrt(at(i, i) * at(j, j))
                out.append(F.when(d > 0, at(i, j) / d).otherwise(0.0))
        return g.select(*by, F.array(*out).alias(name))

    t = corr(baseline, "a").join(corr(live, "b"), by)
    gap = F.aggregate(
        F.zip_with("a", "b", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x
    )
    return t.select(*by, (gap / F.greatest(F.size("a"), F.lit(1)) / 2.0).alias("correlation_drift"))


def drift_summary(per_feature: DataFrame, corr: DataFrame, by, top: int = 10) -> DataFrame:
    """Overall feature drift severity and the most drifted features (unexpected ones aside)."""
    by = list(by)
    per_feature = per_feature.where(C("drift_score").isNotNull())
    m = per_feature.groupBy(*by).agg(F.avg("drift_score").alias("_m"))
    w = Window.partitionBy(*by).orderBy(C("drift_score").desc(), "feature")
    best = per_feature.withColumn("_r", F.row_number().over(w)).where(C("_r") <= top)
    best = best.groupBy(*by).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_r", "feature"))), lambda s: s["feature"]).alias("most_drifted")
    )
    t = m.join(corr, by, "left").join(best, by)
    cd = F.coalesce("correlation_drift", F.lit(0.0))
    sev = clip(0.8 * C("_m") + 0.2 * F.least(cd * 2.0, F.lit(1.0)), 0.0, 1.0)
    t = t.withColumn("overall_severity", sev)
    return t.select(
        *by,
        cd.alias("correlation_drift"),
        "overall_severity",
        severity_label(C("overall_severity")).alias("severity_label"),
        "most_drifted",
    )


def combined_severity(*parts: Column) -> Column:
    """Mean of the parts that are present; null if none is."""
    num = sum(F.coalesce(p, F.lit(0.0)) for p in parts)
    return F.try_divide(num, sum(F.when(p.isNotNull(), 1.0).otherwise(0.0) for p in parts))


# --------------------------------------------------------------------------- predictions


def resolve(predictions: DataFrame, candles: DataFrame, series=("symbol", "timeframe")):
    """(resolved, pending): predictions whose horizon has passed, with the close then.

    ``predictions`` needs the series keys, decision_idx and horizon; candles need bar_idx.
    """
    series = list(series)
    out = candles.select(*series, C("bar_idx").alias("_end"), C("close").alias("outcome_close"))
    p = predictions.withColumn("_end", C("decision_idx") + C("horizon"))
    done = p.join(out, [*series, "_end"])
    pending = p.join(out, [*series, "_end"], "left_anti")
    return done.drop("_end"), pending.drop("_end")


def outcome_columns(
    task: str, y="actual", p="pred", probs="probs", tolerance: float | None = None
) -> dict[str, Column]:
    """``error`` and ``is_correct`` of a resolved prediction."""
    if task == "classification":
        miss = 1.0 - F.coalesce(F.element_at(C(probs), C(y)), F.lit(0.0))
        return {"error": miss, "is_correct": C(p) == C(y)}
    e = C(y) - C(p)
    ok = F.abs(e) <= tolerance if tolerance is not None else (C(p) >= 0) == (C(y) >= 0)
    return {"error": e, "is_correct": ok}


def coverage(resolved: DataFrame, pending: DataFrame, by) -> DataFrame:
    r = resolved.groupBy(*by).agg(F.count("*").alias("n_resolved"))
    p = pending.groupBy(*by).agg(F.count("*").alias("n_pending"))
    t = r.join(p, list(by), "full_outer").fillna(0, ["n_resolved", "n_pending"])
    return t.withColumn("coverage", C("n_resolved") / (C("n_resolved") + C("n_pending")))


def recent(df: DataFrame, by, order, n: int) -> DataFrame:
    """The last ``n`` rows per key (cut per task before the shuffle)."""
    w = Window.partitionBy(*by).orderBy(*[C(o).desc() for o in order])
    return df.withColumn("recency", F.row_number().over(w)).where(C("recency") <= n)


def snapshot_issues(t: DataFrame) -> DataFrame:
    """Array of failing-rule codes per logged prediction."""
    code = lambda cond, name: F.when(cond, F.lit(name))
    is_reg, is_cls = C("task_type") == "regression", C("task_type") == "classification"
    total = F.aggregate(F.map_values("probs"), F.lit(0.0), lambda a, x: a + x)
    empty = C("probs").isNull() | (F.size("probs") == 0)
    issues = F.array_compact(
        F.array(
            code(~(is_reg | is_cls), "task_type"),
            code(F.size("feature_vector") != F.size("feature_names"), "feature_length"),
            code((C("confidence") < 0) | (C("confidence") > 100), "confidence_range"),
            code(C("horizon") < 1, "horizon"),
            code(is_reg & C("predicted_value").isNull(), "no_value"),
            code(is_cls & C("predicted_class").isNull(), "no_class"),
            code(is_cls & empty, "no_probabilities"),
            code(is_cls & ~empty & (F.abs(total - 1.0) > 1e-6), "probability_sum"),
        )
    )
    return t.withColumn("issues", issues)


def profit_factor(df: DataFrame, by, y="actual", p="pred", pip: float = 1e-4) -> DataFrame:
    """Gains over losses of trading the predicted sign, and expected against actual pips."""
    pnl = F.signum(C(p)) * C(y)
    gains, losses = F.sum(F.when(pnl > 0, pnl).otherwise(0.0)), F.sum(F.when(pnl < 0, -pnl).otherwise(0.0))
    inf = F.lit(float("inf"))
    factor = F.when((gains == 0) & (losses == 0), F.lit(None)).when(losses == 0, inf).otherwise(gains / losses)
    r = F.coalesce(F.nanvl(F.corr(p, y), F.lit(0.0)), F.lit(0.0))
    return df.groupBy(*by).agg(
        factor.alias("profit_factor"),
        (F.avg(p) / pip).alias("expected_mean_pips"),
        (F.avg(y) / pip).alias("actual_mean_pips"),
        (F.stddev_pop(p) / pip).alias("expected_std_pips"),
        (F.stddev_pop(y) / pip).alias("actual_std_pips"),
        r.alias("correlation"),
    )


def performance(df: DataFrame, by, order, window: int = 200, task="regression", **cols) -> DataFrame:
    """Metrics over the last ``window`` predictions next to those over all of them."""
    fn = M.regression_metrics if task == "regression" else M.all_classification_metrics
    both = []
    for name, part in (("historical", df), ("rolling", recent(df, by, order, window))):
        both.append(fn(part, by, **cols).withColumn("scope", F.lit(name)))
    return both[0].unionByName(both[1])


# --------------------------------------------------------------------------- calibration


def confidence_buckets(df: DataFrame, by, buckets: int = 10) -> DataFrame:
    """Mean confidence against observed accuracy per 0-100 bucket."""
    t = df.where(C("is_correct").isNotNull())
    b = F.lit(0)
    for i in range(1, buckets):
        b = b + F.when(C("confidence") >= i * (100.0 / buckets), 1).otherwise(0)
    hit = F.when(C("is_correct"), 100.0).otherwise(0.0)
    return t.groupBy(*by, b.cast("long").alias("bucket")).agg(
        F.count("*").alias("n_samples"),
        F.avg("confidence").alias("mean_confidence"),
        F.avg(hit).alias("observed_accuracy"),
        (F.avg("confidence") - F.avg(hit)).alias("gap"),
    )


def calibration(df: DataFrame, by, limit: float = 10.0, buckets: int = 10) -> DataFrame:
    b = confidence_buckets(df, by, buckets)
    n = C("n_samples")
    mean = lambda c: F.sum(n * C(c)) / F.sum(n)
    t = b.groupBy(*by).agg(
        mean("mean_confidence").alias("mean_confidence"),
        mean("observed_accuracy").alias("observed_accuracy"),
        (F.sum(n * F.abs("gap")) / F.sum(n) / 100.0).alias("calibration_error"),
        F.sum(n).alias("n_samples"),
    )
    gap = C("mean_confidence") - C("observed_accuracy")
    status = F.when(gap > limit, "overconfident").when(gap < -limit, "underconfident")
    return t.withColumn("status", status.otherwise("well_calibrated"))


def calibration_drift(baseline: DataFrame, live: DataFrame, by) -> DataFrame:
    a = baseline.select(*by, C("calibration_error").alias("a"))
    return live.select(*by, C("calibration_error").alias("b")).join(a, list(by)).select(
        *by, F.abs(C("b") - C("a")).alias("calibration_drift")
    )


# --------------------------------------------------------------------------- health


def stability(df: DataFrame, by, order, window: int = 200, chunks: int = 4) -> DataFrame:
    """100 x (1 - variation of the mean error over consecutive parts of the recent predictions).

    ``df`` needs ``miss``: the absolute error, or 0/1 for a wrong class.
    """
    by = list(by)
    t = recent(df, by, order, window)
    n = t.groupBy(*by).agg(F.count("*").alias("_n"))
    t = t.join(n, by)
    size = F.floor(C("_n") / chunks)
    t = t.withColumn("_part", F.floor((C("_n") - C("recency")) / F.greatest(size, F.lit(1))))
    c = t.where((C("_part") < chunks) & C("miss").isNotNull()).groupBy(*by, "_n", "_part").agg(
        F.avg("miss").alias("m")
    )
    c = c.groupBy(*by, "_n").agg(
        F.avg("m").alias("_avg"), F.stddev_pop("m").alias("_sd"), F.count("*").alias("_k")
    )
    cv = F.when(C("_avg") > EPS, C("_sd") / C("_avg")).otherwise(0.0)
    enough = (C("_n") >= chunks * 2) & (C("_k") >= 2)
    score = F.when(enough, 100.0 * (1.0 - F.least(cv, F.lit(1.0)))).otherwise(70.0)
    return c.select(*by, score.alias("prediction_stability"))


def health(t: DataFrame, max_age_days: float = 30.0, threshold: float = 60.0) -> DataFrame:
    """Weighted health score per model row.

    Needs task_type, accuracy (R2 or balanced accuracy), historical_error, rolling_error,
    prediction_stability, calibration_error, coverage, feature_severity and, when known,
    target_severity, residual_severity, regime_shift and age_days.
    """
    known = lambda c, x: F.when(C(c).isNotNull(), x).otherwise(70.0)
    calm = lambda c: known(c, 100.0 * (1.0 - clip(C(c), 0.0, 1.0)))
    tiny = C("historical_error") <= EPS
    grow = F.when(tiny, F.when(C("rolling_error") <= EPS, 1.0).otherwise(2.0)).otherwise(
        C("rolling_error") / C("historical_error")
    )
    parts = {
        "prediction_accuracy": clip(F.coalesce(C("accuracy"), F.lit(0.0)) * 100.0),
        "prediction_stability": clip(C("prediction_stability")),
        "confidence_calibration": 100.0 * (1.0 - F.least(C("calibration_error"), F.lit(1.0))),
        "feature_drift": calm("feature_severity"),
        "target_drift": calm("target_severity"),
        "residual_drift": calm("residual_severity"),
        "rolling_error_score": clip(100.0 * (2.0 - grow)),
        "market_regime_change": calm("regime_shift"),
        "training_age": known("age_days", clip(100.0 * (1.0 - C("age_days") / max_age_days))),
        "prediction_coverage": clip(C("coverage") * 100.0),
    }
    t = t.withColumns({f"h_{k}": v for k, v in parts.items()})
    weight = {**HEALTH_WEIGHTS, "rolling_error_score": HEALTH_WEIGHTS["rolling_error"]}
    total = clip(sum(C(f"h_{k}") * weight[k] for k in parts))
    t = t.withColumn("health_score", total)
    return t.withColumn(
        "health_status",
        F.when(C("health_score") >= threshold, "good")
        .when(C("health_score") >= threshold * 0.5, "warning")
        .otherwise("critical"),
    )


# --------------------------------------------------------------------------- retraining


def retraining_policy(
    t: DataFrame,
    health_threshold: float = 60.0,
    drift_threshold: float = 0.3,
    error_increase: dict | None = None,
    min_new: int = 200,
    max_age_days: float = 30.0,
) -> DataFrame:
    """Triggers, priority and estimated benefit per model row of a health table."""
    limit = error_increase or {"regression": 0.15, "classification": 0.1}
    cap = F.when(C("task_type") == "regression", limit["regression"]).otherwise(limit["classification"])
    grew = (C("rolling_error") - C("historical_error")) / C("historical_error") > cap
    cond = {
        "health": C("health_score") < health_threshold,
        "performance": (C("historical_error") > EPS) & grew,
        "feature_drift": C("feature_severity") > drift_threshold,
        "regime_shift": C("regime_shift_detected"),
        "model_age": C("age_days") > max_age_days,
    }
    hits = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in cond.items()]))
    t = t.withColumn("triggers", hits)
    n = F.size("triggers")
    enough = C("new_samples") >= min_new
    critical = (C("health_status") == "critical") | (C("drift_label") == "severe")
    lack = F.greatest(F.lit(0.0), health_threshold - C("health_score"))
    gain = clip(lack * 0.3 + C("drift_severity") * 20.0, 0.0, 40.0)
    return t.withColumns(
        {
            "recommended": (n > 0) & enough,
            "deferred": (n > 0) & ~enough,
            "priority": F.when(n == 0, "none")
            .when(critical, "critical")
            .when(n >= 3, "high")
            .when(n == 2, "medium")
            .otherwise("low"),
            "estimated_benefit": F.when(n > 0, F.format_string("+%.0f%%", gain)).otherwise("0%"),
            "suggested_dataset_size": F.greatest(F.lit(min_new), C("training_dataset_size")),
        }
    )


def retraining_due(
    t: DataFrame,
    interval_days: float = 7.0,
    health_threshold: float = 60.0,
    drift_threshold: float = 0.3,
    min_new: int = 200,
    auto: bool = False,
) -> DataFrame:
    """``due`` per model row by its ``mode``: manual, scheduled or adaptive."""
    ready = (
        (C("health_score") < health_threshold)
        & (C("feature_severity") > drift_threshold)
        & (C("new_samples") >= min_new)
    )
    due = (
        F.when(C("mode") == "scheduled", C("age_days") >= interval_days)
        .when(C("mode") == "adaptive", ready & F.lit(auto))
        .otherwise(False)
    )
    return t.withColumn("due", due)


def compare_models(
    production: DataFrame,
    candidate: DataFrame,
    by,
    primary: str,
    min_gain: float = 0.02,
    tie: float = 0.005,
    allow_tie: bool = False,
    max_slowdown: float = 0.5,
) -> DataFrame:
    """Decision per model from the primary metric and the latency of both versions."""
    if primary not in (*LOWER_IS_BETTER, *HIGHER_IS_BETTER):
        raise ValueError(f"unknown metric {primary!r}")
    pick = lambda d, p: d.select(*by, C(primary).alias(f"{p}_value"), C("latency_ms").alias(f"{p}_ms"))
    t = pick(production, "production").join(pick(candidate, "candidate"), list(by))
    a, b = C("production_value"), C("candidate_value")
    better = a - b if primary in LOWER_IS_BETTER else b - a
    gain = F.when(a != 0, better / F.abs(a)).otherwise(F.when(better > 0, 1.0).otherwise(0.0))
    slow = F.coalesce(safe_divide(C("candidate_ms") - C("production_ms"), C("production_ms")), F.lit(0.0))
    t = t.withColumns({"relative_improvement": gain, "_slow": slow > max_slowdown})
    g = C("relative_improvement")
    decision = (
        F.when(C("_slow"), "reject")
        .when(g >= min_gain, "deploy")
        .when(F.abs(g) <= tie, "deploy" if allow_tie else "further_evaluation")
        .otherwise("reject")
    )
    return t.withColumn("decision", decision).drop("_slow")


def importance_changes(production: DataFrame, candidate: DataFrame, by) -> DataFrame:
    """Change of every feature's importance; a feature only one side has counts from 0."""
    on = [*by, "feature"]
    a = production.select(*on, C("importance").alias("a"))
    b = candidate.select(*on, C("importance").alias("b"))
    z = lambda c: F.coalesce(C(c), F.lit(0.0))
    return a.join(b, on, "full_outer").select(*on, (z("b") - z("a")).alias("change"))


# --------------------------------------------------------------------------- lifecycle


def lifecycle(versions: DataFrame, promotions: DataFrame, by=("model_name",)) -> DataFrame:
    """Status of each version: the last promoted one is in production, earlier ones archived."""
    by = list(by)
    last = promotions.groupBy(*by).agg(
        F.max_by("version", F.struct("promoted_at", "version")).alias("_current")
    )
    when = promotions.groupBy(*by, "version").agg(F.max("promoted_at").alias("promoted_at"))
    t = versions.join(when, [*by, "version"], "left").join(last, by, "left")
    status = (
        F.when(C("version") == C("_current"), "production")
        .when(C("promoted_at").isNotNull(), "archived")
        .otherwise("candidate")
    )
    rate = F.when(
        C("live_prediction_count") > 0, C("correct_prediction_count") / C("live_prediction_count")
    )
    return t.withColumns({"status": status, "accuracy_rate": rate}).drop("_current")


def age_days(now: Column, trained: Column) -> Column:
    seconds = F.unix_micros(now.cast("timestamp")) - F.unix_micros(trained.cast("timestamp"))
    return F.greatest(seconds / (86400.0 * 1e6), F.lit(0.0))


def alerts(t: DataFrame, by, min_severity: str = "info") -> DataFrame:
    """One row per alert from a table with health, drift, policy and comparison columns."""
    have = set(t.columns)
    kinds = []

    def add(need, kind, cond, severity):
        if need in have:
            kinds.append(F.when(cond, F.struct(F.lit(kind).alias("type"), severity.alias("severity"))))

    crit = lambda c: F.when(c, "critical").otherwise("warning")
    add(
        "health_status", "model_health_warning", C("health_status") != "good",
        crit(C("health_status") == "critical"),
    )
    add(
        "feature_label", "feature_drift_alert", C("feature_label").isin("high", "severe"),
        crit(C("feature_label") == "severe"),
    )
    add(
        "priority", "retraining_recommended", C("recommended"),
        crit(~C("priority").isin("low", "medium")),
    )
    add("decision", "candidate_promoted", C("decision") == "deploy", F.lit("info"))
    add("decision", "model_performance_improved", C("decision") == "deploy", F.lit("info"))
    add("decision", "candidate_rejected", C("decision") != "deploy", F.lit("warning"))
    add(
        "decision", "model_performance_degraded",
        (C("decision") != "deploy") & (C("relative_improvement") < 0), F.lit("warning"),
    )
    out = t.select(*by, F.explode(F.array_compact(F.array(*kinds))).alias("a")).select(*by, "a.*")
    allowed = [s for s, r in SEVERITY_ORDER.items() if r >= SEVERITY_ORDER[min_severity]]
    return out.where(C("severity").isin(*allowed))


def compact_report(t: DataFrame, by) -> DataFrame:
    """The short status row of a model."""
    status = F.when(C("calibration_status") == "well_calibrated", "Good").otherwise(
        F.initcap(F.translate("calibration_status", "_", " "))
    )
    return t.select(
        *by,
        F.round("health_score").cast("long").alias("health_score"),
        F.initcap("health_status").alias("status"),
        F.round("feature_severity", 2).alias("feature_drift"),
        status.alias("calibration"),
        C("recommended").alias("retraining_recommended"),
        C("estimated_benefit").alias("estimated_improvement"),
        F.initcap("priority").alias("priority"),
    )
