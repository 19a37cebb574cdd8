"""Model quality metrics as grouped aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwick.functions.columns import Registry, col, safe_divide
from sparkwick.operators import scan as S

C = F.col
LOG_FLOOR = 2.220446049250313e-16
REGRESSION = Registry()


def _sse(y, p):
    return F.sum((y - p) * (y - p))


@REGRESSION.register("mae")
def _mae(y, p):
    return F.avg(F.abs(y - p))


@REGRESSION.register("mse")
def _mse(y, p):
    return F.avg((y - p) * (y - p))


@REGRESSION.register("rmse")
def _rmse(y, p):
    return F.sqrt(_mse(y, p))


def _ratio_score(loss: Column, total: Column) -> Column:
    flat = F.when(loss == 0, 1.0).otherwise(0.0)
    return F.when(total == 0, flat).otherwise(1.0 - loss / total)


@REGRESSION.register("r2")
def _r2(y, p):
    return F.when(F.count(y) >= 2, _ratio_score(_mse(y, p), F.var_pop(y)))


@REGRESSION.register("mape")
def _mape(y, p):
    return F.avg(F.when(y != 0, F.abs(y - p) / F.abs(y)))


@REGRESSION.register("explained_variance")
def _explained(y, p):
    return _ratio_score(F.var_pop(y - p), F.var_pop(y))


def regression_metrics(df: DataFrame, by, y="y", p="pred", names=None) -> DataFrame:
    """All error metrics of each group in a single aggregation."""
    y, p = col(y), col(p)
    names = names or list(REGRESSION)
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), *[REGRESSION[n](y, p).alias(n) for n in names]
    )


def residual_statistics(df: DataFrame, by, y="y", p="pred") -> DataFrame:
    t = df.select(*by, (col(y) - col(p)).alias("e"))
    s = t.groupBy(*by).agg(
        F.avg("e").alias("mean"),
        F.stddev_pop("e").alias("std"),
        F.min("e").alias("min"),
        F.max("e").alias("max"),
    )
    return s.join(S.quantiles(t, by, "e", {"median": 0.5}), list(by))


def histogram(df: DataFrame, by, value, bins: int = 10) -> DataFrame:
    """Equal-width bins between the extremes; the last bin is closed. Empty bins count 0."""
    by = list(by)
    t = df.select(*by, col(value).alias("v")).where(C("v").isNotNull())
    lim = t.groupBy(*by).agg(F.min("v").alias("_a"), F.max("v").alias("_b"))
    flat = C("_a") == C("_b")
    lim = lim.select(
        *by,
        F.when(flat, C("_a") - 0.5).otherwise(C("_a")).alias("_lo"),
        F.when(flat, C("_b") + 0.5).otherwise(C("_b")).alias("_hi"),
    )
    pos = F.floor((C("v") - C("_lo")) / ((C("_hi") - C("_lo")) / bins))
    at = F.greatest(F.least(pos, F.lit(bins - 1)), F.lit(0)).cast("long")
    n = S.attach(t, lim, by, "v").withColumn("bin", at).groupBy(*by, "bin").agg(F.count("*").alias("n"))
    full = lim.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).cast("long"))
    step = (C("_hi") - C("_lo")) / bins
    return full.join(n, [*by, "bin"], "left").select(
        *by,
        "bin",
        (C("_lo") + step * C("bin")).alias("lower"),
        (C("_lo") + step * (C("bin") + 1)).alias("upper"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


# --------------------------------------------------------------------------- classification


def confusion(df: DataFrame, by, y="y", p="pred") -> DataFrame:
    return df.groupBy(*by, col(y).alias("actual"), col(p).alias("predicted")).agg(
        F.count("*").alias("n")
    )


def per_class(conf: DataFrame, by) -> DataFrame:
    """Precision, recall, F1 and specificity of each class from confusion counts."""
    by = list(by)
    zero = F.lit(0).cast("long")
    hit = F.when(C("actual") == C("predicted"), C("n")).otherwise(zero)
    cells = F.array(
        F.struct(C("actual").alias("class"), C("n").alias("act"), zero.alias("prd"), hit.alias("tp")),
        F.struct(C("predicted").alias("class"), zero.alias("act"), C("n").alias("prd"), zero.alias("tp")),
    )
    t = conf.select(*by, F.explode(cells).alias("e")).select(*by, "e.*")
    t = t.groupBy(*by, "class").agg(*[F.sum(c).alias(c) for c in ("act", "prd", "tp")])
    total = conf.groupBy(*by, F.lit(1).alias("_k")).agg(F.sum("n").alias("total"))
    t = t.withColumn("_k", F.lit(1)).join(total, [*by, "_k"])
    fp = C("prd") - C("tp")
    negatives = C("total") - C("act")
    prec, rec = safe_divide(C("tp"), C("prd")), safe_divide(C("tp"), C("act"))
    return t.select(
        *by,
        "class",
        C("act").alias("support"),
        "tp",
        "total",
        prec.alias("precision"),
        rec.alias("recall"),
        safe_divide(2.0 * C("tp"), C("act") + C("prd")).alias("f1"),
        safe_divide(negatives - fp, negatives).alias("specificity"),
    )


def classification_metrics(df: DataFrame, by, y="y", p="pred") -> DataFrame:
    """Accuracy and macro scores per group."""
    t = per_class(confusion(df, by, y, p), by)
    return t.groupBy(*by).agg(
        F.max("total").alias("n"),
        (F.sum("tp") / F.max("total")).alias("accuracy"),
        F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"),
        F.avg("f1").alias("f1"),
        F.avg("specificity").alias("specificity"),
        F.avg(F.when(C("support") > 0, C("recall"))).alias("balanced_accuracy"),
    )


def one_vs_rest(df: DataFrame, by, y="y", probs="probs") -> DataFrame:
    """(by, class, score, pos) from a map column class -> probability."""
    t = df.select(*by, col(y).alias("_y"), F.explode(probs).alias("class", "score"))
    return t.select(*by, "class", "score", (C("_y") == C("class")).cast("int").alias("pos"))


def _score_counts(df: DataFrame, by, y, probs) -> DataFrame:
    keys = [*by, "class"]
    t = S.value_counts(one_vs_rest(df, by, y, probs), keys, "score", {"pos": C("pos")})
    total = t.groupBy(*keys).agg(F.sum("pos").alias("_P"), F.sum("n").alias("_N"))
    return S.attach(t, total, keys, "value").where((C("_P") > 0) & (C("_P") < C("_N")))


def _macro(df: DataFrame, scores: DataFrame, by, name: str, empty: float) -> DataFrame:
    by = list(by)
    m = scores.groupBy(*by).agg(F.avg("s").alias(name))
    groups = df.select(*by).distinct()
    return groups.join(m, by, "left").withColumn(name, F.coalesce(name, F.lit(empty)))


def roc_auc(df: DataFrame, by, y="y", probs="probs") -> DataFrame:
    """Macro one-vs-rest area under the ROC curve, by counting ordered pairs per score."""
    t = _score_counts(df, by, y, probs)
    above = C("_P") - C("pos_upto") + 0.5 * C("pos")
    pairs = F.sum((C("n") - C("pos")) * above) / (F.first("_P") * (F.first("_N") - F.first("_P")))
    return _macro(df, t.groupBy(*by, "class").agg(pairs.alias("s")), by, "roc_auc", 0.5)


def pr_auc(df: DataFrame, by, y="y", probs="probs") -> DataFrame:
    """Macro area under the precision-recall curve (trapezoids, from recall 0 at precision 1)."""
    t = _score_counts(df, by, y, probs)
    tp = C("_P") - C("pos_upto") + C("pos")
    sel = C("_N") - C("upto") + C("n")
    tp0, sel0 = tp - C("pos"), sel - C("n")
    p1, p0 = tp / sel, F.when(sel0 > 0, tp0 / sel0).otherwise(1.0)
    area = F.sum(C("pos") / C("_P") * (p1 + p0) / 2.0)
    return _macro(df, t.groupBy(*by, "class").agg(area.alias("s")), by, "pr_auc", 0.0)


def probability_losses(df: DataFrame, by, y="y", probs="probs") -> DataFrame:
    """Log loss and macro Brier score per group."""
    own = F.element_at(C(probs), col(y))
    row_brier = F.aggregate(
        F.map_entries(probs),
        F.lit(0.0),
        lambda acc, e: acc
        + (e["value"] - F.when(e["key"] == col(y), 1.0).otherwise(0.0))
        * (e["value"] - F.when(e["key"] == col(y), 1.0).otherwise(0.0)),
    ) / F.size(probs)
    floor = F.least(F.greatest(F.coalesce(own, F.lit(0.0)), F.lit(LOG_FLOOR)), F.lit(1 - LOG_FLOOR))
    return df.groupBy(*by).agg(
        (-F.avg(F.ln(floor))).alias("log_loss"), F.avg(row_brier).alias("brier_score")
    )


def edge_bin(p: Column, bins: int, right_closed: bool = False) -> Column:
    """Uniform bins on [0, 1] with exact edges."""
    at = F.lit(0)
    for i in range(1, bins):
        edge = F.lit(i * (1.0 / bins))
        at = at + F.when((p > edge) if right_closed else (p >= edge), 1).otherwise(0)
    return at.cast("long")


def calibration_curve(
    df: DataFrame, by, y="y", probs="probs", bins: int = 10
) -> DataFrame:
    """Mean score and observed frequency per class and bin; empty bins are left out."""
    t = one_vs_rest(df, by, y, probs).withColumn("bin", edge_bin(C("score"), bins, True))
    return t.groupBy(*by, "class", "bin").agg(
        F.count("*").alias("n"), F.avg("score").alias("prob_pred"), F.avg("pos").alias("prob_true")
    )


def expected_calibration_error(
    df: DataFrame, by, y="y", probs="probs", bins: int = 10
) -> DataFrame:
    t = one_vs_rest(df, by, y, probs).withColumn("bin", edge_bin(C("score"), bins))
    b = t.groupBy(*by, "class", "bin").agg(
        F.count("*").alias("n"), F.abs(F.avg("score") - F.avg("pos")).alias("gap")
    )
    return b.groupBy(*by, "class").agg(
        (F.sum(C("n") * C("gap")) / F.sum("n")).alias("ece"), F.sum("n").alias("n")
    )


def all_classification_metrics(df: DataFrame, by, y="y", p="pred", probs="probs") -> DataFrame:
    by = list(by)
    t = classification_metrics(df, by, y, p)
    for part in (roc_auc, pr_auc, probability_losses):
        t = t.join(part(df, by, y, probs), by)
    return t


def latency(df: DataFrame, by, value) -> DataFrame:
    t = df.select(*by, col(value).alias("v"))
    m = t.groupBy(*by).agg(F.count("v").alias("n"), F.avg("v").alias("mean"))
    q = S.quantiles(t, by, "v", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return m.join(q, list(by))


# --------------------------------------------------------------------------- reports


def tidy(df: DataFrame, by, section: str, columns=None, key: Column | None = None) -> DataFrame:
    """(by, section, metric, key, value) rows of a wide metrics table."""
    names = columns or [c for c in df.columns if c not in by]
    cells = [F.struct(F.lit(c).alias("metric"), C(c).cast("double").alias("value")) for c in names]
    t = df.select(
        *by,
        F.lit(section).alias("section"),
        (key.cast("string") if key is not None else F.lit(None).cast("string")).alias("key"),
        F.explode(F.array(*cells)).alias("e"),
    )
    return t.select(*by, "section", "e.metric", "key", "e.value")


def generalization_gap(val: DataFrame, test: DataFrame, by, metric: str) -> DataFrame:
    v = val.select(*by, C(metric).alias("validation"))
    t = test.select(*by, C(metric).alias("testing"))
    return v.join(t, list(by)).withColumn("generalization_gap", C("validation") - C("testing"))


def evaluation_report(
    scored: DataFrame, by, task: str, split="split", y="y", p="pred", probs="probs"
) -> DataFrame:
    """Validation and test metrics, the gap between them and the detail tables, in tidy form."""
    by = list(by)
    val, test = scored.where(C(split) == "val"), scored.where(C(split) == "test")
    if task == "regression":
        m = lambda d: regression_metrics(d, by, y, p)
        primary = "r2"
        h = histogram(test, by, col(y) - col(p))
        detail = tidy(residual_statistics(test, by, y, p), by, "residuals").unionByName(
            tidy(h, by, "error_histogram", ["lower", "upper", "n"], C("bin"))
        )
    elif task == "classification":
        m = lambda d: all_classification_metrics(d, by, y, p, probs)
        primary = "accuracy"
        conf = confusion(test, by, y, p)
        cal = calibration_curve(test, by, y, probs)
        detail = tidy(
            conf, by, "confusion", ["n"], F.concat_ws(">", "actual", "predicted")
        ).unionByName(
            tidy(cal, by, "calibration", ["prob_pred", "prob_true"], F.concat_ws("#", "class", "bin"))
        )
    else:
        raise ValueError(f"unknown task {task!r}")
    vm, tm = m(val), m(test)
    size = scored.groupBy(*by, split).agg(F.count("*").alias("n"))
    return (
        tidy(size, by, "dataset", ["n"], C(split))
        .unionByName(tidy(vm, by, "validation"))
        .unionByName(tidy(tm, by, "testing"))
        .unionByName(tidy(generalization_gap(vm, tm, by, primary), by, "gap"))
        .unionByName(detail)
    )
