"""Queries over supervised data: targets, splits, metrics, diagnostics and models."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import functions as F

from sparkwick.operators import dataset as D
from sparkwick.operators import diagnostics as G
from sparkwick.operators import gram
from sparkwick.operators import isotonic as I
from sparkwick.operators import logistic as LR
from sparkwick.operators import metrics as M
from sparkwick.operators import models as L
from sparkwick.operators.scan import fit_layout
from sparkwick.plans.base import (
    D1,
    H1,
    LONG,
    bars_sql,
    d1_bars,
    h1_bars,
    q,
    qcols,
    qs,
    query,
    table,
    with_sql,
)
from sparkwick.sources.staging import stage

C = F.col
HORIZON = 5
AHEAD = f"(PARTITION BY symbol ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND {HORIZON} FOLLOWING)"
ORD = "(PARTITION BY symbol ORDER BY idx)"


def idx():
    return C("bar_idx").alias("idx")


# --------------------------------------------------------------------------- targets

_LR = "CASE WHEN idx > 0 THEN ln(close / pc) END"
TARGET_SQL = {
    "next_close": f"lead(close, 5) OVER {ORD}",
    "next_open": f"lead(open, 5) OVER {ORD}",
    "next_high": f"lead(high, 5) OVER {ORD}",
    "next_low": f"lead(low, 5) OVER {ORD}",
    "next_return": f"(lead(close, 5) OVER {ORD} - close) / close",
    "next_log_return": f"ln(lead(close, 5) OVER {ORD} / close)",
    "expected_percentage_change": f"(lead(close, 5) OVER {ORD} - close) / close * 100",
    "future_atr": f"avg(tr) OVER {AHEAD}",
    "future_volatility": f"stddev_pop({_LR}) OVER {AHEAD}",
    "maximum_favorable_excursion": f"max(high) OVER {AHEAD} - close",
    "maximum_adverse_excursion": f"close - min(low) OVER {AHEAD}",
    "average_future_price": f"avg(close) OVER {AHEAD}",
    "future_range": f"max(high) OVER {AHEAD} - min(low) OVER {AHEAD}",
    "future_midpoint": f"(max(high) OVER {AHEAD} + min(low) OVER {AHEAD}) / 2",
}


@query(
    "d03_targets",
    with_sql(D1, bars_sql("d1"), f"""t AS (SELECT symbol, idx, n,
  {', '.join(f'{e} AS {k}' for k, e in TARGET_SQL.items())} FROM b)""")
    + f"SELECT symbol, idx, {', '.join(f'{qs(k)} AS target_reg_{k}' for k in TARGET_SQL)} FROM t WHERE idx < n - 5",
)
def targets(spark, sf):
    t = D.with_targets(d1_bars(spark, sf), HORIZON, list(TARGET_SQL), layout=LONG)
    return t.select("symbol", idx(), *qcols([f"target_reg_{k}" for k in TARGET_SQL]))


LABELS = f"""lab AS MATERIALIZED (
  SELECT *, (fc - close) / close AS fret, greatest(mfe, 0) AS gain, greatest(mae, 0) AS pain
  FROM (SELECT *, lead(close, 5) OVER {ORD} AS fc, max(high) OVER {AHEAD} - close AS mfe,
      close - min(low) OVER {AHEAD} AS mae FROM b) WHERE fc IS NOT NULL)"""


def labelled(spark, sf, base=h1_bars):
    bars = base(spark, sf)
    names = ["next_return", "expected_pip_movement", "maximum_favorable_excursion", "maximum_adverse_excursion"]
    return D.with_targets(bars, HORIZON, names, pip_size=0.01, layout=fit_layout(bars))


@query(
    "d10_threshold_label",
    with_sql(H1, bars_sql("h1"), LABELS)
    + """SELECT symbol, idx, CASE WHEN fret > 0.05 THEN 'BUY' WHEN fret < -0.05 THEN 'SELL'
  ELSE 'NO_TRADE' END AS label, CASE WHEN fret > 0.05 THEN 2 WHEN fret < -0.05 THEN 0 ELSE 1 END::BIGINT AS code
FROM lab""",
)
def threshold_label(spark, sf):
    label = D.threshold_label(C("target_reg_next_return"), 0.05, -0.05)
    t = labelled(spark, sf).withColumn("label", label)
    return t.select("symbol", idx(), "label", D.class_code(C("label")).alias("code"))


_RR = """((fc - close) / 0.01::DOUBLE {s} 5 AND {r}fret >= 0 AND
  CASE WHEN {bad} > 1e-12 THEN {good} / {bad} >= 1.5 ELSE {good} > 0 END)"""
_LONG_OK = _RR.format(s=">=", r="", good="gain", bad="pain")
_SHORT_OK = _RR.format(s="<= -", r="-", good="pain", bad="gain").replace("<= - 5", "<= -5")


@query(
    "d11_rr_label",
    with_sql(H1, bars_sql("h1"), LABELS)
    + f"""SELECT symbol, idx, CASE WHEN {_LONG_OK} AND NOT {_SHORT_OK} THEN 'BUY'
  WHEN {_SHORT_OK} AND NOT {_LONG_OK} THEN 'SELL' ELSE 'NO_TRADE' END AS label FROM lab""",
)
def rr_label(spark, sf):
    c = [C(f"target_reg_{n}") for n in ("next_return", "expected_pip_movement",
         "maximum_favorable_excursion", "maximum_adverse_excursion")]
    return labelled(spark, sf).select("symbol", idx(), D.risk_reward_label(*c, pip_size=0.01).alias("label"))


@query(
    "d12_split",
    with_sql(D1, bars_sql("d1"))
    + """SELECT symbol, idx, CASE WHEN idx < floor(n * 0.7::DOUBLE) THEN 'train'
  WHEN idx < floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM b""",
)
def split(spark, sf):
    t = D.sample_index(d1_bars(spark, sf))
    return D.chronological_split(t).select("symbol", C("sample_idx").alias("idx"), "split")


@query(
    "d13_walk_forward",
    with_sql(H1, bars_sql("h1"))
    + """SELECT symbol, fold, role, count(*) AS n, min(idx) AS first_idx, max(idx) AS last_idx FROM (
  SELECT symbol, f.fold, idx, CASE WHEN idx < t + f.fold * t THEN 'train'
      WHEN idx < t + f.fold * t + t THEN 'test' END AS role
  FROM (SELECT *, n // 6 AS t FROM b), (SELECT unnest(range(5)) AS fold) f) WHERE role IS NOT NULL
GROUP BY 1, 2, 3""",
)
def walk_forward(spark, sf):
    t = D.sample_index(h1_bars(spark, sf))
    f = D.walk_forward(t)
    return f.groupBy("symbol", "fold", "role").agg(
        F.count("*").alias("n"), F.min("sample_idx").alias("first_idx"), F.max("sample_idx").alias("last_idx")
    )


@query(
    "d14_split_check",
    with_sql(H1, bars_sql("h1"))
    + """SELECT symbol, count(*) FILTER (idx < floor(n * 0.7::DOUBLE)) AS n_train, true AS disjoint, true AS ordered
FROM b GROUP BY 1""",
)
def split_check(spark, sf):
    t = D.split_check(D.chronological_split(D.sample_index(h1_bars(spark, sf))))
    return t.select("symbol", "n_train", "disjoint", "ordered")


@query(
    "d15_report",
    with_sql(H1)
    + "\nUNION ALL\n".join(
        f"""SELECT symbol, '{c}' AS feature, count(*) AS n_rows, 0::BIGINT AS nan_count, {qs(f'avg({c})')} AS mean,
  {qs(f'stddev_pop({c})')} AS std, {qs(f'min({c})')} AS min, {qs(f'max({c})')} AS max,
  {qs(f'quantile_cont({c}, 0.5)')} AS median FROM h1 GROUP BY symbol"""
        for c in ("close", "volume")
    ),
)
def report(spark, sf):
    t = D.column_report(h1_bars(spark, sf), ["close", "volume"])
    return t.select("symbol", "feature", "n_rows", "nan_count", *qcols(["mean", "std", "min", "max", "median"]))


@query(
    "d16_impute",
    """WITH e AS (SELECT event_id, value, CASE WHEN user_id % 4 = 0 THEN 0 ELSE 1 END AS ok FROM events)
SELECT event_id, """
    + qs("CASE WHEN ok < 0.5 THEN (SELECT quantile_cont(value, 0.5) FROM e WHERE ok >= 0.5) ELSE value END")
    + " AS x FROM e",
)
def impute(spark, sf):
    from sparkwick.plans.base import table

    ok = F.when(C("user_id") % 4 == 0, 0.0).otherwise(1.0)
    t = table(spark, sf, "events").select("event_id", C("value").alias("x"), ok.alias("x_valid"))
    return D.impute(t, D.impute_values(t, ["x", "x_valid"])).select("event_id", q("x").alias("x"))


def returns(spark, sf):
    """Per-bar numeric features and a next-bar target, with splits, over the hourly candles."""
    bars = h1_bars(spark, sf)
    layout = fit_layout(bars)
    t = D.with_targets(bars, 1, ["next_return"], layout=layout)
    t = t.select(
        "symbol",
        "timeframe",
        "bar_idx",
        C("bar_idx").alias("sample_idx"),
        *_feature_columns(),
        C("target_reg_next_return").alias("y"),
    )
    return stage(t)


def _feature_columns():
    c = {
        "f_close": C("close"),
        "f_range": C("high") - C("low"),
        "f_body": C("close") - C("open"),
        "f_volume": C("volume"),
        "f_spread": C("spread"),
    }
    return [v.alias(k) for k, v in c.items()]


FEATURES = ["f_close", "f_range", "f_body", "f_volume", "f_spread"]
DATA = f"""x AS MATERIALIZED (
  SELECT symbol, idx, close AS f_close, high - low AS f_range, close - open AS f_body, volume AS f_volume,
    spread AS f_spread, (fc - close) / close AS y
  FROM (SELECT *, lead(close) OVER {ORD} AS fc FROM b) WHERE fc IS NOT NULL)"""
XS = [H1, bars_sql("h1"), DATA]


@query(
    "d18_scale",
    with_sql(*XS)
    + "SELECT symbol, idx, "
    + ", ".join(
        qs(f"({f} - (SELECT avg({f}) FROM x)) / (SELECT stddev_pop({f}) FROM x)") + f" AS {f}"
        for f in FEATURES
    )
    + " FROM x",
)
def scaled(spark, sf):
    t = returns(spark, sf)
    return D.scale(t, D.fit_scaler(t, FEATURES)).select("symbol", idx(), *qcols(FEATURES))


_SPREAD = lambda f, kind: {
    "minmax": f"({f} - (SELECT min({f}) FROM x)) / (SELECT max({f}) - min({f}) FROM x)",
    "robust": f"({f} - (SELECT quantile_cont({f}, 0.5) FROM x)) / (SELECT quantile_cont({f}, 0.75) - quantile_cont({f}, 0.25) FROM x)",
    "inverse": f,
}[kind]


@query(
    "d18_scalers",
    with_sql(*XS)
    + " UNION ALL ".join(
        f"SELECT '{kind}' AS kind, symbol, idx, "
        + ", ".join(qs(_SPREAD(f, kind)) + f" AS {f}" for f in FEATURES)
        + " FROM x"
        for kind in ("minmax", "robust", "inverse")
    ),
)
def scalers(spark, sf):
    t = stage(returns(spark, sf))
    robust = D.fit_scaler(t, FEATURES, "robust")
    done = {
        "minmax": D.scale(t, D.fit_scaler(t, FEATURES, "minmax")),
        "robust": D.scale(t, robust),
        "inverse": D.scale(D.scale(t, robust), robust, inverse=True),
    }
    parts = [
        d.select(F.lit(kind).alias("kind"), "symbol", idx(), *qcols(FEATURES))
        for kind, d in done.items()
    ]
    return parts[0].union(parts[1]).union(parts[2])


@query(
    "d24_preprocess",
    with_sql(
        *XS,
        """h AS (SELECT *, idx * 2 < max(idx) OVER (PARTITION BY symbol) AS early,
  CASE WHEN idx % 5 = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS ok FROM x)""",
        "md AS (SELECT quantile_cont(f_spread, 0.5) FILTER (early AND ok > 0.5) AS m FROM h)",
        """im AS MATERIALIZED (SELECT symbol, idx, early, f_range, ok AS f_spread_valid,
  CASE WHEN ok < 0.5 THEN m ELSE f_spread END AS f_spread FROM h, md)""",
    )
    + "SELECT symbol, idx, "
    + ", ".join(
        qs(f"({f} - (SELECT avg({f}) FROM im WHERE early)) / (SELECT stddev_pop({f}) FROM im WHERE early)")
        + f" AS {f}"
        for f in ("f_range", "f_spread", "f_spread_valid")
    )
    + " FROM im WHERE NOT early",
)
def preprocess(spark, sf):
    """Fitted on the first half of every series, applied to the second."""
    t = returns(spark, sf)
    last = t.groupBy("symbol").agg(F.max("bar_idx").alias("_m"))
    valid = F.when(C("bar_idx") % 5 == 0, 0.0).otherwise(1.0)
    t = stage(t.join(last, "symbol").withColumn("f_spread_valid", valid))
    early, names = C("bar_idx") * 2 < C("_m"), ["f_range", "f_spread", "f_spread_valid"]
    fitted = D.fit_preprocessor(t.where(early), names)
    out = fitted.apply(t.where(~early).select("symbol", "bar_idx", *names))
    return out.select("symbol", idx(), *qcols(names))


@query(
    "d20_corr_select",
    with_sql(*XS)
    + """SELECT CASE WHEN abs(corr(f_range, f_spread)) >= 0.95 THEN 'f_close,f_range,f_body,f_volume'
  ELSE 'f_close,f_range,f_body,f_volume,f_spread' END AS kept FROM x""",
)
def corr_select(spark, sf):
    kept = D.select_by_correlation(returns(spark, sf), FEATURES, 0.95)
    return spark.createDataFrame([(",".join(kept),)], "kept string")


@query("d21_selectors")
def selectors(spark, sf):
    t = returns(spark, sf)
    rows = [
        ("variance", ",".join(D.select_by_variance(t, FEATURES))),
        ("kbest", ",".join(D.select_k_best(t, FEATURES, "y", 3))),
        ("information", ",".join(D.select_by_information(t, FEATURES, "y", 3))),
        ("rfe", ",".join(D.select_recursively(t, FEATURES, "y", 3))),
    ]
    return spark.createDataFrame(rows, "method string, kept string")


# --------------------------------------------------------------------------- metrics

# a closed-form predictor, so every metric has an exact counterpart in SQL
PREDICTIONS = f"""pr AS MATERIALIZED (
  SELECT *, CASE WHEN fr > 0.05 THEN 'BUY' WHEN fr < -0.05 THEN 'SELL' ELSE 'NO_TRADE' END AS cls_y,
    CASE WHEN pb >= greatest(ps, pn) AND pb > ps AND pb > pn THEN 'BUY' WHEN ps >= pn AND ps >= pb THEN 'SELL'
      ELSE 'NO_TRADE' END AS cls_p
  FROM (SELECT *, es / (es + en + eb) AS ps, en / (es + en + eb) AS pn, eb / (es + en + eb) AS pb
    FROM (SELECT symbol, idx, close, fc AS y, 0.6::DOUBLE * close + 0.4::DOUBLE * pc AS pred,
        (fc - close) / close AS fr, least(100, 50 + abs(0.4::DOUBLE * (pc - close))) AS conf,
        exp(0.01::DOUBLE * (close - pc)) AS es, exp(0.2::DOUBLE) AS en, exp(0.01::DOUBLE * (pc - close)) AS eb
      FROM (SELECT *, lead(close, 5) OVER {ORD} AS fc FROM b) WHERE fc IS NOT NULL)))"""
PS = [H1, bars_sql("h1"), PREDICTIONS]


def predictions(spark, sf):
    bars = h1_bars(spark, sf)
    layout = fit_layout(bars)
    from sparkwick.operators import scan as S

    w = S.bar_window(layout)
    x = S.extend(bars, layout)
    x = x.withColumns(
        {"pc": F.coalesce(F.lag("close").over(w), C("close")), "y": F.lead("close", HORIZON).over(w)}
    )
    x = S.core_rows(x).where(C("y").isNotNull())
    down = C("close") - C("pc")
    raw = [F.exp(0.01 * down), F.exp(F.lit(0.2)), F.exp(-0.01 * down)]
    ret = (C("y") - C("close")) / C("close")
    x = x.withColumns(
        {
            "pred": 0.6 * C("close") + 0.4 * C("pc"),
            "confidence": F.least(F.lit(100.0), 50.0 + F.abs(0.4 * (C("pc") - C("close")))),
            "probs": L.normalised(raw, D.CLASSES),
            "cls_y": D.threshold_label(ret, 0.05, -0.05),
        }
    )
    return x.withColumn("cls_p", L.predicted_class(C("probs")))


def rounded(spark, sf):
    """Scores rounded, so that ties are the same rows in every engine."""
    return predictions(spark, sf).withColumn(
        "probs", F.transform_values("probs", lambda k, v: F.round(v, 9))
    )


@query(
    "a01_regression_metrics",
    with_sql(*PS)
    + f"""SELECT symbol, count(*) AS n, {qs('avg(abs(y - pred))')} AS mae, {qs('avg((y - pred) ** 2)', 4)} AS mse,
  {qs('sqrt(avg((y - pred) ** 2))')} AS rmse, {qs('1 - avg((y - pred) ** 2) / var_pop(y)')} AS r2,
  {qs('avg(CASE WHEN y <> 0 THEN abs(y - pred) / abs(y) END)')} AS mape,
  {qs('1 - var_pop(y - pred) / var_pop(y)')} AS explained_variance FROM pr GROUP BY 1""",
)
def regression_metrics(spark, sf):
    t = M.regression_metrics(predictions(spark, sf), ["symbol"])
    return t.select("symbol", "n", q("mse", 4).alias("mse"),
                    *qcols(["mae", "rmse", "r2", "mape", "explained_variance"]))


@query(
    "a03_residuals",
    with_sql(*PS)
    + f"""SELECT symbol, {qs('avg(y - pred)')} AS mean, {qs('stddev_pop(y - pred)')} AS std, {qs('min(y - pred)')} AS min,
  {qs('max(y - pred)')} AS max, {qs('quantile_cont(y - pred, 0.5)')} AS median FROM pr GROUP BY 1""",
)
def residuals(spark, sf):
    t = M.residual_statistics(predictions(spark, sf), ["symbol"])
    return t.select("symbol", *qcols(["mean", "std", "min", "max", "median"]))


@query(
    "a04_classification",
    with_sql(
        *PS,
        "cm AS MATERIALIZED (SELECT symbol, cls_y AS a, cls_p AS p, count(*) AS n FROM pr GROUP BY 1, 2, 3)",
        "tot AS (SELECT symbol, sum(n) AS total FROM cm GROUP BY 1)",
        """pc AS (SELECT symbol, c, sum(CASE WHEN a = c THEN n ELSE 0 END) AS act, sum(CASE WHEN p = c THEN n ELSE 0 END) AS prd,
    sum(CASE WHEN a = c AND p = c THEN n ELSE 0 END) AS tp
  FROM cm, (SELECT unnest(['SELL', 'NO_TRADE', 'BUY']) AS c) GROUP BY 1, 2 HAVING act + prd > 0)""",
        """ps AS (SELECT pc.*, total, CASE WHEN prd > 0 THEN tp / prd ELSE 0 END AS pr_, CASE WHEN act > 0 THEN tp / act ELSE 0 END AS re,
    2.0::DOUBLE * tp / (act + prd) AS f, CASE WHEN total - act > 0 THEN (total - act - prd + tp) / (total - act) ELSE 0 END AS sp
  FROM pc JOIN tot USING (symbol))""",
    )
    + f"""SELECT symbol, {qs('sum(tp) / max(total)')} AS accuracy, {qs('avg(pr_)')} AS precision, {qs('avg(re)')} AS recall,
  {qs('avg(f)')} AS f1, {qs('avg(sp)')} AS specificity, {qs('avg(re) FILTER (act > 0)')} AS balanced_accuracy
FROM ps GROUP BY 1""",
)
def classification(spark, sf):
    t = M.classification_metrics(predictions(spark, sf), ["symbol"], "cls_y", "cls_p")
    return t.select("symbol", *qcols(["accuracy", "precision", "recall", "f1", "specificity", "balanced_accuracy"]))


OVR = """ov AS MATERIALIZED (
  SELECT symbol, c AS cls, round(CASE c WHEN 'SELL' THEN ps WHEN 'NO_TRADE' THEN pn ELSE pb END, 9) AS s, (cls_y = c)::INT AS pos
  FROM pr, (SELECT unnest(['SELL', 'NO_TRADE', 'BUY']) AS c)),
sc AS MATERIALIZED (
  SELECT symbol, cls, s, count(*) AS n, sum(pos) AS p FROM ov GROUP BY 1, 2, 3),
cu AS (SELECT *, sum(p) OVER d AS tp, sum(n) OVER d AS sel, sum(p) OVER a AS tp_all, sum(n) OVER a AS n_all
  FROM sc WINDOW d AS (PARTITION BY symbol, cls ORDER BY s DESC), a AS (PARTITION BY symbol, cls))"""


@query(
    "a06_roc_auc",
    with_sql(*PS, OVR)
    + f"""SELECT symbol, {qs('avg(u)')} AS roc_auc FROM (
  SELECT symbol, cls, sum((n - p) * (tp - p + 0.5::DOUBLE * p)) / (max(tp_all) * (max(n_all) - max(tp_all))) AS u
  FROM cu GROUP BY 1, 2) GROUP BY 1""",
)
def roc_auc(spark, sf):
    t = M.roc_auc(rounded(spark, sf), ["symbol"], "cls_y")
    return t.select("symbol", q("roc_auc").alias("roc_auc"))


@query(
    "a07_pr_auc",
    with_sql(*PS, OVR)
    + f"""SELECT symbol, {qs('avg(u)')} AS pr_auc FROM (
  SELECT symbol, cls, sum(p / tp_all * (tp / sel + CASE WHEN sel > n THEN (tp - p) / (sel - n) ELSE 1 END) / 2) AS u
  FROM cu GROUP BY 1, 2) GROUP BY 1""",
)
def pr_auc(spark, sf):
    t = M.pr_auc(rounded(spark, sf), ["symbol"], "cls_y")
    return t.select("symbol", q("pr_auc").alias("pr_auc"))


@query(
    "a08_losses",
    with_sql(*PS)
    + f"""SELECT symbol, {qs("-avg(ln(CASE cls_y WHEN 'SELL' THEN ps WHEN 'NO_TRADE' THEN pn ELSE pb END))")} AS log_loss,
  {qs("avg(((ps - (cls_y = 'SELL')::INT) ** 2 + (pn - (cls_y = 'NO_TRADE')::INT) ** 2 + (pb - (cls_y = 'BUY')::INT) ** 2) / 3)")}
    AS brier_score FROM pr GROUP BY 1""",
)
def losses(spark, sf):
    t = M.probability_losses(predictions(spark, sf), ["symbol"], "cls_y")
    return t.select("symbol", *qcols(["log_loss", "brier_score"]))


@query(
    "a09_ece",
    with_sql(*PS, OVR)
    + f"""SELECT symbol, cls AS class, {qs('sum(n * g) / sum(n)')} AS ece FROM (
  SELECT symbol, cls, least(floor(s * 10), 9) AS b, count(*) AS n, abs(avg(s) - avg(pos)) AS g FROM ov GROUP BY 1, 2, 3)
GROUP BY 1, 2""",
)
def ece(spark, sf):
    t = M.expected_calibration_error(rounded(spark, sf), ["symbol"], "cls_y")
    return t.select("symbol", "class", q("ece").alias("ece"))


@query(
    "a11_latency",
    f"""SELECT event_type AS symbol, count(*) AS n, {qs('avg(value)')} AS mean, {qs('quantile_cont(value, 0.5)')} AS p50,
  {qs('quantile_cont(value, 0.95)')} AS p95, {qs('quantile_cont(value, 0.99)')} AS p99 FROM events GROUP BY 1""",
)
def latency(spark, sf):
    from sparkwick.plans.base import table

    t = M.latency(table(spark, sf, "events").withColumnRenamed("event_type", "symbol"), ["symbol"], "value")
    return t.select("symbol", "n", *qcols(["mean", "p50", "p95", "p99"]))


@query("a12_evaluation_report")
def evaluation_report(spark, sf):
    """Tidy report; its sections are checked by a01-a09."""
    t = D.chronological_split(predictions(spark, sf).withColumn("sample_idx", C("bar_idx")))
    return M.evaluation_report(stage(t), ["symbol"], "classification", y="cls_y", p="cls_p")


# --------------------------------------------------------------------------- diagnostics


@query(
    "g01_profile",
    with_sql(*XS, "m AS (SELECT symbol, avg(y) AS mu, stddev_pop(y) AS sd FROM x GROUP BY 1)")
    + f"""SELECT symbol, count(*) AS n_samples, {qs('avg(y)')} AS mean, {qs('stddev_pop(y)')} AS std, {qs('min(y)')} AS minimum,
  {qs('max(y)')} AS maximum, {qs('avg(((y - mu) / sd) ** 3)')} AS skewness, {qs('avg(((y - mu) / sd) ** 4) - 3')} AS kurtosis,
  {qs('quantile_cont(y, 0.25)')} AS q25, {qs('quantile_cont(y, 0.5)')} AS median, {qs('quantile_cont(y, 0.75)')} AS q75,
  {qs('100.0::DOUBLE * count(*) FILTER (abs((y - mu) / sd) > 3) / count(*)')} AS outlier_percentage
FROM x JOIN m USING (symbol) GROUP BY 1""",
)
def profile(spark, sf):
    t = G.profile(returns(spark, sf), ["symbol"], "y")
    cols = ["mean", "std", "minimum", "maximum", "skewness", "kurtosis", "q25", "median", "q75", "outlier_percentage"]
    return t.select("symbol", "n_samples", *qcols(cols))


@query("g03_unit_root")
def unit_root(spark, sf):
    t = G.unit_root(returns(spark, sf), ["symbol"], "f_close")
    return t.select("symbol", "n_lags", "n_effective", q("adf_statistic", 4).alias("adf_statistic"), "is_stationary_5pct")


@query(
    "g04_pearson",
    with_sql(*XS)
    + "\nUNION ALL\n".join(f"SELECT symbol, '{f}' AS feature, {qs(f'corr({f}, y)')} AS pearson FROM x GROUP BY symbol" for f in FEATURES),
)
def pearson(spark, sf):
    t = G.pearson(returns(spark, sf), ["symbol"], FEATURES, "y")
    return t.select("symbol", "feature", q("pearson").alias("pearson"))


def _rank(c: str) -> str:
    return (
        f"rank() OVER (PARTITION BY symbol ORDER BY {c}) + (count(*) OVER (PARTITION BY symbol, {c}) - 1) / 2.0::DOUBLE"
    )


@query(
    "g05_spearman",
    with_sql(*XS, f"r AS (SELECT symbol, {', '.join(f'{_rank(c)} AS {c}' for c in [*FEATURES, 'y'])} FROM x)")
    + "\nUNION ALL\n".join(f"SELECT symbol, '{f}' AS feature, {qs(f'corr({f}, y)')} AS spearman FROM r GROUP BY symbol" for f in FEATURES),
)
def spearman(spark, sf):
    t = G.spearman(returns(spark, sf), ["symbol"], FEATURES, "y", "bar_idx")
    return t.select("symbol", "feature", q("spearman").alias("spearman"))


@query("g07_vif")
def vif(spark, sf):
    rows = G.inflation_factors(returns(spark, sf), FEATURES)
    return spark.createDataFrame(rows, "feature string, vif double")


@query(
    "g08_near_constant",
    with_sql(*XS)
    + "\nUNION ALL\n".join(
        f"""SELECT symbol, '{f}' AS feature, var_pop({f}) < 1e-8 OR (count(*) FILTER ({f} IN (0, 1)) = count(*)
  AND greatest(count(*) FILTER ({f} = 0), count(*) FILTER ({f} = 1)) / count(*) >= 0.99) AS near_constant FROM x GROUP BY symbol"""
        for f in FEATURES
    ),
)
def near_constant(spark, sf):
    return G.near_constant(returns(spark, sf), ["symbol"], FEATURES).select("symbol", "feature", "near_constant")


@query(
    "g09_pairs",
    with_sql(*XS)
    + "SELECT a, b, r FROM ("
    + "\nUNION ALL\n".join(
        f"SELECT '{a}' AS a, '{b}' AS b, {qs(f'corr({a}, {b})')} AS r FROM x"
        for i, a in enumerate(FEATURES)
        for b in FEATURES[i + 1 :]
    )
    + ") WHERE abs(r) >= 0.3",
)
def pairs(spark, sf):
    rows = G.correlated_pairs(returns(spark, sf), FEATURES, 0.3)
    t = spark.createDataFrame(rows, "a string, b string, r double")
    return t.select("a", "b", q("r").alias("r"))


@query("g10_findings")
def findings(spark, sf):
    return G.feature_findings(returns(spark, sf), FEATURES, "y")


@query("g12_qq")
def qq(spark, sf):
    t = predictions(spark, sf).withColumn("e", C("y") - C("pred"))
    return G.qq_correlation(t, ["symbol"], "e").select("symbol", "n_points", q("qq_correlation", 4).alias("qq"))


@query(
    "g13_breusch_pagan",
    with_sql(*PS)
    + f"SELECT symbol, {qs('count(*) * corr((y - pred) ** 2, pred) ** 2', 4)} AS lm_statistic FROM pr GROUP BY 1",
)
def breusch_pagan(spark, sf):
    t = predictions(spark, sf).withColumn("e", C("y") - C("pred"))
    t = G.heteroscedasticity(t, ["symbol"], "e", "pred")
    return t.select("symbol", q("lm_statistic", 4).alias("lm_statistic"))


@query(
    "g11_normality",
    with_sql(*PS, """m AS (SELECT symbol, avg(y - pred) AS mu, stddev_pop(y - pred) AS sd, count(*) AS n FROM pr GROUP BY 1),
k AS (SELECT symbol, max(n) AS n, avg(((y - pred - mu) / sd) ** 3) AS s, avg(((y - pred - mu) / sd) ** 4) - 3 AS k
  FROM pr JOIN m USING (symbol) GROUP BY 1)""")
    + f"SELECT symbol, {qs('n / 6.0::DOUBLE * (s * s + k * k / 4)', 3)} AS jarque_bera FROM k",
)
def normality(spark, sf):
    t = predictions(spark, sf).withColumn("e", C("y") - C("pred"))
    return G.normality(t, ["symbol"], "e").select("symbol", q("jarque_bera", 3).alias("jarque_bera"))


@query(
    "g14_serial",
    with_sql(*PS, f"""e0 AS (SELECT symbol, idx, y - pred AS e, lag(y - pred) OVER {ORD} AS e1, lag(y - pred, 10) OVER {ORD} AS e10,
  avg(y - pred) OVER (PARTITION BY symbol) AS mu FROM pr)""")
    + f"""SELECT symbol, {qs('sum((e - e1) ** 2) / sum(e * e)')} AS durbin_watson,
  {qs('sum((e - mu) * (e1 - mu)) / sum((e - mu) ** 2)')} AS acf_1,
  {qs('sum((e - mu) * (e10 - mu)) / sum((e - mu) ** 2)')} AS acf_10 FROM e0 GROUP BY 1""",
)
def serial(spark, sf):
    t = predictions(spark, sf).withColumn("e", C("y") - C("pred"))
    t = G.serial_correlation(t, ["symbol"], "e", layout=LONG)
    return t.select("symbol", *qcols(["durbin_watson", "acf_1", "acf_10"]))


# --------------------------------------------------------------------------- models


@query(
    "m01_ols",
    with_sql(*XS)
    + f"""SELECT symbol, 'f_close' AS term, {qs('regr_slope(y, f_close)')} AS coefficient FROM x GROUP BY symbol
UNION ALL SELECT symbol, 'intercept', {qs('regr_intercept(y, f_close)')} FROM x GROUP BY symbol""",
)
def ols(spark, sf):
    """One least-squares model per series, all from one pass."""
    t = gram.ols_by_key(returns(spark, sf), ["symbol"], ["f_close"], "y")
    return t.select("symbol", "term", q("coefficient").alias("coefficient"))


@query("m03_tuned_models")
def tuned(spark, sf):
    """The four model kinds with tuned penalties, compared on the last rows."""
    t = _pooled(returns(spark, sf))
    return L.compare_kinds(t.train, t.test, FEATURES, "y").select("kind", "alpha", "r2", "rmse", "n_nonzero", "best")


def _pooled(t):
    """All series as one sample set in time order, split 85/15."""
    from sparkwick.operators import scan as S

    t = t.withColumns({"_all": F.lit(1), "_ib": F.floor(C("bar_idx") / 4096)})
    t = S.scan(t, ["_all"], ["bar_idx", "symbol"], [S.Scan("row", "sum", F.lit(1))], "_ib")
    t = stage(t.withColumn("sample_idx", C("row").cast("long") - 1).drop("row", "_ib", "_all"))
    n = t.count()
    cut = int(n * 0.85)
    return SimpleNamespace(train=t.where(C("sample_idx") < cut), test=t.where(C("sample_idx") >= cut), all=t)


@query("m04_cross_validation")
def cross_validation(spark, sf):
    rows, _ = L.cross_validate(_pooled(returns(spark, sf)).all, FEATURES, "y", "ridge")
    cols = ["fold", "n_train", "n_test", "alpha", "r2", "rmse"]
    return spark.createDataFrame(
        [tuple(r[c] for c in cols) for r in rows],
        "fold int, n_train int, n_test int, alpha double, r2 double, rmse double",
    )


@query("m08_forecast")
def forecast(spark, sf):
    """Forecast, interval and confidence per row from a ridge model with a bootstrap."""
    d = _pooled(returns(spark, sf))
    models = {"next_return": L.train_linear(d.train, FEATURES, "y", "ridge")}
    t = L.forecast(d.test, models)
    box = F.element_at("prediction_interval", "expected_return")
    return t.select("symbol", idx(), "expected_return", box["lower"].alias("lower"), box["upper"].alias("upper"), "forecast_confidence")


@query("m09_logistic")
def logistic(spark, sf):
    """Calibrated class probabilities per held-out row."""
    d = _pooled(returns(spark, sf))
    label = D.class_code(D.threshold_label(C("y"), 0.3, -0.3)).cast("double")
    train, test = (x.withColumn("cls", label) for x in (d.train, d.test))
    fit = L.train_logistic(train, FEATURES, "cls", calibration="platt")
    t = fit.score(test)
    t = t.withColumns(L.probability_summary())
    return t.select("symbol", idx(), "predicted_class", "probability_margin", "prediction_entropy", "sums_to_one")


@query(
    "m13_probability_summary",
    with_sql(*PS)
    + f"""SELECT symbol, idx, cls_p AS predicted_class,
  {qs('greatest(ps, pn, pb) - (1 - greatest(ps, pn, pb) - least(ps, pn, pb))')} AS probability_margin,
  {qs('-(ps * ln(ps) + pn * ln(pn) + pb * ln(pb)) / ln(3.0::DOUBLE)')} AS prediction_entropy,
  CASE cls_p WHEN 'NO_TRADE' THEN 'WAIT' ELSE cls_p END AS live FROM pr""",
)
def probability_summary(spark, sf):
    t = predictions(spark, sf).withColumns(L.probability_summary())
    return t.select("symbol", idx(), "predicted_class", *qcols(["probability_margin", "prediction_entropy"]),
                    L.live_class(C("predicted_class")).alias("live"))


@query(
    "m14_thresholds",
    with_sql(
        *PS,
        OVR,
        """f AS (SELECT cls, i, 2.0::DOUBLE * count(*) FILTER (pos = 1 AND s >= t) / greatest(count(*) FILTER (s >= t)
    + count(*) FILTER (pos = 1), 1) AS f1 FROM ov, (SELECT unnest(range(19)) AS i) g, LATERAL (SELECT
    0.05::DOUBLE + i * (0.9::DOUBLE / 18) AS t) GROUP BY 1, 2)""",
    )
    + f"""SELECT cls AS class, {qs('0.05::DOUBLE + arg_max(i, (f1, -i)) * (0.9::DOUBLE / 18)')} AS threshold,
  {qs('max(f1)')} AS f1 FROM f GROUP BY 1""",
)
def thresholds(spark, sf):
    t = L.optimise_thresholds(rounded(spark, sf), "cls_y")
    return t.select("class", *qcols(["threshold", "f1"]))


@query(
    "c03_class_health",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, {qs(
        'least(100, greatest(0, 65 * (l_discount * 8) + 35 * (1 - least(l_tax * 16, 1))))')} AS health
FROM lineitem""",
)
def class_health(spark, sf):
    from sparkwick.plans.base import table

    t = table(spark, sf, "lineitem")
    h = L.class_model_health(C("l_discount") * 8, C("l_tax") * 4)
    return t.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", q(h).alias("health"))


@query(
    "m15_apply_thresholds",
    with_sql(*PS)
    + """SELECT symbol, idx, CASE
    WHEN NOT (ps >= 0.34 OR pn >= 0.335 OR pb >= 0.33) THEN cls_p
    WHEN pb >= 0.33 AND (pn < 0.335 OR pb > pn) AND (ps < 0.34 OR pb > ps) THEN 'BUY'
    WHEN ps >= 0.34 AND (pn < 0.335 OR ps >= pn) THEN 'SELL'
    ELSE 'NO_TRADE' END AS chosen FROM (
  SELECT symbol, idx, cls_p, round(ps, 9) AS ps, round(pn, 9) AS pn, round(pb, 9) AS pb FROM pr)""",
)
def chosen_classes(spark, sf):
    limits = {"SELL": 0.34, "NO_TRADE": 0.335, "BUY": 0.33}
    chosen = L.apply_thresholds(C("probs"), limits)
    return rounded(spark, sf).select("symbol", idx(), chosen.alias("chosen"))


@query(
    "m18_distributions",
    with_sql(*PS)
    + f"""SELECT symbol, cls_p, count(*) AS n, {qs('count(*) / sum(count(*)) OVER (PARTITION BY symbol)')} AS fraction
FROM pr GROUP BY 1, 2""",
)
def class_distribution(spark, sf):
    t = L.prediction_distribution(predictions(spark, sf), ["symbol"], "cls_p")
    return t.select("symbol", "cls_p", "n", q("fraction").alias("fraction"))


@query(
    "m18_histogram",
    with_sql(*PS, OVR)
    + "SELECT symbol, cls AS class, least(floor(s * 10), 9)::BIGINT AS bin, count(*) AS n FROM ov GROUP BY 1, 2, 3",
)
def class_histogram(spark, sf):
    return L.probability_histogram(rounded(spark, sf), ["symbol"])


@query(
    "d15_class_balance",
    with_sql(*PS)
    + f"""SELECT symbol, cls_y AS class, count(*) AS n, {qs('count(*) / sum(count(*)) OVER (PARTITION BY symbol)')} AS fraction
FROM pr GROUP BY 1, 2""",
)
def label_balance(spark, sf):
    t = D.class_balance(predictions(spark, sf), "cls_y")
    return t.select("symbol", "class", "n", q("fraction").alias("fraction"))


@query(
    "d15_checks",
    with_sql(*PS)
    + """SELECT symbol, count(*) AS n_samples, count(*) - count(DISTINCT idx // 2) AS duplicate_decision_times,
  count(*) FILTER (idx % 7 = 0) AS leakage_violations FROM pr GROUP BY 1""",
)
def sample_checks(spark, sf):
    """Decision times repeated in pairs, and a label inside the window at every seventh bar."""
    t = predictions(spark, sf).withColumns(
        {
            "ts": F.timestamp_seconds(F.expr("bar_idx div 2")),
            "decision_idx": C("bar_idx"),
            "window_end_idx": C("bar_idx"),
            "label_idx": F.when(C("bar_idx") % 7 == 0, C("bar_idx")).otherwise(C("bar_idx") + HORIZON),
        }
    )
    return D.dataset_checks(t, ["symbol"])


@query(
    "d17_non_finite",
    "SELECT count(*) FILTER (user_id % 11 = 0) + count(*) FILTER (user_id % 13 = 0) + count(*) FILTER (user_id % 17 = 0) AS bad FROM events",
)
def non_finite(spark, sf):
    """Nulls, NaNs and infinities over two features."""
    from sparkwick.plans.base import table

    t = table(spark, sf, "events").select(
        F.when(C("user_id") % 11 != 0, C("value")).alias("a"),
        F.when(C("user_id") % 13 == 0, F.lit(float("nan")))
        .when(C("user_id") % 17 == 0, F.lit(float("inf")))
        .otherwise(C("value"))
        .alias("b"),
        (C("user_id") % (13 * 17) == 0).alias("both"),
    )
    bad = D.non_finite_count(t, ["a", "b"]) + t.where("both").count()
    return spark.createDataFrame([(bad,)], "bad long")


@query(
    "d19_variance_select",
    with_sql(*XS)
    + "SELECT string_agg(f, ',' ORDER BY i) AS kept FROM ("
    + " UNION ALL ".join(f"SELECT '{f}' AS f, {i} AS i, var_pop({f}) AS v FROM x" for i, f in enumerate(FEATURES))
    + ") WHERE v > 1.0",
)
def variance_select(spark, sf):
    kept = D.select_by_variance(returns(spark, sf), FEATURES, 1.0)
    return spark.createDataFrame([(",".join(kept),)], "kept string")


@query(
    "g07_vif_pair",
    with_sql(*XS)
    + f"""SELECT feature, {qs('1 / (1 - r * r)', 4)} AS vif FROM (SELECT corr(f_range, f_volume) AS r FROM x),
  (SELECT unnest(['f_range', 'f_volume']) AS feature)""",
)
def vif_pair(spark, sf):
    """Two features: the factor is 1 / (1 - r^2)."""
    rows = G.inflation_factors(returns(spark, sf), ["f_range", "f_volume"])
    t = spark.createDataFrame(rows, "feature string, vif double")
    return t.select("feature", q("vif", 4).alias("vif"))


# --------------------------------------------------------------------------- isotonic curves


@query(
    "m11_isotonic",
    f"""WITH v AS (
  SELECT event_type AS symbol, value AS x, count(*) AS w, count(*) FILTER (user_id % 3 = 0) AS s FROM events GROUP BY 1, 2
), c AS MATERIALIZED (
  SELECT *, row_number() OVER o AS i, sum(w) OVER o AS uw, sum(s) OVER o AS us
  FROM v WINDOW o AS (PARTITION BY symbol ORDER BY x)
), least AS (
  SELECT a.symbol, b.i, min((b.us - a.us + a.s) / (b.uw - a.uw + a.w)) OVER (
    PARTITION BY a.symbol, a.i ORDER BY b.i DESC) AS g
  FROM c a JOIN c b ON a.symbol = b.symbol AND b.i >= a.i
), g AS (SELECT symbol, i, max(g) AS g FROM least GROUP BY 1, 2
), p AS (
  SELECT symbol, x, g, lead(x) OVER o AS x1, lead(g) OVER o AS g1, first(g) OVER o AS g0
  FROM c JOIN g USING (symbol, i) WINDOW o AS (PARTITION BY symbol ORDER BY x)
), e AS (SELECT event_id, event_type AS symbol, value * 0.9::DOUBLE + 1 AS z FROM events
), lowest AS (SELECT symbol, arg_min(g, x) AS g0 FROM p GROUP BY 1)
SELECT event_id, {qs('CASE WHEN p.x IS NULL THEN lowest.g0 WHEN x1 IS NULL THEN g ELSE g + (g1 - g) * (z - p.x) / (x1 - p.x) END')} AS fitted
FROM e JOIN lowest ON lowest.symbol = e.symbol ASOF LEFT JOIN p ON p.symbol = e.symbol AND e.z >= p.x""",
)
def isotonic_curves(spark, sf):
    """Isotonic curve of an outcome over the value of each event type, read at other values."""
    ev = table(spark, sf, "events").select("event_id", C("event_type").alias("symbol"), "value", "user_id")
    blocks = I.fit(ev, ["symbol"], "value", (C("user_id") % 3 == 0).cast("double"))
    t = I.apply(ev, blocks, ["symbol"], C("value") * 0.9 + 1)
    return t.select("event_id", q("fitted").alias("fitted"))


# --------------------------------------------------------------------------- logistic models per series


def _newton_sql(steps: int = 14) -> str:
    """Two classes are one difference of scores d = a + b x, with half the penalty on b."""
    ctes = ["t0 AS (SELECT symbol, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM lx GROUP BY 1)"]
    for i in range(steps):
        ctes.append(f"""sums{i} AS MATERIALIZED (
  SELECT lx.symbol, max(a) AS a, max(b) AS b, sum(w * (p - l)) AS g0, sum(w * (p - l) * x) + max(b) / 2 AS g1,
    sum(w * p * (1 - p)) AS h00, sum(w * p * (1 - p) * x) AS h01, sum(w * p * (1 - p) * x * x) + 0.5 AS h11
  FROM (SELECT lx.*, a, b, 1 / (1 + exp(-(a + b * x))) AS p FROM lx JOIN t{i} USING (symbol)) lx GROUP BY 1),
t{i + 1} AS (SELECT symbol, a - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS a,
    b - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS b FROM sums{i})""")
    return ",\n".join(ctes) + f"""
SELECT lx.symbol, idx, {qs('1 / (1 + exp(-(a + b * x)))')} AS p_up,
  CASE WHEN a + b * x > 0 THEN 1 ELSE 0 END::INTEGER AS predicted FROM lx JOIN t{steps} USING (symbol)"""


@query(
    "m09_logistic_by_symbol",
    with_sql(*XS, """lx AS MATERIALIZED (
  SELECT symbol, idx, f_close / 100 AS x, l, count(*) OVER (PARTITION BY symbol) / (2.0::DOUBLE * count(*) OVER (PARTITION BY symbol, l)) AS w
  FROM (SELECT *, CASE WHEN y > 0 THEN 1 ELSE 0 END AS l FROM x))""")
    + ", " + _newton_sql(),
)
def logistic_by_symbol(spark, sf):
    """One logistic model per series, all advanced by the same scans."""
    t = returns(spark, sf).withColumn("x", C("f_close") / 100)
    models = LR.fit_by_key(t, ["symbol"], ["x"], (C("y") > 0).cast("int"), 2)
    t = LR.score_by_key(t, models, ["symbol"], ["x"], 2, "sample_idx")
    return t.select("symbol", idx(), q(F.get("probabilities", F.lit(1))).alias("p_up"), "predicted")


@query(
    "m12_ensemble_agreement",
    with_sql(*XS)
    + "SELECT symbol, idx, CASE WHEN f_close > 40 THEN 1 ELSE 0 END::INTEGER AS predicted, 1.0::DOUBLE AS agreement FROM x",
)
def ensemble_agreement(spark, sf):
    """Bootstrap members of a separable case: all of them find the classes apart."""
    high = C("f_close") > 40
    t = returns(spark, sf).withColumn("x", (C("f_close") - 40) / 100 + F.when(high, 8.0).otherwise(-8.0))
    models = LR.fit_by_key(t, ["symbol"], ["x"], high.cast("int"), 2, members=6)
    t = LR.score_by_key(t, models, ["symbol"], ["x"], 2, "sample_idx")
    return t.select("symbol", idx(), "predicted", "agreement")
