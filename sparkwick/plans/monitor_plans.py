"""Queries over model monitoring: one model per event type, first half baseline, second half live."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkwick.operators import monitor as Q
from sparkwick.operators.dataset import melt
from sparkwick.plans.base import H1, bars_sql, q, qcols, qs, query, table, with_sql
from sparkwick.plans.decision_plans import FT, feature_table
from sparkwick.plans.learning_plans import FEATURES, HORIZON, PREDICTIONS, XS, predictions, returns
from sparkwick.sources.staging import stage

C = F.col
MODEL = ["symbol"]


def halves(t, order="bar_idx"):
    """(baseline, live) by the position of a row in its model's history."""
    n = t.groupBy(*MODEL).agg(F.max(order).alias("_m"))
    t = stage(t.join(n, MODEL))
    early = C(order) * 2 < C("_m")
    return t.where(early).drop("_m"), t.where(~early).drop("_m")


HALF = "idx * 2 < max(idx) OVER (PARTITION BY symbol)"

# --------------------------------------------------------------------------- regimes

REG = f"""rg AS MATERIALIZED (SELECT symbol, idx, {HALF} AS early,
  CASE WHEN trend_direction > 0 AND trend_strength >= 0.5 THEN 'trending_up'
    WHEN trend_direction < 0 AND trend_strength >= 0.5 THEN 'trending_down' ELSE 'ranging' END AS trend_state,
  CASE WHEN vol_expansion >= 1 THEN 'high_volatility' WHEN vol_compression >= 1 THEN 'low_volatility' ELSE 'normal' END AS volatility_state,
  CASE WHEN session_is_sydney >= 1 THEN 'sydney' WHEN session_is_asian >= 1 THEN 'asian' WHEN session_is_london >= 1 THEN 'london'
    WHEN session_is_newyork >= 1 THEN 'newyork' ELSE 'none' END AS session,
  CASE WHEN spread_spike >= 1 OR spread_percentile >= 0.9 THEN 'widened_spread' ELSE 'normal' END AS liquidity_state FROM ft)"""


@query(
    "q01_regimes",
    with_sql(H1, bars_sql("h1"), FT, REG)
    + "SELECT symbol, idx, trend_state, volatility_state, session, liquidity_state FROM rg",
)
def regimes(spark, sf):
    return Q.classify_regime(feature_table(spark, sf)).select("symbol", "idx", *Q.REGIMES)


DRIFT = """sh AS (SELECT symbol, d AS dimension, s AS state, coalesce(count(*) FILTER (early), 0) AS nb,
    coalesce(count(*) FILTER (NOT early), 0) AS nl FROM (
    SELECT symbol, early, unnest(['trend_state', 'volatility_state', 'session', 'liquidity_state']) AS d,
      unnest([trend_state, volatility_state, session, liquidity_state]) AS s FROM rg) GROUP BY 1, 2, 3),
sp AS (SELECT *, nb / sum(nb) OVER w AS p, nl / sum(nl) OVER w AS ql FROM sh WINDOW w AS (PARTITION BY symbol, dimension))"""


@query(
    "q02_regime_drift",
    with_sql(H1, bars_sql("h1"), FT, REG, DRIFT)
    + f"""SELECT symbol, dimension, {qs('sum(abs(p - ql)) / 2')} AS shift, sum(abs(p - ql)) / 2 > 0.3 AS differs,
  arg_max(state, (ql, state)) AS dominant_state FROM sp GROUP BY 1, 2""",
)
def regime_drift(spark, sf):
    a, b = halves(Q.classify_regime(feature_table(spark, sf)), "idx")
    t = Q.regime_drift(a, b, MODEL)
    return t.select("symbol", "dimension", q("shift").alias("shift"), "differs", "dominant_state")


# --------------------------------------------------------------------------- drift

LONG_SQL = f"""xl AS MATERIALIZED (SELECT symbol, early, unnest({FEATURES}) AS feature, unnest([{', '.join(FEATURES)}]) AS value
  FROM (SELECT *, {HALF} AS early FROM x))"""
PSI_SQL = """ed AS (SELECT symbol, feature, list_sort(list_distinct(quantile_cont(value, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e
  FROM xl WHERE early GROUP BY 1, 2),
bn AS (SELECT symbol, feature, early, least(len(list_filter(e, lambda z: z <= value)), len(e) - 1) AS bin
  FROM xl JOIN ed USING (symbol, feature) WHERE value >= e[1] AND value <= e[-1]),
bg AS (SELECT symbol, feature, unnest(range(1, len(e))) AS bin FROM ed),
bc AS (SELECT bg.symbol, bg.feature, bg.bin, count(*) FILTER (bn.early) AS nb, count(*) FILTER (NOT bn.early) AS nl
  FROM bg LEFT JOIN bn USING (symbol, feature, bin) GROUP BY 1, 2, 3),
bp AS (SELECT *, greatest(nb / sum(nb) OVER w, 1e-12) AS p, greatest(nl / sum(nl) OVER w, 1e-12) AS r
  FROM bc WINDOW w AS (PARTITION BY symbol, feature)),
psi AS MATERIALIZED (SELECT symbol, feature, sum((r - p) * ln(r / p)) AS psi FROM bp GROUP BY 1, 2)"""
KS_SQL = """kv AS (SELECT symbol, feature, value, count(*) FILTER (early) AS b, count(*) FILTER (NOT early) AS l FROM xl GROUP BY 1, 2, 3),
kc AS (SELECT symbol, feature, sum(b) OVER w / sum(b) OVER t AS fb, sum(l) OVER w / sum(l) OVER t AS fl FROM kv
  WINDOW w AS (PARTITION BY symbol, feature ORDER BY value), t AS (PARTITION BY symbol, feature)),
ks AS MATERIALIZED (SELECT symbol, feature, max(abs(fb - fl)) AS d FROM kc GROUP BY 1, 2)"""


def long_halves(spark, sf):
    a, b = halves(returns(spark, sf))
    return melt(a, MODEL, FEATURES), melt(b, MODEL, FEATURES)


@query("q04_psi", with_sql(*XS, LONG_SQL, PSI_SQL) + f"SELECT symbol, feature, {qs('psi')} AS psi FROM psi")
def psi(spark, sf):
    a, b = long_halves(spark, sf)
    return Q.psi(a, b, ["symbol", "feature"]).select("symbol", "feature", q("psi").alias("psi"))


@query("q05_ks", with_sql(*XS, LONG_SQL, KS_SQL) + f"SELECT symbol, feature, {qs('d')} AS ks_statistic FROM ks")
def ks(spark, sf):
    a, b = long_halves(spark, sf)
    t = Q.ks_test(a, b, ["symbol", "feature"])
    return t.select("symbol", "feature", q("ks_statistic").alias("ks_statistic"))


FD = """mo AS (SELECT symbol, feature, avg(value) FILTER (early) AS tm, CASE WHEN stddev_pop(value) FILTER (early) < 1e-12 THEN 1
    ELSE stddev_pop(value) FILTER (early) END AS ts, avg(value) FILTER (NOT early) AS lm, stddev_pop(value) FILTER (NOT early) AS ls FROM xl GROUP BY 1, 2),
ou AS (SELECT symbol, feature, avg((abs((value - tm) / ts) > 3)::INT) AS o FROM xl JOIN mo USING (symbol, feature) WHERE NOT early GROUP BY 1, 2),
fd AS MATERIALIZED (SELECT *, least(1, 0.3::DOUBLE * least(abs(lm - tm) / ts / 3, 1) + 0.2::DOUBLE * least(abs(ls - ts) / ts / 3, 1)
    + 0.25::DOUBLE * least(psi / 0.25::DOUBLE, 1) + 0.1::DOUBLE * o) AS score FROM mo JOIN ou USING (symbol, feature) JOIN psi USING (symbol, feature))"""


@query(
    "q06_feature_drift",
    with_sql(*XS, LONG_SQL, PSI_SQL, FD)
    + f"""SELECT symbol, feature, {qs('abs(lm - tm) / ts')} AS mean_shift, {qs('abs(ls - ts) / ts')} AS variance_shift,
  {qs('o')} AS outlier_frequency, {qs('score')} AS drift_score FROM fd""",
)
def feature_drift(spark, sf):
    a, b = long_halves(spark, sf)
    t = Q.feature_drift(a, b, MODEL)
    return t.select("symbol", "feature", *qcols(["mean_shift", "variance_shift", "outlier_frequency", "drift_score"]))


@query(
    "q06_one_sided",
    with_sql(*XS, LONG_SQL, PSI_SQL, FD)
    + f"""SELECT symbol, feature, CASE feature WHEN '{FEATURES[0]}' THEN 'missing' WHEN '{FEATURES[1]}' THEN 'unexpected' ELSE 'both' END AS presence,
  CASE feature WHEN '{FEATURES[0]}' THEN 1.0 WHEN '{FEATURES[1]}' THEN NULL ELSE {qs('score')} END AS drift_score FROM fd""",
)
def one_sided_drift(spark, sf):
    """Drift where one feature is missing in the live rows and one is new there."""
    a, b = long_halves(spark, sf)
    a, b = a.where(C("feature") != FEATURES[1]), b.where(C("feature") != FEATURES[0])
    t = Q.feature_drift(a, b, MODEL)
    return t.select("symbol", "feature", "presence", q("drift_score").alias("drift_score"))


_PAIRS = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]]
CD = "cd AS (SELECT symbol, (" + " + ".join(
    f"abs(corr({a}, {b}) FILTER (early) - corr({a}, {b}) FILTER (NOT early))" for a, b in _PAIRS
) + f") / {len(_PAIRS)} / 2 AS cd FROM (SELECT *, {HALF} AS early FROM x) GROUP BY 1)"


@query(
    "q07_drift_summary",
    with_sql(*XS, LONG_SQL, PSI_SQL, FD, CD)
    + f"""SELECT symbol, {qs('max(cd)')} AS correlation_drift, {qs('least(1, 0.8::DOUBLE * avg(score) + 0.2::DOUBLE * least(max(cd) * 2, 1))')} AS overall_severity,
  arg_max(feature, score) AS top_feature FROM fd JOIN cd USING (symbol) GROUP BY 1""",
)
def drift_summary(spark, sf):
    a, b = halves(returns(spark, sf))
    per = Q.feature_drift(melt(a, MODEL, FEATURES), melt(b, MODEL, FEATURES), MODEL)
    t = Q.drift_summary(stage(per), Q.correlation_drift(a, b, MODEL, FEATURES), MODEL)
    return t.select("symbol", *qcols(["correlation_drift", "overall_severity"]), F.get("most_drifted", F.lit(0)).alias("top_feature"))


SHIFT = f"""yl AS MATERIALIZED (SELECT symbol, {HALF} AS early, 'y' AS feature, y AS value FROM x),
{KS_SQL.replace('FROM xl', 'FROM yl')},
ys AS (SELECT symbol, avg(value) FILTER (early) AS bm, stddev_pop(value) FILTER (early) AS bs, avg(value) FILTER (NOT early) AS lm,
  stddev_pop(value) FILTER (NOT early) AS ls FROM yl GROUP BY 1)"""


@query(
    "q03_target_shift",
    with_sql(*XS, SHIFT)
    + f"""SELECT symbol, {qs('abs(lm - bm) / bs')} AS mean_shift, {qs('abs(ls - bs) / bs')} AS variance_shift, {qs('d')} AS ks_statistic,
  {qs('least(1, 0.45::DOUBLE * least(abs(lm - bm) / bs / 3, 1) + 0.25::DOUBLE * least(abs(ls - bs) / bs / 3, 1) + 0.3::DOUBLE * d)')} AS severity
FROM ys JOIN ks USING (symbol)""",
)
def target_shift(spark, sf):
    a, b = halves(returns(spark, sf))
    t = Q.distribution_shift(a, b, MODEL, "y")
    return t.select("symbol", *qcols(["mean_shift", "variance_shift", "ks_statistic", "severity"]))


# --------------------------------------------------------------------------- predictions

PS = [H1, bars_sql("h1"), PREDICTIONS]


@query(
    "q09_resolve",
    with_sql(H1, bars_sql("h1"))
    + """SELECT symbol, count(*) FILTER (idx + 5 < n) AS n_resolved, count(*) FILTER (idx + 5 >= n) AS n_pending,
  round(count(*) FILTER (idx + 5 < n) / count(*), 6) AS coverage FROM b GROUP BY 1""",
)
def resolve(spark, sf):
    from sparkwick.plans.base import h1_bars

    bars = h1_bars(spark, sf)
    log = bars.select("symbol", "timeframe", C("bar_idx").alias("decision_idx"), F.lit(HORIZON).alias("horizon"))
    t = Q.coverage(*Q.resolve(log, bars), MODEL)
    return t.select("symbol", "n_resolved", "n_pending", F.round("coverage", 6).alias("coverage"))


def resolved(spark, sf):
    """Resolved return predictions: predicted and realised move, confidence, class outcome."""
    t = predictions(spark, sf)
    t = t.withColumns({"actual": C("y") - C("close"), "move": C("pred") - C("close")})
    t = t.withColumns(Q.outcome_columns("classification", "cls_y", "cls_p"))
    return stage(t.select("symbol", "bar_idx", "actual", "move", "confidence", "error", "is_correct", "probs", "cls_y", "cls_p", "y", "pred"))


@query(
    "q10_outcomes",
    with_sql(*PS)
    + f"""SELECT symbol, idx, {qs("1 - CASE cls_y WHEN 'SELL' THEN ps WHEN 'NO_TRADE' THEN pn ELSE pb END")} AS error, cls_p = cls_y AS is_correct FROM pr""",
)
def outcomes(spark, sf):
    return resolved(spark, sf).select("symbol", C("bar_idx").alias("idx"), q("error").alias("error"), "is_correct")


@query("q11_recent", with_sql(*PS) + "SELECT symbol, idx FROM pr QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY idx DESC) <= 200")
def recent(spark, sf):
    return Q.recent(predictions(spark, sf), MODEL, ["bar_idx"], 200).select("symbol", C("bar_idx").alias("idx"))


@query(
    "q12_snapshot_issues",
    """SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'task_type' WHEN event_id % 2 = 0 THEN concat_ws(',',
    CASE WHEN value * 4 > 100 THEN 'confidence_range' END, CASE WHEN user_id % 5 < 1 THEN 'horizon' END,
    CASE WHEN event_id % 3 = 0 THEN 'no_value' END)
  ELSE concat_ws(',', CASE WHEN value * 4 > 100 THEN 'confidence_range' END, CASE WHEN user_id % 5 < 1 THEN 'horizon' END,
    CASE WHEN user_id % 7 = 0 THEN 'probability_sum' END) END AS issues FROM events
WHERE event_id % 10 <> 0 OR true""".replace(
        "WHEN event_id % 10 = 0 THEN 'task_type'",
        "WHEN event_id % 10 = 0 THEN concat_ws(',', 'task_type', CASE WHEN value * 4 > 100 THEN 'confidence_range' END, "
        "CASE WHEN user_id % 5 < 1 THEN 'horizon' END)",
    ),
)
def snapshot_issues(spark, sf):
    e = C("event_id")
    task = F.when(e % 10 == 0, "other").when(e % 2 == 0, "regression").otherwise("classification")
    p = F.when(C("user_id") % 7 == 0, 0.4).otherwise(0.5)
    t = table(spark, sf, "events").select(
        "event_id",
        task.alias("task_type"),
        F.array(C("value")).alias("feature_vector"),
        F.array(F.lit("value")).alias("feature_names"),
        (C("value") * 4).alias("confidence"),
        (C("user_id") % 5).alias("horizon"),
        F.when(e % 3 != 0, C("value")).alias("predicted_value"),
        F.lit("BUY").alias("predicted_class"),
        F.create_map(F.lit("BUY"), p, F.lit("SELL"), F.lit(0.5)).alias("probs"),
    )
    return Q.snapshot_issues(t).select("event_id", F.array_join("issues", ",").alias("issues"))


@query(
    "q14_profit_factor",
    with_sql(*PS, "mv AS (SELECT symbol, pred - close AS p, y - close AS a FROM pr)")
    + f"""SELECT symbol, {qs('sum(CASE WHEN sign(p) * a > 0 THEN sign(p) * a ELSE 0 END) / sum(CASE WHEN sign(p) * a < 0 THEN -sign(p) * a ELSE 0 END)')} AS profit_factor,
  {qs('avg(p) / 0.01::DOUBLE', 3)} AS expected_mean_pips, {qs('avg(a) / 0.01::DOUBLE', 3)} AS actual_mean_pips, {qs('corr(p, a)')} AS correlation FROM mv GROUP BY 1""",
)
def profit_factor(spark, sf):
    t = Q.profit_factor(resolved(spark, sf), MODEL, "actual", "move", 0.01)
    return t.select("symbol", *qcols(["profit_factor", "correlation"]), *qcols(["expected_mean_pips", "actual_mean_pips"], 3))


@query("q13_performance")
def performance(spark, sf):
    t = Q.performance(resolved(spark, sf), MODEL, ["bar_idx"], 200, "regression", y="y", p="pred")
    return t.select("symbol", "scope", "n", "rmse", "mae", "r2")


CAL = """cb AS (SELECT symbol, least(floor(conf / 10), 9) AS b, count(*) AS n, avg(conf) AS mc, avg((cls_p = cls_y)::INT) * 100 AS acc FROM pr GROUP BY 1, 2)"""


@query(
    "q15_calibration",
    with_sql(*PS, CAL)
    + f"""SELECT symbol, {qs('sum(n * mc) / sum(n)')} AS mean_confidence, {qs('sum(n * acc) / sum(n)')} AS observed_accuracy,
  {qs('sum(n * abs(mc - acc)) / sum(n) / 100')} AS calibration_error, CASE WHEN sum(n * (mc - acc)) / sum(n) > 10 THEN 'overconfident'
    WHEN sum(n * (mc - acc)) / sum(n) < -10 THEN 'underconfident' ELSE 'well_calibrated' END AS status FROM cb GROUP BY 1""",
)
def calibration(spark, sf):
    t = Q.calibration(resolved(spark, sf), MODEL)
    return t.select("symbol", *qcols(["mean_confidence", "observed_accuracy", "calibration_error"]), "status")


# --------------------------------------------------------------------------- health

# model rows with every input of the health score, from order totals: one model per customer
ORD = """om AS (SELECT o_custkey, CASE WHEN o_custkey % 2 = 0 THEN 'regression' ELSE 'classification' END AS task_type,
  avg(o_totalprice) / 400000 AS accuracy, stddev_pop(o_totalprice) / 100000 AS historical_error, max(o_totalprice) / 400000 AS rolling_error,
  (o_custkey % 101)::DOUBLE AS prediction_stability, min(o_totalprice) / 400000 AS calibration_error, (o_custkey % 11) / 10.0::DOUBLE AS coverage,
  (o_custkey % 21) / 20.0::DOUBLE AS feature_severity, CASE WHEN o_custkey % 3 <> 0 THEN (o_custkey % 13) / 12.0::DOUBLE END AS target_severity,
  CASE WHEN o_custkey % 5 <> 0 THEN (o_custkey % 17) / 16.0::DOUBLE END AS regime_shift, (o_custkey % 60)::DOUBLE AS age_days,
  count(*) * 50 AS new_samples FROM orders GROUP BY 1)"""
_W = "greatest(0, least(100, "
HEALTH = f"""hl AS MATERIALIZED (SELECT *, {_W}0.2::DOUBLE * {_W}accuracy * 100)) + 0.1::DOUBLE * prediction_stability
    + 0.1::DOUBLE * 100 * (1 - least(calibration_error, 1)) + 0.15::DOUBLE * 100 * (1 - feature_severity)
    + 0.08::DOUBLE * coalesce(100 * (1 - target_severity), 70) + 0.08::DOUBLE * 70
    + 0.1::DOUBLE * {_W}100 * (2 - CASE WHEN historical_error <= 1e-12 THEN CASE WHEN rolling_error <= 1e-12 THEN 1 ELSE 2 END ELSE rolling_error / historical_error END)))
    + 0.09::DOUBLE * coalesce(100 * (1 - regime_shift), 70) + 0.05::DOUBLE * {_W}100 * (1 - age_days / 30))) + 0.05::DOUBLE * coverage * 100)) AS health_score FROM om)"""


def models(spark, sf):
    k = C("o_custkey")
    price = lambda fn, d: fn("o_totalprice") / d
    t = table(spark, sf, "orders").groupBy("o_custkey").agg(
        price(F.avg, 400000).alias("accuracy"),
        price(F.stddev_pop, 100000).alias("historical_error"),
        price(F.max, 400000).alias("rolling_error"),
        price(F.min, 400000).alias("calibration_error"),
        (F.count("*") * 50).alias("new_samples"),
    )
    t = t.withColumns(
        {
            "task_type": F.when(k % 2 == 0, "regression").otherwise("classification"),
            "prediction_stability": (k % 101).cast("double"),
            "coverage": (k % 11) / 10.0,
            "feature_severity": (k % 21) / 20.0,
            "target_severity": F.when(k % 3 != 0, (k % 13) / 12.0),
            "residual_severity": F.lit(None).cast("double"),
            "regime_shift": F.when(k % 5 != 0, (k % 17) / 16.0),
            "age_days": (k % 60).cast("double"),
            "mode": F.element_at(F.array(*map(F.lit, ("manual", "scheduled", "adaptive"))), (k % 3 + 1).cast("int")),
            "regime_shift_detected": k % 5 == 1,
            "drift_severity": (k % 21) / 20.0,
            "training_dataset_size": k,
            "calibration_status": F.when(k % 4 == 0, "overconfident").otherwise("well_calibrated"),
        }
    )
    t = t.withColumns({"drift_label": Q.severity_label(C("drift_severity")), "feature_label": Q.severity_label(C("feature_severity"))})
    return Q.health(t)


@query(
    "q16_health",
    with_sql(ORD, HEALTH)
    + f"""SELECT o_custkey, {qs('health_score')} AS health_score, CASE WHEN health_score >= 60 THEN 'good' WHEN health_score >= 30 THEN 'warning'
  ELSE 'critical' END AS health_status FROM hl""",
)
def health(spark, sf):
    return models(spark, sf).select("o_custkey", q("health_score").alias("health_score"), "health_status")


RETRAIN = """rt AS MATERIALIZED (SELECT *, (health_score < 60)::INT + (historical_error > 1e-12 AND (rolling_error - historical_error) / historical_error
    > CASE task_type WHEN 'regression' THEN 0.15::DOUBLE ELSE 0.1::DOUBLE END)::INT + (feature_severity > 0.3)::INT + (o_custkey % 5 = 1)::INT + (age_days > 30)::INT AS nt FROM hl)"""


@query(
    "q17_retraining",
    with_sql(ORD, HEALTH, RETRAIN)
    + """SELECT o_custkey, nt > 0 AND new_samples >= 200 AS recommended, CASE WHEN nt = 0 THEN 'none' WHEN health_score < 30 OR feature_severity >= 0.6 THEN 'critical'
  WHEN nt >= 3 THEN 'high' WHEN nt = 2 THEN 'medium' ELSE 'low' END AS priority FROM rt""",
)
def retraining(spark, sf):
    return Q.retraining_policy(models(spark, sf)).select("o_custkey", "recommended", "priority")


@query(
    "q18_due",
    with_sql(ORD, HEALTH)
    + """SELECT o_custkey, CASE o_custkey % 3 WHEN 1 THEN age_days >= 7 WHEN 2 THEN health_score < 60 AND feature_severity > 0.3 AND new_samples >= 200
  ELSE false END AS due FROM hl""",
)
def due(spark, sf):
    return Q.retraining_due(models(spark, sf), auto=True).select("o_custkey", "due")


CMP = """pc AS (SELECT o_custkey, avg(o_totalprice) FILTER (o_orderkey % 2 = 0) AS pv, avg(o_totalprice) FILTER (o_orderkey % 2 = 1) AS cv,
  (o_custkey % 10 + 1)::DOUBLE AS pm, (o_custkey % 7 + 1)::DOUBLE AS cm FROM orders GROUP BY 1 HAVING pv IS NOT NULL AND cv IS NOT NULL)"""


def compared(spark, sf):
    o = table(spark, sf, "orders")

    def side(parity: int, slow: int):
        t = o.where(C("o_orderkey") % 2 == parity).groupBy("o_custkey").agg(F.avg("o_totalprice").alias("rmse"))
        return t.withColumn("latency_ms", (C("o_custkey") % slow + 1).cast("double"))

    return Q.compare_models(side(0, 10), side(1, 7), ["o_custkey"], "rmse")


@query(
    "q19_compare",
    with_sql(CMP)
    + f"""SELECT o_custkey, {qs('(pv - cv) / pv')} AS relative_improvement, CASE WHEN (cm - pm) / pm > 0.5 THEN 'reject' WHEN (pv - cv) / pv >= 0.02 THEN 'deploy'
  WHEN abs((pv - cv) / pv) <= 0.005 THEN 'further_evaluation' ELSE 'reject' END AS decision FROM pc""",
)
def compare(spark, sf):
    return compared(spark, sf).select("o_custkey", q("relative_improvement").alias("relative_improvement"), "decision")


@query(
    "q19_importance_changes",
    f"""SELECT c AS model, s AS feature, {qs('coalesce(sum(b), 0) - coalesce(sum(a), 0)')} AS change FROM (
  SELECT o_custkey % 100 AS c, o_orderpriority AS s, CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN o_totalprice / 1e6 END AS a,
    CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN o_totalprice / 1e6 END AS b FROM orders) GROUP BY 1, 2""",
)
def importance_changes(spark, sf):
    o = table(spark, sf, "orders").withColumn("model", C("o_custkey") % 100)
    early = C("o_orderdate") < F.lit("1998-01-01").cast("timestamp")
    imp = lambda t: t.groupBy("model", C("o_orderpriority").alias("feature")).agg(
        F.sum(C("o_totalprice") / 1e6).alias("importance")
    )
    t = Q.importance_changes(imp(o.where(early)), imp(o.where(~early)), ["model"])
    return t.select("model", "feature", q("change").alias("change"))


@query(
    "q20_current_version",
    """WITH v AS (SELECT o_custkey AS model, o_orderkey AS version, o_orderdate AS pd, o_orderstatus = 'F' AS promoted FROM orders),
c AS (SELECT model, arg_max(version, (pd, version)) AS cur FROM v WHERE promoted GROUP BY 1)
SELECT v.model, version, CASE WHEN version = cur THEN 'production' WHEN promoted THEN 'archived' ELSE 'candidate' END AS status
FROM v LEFT JOIN c USING (model)""",
)
def current_version(spark, sf):
    v = table(spark, sf, "orders").select(
        C("o_custkey").alias("model"),
        C("o_orderkey").alias("version"),
        C("o_orderdate").alias("promoted_at"),
        (C("o_orderstatus") == "F").alias("promoted"),
        F.lit(10).alias("live_prediction_count"),
        F.lit(5).alias("correct_prediction_count"),
    )
    versions = v.drop("promoted_at", "promoted")
    t = Q.lifecycle(versions, v.where("promoted").select("model", "version", "promoted_at"), ["model"])
    return t.select("model", "version", "status")


@query(
    "q21_alerts",
    with_sql(ORD, HEALTH, RETRAIN)
    + """SELECT o_custkey, 'model_health_warning' AS type, CASE WHEN health_score < 30 THEN 'critical' ELSE 'warning' END AS severity FROM rt WHERE health_score < 60
UNION ALL SELECT o_custkey, 'feature_drift_alert', CASE WHEN feature_severity >= 0.6 THEN 'critical' ELSE 'warning' END FROM rt WHERE feature_severity >= 0.35
UNION ALL SELECT o_custkey, 'retraining_recommended', CASE WHEN health_score < 30 OR feature_severity >= 0.6 OR nt >= 3 THEN 'critical' ELSE 'warning' END
  FROM rt WHERE nt > 0 AND new_samples >= 200""",
)
def alerts(spark, sf):
    return Q.alerts(Q.retraining_policy(models(spark, sf)), ["o_custkey"], "warning")


@query("q22_report")
def compact_report(spark, sf):
    return Q.compact_report(Q.retraining_policy(models(spark, sf)), ["o_custkey"])
