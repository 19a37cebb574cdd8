"""Models, strategies and monitoring on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from sparkwick.operators import isotonic
from sparkwick.operators import logistic as LR
from sparkwick.operators import models as L
from sparkwick.operators import monitor as Q
from sparkwick.operators import strategy as R
from sparkwick.sources.staging import stage

C = F.col


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(3)
    out = []
    for i in range(400):
        x, z = r.gauss(0, 1), r.gauss(0, 2)
        y = 1.5 * x - 0.5 * z + r.gauss(0, 0.3)
        cls = 2 if y > 0.7 else 0 if y < -0.7 else 1
        out.append((i, x, z, y, float(cls)))
    return stage(spark.createDataFrame(out, "sample_idx long, x double, z double, y double, cls double"))


def test_linear_kinds_agree_with_mllib(rows):
    for kind, alpha in (("linear", 0.0), ("ridge", 30.0), ("lasso", 0.05), ("elasticnet", 0.05)):
        mine, _ = L.train_linear(rows, ["x", "z"], "y", kind, alpha, bootstrap=0)
        other = L.spark_linear(rows, ["x", "z"], "y", kind, alpha)
        assert list(mine.coef) == pytest.approx(list(other.coef), abs=2e-3), kind


def test_bootstrap_and_forecast(rows):
    fit, members = L.train_linear(rows, ["x", "z"], "y", "ridge")
    assert len(members) == L.ROUNDS and fit.stats["train_r2"] > 0.9
    t = L.forecast(rows, {"next_return": (fit, members)})
    row = t.select(C("prediction_interval")["expected_return"].alias("b"), "expected_return", "forecast_confidence").first()
    assert row["b"]["lower"] < row["expected_return"] < row["b"]["upper"]
    assert 0 <= row["forecast_confidence"] <= 100


def test_cross_validation(rows):
    folds, total = L.cross_validate(rows, ["x", "z"], "y", "ridge")
    assert len(folds) == 5 and total["mean_r2"] > 0.9


@pytest.mark.parametrize("calibration", ["none", "platt", "isotonic"])
def test_logistic(rows, calibration):
    fit = L.train_logistic(rows, ["x", "z"], "cls", calibration=calibration)
    t = fit.score(rows).withColumns(L.probability_summary())
    names = {0.0: "SELL", 1.0: "NO_TRADE", 2.0: "BUY"}
    got = t.select("cls", "predicted_class", "sums_to_one").collect()
    assert all(r["sums_to_one"] for r in got)
    # per-class curves see one margin each; the middle class's own margin says little
    least = 0.75 if calibration == "none" else 0.6
    assert sum(names[r["cls"]] == r["predicted_class"] for r in got) / len(got) > least


def test_balancing(rows):
    sizes = lambda m: {r["cls"]: r["n"] for r in L.balance(rows, "cls", m).groupBy("cls").agg(F.count("*").alias("n")).collect()}
    plain = sizes("none")
    over = sizes("oversample")
    assert min(over.values()) > 0.85 * max(plain.values())


def test_presets_are_valid():
    assert all(not s.issues() for s in R.PRESETS)
    bad = R.Strategy("bad", {"trend": 50, "nope": 10}, disabled=("rsi",))
    assert set(bad.issues()) == {"unknown_rule:nope", "weight_sum", "unknown_disabled:rsi"}


def test_same_distribution_has_no_drift(rows):
    long = rows.select(F.lit("m").alias("m"), F.lit("x").alias("feature"), C("x").alias("value"))
    same = Q.feature_drift(long, long, ["m"]).first()
    moved = Q.feature_drift(long, long.withColumn("value", C("value") + 3), ["m"]).first()
    assert same["drift_score"] < 0.05 and same["ks_statistic"] == 0
    assert moved["drift_score"] > 0.5 and moved["ks_pvalue"] < 1e-6


def test_drift_with_features_of_one_side(rows):
    one = lambda n: rows.select(F.lit("m").alias("m"), F.lit(n).alias("feature"), C("x").alias("value"))
    t = Q.feature_drift(one("a").union(one("gone")), one("a").union(one("new")), ["m"])
    got = {r["feature"]: r for r in t.collect()}
    assert {f: r["presence"] for f, r in got.items()} == {"a": "both", "gone": "missing", "new": "unexpected"}
    assert got["gone"]["drift_score"] == 1.0 and got["gone"]["missing_frequency"] == 1.0
    assert got["new"]["drift_score"] is None and got["a"]["drift_score"] < 0.05
    ks = {r["feature"]: r for r in Q.ks_test(one("a"), one("a").union(one("new")), ["feature"]).collect()}
    assert ks["new"]["ks_statistic"] is None and ks["a"]["ks_pvalue"] == 1.0
    shift = Q.distribution_shift(one("a"), one("new"), ["feature"]).collect()
    assert {r["feature"] for r in shift} == {"a", "new"}


def test_combined_severity_of_nothing_is_null(spark):
    t = spark.createDataFrame([(None, None), (0.5, None)], "a double, b double")
    assert [r[0] for r in t.select(Q.combined_severity(C("a"), C("b"))).collect()] == [None, 0.5]


def test_ranks_share_ties_with_a_hot_value(spark):
    from sparkwick.operators.diagnostics import average_ranks

    t = spark.createDataFrame([("k", i, 0.0 if i % 4 else float(i)) for i in range(400)], "k string, id int, v double")
    got = {r["id"]: r["rank"] for r in average_ranks(t, ["k"], "v").collect()}
    assert len(got) == 400 and got[1] == got[399] == got[0] == (1 + 301) / 2.0
    assert got[4] == 302.0 and got[396] == 400.0


def test_health_defaults_for_unknown_parts(spark):
    t = spark.createDataFrame(
        [("regression", 0.5, 1.0, 1.0, 80.0, 0.1, 1.0, 0.2, None, None, None, None)],
        "task_type string, accuracy double, historical_error double, rolling_error double, prediction_stability double,"
        " calibration_error double, coverage double, feature_severity double, target_severity double,"
        " residual_severity double, regime_shift double, age_days double",
    )
    r = Q.health(t).first()
    assert r["h_target_drift"] == r["h_residual_drift"] == r["h_market_regime_change"] == r["h_training_age"] == 70.0
    assert r["health_status"] == "good"


def test_fitted_preprocessing_is_never_refitted(spark):
    from sparkwick.operators import dataset as D

    names = ["a", "a_valid", "flat"]
    make = lambda rows: spark.createDataFrame(rows, "id int, a double, a_valid double, flat double")
    train = make([(i, float(i), float(i % 4 > 0), 7.0) for i in range(40)])
    fitted = D.fit_preprocessor(train, names)
    assert fitted.names == ["a", "a_valid"] and len(fitted.schema) == 64
    new = fitted.apply(make([(1, 1000.0, 1.0, 9.0), (2, -5.0, 0.0, 9.0)])).orderBy("id").collect()
    c, d = fitted.scaler["a"]
    assert new[0]["a"] == pytest.approx((1000.0 - c) / d)
    assert new[1]["a"] == pytest.approx((fitted.medians["a"] - c) / d)
    assert set(new[0].asDict()) == {"id", "a", "a_valid"}
    for wrong in (["a_valid", "a", "flat"], ["a", "a_valid"], [*names, "b"]):
        with pytest.raises(ValueError):
            fitted.apply(train, wrong)
    with pytest.raises(ValueError):
        fitted.apply(train.drop("flat"))


def test_isotonic_curves_equal_the_library(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    r = random.Random(4)
    data = [(k, float(r.randint(0, 60)), float(r.random() < 0.2 + i / 900), i + 400 * n) for n, k in enumerate("ab") for i in range(400)]
    data += [("a", None, 1.0, 900), ("one", 5.0, 1.0, 901)]
    df = spark.createDataFrame(data, "k string, x double, y double, row long")
    blocks = isotonic.fit(df, ["k"], "x", "y")
    ends = blocks.orderBy("k", "lo").collect()
    for a, b in zip(ends, ends[1:]):
        assert a.k != b.k or (a.hi < b.lo and a.value < b.value)
    got = {x.row: x.fitted for x in isotonic.apply(df, blocks, ["k"], F.col("x") * 1.1 - 2).collect()}
    assert len(got) == len(data) and got[900] is None and got[901] == 1.0
    for k in ("a", "b"):
        own = VectorAssembler(inputCols=["x"], outputCol="v").transform(df.where((F.col("k") == k) & F.col("x").isNotNull()))
        m = IsotonicRegression(featuresCol="v", labelCol="y").fit(own)
        want = m.transform(VectorAssembler(inputCols=["z"], outputCol="w").transform(own.withColumn("z", F.col("x") * 1.1 - 2)).drop("v").withColumnRenamed("w", "v"))
        for x in want.collect():
            assert abs(got[x.row] - x.prediction) < 1e-9
    empty = df.where("k = 'none'")
    assert isotonic.fit(empty, ["k"], "x", "y").count() == 0
    assert all(x.fitted is None for x in isotonic.apply(df, isotonic.fit(empty, ["k"], "x", "y"), ["k"], "x").collect())


def test_bootstrap_agreement_of_a_separable_case(rows):
    fit = L.train_logistic(rows, ["x", "z"], "cls")
    other = L.train_logistic(rows, ["x", "z"], "cls", calibration="isotonic")
    t = L.bootstrap_agreement(rows, fit, [fit, fit, other])
    shares = {x.bootstrap_agreement for x in t.select("bootstrap_agreement").distinct().collect()}
    assert shares <= {2 / 3, 1.0} and 1.0 in shares


def test_logistic_models_of_many_keys_equal_single_fits(spark):
    r = random.Random(8)
    data = []
    for n, k in enumerate(("a", "b", "hot")):
        for i in range(150 * (1 + 2 * n)):
            x, z = r.gauss(0, 1), r.gauss(n, 2)
            s = x * (n - 1) + 0.4 * z + r.gauss(0, 0.6)
            data.append((k, len(data), x, z, 2 if s > 0.8 else 0 if s < -0.2 else 1))
    data += [("poor", len(data) + i, 0.5, float(i), i % 2) for i in range(20)]
    data += [("a", 100_000, None, 1.0, 1), ("a", 100_001, 1.0, 1.0, None)]
    df = stage(spark.createDataFrame(data, "k string, sample_idx long, x double, z double, cls int"))
    models = LR.fit_by_key(df, ["k"], ["x", "z"], "cls", 3, members=2)
    assert sorted((m.k, m.member) for m in models.collect()) == [(k, i) for k in ("a", "b", "hot") for i in range(3)]
    got = {x.sample_idx: x for x in LR.score_by_key(df.dropna(), models, ["k"], ["x", "z"], 3, "sample_idx").collect()}
    for k in ("a", "b", "hot"):
        own = df.where(F.col("k") == k).dropna().withColumn("cls", F.col("cls").cast("double"))
        fit = L.train_logistic(own, ["x", "z"], "cls")
        for x in fit.score(own).collect():
            want = [x.probs[c] for c in L.CLASSES]
            mine = got[x.sample_idx]
            assert max(abs(a - b) for a, b in zip(mine.probabilities, want)) < 1e-4
            assert mine.agreement in (0.0, 0.5, 1.0)
    assert not any(x.k == "poor" for x in got.values())
