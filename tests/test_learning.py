"""Selection, reduction, splits, models, feature frame and hypothesis tests."""

from __future__ import annotations

import glob

import numpy as np
import pandas as pd
import pytest
from conftest import assert_same
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ledgerlens.operators import features as ft
from ledgerlens.operators import hypothesis as h
from ledgerlens.operators import selection, shape
from ledgerlens.plans import feature_frame, model, reports, risk, split


@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=60)
    frame = pd.DataFrame({"id": range(60), "a": a, "twin": a * 2 + 1, "near": a + rng.normal(size=60) * 0.01, "other": rng.normal(size=60), "flat": 1.0})
    frame["sparse"] = np.where(np.arange(60) % 3 == 0, np.nan, frame["other"])
    frame["gaps"] = np.where(np.arange(60) % 6 == 0, np.nan, rng.normal(size=60))
    frame["half_flat"] = np.where(np.arange(60) % 12 == 0, np.nan, 2.0)
    frame["empty"] = np.nan
    return frame, spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "id long, " + ", ".join(f"{c} double" for c in frame.columns[1:]))


def test_correlations_equal_pandas(wide):
    local, df = wide
    columns = ["a", "twin", "near", "other", "sparse", "gaps"]
    np.testing.assert_allclose(selection.correlation_matrix(df.repartition(5), columns), local[columns].corr().to_numpy(), atol=1e-12)
    assert np.isnan(selection.correlation_matrix(df, ["a", "flat"])[0, 1])


def test_selection_reasons(wide):
    kept, report = selection.select_features(wide[1], ["id"])
    reasons = {r["column"]: r["reason"] for r in report.collect()}
    assert reasons == {
        "a": None,
        "twin": "highly_correlated",
        "near": "highly_correlated",
        "other": None,
        "flat": "low_information",
        "sparse": "highly_null",
        "gaps": None,
        "half_flat": "single_value",
        "empty": "highly_null",
    }
    assert kept.columns == ["id", "a", "other", "gaps"]
    again, second = selection.select_features(kept, ["id"])
    assert again.columns == kept.columns and second.where("NOT kept").count() == 0


def test_correlation_groups(wide):
    columns = ["a", "other", "twin", "near"]
    assert selection.correlation_groups(selection.correlation_matrix(wide[1], columns), columns) == [["a", "twin", "near"]]


@pytest.mark.parametrize("standardise", [False, True])
def test_reduction_explains_the_leading_variance(wide, standardise):
    local, df = wide
    columns = ["a", "twin", "other"]
    reduced, fitted = selection.reduce_features(df.select("id", *columns), ["id"], 2, standardise)
    points = np.array([r["v"] for r in reduced.select(vector_to_array("pca_features").alias("v")).collect()])
    x = local[columns].to_numpy()
    x = (x - x.mean(0)) / x.std(0, ddof=1) if standardise else x
    want = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1][:2]
    np.testing.assert_allclose(points.var(0, ddof=1), want, rtol=1e-8)
    assert reduced.columns == ["id", "pca_features"]


def test_reduction_indexes_text_and_imputes(spark):
    df = spark.createDataFrame([(1, "x", 1.0), (2, "y", None), (3, "x", 3.0), (4, None, 2.0)], "id long, s string, v double")
    reduced, fitted = selection.reduce_features(df, ["id"], 10)
    assert reduced.count() == 4 and fitted.stages[-1].getK() == 2
    only_numbers, _ = selection.reduce_features(df.drop("s"), ["id"], 1)
    assert only_numbers.count() == 4


def labelled(spark, n=10):
    return spark.createDataFrame([(i, 7, i % 2) for i in range(1, n + 1)], "LOAN_ID long, MAIN_SYSTEM_ID long, label int")


def test_split_parts_by_hand(spark):
    """Percent ranks of ids 1..10 are 0/9 .. 9/9; odd ids have label 1."""
    got = {r["LOAN_ID"]: r["split"] for r in split.stratified_time_split(labelled(spark)).collect()}
    assert [i for i in got if got[i] == "test"] == [9, 10] or sorted(i for i in got if got[i] == "test") == [9, 10]
    assert sorted(i for i in got if got[i] == "validation") == [7, 8]
    assert len(got) == 10


def test_splits_are_disjoint_and_complete(spark):
    parted = split.stratified_time_split(labelled(spark, 101))
    audit = split.split_audit(parted).collect()
    assert sum(r["train"] + r["validation"] + r["test"] for r in audit) == 101
    assert split.train_rows(parted).count() + split.test_rows(parted).count() == 101
    newest_train = {r["label"]: r["m"] for r in split.train_rows(parted).groupBy("label").agg(F.max("LOAN_ID").alias("m")).collect()}
    oldest_test = {r["label"]: r["m"] for r in split.test_rows(parted).groupBy("label").agg(F.min("LOAN_ID").alias("m")).collect()}
    assert all(newest_train[k] < oldest_test[k] for k in newest_train)


def test_folds_run_forward(spark):
    folds = split.time_folds(labelled(spark, 60), folds=5)
    bounds = folds.groupBy("fold").agg(F.min("LOAN_ID").alias("lo"), F.max("LOAN_ID").alias("hi")).orderBy("fold").collect()
    assert [r["fold"] for r in bounds] == list(range(6))
    assert all(a["hi"] < b["lo"] for a, b in zip(bounds, bounds[1:]))


def test_layouts_are_written(spark, tmp_path):
    frame = labelled(spark, 20).withColumn("a", F.col("LOAN_ID").cast("double")).withColumn("b", F.rand(3))
    reduced, _ = selection.reduce_features(frame.drop("label"), ["LOAN_ID", "MAIN_SYSTEM_ID"], 2)
    parted = split.stratified_time_split(reduced.join(labelled(spark, 20), "LOAN_ID").select("LOAN_ID", reduced["MAIN_SYSTEM_ID"], "pca_features", "label"))
    split.write_layouts(parted, str(tmp_path), "pca_features", 2)
    flat = spark.read.parquet(str(tmp_path / "train-flat"))
    assert flat.columns == ["LOAN_ID", "MAIN_SYSTEM_ID", "label", "principal_component_0", "principal_component_1"]
    vectors = spark.read.parquet(str(tmp_path / "train-vector"))
    assert {"pca_features", "is_validation", "stratified_split"} <= set(vectors.columns)
    assert flat.count() + spark.read.parquet(str(tmp_path / "test-vector")).count() == 20
    assert glob.glob(str(tmp_path / "test-flat" / "*.parquet"))


@pytest.fixture(scope="module")
def learnable(spark):
    rows = [(i, float((i * 7) % 13), float((i * 5) % 11), int((i * 7) % 13 > 8)) for i in range(260)]
    df = spark.createDataFrame(rows, "LOAN_ID long, x double, y double, label int")
    return VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(df).withColumn("label", F.col("label").cast("double"))


def test_classifier_learns_and_metrics_agree(learnable):
    parted = split.stratified_time_split(learnable)
    fitted = model.fit_classifier(split.train_rows(parted), depth=3, trees=5)
    scored = fitted.transform(split.test_rows(parted))
    assert model.area_under_pr(scored) > 0.99
    noisy = learnable.withColumn("prediction", (F.col("x") > 6).cast("double"))
    row = model.classification_metrics(noisy, F.col("label") == 1, F.col("prediction") == 1).first()
    for beta, name in [(2.0, "f_2_0"), (1.0, "f_1_0"), (0.5, "f_0_5")]:
        assert row[name] == pytest.approx(model.f_beta(noisy, beta))
    assert row["recall"] == 1.0 and row["precision"] < 1.0


def test_class_weights_balance(learnable):
    weights = model.balance_weights(learnable).groupBy("label").agg(F.sum("weight").alias("w")).collect()
    assert weights[0]["w"] == pytest.approx(weights[1]["w"]) == pytest.approx(130.0)


def test_forward_search_prefers_the_better_model(learnable):
    folded = split.time_folds(learnable.withColumn("label", 3 * F.col("x") + 0.5 * F.col("y") + 0.01 * F.col("LOAN_ID")), folds=2)
    grid = {k: v for k, v in model.candidates().items() if k in ("linear", "boosted_trees")}
    best, scores = model.forward_search(folded, grid, folds=2)
    assert type(best).__name__ == "LinearRegressionModel"
    assert {r["model"] for r in scores.where("best").collect()} == {"linear"} and scores.count() == 4


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 4.0), (6.0, 5.0)], "label double, prediction double")
    got = model.regression_metrics(df).first()
    assert got["mae"] == pytest.approx(1.0) and got["mse"] == pytest.approx(5 / 3) and got["r2"] == pytest.approx(1 - (5 / 3) / (14 / 3))


# --- feature frame -------------------------------------------------------------------------------------------------


def test_point_in_time_ignores_the_future(spark, views):
    """Adding child rows after all loans changes nothing."""
    last = views["loans"].agg(F.max("LOAN_ISSUANCE_DATE")).first()[0]
    late = views["purchases"].limit(40).withColumn("ORDER_CREATION_DATE", F.lit(last) + F.expr("INTERVAL 1 SECOND")).withColumn("ORDER_ID", F.col("ORDER_ID") + 10**9)
    more = views["purchases"].unionByName(late.select(views["purchases"].columns))
    build = lambda p: ft.point_in_time(views["loans"], ft.Entity(p, "ORDER_ID", "ORDER_CREATION_DATE"), "MAIN_SYSTEM_ID", ["ORDER_PRICE"])
    assert_same(build(views["purchases"]), build(more))


def test_secondary_time_masks(spark):
    from datetime import datetime

    t = lambda d: datetime(2024, 1, d)
    sales = spark.createDataFrame([(1, 5, t(1), t(9), 10.0, "OK"), (2, 5, t(2), t(3), 4.0, "OK")], "ID long, k long, c timestamp_ntz, u timestamp_ntz, paid double, s string")
    loans = spark.createDataFrame([(1, 5, t(4)), (2, 5, t(9)), (3, 6, t(4))], "LOAN_ID long, k long, LOAN_ISSUANCE_DATE timestamp_ntz")
    out = ft.point_in_time(loans, ft.Entity(sales, "ID", "c", {"u": ["paid", "s"]}), "k", ["paid"], ["s"])
    got = {r["LOAN_ID"]: (r["count"], r["sum_paid"], r["num_unique_s"]) for r in out.collect()}
    assert got == {1: (2, 4.0, 1), 2: (2, 14.0, 1), 3: (0, None, 0)}


@pytest.mark.parametrize("cutoff", ["issuance", None])
def test_feature_frame_has_one_row_per_loan(views, cutoff):
    frame, defs = feature_frame.build_feature_frame(views, cutoff)
    assert frame.count() == views["loans"].count()
    names = {r["name"] for r in defs.collect()}
    assert names == set(frame.columns) - {"LOAN_ID", "MAIN_SYSTEM_ID", "LOAN_AMOUNT", "TOTAL_INITIAL_AMOUNT"}


def test_feature_frame_without_children(views):
    frame, defs = feature_frame.build_feature_frame({"loans": views["loans"]})
    assert frame.count() == views["loans"].count() and defs.where("family = 'point_in_time'").count() == 0


def test_merged_definitions(spark):
    left, right = (spark.createDataFrame([(1, 2)], f"LOAN_ID long, {c} int") for c in "ab")
    one = ft.feature_defs(spark, ft.unary_features(["x"]))
    two = ft.feature_defs(spark, ft.unary_features(["x", "y"]))
    frame, defs = ft.merge_frames(left, right, one, two, "LOAN_ID")
    assert frame.columns == ["LOAN_ID", "a", "b"] and defs.count() == 16


# --- hypothesis tests ----------------------------------------------------------------------------------------------


def test_bootstrap_interval_has_the_right_moments(spark):
    hits = spark.createDataFrame([(7, 1.0, 1000, 300)], "window int, limit double, n long, hits long")
    row = h.bootstrap_share_ci(hits, rounds=1000).first()
    sd = (0.3 * 0.7 / 300) ** 0.5
    assert row["lower"] == pytest.approx(0.3 - 1.96 * sd, abs=0.01) and row["upper"] == pytest.approx(0.3 + 1.96 * sd, abs=0.01)
    assert tuple(h.bootstrap_share_ci(hits, rounds=1000).first()) == tuple(row)  # repeatable


def test_poisson_weights_have_mean_and_variance_one():
    base = np.random.default_rng(1).integers(0, 1 << 63, 4000, dtype=np.uint64)
    w = h.round_weights(base, 200)
    assert w.mean() == pytest.approx(1.0, abs=0.005) and w.var() == pytest.approx(1.0, abs=0.01)
    assert abs(np.corrcoef(w[:50])[np.triu_indices(50, 1)]).max() < 0.1  # rounds do not depend on each other
    assert (h.round_weights(base[:7], 200) == w[:, :7]).all()  # a row weighs the same in any batch
    counts = np.bincount(w.astype(int).ravel(), minlength=4)[:4] / w.size
    assert counts == pytest.approx(np.exp(-1) / np.array([1, 1, 2, 6]), abs=0.002)


def test_bootstrap_does_not_depend_on_partitions(spark):
    rows = spark.createDataFrame([(i, None if i % 7 == 0 else float(i % 13)) for i in range(3000)], "k long, x double")
    one, many = (h.poisson_bootstrap(rows.repartition(n), "k", "x", 50).orderBy("round").collect() for n in (1, 9))
    assert [(r["round"], r["weight"]) for r in one] == [(r["round"], r["weight"]) for r in many]
    assert [r["total"] for r in one] == pytest.approx([r["total"] for r in many])
    spread = np.std([r["mean"] for r in h.poisson_bootstrap(rows, "k", "x", 400).collect()])
    known = [i % 13 for i in range(3000) if i % 7]
    assert spread == pytest.approx(np.std(known) / len(known) ** 0.5, rel=0.15)


def test_verdict(spark):
    rows = spark.createDataFrame([(7, 0.2, 0.3), (30, 0.21, 0.3)], "window int, lower double, upper double")
    assert [r["reject"] for r in h.verdict(rows).orderBy("window").collect()] == [False, True]


# --- decisions and reports -----------------------------------------------------------------------------------------


def test_unknown_deviation_denies(spark):
    mart = spark.createDataFrame([(1, 1.0, 1.0, 5.0, None), (2, 1.0, 1.0, 5.0, 0.0), (3, 6.0, 1.0, 5.0, 1.0), (4, 7.1, 1.0, 5.0, 1.0)],
        "LOAN_ID long, y_pred double, LOAN_AMOUNT double, ROLLINGMEAN_30DAYS__ORDER_PRICE__ double, ROLLINGSTDDEV_30DAYS__ORDER_PRICE__ double")
    got = {r["LOAN_ID"]: r["d"] for r in risk.decide(mart, 1, "d").collect()}
    assert got == {1: False, 2: True, 3: True, 4: False}


def test_growth_then_drop(spark):
    report = spark.createDataFrame([(1, 2, 1.0), (2, 4, None), (3, 6, 3.0), (4, 0, 3.0), (5, 9, 1.0)], "week_dt int, n int, loss double")
    out = reports.growth(report, ["n", "loss"]).dropna().orderBy("week_dt").collect()
    assert [(r["week_dt"], r["n_weekly_growth"]) for r in out] == [(4, 0.0)]  # week 3 has no ratio of losses, week 5 divides by zero


def test_joined_and_carried_decisions_agree(views):
    loans = views["loans"].withColumn("y_pred", F.col("SPENT"))
    mart = risk.risk_mart(loans, views["purchases"])
    for policy in risk.POLICIES:
        assert_same(reports.policy_counts(mart, None, policy), reports.policy_counts(views["loans"], risk.decisions(mart), policy))


def test_label_join(views):
    label = shape.make_label(views["loans"], "SPENT")
    assert label.count() == views["loans"].where("SPENT > 0").count()
