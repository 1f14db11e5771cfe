"""Moments in tiles, reductions learned from some rows, and chains that see nothing of later ones."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from ledgerlens.operators import moments, reduction, selection
from ledgerlens.plans import feature_frame, model, split
from ledgerlens.schemas import KEY


def sample(rows, columns, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(rows, 6)) @ rng.normal(size=(6, columns)) + 0.3 * rng.normal(size=(rows, columns)) + 1e4 * rng.random(columns)
    x[rng.random(x.shape) < 0.05] = np.nan
    return pd.DataFrame(x, columns=[f"c {i}" for i in range(columns)])


@pytest.fixture(scope="module")
def wide(spark):
    local = sample(400, 150)
    local["flat"] = 3.0
    return local, spark.createDataFrame(local.astype(object).where(local.notna(), None), ", ".join(f"`{c}` double" for c in local.columns)).repartition(4)


def matrix(df, columns):
    out = np.full((len(columns), len(columns)), np.nan)
    for r in moments.pair_correlations(df, columns).collect():
        out[r["i"], r["j"]] = np.nan if r["corr"] is None else r["corr"]
    return out


def test_correlations_of_several_tiles(wide, monkeypatch):
    local, df = wide
    columns = list(local.columns)
    want = local.corr().to_numpy()
    upper = np.triu_indices(len(columns), 1)
    np.testing.assert_allclose(matrix(df, columns)[upper], want[upper], atol=1e-9)
    monkeypatch.setattr(moments, "WIDEST", 80)  # several stripes, a scan each
    assert len(moments._stripes(3)) == 3
    np.testing.assert_allclose(matrix(df, columns)[upper], want[upper], atol=1e-9)


def test_a_tile_is_the_widest_row(wide):
    _, df = wide
    rows = moments.tiles(df, df.columns).select("i", "j", F.size("v").alias("n")).collect()
    assert {(r["i"], r["j"]) for r in rows} == {(i, j) for i in range(3) for j in range(i, 3)}
    assert max(r["n"] for r in rows) == len(moments.SUMS) * moments.TILE**2


def test_one_scan_of_a_thousand_columns(spark, capsys):
    df = spark.range(10).select(*[(F.col("id") * i).alias(f"c{i}") for i in range(1000)])
    moments.tiles(df, df.columns, np.zeros(1000)).explain("simple")
    plan = capsys.readouterr().out
    assert plan.count("MapInArrow") == 1 and plan.count("Range (") == 1


def plain_components(local, k):
    filled = local.fillna(local.mean())
    z = ((filled - filled.mean()) / filled.std()).to_numpy()
    values, vectors = np.linalg.eigh(np.cov(z.T))
    best = np.argsort(-values)[:k]
    return z @ vectors[:, best], values[best]


@pytest.mark.parametrize("dense", [512, 10])
def test_components_are_those_of_the_covariance(spark, wide, dense):
    """By the matrix and by the range finder, up to signs."""
    local, _ = wide
    local = local.drop(columns="flat").iloc[:, :60]
    rows = local.assign(id=range(len(local)))
    df = spark.createDataFrame(rows.astype(object).where(rows.notna(), None), ", ".join(f"`{c}` {'long' if c == 'id' else 'double'}" for c in rows.columns)).repartition(3)
    learned = reduction.fit(df, ["id"], k=5, max_corr=1.1, dense=dense)
    scores, variances = plain_components(local, 5)
    np.testing.assert_allclose(learned.variances, variances, rtol=1e-6)
    got = learned.apply(df).select("id", vector_to_array("features").alias("v")).orderBy("id").collect()
    np.testing.assert_allclose(np.abs(np.array([r["v"] for r in got])), np.abs(scores), atol=1e-6 * np.abs(scores).max())


def test_selection_is_that_of_the_plain_report(spark, views):
    frame = feature_frame.build_feature_frame({"loans": views["loans"]})[0].persist()
    ids = ["LOAN_ID", KEY]
    learned = reduction.fit(frame, ids, k=3)
    numeric = selection.numeric_frame(frame, ids)
    report = {r["column"]: r for r in selection.select_features(numeric, ids)[1].collect()}
    for c, r in report.items():
        if r["reason"] != "highly_correlated" and c in numeric.columns and dict(numeric.dtypes)[c] != "string":
            assert (learned.reasons.get(c) is None) == r["kept"] or learned.reasons.get(c) == "highly_correlated", c


def test_text_and_unseen_values(spark):
    rows = [(i, "ab"[i % 2], float(i), None if i % 3 else 1.0 + i) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, kind string, x double, y double")
    learned = reduction.fit(df, ["id"], k=2, max_null=0.9)
    later = spark.createDataFrame([(100, "new", None, None), (101, None, 2.0, 3.0)], df.schema)
    out = learned.apply(later, "kind").orderBy("id").collect()
    assert [r["kind"] for r in out] == ["new", None] and all(len(r["features"]) == 2 and np.isfinite(r["features"].toArray()).all() for r in out)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, None, 2.0)], "id long, a double, b double")
    learned = reduction.fit(df, ["id"])
    assert learned.columns == () and {r["features"].size for r in learned.apply(df).collect()} == {0}


def test_later_loans_change_no_earlier_fold(spark, views):
    """Every number of a fold stays the same when loans after it are turned upside down."""
    loans = views["loans"]
    frame = feature_frame.loan_transforms(loans.select("LOAN_ID", KEY, "LOAN_ISSUANCE_DATE", "INITIAL_DATE", "LOAN_AMOUNT", "TOTAL_INITIAL_AMOUNT"))[0].drop("LOAN_ISSUANCE_DATE", "INITIAL_DATE")
    folded = split.time_folds(frame.join(loans.select("LOAN_ID", F.col("SPENT").alias("label")), "LOAN_ID"), folds=3).persist()
    aside = ["label", "stratified_split", "fold"]
    late = F.col("fold") >= 2
    changed = folded.select(*[F.when(late, -7 * F.col(f"`{c}`") + F.rand(3)).otherwise(F.col(f"`{c}`")).alias(c) if t == "double" and c not in aside[1:] else F.col(f"`{c}`") for c, t in folded.dtypes])
    grid = {"linear": LinearRegression(regParam=0.1, featuresCol="features", labelCol="label")}
    scores = []
    for rows in (folded, changed):
        found = model.forward_search(model.reduced_folds(rows, ["LOAN_ID", KEY], aside, 3, k=4), grid, folds=3)[1]
        scores.append({r["fold"]: tuple(r)[2:6] for r in found.collect()})
    assert scores[0][1] == pytest.approx(scores[1][1], rel=1e-9)
    assert scores[0][2] != pytest.approx(scores[1][2], rel=1e-3) and scores[0][3] != pytest.approx(scores[1][3], rel=1e-3)


def test_folds_learn_what_each_would_alone(spark, monkeypatch):
    """Sums that are added up over folds give the reductions of one fit per fold, and one table holds all their features."""
    rng = np.random.default_rng(5)
    rows = [
        (i, i // 40, "abc"[int(rng.integers(0, 3)) if i >= 40 else i % 2], float(x), None if i % 7 == 0 else float(2 * x + y), float(y), 4.0 if i < 80 else float(y * x), None if i < 120 else 1.0, float("nan") if i < 40 else 2.0)
        for i, (x, y) in enumerate(rng.normal(size=(240, 2)) * 10 + 1000)
    ]
    df = spark.createDataFrame(rows, "id long, fold int, kind string, x double, `two y` double, y double, late double, rare double, odd double").repartition(3)
    learned = reduction.fit_before(df, ["id"], "fold", 5, k=3)
    for f, got in enumerate(learned, 1):
        want = reduction.fit(df.where(F.col("fold") < f).drop("fold"), ["id"], k=3)
        assert (got.columns, got.reasons) == (want.columns, want.reasons), f
        for a, b in ((got.mean, want.mean), (got.scale, want.scale), (got.variances, want.variances), (got.components, want.components)):
            np.testing.assert_allclose(a, b, rtol=1e-9, atol=1e-9)
    written = []
    monkeypatch.setattr(model, "materialise", lambda rows: written.append(rows) or rows)
    for f, found in enumerate(model.reduced_folds(df, ["id"], ["fold"], 5, k=3), 1):
        got = {r["id"]: r["features"].toArray() for r in found.collect()}
        want = {r["id"]: r["features"].toArray() for r in learned[f - 1].apply(df.where(F.col("fold") <= f)).collect()}
        assert set(got) == set(want) and all(np.allclose(got[i], want[i]) for i in want)
    assert len(written) == 1


def test_a_text_does_not_make_the_facts_of_numbers_sorted(spark, capsys):
    """Only texts are aggregated by sorting, and no aggregation has more buffers than Spark generates code for."""
    df = spark.range(50).select(*[(F.col("id") % (i + 1)).cast("double").alias(f"c{i}") for i in range(70)], F.col("id").cast("string").alias("text"))
    facts = selection.column_facts(df, df.columns)
    facts.explain("simple")
    plan = capsys.readouterr().out
    assert plan.count("SortAggregate(") == 2 and plan.count("HashAggregate(") == 6
    got = {r["column"]: r for r in facts.collect()}
    assert len(got) == 71 and got["c0"]["constant"] and not got["text"]["constant"] and all(r["non_null"] == 50 for r in got.values())


def test_scaling_and_components_read_one_written_column(spark, monkeypatch):
    df = spark.createDataFrame([(i, "xyz"[i % 3], None if i % 5 == 0 else float(i), float(i * i % 7)) for i in range(60)], "id long, s string, v double, w double")
    written = []
    monkeypatch.setattr(selection, "materialise", lambda rows: written.append(rows.columns) or rows)
    reduced, fitted = selection.reduce_features(df, ["id"], 2, standardise=True)
    assert written == [["id", "assembled_features"]]
    again = fitted.transform(selection.numeric_frame(df, ["id"]))
    assert [r["pca_features"] for r in reduced.orderBy("id").collect()] == [r["pca_features"] for r in again.orderBy("id").collect()]
