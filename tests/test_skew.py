"""Every ordered operator gives the same answer when all keys are treated as heavy and cut into small pieces."""

from __future__ import annotations

import pytest
from conftest import assert_same
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.operators import features as ft
from ledgerlens.operators import profiling, quantiles, series, skew
from ledgerlens.operators.skew import heavy_keys, measure, numbered, ranked, running, windowed

KEY, TS, X = "MAIN_SYSTEM_ID", "ORDER_CREATION_DATE", "ORDER_PRICE"
ORDER = [TS, "ORDER_ID"]
FORCE = {"hot_rows": 1, "share": 0.0}


@pytest.fixture(scope="module")
def orders(views):
    return views["purchases"]


@pytest.fixture(scope="module")
def by_time(orders):
    return measure(orders, KEY, TS, pieces=5, **FORCE)


@pytest.fixture(scope="module")
def by_value(orders):
    return measure(orders, KEY, X, pieces=5, **FORCE)


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(skew, "BLOCK", 3)


def test_measure_finds_only_heavy_keys(spark):
    frame = spark.createDataFrame([(1, i) for i in range(90)] + [(k, 0) for k in range(2, 12)] + [(None, i) for i in range(50)], "k long, v long")
    assert [r["k"] for r in heavy_keys(frame, "k", hot_rows=10, share=0.3).collect()] == [1]
    assert heavy_keys(frame, "k", hot_rows=100, share=0.0) is None
    assert measure(frame, "k", "v") is None
    slices = measure(frame, "k", "v", hot_rows=10, share=0.3, pieces=9)
    sizes = skew.slice_rows(frame.where("k = 1"), "v", slices).groupBy("_slice").count().collect()
    assert len(sizes) == 9 and max(r["count"] for r in sizes) <= 18
    seen = skew.apart(frame, lambda rows, s: rows.select("k", F.lit(s is not None).alias("heavy")), slices).distinct().collect()
    assert {(r["k"], r["heavy"]) for r in seen} == {(1, True), (None, False)} | {(k, False) for k in range(2, 12)}


def test_strings_cannot_be_cut(spark):
    with pytest.raises(TypeError, match="cannot slice"):
        measure(spark.createDataFrame([(1, "a")], "k long, v string"), "k", "v", **FORCE)


@pytest.mark.parametrize("peers,previous", [(True, False), (False, False), (False, True)])
def test_running(orders, by_time, peers, previous):
    accs = {
        "s": ("sum", F.col(X).cast("decimal(18,4)")),
        "lo": ("min", F.col(X)),
        "hi": ("max", F.col(X)),
        "last": ("last", F.when(F.col("ORDER_ID") % 3 == 0, F.col(X))),
    }
    args = (orders, KEY, ORDER, accs)
    assert_same(running(*args, by_time, peers, previous), running(*args, None, peers, previous))


def test_numbered_and_windowed(orders, by_time):
    assert_same(numbered(orders, KEY, ORDER, by_time), numbered(orders, KEY, ORDER))

    def build(w):
        return {"b5": F.lag(X, 5).over(w), "a2": F.lead(X, 2).over(w), "m": F.max(X).over(w.rowsBetween(-3, 1))}

    args = (orders, KEY, ORDER, build, 5, 2)
    assert_same(windowed(*args, by_time, position="p"), windowed(*args, position="p"))


def test_ranked(orders, by_value):
    assert_same(ranked(orders, KEY, X, by_value), ranked(orders, KEY, X))


@pytest.mark.parametrize("column", [X, "DISCOUNT"])
def test_quantiles(orders, column):
    names = {"a": 0.0, "b": 0.3, "c": 0.5, "d": 1.0}
    for keys in ([KEY], []):
        slices = measure(orders, keys, column, pieces=7, **FORCE)
        assert slices is not None
        assert_same(quantiles.quantiles(orders, keys, column, names, slices), quantiles.quantiles(orders, keys, column, names))


def test_some_keys_heavy(orders):
    """A mixture: the heaviest retailers are cut, the others are not."""
    slices = measure(orders, KEY, TS, hot_rows=14, share=0.0, pieces=4)
    assert 0 < slices.hot.count() < orders.select(KEY).distinct().count()
    assert_same(ft.cumulative_features(orders, KEY, ORDER, X, slices), ft.cumulative_features(orders, KEY, ORDER, X))
    assert_same(series.positions(orders, KEY, ORDER, X, 40.0, slices=slices), series.positions(orders, KEY, ORDER, X, 40.0))


@pytest.mark.parametrize("name", ["cumulative_features", "step_features", "rolling_row_features", "ewma_feature", "ordered_aggregates"])
def test_ordered_features(orders, by_time, name):
    fn = getattr(ft, name)
    assert_same(fn(orders, KEY, ORDER, "DISCOUNT", slices=by_time), fn(orders, KEY, ORDER, "DISCOUNT"))


def test_percentile_and_aggregates(orders, by_value):
    assert_same(ft.percentile_feature(orders, KEY, X, by_value), ft.percentile_feature(orders, KEY, X))
    assert_same(ft.dfs_agg(orders, KEY, [X, "DISCOUNT"], **FORCE), ft.dfs_agg(orders, KEY, [X, "DISCOUNT"]))


def test_direct(views, by_time):
    parent = ft.numeric_aggregates(views["purchases"], KEY, [X])
    loans = views["loans"].select("LOAN_ID", KEY)
    assert_same(ft.dfs_direct(loans, KEY, parent, slices=by_time), ft.dfs_direct(loans, KEY, parent))


@pytest.mark.parametrize("family", ["lag_statistics", "trends", "fourier_coefficients", "permutation_entropy", "power_spectrum", "positions"])
def test_series_by_time(orders, by_time, family):
    fn = getattr(series, family)
    assert_same(fn(orders, KEY, ORDER, X, slices=by_time), fn(orders, KEY, ORDER, X))


@pytest.mark.parametrize("family", ["distribution", "changes"])
def test_series_by_time_and_value(orders, by_time, by_value, family):
    fn = getattr(series, family)
    assert_same(fn(orders, KEY, ORDER, X, slices=by_time, value_slices=by_value), fn(orders, KEY, ORDER, X))


@pytest.mark.parametrize("family", ["moments", "thresholds"])
def test_series_by_value(orders, by_value, family):
    fn = getattr(series, family)
    assert_same(fn(orders, KEY, X, slices=by_value), fn(orders, KEY, X))


def test_point_in_time(views):
    child = ft.Entity(views["sales"], "ID", "CREATED_AT", {"UPDATED_AT": ["STATUS", "TOTAL_AMOUNT_PAID"]})
    slices = measure(views["sales"], KEY, "CREATED_AT", pieces=5, **FORCE)
    args = (views["loans"], child, KEY, ["AMOUNT", "TOTAL_AMOUNT_PAID"], ["STATUS"])
    assert_same(ft.point_in_time(*args, slices=slices), ft.point_in_time(*args))


def test_spend_reconstruction(views, by_time):
    args = (views["loans"], views["purchases"])
    assert_same(profiling.spend_reconstruction(*args, by_time), profiling.spend_reconstruction(*args))


def test_numeric_profile(views):
    frame = views["loans"].select("LOAN_AMOUNT", "SPENT", "INITIAL_COST")
    assert_same(profiling.profile_numeric(frame, hot_rows=1), profiling.profile_numeric(frame))


def test_slices_do_not_depend_on_partitioning(orders, by_time):
    """A row's slice is a function of its values, so a recomputed task agrees with the first run."""
    spread = orders.repartition(13)
    first = skew.slice_rows(orders, TS, by_time).select("ORDER_ID", "_slice")
    assert_same(first, skew.slice_rows(spread, TS, by_time).select("ORDER_ID", "_slice"))


def test_heavy_key_is_spread_over_window_partitions(spark):
    """A key with a third of all rows is sorted in pieces: no window partition holds more than a few percent."""
    hot = spark.range(30_000).select(F.lit(0).alias("k"), F.col("id").alias("t"), F.lit(1.0).alias("x"))
    cold = spark.range(60_000).select((F.col("id") % 6000 + 1).alias("k"), F.col("id").alias("t"), F.lit(1.0).alias("x"))
    frame = hot.unionByName(cold)
    slices = measure(frame, "k", "t", hot_rows=1000, share=0.01, pieces=64)
    sizes = skew.slice_rows(frame.where("k = 0"), "t", slices).groupBy("k", "_slice").count()
    assert sizes.agg(F.max("count")).first()[0] < 1000
    out = running(frame, "k", "t", {"n": ("sum", F.lit(1))}, slices)
    assert out.where("k = 0").agg(F.max("n")).first()[0] == 30_000
    assert out.where("k = 0 AND n <> t + 1").count() == 0


def test_cut_order_is_kept_by_a_window(orders, by_time):
    w = Window.partitionBy(KEY).orderBy(*ORDER)
    want = orders.withColumn("p", F.row_number().over(w).cast("long"))
    assert_same(numbered(orders, KEY, ORDER, by_time, "p"), want)


@pytest.mark.parametrize("limits", [{}, FORCE])
def test_all_families_at_once_equal_the_single_ones(orders, limits):
    wide = series.ts_features(orders, KEY, ORDER, X, **limits)
    for part in [
        series.moments(orders, KEY, X),
        series.thresholds(orders, KEY, X),
        series.changes(orders, KEY, ORDER, X),
        series.positions(orders, KEY, ORDER, X),
        series.lag_statistics(orders, KEY, ORDER, X),
        series.trends(orders, KEY, ORDER, X),
        series.fourier_coefficients(orders, KEY, ORDER, X),
        series.permutation_entropy(orders, KEY, ORDER, X),
    ]:
        own = wide.select(*part.columns)
        if "permutation_entropy" in part.columns:  # a series too short for a pattern has no row of its own
            own = own.where("permutation_entropy IS NOT NULL")
        assert_same(own, part)
