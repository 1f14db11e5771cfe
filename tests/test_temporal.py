"""Window and as-of semantics, by hand and against brute force."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from statistics import mean, stdev

import pytest
from conftest import assert_same
from pyspark.sql import functions as F

from ledgerlens.operators.skew import measure
from ledgerlens.operators.temporal import asof_join, percent_rank_scaled, rolling_asof, rolling_time, strictly_before

T0 = datetime(2024, 1, 1)
ORDERS = "k long, t timestamp_ntz, x double, id long"


def at(days=0, **more):
    return T0 + timedelta(days=days, **more)


def rolled(spark, data, days=30):
    df = spark.createDataFrame(data, ORDERS)
    out = rolling_time(df, "k", "t", "x", days)
    return {r["id"]: (r[f"ROLLINGMEAN_{days}DAYS__x__"], r[f"ROLLINGSTDDEV_{days}DAYS__x__"]) for r in out.collect()}


def test_window_is_open_on_the_left(spark):
    out = rolled(spark, [(1, at(0), 10.0, 1), (1, at(30), 20.0, 2), (1, at(60, microseconds=-1), 40.0, 3)])
    assert out[2] == (20.0, None)  # exactly 30 days apart: not in one window
    assert out[3][0] == 30.0 and out[3][1] == pytest.approx(200**0.5)


def test_equal_times_see_each_other(spark):
    out = rolled(spark, [(1, at(0), 10.0, 1), (1, at(0), 30.0, 2)])
    assert out[1] == out[2] and out[1][0] == 20.0


def test_single_order_has_no_deviation(spark):
    assert rolled(spark, [(1, at(0), 10.0, 1)])[1] == (10.0, None)


def test_equal_amounts_deviate_by_exactly_zero(spark):
    out = rolled(spark, [(1, at(i), 0.1, i) for i in range(7)])
    assert out[6] == (pytest.approx(0.1), 0.0)


def test_missing_amounts_and_times(spark):
    out = rolled(spark, [(1, at(0), None, 1), (1, at(1), 4.0, 2), (1, None, 9.0, 3)])
    assert out == {1: (None, None), 2: (4.0, None), 3: (None, None)}


def test_large_amounts_use_the_fallback(spark):
    out = rolled(spark, [(1, at(i), 9e12 + i, i) for i in range(400)])
    assert out[399][0] == pytest.approx(9e12 + 384.5, rel=1e-12)


@pytest.mark.parametrize("seed", range(3))
def test_rolling_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    data = [(rng.randrange(3), at(rng.randrange(40)), float(rng.randrange(1, 9)), i) for i in range(80)]
    out = rolled(spark, data, 7)
    for k, t, _, i in data:
        window = [x for kk, tt, x, _ in data if kk == k and t - timedelta(days=7) < tt <= t]
        assert out[i][0] == pytest.approx(mean(window))
        assert out[i][1] == (pytest.approx(stdev(window)) if len(window) > 1 else None)


def joined(spark, loans, orders, tolerance=7, **more):
    left = spark.createDataFrame(loans, "loan long, k long, at timestamp_ntz")
    right = spark.createDataFrame(orders, ORDERS)
    limit = None if tolerance is None else timedelta(days=tolerance)
    return asof_join(left, right, "at", "t", "k", limit, tie="id", **more)


def test_exact_match_hides_an_older_order(spark):
    found = joined(spark, [(1, 1, at(5))], [(1, at(3), 1.0, 1), (1, at(5), 2.0, 2)])
    assert found.first()["id"] == 2
    assert strictly_before(found, "at", "t").count() == 0
    assert joined(spark, [(1, 1, at(5))], [(1, at(3), 1.0, 1), (1, at(5), 2.0, 2)], allow_exact=False).first()["id"] == 1


def test_tolerance_is_inclusive(spark):
    assert joined(spark, [(1, 1, at(7))], [(1, at(0), 1.0, 1)]).first()["id"] == 1
    assert joined(spark, [(1, 1, at(7, microseconds=1))], [(1, at(0), 1.0, 1)]).first()["id"] is None


def test_unmatched_and_undated_loans_stay(spark):
    out = joined(spark, [(1, 1, at(0)), (2, 2, at(9)), (3, 1, None)], [(1, at(1), 1.0, 1)])
    assert {r["loan"]: r["id"] for r in out.collect()} == {1: None, 2: None, 3: None}


def test_missing_keys_match_nothing(spark):
    loans, orders = [(1, None, at(2)), (2, 1, at(2))], [(None, at(1), 1.0, 1), (1, at(1), 2.0, 2)]
    assert {r["loan"]: r["id"] for r in joined(spark, loans, orders).collect()} == {1: None, 2: 2}
    left = spark.createDataFrame(loans, "loan long, k long, at timestamp_ntz")
    fused = rolling_asof(left, spark.createDataFrame(orders, ORDERS), "at", "t", "k", "x", 30, timedelta(days=7), tie="id")
    assert {r["loan"]: (r["id"], r["ROLLINGMEAN_30DAYS__x__"]) for r in fused.collect()} == {1: (None, None), 2: (2, 2.0)}


def test_name_clash_is_an_error(spark):
    frame = spark.createDataFrame([(1, at(0), 1.0, 1)], ORDERS)
    with pytest.raises(ValueError, match="both sides"):
        asof_join(frame, frame, "t", "t", "k")


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("sliced", [False, True])
def test_asof_equals_brute_force(spark, seed, sliced):
    rng = random.Random(seed)
    loans = [(i, rng.randrange(4), at(rng.randrange(30))) for i in range(60)]
    orders = [(rng.randrange(3), at(rng.randrange(30)), 1.0, i) for i in range(40)]
    slices = None
    if sliced:
        slices = measure(spark.createDataFrame(orders, ORDERS), "k", "t", hot_rows=1, share=0.0, pieces=5)
    out = {r["loan"]: r["id"] for r in joined(spark, loans, orders, 7, slices=slices).collect()}
    for loan, k, t in loans:
        best = max(((o[1], o[3]) for o in orders if o[0] == k and t - timedelta(days=7) <= o[1] <= t), default=None)
        assert out[loan] == (best[1] if best else None)


@pytest.mark.parametrize("sliced", [False, True])
def test_fused_join_equals_the_composition(spark, sparse, sliced):
    loans = sparse["loans"].select("LOAN_ID", "MAIN_SYSTEM_ID", "LOAN_ISSUANCE_DATE")
    orders = sparse["purchases"]
    slices = measure(orders, "MAIN_SYSTEM_ID", "ORDER_CREATION_DATE", hot_rows=1, share=0.0, pieces=6) if sliced else None
    args = ("LOAN_ISSUANCE_DATE", "ORDER_CREATION_DATE", "MAIN_SYSTEM_ID")
    volume = rolling_time(orders, "MAIN_SYSTEM_ID", "ORDER_CREATION_DATE", "ORDER_PRICE", [30, 360])
    want = asof_join(loans, volume, *args, timedelta(days=90), tie="ORDER_ID")
    got = rolling_asof(loans, orders, *args, "ORDER_PRICE", [30, 360], timedelta(days=90), tie="ORDER_ID", slices=slices)
    assert_same(got, want)


def test_percent_rank_equals_the_built_in(spark, sparse):
    frame = sparse["purchases"].select("ORDER_ID", "ORDER_CREATION_DATE")
    frame.createOrReplaceTempView("ranked_orders")
    want = spark.sql("SELECT *, percent_rank() OVER (ORDER BY ORDER_CREATION_DATE) AS stratified_split FROM ranked_orders")
    assert_same(percent_rank_scaled(frame, "ORDER_CREATION_DATE"), want)


def test_percent_rank_of_one_row(spark):
    assert percent_rank_scaled(spark.createDataFrame([(5,)], "id long"), "id").first()["stratified_split"] == 0.0


def test_fixture_counts(views):
    """The counts published with the test fixtures."""
    from ledgerlens.plans import risk

    loans = views["loans"].withColumn("y_pred", F.col("SPENT"))
    mart = risk.risk_mart(loans, views["purchases"])
    facts = mart.agg(
        F.count(F.lit(1)),
        F.sum(F.col("ROLLINGSTDDEV_30DAYS__ORDER_PRICE__").isNull().cast("int")),
        F.sum(F.col("CONSERVATIVE_DECISION").cast("int")),
        F.sum(F.col("AMBITIOUS_DECISION").cast("int")),
    ).first()
    assert tuple(facts) == (171, 13, 123, 134)
    assert mart.where("CONSERVATIVE_DECISION AND NOT AMBITIOUS_DECISION").count() == 0
