"""Missing keys, times and values, fine and very large amounts: rows are kept and figures equal DuckDB's."""

from __future__ import annotations

from datetime import datetime, timedelta
from fractions import Fraction

import duckdb
import pandas as pd
import pytest

from ledgerlens.operators import features as ft
from ledgerlens.operators import profiling, series, skew
from ledgerlens.operators.temporal import asof_join, rolling_asof, rolling_time
from ledgerlens.plans import feature_frame, model

T0 = datetime(2024, 1, 1)
FORCE = {"hot_rows": 1, "share": 0.0}
ORDERS = "i long, k long, t timestamp_ntz, x double"


def at(days):
    return None if days is None else T0 + timedelta(days=days)


def order_rows():
    amounts = [1.00004, 1.000041, 0.000123, 1e15, 1e15, 1e15 + 1, 2.5, 2.5, 2.5, 7e17, 3.0, None]
    rows = [(i, i % 3 if i % 7 else None, at(None if i % 11 == 5 else i // 4), amounts[i % len(amounts)]) for i in range(90)]
    return rows + [(900 + i, 8, at(40 + i), 2.5) for i in range(5)]


def pandas(rows, names):
    return pd.DataFrame(rows, columns=names)


def close(a, b):
    return (a is None or pd.isna(a)) and (b is None or pd.isna(b)) or a == pytest.approx(b, rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("sliced", [False, True])
def test_rolling_time(spark, sliced):
    rows = order_rows()
    df = spark.createDataFrame(rows, ORDERS)
    slices = skew.measure(df, "k", "t", pieces=4, **FORCE) if sliced else None
    got = {r.i: (r[4], r[5]) for r in rolling_time(df, "k", "t", "x", 7, slices=slices).collect()}
    assert len(got) == len(rows)
    for i, k, t, _ in rows:
        inside = [x for _, kk, tt, x in rows if kk == k and t is not None and tt is not None and t - timedelta(days=7) < tt <= t and x is not None]
        mean = sum(map(Fraction, inside)) / len(inside) if inside else None
        assert close(got[i][0], None if mean is None else float(mean)), i
        if len(inside) < 2:
            assert got[i][1] is None
        elif len(set(inside)) == 1:
            assert got[i][1] == 0 or max(inside) > 1e15
        else:
            want = float(sum((Fraction(v) - mean) ** 2 for v in inside) / (len(inside) - 1)) ** 0.5
            assert got[i][1] == pytest.approx(want, rel=1e-7, abs=1e-9), (i, inside)


def test_as_of_joins_keep_all_loans(spark):
    rows = order_rows()
    right = spark.createDataFrame(rows, ORDERS)
    loans = [(i, i % 4 if i % 5 else None, at(None if i % 6 == 1 else i * 0.7)) for i in range(50)]
    left = spark.createDataFrame(loans, "loan long, k long, u timestamp_ntz")
    con = duckdb.connect()
    con.register("r", pandas([r for r in rows], ["i", "k", "t", "x"]))
    con.register("l", pandas(loans, ["loan", "k", "u"]))
    want = con.execute("SELECT loan, max(r.t) FROM l LEFT JOIN r ON r.k = l.k AND r.t <= l.u AND r.t >= l.u - INTERVAL 7 DAY GROUP BY loan").fetchall()
    want = {a: None if b is None or pd.isna(b) else b for a, b in want}
    plain = {r.loan: r.t for r in asof_join(left, right, "u", "t", "k", timedelta(days=7)).collect()}
    fused = {r.loan: r.t for r in rolling_asof(left, right, "u", "t", "k", "x", 7, timedelta(days=7), tie="i").collect()}
    assert plain == want and fused == want


@pytest.mark.parametrize("sliced", [False, True])
def test_point_in_time_keeps_raw_extremes(spark, sliced):
    rows = order_rows()
    child = spark.createDataFrame([r for r in rows], ORDERS)
    loans = [(i, i % 4 if i % 5 else None, at(i * 0.9)) for i in range(40)]
    left = spark.createDataFrame(loans, "LOAN_ID long, k long, u timestamp_ntz")
    slices = skew.measure(child, "k", "t", pieces=4, **FORCE) if sliced else None
    out = {r.LOAN_ID: r for r in ft.point_in_time(left, ft.Entity(child, "i", "t"), "k", ["x"], at="u", slices=slices).collect()}
    assert len(out) == len(loans)
    for i, k, u in loans:
        seen = [x for _, kk, t, x in rows if kk is not None and kk == k and t is not None and t <= u and x is not None]
        r = out[i]
        assert (r.min_x, r.max_x) == ((min(seen), max(seen)) if seen else (None, None))
        assert close(r.sum_x, sum(seen) if seen else None) and close(r.mean_x, sum(seen) / len(seen) if seen else None)


def test_spend_reconstruction_with_missing_due_dates_and_retailers(spark):
    loans = [(i, i % 3 if i % 4 else None, at(i), at(None if i % 5 == 2 else i + i % 6 - 1), 1.0) for i in range(40)]
    orders = [(i, None if i % 9 == 0 else i % 3, at(None if i % 8 == 3 else i * 0.5), [1.00004, 1e15, None, 2.0][i % 4]) for i in range(80)]
    shape = "LOAN_ID long, MAIN_SYSTEM_ID long, LOAN_ISSUANCE_DATE timestamp_ntz, INITIAL_DATE timestamp_ntz, SPENT double"
    left = spark.createDataFrame(loans, shape)
    right = spark.createDataFrame(orders, "ORDER_ID long, MAIN_SYSTEM_ID long, ORDER_CREATION_DATE timestamp_ntz, ORDER_PRICE double")
    got = {r.LOAN_ID: (r.ordered, r.n_orders) for r in profiling.spend_reconstruction(left, right).collect()}
    assert len(got) == 40
    for i, k, a, b, _ in loans:
        seen = [x for _, kk, t, x in orders if k is not None and kk == k and t is not None and b is not None and a <= t <= b]
        assert got[i][1] == len(seen) and close(got[i][0], float(sum(x or 0.0 for x in seen)))


@pytest.mark.parametrize("alpha", [0.5, 0.001, 1.0])
@pytest.mark.parametrize("sliced", [False, True])
def test_ewma_is_exact_at_any_distance(spark, alpha, sliced):
    values = [1e30] + [1.0] * 59 + [None, 5.0, None] + [float(i % 7) for i in range(900)]
    rows = [(i, 1, at(i), v) for i, v in enumerate(values)] + [(5000 + i, None, at(i), 2.0 * i) for i in range(5)]
    df = spark.createDataFrame(rows, ORDERS)
    slices = skew.measure(df, "k", "t", pieces=4, **FORCE) if sliced else None
    got = {r.i: r.ewma_x for r in ft.ewma_feature(df, "k", ["t", "i"], "x", alpha, slices).collect()}
    assert len(got) == len(rows)
    for key in (1, None):
        total = weight = 0.0
        for i, k, _, v in rows:
            if k != key:
                continue
            if v is not None:
                total, weight = total * (1 - alpha) + v, weight * (1 - alpha) + 1.0
            assert close(got[i], total / weight), i


@pytest.mark.parametrize("sliced", [False, True])
def test_percentile_keeps_rows_without_value(spark, sliced):
    rows = [(i, i % 2, at(i), None if i % 5 == 0 else float(i % 4)) for i in range(40)]
    df = spark.createDataFrame(rows, ORDERS)
    slices = skew.measure(df, "k", "x", pieces=3, **FORCE) if sliced else None
    got = {r.i: r.percentile_x for r in ft.percentile_feature(df, "k", "x", slices).collect()}
    assert len(got) == 40
    for i, k, _, v in rows:
        same = [x for _, kk, _, x in rows if kk == k and x is not None]
        want = None if v is None else (sum(x < v for x in same) + 1 + sum(x <= v for x in same)) / (2 * len(same))
        assert close(got[i], want)


def test_short_series_keep_a_row(spark):
    rows = [(i, 1, at(i), float(i % 3)) for i in range(20)] + [(100 + i, 2, at(i), 1.0) for i in range(3)] + [(200, 3, at(1), 5.0)]
    df = spark.createDataFrame(rows, ORDERS)
    power = {r.k: r.power_0 for r in series.power_spectrum(df, "k", ["t", "i"], "x").collect()}
    assert power.keys() == {1, 2, 3} and power[2] is None and power[3] is None and power[1] is not None
    entropy = {r.k: r.permutation_entropy for r in series.permutation_entropy(df, "k", ["t", "i"], "x").collect()}
    assert entropy.keys() == {1, 2, 3} and entropy[3] is None and entropy[2] == 0.0


def test_slices_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(skew, "BLOCK", 50)
    few, many = (len(skew.measure(spark.range(n), [], "id", hot_rows=0).cuts) for n in (200, 2000))
    assert few < 6 and many > 30


def test_forced_heavy_keys_plan_the_frame_twice_not_exponentially(spark, views):
    light = feature_frame.build_feature_frame(views)[0]
    heavy = feature_frame.build_feature_frame(views, **FORCE)[0]
    plan = heavy._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 16 and plan.count("Window [") <= 40
    a, b = (sorted((r.LOAN_ID, round(r.sales_sum_AMOUNT or 0, 6), r.purchases_count) for r in f.select("LOAN_ID", "sales_sum_AMOUNT", "purchases_count").collect()) for f in (light, heavy))
    assert a == b


def test_series_are_refused_at_issuance(views):
    with pytest.raises(ValueError):
        feature_frame.build_feature_frame(views, with_series=True)


def test_average_precision(spark):
    rows = [(0.9, 1), (0.8, 0), (0.8, 1), (0.3, 1), (0.1, 0), (None, 1)]
    out = model.average_precision(spark.createDataFrame(rows, "score double, label int")).first()[0]
    assert out == pytest.approx((1 / 1 * 1 + 2 / 3 * 1 + 3 / 4 * 1) / 3)
