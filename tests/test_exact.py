"""Amounts of few and many digits, large, tiny and not finite, in windows that they enter and leave."""

from __future__ import annotations

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import exact
from ledgerlens.operators import features as ft
from ledgerlens.operators.temporal import rolling_time

START = datetime(2024, 1, 1)
INF, NAN = float("inf"), float("nan")


def frame(spark, values, key=1):
    return spark.createDataFrame([(key, START + timedelta(days=i), i, v) for i, v in enumerate(values)], "k long, ts timestamp_ntz, id long, x double")


@pytest.mark.parametrize(
    "values, kind",
    [
        ([1.25, 3.0, None, -120.5], exact.Kind(3, 2, False)),
        ([0.125], exact.Kind(1, 4, False)),
        ([1234567.123456], exact.Kind(7, 6, False)),
        ([13.37 * 3 / 100], exact.Kind(1, 4, False)),  # the last bits of earlier arithmetic
        ([None, None], exact.Kind(1, 2, False)),
        ([], exact.Kind(1, 2, False)),
        ([1.5, 1e16], exact.GENERAL),
        ([1.5, 3e-11], exact.GENERAL),
        ([1.5, INF], exact.GENERAL),
        ([NAN], exact.GENERAL),
    ],
)
def test_kinds(spark, values, kind):
    assert exact.amount_kinds(frame(spark, values), ["x"])["x"] == kind


def windows(spark, values, days):
    out = rolling_time(frame(spark, values), "k", "ts", "x", days).orderBy("id").collect()
    return [(r[f"ROLLINGMEAN_{days}DAYS__x__"], r[f"ROLLINGSTDDEV_{days}DAYS__x__"]) for r in out]


def same(a, b):
    return a == b or (a is not None and b is not None and (math.isnan(a) and math.isnan(b) or a == pytest.approx(b, rel=1e-9)))


@pytest.mark.parametrize("values", [[3e-11, 3e-11, 6e-11], [1.00000000004, 1.0, 1.00000000008], [2e16, 1e16, 3.0], [1e300, 2.0, 4.0]])
def test_means_are_not_cut(spark, values):
    got = windows(spark, values, 2)
    want = [values[0], (values[0] + values[1]) / 2, (values[1] + values[2]) / 2]
    assert [m for m, _ in got] == pytest.approx(want, rel=1e-12)


def test_nothing_remains_of_what_is_not_finite(spark):
    values = [1.0, INF, 2e16, 5.0, NAN, 7.0, -INF, INF, 1.5, 2.5, 3.5, 0.1]
    got = windows(spark, values, 2)
    for i, (mean, deviation) in enumerate(got):
        inside = [v for v in values[max(0, i - 1) : i + 1]]
        total = sum(inside)
        assert same(mean, total / len(inside)), (i, mean)
        if len(inside) > 1 and not all(map(math.isfinite, inside)):
            assert math.isnan(deviation)
    assert got[-1] == (pytest.approx(1.8), pytest.approx(np.std([3.5, 0.1], ddof=1)))


@pytest.mark.parametrize("digits, whole", [(2, 5), (4, 8), (6, 6), (6, 9), (9, 6)])
def test_deviations_of_any_scale(spark, digits, whole):
    rng = random.Random(digits)
    values = [round(rng.uniform(-(10**whole), 10**whole), digits) for _ in range(120)] + [round(10.0**whole - 1 + i / 10**digits, digits) for i in range(30)]
    got = windows(spark, values, 9)
    for i, (mean, deviation) in enumerate(got):
        v = values[max(0, i - 8) : i + 1]
        assert mean == pytest.approx(math.fsum(v) / len(v), rel=1e-12, abs=1e-12)
        if len(v) > 1:
            m = math.fsum(v) / len(v)
            assert deviation == pytest.approx(math.sqrt(math.fsum((x - m) ** 2 for x in v) / (len(v) - 1)), rel=1e-6, abs=10 ** (whole - 14))


def test_equal_amounts_have_no_deviation(spark):
    for value in (0.1, 123456.78, 9999999.999999, 1e15 + 0.5):
        assert [d for _, d in windows(spark, [value] * 7, 3)] == [None] + [0.0] * 6


@pytest.mark.parametrize("values, n", [([1.25, 2.5], 3), ([123456789.123456], 5), ([1.25, 3e-11], 11)])
def test_running_totals_of_a_narrow_column_are_few(spark, values, n):
    """Two digits: count, sum and one square per window."""
    kind = exact.amount_kinds(frame(spark, values), ["x"])["x"]
    assert list(exact.parts(F.col("x"), True, kind)) == exact.names(True, kind) and len(exact.names(True, kind)) == n


def test_cumulative_and_summed(spark):
    values = [3e-11, 1.5, INF, 2.0]
    out = ft.cumulative_features(frame(spark, values), "k", ["ts", "id"], "x").orderBy("id").collect()
    assert [r["cum_sum_x"] for r in out] == pytest.approx([3e-11, 1.5 + 3e-11, INF, INF])
    assert frame(spark, [1e16, 0.25, 3e-11]).agg(exact.exact_sum(F.col("x"))).first()[0] == pytest.approx(1e16)
    assert frame(spark, [3e-11, 4e-11]).agg(exact.exact_sum(F.col("x"))).first()[0] == pytest.approx(7e-11)
