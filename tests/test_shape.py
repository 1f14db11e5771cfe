"""Projections, labels and row reshaping by hand."""

from __future__ import annotations

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from ledgerlens.operators import quantiles, shape, summaries
from ledgerlens.schemas import AFTER_THE_FACT, LOW_SIGNAL

LOANS = "LOAN_ID long, SPENT double, PAYMENT_STATUS string, FIRST_TRAIL_DELAYS int, FIRST_TRIAL_BALANCE double"


@pytest.fixture(scope="module")
def loans(spark):
    return spark.createDataFrame(
        [(1, 5.0, "Paid", 0, 0.0), (2, 5.0, None, 2, -1.0), (3, 0.0, "Unpaid", 0, 0.0), (4, 1.0, "PAID", None, None)], LOANS
    )


def test_missing_status_counts_as_not_paid(loans):
    got = {r["LOAN_ID"]: (r["LOAN_NOT_PAID"], r["FIRST_TRAIL_DELAY"]) for r in shape.targets(loans).collect()}
    assert got == {1: (0, 0), 2: (1, 1), 4: (0, 0)}  # loan 3 was never used


def test_first_collection_default(loans):
    got = {r["LOAN_ID"]: r["LABEL"] for r in shape.first_collection_default(loans).collect()}
    assert got == {1: False, 2: True, 3: True, 4: False}


def test_label_name_is_case_insensitive(loans):
    assert {r["label"] for r in shape.make_label(loans, "Loan_Not_Paid").collect()} == {0, 1}
    with pytest.raises(ValueError, match="unknown target"):
        shape.make_label(loans, "nothing")


def test_drop_leaky(views):
    left = shape.drop_leaky(views["loans"]).columns
    assert not set(left) & {*LOW_SIGNAL, *AFTER_THE_FACT}
    assert left == ["MAIN_SYSTEM_ID", "LOAN_ID", "LOAN_ISSUANCE_DATE", "LOAN_AMOUNT", "TOTAL_INITIAL_AMOUNT", "INITIAL_DATE"]


def test_harmonise(spark):
    df = spark.createDataFrame([(1, 2, True, "a", 1.5)], "id long, n int, b boolean, s string, f float")
    assert dict(shape.harmonise(df, ["id"]).dtypes) == {"id": "bigint", "n": "double", "b": "int", "s": "string", "f": "double"}


def test_sanitise_names(spark):
    names = ["retailers.SUM(sales.AMOUNT)", "A % B", "A / B", "A * B", "F(x, y)"]
    df = spark.range(1).select(*[F.lit(1).alias(n) for n in names])
    assert shape.sanitise_names(df).columns == ["retailers_SUM__sales_AMOUNT__", "A_mod_B", "A_div_B", "A_mul_B", "F__x_ y__"]


def test_split_columns(spark):
    df = spark.createDataFrame([(1, "a", 2.0, True)], "id long, s string, x double, b boolean")
    assert shape.split_columns(df, ["id"]) == (["s"], ["x", "b"])
    with pytest.raises(ValueError, match="neither"):
        shape.split_columns(df.withColumn("t", F.current_date()), ["id"])


def test_vector_columns(spark):
    df = spark.createDataFrame([(1, Vectors.dense([1.0, 2.0])), (2, Vectors.sparse(2, [1], [5.0]))], ["id", "v"])
    got = sorted(tuple(r) for r in shape.vector_columns(df, "v", 2).collect())
    assert got == [(1, 1.0, 2.0), (2, 0.0, 5.0)]
    assert df.select(shape.vector_size("v")).first()[0] == 2


def test_first_row_has_sorted_columns(spark):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "z long, a string")
    out = shape.first_row(df, "z")
    assert out.columns == ["a", "z"] and tuple(out.first()) == ("a", 1)


def test_merge_columns_takes_shared_ones_from_the_left(spark):
    left = spark.createDataFrame([(1, "left", 1)], "id long, s string, a int")
    right = spark.createDataFrame([(1, "right", 2)], "id long, s string, b int")
    assert summaries.merge_columns(left, right, "id").first().asDict() == {"id": 1, "s": "left", "a": 1, "b": 2}


def test_histogram_bounds(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (9.9,), (10.0,), (None,)], "x double")
    bins = {r["bin"]: r["n"] for r in quantiles.equal_width_bins(df, "x", 5).collect()}
    assert bins == {0: 2, 1: 0, 2: 0, 3: 0, 4: 2}
    one = quantiles.equal_width_bins(spark.createDataFrame([(3.0,), (3.0,)], "x double"), "x", 4).collect()
    assert sum(r["n"] for r in one) == 2


def test_lost_and_present_keys_cover_all(views):
    lost = summaries.lost_keys(views["loans"], views["purchases"])
    everyone = views["loans"].select("MAIN_SYSTEM_ID").distinct()
    kept = everyone.join(views["purchases"], "MAIN_SYSTEM_ID", "left_semi")
    assert lost.count() + kept.count() == everyone.count()
    assert summaries.present_keys(lost, views["purchases"]).first()[0] == 0
    assert lost.count() == 1


def test_empty_and_null_amounts_do_not_break_the_ratio(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 2.0), (3, None, 2.0)], "LOAN_ID long, SPENT double, LOAN_AMOUNT double").withColumn("MAIN_SYSTEM_ID", F.lit(1))
    assert [r["LOAN_ID"] for r in shape.overspent(df).collect()] == [2]
