"""Recipe graphs: what they hold, and that a saved one makes the same frame again."""

from __future__ import annotations

import pytest
from conftest import assert_same

from ledgerlens.operators import features as ft
from ledgerlens.operators import recipes as R
from ledgerlens.schemas import KEY

ORDER = ["LOAN_ISSUANCE_DATE", "LOAN_ID"]
BASE = {"LOAN_AMOUNT": R.NUMBER, "SPENT": R.NUMBER, "LOAN_ISSUANCE_DATE": R.TIME, "INITIAL_DATE": R.TIME}
ALL = ("calendar", "unary", "pair", "time_since", "cumulative", "step")


@pytest.fixture(scope="module")
def loans(views):
    return views["loans"].select("LOAN_ID", KEY, *BASE)


def test_first_level_is_what_the_families_make(loans):
    graph = R.grow(BASE, [ALL])
    made = [*ft.calendar_features("LOAN_ISSUANCE_DATE"), *ft.calendar_features("INITIAL_DATE"), *ft.unary_features(["LOAN_AMOUNT", "SPENT"]), *ft.pair_features(["LOAN_AMOUNT", "SPENT"])]
    names = {f.name for f in made} | {"time_from_LOAN_ISSUANCE_DATE_to_INITIAL_DATE", "time_from_INITIAL_DATE_to_LOAN_ISSUANCE_DATE"}
    names |= {f"{n}_{c}" for n in (*R.CUMULATIVE, *R.STEPS) for c in ("LOAN_AMOUNT", "SPENT")}
    assert {r.name for r in graph} == names and {r.depth for r in graph} == {1}
    own = R.apply(loans, [r for r in graph if r.family in ("calendar", "unary", "pair")], KEY, ORDER)
    assert_same(own, ft.dfs_transform(loans, made))


def test_nothing_is_made_twice_or_undone():
    graph = R.grow({"a": R.NUMBER, "b": R.NUMBER}, [("unary", "pair"), ("unary", "not", "pair"), ("unary",)])
    names = [r.name for r in graph]
    assert len(names) == len(set(names))
    for gone in ("negate_negate_a", "absolute_absolute_a", "absolute_negate_a", "cosine_negate_a", "not_a_eq_b", "is_null_negate_a", "b_add_a", "negate_absolute_negate_a"):
        assert gone not in names
    for there in ("log_absolute_a", "negate_absolute_a", "not_a_gt_b", "sqrt_a_mul_b", "log_log_a", "sine_log_absolute_a"):
        assert there in names
    by_name = {r.name: r for r in graph}
    assert by_name["sine_log_absolute_a"].depth == 3 and by_name["not_a_gt_b"].kind == R.FLAG
    # types: no arithmetic on flags, no calendar of numbers
    assert not any(by_name[c].kind == R.FLAG for r in graph if r.family in ("unary", "pair") for c in r.inputs if c in by_name)


def test_allow_and_closure():
    graph = R.grow({"a": R.NUMBER, "b": R.NUMBER}, [("unary", "pair"), ("unary",)], lambda r: r.primitive != "tangent")
    assert all(r.primitive != "tangent" for r in graph)
    wanted = [r for r in graph if r.name == "log_a_add_b"]
    assert [r.name for r in R.closed(wanted, graph)] == ["a_add_b", "log_a_add_b"]


def test_saved_definitions_make_the_same_frame(spark, loans, tmp_path):
    graph = R.grow(R.kinds(loans, BASE), [ALL, ("unary", "not")])
    some = [r for r in graph if r.depth == 2][::9]
    whole = R.closed(some, graph)
    R.definitions(spark, whole).write.parquet(str(tmp_path / "defs"))
    again = R.from_definitions(spark.read.parquet(str(tmp_path / "defs")))
    assert sorted(again) == sorted(whole) and {r.family for r in whole} >= {"calendar", "cumulative", "step", "time_since", "pair"}
    names = [r.name for r in some]
    assert_same(R.apply(loans, again, KEY, ORDER).select("LOAN_ID", *names), R.apply(loans, whole, KEY, ORDER).select("LOAN_ID", *names))


def test_another_table(spark, loans):
    """Recipes of the loans applied to rows they were not grown from."""
    graph = R.grow(BASE, [("unary", "cumulative"), ("unary",)])
    few = loans.where("LOAN_ID % 3 = 0")
    out = R.apply(few, [r for r in graph if "SPENT" in r.name], KEY, ORDER)
    assert out.count() == few.count() and "log_cum_sum_SPENT" in out.columns and "log_LOAN_AMOUNT" not in out.columns


def test_kinds(spark):
    frame = spark.createDataFrame([], "a int, b decimal(9,2), c boolean, d date, e timestamp_ntz, f string, g array<int>")
    assert R.kinds(frame, frame.columns) == {"a": R.NUMBER, "b": R.NUMBER, "c": R.FLAG, "d": R.TIME, "e": R.TIME, "f": R.TEXT}
