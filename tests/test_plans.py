"""Physical plans: no nested loops, no single-partition sorts of rows, pushed filters, pruned columns."""

from __future__ import annotations

import re

import pytest
from conftest import SF
from pyspark.sql import functions as F

from ledgerlens.operators import prefix, profiling, shape
from ledgerlens.operators.features import Entity
from ledgerlens.operators.temporal import percent_rank_scaled, rolling_asof, rolling_time
from ledgerlens.plans import feature_frame, reports, risk, split
from ledgerlens.sources.adapters import load_views

KEY = "MAIN_SYSTEM_ID"


@pytest.fixture(scope="module")
def lazy(spark):
    spark.catalog.clearCache()  # other tests persist the same views
    return load_views(spark, SF)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text: str) -> list[str]:
    return re.findall(r"Exchange (\w+)", text)


def test_mart_is_one_shuffle_by_retailer(lazy):
    mart = risk.risk_mart(lazy["loans"].withColumn("y_pred", F.col("SPENT")), lazy["purchases"])
    text = plan(mart)
    assert exchanges(text) == ["hashpartitioning"]
    assert "NestedLoop" not in text and "Cartesian" not in text
    assert "PythonUDF" not in text and "ArrowEval" not in text


def test_rolling_windows_share_one_shuffle(lazy):
    assert exchanges(plan(rolling_time(lazy["purchases"], KEY, "ORDER_CREATION_DATE", "ORDER_PRICE", [7, 30, 120, 360]))) == ["hashpartitioning"]


def test_weekly_report_orders_only_weeks(lazy):
    loans = lazy["loans"].withColumn("y_pred", F.col("SPENT"))
    text = plan(reports.policy_counts(risk.risk_mart(loans, lazy["purchases"]), None, "CONSERVATIVE_DECISION"))
    assert "SinglePartition" not in text and "Expand" not in text
    assert "partial_" in text


def test_split_never_gathers_rows_in_one_partition(lazy):
    """Single-partition exchanges hold one row per slice or one count, never the rows."""
    text = plan(split.stratified_time_split(shape.make_label(lazy["loans"], "LOAN_NOT_PAID")))
    for match in re.finditer(r"Exchange SinglePartition.*\n(.*)", text):
        assert "Aggregate" in match.group(1), match.group(0)
    assert "NestedLoop" not in text
    assert "hashpartitioning(_slice" in plan(percent_rank_scaled(lazy["loans"].select("LOAN_ID"), "LOAN_ID"))


def test_filters_and_columns_reach_the_scan(spark, lazy):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    text = plan(shape.used_loans(lazy["loans"]).where(F.col("LOAN_ISSUANCE_DATE") > F.lit("2024-01-15").cast("timestamp_ntz")).select("LOAN_ID"))
    assert "GreaterThan(ts,2024-01-15" in text and "EqualTo(event_type,signup)" in text
    schema = re.search(r"ReadSchema: struct<(.*?)>", text).group(1)
    assert "props" not in schema


def test_first_rows_are_limited_before_the_shuffle(lazy):
    text = plan(shape.first_per_key(lazy["loans"].select(KEY, "LOAN_ID", "LOAN_ISSUANCE_DATE"), KEY, ["LOAN_ISSUANCE_DATE", "LOAN_ID"], 3))
    assert re.search(r"WindowGroupLimit.*Partial", text)
    assert re.search(r"WindowGroupLimit.*Partial", plan(profiling.most_common(lazy["sales"], ["STATUS"], 5)))


def test_top_k_is_not_a_full_sort(lazy):
    from ledgerlens.operators.summaries import top_delayed

    assert "TakeOrderedAndProject" in plan(top_delayed(lazy["loans"], 5))


def test_fused_join_keeps_heavy_rows_apart(lazy):
    slices = risk.heavy_retailers(lazy["loans"], lazy["purchases"], hot_rows=5, share=0.0)
    joined = rolling_asof(lazy["loans"].select("LOAN_ID", KEY, "LOAN_ISSUANCE_DATE"), lazy["purchases"], "LOAN_ISSUANCE_DATE", "ORDER_CREATION_DATE", KEY, "ORDER_PRICE", 30, slices=slices)
    text = plan(joined)
    assert "hashpartitioning(_key" in text and "_slice" in text
    assert "NestedLoop" not in text and "SortMergeJoin" not in text


def test_bucketed_tables_need_no_exchange(spark):
    """Mart, rolling statistics, as-of facts and history at issuance over tables written once by retailer."""
    from ledgerlens.catalog.storage import bucketed_views

    v = bucketed_views(spark, SF, buckets=4)
    loans = v["loans"].withColumn("y_pred", F.col("SPENT"))
    mart = risk.risk_mart(loans, v["purchases"], slices=None)
    orders = Entity(v["purchases"], "ORDER_ID", "ORDER_CREATION_DATE")
    past = prefix.history_so_far(v["loans"], orders, KEY, ["ORDER_PRICE"], slices=None)
    per = v["purchases"].groupBy(KEY).agg(F.sum("ORDER_PRICE"))
    for df in (mart, past, rolling_time(v["purchases"], KEY, "ORDER_CREATION_DATE", "ORDER_PRICE", [7, 30], slices=None), per):
        text = plan(df)
        assert exchanges(text) == [] and "Bucketed: true" in text
    plain = load_views(spark, SF)
    want = risk.decisions(risk.risk_mart(plain["loans"].withColumn("y_pred", F.col("SPENT")), plain["purchases"]))
    assert sorted(map(str, risk.decisions(mart).collect())) == sorted(map(str, want.collect()))


def test_feature_frame_with_forced_heavy_keys_scans_each_table_a_few_times(spark, lazy):
    """Heavy rows are set apart once and written after each step, so what is read does not multiply along the chain."""
    light = plan(feature_frame.build_feature_frame(lazy)[0])
    assert light.count("FileScan") <= 7 and len(exchanges(light)) <= 6
    heavy = plan(feature_frame.build_feature_frame(lazy, hot_rows=1, share=0.0, pieces=3)[0])
    assert heavy.count("FileScan") <= 12 and len(exchanges(heavy)) <= 12


def test_facts_of_the_past_move_key_and_time_only(spark, views, monkeypatch):
    """The loan's other columns go through no window of the past, and the facts are those that a carried frame has."""
    from conftest import assert_same

    es = feature_frame.entity_set({n: views[n] for n in ("loans", "purchases")})
    frame = views["loans"].select("LOAN_ID", KEY, "LOAN_ISSUANCE_DATE", "LOAN_AMOUNT", "SPENT")
    child = es.entities["purchases"]
    want = prefix.history_so_far(frame, child, KEY, ["ORDER_PRICE"], prefix="purchases_", slices=None)
    moved = []
    for name in ("history_so_far", "categories_so_far", "quantiles_so_far"):
        plain = getattr(prefix, name)
        monkeypatch.setattr(prefix, name, lambda loans, *a, f=plain, **b: moved.append(loans.columns) or f(loans, *a, **b))
    out, made = feature_frame.with_past(frame, es)
    assert moved == [["_past_of", KEY, "LOAN_ISSUANCE_DATE"]] * 5
    assert out.columns == [*frame.columns, *[f.name for f in made]]
    assert_same(out.select(*want.columns), want)


def test_parts_are_ranked_before_wide_rows_are_joined(spark):
    """Only ids and labels are ranked, and the parts are those that the joined frame would have."""
    from conftest import assert_same

    from ledgerlens.catalog import modelling

    ranked = []
    out = modelling.labelled_frame(spark, SF, "LOAN_NOT_PAID", lambda rows: ranked.append(rows.columns) or split.stratified_time_split(rows))
    assert ranked == [["LOAN_ID", "label"]] and len(out.columns) > 100
    found = ["LOAN_ID", "label", "stratified_split", "split", "is_validation"]
    assert_same(out.select(*found), split.stratified_time_split(out.select("LOAN_ID", "label")))
