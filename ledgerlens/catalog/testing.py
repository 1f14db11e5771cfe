"""Hypothesis tests, join coverage and time-ordered splits."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ledgerlens.catalog.lending import _asof_sql, _frame, _volume_sql
from ledgerlens.catalog.registry import query
from ledgerlens.catalog.views_sql import SPARSE, with_views
from ledgerlens.operators import hypothesis as h
from ledgerlens.operators import shape
from ledgerlens.operators.skew import measure
from ledgerlens.operators.temporal import percent_rank_scaled, rolling_time
from ledgerlens.plans import risk, split
from ledgerlens.schemas import KEY
from ledgerlens.sources.adapters import load_views

WINDOWS = [7, 30, 120, 360]


def joined_volume(spark, sf_dir, adapter="sparse", days=WINDOWS, tolerance=30):
    v = load_views(spark, sf_dir, adapter)
    loans = v["loans"].select("LOAN_ID", KEY, "LOAN_ISSUANCE_DATE", "LOAN_AMOUNT", "PAYMENT_STATUS")
    return risk.with_volume(loans, v["purchases"], list(days), tolerance, slices=risk.heavy_retailers(loans, v["purchases"]))


def _joined_sql(adapter, days, tolerance):
    columns = ", ".join(f"v.ROLLINGMEAN_{d}DAYS__ORDER_PRICE__ AS m{d}, v.ROLLINGSTDDEV_{d}DAYS__ORDER_PRICE__ AS s{d}" for d in days)
    return [
        _volume_sql(days),
        f"""joined AS (SELECT l.LOAN_ID, l.LOAN_AMOUNT, l.PAYMENT_STATUS, l.MAIN_SYSTEM_ID, v.ORDER_CREATION_DATE, v.ORDER_PRICE, v.ORDER_ID, {columns}
  FROM loans l ASOF JOIN (SELECT * FROM volume QUALIFY row_number() OVER (PARTITION BY MAIN_SYSTEM_ID, ORDER_CREATION_DATE ORDER BY ORDER_ID DESC) = 1) v
  ON l.MAIN_SYSTEM_ID = v.MAIN_SYSTEM_ID AND l.LOAN_ISSUANCE_DATE >= v.ORDER_CREATION_DATE
  WHERE v.ORDER_CREATION_DATE >= l.LOAN_ISSUANCE_DATE - INTERVAL {tolerance} DAY AND l.LOAN_ISSUANCE_DATE > v.ORDER_CREATION_DATE)""",
        "limits AS (" + " UNION ALL ".join(f'SELECT {d} AS "window", avg(m{d}) + stddev_samp(s{d}) AS "limit" FROM joined' for d in days) + ")",
    ]


def _h(select, *more, adapter="sparse", days=WINDOWS, tolerance=30):
    views = {"adapter": SPARSE} if adapter == "sparse" else {}
    return with_views(select, *_joined_sql(adapter, days, tolerance), *more, names="loans purchases", **views)


@query("h1_volume_limit", _h('SELECT "window", round("limit", 4) AS "limit" FROM limits'))
def _(spark, sf_dir):
    return h.volume_limit(joined_volume(spark, sf_dir), WINDOWS).select("window", F.round("limit", 4).alias("limit"))


@query(
    "h1_volume_limit_dense_7d",
    _h('SELECT "window", round("limit", 6) AS "limit" FROM limits', adapter="dense", days=[7, 30], tolerance=7),
)
def _(spark, sf_dir):
    return h.volume_limit(joined_volume(spark, sf_dir, "dense", [7, 30], 7), [7, 30]).select("window", F.round("limit", 6).alias("limit"))


@query(
    "h2_hits_above_limit",
    _h(
        'SELECT "window", count(*) AS n, count(*) FILTER (WHERE LOAN_AMOUNT > "limit") AS hits FROM joined CROSS JOIN limits GROUP BY 1',
        adapter="dense",
        days=[7, 30],
        tolerance=30,
    ),
)
def _(spark, sf_dir):
    joined = joined_volume(spark, sf_dir, "dense", [7, 30], 30)
    return h.hits_above(joined, "LOAN_AMOUNT", h.volume_limit(joined, [7, 30])).drop("limit")


@query("h2_bootstrap_share_ci")
def _(spark, sf_dir):
    return h.volume_test(joined_volume(spark, sf_dir), WINDOWS).select("window", "limit", "n", "hits", "lower", "upper")


@query(
    "h2_interval_covers_share",
    _h(
        'SELECT "window", count(*) AS n, count(*) FILTER (WHERE LOAN_AMOUNT > "limit") AS hits, true AS covers, true AS narrow FROM joined CROSS JOIN limits GROUP BY 1',
        adapter="dense",
        days=[7, 30],
        tolerance=30,
    ),
)
def _(spark, sf_dir):
    """Whether the bootstrap interval holds the share itself and is as wide as a binomial share of that many draws may be."""
    found = h.volume_test(joined_volume(spark, sf_dir, "dense", [7, 30], 30), [7, 30])
    share, width = F.col("hits") / F.col("n"), F.col("upper") - F.col("lower")
    sd = F.sqrt(share * (1 - share) / F.greatest(F.lit(1.0), F.round(F.col("n") * 0.3)))
    return found.select("window", "n", "hits", ((F.col("lower") <= share) & (share <= F.col("upper"))).alias("covers"), (F.abs(width - 3.92 * sd) <= 1.2 * sd + 1e-9).alias("narrow"))


@query("h5_bootstrap_verdict")
def _(spark, sf_dir):
    return h.volume_test(joined_volume(spark, sf_dir, "dense", [7, 30], 30), [7, 30])


# Verdict over the plain share, so that the rule and its text can be compared exactly.
@query(
    "h5_verdict_rule",
    _h(
        """SELECT "window", lower, upper, lower > 0.2 AS reject,
printf('Loans exceed the limit of the last %d days %s', "window", CASE WHEN lower > 0.2 THEN 'more often than tolerated' ELSE 'no more often than tolerated' END) AS finding,
printf('share between %.4f and %.4f', lower, upper) AS interval_text
FROM (SELECT "window", round(count(*) FILTER (WHERE LOAN_AMOUNT > "limit") / count(*), 6) AS lower, round(count(*) FILTER (WHERE LOAN_AMOUNT >= "limit") / count(*), 6) AS upper
 FROM joined CROSS JOIN limits GROUP BY 1)""",
        adapter="dense",
        days=[7, 30],
        tolerance=30,
    ),
)
def _(spark, sf_dir):
    joined = joined_volume(spark, sf_dir, "dense", [7, 30], 30)
    share = F.round(F.col("hits") / F.col("n"), 6)
    shares = h.hits_above(joined, "LOAN_AMOUNT", h.volume_limit(joined, [7, 30])).select("window", share.alias("lower"), share.alias("upper"))
    return h.verdict(shares)


ROUNDS = 1000
_WEIGHT = (
    "CASE "
    + " ".join(f"WHEN u < {math.ceil(bound * 2**53)} THEN {k}" for k, bound in enumerate(h.poisson_thresholds()))
    + f" ELSE {len(h.poisson_thresholds())} END"
)


def _mixed(z):
    """The 64-bit mixer in arithmetic of 128 bits."""
    for shift, factor in h.MIXERS:
        z = f"SELECT round, x, (xor(z, z >> {shift}) * {factor}::UHUGEINT) & {(1 << 64) - 1}::UHUGEINT AS z FROM ({z})"
    return f"SELECT round, x, (xor(z, z >> {h.LAST_SHIFT}) >> 11)::UBIGINT AS u FROM ({z})"


_SEEDS = f"""SELECT r.round::INTEGER AS round, l.LOAN_AMOUNT AS x, (('0x' || substr(md5(l.LOAN_ID::VARCHAR), 1, 16))::UBIGINT::UHUGEINT
  + (r.round + 1)::UHUGEINT * {h.STEP}::UHUGEINT) & {(1 << 64) - 1}::UHUGEINT AS z
  FROM loans l CROSS JOIN (SELECT unnest(range({ROUNDS})) AS round) r"""
_BOOT = f"""b AS (SELECT round, sum({_WEIGHT})::BIGINT AS weight, sum(x * {_WEIGHT}) AS total FROM ({_mixed(_SEEDS)}) GROUP BY 1)"""


@query("h3_poisson_bootstrap", with_views("SELECT round, weight, round(total, 4) AS total, round(total / weight, 6) AS mean FROM b", _BOOT, names="loans"))
def _(spark, sf_dir):
    rounds = h.poisson_bootstrap(load_views(spark, sf_dir)["loans"], "LOAN_ID", "LOAN_AMOUNT", ROUNDS)
    return rounds.select("round", "weight", F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"))


@query(
    "h4_percentile_interval",
    with_views("SELECT round(quantile_cont(total / weight, 0.025), 6) AS lower, round(quantile_cont(total / weight, 0.975), 6) AS upper FROM b", _BOOT, names="loans"),
)
def _(spark, sf_dir):
    rounds = h.poisson_bootstrap(load_views(spark, sf_dir)["loans"], "LOAN_ID", "LOAN_AMOUNT", ROUNDS)
    return h.percentile_interval(rounds, "mean").select(F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"))


TOLERANCES = [7, 14, 30]


def _nearest(spark, sf_dir, adapter="dense"):
    v = load_views(spark, sf_dir, adapter)
    used = shape.used_loans(v["loans"])
    return h.nearest_orders(used, v["purchases"], risk.heavy_retailers(used, v["purchases"]))


def _coverage_sql(select):
    return with_views(
        select,
        f"""near AS (SELECT l.LOAN_ID, l.MAIN_SYSTEM_ID, l.PAYMENT_STATUS, l.LOAN_ISSUANCE_DATE AS i, p.ORDER_CREATION_DATE AS o
  FROM (SELECT * FROM loans WHERE SPENT > 0) l ASOF LEFT JOIN purchases p ON l.MAIN_SYSTEM_ID = p.MAIN_SYSTEM_ID AND l.LOAN_ISSUANCE_DATE >= p.ORDER_CREATION_DATE),
c AS (SELECT *, coalesce(o >= i - to_days(tolerance) AND i > o, false) AS matched FROM near CROSS JOIN (SELECT unnest({TOLERANCES}) AS tolerance))""",
        names="loans purchases",
    )


@query(
    "h6_asof_coverage",
    _coverage_sql(
        """SELECT tolerance, count(*) AS loans, count(*) FILTER (WHERE matched) AS matched, round(count(*) FILTER (WHERE matched) / count(*), 6) AS matched_share,
count(DISTINCT MAIN_SYSTEM_ID) - count(DISTINCT MAIN_SYSTEM_ID) FILTER (WHERE matched) AS lost_retailers FROM c GROUP BY 1"""
    ),
)
def _(spark, sf_dir):
    return h.asof_coverage(_nearest(spark, sf_dir), TOLERANCES)


@query("h6_lost_by_status", _coverage_sql("SELECT tolerance, PAYMENT_STATUS, count(*) AS n_lost FROM c WHERE NOT matched GROUP BY 1, 2"))
def _(spark, sf_dir):
    return h.lost_by_status(_nearest(spark, sf_dir), TOLERANCES)


@query(
    "w2_rolling_over_joined_rows",
    _h(
        f"SELECT LOAN_ID, round(avg(ORDER_PRICE) {_frame(120)}, 4) AS mean_120, round(stddev_samp(ORDER_PRICE) {_frame(120)}, 4) AS std_120 FROM joined",
        days=[30],
    ),
)
def _(spark, sf_dir):
    joined = joined_volume(spark, sf_dir, "sparse", [30]).select("LOAN_ID", KEY, "ORDER_CREATION_DATE", "ORDER_PRICE")
    out = rolling_time(joined, KEY, "ORDER_CREATION_DATE", "ORDER_PRICE", 120, slices=measure(joined, KEY, "ORDER_CREATION_DATE"))
    return out.select(
        "LOAN_ID", F.round("ROLLINGMEAN_120DAYS__ORDER_PRICE__", 4).alias("mean_120"), F.round("ROLLINGSTDDEV_120DAYS__ORDER_PRICE__", 4).alias("std_120")
    )


# --- splits --------------------------------------------------------------------------------------------------------

_RANKED = """labelled AS (SELECT LOAN_ID, CASE WHEN lower(PAYMENT_STATUS) IS DISTINCT FROM 'paid' THEN 1 ELSE 0 END AS label FROM loans WHERE SPENT > 0),
ranked AS (SELECT *, percent_rank() OVER (ORDER BY LOAN_ID) AS r FROM labelled),
parted AS (SELECT *, CASE WHEN r >= CASE label WHEN 1 THEN 0.7 ELSE 0.8 END THEN 'test' WHEN r >= CASE label WHEN 1 THEN 0.5 ELSE 0.6 END THEN 'validation' ELSE 'train' END AS split FROM ranked)"""


def labelled(spark, sf_dir):
    return shape.make_label(load_views(spark, sf_dir)["loans"], "LOAN_NOT_PAID")


@query("w4_percent_rank", with_views("SELECT LOAN_ID, round(r, 12) AS stratified_split FROM ranked", _RANKED, names="loans"))
def _(spark, sf_dir):
    return percent_rank_scaled(labelled(spark, sf_dir).select("LOAN_ID"), "LOAN_ID").withColumn("stratified_split", F.round("stratified_split", 12))


@query("w4_percent_rank_ties", "SELECT o_orderkey, round(percent_rank() OVER (ORDER BY o_orderdate), 12) AS stratified_split FROM orders")
def _(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate")
    return percent_rank_scaled(rows, "o_orderdate").select("o_orderkey", F.round("stratified_split", 12).alias("stratified_split"))


@query("m1_stratified_split", with_views("SELECT LOAN_ID, label, split FROM parted", _RANKED, names="loans"))
def _(spark, sf_dir):
    return split.stratified_time_split(labelled(spark, sf_dir)).select("LOAN_ID", "label", "split")


@query(
    "m2_validation_flag",
    with_views("SELECT LOAN_ID, label, split = 'validation' AS is_validation FROM parted WHERE split <> 'test'", _RANKED, names="loans"),
)
def _(spark, sf_dir):
    return split.train_rows(split.stratified_time_split(labelled(spark, sf_dir))).select("LOAN_ID", "label", "is_validation")


@query(
    "a5_split_audit",
    with_views(
        "SELECT label, count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'validation') AS validation, count(*) FILTER (WHERE split = 'test') AS test FROM parted GROUP BY 1",
        _RANKED,
        names="loans",
    ),
)
def _(spark, sf_dir):
    return split.split_audit(split.stratified_time_split(labelled(spark, sf_dir)))


_CONT = "ranked AS (SELECT LOAN_ID, SPENT AS label, percent_rank() OVER (ORDER BY LOAN_ID) AS r FROM loans WHERE SPENT > 0)"


@query("m3_continuous_split", with_views("SELECT LOAN_ID, label, CASE WHEN r >= 0.8 THEN 'test' ELSE 'train' END AS split FROM ranked", _CONT, names="loans"))
def _(spark, sf_dir):
    rows = shape.make_label(load_views(spark, sf_dir)["loans"], "SPENT")
    return split.time_split(rows).select("LOAN_ID", "label", "split")


@query("m3_time_folds", with_views("SELECT LOAN_ID, least(floor(r * 6), 5)::INTEGER AS fold FROM ranked", _CONT, names="loans"))
def _(spark, sf_dir):
    rows = shape.make_label(load_views(spark, sf_dir)["loans"], "SPENT")
    return split.time_folds(rows).select("LOAN_ID", "fold")
