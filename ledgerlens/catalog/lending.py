"""Rolling volume, as-of join, decisions and portfolio reports."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from ledgerlens.catalog.registry import query
from ledgerlens.catalog.views_sql import SPARSE, with_views
from ledgerlens.operators.skew import measure
from ledgerlens.operators.temporal import asof_join, rolling_time, strictly_before
from ledgerlens.plans import reports, risk
from ledgerlens.schemas import KEY
from ledgerlens.sources.adapters import load_views

TS, PRICE = "ORDER_CREATION_DATE", "ORDER_PRICE"


def _frame(days: int) -> str:
    return (
        f"OVER (PARTITION BY MAIN_SYSTEM_ID ORDER BY ORDER_CREATION_DATE RANGE BETWEEN "
        f"(INTERVAL {days} DAY - INTERVAL 1 MICROSECOND) PRECEDING AND CURRENT ROW)"
    )


def _rolled(days: int) -> str:
    f = _frame(days)
    return (
        f"avg(ORDER_PRICE) {f} AS ROLLINGMEAN_{days}DAYS__ORDER_PRICE__, "
        f"stddev_samp(ORDER_PRICE) {f} AS ROLLINGSTDDEV_{days}DAYS__ORDER_PRICE__"
    )


def _rounded(days: int, digits: int = 6) -> str:
    return ", ".join(f"round({c}_{days}DAYS__ORDER_PRICE__, {digits}) AS {c.lower()}_{days}" for c in ("ROLLINGMEAN", "ROLLINGSTDDEV"))


def _rounded_columns(*days: int, digits: int = 6):
    return [F.round(f"{c}_{d}DAYS__ORDER_PRICE__", digits).alias(f"{c.lower()}_{d}") for d in days for c in ("ROLLINGMEAN", "ROLLINGSTDDEV")]


def _volume_sql(days: list[int]) -> str:
    return f"volume AS (SELECT MAIN_SYSTEM_ID, ORDER_ID, ORDER_CREATION_DATE, ORDER_PRICE, {', '.join(_rolled(d) for d in days)} FROM purchases)"


def _rolling(adapter: str, days: list[int]):
    def run(spark, sf_dir):
        orders = load_views(spark, sf_dir, adapter)["purchases"].select("ORDER_ID", KEY, TS, PRICE)
        slices = measure(orders, KEY, TS)
        return rolling_time(orders, KEY, TS, PRICE, days, slices=slices).select("ORDER_ID", KEY, *_rounded_columns(*days, digits=6 if adapter == "dense" else 5))

    return run


for _name, _adapter, _days in [
    ("w1_rolling_7d_30d", "dense", [7, 30]),
    ("w1_rolling_30d_ties", "sparse", [30]),
    ("w2_rolling_120d_360d", "sparse", [120, 360]),
]:
    query(
        _name,
        with_views(
            f"SELECT ORDER_ID, MAIN_SYSTEM_ID, {', '.join(_rounded(d, 6 if _adapter == 'dense' else 5) for d in _days)} FROM volume",
            _volume_sql(_days),
            names="purchases",
            **({} if _adapter == "dense" else {"adapter": SPARSE}),
        ),
    )(_rolling(_adapter, _days))


def _asof_sql(select: str, tolerance: int, adapter=None, extra: str = "") -> str:
    views = {"adapter": adapter} if adapter else {}
    return with_views(
        select,
        f"""matched AS (SELECT l.LOAN_ID, l.MAIN_SYSTEM_ID, l.LOAN_ISSUANCE_DATE, p.ORDER_CREATION_DATE, p.ORDER_PRICE, p.ORDER_ID
  FROM loans l ASOF LEFT JOIN (SELECT * FROM purchases QUALIFY row_number() OVER
    (PARTITION BY MAIN_SYSTEM_ID, ORDER_CREATION_DATE ORDER BY ORDER_ID DESC) = 1) p
  ON l.MAIN_SYSTEM_ID = p.MAIN_SYSTEM_ID AND l.LOAN_ISSUANCE_DATE >= p.ORDER_CREATION_DATE),
nearest AS (SELECT LOAN_ID, MAIN_SYSTEM_ID, LOAN_ISSUANCE_DATE,
  CASE WHEN ORDER_CREATION_DATE >= LOAN_ISSUANCE_DATE - INTERVAL {tolerance} DAY THEN ORDER_CREATION_DATE END AS ORDER_CREATION_DATE,
  CASE WHEN ORDER_CREATION_DATE >= LOAN_ISSUANCE_DATE - INTERVAL {tolerance} DAY THEN ORDER_ID END AS ORDER_ID,
  CASE WHEN ORDER_CREATION_DATE >= LOAN_ISSUANCE_DATE - INTERVAL {tolerance} DAY THEN ORDER_PRICE END AS ORDER_PRICE FROM matched){extra}""",
        names="loans purchases",
        **views,
    )


def asof_loans(spark, sf_dir, tolerance: int, adapter: str = "dense"):
    views = load_views(spark, sf_dir, adapter)
    loans = views["loans"].select("LOAN_ID", KEY, "LOAN_ISSUANCE_DATE")
    orders = views["purchases"].select(KEY, "ORDER_ID", TS, PRICE)
    slices = risk.heavy_retailers(loans, orders)
    return asof_join(loans, orders, "LOAN_ISSUANCE_DATE", TS, KEY, timedelta(days=tolerance), tie="ORDER_ID", slices=slices)


for _name, _tol, _adapter in [("j7_asof_7d", 7, "dense"), ("j7_asof_30d", 30, "dense"), ("j7_asof_30d_ties", 30, "sparse")]:
    query(_name, _asof_sql("SELECT * FROM nearest", _tol, SPARSE if _adapter == "sparse" else None))(
        lambda spark, sf_dir, t=_tol, a=_adapter: asof_loans(spark, sf_dir, t, a)
    )

for _name, _tol, _adapter in [("j8_strict_7d", 7, "dense"), ("j8_strict_30d_ties", 30, "sparse")]:
    query(
        _name,
        _asof_sql("SELECT * FROM nearest WHERE LOAN_ISSUANCE_DATE > ORDER_CREATION_DATE", _tol, SPARSE if _adapter == "sparse" else None),
    )(lambda spark, sf_dir, t=_tol, a=_adapter: strictly_before(asof_loans(spark, sf_dir, t, a), "LOAN_ISSUANCE_DATE", TS))


# --- decisions and reports; SPENT stands in for the model's prediction -------------------------------------------

MART_SQL = [
    _volume_sql([30]),
    """joined AS (SELECT l.*, l.SPENT AS y_pred, v.ORDER_CREATION_DATE,
  v.ROLLINGMEAN_30DAYS__ORDER_PRICE__ AS m, v.ROLLINGSTDDEV_30DAYS__ORDER_PRICE__ AS s
  FROM loans l ASOF JOIN volume v ON l.MAIN_SYSTEM_ID = v.MAIN_SYSTEM_ID AND l.LOAN_ISSUANCE_DATE >= v.ORDER_CREATION_DATE),
mart AS (SELECT *, coalesce(y_pred <= m + s AND LOAN_AMOUNT <= m + s, false) AS CONSERVATIVE_DECISION,
  coalesce(y_pred <= m + 2 * s AND LOAN_AMOUNT <= m + 2 * s, false) AS AMBITIOUS_DECISION
  FROM joined WHERE ORDER_CREATION_DATE >= LOAN_ISSUANCE_DATE - INTERVAL 7 DAY AND LOAN_ISSUANCE_DATE > ORDER_CREATION_DATE)""",
]


def mart_sql(select: str, *ctes: str) -> str:
    return with_views(select, *MART_SQL, *ctes, names="loans purchases")


MART_COLUMNS = ["LOAN_ID", KEY, "LOAN_ISSUANCE_DATE", "LOAN_AMOUNT", "SPENT", "FIRST_TRIAL_BALANCE", "PAYMENT_STATUS"]


def build_mart(spark, sf_dir):
    views = load_views(spark, sf_dir)
    loans = views["loans"].select(*MART_COLUMNS, F.col("SPENT").alias("y_pred"))
    return risk.risk_mart(loans, views["purchases"], slices=risk.heavy_retailers(loans, views["purchases"]))


@query(
    "r1_decisions_spent_standin",
    mart_sql("SELECT LOAN_ID, CONSERVATIVE_DECISION, AMBITIOUS_DECISION FROM mart"),
)
def _(spark, sf_dir):
    return risk.decisions(build_mart(spark, sf_dir))


@query(
    "r2_risk_mart_spent_standin",
    mart_sql(
        "SELECT LOAN_ID, MAIN_SYSTEM_ID, LOAN_ISSUANCE_DATE, ORDER_CREATION_DATE, LOAN_AMOUNT, y_pred, "
        "round(m, 6) AS usual_mean, round(s, 6) AS usual_std, CONSERVATIVE_DECISION, AMBITIOUS_DECISION FROM mart"
    ),
)
def _(spark, sf_dir):
    mart = build_mart(spark, sf_dir)
    return mart.select(
        "LOAN_ID",
        KEY,
        "LOAN_ISSUANCE_DATE",
        TS,
        "LOAN_AMOUNT",
        "y_pred",
        F.round("ROLLINGMEAN_30DAYS__ORDER_PRICE__", 6).alias("usual_mean"),
        F.round("ROLLINGSTDDEV_30DAYS__ORDER_PRICE__", 6).alias("usual_std"),
        *risk.POLICIES,
    )


def _policy_sql(policy: str) -> str:
    return f"""SELECT date_trunc('week', LOAN_ISSUANCE_DATE)::TIMESTAMP AS week_dt, count(DISTINCT LOAN_ID) AS nunique_loans,
  count(DISTINCT LOAN_ID) FILTER (WHERE {policy}) AS nunique_loans_approved,
  count(DISTINCT LOAN_ID) FILTER (WHERE {policy} AND FIRST_TRIAL_BALANCE < 0) AS nunique_loans_approved_defaulted,
  count(DISTINCT LOAN_ID) FILTER (WHERE FIRST_TRIAL_BALANCE < 0) AS nunique_loans_defaulted_gt,
  sum(LOAN_AMOUNT::VARCHAR::DECIMAL(28,10))::VARCHAR::DOUBLE AS total_amount_requested,
  (sum(LOAN_AMOUNT::VARCHAR::DECIMAL(28,10)) FILTER (WHERE {policy}))::VARCHAR::DOUBLE AS amount_approved,
  (sum(LOAN_AMOUNT::VARCHAR::DECIMAL(28,10)) FILTER (WHERE {policy} AND FIRST_TRIAL_BALANCE < 0))::VARCHAR::DOUBLE AS amount_approved_defaulted,
  (sum(LOAN_AMOUNT::VARCHAR::DECIMAL(28,10)) FILTER (WHERE FIRST_TRIAL_BALANCE < 0))::VARCHAR::DOUBLE AS total_amount_requested_defaulted_gt
  FROM mart GROUP BY ALL"""


def _growth_sql(source: str, columns: list[str]) -> str:
    ratios = ", ".join(f"{c}::DOUBLE / nullif(lag({c}) OVER (ORDER BY week_dt), 0) AS {c}_weekly_growth" for c in columns)
    return f"SELECT *, {ratios} FROM {source}"


POLICY_GROWTH = ["nunique_loans_approved", "nunique_loans_approved_defaulted"]
ROUND_POLICY = ", ".join(f"round({c}_weekly_growth, 6) AS {c}_weekly_growth" for c in POLICY_GROWTH)


def _policy_report_sql(policy: str) -> str:
    return mart_sql(
        f"SELECT * REPLACE ({ROUND_POLICY}) FROM grown WHERE COLUMNS(*) IS NOT NULL",
        f"weekly AS ({_policy_sql(policy)})",
        f"grown AS ({_growth_sql('weekly', POLICY_GROWTH)})",
    )


def _round_columns(df, columns):
    return df.select(*[F.round(c, 6).alias(c) if c in columns else c for c in df.columns])


def _policy_query(policy: str):
    def run(spark, sf_dir):
        report = reports.weekly_policy(build_mart(spark, sf_dir), None, policy)
        return _round_columns(report, [f"{c}_weekly_growth" for c in POLICY_GROWTH])

    return run


query("r5_weekly_conservative_spent_standin", _policy_report_sql("CONSERVATIVE_DECISION"))(_policy_query("CONSERVATIVE_DECISION"))
query("r5_weekly_ambitious_spent_standin", _policy_report_sql("AMBITIOUS_DECISION"))(_policy_query("AMBITIOUS_DECISION"))


@query("a3_policy_counts_joined", mart_sql(_policy_sql("CONSERVATIVE_DECISION")))
def _(spark, sf_dir):
    decided = risk.decisions(build_mart(spark, sf_dir))
    return reports.policy_counts(load_views(spark, sf_dir)["loans"], decided, "CONSERVATIVE_DECISION")


_COMPARE = ["nunique_loans_approved_defaulted", "amount_approved_defaulted"]


@query(
    "a4_compare_policies",
    mart_sql(
        "SELECT c.week_dt, "
        + ", ".join(f"c.{x} AS {x}_conservative, a.{x} AS {x}_ambitious" for x in _COMPARE)
        + " FROM c JOIN a ON a.week_dt = c.week_dt",
        f"c AS ({_policy_sql('CONSERVATIVE_DECISION')})",
        f"a AS ({_policy_sql('AMBITIOUS_DECISION')})",
    ),
)
def _(spark, sf_dir):
    mart = build_mart(spark, sf_dir)
    both = [reports.policy_counts(mart, None, p) for p in risk.POLICIES]
    return reports.compare_policies(*both)


@query(
    "r6_policy_uplift",
    mart_sql(
        """SELECT *, round(loans_other / loans_base - 1, 6) AS loans_uplift, round(retailers_other / retailers_base - 1, 6) AS retailers_uplift
FROM (SELECT count(*) FILTER (WHERE CONSERVATIVE_DECISION) AS loans_base, count(*) FILTER (WHERE AMBITIOUS_DECISION) AS loans_other,
  count(DISTINCT MAIN_SYSTEM_ID) FILTER (WHERE CONSERVATIVE_DECISION) AS retailers_base,
  count(DISTINCT MAIN_SYSTEM_ID) FILTER (WHERE AMBITIOUS_DECISION) AS retailers_other FROM mart)"""
    ),
)
def _(spark, sf_dir):
    return reports.policy_uplift(build_mart(spark, sf_dir))


@query(
    "a12_mean_growth",
    mart_sql(
        "SELECT " + ", ".join(f"round(avg({c}_weekly_growth), 6) AS avg_{c}_weekly_growth" for c in POLICY_GROWTH)
        + " FROM (SELECT * FROM grown WHERE COLUMNS(*) IS NOT NULL) WHERE week_dt < TIMESTAMP '2024-01-29'",
        f"weekly AS ({_policy_sql('AMBITIOUS_DECISION')})",
        f"grown AS ({_growth_sql('weekly', POLICY_GROWTH)})",
    ),
)
def _(spark, sf_dir):
    report = reports.weekly_policy(build_mart(spark, sf_dir), None, "AMBITIOUS_DECISION")
    return reports.mean_growth(report, [f"{c}_weekly_growth" for c in POLICY_GROWTH], "2024-01-29")


@query(
    "r3_portfolio_summary",
    with_views(
        """SELECT count(DISTINCT LOAN_ID) AS nunique_loans, count(DISTINCT date_trunc('week', LOAN_ISSUANCE_DATE)) AS nunique_weeks,
  printf('%.2f', sum(LOAN_AMOUNT::VARCHAR::DECIMAL(28,10))::VARCHAR::DOUBLE) AS total_amount_requested,
  printf('%.2f', sum(SPENT::VARCHAR::DECIMAL(28,10))::VARCHAR::DOUBLE) AS total_amount_spent,
  printf('%.4f', 1 - sum(SPENT::VARCHAR::DECIMAL(28,10))::VARCHAR::DOUBLE / sum(LOAN_AMOUNT::VARCHAR::DECIMAL(28,10))::VARCHAR::DOUBLE) AS percentage_amount_stale,
  count(DISTINCT LOAN_ID) FILTER (WHERE NOT label) AS nunique_loans_fullfiled_first_collection,
  count(DISTINCT LOAN_ID) FILTER (WHERE label) AS nunique_loans_defaulted_first_collection
FROM (SELECT *, lower(PAYMENT_STATUS) IS DISTINCT FROM 'paid' OR FIRST_TRIAL_BALANCE < 0 AS label FROM loans)""",
        names="loans",
    ),
)
def _(spark, sf_dir):
    return reports.portfolio_summary(load_views(spark, sf_dir)["loans"])


OVERVIEW_SQL = """weekly AS (SELECT date_trunc('week', LOAN_ISSUANCE_DATE)::TIMESTAMP AS week_dt, count(DISTINCT LOAN_ID) AS nunique_loans,
  sum(LOAN_AMOUNT::VARCHAR::DECIMAL(28,10))::VARCHAR::DOUBLE AS total_amount_requested, sum(SPENT::VARCHAR::DECIMAL(28,10))::VARCHAR::DOUBLE AS total_amount_spent,
  abs(sum(FIRST_TRIAL_BALANCE::VARCHAR::DECIMAL(28,10)) FILTER (WHERE FIRST_TRIAL_BALANCE < 0))::VARCHAR::DOUBLE AS total_amount_loss
  FROM loans GROUP BY ALL)"""
OVERVIEW = ["nunique_loans", "total_amount_requested", "total_amount_spent", "total_amount_loss"]


@query("a2_weekly_counts", with_views("SELECT * FROM weekly", OVERVIEW_SQL, names="loans"))
def _(spark, sf_dir):
    return reports.overview_counts(load_views(spark, sf_dir)["loans"])


for _name, _adapter in [("r4_weekly_overview", "dense"), ("r4_weekly_overview_sparse", "sparse")]:

    @query(
        _name,
        with_views(
            "SELECT * REPLACE (" + ", ".join(f"round({c}_weekly_growth, 6) AS {c}_weekly_growth" for c in OVERVIEW) + ") FROM grown WHERE COLUMNS(*) IS NOT NULL",
            OVERVIEW_SQL,
            f"grown AS ({_growth_sql('weekly', OVERVIEW)})",
            names="loans",
            **({"adapter": SPARSE} if _adapter == "sparse" else {}),
        ),
    )
    def _(spark, sf_dir, adapter=_adapter):
        report = reports.weekly_overview(load_views(spark, sf_dir, adapter)["loans"])
        return _round_columns(report, [f"{c}_weekly_growth" for c in OVERVIEW])


for _grain in ("day", "week"):

    @query(
        f"r7_stale_capital_{_grain}",
        with_views(
            f"""SELECT period_dt, requested, spent, round(requested - spent, 4) AS stale, round(1 - spent / requested, 6) AS stale_share
FROM (SELECT date_trunc('{_grain}', LOAN_ISSUANCE_DATE)::TIMESTAMP AS period_dt, sum(LOAN_AMOUNT::VARCHAR::DECIMAL(28,10))::VARCHAR::DOUBLE AS requested,
  sum(SPENT::VARCHAR::DECIMAL(28,10))::VARCHAR::DOUBLE AS spent FROM loans GROUP BY 1)""",
            names="loans",
        ),
    )
    def _(spark, sf_dir, grain=_grain):
        return reports.stale_capital(load_views(spark, sf_dir)["loans"], grain)
