"""Facts of a child table's past at the moment of each loan; the SQL joins every loan with its history."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.catalog.registry import query
from ledgerlens.catalog.synthesis import purchases_entity, rounded, sales_entity
from ledgerlens.catalog.views_sql import SPARSE, with_views
from ledgerlens.operators import features as ft
from ledgerlens.operators import prefix
from ledgerlens.schemas import KEY
from ledgerlens.sources.adapters import load_views

_TS = "LOAN_ISSUANCE_DATE"
QUARTERS = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def _loans(v):
    return v["loans"].select("LOAN_ID", KEY, _TS)


def _result(df, names):
    """Loan id and facts, computed doubles to six digits."""
    doubles = {n for n, t in df.dtypes if t == "double" and not n.startswith(("mode_", "first_", "trend_"))}
    out = rounded(df.select("LOAN_ID", *names), doubles)
    return rounded(out, [n for n in names if n.startswith("trend_")], 3)  # slopes of amounts per day are large numbers


def _history(child: str, index: str, time: str, col: str, less: str = "<=") -> str:
    """SQL: every loan with the known rows of one column (NULL where it has none)."""
    child = "(SELECT * FROM loans)" if child == "loans" else child
    return f"""h AS (SELECT l.LOAN_ID, l.{_TS} AS issued, c.{index} AS id, c.{time} AS known, c.{col} AS x FROM loans l
  LEFT JOIN {child} c ON c.MAIN_SYSTEM_ID = l.MAIN_SYSTEM_ID AND c.{time} {less} l.{_TS} AND c.{col} IS NOT NULL)"""


def _quantile_sql(names):
    return "SELECT LOAN_ID, " + ", ".join(f"round(quantile_cont(x, {p}), 6) AS {n}" for n, p in names.items()) + " FROM h GROUP BY LOAN_ID"


def _quantile_query(name, child, index, time, col, names, entity, adapter="dense", less="<="):
    sql = with_views(_quantile_sql(names), _history(child, index, time, col, less), **({} if adapter == "dense" else {"adapter": SPARSE}), names=" ".join(dict.fromkeys(["loans", child])))

    @query(name, sql)
    def _(spark, sf_dir):
        v = load_views(spark, sf_dir, adapter) if adapter != "dense" else load_views(spark, sf_dir)
        out = prefix.quantiles_so_far(_loans(v), entity(v), KEY, col, names, strict=less == "<")
        return _result(out, names)


def loans_entity(v):
    return ft.Entity(v["loans"], "LOAN_ID", _TS)


_quantile_query("d13_median", "purchases", "ORDER_ID", "ORDER_CREATION_DATE", "ORDER_PRICE", QUARTERS, purchases_entity)
_quantile_query("d13_median_sales_paid", "sales", "ID", "UPDATED_AT", "TOTAL_AMOUNT_PAID", {"median_TOTAL_AMOUNT_PAID": 0.5}, sales_entity)
_quantile_query("d13_median_orders_sparse", "purchases", "ORDER_ID", "ORDER_CREATION_DATE", "ORDER_PRICE", {"lowest": 0.0, "median": 0.5, "p90": 0.9}, purchases_entity, "sparse")
_quantile_query("d13_median_earlier_loans", "loans", "LOAN_ID", _TS, "LOAN_AMOUNT", {"median_LOAN_AMOUNT": 0.5}, loans_entity, less="<")


def _mode_sql(col):
    """Counts per loan and value, the most frequent first, of equal ones the smallest."""
    return f"""SELECT LOAN_ID, arg_min(x, (-n, x)) AS mode_{col}, coalesce(max(n), 0) AS mode_count_{col}, count(x) AS num_unique_{col},
round(count(x) / sum(n)::DOUBLE, 6) AS percent_unique_{col}, round(CASE WHEN sum(n) > 0 THEN greatest(ln(sum(n)) - sum(n * ln(n)) / sum(n), 0) END, 6) AS entropy_{col}
FROM (SELECT LOAN_ID, x, CASE WHEN x IS NOT NULL THEN count(*) END AS n FROM h GROUP BY LOAN_ID, x) GROUP BY LOAN_ID"""


def _mode_query(name, child, index, time, col, entity):
    @query(name, with_views(_mode_sql(col), _history(child, index, time, col), names=f"loans {child}"))
    def _(spark, sf_dir):
        v = load_views(spark, sf_dir)
        out = prefix.categories_so_far(_loans(v), entity(v), KEY, col)
        return _result(out, [f"{n}_{col}" for n in ("mode", "mode_count", "num_unique", "percent_unique", "entropy")])


_mode_query("d13_mode", "purchases", "ORDER_ID", "ORDER_CREATION_DATE", "DISCOUNT", purchases_entity)
_mode_query("d13_mode_status", "sales", "ID", "UPDATED_AT", "STATUS", sales_entity)

_MOMENTS = ["variance", "skew", "kurtosis"]


@query(
    "d13_moments",
    with_views(
        """SELECT LOAN_ID, round(var_samp(x), 6) AS variance_ORDER_PRICE,
round(CASE WHEN count(x) > 2 AND max(x) > min(x) THEN skewness(x) * (count(x) - 2) / sqrt(count(x) * (count(x) - 1.0)) END, 6) AS skew_ORDER_PRICE,
round(CASE WHEN count(x) > 2 AND max(x) > min(x) THEN kurtosis_pop(x) END, 6) AS kurtosis_ORDER_PRICE FROM h GROUP BY LOAN_ID""",
        _history("purchases", "ORDER_ID", "ORDER_CREATION_DATE", "ORDER_PRICE"),
        names="loans purchases",
    ),
)
def _(spark, sf_dir):
    v = load_views(spark, sf_dir)
    return _result(prefix.history_so_far(_loans(v), purchases_entity(v), KEY, ["ORDER_PRICE"]), [f"{n}_ORDER_PRICE" for n in _MOMENTS])


_PER_DAY = "(epoch_us(issued) - epoch_us(%s)) / 86400e6"
_TIMES = ["first", "last", "span", "avg_gap", "longest_gap", "days_since_first", "days_since_last", "n_days", "n_weeks", "n_months"]


@query(
    "d13_times",
    with_views(
        f"""SELECT LOAN_ID, min(known) AS first_ORDER_CREATION_DATE, max(known) AS last_ORDER_CREATION_DATE, round((epoch_us(max(known)) - epoch_us(min(known))) / 1e6, 6) AS span_ORDER_CREATION_DATE,
round((epoch_us(max(known)) - epoch_us(min(known))) / 1e6 / nullif(count(known) - 1, 0), 6) AS avg_gap_ORDER_CREATION_DATE, round(max(gap), 6) AS longest_gap_ORDER_CREATION_DATE,
round({_PER_DAY % "min(known)"}, 6) AS days_since_first_ORDER_CREATION_DATE, round({_PER_DAY % "max(known)"}, 6) AS days_since_last_ORDER_CREATION_DATE,
count(DISTINCT date_trunc('day', known)) AS n_days_ORDER_CREATION_DATE, count(DISTINCT date_trunc('week', known)) AS n_weeks_ORDER_CREATION_DATE,
count(DISTINCT date_trunc('month', known)) AS n_months_ORDER_CREATION_DATE
FROM (SELECT *, (epoch_us(known) - epoch_us(lag(known) OVER (PARTITION BY LOAN_ID ORDER BY known, id))) / 1e6 AS gap FROM h) GROUP BY LOAN_ID, issued""",
        _history("purchases", "ORDER_ID", "ORDER_CREATION_DATE", "ORDER_ID"),
        names="loans purchases",
    ),
)
def _(spark, sf_dir):
    v = load_views(spark, sf_dir)
    return _result(prefix.history_so_far(_loans(v), purchases_entity(v), KEY, []), [f"{n}_ORDER_CREATION_DATE" for n in _TIMES])


def _runs_sql(col):
    """First value, trend, flags, runs by sign and the latest step, from the history of every loan in time order."""
    longest = ", ".join(f"coalesce(max(len) FILTER (s = {s}), 0) AS longest_{n}_{col}" for n, s in (("positive", 1), ("zero", 0), ("negative", -1)))
    return f"""SELECT f.LOAN_ID, first_{col}, round(trend, 3) AS trend_{col}, increasing_{col}, decreasing_{col}, longest_positive_{col}, longest_zero_{col}, longest_negative_{col},
sign_changes_{col}, round(last_diff, 6) AS last_diff_{col}, round(last_diff / nullif(last_gap, 0), 6) AS last_rate_{col}, round(last_gap, 6) AS last_gap_{col}
FROM (SELECT LOAN_ID, arg_min(x, (known, id)) AS first_{col}, CASE WHEN max(known) > min(known) THEN regr_slope(x, epoch_us(known) / 86400e6) END AS trend,
        CASE WHEN count(x) > 0 THEN coalesce(min(x - p) >= 0, true) END AS increasing_{col}, CASE WHEN count(x) > 0 THEN coalesce(max(x - p) <= 0, true) END AS decreasing_{col},
        greatest(coalesce(max(run), 1) - 1, 0) AS sign_changes_{col}, arg_max(x - p, (known, id)) AS last_diff, arg_max((epoch_us(known) - epoch_us(pt)) / 1e6, (known, id)) AS last_gap
      FROM g GROUP BY LOAN_ID) f
LEFT JOIN (SELECT LOAN_ID, {longest} FROM (SELECT LOAN_ID, run, any_value(s) AS s, count(*) AS len FROM g WHERE x IS NOT NULL GROUP BY LOAN_ID, run) GROUP BY LOAN_ID
           UNION ALL SELECT LOAN_ID, 0, 0, 0 FROM g WHERE x IS NULL) r USING (LOAN_ID)"""


_RUNS = [
    "e AS (SELECT *, lag(x) OVER w AS p, lag(known) OVER w AS pt, sign(x) AS s FROM h WINDOW w AS (PARTITION BY LOAN_ID ORDER BY known, id))",
    "g AS (SELECT *, CASE WHEN x IS NOT NULL THEN 1 + sum(CASE WHEN s <> sign(p) THEN 1 ELSE 0 END) OVER (PARTITION BY LOAN_ID ORDER BY known, id ROWS UNBOUNDED PRECEDING) END AS run FROM e)",
]
_RUN_NAMES = ["first", "trend", "increasing", "decreasing", "longest_positive", "longest_zero", "longest_negative", "sign_changes"]
_STEP_NAMES = ["last_diff", "last_rate", "last_gap"]


def _runs_query(name, child, index, time, col, entity, kept):
    shown = f"SELECT LOAN_ID, {', '.join(f'{n}_{col}' for n in kept)} FROM ({_runs_sql(col)})"

    @query(name, with_views(shown, _history(child, index, time, col), *_RUNS, names=f"loans {child}"))
    def _(spark, sf_dir):
        v = load_views(spark, sf_dir)
        return _result(prefix.history_so_far(_loans(v), entity(v), KEY, [col]), [f"{n}_{col}" for n in kept])


_runs_query("d5_at_issuance", "purchases", "ORDER_ID", "ORDER_CREATION_DATE", "DISCOUNT", purchases_entity, _RUN_NAMES)
_runs_query("d5_at_issuance_sales_paid", "sales", "ID", "UPDATED_AT", "TOTAL_AMOUNT_PAID", sales_entity, _RUN_NAMES)
_runs_query("d10_at_issuance", "purchases", "ORDER_ID", "ORDER_CREATION_DATE", "ORDER_PRICE", purchases_entity, _STEP_NAMES)
