"""Feature synthesis over the lending views."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ledgerlens.catalog.registry import query
from ledgerlens.catalog.views_sql import with_views
from ledgerlens.operators import features as ft
from ledgerlens.operators.skew import measure
from ledgerlens.operators.temporal import measure_sides
from ledgerlens.schemas import KEY
from ledgerlens.sources.adapters import load_views

CUTOFF = datetime(2024, 2, 1)
TS = "ORDER_CREATION_DATE"
ORDER = [TS, "ORDER_ID"]


def rounded(df, columns, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in columns else c for c in df.columns])


def _purchases(spark, sf_dir):
    return load_views(spark, sf_dir)["purchases"]


COLS = ["ORDER_PRICE", "DISCOUNT"]


def _numeric_sql(c):
    return f"""sum({c}::VARCHAR::DECIMAL(28,10))::VARCHAR::DOUBLE AS sum_{c}, round(avg({c}), 6) AS mean_{c}, min({c}) AS min_{c}, max({c}) AS max_{c},
round(stddev_samp({c}), 6) AS std_{c}, round(var_samp({c}), 6) AS variance_{c},
round(CASE WHEN count({c}) > 2 AND max({c}) > min({c}) THEN skewness({c}) * (count({c}) - 2) / sqrt(count({c}) * (count({c}) - 1.0)) END, 6) AS skew_{c},
round(CASE WHEN count({c}) > 2 AND max({c}) > min({c}) THEN kurtosis_pop({c}) END, 6) AS kurtosis_{c}"""


@query(
    "d2_agg_numeric",
    with_views(f"SELECT MAIN_SYSTEM_ID, count(*) AS count, {', '.join(_numeric_sql(c) for c in COLS)} FROM purchases GROUP BY 1", names="purchases"),
)
def _(spark, sf_dir):
    out = ft.numeric_aggregates(_purchases(spark, sf_dir), KEY, COLS)
    names = [f"{p}_{c}" for c in COLS for p in ("mean", "std", "variance", "skew", "kurtosis")]
    return out.select(*[F.round(F.nanvl(c, F.lit(None)), 6).alias(c) if c in names else c for c in out.columns])


@query(
    "d2_agg_distinct_median",
    with_views(
        "SELECT MAIN_SYSTEM_ID, "
        + ", ".join(
            f"count(DISTINCT {c}) AS num_unique_{c}, round(count(DISTINCT {c}) / count({c}), 6) AS percent_unique_{c}, round(median({c}), 6) AS median_{c}" for c in COLS
        )
        + " FROM purchases GROUP BY 1",
        names="purchases",
    ),
)
def _(spark, sf_dir):
    p = _purchases(spark, sf_dir)
    out = ft.distinct_aggregates(p, KEY, COLS).join(ft.medians(p, KEY, COLS), KEY)
    return rounded(out, [f"{q}_{c}" for c in COLS for q in ("percent_unique", "median")])


@query(
    "d2_agg_mean_counts",
    with_views(
        "SELECT MAIN_SYSTEM_ID, "
        + ", ".join(
            f"""count(*) FILTER (WHERE {c} > m_{c}) AS count_above_mean_{c}, count(*) FILTER (WHERE {c} < m_{c}) AS count_below_mean_{c},
count(*) FILTER (WHERE abs({c} - m_{c}) <= s_{c}) AS count_inside_std_{c}, count(*) FILTER (WHERE abs({c} - m_{c}) > s_{c}) AS count_outside_std_{c},
count(*) FILTER (WHERE {c} >= 0 AND {c} < 50) AS count_in_range_{c}"""
            for c in COLS
        )
        + " FROM (SELECT *, "
        + ", ".join(f"avg({c}) OVER w AS m_{c}, stddev_samp({c}) OVER w AS s_{c}" for c in COLS)
        + " FROM purchases WINDOW w AS (PARTITION BY MAIN_SYSTEM_ID)) GROUP BY 1",
        names="purchases",
    ),
)
def _(spark, sf_dir):
    return ft.mean_counts(_purchases(spark, sf_dir), KEY, COLS)


@query(
    "d3_agg_categorical",
    with_views(
        """SELECT MAIN_SYSTEM_ID, arg_min(STATUS, (-n, STATUS)) AS mode_STATUS, max(n) AS mode_count_STATUS, count(*) AS num_unique_STATUS, sum(n)::BIGINT AS count_STATUS,
round(greatest(ln(sum(n)) - sum(n * ln(n)) / sum(n), 0), 6) AS entropy_STATUS, max(STATUS) FILTER (WHERE p = 1) AS common1_STATUS,
max(STATUS) FILTER (WHERE p = 2) AS common2_STATUS, max(STATUS) FILTER (WHERE p = 3) AS common3_STATUS
FROM (SELECT *, row_number() OVER (PARTITION BY MAIN_SYSTEM_ID ORDER BY n DESC, STATUS) AS p FROM (SELECT MAIN_SYSTEM_ID, STATUS, count(*) AS n FROM sales GROUP BY 1, 2)) GROUP BY 1""",
        names="sales",
    ),
)
def _(spark, sf_dir):
    return rounded(ft.categorical_aggregates(load_views(spark, sf_dir)["sales"], KEY, "STATUS"), ["entropy_STATUS"])


_T = "ORDER_CREATION_DATE"


@query(
    "d4_agg_time",
    with_views(
        f"""SELECT MAIN_SYSTEM_ID, min({_T}) AS first_{_T}, max({_T}) AS last_{_T}, (epoch_us(max({_T})) - epoch_us(min({_T}))) / 1e6 AS span_{_T},
(epoch_us(max({_T})) - epoch_us(min({_T}))) / 1e6 / nullif(count(*) - 1, 0) AS avg_gap_{_T},
round((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(min({_T}))) / 1e6 / 86400, 6) AS days_since_first_{_T},
round((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(max({_T}))) / 1e6 / 86400, 6) AS days_since_last_{_T},
count(DISTINCT {_T}::DATE) AS n_days_{_T}, count(DISTINCT date_trunc('week', {_T})) AS n_weeks_{_T}, count(DISTINCT date_trunc('month', {_T})) AS n_months_{_T}
FROM purchases GROUP BY 1""",
        names="purchases",
    ),
)
def _(spark, sf_dir):
    out = ft.time_aggregates(_purchases(spark, sf_dir), KEY, TS, CUTOFF)
    return rounded(out, [f"days_since_first_{TS}", f"days_since_last_{TS}"])


@query(
    "d5_agg_ordered",
    with_views(
        """SELECT s.MAIN_SYSTEM_ID, first_x AS first_DISCOUNT, last_x AS last_DISCOUNT, increasing AS increasing_DISCOUNT, decreasing AS decreasing_DISCOUNT,
trend AS trend_DISCOUNT, coalesce(pos, 0) AS longest_positive_DISCOUNT, coalesce(zer, 0) AS longest_zero_DISCOUNT, coalesce(neg, 0) AS longest_negative_DISCOUNT, n_runs - 1 AS sign_changes_DISCOUNT
FROM (SELECT MAIN_SYSTEM_ID, arg_min(DISCOUNT, (ORDER_CREATION_DATE, ORDER_ID)) AS first_x, arg_max(DISCOUNT, (ORDER_CREATION_DATE, ORDER_ID)) AS last_x,
  coalesce(bool_and(DISCOUNT >= p), true) AS increasing, coalesce(bool_and(DISCOUNT <= p), true) AS decreasing,
  round(regr_slope(DISCOUNT, epoch_us(ORDER_CREATION_DATE) / 1e6 / 86400), 6) AS trend FROM steps GROUP BY 1) s
JOIN (SELECT MAIN_SYSTEM_ID, max(len) FILTER (WHERE s = 1) AS pos, max(len) FILTER (WHERE s = 0) AS zer, max(len) FILTER (WHERE s = -1) AS neg, count(*) AS n_runs
  FROM (SELECT MAIN_SYSTEM_ID, run, any_value(s) AS s, count(*) AS len FROM runs GROUP BY 1, 2) GROUP BY 1) r ON r.MAIN_SYSTEM_ID = s.MAIN_SYSTEM_ID""",
        "steps AS (SELECT *, sign(DISCOUNT) AS s, lag(DISCOUNT) OVER w AS p, lag(sign(DISCOUNT)) OVER w AS ps FROM purchases WINDOW w AS (PARTITION BY MAIN_SYSTEM_ID ORDER BY ORDER_CREATION_DATE, ORDER_ID))",
        "runs AS (SELECT *, sum(CASE WHEN s <> ps THEN 1 ELSE 0 END) OVER (PARTITION BY MAIN_SYSTEM_ID ORDER BY ORDER_CREATION_DATE, ORDER_ID) AS run FROM steps)",
        names="purchases",
    ),
)
def _(spark, sf_dir):
    p = _purchases(spark, sf_dir)
    return rounded(ft.ordered_aggregates(p, KEY, ORDER, "DISCOUNT", slices=measure(p, KEY, TS)), ["trend_DISCOUNT"])


@query(
    "d6_direct",
    with_views(
        """SELECT l.LOAN_ID, p.n AS purchases_count, p.total AS purchases_sum_ORDER_PRICE, s.n AS sales_count, s.total AS sales_sum_AMOUNT FROM loans l
LEFT JOIN (SELECT MAIN_SYSTEM_ID, count(*) AS n, sum(ORDER_PRICE::VARCHAR::DECIMAL(28,10))::VARCHAR::DOUBLE AS total FROM purchases GROUP BY 1) p ON p.MAIN_SYSTEM_ID = l.MAIN_SYSTEM_ID
LEFT JOIN (SELECT MAIN_SYSTEM_ID, count(*) AS n, sum(AMOUNT::VARCHAR::DECIMAL(28,10))::VARCHAR::DOUBLE AS total FROM sales GROUP BY 1) s ON s.MAIN_SYSTEM_ID = l.MAIN_SYSTEM_ID""",
        names="loans purchases sales",
    ),
)
def _(spark, sf_dir):
    v = load_views(spark, sf_dir)
    parents = [ft.numeric_aggregates(v["purchases"], KEY, ["ORDER_PRICE"], "purchases_"), ft.numeric_aggregates(v["sales"], KEY, ["AMOUNT"], "sales_")]
    return ft.dfs_direct(v["loans"].select("LOAN_ID", KEY), KEY, *parents).select(
        "LOAN_ID", "purchases_count", "purchases_sum_ORDER_PRICE", "sales_count", "sales_sum_AMOUNT"
    )


_L = "LOAN_ISSUANCE_DATE"
_PART = "CASE " + " ".join(f"WHEN hour({_L}) >= {h} THEN '{n}'" for h, n in reversed(ft.PARTS_OF_DAY)) + " ELSE 'midnight' END"
_CALENDAR = {
    "year": f"year({_L})",
    "quarter": f"quarter({_L})",
    "month": f"month({_L})",
    "week": f"weekofyear({_L})",
    "day": f"day({_L})",
    "day_of_year": f"dayofyear({_L})",
    "weekday": f"isodow({_L}) - 1",
    "hour": f"hour({_L})",
    "minute": f"minute({_L})",
    "second": f"second({_L})",
    "is_weekend": f"isodow({_L}) >= 6",
    "is_month_start": f"day({_L}) = 1",
    "is_month_end": f"{_L}::DATE = last_day({_L})",
    "is_quarter_start": f"day({_L}) = 1 AND month({_L}) IN (1, 4, 7, 10)",
    "is_quarter_end": f"{_L}::DATE = last_day({_L}) AND month({_L}) IN (3, 6, 9, 12)",
    "is_year_start": f"dayofyear({_L}) = 1",
    "is_year_end": f"day({_L}) = 31 AND month({_L}) = 12",
    "is_leap_year": f"day(last_day(make_date(year({_L}), 2, 1))) = 29",
    "days_in_month": f"day(last_day({_L}))",
    "part_of_day": _PART,
    "is_working_hours": f"hour({_L}) BETWEEN 8 AND 18",
}
for _name, _adapter in [("d7_calendar", "dense"), ("d7_calendar_sparse", "sparse")]:
    from ledgerlens.catalog.views_sql import SPARSE

    @query(
        _name,
        with_views(
            "SELECT LOAN_ID, " + ", ".join(f"{e} AS {n}_{_L}" for n, e in _CALENDAR.items()) + " FROM loans",
            names="loans",
            **({"adapter": SPARSE} if _adapter == "sparse" else {}),
        ),
    )
    def _(spark, sf_dir, adapter=_adapter):
        return ft.dfs_transform(load_views(spark, sf_dir, adapter)["loans"].select("LOAN_ID", _L), ft.calendar_features(_L)).drop(_L)


_UNARY = ["LOAN_AMOUNT", "FIRST_TRIAL_BALANCE"]


def _unary_sql(c):
    return f"""abs({c}) AS absolute_{c}, -{c} AS negate_{c}, round(CASE WHEN {c} >= 0 THEN sqrt({c}) END, 9) AS sqrt_{c}, round(CASE WHEN {c} > 0 THEN ln({c}) END, 9) AS log_{c},
round(sin({c}), 9) AS sine_{c}, round(cos({c}), 9) AS cosine_{c}, round(tan({c}), 5) AS tangent_{c}, {c} IS NULL AS is_null_{c}"""


@query("d8_unary", with_views(f"SELECT LOAN_ID, {', '.join(map(_unary_sql, _UNARY))} FROM loans", names="loans"))
def _(spark, sf_dir):
    out = ft.dfs_transform(load_views(spark, sf_dir)["loans"].select("LOAN_ID", *_UNARY), ft.unary_features(_UNARY)).drop(*_UNARY)
    out = rounded(out, [f"{p}_{c}" for c in _UNARY for p in ("sqrt", "log", "sine", "cosine")], 9)
    return rounded(out, [f"tangent_{c}" for c in _UNARY], 5)


_A, _B = "SPENT", "LOAN_AMOUNT"


@query(
    "d9_pairs",
    with_views(
        f"""SELECT LOAN_ID, {_A} + {_B} AS {_A}_add_{_B}, {_A} - {_B} AS {_A}_sub_{_B}, round({_A} * {_B}, 6) AS {_A}_mul_{_B}, {_A} / nullif({_B}, 0) AS {_A}_div_{_B},
round({_A} % nullif({_B}, 0), 6) AS {_A}_mod_{_B}, {_A} > {_B} AS {_A}_gt_{_B}, {_A} >= {_B} AS {_A}_ge_{_B}, {_A} = {_B} AS {_A}_eq_{_B}, {_A} <> {_B} AS {_A}_ne_{_B} FROM loans""",
        names="loans",
    ),
)
def _(spark, sf_dir):
    loans = load_views(spark, sf_dir)["loans"].select("LOAN_ID", _A, _B)
    return rounded(ft.dfs_transform(loans, ft.pair_features([_A, _B])).drop(_A, _B), [f"{_A}_mul_{_B}", f"{_A}_mod_{_B}"])


@query(
    "d9_flags",
    with_views("SELECT LOAN_ID, NOT a AS not_a, NOT b AS not_b, a AND b AS a_and_b, a OR b AS a_or_b FROM (SELECT LOAN_ID, SPENT > 30 AS a, FIRST_TRIAL_BALANCE < 0 AS b FROM loans)", names="loans"),
)
def _(spark, sf_dir):
    flags = load_views(spark, sf_dir)["loans"].select("LOAN_ID", (F.col("SPENT") > 30).alias("a"), (F.col("FIRST_TRIAL_BALANCE") < 0).alias("b"))
    return ft.dfs_transform(flags, ft.flag_features(["a", "b"])).drop("a", "b")


_W = "PARTITION BY MAIN_SYSTEM_ID ORDER BY ORDER_CREATION_DATE, ORDER_ID"


@query(
    "d10_cumulative",
    with_views(
        f"""SELECT ORDER_ID, (sum(ORDER_PRICE::VARCHAR::DECIMAL(28,10)) OVER w)::VARCHAR::DOUBLE AS cum_sum_ORDER_PRICE, count(ORDER_PRICE) OVER w AS cum_count_ORDER_PRICE,
round((sum(ORDER_PRICE::VARCHAR::DECIMAL(28,10)) OVER w)::VARCHAR::DOUBLE / count(ORDER_PRICE) OVER w, 6) AS cum_mean_ORDER_PRICE, min(ORDER_PRICE) OVER w AS cum_min_ORDER_PRICE,
max(ORDER_PRICE) OVER w AS cum_max_ORDER_PRICE, round(stddev_samp(ORDER_PRICE) OVER w, 6) AS expanding_std_ORDER_PRICE FROM purchases WINDOW w AS ({_W} ROWS UNBOUNDED PRECEDING)""",
        names="purchases",
    ),
)
def _(spark, sf_dir):
    p = _purchases(spark, sf_dir).select("ORDER_ID", KEY, TS, "ORDER_PRICE")
    out = ft.cumulative_features(p, KEY, ORDER, "ORDER_PRICE", measure(p, KEY, TS)).drop(KEY, TS, "ORDER_PRICE")
    return rounded(out, ["cum_mean_ORDER_PRICE", "expanding_std_ORDER_PRICE"])


@query(
    "d10_steps",
    with_views(
        f"""SELECT ORDER_ID, lag(ORDER_PRICE) OVER w AS lag_ORDER_PRICE, ORDER_PRICE - lag(ORDER_PRICE) OVER w AS diff_ORDER_PRICE,
round((ORDER_PRICE - lag(ORDER_PRICE) OVER w) / nullif((epoch_us(ORDER_CREATION_DATE) - epoch_us(lag(ORDER_CREATION_DATE) OVER w)) / 1e6, 0), 6) AS rate_ORDER_PRICE,
ORDER_PRICE = lag(ORDER_PRICE) OVER w AS same_ORDER_PRICE, round((epoch_us(ORDER_CREATION_DATE) - epoch_us(lag(ORDER_CREATION_DATE) OVER w)) / 1e6, 6) AS time_since_previous_ORDER_PRICE
FROM purchases WINDOW w AS ({_W})""",
        names="purchases",
    ),
)
def _(spark, sf_dir):
    p = _purchases(spark, sf_dir).select("ORDER_ID", KEY, TS, "ORDER_PRICE")
    out = ft.step_features(p, KEY, ORDER, "ORDER_PRICE", measure(p, KEY, TS)).drop(KEY, TS, "ORDER_PRICE")
    return rounded(rounded(out, ["rate_ORDER_PRICE"]), ["time_since_previous_ORDER_PRICE"], 6)


@query(
    "d10_rolling_rows",
    with_views(
        f"""SELECT ORDER_ID, count(ORDER_PRICE) OVER w AS roll_count_ORDER_PRICE, round(avg(ORDER_PRICE) OVER w, 5) AS roll_mean_ORDER_PRICE, round(stddev_samp(ORDER_PRICE) OVER w, 6) AS roll_std_ORDER_PRICE,
min(ORDER_PRICE) OVER w AS roll_min_ORDER_PRICE, max(ORDER_PRICE) OVER w AS roll_max_ORDER_PRICE FROM purchases WINDOW w AS ({_W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
        names="purchases",
    ),
)
def _(spark, sf_dir):
    p = _purchases(spark, sf_dir).select("ORDER_ID", KEY, TS, "ORDER_PRICE")
    out = ft.rolling_row_features(p, KEY, ORDER, "ORDER_PRICE", 3, measure(p, KEY, TS)).drop(KEY, TS, "ORDER_PRICE")
    return rounded(rounded(out, ["roll_mean_ORDER_PRICE"], 5), ["roll_std_ORDER_PRICE"])


@query(
    "d10_percentile",
    with_views(
        """SELECT ORDER_ID, round((rank() OVER w + count(*) OVER w) / (2 * count(*) OVER (PARTITION BY MAIN_SYSTEM_ID)), 9) AS percentile_ORDER_PRICE
FROM purchases WINDOW w AS (PARTITION BY MAIN_SYSTEM_ID ORDER BY ORDER_PRICE)""",
        names="purchases",
    ),
)
def _(spark, sf_dir):
    p = _purchases(spark, sf_dir).select("ORDER_ID", KEY, "ORDER_PRICE")
    out = ft.percentile_feature(p, KEY, "ORDER_PRICE", measure(p, KEY, "ORDER_PRICE"))
    return out.select("ORDER_ID", F.round("percentile_ORDER_PRICE", 9).alias("percentile_ORDER_PRICE"))


@query(
    "d10_ewma",
    with_views(
        f"""SELECT ORDER_ID, round(list_sum(list_transform(xs, lambda x, i: x * pow(0.5::DOUBLE, len(xs) - i))) / list_sum(list_transform(xs, lambda x, i: pow(0.5::DOUBLE, len(xs) - i))), 6) AS ewma_ORDER_PRICE
FROM (SELECT ORDER_ID, list(ORDER_PRICE) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS xs FROM purchases)""",
        names="purchases",
    ),
)
def _(spark, sf_dir):
    p = _purchases(spark, sf_dir).select("ORDER_ID", KEY, TS, "ORDER_PRICE")
    out = ft.ewma_feature(p, KEY, ORDER, "ORDER_PRICE", 0.5, measure(p, KEY, TS))
    return out.select("ORDER_ID", F.round("ewma_ORDER_PRICE", 6).alias("ewma_ORDER_PRICE"))


@query(
    "d11_time_since",
    with_views(
        "SELECT LOAN_ID, round((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(LOAN_ISSUANCE_DATE)) / 1e6, 6) AS time_since_LOAN_ISSUANCE_DATE, round((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(INITIAL_DATE)) / 1e6, 6) AS time_since_INITIAL_DATE FROM loans",
        names="loans",
    ),
)
def _(spark, sf_dir):
    times = [_L, "INITIAL_DATE"]
    out = ft.dfs_transform(load_views(spark, sf_dir)["loans"].select("LOAN_ID", *times), ft.time_since_features(times, CUTOFF)).drop(*times)
    return rounded(out, [f"time_since_{t}" for t in times], 6)


DEPTH2 = [("log", "LOAN_AMOUNT_add_TOTAL_INITIAL_AMOUNT"), ("sqrt", "LOAN_AMOUNT_mul_TOTAL_INITIAL_AMOUNT"), ("absolute", "LOAN_AMOUNT_sub_TOTAL_INITIAL_AMOUNT")]


@query(
    "d12_depth2",
    with_views(
        """SELECT LOAN_ID, round(CASE WHEN LOAN_AMOUNT + TOTAL_INITIAL_AMOUNT > 0 THEN ln(LOAN_AMOUNT + TOTAL_INITIAL_AMOUNT) END, 6) AS log_LOAN_AMOUNT_add_TOTAL_INITIAL_AMOUNT,
round(sqrt(LOAN_AMOUNT * TOTAL_INITIAL_AMOUNT), 6) AS sqrt_LOAN_AMOUNT_mul_TOTAL_INITIAL_AMOUNT, abs(LOAN_AMOUNT - TOTAL_INITIAL_AMOUNT) AS absolute_LOAN_AMOUNT_sub_TOTAL_INITIAL_AMOUNT FROM loans""",
        names="loans",
    ),
)
def _(spark, sf_dir):
    base = ["LOAN_AMOUNT", "TOTAL_INITIAL_AMOUNT"]
    first = ft.pair_features(base)
    second = ft.depth2_features(first, DEPTH2)
    out = ft.dfs_transform(ft.dfs_transform(load_views(spark, sf_dir)["loans"].select("LOAN_ID", *base), first), second)
    return rounded(out.select("LOAN_ID", *[f.name for f in second]), [f.name for f in second if f.params != "absolute"])


def sales_entity(views):
    return ft.Entity(views["sales"], "ID", "CREATED_AT", {"UPDATED_AT": ["STATUS", "TOTAL_AMOUNT_PAID"]})


def purchases_entity(views):
    return ft.Entity(views["purchases"], "ORDER_ID", TS)


@query(
    "d13_point_in_time_purchases",
    with_views(
        """SELECT l.LOAN_ID, count(p.ORDER_ID) AS count, sum(p.ORDER_PRICE::VARCHAR::DECIMAL(28,10))::VARCHAR::DOUBLE AS sum_ORDER_PRICE, round(avg(p.ORDER_PRICE), 6) AS mean_ORDER_PRICE,
round(stddev_samp(p.ORDER_PRICE), 6) AS std_ORDER_PRICE, min(p.ORDER_PRICE) AS min_ORDER_PRICE, max(p.ORDER_PRICE) AS max_ORDER_PRICE,
arg_max(p.ORDER_PRICE, (p.ORDER_CREATION_DATE, p.ORDER_ID)) AS last_ORDER_PRICE, count(DISTINCT p.DISCOUNT) AS num_unique_DISCOUNT
FROM loans l LEFT JOIN purchases p ON p.MAIN_SYSTEM_ID = l.MAIN_SYSTEM_ID AND p.ORDER_CREATION_DATE <= l.LOAN_ISSUANCE_DATE GROUP BY 1""",
        names="loans purchases",
    ),
)
def _(spark, sf_dir):
    v = load_views(spark, sf_dir)
    out = ft.point_in_time(v["loans"], purchases_entity(v), KEY, ["ORDER_PRICE"], ["DISCOUNT"], slices=measure_sides(v["loans"], v["purchases"], _L, TS, KEY))
    return rounded(out, ["mean_ORDER_PRICE", "std_ORDER_PRICE"])


@query(
    "d13_point_in_time_sales_masked",
    with_views(
        """SELECT l.LOAN_ID, count(s.ID) AS count, sum(s.AMOUNT::VARCHAR::DECIMAL(28,10))::VARCHAR::DOUBLE AS sum_AMOUNT,
(sum(s.TOTAL_AMOUNT_PAID::VARCHAR::DECIMAL(28,10)) FILTER (WHERE s.UPDATED_AT <= l.LOAN_ISSUANCE_DATE))::VARCHAR::DOUBLE AS sum_TOTAL_AMOUNT_PAID,
max(s.TOTAL_AMOUNT_PAID) FILTER (WHERE s.UPDATED_AT <= l.LOAN_ISSUANCE_DATE)::DOUBLE AS max_TOTAL_AMOUNT_PAID,
count(DISTINCT s.STATUS) FILTER (WHERE s.UPDATED_AT <= l.LOAN_ISSUANCE_DATE) AS num_unique_STATUS
FROM loans l LEFT JOIN sales s ON s.MAIN_SYSTEM_ID = l.MAIN_SYSTEM_ID AND s.CREATED_AT <= l.LOAN_ISSUANCE_DATE GROUP BY 1""",
        names="loans sales",
    ),
)
def _(spark, sf_dir):
    v = load_views(spark, sf_dir)
    out = ft.point_in_time(
        v["loans"], sales_entity(v), KEY, ["AMOUNT", "TOTAL_AMOUNT_PAID"], ["STATUS"], slices=measure_sides(v["loans"], v["sales"], _L, "CREATED_AT", KEY)
    )
    return out.select("LOAN_ID", "count", "sum_AMOUNT", "sum_TOTAL_AMOUNT_PAID", "max_TOTAL_AMOUNT_PAID", "num_unique_STATUS")
