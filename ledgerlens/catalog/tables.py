"""Projections, filters, joins, aggregations and profiles."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.catalog.lending import _asof_sql, asof_loans
from ledgerlens.catalog.registry import query
from ledgerlens.catalog.views_sql import with_views
from ledgerlens.functions.exact import exact_sum
from ledgerlens.functions.scalar import flag
from ledgerlens.operators import profiling, quantiles, shape, summaries
from ledgerlens.operators.skew import measure
from ledgerlens.operators.temporal import asof_join
from ledgerlens.plans import risk
from ledgerlens.schemas import KEY, LOANS, PURCHASES, SALES
from ledgerlens.sources.adapters import load_views, table


def loans_of(spark, sf_dir):
    return load_views(spark, sf_dir)["loans"]


def simple(name, sql, build, names="loans"):
    """Register a query that is one function of the dense views."""
    query(name, with_views(sql, names=names))(lambda spark, sf_dir: build(load_views(spark, sf_dir)))


simple(
    "p1_drop_leaky",
    "SELECT MAIN_SYSTEM_ID, LOAN_ID, LOAN_ISSUANCE_DATE, LOAN_AMOUNT, TOTAL_INITIAL_AMOUNT, INITIAL_DATE FROM loans",
    lambda v: shape.drop_leaky(v["loans"]),
)
simple(
    "p2_column_subset",
    "SELECT LOAN_ID, SPENT, PAYMENT_STATUS, FIRST_TRAIL_DELAYS FROM loans",
    lambda v: v["loans"].select("LOAN_ID", "SPENT", "PAYMENT_STATUS", "FIRST_TRAIL_DELAYS"),
)


@query(
    "p3_conform_types",
    with_views(
        "SELECT LOAN_ID, MAIN_SYSTEM_ID, LOAN_ISSUANCE_DATE, LOAN_AMOUNT, PAYMENT_STATUS FROM loans",
        names="loans",
    ),
)
def _(spark, sf_dir):
    # as read from an untyped CSV: every value is text
    text = loans_of(spark, sf_dir).select(*[F.col(f.name).cast("string").alias(f.name) for f in LOANS.fields])
    typed = shape.conform(text, LOANS)
    return typed.select("LOAN_ID", KEY, "LOAN_ISSUANCE_DATE", "LOAN_AMOUNT", "PAYMENT_STATUS")


simple("p7_one_retailer", "SELECT LOAN_ID, LOAN_AMOUNT FROM loans WHERE MAIN_SYSTEM_ID = 42", lambda v: v["loans"].where(F.col(KEY) == 42).select("LOAN_ID", "LOAN_AMOUNT"))
simple("p8_used_loans", "SELECT LOAN_ID, SPENT FROM loans WHERE SPENT > 0", lambda v: shape.used_loans(v["loans"]).select("LOAN_ID", "SPENT"))
simple(
    "p9_issued_after",
    "SELECT LOAN_ID, LOAN_ISSUANCE_DATE FROM loans WHERE LOAN_ISSUANCE_DATE > TIMESTAMP '2024-01-15'",
    lambda v: v["loans"].where(F.col("LOAN_ISSUANCE_DATE") > F.lit("2024-01-15").cast("timestamp_ntz")).select("LOAN_ID", "LOAN_ISSUANCE_DATE"),
)
simple(
    "p10_missed_then_paid",
    """SELECT MAIN_SYSTEM_ID, LOAN_ID, REPAYMENT_ID, REPAYMENT_AMOUNT, TOTAL_FINAL_AMOUNT FROM loans
WHERE FIRST_TRIAL_BALANCE < 0 AND PAYMENT_STATUS = 'Paid'""",
    lambda v: shape.missed_first_collection(v["loans"], yet_paid=True)
    .select(KEY, "LOAN_ID", "REPAYMENT_ID", "REPAYMENT_AMOUNT", "TOTAL_FINAL_AMOUNT")
    .orderBy(KEY, "LOAN_ID"),
)
simple("p10_missed", "SELECT LOAN_ID, FIRST_TRIAL_BALANCE FROM loans WHERE FIRST_TRIAL_BALANCE < 0", lambda v: shape.missed_first_collection(v["loans"]).select("LOAN_ID", "FIRST_TRIAL_BALANCE"))
simple(
    "p11_overspent",
    "SELECT MAIN_SYSTEM_ID, LOAN_ID, LOAN_AMOUNT, SPENT FROM loans WHERE SPENT / nullif(LOAN_AMOUNT, 0) > 1",
    lambda v: shape.overspent(v["loans"]),
)
simple(
    "p12_targets",
    """SELECT LOAN_ID, SPENT, CASE WHEN lower(PAYMENT_STATUS) IS DISTINCT FROM 'paid' THEN 1 ELSE 0 END AS LOAN_NOT_PAID,
CASE WHEN FIRST_TRAIL_DELAYS > 0 THEN 1 ELSE 0 END AS FIRST_TRAIL_DELAY FROM loans WHERE SPENT > 0""",
    lambda v: shape.targets(v["loans"]),
)
simple(
    "p12_label_not_paid",
    "SELECT LOAN_ID, CASE WHEN lower(PAYMENT_STATUS) IS DISTINCT FROM 'paid' THEN 1 ELSE 0 END AS label FROM loans WHERE SPENT > 0",
    lambda v: shape.make_label(v["loans"], "loan_not_paid"),
)
simple(
    "p13_first_collection_default",
    'SELECT LOAN_ID, lower(PAYMENT_STATUS) IS DISTINCT FROM \'paid\' OR FIRST_TRIAL_BALANCE < 0 AS "LABEL" FROM loans',
    lambda v: shape.first_collection_default(v["loans"]).select("LOAN_ID", "LABEL"),
)
simple(
    "p14_ratio_due_date",
    "SELECT LOAN_ID, SPENT / nullif(LOAN_AMOUNT, 0) AS spend_ratio, INITIAL_DATE AS LOAN_DUE_DATE FROM loans",
    lambda v: v["loans"].select("LOAN_ID", shape.spend_ratio().alias("spend_ratio"), F.col("INITIAL_DATE").alias("LOAN_DUE_DATE")),
)


@query("p15_drop_nulls", _asof_sql("SELECT * FROM nearest WHERE ORDER_ID IS NOT NULL", 7))
def _(spark, sf_dir):
    return asof_loans(spark, sf_dir, 7).dropna()


simple("p16_distinct_keys", "SELECT DISTINCT MAIN_SYSTEM_ID FROM loans", lambda v: v["loans"].select(KEY).dropDuplicates())
simple(
    "p16_distinct_rows",
    "SELECT DISTINCT MAIN_SYSTEM_ID, PAYMENT_STATUS, FIRST_TRAIL_DELAYS FROM loans",
    lambda v: v["loans"].select(KEY, "PAYMENT_STATUS", "FIRST_TRAIL_DELAYS").dropDuplicates(),
)
simple(
    "p17_transpose_first_loans",
    """SELECT LOAN_ID, attribute, value FROM (UNPIVOT (SELECT LOAN_ID, MAIN_SYSTEM_ID::VARCHAR AS MAIN_SYSTEM_ID, PAYMENT_STATUS,
FIRST_TRAIL_DELAYS::VARCHAR AS FIRST_TRAIL_DELAYS FROM loans QUALIFY row_number() OVER (PARTITION BY MAIN_SYSTEM_ID ORDER BY LOAN_ISSUANCE_DATE, LOAN_ID) <= 3)
ON MAIN_SYSTEM_ID, PAYMENT_STATUS, FIRST_TRAIL_DELAYS INTO NAME attribute VALUE value)""",
    lambda v: shape.transpose(
        shape.first_per_key(v["loans"].select(KEY, "LOAN_ID", "LOAN_ISSUANCE_DATE", "PAYMENT_STATUS", "FIRST_TRAIL_DELAYS"), KEY, ["LOAN_ISSUANCE_DATE", "LOAN_ID"], 3),
        "LOAN_ID",
        [KEY, "PAYMENT_STATUS", "FIRST_TRAIL_DELAYS"],
    ),
)
simple("p18_first_row", "SELECT * FROM purchases ORDER BY ORDER_ID LIMIT 1", lambda v: shape.first_row(v["purchases"], "ORDER_ID"), "purchases")

# --- joins ---------------------------------------------------------------------------------------------------------

simple(
    "j1_inner_loan_id",
    "SELECT l.LOAN_ID, l.LOAN_AMOUNT, t.label FROM loans l JOIN (SELECT LOAN_ID, SPENT AS label FROM loans WHERE SPENT > 0) t ON t.LOAN_ID = l.LOAN_ID",
    lambda v: v["loans"].select("LOAN_ID", "LOAN_AMOUNT").join(shape.make_label(v["loans"], "spent"), "LOAN_ID"),
)
simple(
    "j2_left_deduplicated",
    """SELECT p.ORDER_ID, p.MAIN_SYSTEM_ID, r.RETAILER_ID FROM purchases p
LEFT JOIN (SELECT DISTINCT MAIN_SYSTEM_ID, RETAILER_ID FROM loans) r ON r.MAIN_SYSTEM_ID = p.MAIN_SYSTEM_ID""",
    lambda v: v["purchases"].select("ORDER_ID", KEY).join(v["loans"].select(KEY, "RETAILER_ID").dropDuplicates(), KEY, "left"),
    "loans purchases",
)


@query("j3_semi_decided", _asof_sql("SELECT LOAN_ID, LOAN_AMOUNT FROM loans WHERE LOAN_ID IN (SELECT LOAN_ID FROM nearest WHERE LOAN_ISSUANCE_DATE > ORDER_CREATION_DATE)", 7))
def _(spark, sf_dir):
    decided = asof_loans(spark, sf_dir, 7).where(F.col("LOAN_ISSUANCE_DATE") > F.col("ORDER_CREATION_DATE"))
    return loans_of(spark, sf_dir).select("LOAN_ID", "LOAN_AMOUNT").join(decided.select("LOAN_ID"), "LOAN_ID", "left_semi")


@query(
    "j4_anti_lost_retailers",
    _asof_sql("SELECT DISTINCT MAIN_SYSTEM_ID FROM loans WHERE MAIN_SYSTEM_ID NOT IN (SELECT MAIN_SYSTEM_ID FROM nearest WHERE ORDER_ID IS NOT NULL)", 7),
)
def _(spark, sf_dir):
    return summaries.lost_keys(loans_of(spark, sf_dir), asof_loans(spark, sf_dir, 7).where("ORDER_ID IS NOT NULL"))


@query(
    "j5_lost_but_present",
    _asof_sql(
        "SELECT count(DISTINCT MAIN_SYSTEM_ID) AS n_present FROM lost WHERE MAIN_SYSTEM_ID IN (SELECT MAIN_SYSTEM_ID FROM purchases)",
        7,
        extra=", lost AS (SELECT DISTINCT MAIN_SYSTEM_ID FROM loans WHERE MAIN_SYSTEM_ID NOT IN (SELECT MAIN_SYSTEM_ID FROM nearest WHERE ORDER_ID IS NOT NULL))",
    ),
)
def _(spark, sf_dir):
    lost = summaries.lost_keys(loans_of(spark, sf_dir), asof_loans(spark, sf_dir, 7).where("ORDER_ID IS NOT NULL"))
    return summaries.present_keys(lost, load_views(spark, sf_dir)["purchases"])


simple(
    "j6_merge_columns",
    "SELECT a.LOAN_ID, a.LOAN_AMOUNT, a.SPENT, b.REPAYMENT_AMOUNT FROM loans a JOIN loans b ON a.LOAN_ID = b.LOAN_ID",
    lambda v: summaries.merge_columns(
        v["loans"].select("LOAN_ID", "LOAN_AMOUNT", "SPENT"), v["loans"].select("LOAN_ID", "SPENT", "REPAYMENT_AMOUNT"), "LOAN_ID"
    ),
)
simple(
    "j9_retailer_children",
    """SELECT r.MAIN_SYSTEM_ID, coalesce(s.n, 0) AS n_sales, coalesce(p.n, 0) AS n_purchases, p.total AS ordered
FROM retailers r LEFT JOIN (SELECT MAIN_SYSTEM_ID, count(*) AS n FROM sales GROUP BY 1) s ON s.MAIN_SYSTEM_ID = r.MAIN_SYSTEM_ID
LEFT JOIN (SELECT MAIN_SYSTEM_ID, count(*) AS n, sum(ORDER_PRICE::VARCHAR::DECIMAL(28,10))::VARCHAR::DOUBLE AS total FROM purchases GROUP BY 1) p ON p.MAIN_SYSTEM_ID = r.MAIN_SYSTEM_ID""",
    lambda v: v["retailers"]
    .join(v["sales"].groupBy(KEY).agg(F.count(F.lit(1)).alias("n_sales")), KEY, "left")
    .join(v["purchases"].groupBy(KEY).agg(F.count(F.lit(1)).alias("n_purchases"), exact_sum(F.col("ORDER_PRICE")).alias("ordered")), KEY, "left")
    .fillna(0, ["n_sales", "n_purchases"]),
    "retailers sales purchases",
)

# --- aggregations --------------------------------------------------------------------------------------------------

simple(
    "a6_delayed_by_retailer",
    """SELECT MAIN_SYSTEM_ID, count(DISTINCT LOAN_ID) AS nunique_loan_id,
count(DISTINCT LOAN_ID) FILTER (WHERE FIRST_TRIAL_BALANCE < 0 AND PAYMENT_STATUS = 'Paid') AS nunique_loan_id_delayed_payment FROM loans GROUP BY 1""",
    lambda v: summaries.delayed_by_retailer(v["loans"]),
)


def collection_stages(loans):
    """Loans as a lender sees them over time: those not repaid at first come again a day and a week later."""
    missed = loans.where("FIRST_TRIAL_BALANCE < 0")
    later = [missed.withColumn("REPAYMENT_UPDATED", F.col("REPAYMENT_UPDATED") + F.lit(timedelta(days=d))) for d in (1, 7)]
    return loans.unionByName(later[0]).unionByName(later[1].where("LOAN_ID % 2 = 0"))


_STAGES = """stages AS (SELECT MAIN_SYSTEM_ID, LOAN_ID, FIRST_TRIAL_BALANCE, REPAYMENT_UPDATED FROM loans
  UNION ALL SELECT MAIN_SYSTEM_ID, LOAN_ID, FIRST_TRIAL_BALANCE, REPAYMENT_UPDATED + INTERVAL 1 DAY FROM loans WHERE FIRST_TRIAL_BALANCE < 0
  UNION ALL SELECT MAIN_SYSTEM_ID, LOAN_ID, FIRST_TRIAL_BALANCE, REPAYMENT_UPDATED + INTERVAL 7 DAY FROM loans WHERE FIRST_TRIAL_BALANCE < 0 AND LOAN_ID % 2 = 0)"""


@query(
    "a7_several_collections",
    with_views(
        "SELECT LOAN_ID, count(DISTINCT REPAYMENT_UPDATED) AS n_updates FROM stages WHERE FIRST_TRIAL_BALANCE < 0 GROUP BY 1 HAVING count(DISTINCT REPAYMENT_UPDATED) > 1",
        _STAGES,
        names="loans",
    ),
)
def _(spark, sf_dir):
    return summaries.several_collections(collection_stages(loans_of(spark, sf_dir))).select("LOAN_ID", "n_updates")


@query(
    "q10_snapshot_check",
    with_views("SELECT MAIN_SYSTEM_ID, LOAN_ID, count(*) AS n FROM stages GROUP BY 1, 2 HAVING count(*) > 1", _STAGES, names="loans"),
)
def _(spark, sf_dir):
    return collection_stages(loans_of(spark, sf_dir)).groupBy(KEY, "LOAN_ID").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


simple("a8_value_counts", 'SELECT PAYMENT_STATUS, count(*) AS "count" FROM loans GROUP BY 1', lambda v: quantiles.value_counts(v["loans"], "PAYMENT_STATUS"))

RATIO_PROBS = [0.01, 0.1, 0.15, 0.20, 0.205, 0.21, 0.215, 0.225]
_RATIO_NAMES = {f"q{str(p).replace('.', '_')}": p for p in RATIO_PROBS}


@query(
    "a9_ratio_quantiles",
    with_views("SELECT " + ", ".join(f"round(quantile_cont(SPENT / nullif(LOAN_AMOUNT, 0), {p}), 9) AS {n}" for n, p in _RATIO_NAMES.items()) + " FROM loans", names="loans"),
)
def _(spark, sf_dir):
    ratios = loans_of(spark, sf_dir).select(shape.spend_ratio().alias("ratio"))
    slices = measure(ratios, [], "ratio", hot_rows=0)
    return quantiles.quantiles(ratios, [], "ratio", _RATIO_NAMES, slices).select(*[F.round(n, 9).alias(n) for n in _RATIO_NAMES])


_BINS = """b AS (SELECT min(x) AS lo, (max(x) - min(x)) / 50 AS w FROM (SELECT SPENT / nullif(LOAN_AMOUNT, 0) AS x FROM loans)),
c AS (SELECT least(floor((SPENT / nullif(LOAN_AMOUNT, 0) - lo) / w), 49)::INTEGER AS bin, count(*) AS n FROM loans, b WHERE LOAN_AMOUNT <> 0 GROUP BY 1),
h AS (SELECT g.bin::INTEGER AS bin, round(lo + g.bin * w, 9) AS lower, round(lo + (g.bin + 1) * w, 9) AS upper, coalesce(n, 0) AS n
  FROM (SELECT unnest(range(50)) AS bin) g CROSS JOIN b LEFT JOIN c ON c.bin = g.bin)"""


@query("a10_histogram", with_views("SELECT * FROM h", _BINS, names="loans"))
def _(spark, sf_dir):
    bins = quantiles.equal_width_bins(loans_of(spark, sf_dir), shape.spend_ratio(), 50)
    return bins.select("bin", F.round("lower", 9).alias("lower"), F.round("upper", 9).alias("upper"), "n")


@query("a10_histogram_cumulative", with_views("SELECT bin, round(sum(n) OVER (ORDER BY bin) / sum(n) OVER (), 9) AS cumulative FROM h", _BINS, names="loans"))
def _(spark, sf_dir):
    bins = quantiles.cumulative_share(quantiles.equal_width_bins(loans_of(spark, sf_dir), shape.spend_ratio(), 50))
    return bins.select("bin", F.round("cumulative", 9).alias("cumulative"))


simple(
    "a11_mean_std",
    "SELECT round(avg(LOAN_AMOUNT), 6) AS mean_loan_amount, round(stddev_samp(LOAN_AMOUNT), 6) AS std_loan_amount, round(avg(SPENT), 6) AS mean_spent, round(stddev_samp(SPENT), 6) AS std_spent FROM loans",
    lambda v: summaries.mean_std(v["loans"], ["LOAN_AMOUNT", "SPENT"]).select(
        *[F.round(c, 6).alias(c.lower()) for c in ("mean_LOAN_AMOUNT", "std_LOAN_AMOUNT", "mean_SPENT", "std_SPENT")]
    ),
)


@query(
    "a13_column_info",
    _asof_sql(
        "SELECT 'LOAN_ID' AS \"column\", 'bigint' AS type, count(LOAN_ID) AS non_null FROM nearest "
        "UNION ALL SELECT 'MAIN_SYSTEM_ID', 'bigint', count(MAIN_SYSTEM_ID) FROM nearest "
        "UNION ALL SELECT 'LOAN_ISSUANCE_DATE', 'timestamp_ntz', count(LOAN_ISSUANCE_DATE) FROM nearest "
        "UNION ALL SELECT 'ORDER_ID', 'bigint', count(ORDER_ID) FROM nearest "
        "UNION ALL SELECT 'ORDER_CREATION_DATE', 'timestamp_ntz', count(ORDER_CREATION_DATE) FROM nearest "
        "UNION ALL SELECT 'ORDER_PRICE', 'double', count(ORDER_PRICE) FROM nearest",
        7,
    ),
)
def _(spark, sf_dir):
    return summaries.column_info(asof_loans(spark, sf_dir, 7))


_CLOSE = "abs(({a}) - ({b})) <= 0.1::DOUBLE + 0.1::DOUBLE * abs({b})"
simple(
    "a14_identity_outstanding",
    f"SELECT {_CLOSE.format(a='FIRST_TRIAL_BALANCE + REPAYMENT_AMOUNT', b='CUMMULATIVE_OUTSTANDING')} AS \"match\", count(*) AS n FROM loans GROUP BY 1",
    lambda v: summaries.match_rate(v["loans"], F.col("FIRST_TRIAL_BALANCE") + F.col("REPAYMENT_AMOUNT"), F.col("CUMMULATIVE_OUTSTANDING")),
)
simple(
    "q7_identity_discount",
    f"SELECT {_CLOSE.format(a='ORDER_PRICE - DISCOUNT', b='ORDER_PRICE_AFTER_DISCOUNT')} AS \"match\", count(*) AS n FROM purchases GROUP BY 1",
    lambda v: summaries.match_rate(v["purchases"], F.col("ORDER_PRICE") - F.col("DISCOUNT"), F.col("ORDER_PRICE_AFTER_DISCOUNT")),
    "purchases",
)
simple(
    "f9_close_spent_amount",
    f"SELECT {_CLOSE.format(a='SPENT', b='LOAN_AMOUNT')} AS \"match\", count(*) AS n FROM loans GROUP BY 1",
    lambda v: summaries.match_rate(v["loans"], F.col("SPENT"), F.col("LOAN_AMOUNT")),
)
simple(
    "a15_share_above",
    "SELECT round(avg(CASE WHEN LOAN_AMOUNT > 60.0 THEN 1.0 ELSE 0.0 END), 9) AS share FROM loans",
    lambda v: summaries.share_above(v["loans"], "LOAN_AMOUNT", F.lit(60.0)).select(F.round("share", 9).alias("share")),
)

# --- sort, limit, sets ---------------------------------------------------------------------------------------------

simple("o1_order_by_time", "SELECT LOAN_ID, LOAN_ISSUANCE_DATE FROM loans ORDER BY LOAN_ISSUANCE_DATE, LOAN_ID", lambda v: v["loans"].select("LOAN_ID", "LOAN_ISSUANCE_DATE").orderBy("LOAN_ISSUANCE_DATE", "LOAN_ID"))
simple(
    "o2_top_delayed",
    """SELECT MAIN_SYSTEM_ID, count(DISTINCT LOAN_ID) AS nunique_loan_id,
count(DISTINCT LOAN_ID) FILTER (WHERE FIRST_TRIAL_BALANCE < 0 AND PAYMENT_STATUS = 'Paid') AS nunique_loan_id_delayed_payment
FROM loans GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 5""",
    lambda v: summaries.top_delayed(v["loans"], 5),
)
simple(
    "o3_first_loans",
    "SELECT MAIN_SYSTEM_ID, LOAN_ID FROM loans QUALIFY row_number() OVER (PARTITION BY MAIN_SYSTEM_ID ORDER BY LOAN_ISSUANCE_DATE, LOAN_ID) <= 3",
    lambda v: shape.first_per_key(v["loans"].select(KEY, "LOAN_ID", "LOAN_ISSUANCE_DATE"), KEY, ["LOAN_ISSUANCE_DATE", "LOAN_ID"], 3).select(KEY, "LOAN_ID"),
)
simple(
    "o5_union_events",
    """SELECT MAIN_SYSTEM_ID, moment, kind, count(*) AS n FROM (SELECT MAIN_SYSTEM_ID, LOAN_ISSUANCE_DATE AS moment, 'loan' AS kind FROM loans
UNION ALL SELECT MAIN_SYSTEM_ID, ORDER_CREATION_DATE, 'order' FROM purchases) GROUP BY ALL""",
    lambda v: v["loans"]
    .select(KEY, F.col("LOAN_ISSUANCE_DATE").alias("moment"), F.lit("loan").alias("kind"))
    .unionByName(v["purchases"].select(KEY, F.col("ORDER_CREATION_DATE").alias("moment"), F.lit("order").alias("kind")))
    .groupBy(KEY, "moment", "kind")
    .agg(F.count(F.lit(1)).alias("n")),
    "loans purchases",
)
simple(
    "o6_key_difference",
    "SELECT MAIN_SYSTEM_ID FROM loans EXCEPT SELECT MAIN_SYSTEM_ID FROM purchases",
    lambda v: summaries.lost_keys(v["loans"], v["purchases"]),
    "loans purchases",
)

# --- scalar functions ----------------------------------------------------------------------------------------------

simple(
    "f_scalars",
    """SELECT LOAN_ID, lower(PAYMENT_STATUS) AS f1_lower, abs(FIRST_TRIAL_BALANCE) AS f2_abs, date_trunc('week', LOAN_ISSUANCE_DATE)::TIMESTAMP AS f3_week,
strptime(strftime(LOAN_ISSUANCE_DATE, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS f4_timestamp, CAST(FIRST_TRIAL_BALANCE < 0 AS INTEGER) AS f5_flag,
printf('%.2f', LOAN_AMOUNT) AS f6_text, LOAN_AMOUNT - SPENT > 0 AND PAYMENT_STATUS <> 'Paid' AS f7_logic,
LOAN_ISSUANCE_DATE - INTERVAL 7 DAY AS f8_earlier, [LOAN_AMOUNT, SPENT][2] AS f11_element, CASE WHEN FIRST_TRAIL_DELAYS > 0 THEN 1 ELSE 0 END AS f12_flag FROM loans""",
    lambda v: v["loans"].select(
        "LOAN_ID",
        F.lower("PAYMENT_STATUS").alias("f1_lower"),
        F.abs("FIRST_TRIAL_BALANCE").alias("f2_abs"),
        F.date_trunc("week", "LOAN_ISSUANCE_DATE").cast("timestamp_ntz").alias("f3_week"),
        F.to_timestamp_ntz(F.date_format("LOAN_ISSUANCE_DATE", "yyyy-MM-dd HH:mm:ss"), F.lit("yyyy-MM-dd HH:mm:ss")).alias("f4_timestamp"),
        (F.col("FIRST_TRIAL_BALANCE") < 0).cast("int").alias("f5_flag"),
        F.format_string("%.2f", "LOAN_AMOUNT").alias("f6_text"),
        ((F.col("LOAN_AMOUNT") - F.col("SPENT") > 0) & (F.col("PAYMENT_STATUS") != "Paid")).alias("f7_logic"),
        (F.col("LOAN_ISSUANCE_DATE") - F.lit(timedelta(days=7))).alias("f8_earlier"),
        F.array("LOAN_AMOUNT", "SPENT").getItem(1).alias("f11_element"),
        flag(F.col("FIRST_TRAIL_DELAYS") > 0).alias("f12_flag"),
    ),
)

# --- profiles ------------------------------------------------------------------------------------------------------

simple(
    "q1_table_overview",
    """SELECT count(*) AS n_rows, 3 AS n_columns, sum((MAIN_SYSTEM_ID IS NULL)::BIGINT + (PAYMENT_STATUS IS NULL)::BIGINT + (FIRST_TRAIL_DELAYS IS NULL)::BIGINT)::BIGINT AS missing_cells,
count(*) - (SELECT count(*) FROM (SELECT DISTINCT MAIN_SYSTEM_ID, PAYMENT_STATUS, FIRST_TRAIL_DELAYS FROM loans)) AS duplicate_rows FROM loans""",
    lambda v: profiling.profile_table(v["loans"].select(KEY, "PAYMENT_STATUS", "FIRST_TRAIL_DELAYS")),
)

TABLES = {"loans": LOANS, "sales": SALES, "purchases": PURCHASES}
for _name, _schema in TABLES.items():
    _missing = " + ".join(f"({c} IS NULL)::BIGINT" for c in _schema.names)
    simple(
        f"q1_whole_{_name}",
        f"SELECT count(*) AS n_rows, {len(_schema.names)} AS n_columns, sum({_missing})::BIGINT AS missing_cells, "
        f"count(*) - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(_schema.names)} FROM {_name})) AS duplicate_rows FROM {_name}",
        lambda v, n=_name, s=_schema: profiling.profile_table(v[n].select(*s.names)),
        _name,
    )


def _of_kind(schema, *kinds):
    return [f.name for f in schema.fields if isinstance(f.dataType, kinds)]


def _union(name, columns, facts):
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {facts.format(c=c)} FROM {name}" for c in columns)


for _name, _schema in TABLES.items():
    _times, _texts, _numbers = _of_kind(_schema, T.TimestampNTZType), _of_kind(_schema, T.StringType), _of_kind(_schema, T.NumericType)
    simple(
        f"q3_times_{_name}",
        _union(_name, _times, 'count(DISTINCT {c}) AS "distinct", count(*) - count({c}) AS missing, min({c}) AS "first", max({c}) AS "last"'),
        lambda v, n=_name, c=_times: profiling.profile_time(v[n], c),
        _name,
    )
    if _texts:
        simple(
            f"q3_texts_{_name}",
            _union(_name, _texts, 'count(DISTINCT {c}) AS "distinct", count(*) - count({c}) AS missing, min(length({c})) AS shortest, max(length({c})) AS longest'),
            lambda v, n=_name, c=_texts: profiling.profile_text(v[n], c),
            _name,
        )
    simple(
        f"q2_numbers_{_name}",
        _union(
            _name,
            _numbers,
            "count({c}) AS n, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS \"distinct\", round(avg({c}), 4) AS mean, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, "
            "count(*) FILTER (WHERE {c} = 0) AS zeros, count(*) FILTER (WHERE {c} < 0) AS negatives, round(quantile_cont({c}::DOUBLE, 0.5), 4) AS p50",
        ),
        lambda v, n=_name, c=_numbers: profiling.profile_numeric(v[n].select(*c)).select(
            "column", "n", "missing", "distinct", F.round("mean", 4).alias("mean"), "min", "max", "zeros", "negatives", F.round("p50", 4).alias("p50")
        ),
        _name,
    )
    _couples = [(a, b) for i, a in enumerate(_numbers) for b in _numbers[i + 1 :]]
    simple(
        f"q5_pairs_{_name}",
        "SELECT a, b, round(corr, 5) AS corr FROM ("
        + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, CASE WHEN min({a}) < max({a}) AND min({b}) < max({b}) THEN corr({a}::DOUBLE, {b}::DOUBLE) END AS corr FROM {_name}" for a, b in _couples)
        + ")",
        lambda v, n=_name, c=_numbers: profiling.correlation_pairs(v[n], c).withColumn("corr", F.round("corr", 5)),
        _name,
    )

PROFILED = ["LOAN_AMOUNT", "SPENT", "FIRST_TRIAL_BALANCE", "REPAYMENT_AMOUNT", "INITIAL_COST"]
_LONG = "x AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c}::DOUBLE AS value FROM loans" for c in PROFILED) + ")"


@query(
    "q2_numeric_profile",
    with_views(
        """SELECT "column", count(value) AS n, count(*) FILTER (WHERE value IS NULL) AS missing, count(DISTINCT value) AS "distinct",
round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min, max(value) AS max,
count(*) FILTER (WHERE value = 0) AS zeros, count(*) FILTER (WHERE value < 0) AS negatives, """
        + ", ".join(f"round(quantile_cont(value, {p}), 6) AS {n}" for n, p in profiling.QUANTILES.items())
        + ", round(CASE WHEN min(value) < max(value) THEN skewness(value) * (count(value) - 2) / sqrt(count(value) * (count(value) - 1.0)) END, 6) AS skewness,"
        + " round(CASE WHEN min(value) < max(value) THEN kurtosis_pop(value) END, 6) AS kurtosis"
        + ' FROM x GROUP BY "column"',
        _LONG,
        names="loans",
    ),
)
def _(spark, sf_dir):
    p = profiling.profile_numeric(loans_of(spark, sf_dir).select(*PROFILED))
    rounded = ["mean", "std", "skewness", "kurtosis", *profiling.QUANTILES]
    return p.select(*[F.round(F.nanvl(c, F.lit(None)), 6).alias(c) if c in rounded else c for c in p.columns])


simple(
    "q3_text_profile",
    """SELECT 'PAYMENT_STATUS' AS "column", count(DISTINCT PAYMENT_STATUS) AS "distinct", count(*) - count(PAYMENT_STATUS) AS missing,
min(length(PAYMENT_STATUS)) AS shortest, max(length(PAYMENT_STATUS)) AS longest FROM loans""",
    lambda v: profiling.profile_text(v["loans"], ["PAYMENT_STATUS"]),
)
simple(
    "q3_time_profile",
    """SELECT 'LOAN_ISSUANCE_DATE' AS "column", count(DISTINCT LOAN_ISSUANCE_DATE) AS "distinct", count(*) - count(LOAN_ISSUANCE_DATE) AS missing,
min(LOAN_ISSUANCE_DATE) AS "first", max(LOAN_ISSUANCE_DATE) AS "last" FROM loans
UNION ALL SELECT 'INITIAL_DATE', count(DISTINCT INITIAL_DATE), count(*) - count(INITIAL_DATE), min(INITIAL_DATE), max(INITIAL_DATE) FROM loans""",
    lambda v: profiling.profile_time(v["loans"], ["LOAN_ISSUANCE_DATE", "INITIAL_DATE"]),
)
simple(
    "q3_most_common",
    """SELECT * FROM (SELECT "column", value, n, (row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value))::INTEGER AS place FROM
(SELECT 'STATUS' AS "column", STATUS AS value, count(*) AS n FROM sales GROUP BY STATUS
 UNION ALL SELECT 'MAIN_SYSTEM_ID', MAIN_SYSTEM_ID::VARCHAR, count(*) FROM sales GROUP BY MAIN_SYSTEM_ID)) WHERE place <= 5""",
    lambda v: profiling.most_common(v["sales"], ["STATUS", KEY], 5),
    "sales",
)


@query(
    "q4_column_histograms",
    with_views(
        """SELECT "column", least(floor((value - lo) / nullif((hi - lo) / 20, 0)), 19)::INTEGER AS bin, count(*) AS n
FROM x JOIN (SELECT "column", min(value) AS lo, max(value) AS hi FROM x GROUP BY 1) b USING ("column") WHERE hi > lo GROUP BY 1, 2
UNION ALL SELECT "column", 0, count(*) FROM x GROUP BY 1 HAVING min(value) = max(value)""",
        _LONG,
        names="loans",
    ),
)
def _(spark, sf_dir):
    return profiling.column_histograms(loans_of(spark, sf_dir), PROFILED, 20)


_PAIRS = [(a, b) for i, a in enumerate(PROFILED) for b in PROFILED[i + 1 :]]


@query(
    "q5_correlations",
    with_views(
        " UNION ALL ".join(
            f"SELECT '{a}' AS a, '{b}' AS b, round(CASE WHEN stddev_samp({a}) > 0 AND stddev_samp({b}) > 0 THEN corr({a}, {b}) END, 6) AS corr FROM loans" for a, b in _PAIRS
        ),
        names="loans",
    ),
)
def _(spark, sf_dir):
    return profiling.correlation_pairs(loans_of(spark, sf_dir), PROFILED).withColumn("corr", F.round("corr", 6))


_ALERTED = ["LOAN_ID", "LOAN_AMOUNT", "TOTAL_INITIAL_AMOUNT", "SPENT", "INITIAL_COST", "REPAYMENT_AMOUNT"]
_ALERT_LONG = "x AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c}::DOUBLE AS value FROM loans" for c in _ALERTED) + ")"


@query(
    "q6_alerts",
    with_views(
        """SELECT "column", 'constant' AS alert FROM x GROUP BY 1 HAVING count(DISTINCT value) = 1
UNION ALL SELECT "column", 'unique' FROM x GROUP BY 1 HAVING count(DISTINCT value) = count(value) AND count(value) > 1
UNION ALL SELECT "column", 'missing' FROM x GROUP BY 1 HAVING (count(*) - count(value)) / count(*) >= 0.25
UNION ALL SELECT "column", 'zeros' FROM x GROUP BY 1 HAVING count(*) FILTER (WHERE value = 0) / count(*) >= 0.25
UNION ALL """
        + " UNION ALL ".join(
            f"SELECT '{b}', 'correlated with {a}' FROM loans HAVING stddev_samp({a}) > 0 AND stddev_samp({b}) > 0 AND abs(corr({a}, {b})) >= 0.95"
            for i, a in enumerate(_ALERTED)
            for b in _ALERTED[i + 1 :]
        ),
        _ALERT_LONG,
        names="loans",
    ),
)
def _(spark, sf_dir):
    return profiling.alerts(loans_of(spark, sf_dir), _ALERTED)


simple(
    "q8_activity",
    """SELECT MAIN_SYSTEM_ID, date_trunc('day', CREATED_AT)::TIMESTAMP AS bin, count(*) AS n FROM sales
WHERE MAIN_SYSTEM_ID IN (SELECT MAIN_SYSTEM_ID FROM sales GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10) GROUP BY 1, 2""",
    lambda v: profiling.activity(v["sales"], KEY, "CREATED_AT", "day", 10),
    "sales",
)


@query(
    "q9_spend_reconstruction",
    with_views(
        """SELECT l.LOAN_ID, any_value(l.SPENT) AS SPENT, coalesce(sum(p.ORDER_PRICE::VARCHAR::DECIMAL(28,10)), 0)::VARCHAR::DOUBLE AS ordered, count(p.ORDER_ID) AS n_orders
FROM loans l LEFT JOIN purchases p ON p.MAIN_SYSTEM_ID = l.MAIN_SYSTEM_ID AND p.ORDER_CREATION_DATE BETWEEN l.LOAN_ISSUANCE_DATE AND l.INITIAL_DATE GROUP BY 1""",
        names="loans purchases",
    ),
)
def _(spark, sf_dir):
    v = load_views(spark, sf_dir)
    return profiling.spend_reconstruction(v["loans"], v["purchases"], risk.heavy_retailers(v["loans"], v["purchases"]))


@query(
    "q11_order_before_loan",
    _asof_sql("SELECT ORDER_ID IS NOT NULL AS has_recent_order, count(*) AS n FROM nearest GROUP BY 1", 14),
)
def _(spark, sf_dir):
    joined = asof_loans(spark, sf_dir, 14)
    return joined.groupBy(F.col("ORDER_ID").isNotNull().alias("has_recent_order")).agg(F.count(F.lit(1)).alias("n"))


@query("io4_parquet_scan", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01' GROUP BY 1")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp_ntz"))
    return rows.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
