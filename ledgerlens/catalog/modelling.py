"""Feature selection and reduction, models and their evaluation."""

from __future__ import annotations

from functools import partial

from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ledgerlens.catalog.lending import _rolled
from ledgerlens.catalog.registry import query
from ledgerlens.catalog.synthesis import _CALENDAR, _unary_sql
from ledgerlens.catalog.views_sql import with_views
from ledgerlens.operators import features as ft
from ledgerlens.operators import reduction, selection, shape
from ledgerlens.plans import feature_frame, model, reports, risk, split
from ledgerlens.schemas import KEY
from ledgerlens.session import materialise
from ledgerlens.sources.adapters import load_views

IDS = ["LOAN_ID", KEY]
COLUMNS = ["LOAN_AMOUNT", "TOTAL_INITIAL_AMOUNT", "INITIAL_COST", "m7", "s7", "m30", "s30", "nothing"]


def volume_frame(spark, sf_dir):
    """Loans with 7 and 30 day volume, unmatched ones included, plus a constant and an empty column."""
    v = load_views(spark, sf_dir)
    loans = v["loans"].select(*IDS, "LOAN_ISSUANCE_DATE", "LOAN_AMOUNT", "TOTAL_INITIAL_AMOUNT", "INITIAL_COST")
    joined = risk.with_volume(loans, v["purchases"], [7, 30], 7, strict=False, slices=risk.heavy_retailers(loans, v["purchases"]))
    named = [F.col(f"ROLLING{k}_{d}DAYS__ORDER_PRICE__").alias(f"{a}{d}") for d in (7, 30) for k, a in (("MEAN", "m"), ("STDDEV", "s"))]
    return joined.select(*IDS, "LOAN_AMOUNT", "TOTAL_INITIAL_AMOUNT", "INITIAL_COST", *named, F.lit(None).cast("double").alias("nothing"))


FRAME_SQL = [
    f"volume AS (SELECT MAIN_SYSTEM_ID, ORDER_ID, ORDER_CREATION_DATE, ORDER_PRICE, {_rolled(7)}, {_rolled(30)} FROM purchases)",
    "f AS (SELECT l.LOAN_ID, l.MAIN_SYSTEM_ID, l.LOAN_AMOUNT, l.TOTAL_INITIAL_AMOUNT, l.INITIAL_COST, NULL::DOUBLE AS nothing, "
    + ", ".join(
        f"CASE WHEN v.ORDER_CREATION_DATE >= l.LOAN_ISSUANCE_DATE - INTERVAL 7 DAY THEN v.ROLLING{k}_{d}DAYS__ORDER_PRICE__ END AS {a}{d}"
        for d in (7, 30)
        for k, a in (("MEAN", "m"), ("STDDEV", "s"))
    )
    + " FROM loans l ASOF LEFT JOIN volume v ON l.MAIN_SYSTEM_ID = v.MAIN_SYSTEM_ID AND l.LOAN_ISSUANCE_DATE >= v.ORDER_CREATION_DATE)",
]


def frame_sql(select: str) -> str:
    return with_views(select, *FRAME_SQL, names="loans purchases")


def _report_sql(c: str) -> str:
    return f"""SELECT '{c}' AS "column", count(*) AS rows, count({c}) AS non_null, round(1 - count({c}) / count(*), 9) AS null_share, coalesce(min({c}) = max({c}), false) AS constant,
1 - count({c}) / count(*) >= 0.25 AS highly_null, count({c}) = 0 OR (min({c}) = max({c}) AND count({c}) = count(*)) AS low_information, count({c}) = 0 OR min({c}) = max({c}) AS single_value FROM f"""


@query("s1_s2_s3_removal_report", frame_sql(" UNION ALL ".join(map(_report_sql, COLUMNS))))
def _(spark, sf_dir):
    report = selection.removal_report(selection.column_facts(volume_frame(spark, sf_dir), COLUMNS))
    return report.withColumn("null_share", F.round("null_share", 9))


PAIRED = ["LOAN_AMOUNT", "TOTAL_INITIAL_AMOUNT", "m7", "s7", "m30", "s30"]


@query(
    "s4_correlation_matrix",
    frame_sql(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM f" for i, a in enumerate(PAIRED) for b in PAIRED[i + 1 :])),
)
def _(spark, sf_dir):
    corr = selection.correlation_matrix(volume_frame(spark, sf_dir), PAIRED)
    rows = [(a, PAIRED[j], float(corr[i, j])) for i, a in enumerate(PAIRED) for j in range(i + 1, len(PAIRED))]
    return spark.createDataFrame(rows, "a string, b string, corr double").withColumn("corr", F.round("corr", 6))


@query(
    "s4_select_features",
    frame_sql(
        """SELECT c AS "column", c NOT IN ('TOTAL_INITIAL_AMOUNT', 'INITIAL_COST', 'nothing') AND NOT high AS kept,
CASE WHEN c = 'nothing' OR high THEN 'highly_null' WHEN c = 'INITIAL_COST' THEN 'low_information' WHEN c = 'TOTAL_INITIAL_AMOUNT' THEN 'highly_correlated' END AS reason FROM ("""
        + " UNION ALL ".join(f"SELECT '{c}' AS c, 1 - count({c}) / count(*) >= 0.25 AS high FROM f" for c in COLUMNS)
        + ")"
    ),
)
def _(spark, sf_dir):
    return selection.select_features(volume_frame(spark, sf_dir), IDS)[1]


@query(
    "s6_impute_means",
    frame_sql("SELECT LOAN_ID, round(coalesce(m7, avg(m7) OVER ()), 6) AS m7_imputed, round(coalesce(s30, avg(s30) OVER ()), 6) AS s30_imputed FROM f"),
)
def _(spark, sf_dir):
    rows = volume_frame(spark, sf_dir).select("LOAN_ID", "m7", "s30")
    filled = Imputer(inputCols=["m7", "s30"], outputCols=["m7_imputed", "s30_imputed"]).fit(rows).transform(rows)
    return filled.select("LOAN_ID", F.round("m7_imputed", 6).alias("m7_imputed"), F.round("s30_imputed", 6).alias("s30_imputed"))


@query(
    "s10_low_signal",
    with_views(
        """SELECT "column", signal FROM (SELECT "column", CASE WHEN count(DISTINCT v) = 1 THEN 'constant' WHEN count(DISTINCT v) = count(v) THEN 'identifier' END AS signal FROM
(UNPIVOT (SELECT LOAN_ID::VARCHAR AS LOAN_ID, "INDEX"::VARCHAR AS "INDEX", INITIAL_COST::VARCHAR AS INITIAL_COST, FINAL_COST::VARCHAR AS FINAL_COST, MAIN_SYSTEM_ID::VARCHAR AS MAIN_SYSTEM_ID, PAYMENT_STATUS FROM loans)
ON LOAN_ID, "INDEX", INITIAL_COST, FINAL_COST, MAIN_SYSTEM_ID, PAYMENT_STATUS INTO NAME "column" VALUE v) GROUP BY 1) WHERE signal IS NOT NULL""",
        names="loans",
    ),
)
def _(spark, sf_dir):
    return selection.low_signal(load_views(spark, sf_dir)["loans"], ["LOAN_ID", "INDEX", "INITIAL_COST", "FINAL_COST", KEY, "PAYMENT_STATUS"])


_PURCHASES = ["ORDER_PRICE", "DISCOUNT", "ORDER_PRICE_AFTER_DISCOUNT"]
_SALES = ["AMOUNT", "FEES", "RETAILER_CUT", "TOTAL_AMOUNT_INCLUDING_TAX", "TOTAL_AMOUNT_PAID", "WALLET_BALANCE_BEFORE_TRANSACTION"]


def _pit_sql(prefix, child, alias, time, ident, cols, late, upto="<="):
    """SQL of the point-in-time aggregates of one child table, by joining each loan with its whole history."""
    parts = [f"count({alias}.{ident}) AS {prefix}count"]
    for c in cols:
        known = f"FILTER (WHERE {alias}.{late[c]} <= l.LOAN_ISSUANCE_DATE)" if c in late else ""
        x, moment = f"{alias}.{c}", f"{alias}.{late.get(c, time)}"
        total = f"(sum({x}::VARCHAR::DECIMAL(28,10)) {known})::VARCHAR::DOUBLE"
        parts += [
            f"{total} AS {prefix}sum_{c}",
            f"{total} / nullif(count({x}) {known}, 0) AS {prefix}mean_{c}",
            f"round(stddev_samp({x}) {known}, 5) AS {prefix}std_{c}",
            f"(min({x}) {known})::DOUBLE AS {prefix}min_{c}",
            f"(max({x}) {known})::DOUBLE AS {prefix}max_{c}",
            f"(arg_max({x}, ({moment}, {alias}.{ident})) {known})::DOUBLE AS {prefix}last_{c}",
        ]
    if child == "sales":
        parts.append(f"count(DISTINCT {alias}.STATUS) FILTER (WHERE {alias}.UPDATED_AT <= l.LOAN_ISSUANCE_DATE) AS {prefix}num_unique_STATUS")
    return f"""{child}_pit AS (SELECT l.LOAN_ID, {', '.join(parts)} FROM loans l
LEFT JOIN {child} {alias} ON {alias}.MAIN_SYSTEM_ID = l.MAIN_SYSTEM_ID AND {alias}.{time} {upto} l.LOAN_ISSUANCE_DATE GROUP BY 1)"""


_A, _B, _L = "LOAN_AMOUNT", "TOTAL_INITIAL_AMOUNT", "LOAN_ISSUANCE_DATE"
_W = "PARTITION BY MAIN_SYSTEM_ID ORDER BY LOAN_ISSUANCE_DATE, LOAN_ID"
_LOAN_FEATURES = [
    "LOAN_ID, MAIN_SYSTEM_ID, LOAN_AMOUNT, TOTAL_INITIAL_AMOUNT",
    *[f"{e} AS {n}_{_L}" for n, e in _CALENDAR.items()],
    *[_unary_sql(c) for c in (_A, _B)],
    f"""{_A} + {_B} AS {_A}_add_{_B}, {_A} - {_B} AS {_A}_sub_{_B}, round({_A} * {_B}, 6) AS {_A}_mul_{_B}, {_A} / nullif({_B}, 0) AS {_A}_div_{_B}, {_A} % nullif({_B}, 0) AS {_A}_mod_{_B},
{_A} > {_B} AS {_A}_gt_{_B}, {_A} >= {_B} AS {_A}_ge_{_B}, {_A} = {_B} AS {_A}_eq_{_B}, {_A} <> {_B} AS {_A}_ne_{_B}""",
    f"(epoch_us(INITIAL_DATE) - epoch_us({_L})) / 1e6 AS time_since_{_L}",
    f"round(CASE WHEN {_A} + {_B} > 0 THEN ln({_A} + {_B}) END, 9) AS log_{_A}_add_{_B}, round(CASE WHEN {_A} * {_B} >= 0 THEN sqrt({_A} * {_B}) END, 9) AS sqrt_{_A}_mul_{_B}",
    f"""(sum({_A}::VARCHAR::DECIMAL(28,10)) OVER c)::VARCHAR::DOUBLE AS cum_sum_{_A}, count({_A}) OVER c AS cum_count_{_A}, (sum({_A}::VARCHAR::DECIMAL(28,10)) OVER c)::VARCHAR::DOUBLE / count({_A}) OVER c AS cum_mean_{_A},
min({_A}) OVER c AS cum_min_{_A}, max({_A}) OVER c AS cum_max_{_A}, round(stddev_samp({_A}) OVER c, 5) AS expanding_std_{_A}""",
    f"""lag({_A}) OVER w AS lag_{_A}, {_A} - lag({_A}) OVER w AS diff_{_A},
round(({_A} - lag({_A}) OVER w) / nullif((epoch_us({_L}) - epoch_us(lag({_L}) OVER w)) / 1e6, 0), 6) AS rate_{_A}, {_A} = lag({_A}) OVER w AS same_{_A},
(epoch_us({_L}) - epoch_us(lag({_L}) OVER w)) / 1e6 AS time_since_previous_{_A}""",
    f"""count({_A}) OVER t AS roll_count_{_A}, round(avg({_A}) OVER t, 5) AS roll_mean_{_A}, round(stddev_samp({_A}) OVER t, 5) AS roll_std_{_A}, min({_A}) OVER t AS roll_min_{_A}, max({_A}) OVER t AS roll_max_{_A}""",
]


_EARLIER = _pit_sql("loans_", "loans", "e", "LOAN_ISSUANCE_DATE", "LOAN_ID", [_A, _B], {}, "<")


@query("d6_loans_child", with_views("SELECT * FROM loans_pit", _EARLIER, names="loans"))
def _(spark, sf_dir):
    """Each loan with figures of its retailer's earlier loans."""
    es = feature_frame.entity_set(load_views(spark, sf_dir))
    loans = es.entities["loans"]
    out = ft.point_in_time(loans.df, loans, KEY, loans.numeric(), prefix="loans_", strict=True)
    return out.select(*[F.round(c, 5).alias(c) if "_std_" in c else c for c in out.columns])


@query(
    "d15_feature_frame_issuance",
    with_views(
        "SELECT * FROM own JOIN loans_pit USING (LOAN_ID) JOIN sales_pit USING (LOAN_ID) JOIN purchases_pit USING (LOAN_ID)",
        f"own AS (SELECT {', '.join(_LOAN_FEATURES)} FROM loans WINDOW w AS ({_W}), c AS ({_W} ROWS UNBOUNDED PRECEDING), t AS ({_W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))",
        _EARLIER,
        _pit_sql("sales_", "sales", "s", "CREATED_AT", "ID", _SALES, {"TOTAL_AMOUNT_PAID": "UPDATED_AT"}),
        _pit_sql("purchases_", "purchases", "p", "ORDER_CREATION_DATE", "ORDER_ID", _PURCHASES, {}),
        names="loans sales purchases",
    ),
)
def _(spark, sf_dir):
    frame = feature_frame.build_feature_frame(load_views(spark, sf_dir))[0]
    digits = {"std": 5, "expanding": 5, "roll": 5, "tangent": 5, "rate": 6, "log": 9, "sqrt": 9, "sine": 9, "cosine": 9}

    def shown(name):
        if name.endswith(("_mul_" + _B,)) and not name.startswith("sqrt"):
            return 6
        parts = name.removeprefix("sales_").removeprefix("purchases_").removeprefix("loans_").split("_")
        return None if parts[0] == "roll" and parts[1] not in ("mean", "std") else digits.get(parts[0])

    kinds = dict(frame.dtypes)
    return frame.select(*[F.round(c, shown(c)).alias(c) if kinds[c] == "double" and shown(c) else c for c in frame.columns])


@query(
    "d14_frame_merge",
    with_views(
        f"""SELECT l.LOAN_ID, l.{_A}, l.{_A} + l.{_B} AS {_A}_add_{_B}, abs(l.{_A}) AS absolute_{_A}, coalesce(p.n, 0) AS purchases_count FROM loans l
LEFT JOIN (SELECT l.LOAN_ID, count(*) AS n FROM loans l JOIN purchases p ON p.MAIN_SYSTEM_ID = l.MAIN_SYSTEM_ID AND p.ORDER_CREATION_DATE <= l.LOAN_ISSUANCE_DATE GROUP BY 1) p ON p.LOAN_ID = l.LOAN_ID""",
        names="loans purchases",
    ),
)
def _(spark, sf_dir):
    v = load_views(spark, sf_dir)
    loans = v["loans"].select("LOAN_ID", KEY, _L, _A, _B)
    own = [f for f in ft.pair_features([_A, _B]) + ft.unary_features([_A]) if f.params in ("add", "absolute")]
    history = ft.point_in_time(loans, ft.Entity(v["purchases"], "ORDER_ID", "ORDER_CREATION_DATE"), KEY, [], prefix="purchases_")
    left = ft.dfs_transform(loans, own).select("LOAN_ID", _A, *[f.name for f in own])
    right = loans.select("LOAN_ID", _A).join(history, "LOAN_ID")
    known = [ft.Feature("purchases_count", "point_in_time", ("purchases",), "count", F.col("purchases_count"))]
    return ft.merge_frames(left, right, ft.feature_defs(spark, own), ft.feature_defs(spark, known), "LOAN_ID")[0]


@query("d15_feature_frame_history")
def _(spark, sf_dir):
    return feature_frame.build_feature_frame(load_views(spark, sf_dir), cutoff=None, with_series=True)[0]


def reduced(spark, sf_dir):
    frame = materialise(feature_frame.build_feature_frame(load_views(spark, sf_dir))[0])
    chosen = selection.select_features(frame, IDS)[0]
    return selection.reduce_features(chosen, IDS, standardise=True)


@query("s9_reduced_features")
def _(spark, sf_dir):
    return reduced(spark, sf_dir)[0].select(*IDS, vector_to_array("pca_features").alias("pca_features"))


@query("m4_flat_split")
def _(spark, sf_dir):
    frame, fitted = reduced(spark, sf_dir)
    label = shape.make_label(load_views(spark, sf_dir)["loans"], "LOAN_NOT_PAID")
    parted = split.stratified_time_split(materialise(frame.join(label, "LOAN_ID")))
    return split.flat_layout(split.test_rows(parted), "pca_features", fitted.stages[-1].getK())


ASIDE = ["label"]


def labelled_frame(spark, sf_dir, target, parted):
    """Every column of the issuance frame with the label and its part by ``parted``, in a table that all fits read. Parts depend on
    ids and labels only, so these are ranked before the wide rows are joined to them, which are written once."""
    v = load_views(spark, sf_dir)
    label = materialise(shape.make_label(v["loans"], target).select("LOAN_ID", F.col("label").cast("double").alias("label")))
    return materialise(feature_frame.build_feature_frame(v)[0].join(materialise(parted(label.where("LOAN_ID IS NOT NULL"))), "LOAN_ID"))


@query("m5_m6_classifier_scores")
def _(spark, sf_dir):
    """Frame, split by time, reduction learned from the training part alone, boosting that stops on the validation part."""
    aside = ["label", "stratified_split", "split", "is_validation"]
    parted = labelled_frame(spark, sf_dir, "LOAN_NOT_PAID", split.stratified_time_split)
    learned = reduction.fit(parted.where("split = 'train'").drop(*aside), IDS)
    rows = materialise(learned.apply(parted, *aside))
    booster = model.fit_classifier(split.train_rows(rows))
    return booster.transform(split.test_rows(rows)).select("LOAN_ID", "label", "prediction", vector_to_array("probability")[1].alias("probability"))


@query("m9_regression_search")
def _(spark, sf_dir):
    """Forward-chained folds, each with a reduction of its own."""
    aside = ["label", "stratified_split", "fold"]
    folded = labelled_frame(spark, sf_dir, "SPENT", split.time_folds)
    return model.forward_search(model.reduced_folds(folded, IDS, aside, 5), model.grid())[1]


@query("r5_weekly_conservative_model")
def _(spark, sf_dir):
    """The whole chain: features, selection and reduction and a forest from the earlier loans, scores of the later ones, decisions,
    report by week."""
    v = load_views(spark, sf_dir)
    aside = ["label", "stratified_split", "split"]
    parted = labelled_frame(spark, sf_dir, "SPENT", partial(split.time_split, cut=0.5))
    learned = reduction.fit(parted.where("split = 'train'").drop(*aside), IDS)
    rows = materialise(learned.apply(parted, *aside))
    forest = model.candidates()["random_forest"].fit(rows.where("split = 'train'"))
    scored = forest.transform(split.test_rows(rows)).select("LOAN_ID", F.col("prediction").alias("y_pred"))
    mart = risk.risk_mart(v["loans"], v["purchases"], scored, slices=risk.heavy_retailers(v["loans"], v["purchases"]))
    return reports.weekly_policy(mart, None, "CONSERVATIVE_DECISION")


_SCALED = ["LOAN_AMOUNT", "m7", "s7", "m30", "s30"]


@query(
    "s8_row_norms",
    frame_sql(
        "SELECT LOAN_ID, round("
        + " + ".join(f"coalesce(power(({c} - avg({c}) OVER ()) / sqrt(var_pop({c}) OVER () * count({c}) OVER () / (count(*) OVER () - 1)), 2), 0)" for c in _SCALED)
        + f", 6) AS norm, {len(_SCALED)}.0::DOUBLE AS total_variance FROM f"
    ),
)
def _(spark, sf_dir):
    """Squared length of each row in all components, which no choice of signs or axes changes, and the sum of their variances."""
    frame = materialise(volume_frame(spark, sf_dir).select(*IDS, *_SCALED))
    learned = reduction.fit(frame, IDS, k=len(_SCALED), max_null=1.1, max_corr=1.1)
    rows = learned.apply(frame).select("LOAN_ID", vector_to_array("features").alias("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    return rows.select("LOAN_ID", F.round(norm, 6).alias("norm"), F.lit(round(float(learned.variances.sum()), 9)).alias("total_variance"))


@query(
    "s9_component_variances",
    frame_sql(
        "SELECT 'sum' AS what, round("
        + " + ".join(f"2 * power(corr({a}, {b}), 2)" for i, a in enumerate(["LOAN_AMOUNT", "z7", "z30"]) for b in ["LOAN_AMOUNT", "z7", "z30"][i + 1 :])
        + " + 3, 6) AS squares FROM (SELECT LOAN_AMOUNT, coalesce(m7, avg(m7) OVER ()) AS z7, coalesce(m30, avg(m30) OVER ()) AS z30 FROM f)"
    ),
)
def _(spark, sf_dir):
    """Sum of the squared component variances of filled, scaled columns: that of all squared correlations, whatever the signs.
    Found by scans that multiply a block of vectors, without a covariance matrix."""
    frame = materialise(volume_frame(spark, sf_dir).select(*IDS, "LOAN_AMOUNT", "m7", "m30"))
    learned = reduction.fit(frame, IDS, k=3, max_null=1.1, max_corr=1.1, dense=0)
    return spark.createDataFrame([("sum", round(float((learned.variances**2).sum()), 6))], "what string, squares double")


@query(
    "m8_classification_metrics",
    with_views(
        """SELECT tp, fp, fn, tn, tp / (tp + fp) AS "precision", tp / (tp + fn) AS recall, 5.0::DOUBLE * tp / (5.0::DOUBLE * tp + 4.0::DOUBLE * fn + fp) AS f_2_0,
2.0::DOUBLE * tp / (2.0::DOUBLE * tp + 1.0::DOUBLE * fn + fp) AS f_1_0, 1.25::DOUBLE * tp / (1.25::DOUBLE * tp + 0.25::DOUBLE * fn + fp) AS f_0_5 FROM
(SELECT count(*) FILTER (WHERE y AND p) AS tp, count(*) FILTER (WHERE NOT y AND p) AS fp, count(*) FILTER (WHERE y AND NOT p) AS fn, count(*) FILTER (WHERE NOT y AND NOT p) AS tn
 FROM (SELECT FIRST_TRIAL_BALANCE < 0 AS y, SPENT > 30 AS p FROM loans))""",
        names="loans",
    ),
)
def _(spark, sf_dir):
    loans = load_views(spark, sf_dir)["loans"]
    return model.classification_metrics(loans, F.col("FIRST_TRIAL_BALANCE") < 0, F.col("SPENT") > 30)


@query(
    "m10_regression_metrics",
    with_views(
        """SELECT round(avg(abs(e)), 6) AS mae, round(avg(e * e), 6) AS mse, round(sqrt(avg(e * e)), 6) AS rmse, round(1 - avg(e * e) / var_pop(SPENT), 6) AS r2
FROM (SELECT SPENT, SPENT - LOAN_AMOUNT * 0.5::DOUBLE AS e FROM loans WHERE SPENT > 0)""",
        names="loans",
    ),
)
def _(spark, sf_dir):
    used = shape.used_loans(load_views(spark, sf_dir)["loans"]).select(F.col("SPENT").alias("label"), (F.col("LOAN_AMOUNT") * 0.5).alias("prediction"))
    out = model.regression_metrics(used)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


_AP = """p AS (SELECT s, sum(y) AS y, count(*) AS n FROM (SELECT round(SPENT, 1) AS s, (FIRST_TRIAL_BALANCE < 0)::INT AS y FROM loans) GROUP BY s),
c AS (SELECT y, sum(y) OVER w AS tp, sum(n) OVER w AS n FROM p WINDOW w AS (ORDER BY s DESC))"""


@query("m7_average_precision", with_views("SELECT round(sum(tp / n * y) / sum(y), 9) AS average_precision FROM c", _AP, names="loans"))
def _(spark, sf_dir):
    scored = load_views(spark, sf_dir)["loans"].select(F.round("SPENT", 1).alias("score"), (F.col("FIRST_TRIAL_BALANCE") < 0).cast("int").alias("label"))
    return model.average_precision(scored).select(F.round("average_precision", 9).alias("average_precision"))


@query(
    "io10_m6_saved_line",
    with_views(
        "SELECT LOAN_ID, round(i + s * LOAN_AMOUNT, 6) AS prediction FROM loans, (SELECT regr_slope(SPENT, LOAN_AMOUNT) AS s, regr_intercept(SPENT, LOAN_AMOUNT) AS i FROM loans)",
        names="loans",
    ),
)
def _(spark, sf_dir):
    """A line fitted to all loans, saved, loaded and applied."""
    from pyspark.ml import Pipeline
    from pyspark.ml.regression import LinearRegression

    from ledgerlens.catalog.storage import scratch
    from ledgerlens.sources import files

    loans, path = load_views(spark, sf_dir)["loans"], scratch(spark)
    line = Pipeline(stages=[VectorAssembler(inputCols=["LOAN_AMOUNT"], outputCol="x"), LinearRegression(featuresCol="x", labelCol="SPENT", regParam=0.0, solver="normal")])
    files.save_model(line.fit(loans), path)
    return files.load_model(path).transform(loans).select("LOAN_ID", F.round("prediction", 6).alias("prediction"))


@query(
    "m4_four_layouts",
    with_views(
        """SELECT part, layout, LOAN_ID, MAIN_SYSTEM_ID, label, LOAN_AMOUNT AS v0, SPENT AS v1
FROM (SELECT l.LOAN_ID, l.MAIN_SYSTEM_ID, l.LOAN_AMOUNT, l.SPENT, p.label, CASE WHEN p.r >= CASE p.label WHEN 1 THEN 0.7 ELSE 0.8 END THEN 'test' ELSE 'train' END AS part
  FROM loans l JOIN (SELECT *, percent_rank() OVER (ORDER BY LOAN_ID) AS r FROM
    (SELECT LOAN_ID, CASE WHEN lower(PAYMENT_STATUS) IS DISTINCT FROM 'paid' THEN 1 ELSE 0 END AS label FROM loans WHERE SPENT > 0)) p USING (LOAN_ID))
CROSS JOIN (SELECT unnest(['flat', 'vector']) AS layout)""",
        names="loans",
    ),
)
def _(spark, sf_dir):
    """Train and test parts in both layouts, written and read back."""
    from ledgerlens.catalog.storage import scratch

    loans, path = load_views(spark, sf_dir)["loans"], scratch(spark)
    label = shape.make_label(loans, "LOAN_NOT_PAID").select("LOAN_ID", "label")
    rows = VectorAssembler(inputCols=["LOAN_AMOUNT", "SPENT"], outputCol="v").transform(loans.join(label, "LOAN_ID")).select(*IDS, "label", "v")
    split.write_layouts(split.stratified_time_split(rows), path, "v", 2)
    out = []
    for part in ("train", "test"):
        for layout in ("flat", "vector"):
            read = spark.read.parquet(f"{path}/{part}-{layout}")
            entry = lambda i: F.col(f"principal_component_{i}") if layout == "flat" else vector_to_array("v")[i]  # noqa: B023, E731
            out.append(read.select(F.lit(part).alias("part"), F.lit(layout).alias("layout"), *IDS, "label", entry(0).alias("v0"), entry(1).alias("v1")))
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query(
    "s11_correlation_groups",
    with_views(
        """SELECT a, b, abs(c) >= 0.95 AS together FROM (SELECT 'LOAN_AMOUNT' AS a, 'TOTAL_INITIAL_AMOUNT' AS b, corr(LOAN_AMOUNT, TOTAL_INITIAL_AMOUNT) AS c FROM loans
UNION ALL SELECT 'LOAN_AMOUNT', 'REPAYMENT_AMOUNT', corr(LOAN_AMOUNT, REPAYMENT_AMOUNT) FROM loans
UNION ALL SELECT 'TOTAL_INITIAL_AMOUNT', 'REPAYMENT_AMOUNT', corr(TOTAL_INITIAL_AMOUNT, REPAYMENT_AMOUNT) FROM loans)""",
        names="loans",
    ),
)
def _(spark, sf_dir):
    """Pairs of columns and whether they fall into one group of correlated columns."""
    columns = ["LOAN_AMOUNT", "TOTAL_INITIAL_AMOUNT", "REPAYMENT_AMOUNT"]
    loans = load_views(spark, sf_dir)["loans"].select(*columns)
    groups = selection.correlation_groups(selection.correlation_matrix(loans, columns), columns)
    pairs = [(a, b, any(a in g and b in g for g in groups)) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return spark.createDataFrame(pairs, "a string, b string, together boolean")


@query(
    "o7_united_definitions",
    with_views(
        "SELECT name || '_' || c AS name, count(*) AS columns FROM (SELECT unnest(['absolute', 'negate', 'sqrt', 'log', 'sine', 'cosine', 'tangent', 'is_null']) AS name) CROSS JOIN (SELECT unnest(['LOAN_AMOUNT', 'SPENT']) AS c) WHERE (SELECT count(*) FROM loans) > 0 GROUP BY 1",
        names="loans",
    ),
)
def _(spark, sf_dir):
    """Two frames with overlapping features joined on the loan; their definitions are united, each once."""
    loans = load_views(spark, sf_dir)["loans"].select("LOAN_ID", "LOAN_AMOUNT", "SPENT")
    one, two = ft.unary_features(["LOAN_AMOUNT"]), ft.unary_features(["LOAN_AMOUNT", "SPENT"])
    left, right = ft.dfs_transform(loans, one), ft.dfs_transform(loans, two)
    frame, defs = ft.merge_frames(left, right, ft.feature_defs(spark, one), ft.feature_defs(spark, two), "LOAN_ID")
    there = frame.select(F.explode(F.array(*[F.lit(c) for c in frame.columns])).alias("name")).distinct()
    return defs.join(there, "name").groupBy("name").agg(F.count(F.lit(1)).alias("columns"))


_SHARED = {
    "absolute": "true", "negate": "true", "sqrt": "{0} >= 0", "log": "{0} > 0", "sine": "true", "cosine": "true", "tangent": "true", "is_null": "true",
}


@query(
    "o7_definitions_with_values",
    with_views(
        " UNION ALL ".join(
            f"SELECT '{n}_{c}' AS name, '{c}' AS source_cols, {both} AS in_both, count(*) FILTER (WHERE ({c} IS NOT NULL OR '{n}' = 'is_null') AND coalesce({rule.format(c)}, true)) AS n_known FROM loans"
            for c, both in (("LOAN_AMOUNT", "true"), ("FIRST_TRIAL_BALANCE", "false"))
            for n, rule in _SHARED.items()
        ),
        names="loans",
    ),
)
def _(spark, sf_dir):
    """Definitions of two feature frames united, which of them both frames have, and for how many loans each gives a value."""
    loans = load_views(spark, sf_dir)["loans"].select("LOAN_ID", "LOAN_AMOUNT", "FIRST_TRIAL_BALANCE")
    one, two = ft.unary_features(["LOAN_AMOUNT"]), ft.unary_features(["LOAN_AMOUNT", "FIRST_TRIAL_BALANCE"])
    defs = [ft.feature_defs(spark, f) for f in (one, two)]
    frame, united = ft.merge_frames(ft.dfs_transform(loans, one), ft.dfs_transform(loans, two), *defs, "LOAN_ID")
    names = [r["name"] for r in united.select("name").collect()]  # one row per feature
    counts = frame.agg(*[F.count(c).alias(c) for c in names])
    known = counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n_known")) for c in names])))
    both = defs[0].intersect(defs[1]).select("name", F.lit(True).alias("both"))
    return united.join(known, "name").join(both, "name", "left").select("name", "source_cols", F.coalesce("both", F.lit(False)).alias("in_both"), "n_known")
