"""Sources, sinks, column reshaping and vectors: written to the checkpoint folder, read back and compared."""

from __future__ import annotations

import uuid

from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ledgerlens.catalog.lending import MART_COLUMNS, build_mart, mart_sql
from ledgerlens.catalog.registry import query
from ledgerlens.catalog.views_sql import with_views
from ledgerlens.operators import shape
from ledgerlens.plans import risk
from ledgerlens.schemas import KEY, LOANS, PURCHASES
from ledgerlens.session import ensure_checkpoint_dir
from ledgerlens.sources import files
from ledgerlens.sources.adapters import load_views


def scratch(spark) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/catalog-{uuid.uuid4().hex}"


_ORDERS = "SELECT ORDER_ID, MAIN_SYSTEM_ID, ORDER_PRICE, DISCOUNT, ORDER_PRICE_AFTER_DISCOUNT, ORDER_CREATION_DATE FROM purchases"


def written_orders(spark, sf_dir):
    path = scratch(spark)
    files.write_csv(load_views(spark, sf_dir)["purchases"].select(*PURCHASES.names), path)
    return path


@query("io1_io9_typed_csv", with_views(_ORDERS, names="purchases"))
def _(spark, sf_dir):
    return files.read_orders(spark, written_orders(spark, sf_dir))


@query("io3_untyped_csv", with_views(_ORDERS, names="purchases"))
def _(spark, sf_dir):
    return files.read_untyped(spark, written_orders(spark, sf_dir), PURCHASES)


@query("io2_decisions_csv", mart_sql("SELECT LOAN_ID, CONSERVATIVE_DECISION, AMBITIOUS_DECISION FROM mart"))
def _(spark, sf_dir):
    path = scratch(spark)
    files.write_csv(risk.decisions(build_mart(spark, sf_dir)), path)
    return files.read_decisions(spark, path)


@query(
    "io5_merged_schema",
    with_views(
        """SELECT 1 AS part, LOAN_ID, LOAN_AMOUNT, NULL::INTEGER AS late FROM loans WHERE PAYMENT_STATUS = 'Paid'
UNION ALL SELECT 2, LOAN_ID, NULL, CASE WHEN FIRST_TRIAL_BALANCE < 0 THEN 1 ELSE 0 END FROM loans WHERE PAYMENT_STATUS <> 'Paid'""",
        names="loans",
    ),
)
def _(spark, sf_dir):
    path, loans = scratch(spark), load_views(spark, sf_dir)["loans"]
    paid = loans.where("PAYMENT_STATUS = 'Paid'").select("LOAN_ID", "LOAN_AMOUNT", F.lit(0).alias("__index_level_0__"))
    other = loans.where("PAYMENT_STATUS <> 'Paid'").select("LOAN_ID", (F.col("FIRST_TRIAL_BALANCE") < 0).alias("late"))
    paid.write.parquet(f"{path}/part=1")
    shape.harmonise(other, ["LOAN_ID"]).write.parquet(f"{path}/part=2")
    return files.read_feature_frames(spark, path)


@query("io7_bounded_parquet", with_views("SELECT LOAN_ID, SPENT FROM loans", names="loans"))
def _(spark, sf_dir):
    path = scratch(spark)
    files.write_parquet(load_views(spark, sf_dir)["loans"].select("LOAN_ID", "SPENT"), path, files=96)
    return files.read_parquet(spark, path)


@query("io8_bucketed_by_retailer", with_views("SELECT LOAN_ID, MAIN_SYSTEM_ID, SPENT FROM loans", names="loans"))
def _(spark, sf_dir):
    path = scratch(spark)
    files.write_by_retailer(load_views(spark, sf_dir)["loans"].select("LOAN_ID", KEY, "SPENT"), path, buckets=16)
    return files.read_parquet(spark, path).drop("bucket")


def bucketed_views(spark, sf_dir, buckets=16):
    """Loans and orders as tables bucketed by the retailer."""
    v, out = load_views(spark, sf_dir), {}
    for name in ("loans", "purchases"):
        path = scratch(spark)
        out[name] = files.write_bucketed(v[name], f"{name}_{path[-32:]}", path, KEY, buckets)
    return out


@query("io8_mart_of_bucketed_tables", mart_sql("SELECT LOAN_ID, CONSERVATIVE_DECISION, AMBITIOUS_DECISION FROM mart"))
def _(spark, sf_dir):
    """Decisions from tables that were written once by retailer."""
    v = bucketed_views(spark, sf_dir)
    loans = v["loans"].select(*MART_COLUMNS, F.col("SPENT").alias("y_pred"))
    return risk.decisions(risk.risk_mart(loans, v["purchases"], slices=risk.heavy_retailers(loans, v["purchases"])))


@query(
    "p4_harmonise_types",
    with_views(
        "SELECT LOAN_ID, MAIN_SYSTEM_ID, FIRST_TRAIL_DELAYS::DOUBLE AS FIRST_TRAIL_DELAYS, SPENT, (SPENT > LOAN_AMOUNT)::INTEGER AS over, PAYMENT_STATUS FROM loans",
        names="loans",
    ),
)
def _(spark, sf_dir):
    loans = load_views(spark, sf_dir)["loans"]
    mixed = loans.select("LOAN_ID", KEY, "FIRST_TRAIL_DELAYS", "SPENT", (F.col("SPENT") > F.col("LOAN_AMOUNT")).alias("over"), "PAYMENT_STATUS")
    return shape.harmonise(mixed, ["LOAN_ID", KEY])


@query(
    "p5_sanitised_names",
    with_views("SELECT LOAN_ID, SPENT AS retailers_SUM__loans_SPENT__, SPENT + LOAN_AMOUNT AS SPENT_div_LOAN_AMOUNT, SPENT - LOAN_AMOUNT AS F__a_b__ FROM loans", names="loans"),
)
def _(spark, sf_dir):
    loans = load_views(spark, sf_dir)["loans"]
    odd = loans.select(
        "LOAN_ID",
        F.col("SPENT").alias("retailers.SUM(loans.SPENT)"),
        (F.col("SPENT") + F.col("LOAN_AMOUNT")).alias("SPENT / LOAN_AMOUNT"),
        (F.col("SPENT") - F.col("LOAN_AMOUNT")).alias("F(a,b)"),
    )
    return shape.sanitise_names(odd)


@query("p6_numeric_columns", with_views("SELECT LOAN_ID, LOAN_AMOUNT, SPENT, FIRST_TRAIL_DELAYS FROM loans", names="loans"))
def _(spark, sf_dir):
    loans = load_views(spark, sf_dir)["loans"].select("LOAN_ID", KEY, "LOAN_AMOUNT", "SPENT", "FIRST_TRAIL_DELAYS", "PAYMENT_STATUS")
    _categorical, numeric = shape.split_columns(loans, ["LOAN_ID", KEY])
    return loans.select("LOAN_ID", *numeric)


_VECTOR = ["LOAN_AMOUNT", "SPENT", "FIRST_TRIAL_BALANCE"]


@query(
    "p19_s7_vector_columns",
    with_views(
        "SELECT LOAN_ID, LOAN_AMOUNT AS principal_component_0, SPENT AS principal_component_1, FIRST_TRIAL_BALANCE AS principal_component_2 FROM loans",
        names="loans",
    ),
)
def _(spark, sf_dir):
    loans = load_views(spark, sf_dir)["loans"].select("LOAN_ID", *_VECTOR)
    vectors = VectorAssembler(inputCols=_VECTOR, outputCol="v").transform(loans).select("LOAN_ID", "v")
    return shape.vector_columns(vectors, "v", 3)


@query(
    "u1_u2_vector_arrays",
    with_views("SELECT LOAN_ID, 3 AS vec_size, LOAN_AMOUNT + SPENT + FIRST_TRIAL_BALANCE AS total FROM loans", names="loans"),
)
def _(spark, sf_dir):
    loans = load_views(spark, sf_dir)["loans"].select("LOAN_ID", *_VECTOR)
    vectors = VectorAssembler(inputCols=_VECTOR, outputCol="v").transform(loans)
    total = F.aggregate(vector_to_array("v"), F.lit(0.0), lambda a, x: a + x)
    return vectors.select("LOAN_ID", shape.vector_size("v").alias("vec_size"), total.alias("total"))


@query(
    "s5_string_index",
    with_views(
        """SELECT l.LOAN_ID, i.place::DOUBLE AS PAYMENT_STATUS_index FROM loans l JOIN (SELECT PAYMENT_STATUS, row_number() OVER (ORDER BY count(*) DESC, PAYMENT_STATUS) - 1 AS place
FROM loans GROUP BY 1) i ON i.PAYMENT_STATUS = l.PAYMENT_STATUS""",
        names="loans",
    ),
)
def _(spark, sf_dir):
    loans = load_views(spark, sf_dir)["loans"].select("LOAN_ID", "PAYMENT_STATUS")
    indexer = StringIndexer(inputCol="PAYMENT_STATUS", outputCol="PAYMENT_STATUS_index", handleInvalid="keep")
    return indexer.fit(loans).transform(loans).select("LOAN_ID", "PAYMENT_STATUS_index")


@query("io3_conformed_loans", with_views("SELECT * FROM loans", names="loans"))
def _(spark, sf_dir):
    path = scratch(spark)
    files.write_csv(load_views(spark, sf_dir)["loans"].select(*LOANS.names), path)
    return files.read_loans(spark, path)


_SEVERITY = [("Paid", 0), ("Partialy paid", 1), ("Unpaid", 2)]


@query(
    "io6_local_rows",
    with_views("SELECT LOAN_ID, CASE PAYMENT_STATUS WHEN 'Paid' THEN 0 WHEN 'Partialy paid' THEN 1 WHEN 'Unpaid' THEN 2 END AS severity FROM loans", names="loans"),
)
def _(spark, sf_dir):
    """A small driver-side table joined with the loans."""
    levels = files.local_rows(spark, _SEVERITY, "PAYMENT_STATUS string, severity int")
    return load_views(spark, sf_dir)["loans"].join(F.broadcast(levels), "PAYMENT_STATUS", "left").select("LOAN_ID", "severity")


@query("io11_report", with_views("SELECT PAYMENT_STATUS, count(*) AS n FROM loans GROUP BY 1", names="loans"))
def _(spark, sf_dir):
    """An aggregated report collected as a pandas frame, and read again."""
    counts = load_views(spark, sf_dir)["loans"].groupBy("PAYMENT_STATUS").agg(F.count(F.lit(1)).alias("n"))
    return files.local_rows(spark, files.to_report(counts), "PAYMENT_STATUS string, n long")


@query(
    "io12_kept_frame",
    with_views(
        "SELECT count(*) AS loans, (SELECT count(DISTINCT MAIN_SYSTEM_ID) FROM loans WHERE SPENT > 0) AS retailers FROM loans WHERE SPENT > 0",
        names="loans",
    ),
)
def _(spark, sf_dir):
    """Two aggregates of one frame that is kept between them."""
    kept = files.keep(shape.used_loans(load_views(spark, sf_dir)["loans"]))
    retailers = kept.select(KEY).distinct().agg(F.count(F.lit(1)).alias("retailers"))
    return kept.agg(F.count(F.lit(1)).alias("loans")).crossJoin(F.broadcast(retailers))  # one row each
