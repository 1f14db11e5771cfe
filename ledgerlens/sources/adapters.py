"""Lending views over the benchmark tables.

``dense`` reads ``events`` (30 days, microsecond times), ``sparse`` reads ``orders`` (6.6 years, day precision, ties).
Every view is a projection of one scan, so filters and column pruning reach the Parquet reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _days(n: int) -> Column:
    return F.expr(f"INTERVAL '{n}' DAY")


def _loan_columns(ident: str, retailer: str, ts: str, amount: str) -> list[Column]:
    i, amt, when = F.col(ident), F.col(amount), F.col(ts)
    spent = amt * (i % 12) / F.lit(10.0)
    status = F.when(i % 25 == 0, "Unpaid").when(i % 25 == 1, "Partialy paid").otherwise("Paid")
    missed = (i % 25 <= 1) | (i % 20 == 0)
    balance = F.when(missed, -spent).otherwise(F.lit(0.0))
    repaid = F.when((i % 20 == 0) & (i % 25 > 1), spent).otherwise(F.lit(0.0))
    return [
        i.alias("INDEX"),
        F.col(retailer).alias("MAIN_SYSTEM_ID"),
        (F.col(retailer) + 100000).alias("RETAILER_ID"),
        i.alias("LOAN_ID"),
        when.alias("LOAN_ISSUANCE_DATE"),
        amt.alias("LOAN_AMOUNT"),
        F.lit(0.0).alias("INITIAL_COST"),
        amt.alias("TOTAL_INITIAL_AMOUNT"),
        (when + _days(7)).alias("INITIAL_DATE"),
        (when + _days(8)).alias("LOAN_PAYMENT_DATE"),
        (spent + balance).alias("PAYMENT_AMOUNT"),
        F.when(i % 20 == 0, 1).otherwise(0).alias("FIRST_TRAIL_DELAYS"),
        spent.alias("SPENT"),
        balance.alias("FIRST_TRIAL_BALANCE"),
        F.lit(0.0).alias("FINAL_COST"),
        spent.alias("TOTAL_FINAL_AMOUNT"),
        i.alias("REPAYMENT_ID"),
        repaid.alias("REPAYMENT_AMOUNT"),
        (when + _days(8)).alias("REPAYMENT_UPDATED"),
        (balance + repaid).alias("CUMMULATIVE_OUTSTANDING"),
        status.alias("PAYMENT_STATUS"),
    ]


def _dense(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    events = table(spark, sf_dir, "events")
    kind, user, ident, value, ts = F.col("event_type"), F.col("user_id"), F.col("event_id"), F.col("value"), F.col("ts")
    loans = events.where(kind == "signup").select(*_loan_columns("event_id", "user_id", "ts", "value"))
    discount = value * (ident % 5) / F.lit(100.0)
    purchases = events.where((kind == "purchase") & (user % 10 != 9)).select(
        ident.alias("ORDER_ID"),
        user.alias("MAIN_SYSTEM_ID"),
        value.alias("ORDER_PRICE"),
        discount.alias("DISCOUNT"),
        (value - discount).alias("ORDER_PRICE_AFTER_DISCOUNT"),
        ts.alias("ORDER_CREATION_DATE"),
    )
    with_tax = value + value / F.lit(100.0)
    sales = events.where(kind.isin("click", "view", "error")).select(
        ident.alias("ID"),
        user.alias("MAIN_SYSTEM_ID"),
        ts.alias("CREATED_AT"),
        (ts + F.expr("make_dt_interval(0, 0, CAST(event_id % 60 AS INT), 0)")).alias("UPDATED_AT"),
        value.alias("AMOUNT"),
        (value / F.lit(100.0)).alias("FEES"),
        (value / F.lit(50.0)).alias("RETAILER_CUT"),
        F.when(kind == "error", "FAILED").otherwise("SUCCESSFUL").alias("STATUS"),
        with_tax.alias("TOTAL_AMOUNT_INCLUDING_TAX"),
        F.when(kind == "error", 0.0).otherwise(with_tax).alias("TOTAL_AMOUNT_PAID"),
        (value * (ident % 7)).alias("WALLET_BALANCE_BEFORE_TRANSACTION"),
    )
    retailers = loans.select("MAIN_SYSTEM_ID").distinct()
    return {"loans": loans, "purchases": purchases, "sales": sales, "retailers": retailers}


def _sparse(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    orders = table(spark, sf_dir, "orders")
    loans = orders.where(F.col("o_orderkey") % 5 == 0).select(
        *_loan_columns("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    )
    purchases = orders.where(F.col("o_orderkey") % 5 != 0).select(
        F.col("o_orderkey").alias("ORDER_ID"),
        F.col("o_custkey").alias("MAIN_SYSTEM_ID"),
        F.col("o_totalprice").alias("ORDER_PRICE"),
        F.col("o_orderdate").alias("ORDER_CREATION_DATE"),
    )
    retailers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("MAIN_SYSTEM_ID"))
    return {"loans": loans, "purchases": purchases, "retailers": retailers}


def load_views(spark: SparkSession, sf_dir: str, adapter: str = "dense") -> dict[str, DataFrame]:
    """``loans``, ``purchases``, ``sales`` (dense only) and ``retailers`` over the tables in ``sf_dir``."""
    return {"dense": _dense, "sparse": _sparse}[adapter](spark, sf_dir)
