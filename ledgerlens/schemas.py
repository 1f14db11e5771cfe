"""Declared schemas and column lists of the lending tables."""

from __future__ import annotations

from pyspark.sql import types as T

KEY = "MAIN_SYSTEM_ID"

# Column names and types of the input files.
LOANS = T.StructType(
    [
        T.StructField("INDEX", T.LongType()),
        T.StructField("MAIN_SYSTEM_ID", T.LongType()),
        T.StructField("RETAILER_ID", T.LongType()),
        T.StructField("LOAN_ID", T.LongType()),
        T.StructField("LOAN_ISSUANCE_DATE", T.TimestampNTZType()),
        T.StructField("LOAN_AMOUNT", T.DoubleType()),
        T.StructField("INITIAL_COST", T.DoubleType()),
        T.StructField("TOTAL_INITIAL_AMOUNT", T.DoubleType()),
        T.StructField("INITIAL_DATE", T.TimestampNTZType()),
        T.StructField("LOAN_PAYMENT_DATE", T.TimestampNTZType()),
        T.StructField("PAYMENT_AMOUNT", T.DoubleType()),
        T.StructField("FIRST_TRAIL_DELAYS", T.IntegerType()),
        T.StructField("SPENT", T.DoubleType()),
        T.StructField("FIRST_TRIAL_BALANCE", T.DoubleType()),
        T.StructField("FINAL_COST", T.DoubleType()),
        T.StructField("TOTAL_FINAL_AMOUNT", T.DoubleType()),
        T.StructField("REPAYMENT_ID", T.LongType()),
        T.StructField("REPAYMENT_AMOUNT", T.DoubleType()),
        T.StructField("REPAYMENT_UPDATED", T.TimestampNTZType()),
        T.StructField("CUMMULATIVE_OUTSTANDING", T.DoubleType()),
        T.StructField("PAYMENT_STATUS", T.StringType()),
    ]
)
SALES = T.StructType(
    [
        T.StructField("ID", T.LongType()),
        T.StructField("CREATED_AT", T.TimestampNTZType()),
        T.StructField("UPDATED_AT", T.TimestampNTZType()),
        T.StructField("AMOUNT", T.DoubleType()),
        T.StructField("FEES", T.DoubleType()),
        T.StructField("RETAILER_CUT", T.DoubleType()),
        T.StructField("STATUS", T.StringType()),
        T.StructField("TOTAL_AMOUNT_INCLUDING_TAX", T.DoubleType()),
        T.StructField("TOTAL_AMOUNT_PAID", T.DoubleType()),
        T.StructField("WALLET_BALANCE_BEFORE_TRANSACTION", T.DoubleType()),
        T.StructField("MAIN_SYSTEM_ID", T.LongType()),
    ]
)
PURCHASES = T.StructType(
    [
        T.StructField("ORDER_ID", T.LongType()),
        T.StructField("MAIN_SYSTEM_ID", T.LongType()),
        T.StructField("ORDER_PRICE", T.DoubleType()),
        T.StructField("DISCOUNT", T.DoubleType()),
        T.StructField("ORDER_PRICE_AFTER_DISCOUNT", T.DoubleType()),
        T.StructField("ORDER_CREATION_DATE", T.TimestampNTZType()),
    ]
)
DECISIONS = T.StructType(
    [
        T.StructField("LOAN_ID", T.LongType(), nullable=False),
        T.StructField("CONSERVATIVE_DECISION", T.BooleanType(), nullable=False),
        T.StructField("AMBITIOUS_DECISION", T.BooleanType(), nullable=False),
    ]
)

# Loan columns without signal, and columns known only after the loan was granted.
LOW_SIGNAL = ["INITIAL_COST", "INDEX", "REPAYMENT_ID", "FINAL_COST", "RETAILER_ID"]
AFTER_THE_FACT = [
    "REPAYMENT_UPDATED",
    "SPENT",
    "TOTAL_FINAL_AMOUNT",
    "FIRST_TRIAL_BALANCE",
    "FIRST_TRAIL_DELAYS",
    "PAYMENT_AMOUNT",
    "LOAN_PAYMENT_DATE",
    "REPAYMENT_AMOUNT",
    "CUMMULATIVE_OUTSTANDING",
    "PAYMENT_STATUS",
]
