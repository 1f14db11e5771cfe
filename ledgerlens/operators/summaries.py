"""Aggregations, membership joins and checks over the lending tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.scalar import flag, is_close
from ledgerlens.schemas import KEY


def delayed_by_retailer(loans: DataFrame) -> DataFrame:
    """Distinct loans of each retailer, and those that missed the first collection but were paid."""
    late = (F.col("FIRST_TRIAL_BALANCE") < 0) & (F.col("PAYMENT_STATUS") == "Paid")
    per_loan = loans.groupBy(KEY, "LOAN_ID").agg(F.max(flag(late)).alias("late"))
    return per_loan.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("nunique_loan_id"), F.sum("late").alias("nunique_loan_id_delayed_payment")
    )


def top_delayed(loans: DataFrame, k: int = 5) -> DataFrame:
    return delayed_by_retailer(loans).orderBy(F.desc("nunique_loan_id_delayed_payment"), KEY).limit(k)


def several_collections(loans: DataFrame) -> DataFrame:
    """Loans that missed the first collection and carry more than one repayment time."""
    missed = loans.where("FIRST_TRIAL_BALANCE < 0")
    counts = missed.groupBy(KEY, "LOAN_ID").agg(F.count_distinct("REPAYMENT_UPDATED").alias("n_updates"))
    return counts.where("n_updates > 1")


def lost_keys(before: DataFrame, after: DataFrame, key: str = KEY) -> DataFrame:
    """Keys of ``before`` that have no row left in ``after``."""
    return before.select(key).distinct().join(after.select(key).distinct(), key, "left_anti")


def present_keys(keys: DataFrame, table: DataFrame, key: str = KEY) -> DataFrame:
    """How many of ``keys`` occur in ``table``."""
    return keys.select(key).distinct().join(table.select(key).distinct(), key, "left_semi").agg(F.count(F.lit(1)).alias("n_present"))


def merge_columns(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Join two frames on a key; columns both have are taken from the left."""
    shared = [c for c in right.columns if c in left.columns and c != on]
    return left.join(right.drop(*shared), on)


def mean_std(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    parts = [(F.avg(c).alias(f"mean_{c}"), F.stddev_samp(c).alias(f"std_{c}")) for c in columns]
    return df.agg(*[e for pair in parts for e in pair])


def column_info(df: DataFrame) -> DataFrame:
    """``column, type, non_null`` for every column, from one aggregation."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])
    rows = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col(f"`{c}`").alias("non_null")) for c, t in df.dtypes]
    return counts.select(F.inline(F.array(*rows)))


def match_rate(df: DataFrame, a: Column, b: Column, rtol: float = 1e-1, atol: float = 1e-1) -> DataFrame:
    """Rows where two amounts agree within a tolerance, and where they do not."""
    return df.select(is_close(a, b, rtol, atol).alias("match")).groupBy("match").agg(F.count(F.lit(1)).alias("n"))


def share_above(df: DataFrame, col: str, limit: Column) -> DataFrame:
    """Share of all rows strictly above a limit."""
    return df.agg(F.avg(F.when(F.col(col) > limit, 1.0).otherwise(0.0)).alias("share"))
