"""The loan risk mart: usual order volume at the moment of each request, and the decision rules on top of it."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.skew import AUTO, Slices
from ledgerlens.operators.temporal import measure_sides, rolling_asof, strictly_before
from ledgerlens.schemas import KEY

# Deviations above the mean that each policy tolerates.
POLICIES = {"CONSERVATIVE_DECISION": 1, "AMBITIOUS_DECISION": 2}


def heavy_retailers(loans: DataFrame, purchases: DataFrame, **limits) -> Slices | None:
    """Measure once which retailers are heavy in either table."""
    return measure_sides(loans, purchases, "LOAN_ISSUANCE_DATE", "ORDER_CREATION_DATE", KEY, **limits)


def with_volume(
    loans: DataFrame,
    purchases: DataFrame,
    days: int | list[int] = 30,
    tolerance_days: int = 7,
    strict: bool = True,
    slices: Slices | str | None = AUTO,
) -> DataFrame:
    """Each loan with the rolling order volume at the retailer's latest order within the tolerance."""
    orders = purchases.select(KEY, "ORDER_CREATION_DATE", "ORDER_PRICE", "ORDER_ID")
    joined = rolling_asof(
        loans,
        orders,
        "LOAN_ISSUANCE_DATE",
        "ORDER_CREATION_DATE",
        KEY,
        "ORDER_PRICE",
        days,
        tolerance=timedelta(days=tolerance_days),
        tie="ORDER_ID",
        slices=slices,
    )
    return strictly_before(joined, "LOAN_ISSUANCE_DATE", "ORDER_CREATION_DATE") if strict else joined


def limit_rule(k: float, days: int = 30) -> Column:
    """Both the expected spend and the requested amount lie within ``k`` deviations above the mean; unknown denies."""
    limit = F.col(f"ROLLINGMEAN_{days}DAYS__ORDER_PRICE__") + k * F.col(f"ROLLINGSTDDEV_{days}DAYS__ORDER_PRICE__")
    return F.coalesce((F.col("y_pred") <= limit) & (F.col("LOAN_AMOUNT") <= limit), F.lit(False))


def decide(mart: DataFrame, k: float, name: str, days: int = 30) -> DataFrame:
    return mart.withColumn(name, limit_rule(k, days))


def risk_mart(
    loans: DataFrame,
    purchases: DataFrame,
    predictions: DataFrame | None = None,
    days: int = 30,
    tolerance_days: int = 7,
    slices: Slices | str | None = AUTO,
) -> DataFrame:
    """Loans with a recent order, their usual volume and one decision column per policy.

    ``predictions`` is ``LOAN_ID, y_pred``; leave it out if ``loans`` already has ``y_pred``.
    """
    scored = loans if predictions is None else loans.join(predictions, "LOAN_ID")
    mart = with_volume(scored, purchases, days, tolerance_days, slices=slices)
    return mart.select("*", *[limit_rule(k, days).alias(name) for name, k in POLICIES.items()])


def decisions(mart: DataFrame) -> DataFrame:
    return mart.select("LOAN_ID", *POLICIES)
