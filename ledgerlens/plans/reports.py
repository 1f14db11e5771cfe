"""Portfolio reports. Distinct loans are counted by grouping on the loan first, which needs no row expansion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.exact import exact_sum
from ledgerlens.functions.scalar import flag, week_start
from ledgerlens.operators.shape import first_collection_default


def portfolio_summary(loans: DataFrame) -> DataFrame:
    """One row: loans, weeks, amounts as text, unused share, loans by first-collection outcome."""
    labelled = first_collection_default(loans).withColumn("week_dt", week_start("LOAN_ISSUANCE_DATE"))
    per_loan = labelled.groupBy("LOAN_ID").agg(
        exact_sum(F.col("LOAN_AMOUNT")).alias("requested"),
        exact_sum(F.col("SPENT")).alias("spent"),
        F.max(flag(~F.col("LABEL"))).alias("kept"),
        F.max(flag(F.col("LABEL"))).alias("missed"),
    )
    requested, spent = exact_sum(F.col("requested")), exact_sum(F.col("spent"))
    totals = per_loan.agg(
        F.count(F.lit(1)).alias("nunique_loans"),
        F.format_string("%.2f", requested).alias("total_amount_requested"),
        F.format_string("%.2f", spent).alias("total_amount_spent"),
        F.format_string("%.4f", 1 - F.try_divide(spent, requested)).alias("percentage_amount_stale"),
        F.sum("kept").alias("nunique_loans_fullfiled_first_collection"),
        F.sum("missed").alias("nunique_loans_defaulted_first_collection"),
    )
    weeks = labelled.agg(F.count_distinct("week_dt").alias("n")).scalar()
    return totals.withColumn("nunique_weeks", weeks)


def growth(report: DataFrame, columns: Sequence[str], period: str = "week_dt", suffix: str = "_weekly_growth") -> DataFrame:
    """Ratio of each column to the previous period. The report has one row per period, so one task orders it."""
    w = Window.orderBy(period)
    ratios = [F.try_divide(F.col(c).cast("double"), F.lag(c).over(w).cast("double")).alias(c + suffix) for c in columns]
    return report.select("*", *ratios)


def overview_counts(loans: DataFrame) -> DataFrame:
    """Loans, requested and spent amounts and first-collection losses by week of issuance."""
    shortfall = F.when(F.col("FIRST_TRIAL_BALANCE") < 0, F.col("FIRST_TRIAL_BALANCE"))
    per_loan = loans.groupBy(week_start("LOAN_ISSUANCE_DATE").alias("week_dt"), "LOAN_ID").agg(
        exact_sum(F.col("LOAN_AMOUNT")).alias("requested"), exact_sum(F.col("SPENT")).alias("spent"), exact_sum(shortfall).alias("lost")
    )
    return per_loan.groupBy("week_dt").agg(
        F.count(F.lit(1)).alias("nunique_loans"),
        exact_sum(F.col("requested")).alias("total_amount_requested"),
        exact_sum(F.col("spent")).alias("total_amount_spent"),
        F.abs(exact_sum(F.col("lost"))).alias("total_amount_loss"),
    )


def weekly_overview(loans: DataFrame) -> DataFrame:
    """Weekly volume and losses with growth; weeks with an undefined figure are left out after growth was taken."""
    figures = ["nunique_loans", "total_amount_requested", "total_amount_spent", "total_amount_loss"]
    return growth(overview_counts(loans), figures).dropna().orderBy("week_dt")


def policy_counts(loans: DataFrame, decisions: DataFrame | None, policy: str) -> DataFrame:
    """Weekly counts and volumes: requested, approved, approved and defaulted, defaulted.

    ``decisions`` is joined on the loan; pass ``None`` if ``loans`` already carries the policy column.
    """
    facts = loans if decisions is None else loans.join(decisions.select("LOAN_ID", policy), "LOAN_ID")
    approved, missed = F.col(policy), F.col("FIRST_TRIAL_BALANCE") < 0
    amount = F.col("LOAN_AMOUNT")
    per_loan = facts.groupBy(week_start("LOAN_ISSUANCE_DATE").alias("week_dt"), "LOAN_ID").agg(
        F.max(flag(approved)).alias("approved"),
        F.max(flag(approved & missed)).alias("approved_missed"),
        F.max(flag(missed)).alias("missed"),
        exact_sum(amount).alias("amount"),
        exact_sum(F.when(approved, amount)).alias("amount_approved"),
        exact_sum(F.when(approved & missed, amount)).alias("amount_approved_missed"),
        exact_sum(F.when(missed, amount)).alias("amount_missed"),
    )
    return per_loan.groupBy("week_dt").agg(
        F.count(F.lit(1)).alias("nunique_loans"),
        F.sum("approved").alias("nunique_loans_approved"),
        F.sum("approved_missed").alias("nunique_loans_approved_defaulted"),
        F.sum("missed").alias("nunique_loans_defaulted_gt"),
        exact_sum(F.col("amount")).alias("total_amount_requested"),
        exact_sum(F.col("amount_approved")).alias("amount_approved"),
        exact_sum(F.col("amount_approved_missed")).alias("amount_approved_defaulted"),
        exact_sum(F.col("amount_missed")).alias("total_amount_requested_defaulted_gt"),
    )


def weekly_policy(loans: DataFrame, decisions: DataFrame | None, policy: str) -> DataFrame:
    """The weekly policy report with growth of approvals and of approved defaults."""
    figures = ["nunique_loans_approved", "nunique_loans_approved_defaulted"]
    return growth(policy_counts(loans, decisions, policy), figures).dropna().orderBy("week_dt")


def mean_growth(report: DataFrame, columns: Sequence[str], before: str | None = None) -> DataFrame:
    """Average of growth columns over the weeks before a date."""
    rows = report if before is None else report.where(F.col("week_dt") < F.lit(before).cast("timestamp_ntz"))
    return rows.agg(*[F.round(F.avg(c), 6).alias(f"avg_{c}") for c in columns])


def compare_policies(conservative: DataFrame, ambitious: DataFrame) -> DataFrame:
    """Approved defaults of two weekly policy reports side by side."""
    figures = ["nunique_loans_approved_defaulted", "amount_approved_defaulted"]
    left = conservative.select("week_dt", *[F.col(c).alias(f"{c}_conservative") for c in figures])
    right = ambitious.select("week_dt", *[F.col(c).alias(f"{c}_ambitious") for c in figures])
    return left.join(right, "week_dt").orderBy("week_dt")


def policy_uplift(mart: DataFrame, base: str = "CONSERVATIVE_DECISION", other: str = "AMBITIOUS_DECISION") -> DataFrame:
    """Loans and retailers served under two policies and the relative gain of the second."""
    retailers = mart.groupBy("MAIN_SYSTEM_ID").agg(
        F.sum(flag(F.col(base))).alias("b"), F.sum(flag(F.col(other))).alias("o")
    )
    served = retailers.agg(
        F.sum("b").alias("loans_base"),
        F.sum("o").alias("loans_other"),
        F.sum(flag(F.col("b") > 0)).alias("retailers_base"),
        F.sum(flag(F.col("o") > 0)).alias("retailers_other"),
    )
    return served.select(
        "*",
        F.round(F.try_divide("loans_other", "loans_base") - 1, 6).alias("loans_uplift"),
        F.round(F.try_divide("retailers_other", "retailers_base") - 1, 6).alias("retailers_uplift"),
    )


def stale_capital(loans: DataFrame, grain: str = "week") -> DataFrame:
    """Committed but unused money by day or week."""
    period = F.date_trunc(grain, "LOAN_ISSUANCE_DATE").cast("timestamp_ntz").alias("period_dt")
    sums = loans.groupBy(period).agg(exact_sum(F.col("LOAN_AMOUNT")).alias("requested"), exact_sum(F.col("SPENT")).alias("spent"))
    return sums.select(
        "*",
        F.round(F.col("requested") - F.col("spent"), 4).alias("stale"),
        F.round(1 - F.try_divide("spent", "requested"), 6).alias("stale_share"),
    ).orderBy("period_dt")
