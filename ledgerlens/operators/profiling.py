"""Table and column profiles as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions import exact
from ledgerlens.operators.moments import named_pairs
from ledgerlens.operators.quantiles import quantiles
from ledgerlens.operators.selection import maybe_unique
from ledgerlens.operators.skew import AUTO, HOT_ROWS, measure, resolve, running
from ledgerlens.operators.temporal import measure_sides
from ledgerlens.schemas import KEY

QUANTILES = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def profile_table(df: DataFrame) -> DataFrame:
    """Rows, columns, missing cells and duplicate rows (all rows minus distinct rows)."""
    whole = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(sum(F.when(F.col(f"`{c}`").isNull(), 1).otherwise(0) for c in df.columns)).cast("long").alias("missing_cells"),
    )
    distinct = df.distinct().agg(F.count(F.lit(1))).scalar()
    return whole.select("n_rows", F.lit(len(df.columns)).alias("n_columns"), "missing_cells", (F.col("n_rows") - distinct).alias("duplicate_rows"))


def long_form(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value)`` pairs of numeric columns, one scan."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns])
    return df.select(F.inline(pairs))


def profile_numeric(df: DataFrame, columns: Sequence[str] | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per numeric column: counts, moments, extremes, quantiles, zeros and negatives.

    Moments come from one aggregation without a shuffle of rows. Quantiles and distinct counts work on (column, value)
    counts; a column with many rows is ordered in slices instead of in one task.
    """
    columns = list(columns or numeric_columns(df))
    pairs = long_form(df, columns)
    x = F.col("value")
    moments = pairs.groupBy("column").agg(
        F.count("value").alias("n"),
        F.sum(F.when(x.isNull(), 1).otherwise(0)).alias("missing"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.sum(F.when(x == 0, 1).otherwise(0)).alias("zeros"),
        F.sum(F.when(x < 0, 1).otherwise(0)).alias("negatives"),
        F.skewness("value").alias("skewness"),
        F.kurtosis("value").alias("kurtosis"),
    )
    known = pairs.where(x.isNotNull())
    distinct = known.groupBy("column", "value").agg(F.lit(1).alias("o")).groupBy("column").agg(F.count("o").alias("distinct"))
    slices = measure(known, "column", "value", hot_rows=hot_rows)
    cuts = quantiles(known, "column", "value", QUANTILES, slices)
    return moments.join(distinct, "column", "left").join(cuts, "column", "left")


def profile_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values, missing, shortest and longest text per column."""
    pairs = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns])))
    return pairs.groupBy("column", "value").agg(F.count(F.lit(1)).alias("c")).groupBy("column").agg(
        F.count("value").alias("distinct"),
        F.sum(F.when(F.col("value").isNull(), F.col("c")).otherwise(0)).alias("missing"),
        F.min(F.length("value")).cast("long").alias("shortest"),
        F.max(F.length("value")).cast("long").alias("longest"),
    )


def profile_time(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values, missing, first and last time per column."""
    pairs = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns])))
    return pairs.groupBy("column", "value").agg(F.count(F.lit(1)).alias("c")).groupBy("column").agg(
        F.count("value").alias("distinct"),
        F.sum(F.when(F.col("value").isNull(), F.col("c")).otherwise(0)).alias("missing"),
        F.min("value").alias("first"),
        F.max("value").alias("last"),
    )


def most_common(df: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    """The ``k`` most frequent values of each column; each task forwards at most ``k`` per column."""
    pairs = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])))
    counts = pairs.where("value IS NOT NULL").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))
    return counts.withColumn("place", place).where(F.col("place") <= k)


def column_histograms(df: DataFrame, columns: Sequence[str], bins: int) -> DataFrame:
    """Equal-width histogram of every column from one ``(column, bin)`` aggregation; empty bins are left out."""
    pairs = long_form(df, columns).where("value IS NOT NULL")
    bounds = pairs.groupBy("column").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.when(width > 0, F.least(F.floor((F.col("value") - F.col("lo")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))).otherwise(0)
    placed = pairs.join(F.broadcast(bounds), "column").select("column", place.cast("int").alias("bin"))  # one row per column
    return placed.groupBy("column", "bin").agg(F.count(F.lit(1)).alias("n"))


def correlation_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns (``a`` before ``b``) over rows where both are known, from one scan."""
    return named_pairs(df, list(columns))


def alerts(df: DataFrame, columns: Sequence[str], max_null: float = 0.25, max_zero: float = 0.25, max_corr: float = 0.95) -> DataFrame:
    """Findings per column: constant, unique, mostly missing, many zeros, highly correlated with another column."""
    columns = list(columns)
    facts, unique = maybe_unique(df, columns)
    found = []
    for c in columns:
        f = facts[c]
        share = lambda n: f["rows"] > 0 and n / f["rows"]  # noqa: B023, E731
        findings = {
            "constant": f["constant"],
            "unique": c in unique and f["n"] > 1,
            "missing": f["rows"] > 0 and share(f["rows"] - f["n"]) >= max_null,
            "zeros": f["rows"] > 0 and share(f["zeros"]) >= max_zero,
        }
        found += [(c, name) for name, there in findings.items() if there]
    single = df.sparkSession.createDataFrame(found, "column string, alert string")
    related = correlation_pairs(df, columns).where(F.abs("corr") >= max_corr)
    return single.unionByName(related.select(F.col("b").alias("column"), F.concat(F.lit("correlated with "), "a").alias("alert")))


def activity(df: DataFrame, entity: str, ts: str, grain: str, top: int) -> DataFrame:
    """Events of the ``top`` busiest entities per time bin."""
    busiest = df.groupBy(entity).agg(F.count(F.lit(1)).alias("_c")).orderBy(F.desc("_c"), entity).limit(top).select(entity)
    rows = df.join(F.broadcast(busiest), entity, "left_semi")  # ``top`` rows
    bin_ = F.date_trunc(grain, ts).cast("timestamp_ntz").alias("bin")
    return rows.groupBy(entity, bin_).agg(F.count(F.lit(1)).alias("n"))


def spend_reconstruction(loans: DataFrame, purchases: DataFrame, slices=AUTO) -> DataFrame:
    """Orders placed from issuance to due date of each loan, next to what the loan says was spent.

    The sum over ``[issuance, due]`` is a running total at the due date minus the running total just before issuance,
    so a retailer's orders are never paired with its loans.
    """
    slices = resolve(slices, lambda: measure_sides(loans, purchases, "LOAN_ISSUANCE_DATE", "ORDER_CREATION_DATE", KEY))
    begin, due = F.col("LOAN_ISSUANCE_DATE"), F.col("INITIAL_DATE")
    orders = purchases.where(F.col(KEY).isNotNull() & F.col("ORDER_CREATION_DATE").isNotNull())
    facts = {f"_{n}": c for n, c in exact.parts(F.col("ORDER_PRICE"), kind=exact.amount_kinds(purchases, ["ORDER_PRICE"])["ORDER_PRICE"]).items()} | {"_one": F.lit(1).cast("long")}
    orders = orders.select(KEY, F.col("ORDER_CREATION_DATE").alias("_at"), F.lit(1).alias("_side"), *[c.alias(n) for n, c in facts.items()])
    cuts = F.array(
        F.struct(begin.alias("at"), F.lit(0).alias("side"), F.lit(-1).alias("sign")),
        F.struct(due.alias("at"), F.lit(2).alias("side"), F.lit(1).alias("sign")),
    )
    # a loan without retailer or with a missing or empty period has no orders
    whole = F.coalesce(F.col(KEY).isNotNull() & (begin <= due), F.lit(False))
    probes = loans.where(whole).select(KEY, "LOAN_ID", "SPENT", F.explode(cuts).alias("_p")).select(
        KEY, "LOAN_ID", "SPENT", F.col("_p.at").alias("_at"), F.col("_p.side").alias("_side"), F.col("_p.sign").alias("_sign")
    )
    events = orders.unionByName(probes, allowMissingColumns=True)
    totals = running(events, KEY, ["_at", "_side"], {f"{n}_sum": ("sum", F.col(n)) for n in facts}, slices)
    ends = totals.where(F.col("_sign").isNotNull()).select("LOAN_ID", "SPENT", "_sign", *[f"{n}_sum" for n in facts])
    ends = ends.unionByName(loans.where(~whole).select("LOAN_ID", "SPENT"), allowMissingColumns=True)
    moved = {n: F.sum(F.when(F.col("_sign") > 0, F.col(f"{n}_sum")).when(F.col("_sign") < 0, -F.col(f"{n}_sum"))) for n in facts}
    inside = {n[1:]: F.coalesce(c, F.lit(0)) for n, c in moved.items()}
    return ends.groupBy("LOAN_ID").agg(
        F.max("SPENT").alias("SPENT"), F.coalesce(exact.total(inside), F.lit(0.0)).alias("ordered"), inside["one"].cast("long").alias("n_orders")
    )
