"""Exact quantiles and value counts that need no task to hold a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.skew import Slices, apart, as_list, running


def _counted(df: DataFrame, keys: list[str], col: str, names: dict[str, float], slices: Slices) -> DataFrame:
    """Quantiles from counts per distinct value: repeated values collapse before the shuffle, heavy keys are sliced."""
    values = df.where(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count(F.lit(1)).alias("_c"))
    placed = running(values, keys, col, {"_upto": ("sum", F.col("_c"))}, slices)
    if keys:
        totals = values.groupBy(*keys).agg(F.sum("_c").alias("_n"))
        placed = placed.join(F.broadcast(totals), keys)  # heavy keys only: one row for each
        n = F.col("_n")
    else:
        n = values.agg(F.sum("_c")).scalar()
    below = F.col("_upto") - F.col("_c")

    def at(rank: Column) -> Column:
        return F.max(F.when((below <= rank) & (rank < F.col("_upto")), F.col(col)))

    picks, outs = [], []
    for i, (name, p) in enumerate(names.items()):
        place = F.lit(p) * (n - 1)
        picks += [at(F.floor(place)).alias(f"_lo{i}"), at(F.ceil(place)).alias(f"_hi{i}"), F.max(place - F.floor(place)).alias(f"_w{i}")]
        outs.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_w{i}")).alias(name))
    return placed.groupBy(*keys).agg(*picks).select(*keys, *outs)


def quantiles(df: DataFrame, keys: str | Sequence[str], col: str, names: dict[str, float], slices: Slices | None = None) -> DataFrame:
    """Quantiles with linear interpolation per key, one result column per entry of ``names``.

    Light keys use the built-in exact aggregate, whose buffer holds the key's distinct values: at most the rows below which
    a key counts as light, or 1/100,000 of the table where that is more; ``slices`` (from ``measure`` on ``col``) sends heavy keys through counted values.
    """
    keys = as_list(keys)

    def plan(rows: DataFrame, slices: Slices | None) -> DataFrame:
        if slices is None:
            return rows.groupBy(*keys).agg(*[F.percentile(col, p).alias(name) for name, p in names.items()])
        return _counted(rows, keys, col, names, slices)

    return apart(df, plan, slices)


def value_counts(df: DataFrame, columns: str | Sequence[str], name: str = "count") -> DataFrame:
    """Rows per value, most frequent first, ties in value order."""
    columns = as_list(columns)
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias(name)).orderBy(F.desc(name), *columns)


def equal_width_bins(df: DataFrame, col: str | Column, bins: int) -> DataFrame:
    """``bin, lower, upper, n`` for ``bins`` equal bins between the smallest and largest value; empty bins included.

    Two passes: the bounds, then one count per bin. Values on the upper bound belong to the last bin.
    """
    x = F.col(col) if isinstance(col, str) else col
    values = df.select(x.cast("double").alias("_x")).where(F.col("_x").isNotNull())
    bounds = values.agg(F.struct(F.min("_x").alias("lo"), F.max("_x").alias("hi")).alias("b"))
    limits = bounds.select("b").scalar()
    width = (limits["hi"] - limits["lo"]) / bins
    place = F.when(width > 0, F.least(F.floor((F.col("_x") - limits["lo"]) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))).otherwise(0)
    counts = values.groupBy(place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    frame = bounds.select(
        F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), F.col("b.lo").alias("lo"), ((F.col("b.hi") - F.col("b.lo")) / bins).alias("w")
    )
    full = frame.join(counts, "bin", "left")
    return full.select(
        "bin",
        (F.col("lo") + F.col("bin") * F.col("w")).alias("lower"),
        (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("upper"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def cumulative_share(bins: DataFrame) -> DataFrame:
    """Normalised cumulative form of a histogram; the input has one row per bin."""
    from pyspark.sql import Window

    upto = F.sum("n").over(Window.orderBy("bin"))
    total = bins.agg(F.sum("n")).scalar()
    return bins.select("*", (upto / total).alias("cumulative"))
