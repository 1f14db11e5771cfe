"""Bootstrap tests of borrowing against usual order volume."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from datetime import timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.skew import AUTO, Slices
from ledgerlens.operators.temporal import asof_join
from ledgerlens.schemas import KEY
from ledgerlens.session import materialise


def volume_limit(df: DataFrame, days: Sequence[int], std_of: str = "rolling_std") -> DataFrame:
    """``window, limit`` per window: mean of the rolling means plus a deviation, from one aggregation.

    The deviation is that of the rolling deviations, or of the rolling means with ``std_of="rolling_mean"``.
    """
    parts = []
    for d in days:
        spread = "ROLLINGSTDDEV" if std_of == "rolling_std" else "ROLLINGMEAN"
        parts.append((F.avg(f"ROLLINGMEAN_{d}DAYS__ORDER_PRICE__") + F.stddev_samp(f"{spread}_{d}DAYS__ORDER_PRICE__")).alias(f"w{d}"))
    rows = F.array(*[F.struct(F.lit(d).alias("window"), F.col(f"w{d}").alias("limit")) for d in days])
    return df.agg(*parts).select(F.inline(rows))


def hits_above(df: DataFrame, col: str, limits: DataFrame) -> DataFrame:
    """``window, limit, n, hits``: rows and rows strictly above each window's limit, from one pass over ``df``."""
    held = limits.agg(F.collect_list(F.struct("window", "limit")).alias("l")).select("l").scalar()  # one entry per window
    above = F.col(col) > F.col("_l.limit")
    return (
        df.select(col, F.explode(held).alias("_l"))
        .groupBy(F.col("_l.window").alias("window"), F.col("_l.limit").alias("limit"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(above, 1).otherwise(0)).alias("hits"))
    )


def bootstrap_share_ci(
    hits: DataFrame, rounds: int = 1000, frac: float = 0.3, seed: int = 7, low: float = 0.025, high: float = 0.975
) -> DataFrame:
    """Percentile interval of the share above the limit under resampling with replacement.

    A round draws ``frac * n`` rows with replacement, and the share only depends on how many of them are hits: that
    number is binomial. One draw per round replaces the resampling, whatever the table's size.
    """

    @F.pandas_udf("double")
    def draw(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for window, round_, n, hit in batches:
            out = []
            for w, r, size, h in zip(window, round_, n, hit):
                m = max(1, int(round(frac * size)))
                out.append(np.random.default_rng([seed, int(w), int(r)]).binomial(m, h / size) / m)
            yield pd.Series(out)

    trials = hits.where("n > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round"))
    shares = trials.withColumn("share", draw("window", "round", "n", "hits"))
    bounds = F.percentile("share", F.array(F.lit(low), F.lit(high)))  # ``rounds`` values per window
    return shares.groupBy("window", "limit", "n", "hits").agg(bounds.alias("b")).select(
        "window", "limit", "n", "hits", F.col("b")[0].alias("lower"), F.col("b")[1].alias("upper")
    )


def verdict(intervals: DataFrame, reject_above: float = 0.2) -> DataFrame:
    """Reject when the lower bound exceeds the threshold; with the sentence the report prints."""
    reject = F.col("lower") > reject_above
    asked = F.when(reject, "more often than tolerated").otherwise("no more often than tolerated")
    return intervals.select(
        "*",
        reject.alias("reject"),
        F.format_string("Loans exceed the limit of the last %d days %s", "window", asked).alias("finding"),
        F.format_string("share between %.4f and %.4f", "lower", "upper").alias("interval_text"),
    )


def volume_test(joined: DataFrame, days: Sequence[int], rounds: int = 1000, frac: float = 0.3, seed: int = 7, reject_above: float = 0.2) -> DataFrame:
    """Do loans exceed the usual volume? Limit, share above it, bootstrap interval and verdict per window.

    The limit needs the whole join before the first share can be counted, so the few columns both passes use are
    written once.
    """
    windows = [f"ROLLING{k}_{d}DAYS__ORDER_PRICE__" for d in days for k in ("MEAN", "STDDEV")]
    rows = materialise(joined.select("LOAN_AMOUNT", *windows))
    hits = hits_above(rows, "LOAN_AMOUNT", volume_limit(rows, days))
    return verdict(bootstrap_share_ci(hits, rounds, frac, seed), reject_above)


def poisson_thresholds(upto: int = 20) -> list[float]:
    """Cumulative Poisson(1) probabilities of 0 .. ``upto`` - 1; beyond them lies less than one step of a draw."""
    return [math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1)) for k in range(upto)]


#: Fixed values of a 64-bit mixer: the step from one round to the next, and two multipliers with the shifts before them.
STEP, MIXERS, LAST_SHIFT = 0x9E3779B97F4A7C15, ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)), 31
#: Rows that are weighed at once.
CHUNK = 1024


def round_weights(base: np.ndarray, rounds: int) -> np.ndarray:
    """Poisson(1) weights, a row per round and a column per 64-bit number; they depend on nothing else, so a retried task
    repeats them."""
    with np.errstate(over="ignore"):
        z = base[None, :] + np.arange(1, rounds + 1, dtype=np.uint64)[:, None] * np.uint64(STEP)
        for shift, factor in MIXERS:
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        z ^= z >> np.uint64(LAST_SHIFT)
    bounds = np.array([math.ceil(p * 2**53) for p in poisson_thresholds()], dtype=np.uint64)
    draws, weights = z >> np.uint64(11), np.zeros(z.shape)
    for bound in bounds:
        reached = draws >= bound
        if not reached.any():
            break
        weights += reached
    return weights


def poisson_bootstrap(df: DataFrame, key: str, value: str, rounds: int = 1000) -> DataFrame:
    """Weighted mean and sum of ``value`` per bootstrap round; rows without a value have no weight.

    A row's key is hashed once, and its weights in all rounds come from that number by a few multiplications over whole
    batches. Each task sums all rounds of its rows, so one row per round and task is shuffled.
    """
    base = F.unhex(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, 16))
    rows = df.select(base.alias("h"), F.col(value).cast("double").alias("x")).where("x IS NOT NULL")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, total = np.zeros(rounds), np.zeros(rounds)
        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column(0).to_pylist()), ">u8").astype(np.uint64)
            values = batch.column(1).to_numpy()
            for i in range(0, len(keys), CHUNK):
                w = round_weights(keys[i : i + CHUNK], rounds)
                weight += w.sum(axis=1)
                total += w @ values[i : i + CHUNK]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(rounds), pa.int32()), pa.array(weight.astype(np.int64)), pa.array(total)], names=["round", "weight", "total"])

    parts = rows.mapInArrow(weigh, "round int, weight long, total double")
    sums = parts.groupBy("round").agg(F.sum("weight").alias("weight"), F.sum("total").alias("total"))
    return sums.select("round", "weight", "total", F.try_divide("total", F.col("weight").cast("double")).alias("mean"))


def percentile_interval(df: DataFrame, col: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Percentile interval over bootstrap rounds."""
    return df.agg(F.percentile(col, F.array(F.lit(low), F.lit(high))).alias("b")).select(F.col("b")[0].alias("lower"), F.col("b")[1].alias("upper"))


def nearest_orders(loans: DataFrame, purchases: DataFrame, slices: Slices | str | None = AUTO) -> DataFrame:
    """Each loan with its latest order; a tolerance only hides matches, so one join serves every tolerance."""
    probes = loans.select("LOAN_ID", KEY, "LOAN_ISSUANCE_DATE", "PAYMENT_STATUS")
    points = purchases.select(KEY, "ORDER_CREATION_DATE")
    return asof_join(probes, points, "LOAN_ISSUANCE_DATE", "ORDER_CREATION_DATE", KEY, slices=slices)


def _with_tolerances(nearest: DataFrame, tolerances: Sequence[int]) -> DataFrame:
    issued, ordered = F.col("LOAN_ISSUANCE_DATE"), F.col("ORDER_CREATION_DATE")
    hits = [
        F.struct(
            F.lit(t).alias("tolerance"),
            F.coalesce((ordered + F.lit(timedelta(days=t)) >= issued) & (issued > ordered), F.lit(False)).alias("matched"),
        )
        for t in tolerances
    ]
    return nearest.select(KEY, "LOAN_ID", "PAYMENT_STATUS", F.inline(F.array(*hits)))


def asof_coverage(nearest: DataFrame, tolerances: Sequence[int]) -> DataFrame:
    """Loans, matched loans and share, and retailers without any matched loan, per tolerance."""
    per_retailer = _with_tolerances(nearest, tolerances).groupBy("tolerance", KEY).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("matched").cast("int")).alias("m")
    )
    totals = per_retailer.groupBy("tolerance").agg(
        F.sum("n").alias("loans"), F.sum("m").alias("matched"), F.sum(F.when(F.col("m") == 0, 1).otherwise(0)).alias("lost_retailers")
    )
    return totals.select("tolerance", "loans", "matched", "lost_retailers", F.round(F.col("matched") / F.col("loans"), 6).alias("matched_share"))


def lost_by_status(nearest: DataFrame, tolerances: Sequence[int]) -> DataFrame:
    """Loans without a recent order, by payment status."""
    lost = _with_tolerances(nearest, tolerances).where("NOT matched")
    return lost.groupBy("tolerance", "PAYMENT_STATUS").agg(F.count(F.lit(1)).alias("n_lost"))
