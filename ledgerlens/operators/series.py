"""Time-series features of one value per key, as aggregates.

The series of a key is its rows in a total order. Every feature is a sum, count or extreme over rows that carry their
position, a few neighbours and their key's statistics, so a series of any length is folded map-side before it is
shuffled; ``slices`` (see ``skew``) cuts the ordering of heavy keys.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.exact import exact_sum, parts, total
from ledgerlens.functions.scalar import flag, seconds
from ledgerlens.operators.quantiles import quantiles
from ledgerlens.operators.skew import Slices, apart, as_list, attach, cut, heavy_keys, running, windowed

POS = "_pos"


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def _series(df: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).select(key, *as_list(order), F.col(value).cast("double").alias("x"))


def _placed(df: DataFrame, key: str, order: Sequence[str], value: str, back: int, ahead: int, slices: Slices | None) -> DataFrame:
    """Rows with position, ``b1..`` earlier and ``a1..`` later values."""

    def build(w) -> dict[str, Column]:
        cols = {f"b{i}": F.lag("x", i).over(w) for i in range(1, back + 1)}
        return cols | {f"a{i}": F.lead("x", i).over(w) for i in range(1, ahead + 1)}

    return windowed(_series(df, key, order, value), key, order, build, back, ahead, slices, position=POS)


def _stats(df: DataFrame, key: str, value: str, ts: str | None = None) -> DataFrame:
    """One row per key: rows, mean, deviation, extremes and, with ``ts``, the first time."""
    x = F.col(value).cast("double")
    first = [F.min(ts).alias("_t0")] if ts else []
    return df.where(x.isNotNull()).groupBy(key).agg(
        F.count(x).alias("n"), F.avg(x).alias("mu"), F.stddev_pop(x).alias("sd"), F.min(x).alias("lo"), F.max(x).alias("hi"), *first
    )


def _moment_exprs() -> list[Column]:
    x = F.col("x")
    n = F.count(x)
    return [
        n.alias("length"),
        exact_sum(x).alias("sum_values"),
        F.sum(x * x).alias("abs_energy"),
        F.avg(x).alias("mean"),
        F.min(x).alias("minimum"),
        F.max(x).alias("maximum"),
        F.max(F.abs(x)).alias("absolute_maximum"),
        F.var_pop(x).alias("variance"),
        F.stddev_pop(x).alias("standard_deviation"),
        F.sqrt(F.avg(x * x)).alias("root_mean_square"),
        F.try_divide(F.stddev_pop(x), F.avg(x)).alias("variation_coefficient"),
        F.when(n > 2, F.skewness(x)).alias("skewness"),
        F.when(n > 2, F.kurtosis(x)).alias("kurtosis"),
    ]


def _values(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).select(key, F.col(value).cast("double").alias("x"))


def moments(df: DataFrame, key: str, value: str, slices: Slices | None = None) -> DataFrame:
    """Energy, level, spread and shape (population moments); ``slices`` measured on ``value``."""

    def plan(df: DataFrame, slices: Slices | None) -> DataFrame:
        facts = _values(df, key, value).groupBy(key).agg(*_moment_exprs())
        return facts.join(quantiles(df, key, value, {"median": 0.5}, slices), key)

    return apart(df, plan, slices)


def _threshold_exprs(t: float = 0.0, low: float = -1.0, high: float = 1.0, v: float = 0.0, r: float = 1.0, share: float = 0.25) -> list[Column]:
    x, mu, sd = F.col("x"), F.col("mu"), F.col("sd")
    span = F.max("hi") - F.max("lo")
    return [
        F.sum(flag(x > t)).alias("count_above"),
        F.sum(flag(x < t)).alias("count_below"),
        F.sum(flag(x > mu)).alias("count_above_mean"),
        F.sum(flag(x < mu)).alias("count_below_mean"),
        F.sum(flag((x >= low) & (x < high))).alias("range_count"),
        F.sum(flag(x == v)).alias("value_count"),
        F.avg(flag(F.abs(x - mu) > r * sd)).alias("ratio_beyond_sigma"),
        (F.max("sd") > share * span).alias("large_standard_deviation"),
        (F.max("sd") * F.max("sd") > F.max("sd")).alias("variance_larger_than_std"),
        F.max("mu").alias("_mu"),
        span.alias("_span"),
    ]


def _symmetry(median: str, share: float = 0.25) -> Column:
    return (F.abs(F.col("_mu") - F.col(median)) < share * F.col("_span")).alias("symmetry_looking")


def thresholds(
    df: DataFrame, key: str, value: str, t: float = 0.0, low: float = -1.0, high: float = 1.0, v: float = 0.0, r: float = 1.0, share: float = 0.25, slices: Slices | None = None
) -> DataFrame:
    """Counts against fixed limits and against the key's own mean and deviation."""

    def plan(df: DataFrame, slices: Slices | None) -> DataFrame:
        rows = attach(_values(df, key, value), _stats(df, key, value), key, slices)
        facts = rows.groupBy(key).agg(*_threshold_exprs(t, low, high, v, r, share))
        middle = quantiles(df, key, value, {"_median": 0.5}, slices)
        return facts.join(middle, key).select(*[c for c in facts.columns if not c.startswith("_")], _symmetry("_median", share))

    return apart(df, plan, slices)


def repetition(df: DataFrame, key: str, value: str, top: int = 3) -> DataFrame:
    """Duplicates and reoccurring values from counts per (key, value); mean of the largest absolute values."""
    x = F.col(value).cast("double")
    counts = df.where(x.isNotNull()).groupBy(key, x.alias("x")).agg(F.count(F.lit(1)).alias("c"))
    again = F.col("c") > 1
    low, high = F.min(F.struct("x", "c"))["c"], F.max(F.struct("x", "c"))["c"]
    facts = counts.groupBy(key).agg(
        F.max(again).alias("has_duplicate"),
        (low > 1).alias("has_duplicate_min"),
        (high > 1).alias("has_duplicate_max"),
        (F.sum(flag(again)) / F.count(F.lit(1))).alias("reoccurring_values_share"),
        (F.sum(F.when(again, F.col("c")).otherwise(0)) / F.sum("c")).alias("reoccurring_points_share"),
        F.coalesce(exact_sum(F.when(again, F.col("x"))), F.lit(0.0)).alias("sum_reoccurring_values"),
        F.coalesce(exact_sum(F.when(again, F.col("x") * F.col("c"))), F.lit(0.0)).alias("sum_reoccurring_points"),
        (F.count(F.lit(1)) / F.sum("c")).alias("distinct_share"),
    )
    size = F.abs(x)
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("size")))
    largest = df.where(x.isNotNull()).select(key, size.alias("size")).withColumn("_p", place).where(F.col("_p") <= top)
    return facts.join(largest.groupBy(key).agg((F.sum("size") / F.count("size")).alias("mean_n_absolute_max")), key)


def distribution(df: DataFrame, key: str, order: Sequence[str], value: str, qs: Sequence[float] = (0.1, 0.9), bins: int = 10, mass: float = 0.5, slices: Slices | None = None, value_slices: Slices | None = None) -> DataFrame:
    """Quantiles, entropy over equal bins, agreement with Benford's law and the place where ``mass`` of |x| is reached."""

    def plan(df: DataFrame, slices: Slices | None, value_slices: Slices | None) -> DataFrame:
        frames = [quantiles(df, key, value, {f"quantile_{str(q).replace('.', '_')}": q for q in qs}, value_slices)]
        rows = df.where(F.col(value).isNotNull()).select(key, F.col(value).cast("double").alias("x"))
        rows = attach(rows, _stats(df, key, value), key, slices)
        width = (F.col("hi") - F.col("lo")) / bins
        bin_ = F.when(width > 0, F.least(F.floor((F.col("x") - F.col("lo")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))).otherwise(0)
        share = _ratio(F.col("c"), F.col("n"))
        cells = rows.groupBy(key, bin_.alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n"))
        frames.append(cells.groupBy(key).agg((-F.sum(share * F.log(share))).alias("binned_entropy")))

        digit = F.regexp_extract(F.abs("x").cast("string"), "[1-9]", 0)
        expected = [math.log10(1 + 1 / d) for d in range(1, 10)]
        tallies = rows.where(F.col("x") != 0).groupBy(key).agg(*[F.sum(flag(digit == str(d))).cast("double").alias(f"d{d}") for d in range(1, 10)])
        got = [F.col(f"d{d}") for d in range(1, 10)]
        sx, sxx = reduce(lambda a, b: a + b, got), reduce(lambda a, b: a + b, [g * g for g in got])
        se, see = sum(expected), sum(e * e for e in expected)
        sxe = reduce(lambda a, b: a + b, [g * e for g, e in zip(got, expected)])
        corr = F.try_divide(9 * sxe - sx * se, F.sqrt((9 * sxx - sx * sx) * F.lit(9 * see - se * se)))
        frames.append(tallies.select(key, corr.alias("benford_correlation")))

        size = parts(F.abs(F.col("x")))
        placed = _placed(df, key, order, value, 0, 0, slices)
        upto = running(placed, key, POS, {f"_{n}": ("sum", c) for n, c in size.items()}, slices and slices.by_position(), peers=False)
        totals = placed.groupBy(key).agg(exact_sum(F.abs(F.col("x"))).alias("_total"), F.count(F.lit(1)).alias("_rows"))
        reached = F.min(F.when(total({n: F.col(f"_{n}") for n in size}) >= mass * F.col("_total"), F.col(POS)))
        frames.append(attach(upto, totals, key, slices).groupBy(key).agg(_ratio(reached, F.max("_rows")).alias("index_mass_quantile")))
        return reduce(lambda a, b: a.join(b, key, "left"), frames)

    return apart(df, plan, slices, value_slices)


def _change_exprs() -> list[Column]:
    x, b, a = F.col("x"), F.col("b1"), F.col("a1")
    step = x - b
    inside = x.between(F.col("_ql"), F.col("_qh")) & b.between(F.col("_ql"), F.col("_qh"))
    return [
        F.avg(step).alias("mean_change"),
        F.avg(F.abs(step)).alias("mean_abs_change"),
        F.coalesce(F.sum(F.abs(step)), F.lit(0.0)).alias("absolute_sum_of_changes"),
        F.avg((a - 2 * x + b) / 2).alias("mean_second_derivative"),
        F.coalesce(F.sqrt(F.sum(step * step)), F.lit(0.0)).alias("cid_ce"),
        F.coalesce(F.avg(F.when(inside, F.abs(step))), F.lit(0.0)).alias("change_quantiles_mean"),
        F.coalesce(F.var_pop(F.when(inside, F.abs(step))), F.lit(0.0)).alias("change_quantiles_var"),
    ]


def changes(df: DataFrame, key: str, order: Sequence[str], value: str, ql: float = 0.1, qh: float = 0.9, slices: Slices | None = None, value_slices: Slices | None = None) -> DataFrame:
    """Changes between neighbours, second derivative, complexity, and changes inside a quantile corridor."""

    def plan(df: DataFrame, slices: Slices | None, value_slices: Slices | None) -> DataFrame:
        corridor = quantiles(df, key, value, {"_ql": ql, "_qh": qh}, value_slices)
        return attach(_placed(df, key, order, value, 1, 1, slices), corridor, key, slices).groupBy(key).agg(*_change_exprs())

    return apart(df, plan, slices, value_slices)


def _position_exprs(m: float = 0.0, support: int = 1) -> list[Column]:
    x, at, n = F.col("x"), F.col(POS), F.max("n")
    around = [x > F.col(f"{s}{i}") for i in range(1, support + 1) for s in "ba"]
    return [
        ((F.max(F.struct(x, (-at).alias("at")))["at"] * -1 - 1) / n).alias("first_location_of_maximum"),
        (F.max(F.struct(x, at.alias("at")))["at"] / n).alias("last_location_of_maximum"),
        ((F.min(F.struct(x, at.alias("at")))["at"] - 1) / n).alias("first_location_of_minimum"),
        (F.min(F.struct(x, (-at).alias("at")))["at"] * -1 / n).alias("last_location_of_minimum"),
        F.sum(flag((x > m) != (F.col("b1") > m))).alias("number_crossing"),
        F.sum(flag(reduce(lambda p, q: p & q, around))).alias("number_peaks"),
    ]


def _strikes(rows: DataFrame, key: str, slices: Slices | None) -> DataFrame:
    """Longest runs above and below the mean; a run is folded to one row before the key is grouped."""
    x, b, mu = F.col("x"), F.col("b1"), F.col("mu")
    side = F.when(x > mu, 1).when(x < mu, -1).otherwise(0)
    before = F.when(b > mu, 1).when(b < mu, -1).otherwise(0)
    turned = flag(b.isNotNull() & (side != before)).cast("long")
    narrow = rows.select(key, POS, side.alias("_side"), turned.alias("_turned"))
    runs = running(narrow, key, POS, {"_run": ("sum", F.col("_turned"))}, slices and slices.by_position(), peers=False)
    lengths = runs.groupBy(key, "_run").agg(F.max("_side").alias("_side"), F.count(F.lit(1)).alias("_len"))

    def longest(s: int) -> Column:
        return F.coalesce(F.max(F.when(F.col("_side") == s, F.col("_len"))), F.lit(0))

    return lengths.groupBy(key).agg(longest(1).alias("longest_strike_above_mean"), longest(-1).alias("longest_strike_below_mean"))


def positions(df: DataFrame, key: str, order: Sequence[str], value: str, m: float = 0.0, support: int = 1, slices: Slices | None = None) -> DataFrame:
    """Where extremes lie, longest runs around the mean, crossings of ``m`` and peaks of a given support."""

    def plan(df: DataFrame, slices: Slices | None) -> DataFrame:
        placed = _placed(df, key, order, value, max(support, 1), support, slices)
        rows = attach(placed, _stats(df, key, value), key, slices)
        return rows.groupBy(key).agg(*_position_exprs(m, support)).join(_strikes(rows, key, slices), key)

    return apart(df, plan, slices)


#: The largest lag of the partial autocorrelation.
PARTIAL = 5


def _predictors(facts: DataFrame, order: int) -> DataFrame:
    """Add ``_f{k}_1 .. _f{k}_{k}``, the coefficients of the best linear predictors of each order k, from autocorrelations ``_r1, _r2, ..``
    (Durbin-Levinson). Each order is a projection of its own: it names the order before many times."""
    total = lambda terms: reduce(lambda a, b: a + b, terms)
    for k in range(1, order + 1):
        if k == 1:
            facts = facts.withColumn("_f1_1", F.col("_r1"))
            continue
        before = [F.col(f"_f{k - 1}_{j}") for j in range(1, k)]
        top = F.col(f"_r{k}") - total([f * F.col(f"_r{k - j}") for j, f in enumerate(before, 1)])
        bottom = 1 - total([f * F.col(f"_r{j}") for j, f in enumerate(before, 1)])
        last = F.col(f"_f{k}_{k}")
        facts = facts.withColumn(f"_f{k}_{k}", F.try_divide(top, bottom))
        facts = facts.withColumns({f"_f{k}_{j}": f - last * before[k - 1 - j] for j, f in enumerate(before, 1)})
    return facts


def _lag_exprs(lags: int = 3, partial: int = PARTIAL) -> list[Column]:
    x, mu, exprs = F.col("x"), F.col("mu"), []
    for lag in range(1, max(lags, partial) + 1):
        cross = F.sum((x - mu) * (F.col(f"b{lag}") - mu))
        if lag <= lags:
            exprs.append(F.try_divide(cross, (F.max("n") - lag) * F.max("sd") * F.max("sd")).alias(f"autocorrelation_{lag}"))
        exprs.append(F.try_divide(F.coalesce(cross, F.lit(0.0)), F.max("n") * F.max("sd") * F.max("sd")).alias(f"_r{lag}"))
    for lag in range(1, lags + 1):
        p, q = F.col(f"b{lag}"), F.col(f"b{2 * lag}")
        exprs.append(F.avg(x * p * q).alias(f"c3_{lag}"))
        exprs.append(F.avg(x * x * p - p * q * q).alias(f"time_reversal_asymmetry_{lag}"))
    return exprs


def _lag_finish(lags: int = 3, partial: int = PARTIAL) -> list[Column]:
    """Mean and variance over lags and the predictors, from the aggregates of ``_lag_exprs``, ``_n`` and ``_predictors``."""
    auto = [F.col(f"autocorrelation_{i}") for i in range(1, lags + 1)]
    known = reduce(lambda a, b: a + b, [F.coalesce(a, F.lit(0.0)) for a in auto])
    count = reduce(lambda a, b: a + b, [flag(a.isNotNull()) for a in auto])
    squares = reduce(lambda a, b: a + b, [F.coalesce(a * a, F.lit(0.0)) for a in auto])
    mean = F.try_divide(known, count)
    reach = F.col("_n") > F.lit(partial)
    return [
        mean.alias("autocorrelation_mean"),
        (F.try_divide(squares, count) - mean * mean).alias("autocorrelation_var"),
        *[F.when(F.col("_n") > k, F.col(f"_f{k}_{k}")).alias(f"partial_autocorrelation_{k}") for k in range(1, partial + 1)],
        *[F.when(reach, F.col(f"_f{partial}_{j}")).alias(f"ar_coefficient_{j}") for j in range(1, partial + 1)],
    ]


def lag_statistics(df: DataFrame, key: str, order: Sequence[str], value: str, lags: int = 3, partial: int = PARTIAL, slices: Slices | None = None) -> DataFrame:
    """Autocorrelation and its mean and variance over lags, partial autocorrelation, autoregressive coefficients
    (Yule-Walker), c3 and time reversal asymmetry. Lags a series does not have are NULL."""

    def plan(df: DataFrame, slices: Slices | None) -> DataFrame:
        placed = _placed(df, key, order, value, max(lags, partial, 2 * lags), 0, slices)
        facts = attach(placed, _stats(df, key, value), key, slices).groupBy(key).agg(*_lag_exprs(lags, partial), F.max("n").alias("_n"))
        shown = [c for c in facts.columns if not c.startswith("_")]
        return _predictors(facts, partial).select(*shown, *_lag_finish(lags, partial))

    return apart(df, plan, slices)


def _trend_exprs(ts: str, segments: int = 4) -> list[Column]:
    x, i = F.col("x"), (F.col(POS) - 1).cast("double")
    hours = (seconds(F.col(ts)) - seconds(F.col("_t0"))) / 3600
    place = F.floor((F.col(POS) - 1) * segments / F.col("n"))
    return [
        F.regr_slope(x, i).alias("linear_trend_slope"),
        F.regr_intercept(x, i).alias("linear_trend_intercept"),
        F.try_divide(F.covar_pop(x, i), F.stddev_pop(x) * F.stddev_pop(i)).alias("linear_trend_r"),
        F.regr_slope(x, hours).alias("linear_trend_hourly_slope"),
        *[_ratio(F.sum(F.when(place == s, x * x).otherwise(0.0)), F.sum(x * x)).alias(f"energy_ratio_{s}") for s in range(segments)],
    ]


def _chunk_trends(rows: DataFrame, key: str, chunk: int = 3) -> DataFrame:
    chunks = rows.groupBy(key, F.floor((F.col(POS) - 1) / chunk).alias("c")).agg(F.avg("x").alias("m"), F.max("x").alias("h"))
    c = F.col("c").cast("double")
    return chunks.groupBy(key).agg(F.regr_slope("m", c).alias("chunk_mean_slope"), F.regr_slope("h", c).alias("chunk_max_slope"))


def trends(df: DataFrame, key: str, order: Sequence[str], value: str, chunk: int = 3, segments: int = 4, slices: Slices | None = None) -> DataFrame:
    """Linear trend over position and elapsed hours, trend of chunk means, share of energy per segment."""
    ts = as_list(order)[0]

    def plan(df: DataFrame, slices: Slices | None) -> DataFrame:
        rows = attach(_placed(df, key, order, value, 0, 0, slices), _stats(df, key, value, ts), key, slices)
        return rows.groupBy(key).agg(*_trend_exprs(ts, segments)).join(_chunk_trends(rows, key, chunk), key)

    return apart(df, plan, slices)


def _fourier_exprs(k: int = 3) -> list[Column]:
    turn, exprs = 2 * math.pi * (F.col(POS) - 1) / F.col("n"), []
    for j in range(k):
        exprs += [F.sum(F.col("x") * F.cos(turn * j)).alias(f"_re{j}"), F.sum(-F.col("x") * F.sin(turn * j)).alias(f"_im{j}")]
    return exprs


def _fourier_finish(k: int = 3) -> list[Column]:
    """A series of n values has n // 2 + 1 distinct coefficients."""
    has = [F.col("_n") >= 2 * j for j in range(k)]
    outs = [F.when(has[j], F.col(f"_{short}{j}")).alias(f"fft_{name}_{j}") for j in range(k) for short, name in (("re", "real"), ("im", "imag"))]
    return outs + [F.when(has[j], F.hypot(f"_re{j}", f"_im{j}")).alias(f"fft_abs_{j}") for j in range(k)]


def fourier_coefficients(df: DataFrame, key: str, order: Sequence[str], value: str, k: int = 3, slices: Slices | None = None) -> DataFrame:
    """Real part, imaginary part and magnitude of the first discrete Fourier coefficients, as sums over rows."""

    def plan(df: DataFrame, slices: Slices | None) -> DataFrame:
        rows = attach(_placed(df, key, order, value, 0, 0, slices), _stats(df, key, value), key, slices)
        return rows.groupBy(key).agg(*_fourier_exprs(k), F.max("n").alias("_n")).select(key, *_fourier_finish(k))

    return apart(df, plan, slices)


def power_spectrum(df: DataFrame, key: str, order: Sequence[str], value: str, size: int = 8, bins: int = 10, slices: Slices | None = None) -> DataFrame:
    """Averaged power over half-overlapping Hann segments of ``size`` rows, its centroid, variance and binned entropy.

    A row belongs to at most two segments. The mean of a segment is removed through the known sums of the window, so a
    segment needs no second pass. A series shorter than one segment has NULLs.
    """

    def plan(df: DataFrame, slices: Slices | None) -> DataFrame:
        half, freqs = size // 2, size // 2 + 1
        hann = [0.5 - 0.5 * math.cos(2 * math.pi * i / size) for i in range(size)]
        scale = sum(w * w for w in hann)
        rows = attach(_placed(df, key, order, value, 0, 0, slices), _stats(df, key, value).select(key, "n"), key, slices)
        at = F.col(POS) - 1
        last = F.floor((F.col("n") - size) / half)
        own = F.floor(at / half)
        segment = F.explode(F.filter(F.array(own, own - 1), lambda s: (s >= 0) & (s <= last)))
        placed = rows.where(F.col("n") >= size).select(key, "x", at.alias("_at"), segment.alias("s"))
        inside = (F.col("_at") - F.col("s") * half).cast("int")
        window = F.element_at(F.array(*[F.lit(w) for w in hann]), inside + 1)
        turn = 2 * math.pi * inside / size
        sums = [F.avg("x").alias("_m")]
        for j in range(freqs):
            sums += [F.sum(F.col("x") * window * F.cos(turn * j)).alias(f"_c{j}"), F.sum(F.col("x") * window * F.sin(turn * j)).alias(f"_s{j}")]
        parts = placed.groupBy(key, "s").agg(*sums)
        powers = []
        for j in range(freqs):
            wc = sum(w * math.cos(2 * math.pi * i * j / size) for i, w in enumerate(hann))
            ws = sum(w * math.sin(2 * math.pi * i * j / size) for i, w in enumerate(hann))
            re, im = F.col(f"_c{j}") - F.col("_m") * wc, F.col(f"_s{j}") - F.col("_m") * ws
            double = 1 if j in (0, half) else 2
            powers.append((F.avg(re * re + im * im) * double / scale).alias(f"power_{j}"))
        spectrum = parts.groupBy(key).agg(*powers)
        p = [F.col(f"power_{j}") for j in range(freqs)]
        total = reduce(lambda a, b: a + b, p)
        first = _ratio(reduce(lambda a, b: a + b, [c * j for j, c in enumerate(p)]), total)
        second = _ratio(reduce(lambda a, b: a + b, [c * j * j for j, c in enumerate(p)]), total)
        top = F.greatest(*p)
        cell = [F.least(F.floor(F.coalesce(_ratio(c, top), F.lit(0.0)) * bins), F.lit(bins - 1)) for c in p]
        shares = [reduce(lambda a, b: a + b, [flag(c == b_) for c in cell]) / F.lit(float(freqs)) for b_ in range(bins)]
        entropy = reduce(lambda a, b: a + b, [F.when(s > 0, -s * F.log(s)).otherwise(0.0) for s in shares])
        found = spectrum.select(key, *p, first.alias("spectral_centroid"), (second - first * first).alias("spectral_variance"), entropy.alias("fourier_entropy"))
        short = _stats(df, key, value).where(F.col("n") < size).select(key)
        return found.unionByName(short, allowMissingColumns=True)

    return apart(df, plan, slices)


def _order_patterns(rows: DataFrame, key: str, dimension: int = 3) -> DataFrame:
    values = [F.col("x"), *[F.col(f"a{i}") for i in range(1, dimension)]]
    ranked = F.array_sort(F.array(*[F.struct(v.alias("v"), F.lit(i).alias("i")) for i, v in enumerate(values)]))
    pattern = F.concat_ws("", F.transform(ranked, lambda e: e["i"].cast("string")))
    # a series too short for a pattern keeps its row: its only group has no pattern and counts nothing
    whole = values[-1].isNotNull()
    counts = rows.groupBy(key, F.when(whole, pattern).alias("p")).agg(F.sum(whole.cast("double")).alias("c"))
    n, c = F.sum("c"), F.when(F.col("c") > 0, F.col("c"))
    found = F.greatest(F.log(n) - F.sum(c * F.log(c)) / n, F.lit(0.0))
    return counts.groupBy(key).agg(F.when(n > 0, found).alias("permutation_entropy"))


def permutation_entropy(df: DataFrame, key: str, order: Sequence[str], value: str, dimension: int = 3, slices: Slices | None = None) -> DataFrame:
    """Entropy of the order patterns of ``dimension`` successive values; equal values rank by position."""

    def plan(df: DataFrame, slices: Slices | None) -> DataFrame:
        return _order_patterns(_placed(df, key, order, value, 0, dimension - 1, slices), key, dimension)

    return apart(df, plan, slices)


def _one_pass(df: DataFrame, key: str, order: Sequence[str], value: str, slices: Slices | None, value_slices: Slices | None) -> DataFrame:
    """All families that are aggregates of placed rows: one shuffle of the series, two groupings for most features."""
    ts = order[0]

    def plan(df: DataFrame, slices: Slices | None, value_slices: Slices | None) -> DataFrame:
        cuts = quantiles(df, key, value, {"_ql": 0.1, "_qh": 0.9, "median": 0.5}, value_slices)
        facts = _stats(df, key, value, ts).join(cuts, key)
        rows = attach(_placed(df, key, order, value, 6, 2, slices), facts, key, slices)
        # two groupings, so that either one's buffers stay below the 100 fields up to which Spark generates code
        level = rows.groupBy(key).agg(F.max("median").alias("median"), *_moment_exprs(), *_threshold_exprs(), *_change_exprs(), *_position_exprs())
        course = rows.groupBy(key).agg(F.max("n").alias("_n"), *_lag_exprs(), *_trend_exprs(ts), *_fourier_exprs())
        wide = level.join(course, key)
        shown = [c for c in wide.columns if not c.startswith("_")]
        done = _predictors(wide, PARTIAL).select(*shown, _symmetry("median"), *_lag_finish(), *_fourier_finish())
        others = [_strikes(rows, key, slices), _chunk_trends(rows, key), _order_patterns(rows, key)]
        return reduce(lambda a, b: a.join(b, key, "left"), [done, *others])

    return apart(df, plan, slices, value_slices)


def ts_features(df: DataFrame, key: str, order: Sequence[str], value: str, prefix: str = "", **limits) -> DataFrame:
    """All families of a series joined on the key, with names prefixed."""
    order = as_list(order)
    hot = heavy_keys(df, key, **limits)
    slices, by_value = cut(df, key, order[0], hot), cut(df, key, value, hot)
    frames = [
        _one_pass(df, key, order, value, slices, by_value),
        repetition(df, key, value),
        distribution(df, key, order, value, slices=slices, value_slices=by_value),
        power_spectrum(df, key, order, value, slices=slices),
    ]
    named = [f.select(key, *[F.col(c).alias(prefix + c) for c in f.columns if c != key]) for f in frames]
    return reduce(lambda a, b: a.join(b, key, "left"), named)
