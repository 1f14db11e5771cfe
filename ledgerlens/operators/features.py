"""Feature synthesis: aggregates of child tables per retailer, transforms of loan columns, point-in-time aggregates.

Every function works on all retailers at once; the retailer is a grouping key, never a loop.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from datetime import datetime
from functools import reduce
from math import exp, log
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions import exact
from ledgerlens.functions.scalar import elapsed, flag, seconds
from ledgerlens.operators.quantiles import quantiles
from ledgerlens.operators.skew import Slices, apart, as_list, attach, cut, heavy_keys, running, windowed

BATCH = 200
AGG_BATCH = 24  # statistics per grouping: their buffers stay below the 100 fields up to which Spark generates code


@dataclass(frozen=True)
class Entity:
    """A table with its row id, time column and columns that only become known at another time."""

    df: DataFrame
    index: str
    time: str | None = None
    secondary: dict[str, list[str]] = field(default_factory=dict)
    ignored: tuple[str, ...] = ()

    def numeric(self) -> list[str]:
        """Amount columns: numeric and not ignored, in the table's order."""
        return [f.name for f in self.df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in self.ignored]


@dataclass(frozen=True)
class EntitySet:
    """Tables that hang off one parent key; a child may have no rows for a parent."""

    key: str
    target: str
    entities: dict[str, Entity]

    def children(self) -> dict[str, Entity]:
        return {n: e for n, e in self.entities.items() if n != self.target}

    def restricted(self, keys: DataFrame, how: str) -> EntitySet:
        """The same tables with the rows that are (``left_semi``) or are not (``left_anti``) of the given keys."""
        return replace(self, entities={n: replace(e, df=e.df.join(keys, self.key, how)) for n, e in self.entities.items()})


class Feature(NamedTuple):
    """A derived column with its recipe."""

    name: str
    family: str
    sources: tuple[str, ...]
    params: str
    column: Column


def feature_defs(spark: SparkSession, features: Sequence[Feature]) -> DataFrame:
    """``name, family, source_cols, params`` of generated features."""
    rows = sorted({(f.name, f.family, ",".join(f.sources), f.params) for f in features})
    return spark.createDataFrame(rows, "name string, family string, source_cols string, params string")


def dfs_transform(df: DataFrame, features: Sequence[Feature]) -> DataFrame:
    """Add features in one projection."""
    return df.select("*", *[f.column.alias(f.name) for f in features])


def _join_on(key: str, frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, key, "left"), frames)


def agg_batches(df: DataFrame, key: str, exprs: Sequence[Column]) -> DataFrame:
    """Many aggregates per key, ``AGG_BATCH`` per pass; a pass reads only the columns of its own aggregates."""
    frames = [df.groupBy(key).agg(*exprs[i : i + AGG_BATCH]) for i in range(0, len(exprs), AGG_BATCH)]
    return _join_on(key, frames)


# --- aggregates of a child table per retailer ----------------------------------------------------------------------


def numeric_aggregates(df: DataFrame, key: str, cols: Sequence[str], prefix: str = "") -> DataFrame:
    """Sum, mean, extremes, deviation, variance, skewness, kurtosis (population) and row count per key, one shuffle."""
    exprs = [F.count(F.lit(1)).alias(f"{prefix}count")]
    for c in cols:
        x, p = F.col(c).cast("double"), f"{prefix}%s_{c}"
        exprs += [
            exact.exact_sum(x).alias(p % "sum"),
            F.avg(x).alias(p % "mean"),
            F.min(x).alias(p % "min"),
            F.max(x).alias(p % "max"),
            F.stddev_samp(x).alias(p % "std"),
            F.var_samp(x).alias(p % "variance"),
            F.when(F.count(x) > 2, F.skewness(x)).alias(p % "skew"),
            F.when(F.count(x) > 2, F.kurtosis(x)).alias(p % "kurtosis"),
        ]
    return agg_batches(df, key, exprs)


def _long(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("_c"), F.col(c).cast("double").alias("_v")) for c in cols])
    return df.select(key, F.inline(pairs)).where("_v IS NOT NULL")


def _wide(df: DataFrame, key: str, cols: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """Back from one row per (key, column) to one row per key."""
    outs = [F.max(F.when(F.col("_c") == c, v)).alias(n % c) for c in cols for n, v in values.items()]
    return df.groupBy(key).agg(*outs)


def distinct_aggregates(df: DataFrame, key: str, cols: Sequence[str], prefix: str = "") -> DataFrame:
    """Distinct values and their share, all columns through one (key, column, value) grouping."""
    values = _long(df, key, cols).groupBy(key, "_c", "_v").agg(F.count(F.lit(1)).alias("_n"))
    per_column = values.groupBy(key, "_c").agg(F.count(F.lit(1)).alias("u"), F.sum("_n").alias("n"))
    return _wide(per_column, key, cols, {prefix + "num_unique_%s": F.col("u"), prefix + "percent_unique_%s": F.col("u") / F.col("n")})


def medians(df: DataFrame, key: str, cols: Sequence[str], prefix: str = "", hot: DataFrame | None = None) -> DataFrame:
    """Exact medians; with heavy keys each column is cut on its own values."""
    if hot is None:
        return df.groupBy(key).agg(*[F.percentile(c, 0.5).alias(f"{prefix}median_{c}") for c in cols])
    return _join_on(key, [quantiles(df, key, c, {f"{prefix}median_{c}": 0.5}, cut(df, key, c, hot)) for c in cols])


def mean_counts(
    df: DataFrame, key: str, cols: Sequence[str], prefix: str = "", n_std: float = 1.0, low: float = 0.0, high: float = 50.0, hot: DataFrame | None = None
) -> DataFrame:
    """Rows above and below the key's mean, inside and outside ``n_std`` deviations, and in ``[low, high)``."""
    stats = df.groupBy(key).agg(
        *[F.avg(c).alias(f"_m_{c}") for c in cols], *[F.stddev_samp(c).alias(f"_s_{c}") for c in cols]
    )
    rows = attach(df.select(key, *cols), stats, key, hot and Slices((key,), hot, ()))
    exprs = []
    for c in cols:
        x, m, s, p = F.col(c), F.col(f"_m_{c}"), F.col(f"_s_{c}"), f"{prefix}%s_{c}"
        exprs += [
            F.sum(flag(x > m)).alias(p % "count_above_mean"),
            F.sum(flag(x < m)).alias(p % "count_below_mean"),
            F.sum(flag(F.abs(x - m) <= n_std * s)).alias(p % "count_inside_std"),
            F.sum(flag(F.abs(x - m) > n_std * s)).alias(p % "count_outside_std"),
            F.sum(flag((x >= low) & (x < high))).alias(p % "count_in_range"),
        ]
    return rows.groupBy(key).agg(*exprs)


def dfs_agg(child: DataFrame, key: str, cols: Sequence[str], prefix: str = "", **limits) -> DataFrame:
    """All numeric aggregates of a child table, one row per key."""
    hot = heavy_keys(child, key, **limits)
    return _join_on(
        key,
        [
            numeric_aggregates(child, key, cols, prefix),
            distinct_aggregates(child, key, cols, prefix),
            medians(child, key, cols, prefix, hot),
            mean_counts(child, key, cols, prefix, hot=hot),
        ],
    )


def categorical_aggregates(df: DataFrame, key: str, col: str, prefix: str = "", top: int = 3) -> DataFrame:
    """Mode (ties: smallest value), distinct values, entropy, the ``top`` most common values and the mode's count."""
    counts = df.where(F.col(col).isNotNull()).groupBy(key, col).agg(F.count(F.lit(1)).alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("n"), F.col(col).alias("v")))
    n = F.col("_n").cast("double")
    facts = counts.groupBy(key).agg(
        best["v"].alias(f"{prefix}mode_{col}"),
        (-best["n"]).alias(f"{prefix}mode_count_{col}"),
        F.count(F.lit(1)).alias(f"{prefix}num_unique_{col}"),
        F.sum("_n").alias(f"{prefix}count_{col}"),
        F.greatest(F.log(F.sum(n)) - F.sum(n * F.log(n)) / F.sum(n), F.lit(0.0)).alias(f"{prefix}entropy_{col}"),
    )
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_n"), col))
    ranked = counts.withColumn("_p", place).where(F.col("_p") <= top)
    common = ranked.groupBy(key).agg(*[F.max(F.when(F.col("_p") == i, F.col(col))).alias(f"{prefix}common{i}_{col}") for i in range(1, top + 1)])
    return facts.join(common, key)


def time_aggregates(df: DataFrame, key: str, ts: str, cutoff: datetime, prefix: str = "") -> DataFrame:
    """First and last time, span, average gap, days since, and distinct days, weeks and months per key."""
    t, now = F.col(ts), F.lit(cutoff).cast("timestamp_ntz")
    day = F.date_trunc("day", t).cast("date")
    per_day = df.where(t.isNotNull()).groupBy(key, day.alias("_d")).agg(
        F.min(ts).alias("_lo"), F.max(ts).alias("_hi"), F.count(F.lit(1)).alias("_n")
    )
    span = elapsed(F.max("_hi"), F.min("_lo"))
    return per_day.groupBy(key).agg(
        F.min("_lo").alias(f"{prefix}first_{ts}"),
        F.max("_hi").alias(f"{prefix}last_{ts}"),
        span.alias(f"{prefix}span_{ts}"),
        F.try_divide(span, F.sum("_n") - 1).alias(f"{prefix}avg_gap_{ts}"),
        (elapsed(now, F.min("_lo")) / 86400).alias(f"{prefix}days_since_first_{ts}"),
        (elapsed(now, F.max("_hi")) / 86400).alias(f"{prefix}days_since_last_{ts}"),
        F.count(F.lit(1)).alias(f"{prefix}n_days_{ts}"),
        F.count_distinct(F.date_trunc("week", F.col("_d"))).alias(f"{prefix}n_weeks_{ts}"),
        F.count_distinct(F.date_trunc("month", F.col("_d"))).alias(f"{prefix}n_months_{ts}"),
    )


def ordered_aggregates(df: DataFrame, key: str, order: Sequence[str], col: str, prefix: str = "", slices: Slices | None = None) -> DataFrame:
    """First, last, slope per day, monotony flags, longest runs by sign and sign changes, in time order."""

    order = as_list(order)

    def plan(df: DataFrame, slices: Slices | None) -> DataFrame:
        x = F.col(col)
        rows = df.select(key, *order, x).where(x.isNotNull())
        sign = F.signum(x).cast("int")
        stepped = windowed(
            rows.withColumn("_sign", sign),
            key,
            order,
            lambda w: {"_prev": F.lag(col).over(w), "_prev_sign": F.lag("_sign").over(w)},
            before=1,
            slices=slices,
        )
        turned = F.coalesce((F.col("_sign") != F.col("_prev_sign")).cast("long"), F.lit(0).cast("long"))
        runs = running(stepped, key, order, {"_run": ("sum", turned)}, slices, peers=False)
        place, days = F.struct(*order), seconds(F.col(order[0])) / 86400
        step, p = x - F.col("_prev"), f"{prefix}%s_{col}"
        # partial results per (key, run): a run of any length is folded before it is shuffled
        per_run = runs.groupBy(key, "_run").agg(
            F.max("_sign").alias("_sign"),
            F.count(F.lit(1)).alias("_len"),
            F.min(F.struct(place.alias("at"), x.alias("x"))).alias("_first"),
            F.max(F.struct(place.alias("at"), x.alias("x"))).alias("_last"),
            F.min(step).alias("_least"),
            F.max(step).alias("_most"),
        )

        def longest(s: int) -> Column:
            return F.coalesce(F.max(F.when(F.col("_sign") == s, F.col("_len"))), F.lit(0))

        facts = per_run.groupBy(key).agg(
            F.min("_first")["x"].alias(p % "first"),
            F.max("_last")["x"].alias(p % "last"),
            F.coalesce(F.min("_least") >= 0, F.lit(True)).alias(p % "increasing"),
            F.coalesce(F.max("_most") <= 0, F.lit(True)).alias(p % "decreasing"),
            longest(1).alias(p % "longest_positive"),
            longest(0).alias(p % "longest_zero"),
            longest(-1).alias(p % "longest_negative"),
            (F.count(F.lit(1)) - 1).alias(p % "sign_changes"),
        )
        slope = rows.groupBy(key).agg(F.regr_slope(x, days).alias(p % "trend"))
        return facts.join(slope, key)

    return apart(df, plan, slices)


def dfs_direct(target: DataFrame, key: str, *parents: DataFrame, slices: Slices | None = None) -> DataFrame:
    """Attach per-retailer features to each loan; NULL where a retailer has no rows in a child.

    The parents are put together first (they share the key's partitioning), so the loans are joined once.
    """
    facts = reduce(lambda a, b: a.join(b, key, "full"), parents)
    return attach(target, facts, key, slices, "left")


# --- transforms of loan columns ------------------------------------------------------------------------------------

# First hour of each part of the day.
PARTS_OF_DAY = [(4, "dawn"), (6, "early morning"), (8, "late morning"), (11, "noon"), (14, "afternoon"), (17, "evening"), (20, "night"), (23, "midnight")]


def calendar_features(ts: str) -> list[Feature]:
    t = F.col(ts)
    day = F.to_date(t)
    part = F.lit("midnight")
    for first, name in PARTS_OF_DAY:
        part = F.when(F.hour(t) >= first, name).otherwise(part)
    quarter_first = (F.month(t) - 1) % 3 == 0
    month_start, month_end = F.dayofmonth(t) == 1, day == F.last_day(day)
    year = F.year(t)
    parts = {
        "year": year,
        "quarter": F.quarter(t),
        "month": F.month(t),
        "week": F.weekofyear(t),
        "day": F.dayofmonth(t),
        "day_of_year": F.dayofyear(t),
        "weekday": F.weekday(t),
        "hour": F.hour(t),
        "minute": F.minute(t),
        "second": F.second(t),
        "is_weekend": F.weekday(t) >= 5,
        "is_month_start": month_start,
        "is_month_end": month_end,
        "is_quarter_start": month_start & quarter_first,
        "is_quarter_end": month_end & (F.month(t) % 3 == 0),
        "is_year_start": F.dayofyear(t) == 1,
        "is_year_end": month_end & (F.month(t) == 12),
        "is_leap_year": (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0)),
        "days_in_month": F.dayofmonth(F.last_day(day)),
        "part_of_day": part,
        "is_working_hours": (F.hour(t) >= 8) & (F.hour(t) <= 18),
    }
    return [Feature(f"{n}_{ts}", "calendar", (ts,), n, c) for n, c in parts.items()]


def unary_features(cols: Sequence[str]) -> list[Feature]:
    """Absolute value, sign flip, root, logarithm, sine, cosine, tangent, null flag; NULL outside the domain."""
    out = []
    for name in cols:
        x = F.col(name)
        forms = {
            "absolute": F.abs(x),
            "negate": -x,
            "sqrt": F.when(x >= 0, F.sqrt(x)),
            "log": F.when(x > 0, F.log(x)),
            "sine": F.sin(x),
            "cosine": F.cos(x),
            "tangent": F.tan(x),
            "is_null": x.isNull(),
        }
        out += [Feature(f"{n}_{name}", "unary", (name,), n, c) for n, c in forms.items()]
    return out


def pair_features(cols: Sequence[str]) -> list[Feature]:
    """Arithmetic and comparisons of every pair of columns; NULL where a divisor is zero."""
    out = []
    for i, a in enumerate(cols):
        for b in cols[i + 1 :]:
            x, y = F.col(a), F.col(b)
            forms = {
                f"{a}_add_{b}": x + y,
                f"{a}_sub_{b}": x - y,
                f"{a}_mul_{b}": x * y,
                f"{a}_div_{b}": F.try_divide(x, y),
                f"{a}_mod_{b}": F.try_mod(x, y),
                f"{a}_gt_{b}": x > y,
                f"{a}_ge_{b}": x >= y,
                f"{a}_eq_{b}": x == y,
                f"{a}_ne_{b}": x != y,
            }
            out += [Feature(n, "pair", (a, b), n[len(a) + 1 : -len(b) - 1], c) for n, c in forms.items()]
    return out


def flag_features(cols: Sequence[str]) -> list[Feature]:
    """And, or of every pair of flags; not of each."""
    out = [Feature(f"not_{a}", "flag", (a,), "not", ~F.col(a)) for a in cols]
    for i, a in enumerate(cols):
        for b in cols[i + 1 :]:
            out.append(Feature(f"{a}_and_{b}", "flag", (a, b), "and", F.col(a) & F.col(b)))
            out.append(Feature(f"{a}_or_{b}", "flag", (a, b), "or", F.col(a) | F.col(b)))
    return out


def time_since_features(cols: Sequence[str], cutoff: datetime | str) -> list[Feature]:
    """Seconds from each time to the cutoff, a fixed time or another column."""
    end = F.col(cutoff) if isinstance(cutoff, str) else F.lit(cutoff).cast("timestamp_ntz")
    return [Feature(f"time_since_{c}", "time_since", (c,), str(cutoff), elapsed(end, F.col(c))) for c in cols]


def depth2_features(features: Sequence[Feature], allow: Sequence[tuple[str, str]]) -> list[Feature]:
    """Unary transforms of already derived columns; ``allow`` lists the (transform, column) pairs to build."""
    wanted = set(allow)
    base = [f.name for f in features]
    return [f._replace(family="depth2") for f in unary_features([c for c in base if any(c == a for _, a in wanted)]) if (f.params, f.sources[0]) in wanted]


def cumulative_features(df: DataFrame, key: str, order: Sequence[str], col: str, slices: Slices | None = None) -> DataFrame:
    """Cumulative sum, count, mean, extremes and expanding deviation in time order (exact totals)."""
    kind = exact.amount_kinds(df, [col])[col]
    facts = exact.parts(F.col(col), squares=True, kind=kind)
    accs = {f"_{n}": ("sum", c) for n, c in facts.items()}
    accs |= {f"cum_min_{col}": ("min", F.col(col)), f"cum_max_{col}": ("max", F.col(col))}
    out = running(df, key, order, accs, slices, peers=False)
    t = {n: F.col(f"_{n}") for n in facts}
    return out.select(
        *df.columns,
        exact.total(t).alias(f"cum_sum_{col}"),
        t["n"].alias(f"cum_count_{col}"),
        F.when(t["n"] > 0, exact.mean(t)).alias(f"cum_mean_{col}"),
        f"cum_min_{col}",
        f"cum_max_{col}",
        exact.spread(t, kind).alias(f"expanding_std_{col}"),
    )


def step_features(df: DataFrame, key: str, order: Sequence[str], col: str, slices: Slices | None = None) -> DataFrame:
    """Previous value, difference, rate of change per second, equality with and time since the previous row."""
    ts = as_list(order)[0]
    stepped = windowed(df, key, order, lambda w: {"_p": F.lag(col).over(w), "_t": F.lag(ts).over(w)}, before=1, slices=slices)
    gap, diff = elapsed(F.col(ts), F.col("_t")), F.col(col) - F.col("_p")
    return stepped.select(
        *df.columns,
        F.col("_p").alias(f"lag_{col}"),
        diff.alias(f"diff_{col}"),
        F.try_divide(diff, gap).alias(f"rate_{col}"),
        (F.col(col) == F.col("_p")).alias(f"same_{col}"),
        gap.alias(f"time_since_previous_{col}"),
    )


def rolling_row_features(df: DataFrame, key: str, order: Sequence[str], col: str, rows: int = 3, slices: Slices | None = None) -> DataFrame:
    """Count, mean, deviation and extremes over the latest ``rows`` rows."""

    def build(w) -> dict[str, Column]:
        f = w.rowsBetween(-(rows - 1), 0)
        return {
            f"roll_count_{col}": F.count(col).over(f),
            f"roll_mean_{col}": F.avg(col).over(f),
            f"roll_std_{col}": F.stddev_samp(col).over(f),
            f"roll_min_{col}": F.min(col).over(f),
            f"roll_max_{col}": F.max(col).over(f),
        }

    return windowed(df, key, order, build, before=rows - 1, slices=slices)


def ewma_feature(df: DataFrame, key: str, order: Sequence[str], col: str, alpha: float = 0.5, slices: Slices | None = None) -> DataFrame:
    """Exponentially weighted mean over all earlier values, weights normalised; missing values do not age the others.

    A key's values are cut into chunks in which a weight falls by 1e200 at most. Inside a chunk the weighted sum is a
    running total of values times growing weights, which a double holds; two earlier chunks are carried in, faded, and
    what lies before them weighs less than the smallest double. A chunk has 460 / -ln(1 - alpha) values (664 for 0.5).
    """
    fade = -log(1 - alpha) if alpha < 1 else 460.0
    block = max(1, int(460 / fade))

    def plan(rows: DataFrame, slices: Slices | None) -> DataFrame:
        x = F.col(col).cast("double")
        placed = running(rows, key, order, {"_k": ("sum", x.isNotNull().cast("long"))}, slices, peers=False)
        placed = placed.withColumn("_chunk", F.floor(F.greatest(F.col("_k") - 1, F.lit(0)) / block))
        age = F.when(x.isNotNull(), (F.col("_k") - 1 - F.col("_chunk") * block).cast("double"))
        grown = F.exp(age * fade)
        inside = Window.partitionBy(key, "_chunk").orderBy("_k").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        summed = placed.withColumns({"_w": F.sum(grown).over(inside), "_s": F.sum(grown * x).over(inside)})
        ends = placed.groupBy(key, "_chunk").agg(F.sum(grown).alias("_cw"), F.sum(grown * x).alias("_cs"))
        before = Window.partitionBy(key).orderBy("_chunk")

        def carried(c: str) -> Column:
            return sum((F.coalesce(F.lag(c, i).over(before), F.lit(0.0)) * exp(-fade * block * i) for i in (1, 2)), F.lit(0.0))

        carry = ends.select(F.col(key).alias("_key"), F.col("_chunk").alias("_at"), carried("_cw").alias("_pw"), carried("_cs").alias("_ps"))
        joined = summed.join(carry, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_chunk") == F.col("_at")), "left")
        total = F.coalesce("_s", F.lit(0.0)) + F.coalesce("_ps", F.lit(0.0))
        weight = F.coalesce("_w", F.lit(0.0)) + F.coalesce("_pw", F.lit(0.0))
        return joined.select(*rows.columns, F.when(F.col("_k") > 0, F.try_divide(total, weight)).alias(f"ewma_{col}"))

    return apart(df, plan, slices)


def percentile_feature(df: DataFrame, key: str, col: str, slices: Slices | None = None) -> DataFrame:
    """Average rank of the value within its key as a share of the key's values (``slices`` measured on ``col``).

    Rows without a value keep NULL. With heavy keys every (key, value) has one share, and values too frequent for one
    task are found as heavy keys of that join.
    """
    name = f"percentile_{col}"
    known, missing = df.where(F.col(col).isNotNull()), df.where(F.col(col).isNull()).withColumn(name, F.lit(None).cast("double"))

    def plan(df: DataFrame, slices: Slices | None) -> DataFrame:
        if slices is None:
            w = Window.partitionBy(key)
            by_value = w.orderBy(col)
            n = F.count(col).over(w)
            return df.withColumn(name, (F.rank().over(by_value) + F.count(col).over(by_value)) / (2 * n))
        values = df.groupBy(key, col).agg(F.count(F.lit(1)).alias("_c"))
        placed = running(values, key, col, {"_upto": ("sum", F.col("_c"))}, slices)
        totals = values.groupBy(key).agg(F.sum("_c").alias("_n"))
        shares = attach(placed, totals, key, slices).select(key, col, ((2 * F.col("_upto") - F.col("_c") + 1) / (2 * F.col("_n"))).alias(name))
        frequent = heavy_keys(df, [key, col])
        return attach(df, shares, [key, col], frequent and Slices((key, col), frequent, ()))

    return apart(known, plan, slices).unionByName(missing)


# --- point-in-time aggregates --------------------------------------------------------------------------------------


def point_in_time(
    loans: DataFrame,
    child: Entity,
    key: str,
    cols: Sequence[str],
    unique: Sequence[str] = (),
    at: str = "LOAN_ISSUANCE_DATE",
    ident: str = "LOAN_ID",
    prefix: str = "",
    carry: bool = False,
    slices: Slices | None = None,
    strict: bool = False,
) -> DataFrame:
    """What each loan could know about a child table when it was issued.

    Child rows count from their time on; columns with a secondary time count from that time on. Count, sum, mean,
    deviation, extremes, last value and distinct values are running totals over child rows and loans in time order, so
    loans are never paired with their history. The result has the loan's id and the features; with ``carry`` the loan's
    other columns travel along, which saves joining them again. ``strict`` leaves out rows of the very moment of the loan,
    for the loans themselves as a child of their retailer.
    """
    late = {c: t for t, names in child.secondary.items() for c in names}
    by_time: dict[str, list[str]] = {}
    for c in cols:
        by_time.setdefault(late.get(c, child.time), []).append(c)
    by_time.setdefault(child.time, [])
    moves = []
    for t, names in by_time.items():
        facts = [F.when(F.lit(c in names), F.col(c)).alias(f"x_{c}") for c in cols]
        moves.append(F.struct(F.col(t).alias("at"), F.lit(1 if t == child.time else 0).alias("one"), *facts))
    rows = child.df.where(F.col(key).isNotNull())
    points = rows.select(key, child.index, F.inline(F.array(*moves))).withColumnRenamed(child.index, "_id")
    side = F.lit(2 if strict else 0)  # a loan stands at 1
    events = points.where("at IS NOT NULL").withColumn("_side", side)
    for c in unique:
        known = rows.select(key, F.col(c).alias("_v"), F.col(late.get(c, child.time)).alias("at")).where("_v IS NOT NULL AND at IS NOT NULL")
        firsts = known.groupBy(key, "_v").agg(F.min("at").alias("at")).select(key, "at", side.alias("_side"), F.lit(1).alias(f"u_{c}"))
        events = events.unionByName(firsts, allowMissingColumns=True)
    kept = loans.columns if carry else [ident]
    probes = loans.select(key, F.col(at).alias("at"), F.lit(1).alias("_side"), F.struct(*kept).alias("_loan"))
    events = events.unionByName(probes, allowMissingColumns=True)

    accs, kinds = {"_n": ("sum", F.col("one"))}, exact.amount_kinds(child.df, list(cols))
    for c in cols:
        x = F.col(f"x_{c}")
        accs |= {f"_{n}_{c}": ("sum", part) for n, part in exact.parts(x, True, kinds[c]).items()}
        accs |= {
            f"_min_{c}": ("min", x),
            f"_max_{c}": ("max", x),
            f"_last_{c}": ("last", x),
        }
    for c in unique:
        accs[f"_u_{c}"] = ("sum", F.col(f"u_{c}"))
    totals = running(events, key, ["at", "_side", "_id"], accs, slices).where(F.col("_loan").isNotNull())

    outs = [F.coalesce("_n", F.lit(0)).cast("long").alias(f"{prefix}count")]
    for c in cols:
        t = {n: F.col(f"_{n}_{c}") for n in exact.names(True, kinds[c])}
        outs += [
            exact.total(t).alias(f"{prefix}sum_{c}"),
            F.when(t["n"] > 0, exact.mean(t)).alias(f"{prefix}mean_{c}"),
            exact.spread(t, kinds[c]).alias(f"{prefix}std_{c}"),
            F.col(f"_min_{c}").cast("double").alias(f"{prefix}min_{c}"),
            F.col(f"_max_{c}").cast("double").alias(f"{prefix}max_{c}"),
            F.col(f"_last_{c}").cast("double").alias(f"{prefix}last_{c}"),
        ]
    outs += [F.coalesce(f"_u_{c}", F.lit(0)).cast("long").alias(f"{prefix}num_unique_{c}") for c in unique]
    return totals.select("_loan.*", *outs)


def merge_frames(left: DataFrame, right: DataFrame, left_defs: DataFrame, right_defs: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """Join two feature frames on the loan, shared columns once, and unite their definitions."""
    from ledgerlens.operators.summaries import merge_columns

    return merge_columns(left, right, on), left_defs.union(right_defs).distinct()
