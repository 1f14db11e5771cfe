"""Time-aware operators: rolling statistics, the as-of join, point-in-time filter and percent rank."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import exact
from ledgerlens.operators.skew import AUTO, Slices, as_list, measure, ranked, resolve, running


class _Rolling:
    """Rolling windows as arrivals and departures: the parts that ``rolling_time`` and ``rolling_asof`` share."""

    def __init__(self, df: DataFrame, ts: str, col: str, days: int | Sequence[int], fns: Sequence[str]):
        self.ts, self.col, self.fns = ts, col, fns
        self.kind = exact.amount_kinds(df, [col])[col]
        self.days = [days] if isinstance(days, int) else list(days)

    def events(self, df: DataFrame, key: str) -> DataFrame:
        """Each row once at its time (``_d`` 0) and once per window when it leaves (``_d`` = days)."""
        ts = F.col(self.ts)
        moves = [F.struct(F.lit(0).alias("d"), ts.alias("at"))]
        moves += [F.struct(F.lit(d).alias("d"), (ts + F.lit(timedelta(days=d))).alias("at")) for d in self.days]
        known = df.where(ts.isNotNull()).select(
            F.struct(*df.columns).alias("_row"), F.col(key).alias("_key"), F.col(self.col).alias("_x"), F.explode(F.array(*moves)).alias("_m")
        )
        row = F.when(F.col("_m.d") == 0, F.col("_row"))
        facts = exact.parts(F.col("_x"), "std" in self.fns, self.kind)
        return known.select("_key", F.col("_m.at").alias("_at"), F.col("_m.d").alias("_d"), *[c.alias(f"_{n}") for n, c in facts.items()], row.alias("_row"))

    def names(self) -> list[str]:
        return exact.names("std" in self.fns, self.kind)

    def totals(self, events: DataFrame, slices: Slices | None) -> DataFrame:
        """The parts inside each window, as running totals of arrivals less departures."""
        accs = {}
        for d in self.days:
            for name in self.names():
                value = F.col(f"_{name}")
                accs[f"_{name}{d}"] = ("sum", F.when(F.col("_d") == 0, value).when(F.col("_d") == d, -value))
        return running(events, "_key", "_at", accs, self.sliced(slices))

    def sliced(self, slices: Slices | None) -> Slices | None:
        """Departures are arrivals moved by whole days, so moving the cuts along keeps both balanced."""
        if slices is None:
            return None
        moved = {c + d * 86_400_000_000 for c in slices.cuts for d in [0, *self.days]}
        return Slices(("_key",), slices.hot and slices.hot.withColumnRenamed(slices.keys[0], "_key"), tuple(sorted(moved)))

    def columns(self) -> list[Column]:
        outs = []
        for d in self.days:
            window = {n: F.col(f"_{n}{d}") for n in self.names()}
            if "mean" in self.fns:
                outs.append(F.when(window["n"] > 0, exact.mean(window)).alias(f"ROLLINGMEAN_{d}DAYS__{self.col}__"))
            if "std" in self.fns:
                outs.append(exact.spread(window, self.kind).alias(f"ROLLINGSTDDEV_{d}DAYS__{self.col}__"))
        return outs

    def unplaced(self, df: DataFrame) -> DataFrame:
        """Rows without a time are in no window, not even their own."""
        names = [f"ROLLING{k}_{d}DAYS__{self.col}__" for d in self.days for k, fn in (("MEAN", "mean"), ("STDDEV", "std")) if fn in self.fns]
        return df.where(F.col(self.ts).isNull()).select("*", *[F.lit(None).cast("double").alias(n) for n in names])


def measure_sides(left: DataFrame, right: DataFrame, left_on: str, right_on: str, by: str | Sequence[str], **limits) -> Slices | None:
    """Heavy keys of two tables that are going to be stacked."""
    by = as_list(by)
    sides = [df.select(*by, F.col(ts).alias("_at")) for df, ts in ((left, left_on), (right, right_on))]
    return measure(sides[0].unionByName(sides[1]), by, "_at", **limits)


def rolling_time(
    df: DataFrame,
    key: str,
    ts: str,
    col: str,
    days: int | Sequence[int],
    fns: Sequence[str] = ("mean", "std"),
    slices: Slices | str | None = AUTO,
) -> DataFrame:
    """Rolling mean and sample deviation of ``col`` over the left-open window ``(ts - days, ts]`` of each key.

    Adds ``ROLLINGMEAN_{d}DAYS__{col}__`` and ``ROLLINGSTDDEV_{d}DAYS__{col}__``; all windows share one shuffle.

    Each row is an arrival at ``ts`` and a departure at ``ts + d`` days. A window's count, sum and sum of squares are
    then running totals of arrivals minus departures, so the work is linear however many rows a window covers. Totals
    are decimals of the scale that the column's values have, which makes the subtraction exact (see ``functions.exact``). A window
    with one row has no deviation (NULL); equal times see each other. Rows without a key share a window of their own, in
    ordered slices where there are many; rows without a time keep NULLs.

    ``slices`` says which keys are heavy (see ``skew``). By default the input is measured; pass the outcome of a
    measurement to share it between operators, or ``None`` for the plain window.
    """
    rolling = _Rolling(df, ts, col, days, fns)
    slices = resolve(slices, lambda: measure(df, key, ts))
    placed = rolling.totals(rolling.events(df, key), slices).where("_d = 0").select("_row.*", *rolling.columns())
    return placed.unionByName(rolling.unplaced(df))


def rolling_asof(
    left: DataFrame,
    right: DataFrame,
    left_on: str,
    right_on: str,
    by: str,
    col: str,
    days: int | Sequence[int],
    tolerance: timedelta | None = None,
    tie: str | None = None,
    slices: Slices | str | None = AUTO,
) -> DataFrame:
    """``asof_join(left, rolling_time(right, ...))`` in one shuffle.

    The left rows travel with the right side's arrivals and departures; the running totals and the last right row are
    two windows over the same partitioning.
    """
    rolling = _Rolling(right, right_on, col, days, ("mean", "std"))
    slices = resolve(slices, lambda: measure_sides(left, right, left_on, right_on, by))
    payload = [c for c in right.columns if c != by]
    clash = set(payload) & set(left.columns)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")

    def plan(left: DataFrame, right: DataFrame, slices: Slices | None) -> DataFrame:
        probes = left.select(F.col(by).alias("_key"), F.col(left_on).alias("_at"), F.lit(-1).alias("_d"), F.struct(*left.columns).alias("_left"))
        events = rolling.events(right, by).unionByName(probes, allowMissingColumns=True)
        totals = rolling.totals(events, slices).where("_d <= 0")
        volume = F.struct(*[F.col(f"_row.{c}").alias(c) for c in payload], *rolling.columns())
        ties = [F.col(f"_row.{tie}").alias("_tie")] if tie else []
        placed = totals.select("_key", "_at", "_left", (-F.col("_d")).alias("_side"), F.when(F.col("_d") == 0, volume).alias("_right"), *ties)
        order = ["_at", "_side", "_tie"] if tie else ["_at", "_side"]
        found = running(placed, "_key", order, {"_last": ("last", F.col("_right"))}, rolling.sliced(slices)).where(F.col("_left").isNotNull())
        near = F.col("_at").isNotNull()
        if tolerance is not None:
            near = near & (F.col(f"_last.{right_on}") + F.lit(tolerance) >= F.col("_at"))
        matched = found.select("_left", F.when(near, F.col("_last")).alias("_last"))
        names = [f.name for f in placed.schema["_right"].dataType.fields]
        return matched.select("_left.*", *[F.col("_last")[c].alias(c) for c in names])

    known, unknown = _with_key(left, [by])
    right = right.where(F.col(by).isNotNull())
    if slices is None:
        matched = plan(known, right, None)
    else:
        hot = F.broadcast(slices.hot)
        light = plan(known.join(hot, by, "left_anti"), right.join(hot, by, "left_anti"), None)
        matched = light.unionByName(plan(known.join(hot, by, "left_semi"), right.join(hot, by, "left_semi"), slices.alone()))
    return matched.unionByName(unknown, allowMissingColumns=True)


def _with_key(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is known, and the others: those match nothing and must not be gathered as one group."""
    missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in by])
    return df.where(~missing), df.where(missing)


def asof_join(
    left: DataFrame,
    right: DataFrame,
    left_on: str,
    right_on: str,
    by: str | Sequence[str],
    tolerance: timedelta | None = None,
    allow_exact: bool = True,
    tie: str | Sequence[str] = (),
    slices: Slices | str | None = AUTO,
) -> DataFrame:
    """Each left row with the latest right row of its key at or before its time (NULLs where there is none).

    Both sides are stacked and the last right row is carried forward along time: one shuffle and one sort, no range
    join. ``tolerance`` is inclusive. Among right rows of one instant the largest ``tie`` wins.
    """
    by, tie = as_list(by), as_list(tie)
    slices = resolve(slices, lambda: measure_sides(left, right, left_on, right_on, by))
    payload = [c for c in right.columns if c not in by]
    clash = set(payload) & set(left.columns)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    known, unknown = _with_key(left, by)
    right, _ = _with_key(right, by)
    side = F.lit(1 if allow_exact else 0)
    probes = known.select(*by, F.col(left_on).alias("_at"), side.alias("_side"), F.struct(*left.columns).alias("_left"))
    ties = [F.col(c).alias(f"_tie{i}") for i, c in enumerate(tie)]
    points = right.where(F.col(right_on).isNotNull()).select(
        *by, F.col(right_on).alias("_at"), F.lit(0 if allow_exact else 1).alias("_side"), F.struct(*payload).alias("_right"), *ties
    )
    events = points.unionByName(probes, allowMissingColumns=True)
    order = ["_at", "_side", *[f"_tie{i}" for i in range(len(tie))]]
    found = running(events, by, order, {"_last": ("last", F.col("_right"))}, slices).where(F.col("_left").isNotNull())
    match = F.col("_last")
    if tolerance is not None:
        match = F.when(F.col(f"_last.{right_on}") + F.lit(tolerance) >= F.col("_at"), match)
    matched = found.select("_left", F.when(F.col("_at").isNotNull(), match).alias("_last"))
    found = matched.select("_left.*", *[F.col("_last")[c].alias(c) for c in payload])
    return found.unionByName(unknown, allowMissingColumns=True)


def strictly_before(df: DataFrame, left_on: str, right_on: str) -> DataFrame:
    """Keep rows whose matched time lies strictly before their own; unmatched rows go too."""
    return df.where(F.col(left_on) > F.col(right_on))


def percent_rank_scaled(df: DataFrame, order: str, name: str = "stratified_split", slices: Slices | None = None) -> DataFrame:
    """``percent_rank() OVER (ORDER BY order)`` without putting the table into one partition."""
    slices = slices or measure(df, [], order, hot_rows=0)
    total = df.agg(F.count(F.lit(1))).scalar()
    placed = ranked(df, [], order, slices, "_rank")
    fraction = F.coalesce(F.try_divide((F.col("_rank") - 1).cast("double"), (total - 1).cast("double")), F.lit(0.0))
    return placed.withColumn(name, fraction).drop("_rank")
