"""Ordered computations that stay balanced when one key owns a large share of the rows.

A window ``PARTITION BY key ORDER BY time`` sorts one key inside one task. That is the right plan while every key is
small, and the wrong one as soon as a retailer owns a third of the table. The functions here first measure which keys
are heavy. None: they are the plain window. Some: rows of heavy keys are cut into ordered slices, each slice is a window
partition of its own, and what earlier slices contribute enters a slice as one extra "carry" row that sorts first.

The measurement is bounded: a heavy key owns at least ``share`` of all rows, so there are at most ``1 / share`` of them.
There is a slice for every ``BLOCK`` rows of the heavy keys, so slices multiply with the table instead of growing, up
to ``MOST_PIECES`` cuts, which is what bounds the measurement. Slices are functions of the row's own values, so a task that
is run again after an executor was lost puts every row where it was before.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOT_ROWS = 1_000_000
HOT_SHARE = 1e-5
BLOCK = 1 << 18
MOST_PIECES = 1 << 16

AUTO = "auto"  # as ``slices``: measure the input here

Accumulators = dict[str, tuple[str, Column]]


@dataclass(frozen=True)
class Slices:
    """Heavy keys (at most ``1 / share`` rows) and cuts of the ordering column.

    ``hot`` is ``None`` when every row is to be cut: a table without key, or a frame of heavy keys only. With ``step``
    the ordering column is a position from 1 on, and every ``step`` positions are a slice.
    """

    keys: tuple[str, ...]
    hot: DataFrame | None
    cuts: tuple[float, ...]
    step: int | None = None

    def alone(self) -> Slices:
        """The same cuts for a frame that holds only rows of heavy keys."""
        return Slices(self.keys, None, self.cuts, self.step)

    def by_position(self) -> Slices:
        """Slices of a frame of the same keys that is ordered by position; nothing has to be measured."""
        return Slices(self.keys, self.hot, (), BLOCK)


def as_list(names: str | Sequence[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def ordinal(df: DataFrame, name: str) -> Column:
    """The ordering column as a double that never decreases when the column increases."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        return F.unix_micros(F.col(name).cast("timestamp")).cast("double")
    if isinstance(kind, T.NumericType):
        return F.col(name).cast("double")
    raise TypeError(f"cannot slice on {name}: {kind.simpleString()}")


def heavy_keys(df: DataFrame, keys: str | Sequence[str], hot_rows: int = HOT_ROWS, share: float = HOT_SHARE) -> DataFrame | None:
    """Keys that own at least ``hot_rows`` rows and ``share`` of the table; ``None`` when there are none.

    One counting job over the key columns. At most ``1 / share`` keys can pass, so the result is small by construction.
    """
    keys = as_list(keys)
    rows = Observation()
    counts = df.observe(rows, F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    known = " AND ".join(f"`{k}` IS NOT NULL" for k in keys)
    heaviest = counts.where(F.col("_n") >= hot_rows).where(known).orderBy(F.desc("_n"))
    if share > 0:  # no more than 1 / share keys can own that share of the rows
        heaviest = heaviest.limit(int(1 / share))
    found = [r for r in heaviest.collect() if r["_n"] >= share * rows.get["n"]]
    if not found:
        return None
    return df.sparkSession.createDataFrame([tuple(r[k] for k in keys) for r in found], schema=df.select(*keys).schema)


def cut(df: DataFrame, keys: str | Sequence[str], order: str, hot: DataFrame | None, pieces: int | None = None) -> Slices | None:
    """Slices for keys already known to be heavy: cuts of ``order`` over their rows from a quantile sketch."""
    if hot is None:
        return None
    keys = as_list(keys)
    return Slices(tuple(keys), hot, _cuts(df.join(F.broadcast(hot), keys, "left_semi"), order, pieces))


def _cuts(rows: DataFrame, order: str, pieces: int | None) -> tuple[float, ...]:
    pieces = pieces or min(MOST_PIECES, max(2, -(-rows.count() // BLOCK)))
    probs = [i / pieces for i in range(1, pieces)]
    found = rows.agg(F.percentile_approx(ordinal(rows, order), probs, 4 * pieces).alias("c")).first()["c"] or []
    return tuple(sorted({float(c) for c in found}))


def measure(
    df: DataFrame,
    keys: str | Sequence[str],
    order: str,
    hot_rows: int = HOT_ROWS,
    share: float = HOT_SHARE,
    pieces: int | None = None,
) -> Slices | None:
    """Heavy keys of ``df`` and cuts of ``order`` over their rows; ``None`` when no key is heavy.

    Without keys the whole table is one group: it is cut as soon as it has ``hot_rows`` rows.
    """
    keys = as_list(keys)
    if keys:
        return cut(df, keys, order, heavy_keys(df, keys, hot_rows, share), pieces)
    if hot_rows and df.count() < hot_rows:
        return None
    return Slices((), None, _cuts(df, order, pieces))


def resolve(slices: Slices | str | None, measured: Callable[[], Slices | None]) -> Slices | None:
    """``slices`` itself, or the outcome of measuring if it is ``AUTO``."""
    return measured() if isinstance(slices, str) else slices


def apart(df: DataFrame, plan: Callable[..., DataFrame], *slices: Slices | None) -> DataFrame:
    """``plan(rows, *slices)`` for light keys without slices and for heavy keys with them, put together.

    The split happens at the input, so what a plan computes more than once for heavy keys never touches the others. All
    ``slices`` name the same heavy keys.
    """
    known = next((s for s in slices if s is not None), None)
    if known is None or known.hot is None:
        return plan(df, *slices)
    hot, keys = F.broadcast(known.hot), list(known.keys)
    light = plan(df.join(hot, keys, "left_anti"), *[None] * len(slices))
    heavy = plan(df.join(hot, keys, "left_semi"), *[s and s.alone() for s in slices])
    return light.unionByName(heavy)


def attach(rows: DataFrame, facts: DataFrame, keys: str | Sequence[str], slices: Slices | None = None, how: str = "inner") -> DataFrame:
    """Join facts, one row per key, to rows of the key.

    Light keys are an ordinary equi-join. Rows of heavy keys meet their facts by broadcast (one row for each of at most
    ``1 / share`` keys), so they are not gathered by key.
    """
    keys = as_list(keys)
    if slices is None:
        return rows.join(facts, keys, how)
    if slices.hot is None:
        return rows.join(F.broadcast(facts), keys, how)
    hot = F.broadcast(slices.hot)
    heavy_facts = facts.join(hot, keys, "left_semi")
    return apart(rows, lambda part, s: attach(part, facts if s is None else heavy_facts, keys, s, how), slices)


def slice_rows(df: DataFrame, order: str, slices: Slices) -> DataFrame:
    """Add ``_slice``, 1.. in the order of ``order``."""
    df = df.withColumn("_raw", F.coalesce(ordinal(df, order), F.lit(float("-inf"))))
    if slices.step:
        return df.withColumn("_slice", (F.floor((F.col("_raw") - 1) / slices.step) + 1).cast("int")).drop("_raw")
    splits = [float("-inf"), *slices.cuts, float("inf")]
    if len(splits) == 2:
        return df.withColumn("_slice", F.lit(1)).drop("_raw")
    cut_ = Bucketizer(splits=splits, inputCol="_raw", outputCol="_bin", handleInvalid="keep").transform(df)
    return cut_.withColumn("_slice", F.col("_bin").cast("int") + 1).drop("_raw", "_bin")


def _over(kind: str, value: Column, window) -> Column:
    if kind == "last":
        return F.last(value, ignorenulls=True).over(window)
    return {"sum": F.sum, "min": F.min, "max": F.max}[kind](value).over(window)


def running(
    df: DataFrame,
    keys: str | Sequence[str],
    order: str | Sequence[str],
    accs: Accumulators,
    slices: Slices | None = None,
    peers: bool = True,
    previous: bool = False,
) -> DataFrame:
    """Running accumulations per key: ``accs`` maps a result name to (``sum|min|max|last``, contribution).

    ``peers=True`` includes all rows with equal ordering values (SQL RANGE), else row by row; ``previous=True`` excludes
    the current row. ``last`` is the latest contribution that is not null. Work is linear in the rows of a key.
    """
    keys, order = as_list(keys), as_list(order)
    parts = {name: f"_in_{i}" for i, name in enumerate(accs)}
    staged = df.select("*", *[accs[name][1].alias(part) for name, part in parts.items()])

    def framed(window):
        if previous:
            return window.rowsBetween(Window.unboundedPreceding, -1)
        return (window.rangeBetween if peers else window.rowsBetween)(Window.unboundedPreceding, Window.currentRow)

    def result(frame: DataFrame, window) -> DataFrame:
        outs = [_over(accs[name][0], F.col(part), framed(window)).alias(name) for name, part in parts.items()]
        return frame.select(*frame.columns, *outs).drop(*parts.values())

    def plan(rows: DataFrame, slices: Slices | None) -> DataFrame:
        if slices is None:
            return result(rows, Window.partitionBy(*keys).orderBy(*order))
        sliced = slice_rows(rows, order[0], slices)
        place = F.struct(*order)
        totals = []
        for name, part in parts.items():
            kind = accs[name][0]
            if kind == "last":
                totals.append(F.max_by(part, F.when(F.col(part).isNotNull(), place)).alias(part))
            else:
                totals.append({"sum": F.sum, "min": F.min, "max": F.max}[kind](part).alias(part))
        per_slice = sliced.groupBy(*keys, "_slice").agg(*totals)
        earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        carry = per_slice.select(
            *keys, "_slice", F.lit(0).alias("_seq"), *[_over(accs[n][0], F.col(p), earlier).alias(p) for n, p in parts.items()]
        )
        events = sliced.withColumn("_seq", F.lit(1)).unionByName(carry, allowMissingColumns=True)
        window = Window.partitionBy(*keys, "_slice").orderBy("_seq", *order)
        return result(events, window).where("_seq = 1").drop("_seq", "_slice")

    return apart(staged, plan, slices)


def numbered(df: DataFrame, keys: str | Sequence[str], order: str | Sequence[str], slices: Slices | None = None, name: str = "_pos") -> DataFrame:
    """1-based position of each row in its key; ``order`` must be total."""
    if slices is None:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*as_list(keys)).orderBy(*as_list(order))).cast("long"))
    return running(df, keys, order, {name: ("sum", F.lit(1).cast("long"))}, slices, peers=False)


def windowed(
    df: DataFrame,
    keys: str | Sequence[str],
    order: str | Sequence[str],
    build: Callable[[object], dict[str, Column]],
    before: int = 0,
    after: int = 0,
    slices: Slices | None = None,
    block: int | None = None,
    position: str | None = None,
) -> DataFrame:
    """Columns that look at most ``before`` rows back and ``after`` rows ahead (lag, lead, short row frames).

    ``build`` receives the ordered window and returns the columns. Heavy keys are cut into blocks of ``block`` rows, and
    the rows near a border are copied into the neighbouring block, so every look-back is complete. ``position`` names
    an extra column with the 1-based place in the key.
    """
    keys, order = as_list(keys), as_list(order)
    def plan(rows: DataFrame, slices: Slices | None) -> DataFrame:
        if slices is None:
            window = Window.partitionBy(*keys).orderBy(*order)
            built = build(window)
            if position:
                built[position] = F.row_number().over(window).cast("long")
            return rows.select("*", *[c.alias(n) for n, c in built.items()])
        size = max(block or BLOCK, before, after)
        own = F.floor((F.col("_at") - 1) / size)
        offset = (F.col("_at") - 1) % size
        places = F.array_compact(
            F.array(
                F.struct(own.alias("b"), F.lit(True).alias("own")),
                F.when(offset >= size - before, F.struct((own + 1).alias("b"), F.lit(False).alias("own"))),
                F.when((offset < after) & (own > 0), F.struct((own - 1).alias("b"), F.lit(False).alias("own"))),
            )
        )
        spread = numbered(rows, keys, order, slices, "_at").select("*", F.explode(places).alias("_place"))
        spread = spread.select(*rows.columns, "_at", F.col("_place.b").alias("_block"), F.col("_place.own").alias("_own"))
        built = build(Window.partitionBy(*keys, "_block").orderBy("_at"))
        wide = spread.select("*", *[c.alias(n) for n, c in built.items()])
        kept = wide.where("_own").drop("_block", "_own")
        return kept.withColumnRenamed("_at", position) if position else kept.drop("_at")

    return apart(df, plan, slices)


def ranked(df: DataFrame, keys: str | Sequence[str], order: str, slices: Slices | None = None, name: str = "_rank") -> DataFrame:
    """1-based competition rank of ``order`` within each key (or over the whole table when ``keys`` is empty)."""
    keys = as_list(keys)
    def plan(rows: DataFrame, slices: Slices | None) -> DataFrame:
        if slices is None:
            return rows.withColumn(name, F.rank().over(Window.partitionBy(*keys).orderBy(order)).cast("long"))
        sliced = slice_rows(rows, order, slices)
        sizes = sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_size"))
        earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        offsets = sizes.select(*keys, "_slice", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))
        if not keys:
            offsets = F.broadcast(offsets)  # one row per slice, at most ``MOST_PIECES`` of them
        local = F.rank().over(Window.partitionBy(*keys, "_slice").orderBy(order))
        placed = sliced.join(offsets, [*keys, "_slice"], "left").withColumn(name, local + F.coalesce("_offset", F.lit(0)))
        return placed.select(*rows.columns, F.col(name).cast("long").alias(name))

    return apart(df, plan, slices)
