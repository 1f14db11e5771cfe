"""What each loan could know of a child table's past when it was issued: facts that are more than running totals.

`features.point_in_time` has counts, sums and extremes. Here are quantiles, modes, entropies, shape, trend, runs, steps and gaps
of the child rows known so far. Loans and child rows are stacked on one time line per retailer, and everything is put
together from running sums, extremes and last values along it, so loans are never paired with their history and no list
of a retailer's rows is ever held:

- *quantiles*: a descent over value ranks. The ranks of a retailer's values are cut into ``FANOUT`` ranges; running counts per range tell
  each loan in which one its order statistic lies and how many places are left. The rows of a range are a window of their
  own on the next level, so after ``log(rows) / log(FANOUT)`` levels a rank is found.
- *modes*: counts per value only grow, so the most frequent value so far is the row with the largest running count of its
  own value: a running extreme of (count, value). The entropy is a running sum of what each row adds to it.
- *runs*: the length of the run a row stands in is its place less that of the latest turn, a running last value; the longest
  run so far is a running maximum of that. This is the state (open run, best run) of a segment, carried from row to row
  and, for heavy retailers, from slice to slice.
- *shape and trend*: running sums of powers of the distance to the retailer's first value and time. The pivot is a row of
  the sample itself, which bounds what cancels.

Rows of one instant as the loan count unless ``strict``. A column with a secondary time counts from that time on. Rows without
key, time or value count nowhere; a loan without key or time, or without any known row, has NULLs and counts of zero.
Several rows of one instant are ordered by their id. Results have one row per loan row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.scalar import elapsed
from ledgerlens.operators.features import Entity
from ledgerlens.operators.skew import AUTO, Slices, apart, measure, numbered, resolve, running
from ledgerlens.operators.temporal import measure_sides
from ledgerlens.session import materialise

FANOUT = 16
LINE = ["_at", "_side", "_id"]

Steps = Callable[[DataFrame], DataFrame]


def _known(child: Entity, key: str, col: str, strict: bool) -> DataFrame:
    """The child's rows on the time line: key, time at which the value is known, id and value. A loan stands at side 1."""
    times = {c: t for t, names in child.secondary.items() for c in names}
    side = F.lit(2 if strict else 0).alias("_side")
    rows = child.df.select(F.col(key).alias("_key"), F.col(times.get(col, child.time)).alias("_at"), side, F.col(child.index).alias("_id"), F.col(col).alias("_x"))
    return rows.where("_key IS NOT NULL AND _at IS NOT NULL AND _x IS NOT NULL")


def _line(loans: DataFrame, points: DataFrame, key: str, at: str) -> DataFrame:
    """Loans, as ``_loan``, among the points."""
    probes = loans.select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*loans.columns).alias("_loan"))
    return points.unionByName(probes.where("_key IS NOT NULL AND _at IS NOT NULL"), allowMissingColumns=True)


def _count(value: Column) -> Column:
    return F.coalesce(value, F.lit(0)).cast("long")


def _sides(loans: DataFrame, child: Entity, key: str, at: str) -> Callable[[], Slices | None]:
    return lambda: measure_sides(loans, child.df, at, child.time, key)


def _split(line: DataFrame, slices: Slices | None, plan: Callable[[DataFrame, Slices | None, Steps], DataFrame], gather: bool = False) -> DataFrame:
    """``plan`` for light retailers, all of whose windows share one exchange by key (none, if the tables are bucketed by it), and for
    heavy ones, whose rows are written after each step because a window over slices reads its input twice. ``gather``: the
    first window is of a finer key, so the rows are dealt by the key before it."""
    own = slices and Slices(("_key",), slices.hot and slices.hot.toDF("_key"), slices.cuts, slices.step)

    def planned(rows: DataFrame, s: Slices | None) -> DataFrame:
        if s is not None:
            return plan(rows, s, materialise)
        return plan(rows.repartition("_key") if gather else rows, None, lambda df: df)

    return apart(line, planned, own)


def quantiles_so_far(
    loans: DataFrame,
    child: Entity,
    key: str,
    col: str,
    probs: dict[str, float],
    at: str = "LOAN_ISSUANCE_DATE",
    strict: bool = False,
    slices: Slices | str | None = AUTO,
    fanout: int = FANOUT,
) -> DataFrame:
    """The loans with exact quantiles of ``col`` over the child rows known at ``at``; ``probs`` maps their names to probabilities.

    Between two values a quantile is interpolated.
    """
    slices = resolve(slices, _sides(loans, child, key, at))
    # written, because the numbers must not change between the loans and what is found for them
    asking = materialise(loans.withColumn("_row", F.monotonically_increasing_id()))
    points = _known(child, key, col, strict).withColumn("_x", F.col("_x").cast("double"))
    is_loan = F.col("_loan").isNotNull()

    def plan(line: DataFrame, slices: Slices | None, step: Steps) -> DataFrame:
        most = line.where(~is_loan).groupBy("_key").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
        levels = 1
        while fanout**levels < most:
            levels += 1
        none = F.lit(None).cast("long")
        rows = step(_value_ranks(line, slices)).select("*", F.lit(0).cast("long").alias("_node"), *[none.alias(c) for c in ("_k", "_want", "_n")])
        for level in range(levels):
            width = fanout ** (levels - 1 - level)
            own = F.floor(F.col("_r") / (width * fanout)).cast("long")
            rows = rows.withColumns({"_node": F.when(is_loan, F.col("_node")).otherwise(own), "_digit": F.floor(F.col("_r") / width).cast("long") % fanout})
            accs = {f"_c{d}": ("sum", F.when(F.col("_digit") == d, F.lit(1).cast("long"))) for d in range(fanout)}
            counted = running(rows, ["_key", "_node"], LINE, accs, slices, peers=False)
            upto, total = [], F.lit(0).cast("long")
            for d in range(fanout):
                total = total + _count(F.col(f"_c{d}"))
                upto.append(total)
            counted = counted.withColumn("_upto", F.array(*upto)).drop(*accs)
            if level == 0:  # now a loan knows how many values there are, and so which places it asks for
                counted = counted.withColumn("_n", F.when(is_loan, F.col("_upto")[fanout - 1]))
                asked = F.when(is_loan, F.when(F.col("_n") > 0, _places(F.col("_n"), list(probs.values())))).otherwise(F.array(none))
                counted = counted.withColumn("_want", F.explode(asked)).withColumn("_k", F.col("_want") + 1)
            below = F.filter("_upto", lambda c: c < F.col("_k"))
            node = F.when(is_loan, F.col("_node") * fanout + F.size(below)).otherwise(F.col("_node"))
            left = F.col("_k") - F.coalesce(F.array_max(below), F.lit(0))
            rows = step(counted.select("_key", *LINE, "_loan", "_x", "_r", node.alias("_node"), left.alias("_k"), "_want", "_n"))
        rows = rows.withColumn("_node", F.when(is_loan, F.col("_node")).otherwise(F.col("_r")))
        found = running(rows, ["_key", "_node"], LINE, {"_value": ("max", F.col("_x"))}, slices, peers=False).where(is_loan)
        return found.select("_loan._row", "_want", "_n", "_value")

    found = _split(_line(asking.select("_row", key, at), points, key, at), slices, plan)

    def quantile(p: float) -> Column:
        place = (F.col("_n") - 1) * F.lit(float(p))
        lo, hi = (F.max(F.when(F.col("_want") == end(place).cast("long"), F.col("_value"))) for end in (F.floor, F.ceil))
        share = F.max(place - F.floor(place))
        return F.when(share > 0, lo + (hi - lo) * share).otherwise(lo)

    per = found.groupBy("_row").agg(*[quantile(p).alias(n) for n, p in probs.items()])
    return asking.join(per, "_row", "left").drop("_row")


def _value_ranks(line: DataFrame, slices: Slices | None) -> DataFrame:
    """The line with the 0-based rank ``_r`` of each point's value within its key; loans have none."""
    names = ["_key", *LINE, "_loan", "_x"]
    if slices is None:  # loans come after all values of their key, so all stays in one partition
        first = F.col("_loan").isNotNull().cast("int")
        ranks = numbered(line.withColumn("_after", first), "_key", ["_after", "_x", "_at", "_id"], None, "_r")
        return ranks.select(*names, F.when(F.col("_loan").isNull(), F.col("_r") - 1).alias("_r"))
    points = line.where("_loan IS NULL")
    ranks = numbered(points, "_key", ["_x", "_at", "_id"], measure(points, [], "_x", hot_rows=0), "_r")
    probes = line.where("_loan IS NOT NULL").select(*names, F.lit(None).cast("long").alias("_r"))
    return ranks.select(*names, (F.col("_r") - 1).alias("_r")).unionByName(probes)


def _places(n: Column, probs: Sequence[float]) -> Column:
    """The 0-based places, each once, between which the quantiles of n values lie."""
    ends = []
    for p in probs:
        place = (n - 1) * F.lit(float(p))
        ends += [F.floor(place).cast("long"), F.ceil(place).cast("long")]
    return F.array_distinct(F.array(*ends))


def categories_so_far(
    loans: DataFrame,
    child: Entity,
    key: str,
    col: str,
    at: str = "LOAN_ISSUANCE_DATE",
    prefix: str = "",
    strict: bool = False,
    slices: Slices | str | None = AUTO,
) -> DataFrame:
    """The loans with mode (of equally frequent values the smallest), its count, distinct values, their share and entropy of
    ``col`` over the child rows known at ``at``."""
    slices = resolve(slices, _sides(loans, child, key, at))

    def plan(line: DataFrame, slices: Slices | None, step: Steps) -> DataFrame:
        point = F.col("_loan").isNull()
        line = step(running(line, ["_key", "_x"], LINE, {"_c": ("sum", F.when(point, F.lit(1).cast("long")))}, slices, peers=False))
        c = F.when(point, F.col("_c")).cast("double")
        grown = c * F.log(c) - F.when(c > 1, (c - 1) * F.log(c - 1)).otherwise(0.0)
        accs = {
            "_best": ("min", F.when(point, F.struct((-F.col("_c")).alias("n"), F.col("_x").alias("v")))),
            "_u": ("sum", F.when(point & (F.col("_c") == 1), F.lit(1).cast("long"))),
            "_n": ("sum", F.when(point, F.lit(1).cast("long"))),
            "_s": ("sum", grown),
        }
        return running(line, "_key", LINE, accs, slices, peers=False).where(~point)

    out = _split(_line(loans, _known(child, key, col, strict), key, at), slices, plan, gather=True)
    n = F.col("_n").cast("double")
    return _with_unplaced(
        loans,
        key,
        at,
        out,
        {
            f"{prefix}mode_{col}": F.col("_best.v"),
            f"{prefix}mode_count_{col}": _count(-F.col("_best.n")),
            f"{prefix}num_unique_{col}": _count(F.col("_u")),
            f"{prefix}percent_unique_{col}": F.try_divide(F.col("_u"), F.col("_n")),
            f"{prefix}entropy_{col}": F.when(n > 0, F.greatest(F.log(n) - F.col("_s") / n, F.lit(0.0))),
        },
    )


def history_so_far(
    loans: DataFrame,
    child: Entity,
    key: str,
    cols: Sequence[str],
    at: str = "LOAN_ISSUANCE_DATE",
    prefix: str = "",
    strict: bool = False,
    slices: Slices | str | None = AUTO,
) -> DataFrame:
    """The loans with shape, trend, runs, steps and gaps of each column, and the times of the child rows, known at ``at``.

    Per column: first value, sample variance, population skewness and excess kurtosis (three values at least that differ), slope
    per day, monotony flags, longest runs by sign, changes of sign, and difference, rate per second and seconds since the
    row before of the latest row. Of the times: first, last, span, mean and longest gap in seconds, days since the first
    and the last, distinct days, weeks and months. All of it is three windows over one exchange.
    """
    slices = resolve(slices, _sides(loans, child, key, at))
    side = F.lit(2 if strict else 0)
    times = {c: t for t, names in child.secondary.items() for c in names}
    by_time: dict[str, list[str]] = {child.time: []}
    for c in cols:
        by_time.setdefault(times.get(c, child.time), []).append(c)
    moves = [
        F.struct(F.col(t).alias("_at"), F.lit(t == child.time).alias("_one"), *[F.when(F.lit(c in names), F.col(c).cast("double")).alias(f"x{i}") for i, c in enumerate(cols)])
        for t, names in by_time.items()
    ]
    points = child.df.select(F.col(key).alias("_key"), side.alias("_side"), F.col(child.index).alias("_id"), F.inline(F.array(*moves)))
    points = points.where("_key IS NOT NULL AND _at IS NOT NULL")
    all_ = range(len(cols))
    at_ = F.col("_at")

    def plan(line: DataFrame, slices: Slices | None, step: Steps) -> DataFrame:
        # what came before this row
        accs = {"before": ("last", F.when(F.col("_one"), at_)), "n_before": ("sum", F.when(F.col("_one"), F.lit(1).cast("long")))}
        for i in all_:
            x = F.col(f"x{i}")
            here = F.when(x.isNotNull(), F.struct(*LINE, x.alias("x")))
            accs |= {f"p{i}": ("last", here), f"f{i}": ("min", here), f"k{i}": ("sum", F.when(x.isNotNull(), F.lit(1).cast("long")))}
        line = step(running(line, "_key", LINE, accs, slices, peers=False, previous=True))

        # steps from it, and sums of distances to the first row
        one = F.col("_one")
        gap = F.when(one, elapsed(at_, F.col("before")))
        accs = {"n": ("sum", F.when(one, F.lit(1).cast("long"))), "lo": ("min", F.when(one, at_)), "hi": ("max", F.when(one, at_)), "far": ("max", gap)}
        for unit in ("day", "week", "month"):
            new = F.col("before").isNull() | (F.date_trunc(unit, at_) != F.date_trunc(unit, F.col("before")))
            accs[unit] = ("sum", F.when(one & new, F.lit(1).cast("long")))
        for i in all_:
            x, p = F.col(f"x{i}"), F.col(f"p{i}")
            d, waited = x - p["x"], elapsed(at_, p["_at"])
            first = F.coalesce(F.col(f"f{i}"), F.when(x.isNotNull(), F.struct(*LINE, x.alias("x"))))
            t = F.when(x.isNotNull(), elapsed(at_, first["_at"]) / 86400)
            y = x - first["x"]
            turned = x.isNotNull() & (p.isNull() | (F.signum(x) != F.signum(p["x"])))
            place = _count(F.col(f"k{i}")) + 1
            accs |= {
                f"first{i}": ("min", first),
                f"start{i}": ("last", F.when(turned, place)),
                f"turns{i}": ("sum", F.when(turned & p.isNotNull(), F.lit(1).cast("long"))),
                f"down{i}": ("min", d),
                f"up{i}": ("max", d),
                f"step{i}": ("last", F.when(d.isNotNull(), F.struct(d.alias("d"), waited.alias("t")))),
                f"t{i}": ("sum", t),
                f"tt{i}": ("sum", t * t),
                f"ty{i}": ("sum", t * y),
                **{f"y{i}_{e}": ("sum", F.pow(y, F.lit(e))) for e in (1, 2, 3, 4)},
            }
        line = step(running(line, "_key", LINE, accs, slices, peers=False))

        # the open run, and the best so far
        accs = {}
        for i in all_:
            x = F.col(f"x{i}")
            length = _count(F.col(f"k{i}")) + 2 - F.col(f"start{i}")
            accs |= {f"run{i}_{s + 1}": ("max", F.when(F.signum(x) == s, length)) for s in (-1, 0, 1)}
        line = running(line, "_key", LINE, accs, slices, peers=False) if accs else line
        return line.where("_loan IS NOT NULL")

    out = _split(_line(loans, points, key, at), slices, plan)
    n = F.col("n")
    span = elapsed(F.col("hi"), F.col("lo"))
    facts = {
        f"{prefix}first_{child.time}": F.col("lo"),
        f"{prefix}last_{child.time}": F.col("hi"),
        f"{prefix}span_{child.time}": span,
        f"{prefix}avg_gap_{child.time}": F.try_divide(span, n - 1),
        f"{prefix}longest_gap_{child.time}": F.col("far"),
        f"{prefix}days_since_first_{child.time}": elapsed(at_, F.col("lo")) / 86400,
        f"{prefix}days_since_last_{child.time}": elapsed(at_, F.col("hi")) / 86400,
        **{f"{prefix}n_{unit}s_{child.time}": _count(F.col(unit)) for unit in ("day", "week", "month")},
    }
    for i, c in enumerate(cols):
        facts |= _column_facts(i, f"{prefix}%s_{c}")
    return _with_unplaced(loans, key, at, out, facts)


def _column_facts(i: int, name: str) -> dict[str, Column]:
    """The facts of column number i from its running sums; before a loan stand as many values as ``k`` says."""
    k = _count(F.col(f"k{i}"))
    n = F.when(k > 0, k.cast("double"))
    s1, s2, s3, s4 = (F.col(f"y{i}_{e}") for e in (1, 2, 3, 4))
    m = s1 / n
    m2 = F.greatest(s2 - n * m * m, F.lit(0.0))
    m3 = s3 - 3 * m * s2 + 2 * n * m * m * m
    m4 = s4 - 4 * m * s3 + 6 * m * m * s2 - 3 * n * m * m * m * m
    shaped = (k > 2) & (m2 > 0)
    t, tt, ty = (F.col(f"{c}{i}") for c in ("t", "tt", "ty"))
    spread = n * tt - t * t
    moved = F.col(f"step{i}")
    runs = {sign: _count(F.col(f"run{i}_{s + 1}")) for sign, s in (("positive", 1), ("zero", 0), ("negative", -1))}
    return {
        name % "first": F.col(f"first{i}.x"),
        name % "variance": F.when(k > 1, m2 / (n - 1)),
        name % "skew": F.when(shaped, F.sqrt(n) * m3 / F.pow(m2, F.lit(1.5))),
        name % "kurtosis": F.when(shaped, n * m4 / (m2 * m2) - 3),
        name % "trend": F.when((k > 1) & (spread > 0), (n * ty - t * s1) / spread),
        name % "increasing": F.when(k > 0, F.coalesce(F.col(f"down{i}") >= 0, F.lit(True))),
        name % "decreasing": F.when(k > 0, F.coalesce(F.col(f"up{i}") <= 0, F.lit(True))),
        **{name % f"longest_{sign}": c for sign, c in runs.items()},
        name % "sign_changes": _count(F.col(f"turns{i}")),
        name % "last_diff": moved["d"],
        name % "last_rate": F.try_divide(moved["d"], moved["t"]),
        name % "last_gap": moved["t"],
    }


def _with_unplaced(loans: DataFrame, key: str, at: str, placed: DataFrame, facts: dict[str, Column]) -> DataFrame:
    """Loan columns and facts of placed loans, and the loans that are on no time line: what counts is zero, the rest NULL."""
    out = placed.select("_loan.*", *[c.alias(n) for n, c in facts.items()])
    rest = loans.where(F.col(key).isNull() | F.col(at).isNull())
    blank = [F.lit(None if (kind := out.schema[n]).nullable else 0).cast(kind.dataType).alias(n) for n in facts]
    return out.unionByName(rest.select(*loans.columns, *blank))
