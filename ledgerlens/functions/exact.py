"""Sums of amounts that do not depend on the order of addition and can be taken back without a remainder.

Most columns of amounts have few digits. ``amount_kinds`` finds, in one job over the columns, how many digits before and after the
point hold every value, up to the last bits that earlier arithmetic left. Sums are then decimals of that scale, and a square is one decimal too, so a window needs
three running totals. Columns with other values ("odd": more digits, 1e16 and more, not finite) have a decimal part with ten
digits for the values that fit it; the others are added as doubles beside it, with their number, and count only where a
window holds any, so no remainder of them is left when they have gone. Infinities and NaN are never added: they are counted, as
taking one back would leave NaN. Squares of an odd column are added in three exact parts (of the whole part, of both, of the
fraction). Extremes, first and last values are never converted.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LARGE = 1e16
#: Digits after the point that are tried, and the most digits of an amount whose square is one decimal.
SCALES, NARROW = (2, 4, 6), 13
#: A double holds whole numbers up to here one by one.
WHOLE = float(2**53)
INF = float("inf")
#: Relative error that a few operations on doubles leave; a sum is no better for keeping it.
NOISE = 1e-15


@dataclass(frozen=True)
class Kind:
    """Digits before and after the point that hold all amounts of a column, or ``odd``."""

    whole: int = 16
    digits: int = 10
    odd: bool = True

    @property
    def narrow(self) -> bool:
        """Whether a square is one decimal."""
        return not self.odd and self.whole + self.digits <= NARROW


GENERAL = Kind()


def amount_kinds(df: DataFrame, columns: Sequence[str]) -> dict[str, Kind]:
    """The kind of every column, from one aggregation: the largest amount, and the scales that hold all of them."""
    if not columns:
        return {}
    exprs = []
    for i, c in enumerate(columns):
        x = F.col(f"`{c}`").cast("double")
        exprs.append(F.max(F.when(x.isNotNull(), F.abs(x))).alias(f"m{i}"))
        for d in SCALES:
            scaled = F.rint(x * float(10**d))
            exprs.append(F.min(_same(scaled / float(10**d), x) & (F.abs(scaled) < WHOLE)).alias(f"f{i}_{d}"))
    row = df.agg(*exprs).first()
    out = {}
    for i, c in enumerate(columns):
        most = row[f"m{i}"]
        digits = next((d for d in SCALES if row[f"f{i}_{d}"] in (True, None)), None)
        out[c] = GENERAL if digits is None or (most is not None and not most < LARGE) else Kind(len(str(int(most or 0))), digits, False)
    return out


def _same(decimal: Column, x: Column) -> Column:
    """Whether a double is a number of few digits but for the rounding of the steps that made it."""
    return F.abs(decimal - x) <= NOISE * F.abs(x)


def _fits(x: Column) -> Column:
    return F.coalesce(_same(_amount(x).cast("double"), x), F.lit(False))


def _amount(x: Column) -> Column:
    return F.when(F.abs(x) < LARGE, x.cast("decimal(26,10)"))


def _odd(x: Column) -> Column:
    """The value as a double if it is finite but has no exact decimal, else NULL."""
    return F.when(~_fits(x) & (F.abs(x) < INF), x)


def names(squares: bool = False, kind: Kind = GENERAL) -> list[str]:
    """The parts that ``parts`` makes."""
    if kind.odd:
        return ["n", "s", "l", "k", "p", "m", "z", *(["a", "b", "c", "q"] if squares else [])]
    return ["n", "s", *((["a"] if kind.narrow else ["a", "b", "c"]) if squares else [])]


def parts(value: Column, squares: bool = False, kind: Kind = GENERAL) -> dict[str, Column]:
    """What to add up: a count (``n``), a sum (``s``), and squares (``a``, or ``a, b, c``). An odd column has besides its odd values as
    doubles (``l``, their squares ``q``, their number ``k``) and the numbers of both infinities and of NaN (``p, m, z``)."""
    x = value.cast("double")
    out = {"n": value.isNotNull().cast("long")}
    if not kind.odd:
        exact = x.cast(f"decimal({kind.whole + kind.digits},{kind.digits})")
        out["s"] = exact
        if squares and kind.narrow:
            return out | {"a": exact * exact}
        return out | _limbs(exact) if squares else out
    exact, odd = F.when(_fits(x), _amount(x)), _odd(x)
    count = lambda c: F.when(x.isNotNull(), c.cast("long"))
    out |= {"s": exact, "l": odd, "k": count(odd.isNotNull()), "p": count(x == INF), "m": count(x == -INF), "z": count(F.isnan(x))}
    return out | _limbs(exact) | {"q": odd * odd} if squares else out


def _limbs(exact: Column) -> dict[str, Column]:
    """A square as the sum of three exact products: of the whole part, of both, of the fraction."""
    whole = F.floor(exact).cast("decimal(17,0)")
    rest = (exact - whole).cast("decimal(11,10)")
    return {"a": whole * whole, "b": whole * rest, "c": rest * rest}


def rounded(value: Column) -> Column:
    """A decimal as the nearest double. A plain cast divides the unscaled number, which a double holds up to 2**53; larger
    ones are parsed from their digits."""
    return F.when(F.abs(value) < 900_000, value.cast("double")).otherwise(value.cast("string").cast("double"))


def _unbounded(t: dict[str, Column], finite: Column) -> Column:
    """The sum where infinities or NaN are in the window."""
    if "p" not in t:
        return finite
    none = (t["z"] > 0) | ((t["p"] > 0) & (t["m"] > 0))
    return F.when(none, F.lit(float("nan"))).when(t["p"] > 0, F.lit(INF)).when(t["m"] > 0, F.lit(-INF)).otherwise(finite)


def total(t: dict[str, Column]) -> Column:
    """The sum as a double; NULL without values."""
    known = F.coalesce(rounded(t["s"]), F.lit(0.0))
    if "k" in t:
        known = F.when(t["k"] > 0, known + t["l"]).otherwise(known)
    return F.when(t["n"] > 0, _unbounded(t, known))


def mean(t: dict[str, Column]) -> Column:
    return total(t) / t["n"]


def _narrow_numerator(t: dict[str, Column], digits: int) -> Column:
    """n times the squares less the square of the sum, exactly where 38 digits hold it."""
    n, s, a = t["n"], F.coalesce(t["s"], F.lit(0)), F.coalesce(t["a"], F.lit(0))
    count = n.cast("double")
    small = (a.cast("double") < float(10 ** (27 - 2 * digits))) & (F.abs(s.cast("double")) < float(10 ** (17 - digits))) & (count < 1e9)
    exact = a.cast(f"decimal(27,{2 * digits})") * n.cast("decimal(9,0)") - s.cast(f"decimal(17,{digits})") * s.cast(f"decimal(17,{digits})")
    return F.when(small, exact.cast("double")).otherwise(a.cast("double") * count - s.cast("double") * s.cast("double"))


def _wide_numerator(t: dict[str, Column]) -> Column:
    """The same from three parts of the squares."""
    zero = lambda c, kind: F.coalesce(c, F.lit(0).cast(kind)).cast(kind)
    n, s = t["n"], F.coalesce(t["s"], F.lit(0)).cast("decimal(36,10)")
    a, b, c = (F.coalesce(t[k], F.lit(0).cast("decimal(10,0)")) for k in "abc")
    count = n.cast("double")
    small = a.cast("double") * count < 1e37
    if "k" in t:
        small = small & (t["k"] == 0)
    for value, bound in [(s, 1e18), (b, 1e17), (count, 1e8)]:
        small = small & (F.abs(value.cast("double")) < bound)
    m = n.cast("decimal(9,0)")
    whole = F.floor(s).cast("decimal(19,0)")
    rest = (s - whole).cast("decimal(11,10)")
    t0 = a.cast("decimal(38,0)") * m - whole * whole
    t1 = (b.cast("decimal(28,10)") * m).cast("decimal(36,10)") - whole * rest
    t2 = (c.cast("decimal(28,20)") * m).cast("decimal(36,20)") - rest * rest
    near = (F.abs(t0.cast("double")) < 1e16) & (F.abs(t1.cast("double")) < 1e16)
    exact = t0.cast("decimal(18,0)") + (t1 + t1).cast("decimal(28,10)") + t2
    limbs = F.when(near, exact.cast("double")).otherwise(t0.cast("double") + 2 * t1.cast("double") + t2.cast("double"))
    with_odd = (lambda c, more: F.when(t["k"] > 0, c + t[more]).otherwise(c)) if "k" in t else lambda c, more: c
    sums = with_odd(s.cast("double"), "l")
    squares = with_odd(zero(a, "double") + 2 * zero(b, "double") + zero(c, "double"), "q")
    return F.when(small, limbs).otherwise(squares * count - sums * sums)


def spread(t: dict[str, Column], kind: Kind = GENERAL) -> Column:
    """Sample deviation from the totals; NULL with fewer than two values, exactly zero for equal ones, NaN where a value is not
    finite."""
    count = t["n"].cast("double")
    numerator = _narrow_numerator(t, kind.digits) if "b" not in t else _wide_numerator(t)
    deviation = F.sqrt(F.greatest(numerator, F.lit(0.0)) / (count * (count - 1)))
    if "p" in t:
        deviation = F.when(t["p"] + t["m"] + t["z"] > 0, F.lit(float("nan"))).otherwise(deviation)
    return F.when(t["n"] > 1, deviation)


def exact_sum(value: Column) -> Column:
    """Aggregate: the sum as a double, in whatever order the rows come."""
    x = value.cast("double")
    known = F.coalesce(rounded(F.sum(F.when(_fits(x), _amount(x)))), F.lit(0.0))
    more = F.sum(F.when(~_fits(x), x))
    return F.when(F.count(value) > 0, F.coalesce(known + more, known))
