"""A typed graph of feature recipes: which columns can be made from which, to any depth, each once; saved and applied again.

A recipe names a primitive and the columns it takes. Primitives are typed (number, flag, time, text), so a graph only holds
what can be computed. A recipe that another one already gives (the absolute value of a negation), that undoes its input
(a negation of a negation) or that is constant (whether a calendar part of a known kind is missing) is left out. Columns of
one depth are made in one projection from columns of the depths before, so a shared input is computed once; ordered
primitives (cumulative, previous value) of one column share one window. Nothing here reads rows: a graph is built from
column names, and ``definitions`` is its table, from which ``from_definitions`` makes the same columns of another frame.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from itertools import combinations, product
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.operators import features as ft
from ledgerlens.operators.skew import Slices, as_list

NUMBER, FLAG, TIME, TEXT = "number", "flag", "time", "text"

#: Primitives of one column that are running or stepping along the rows of a retailer.
CUMULATIVE = ("cum_sum", "cum_count", "cum_mean", "cum_min", "cum_max", "expanding_std")
STEPS = ("lag", "diff", "rate", "same", "time_since_previous")


class Recipe(NamedTuple):
    """A derived column: its name, how it is made, of what kind it is and how many recipes lie below it."""

    name: str
    family: str
    primitive: str
    inputs: tuple[str, ...]
    kind: str
    depth: int


#: Primitives of a time, of a number, of two numbers.
CALENDAR = (
    "year", "quarter", "month", "week", "day", "day_of_year", "weekday", "hour", "minute", "second", "is_weekend", "is_month_start", "is_month_end",
    "is_quarter_start", "is_quarter_end", "is_year_start", "is_year_end", "is_leap_year", "days_in_month", "part_of_day", "is_working_hours",
)
UNARY = ("absolute", "negate", "sqrt", "log", "sine", "cosine", "tangent", "is_null")
PAIR = ("add", "sub", "mul", "div", "mod", "gt", "ge", "eq", "ne")


class Family(NamedTuple):
    """Primitives over columns of given kinds, and what computes them for given columns."""

    takes: tuple[str, ...]
    primitives: tuple[str, ...]
    made: Callable


def _since(a: str, b: str) -> list[ft.Feature]:
    return [ft.time_since_features([a], b)[0]._replace(params="time_since")]


FAMILIES = {
    "calendar": Family((TIME,), CALENDAR, ft.calendar_features),
    "unary": Family((NUMBER,), UNARY, lambda c: ft.unary_features([c])),
    "pair": Family((NUMBER, NUMBER), PAIR, lambda a, b: ft.pair_features([a, b])),
    "not": Family((FLAG,), ("not",), lambda a: ft.flag_features([a])),
    "flag": Family((FLAG, FLAG), ("and", "or"), lambda a, b: ft.flag_features([a, b])),
    "time_since": Family((TIME, TIME), ("time_since",), _since),
    "cumulative": Family((NUMBER,), CUMULATIVE, ft.cumulative_features),
    "step": Family((NUMBER,), STEPS, ft.step_features),
}
ORDERED = ("cumulative", "step")


def _name(primitive: str, inputs: tuple[str, ...]) -> str:
    if primitive == "time_since":
        return f"time_from_{inputs[0]}_to_{inputs[1]}"
    return f"{primitive}_{inputs[0]}" if len(inputs) == 1 else f"{inputs[0]}_{primitive}_{inputs[1]}"


_FLAGS = {"is_null", "gt", "ge", "eq", "ne", "not", "and", "or", "same"}


def _kind(primitive: str) -> str:
    if primitive in _FLAGS or primitive.startswith("is_"):
        return FLAG
    return TEXT if primitive == "part_of_day" else NUMBER


def kinds(df: DataFrame, columns: Iterable[str]) -> dict[str, str]:
    """The kind of each column; columns of other types are left out."""
    out = {}
    for c in columns:
        t = df.schema[c].dataType
        if isinstance(t, T.BooleanType):
            out[c] = FLAG
        elif isinstance(t, T.NumericType):
            out[c] = NUMBER
        elif isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            out[c] = TIME
        elif isinstance(t, T.StringType):
            out[c] = TEXT
    return out


def _meaning(primitive: str, inputs: tuple[str, ...], known: dict[str, Recipe]) -> tuple | None:
    """What a recipe computes, the same for recipes that compute the same; None if it says nothing new."""
    inner = known.get(inputs[0])
    if len(inputs) == 1 and inner is not None:
        chain = (primitive, inner.primitive)
        if chain in {("negate", "negate"), ("absolute", "absolute"), ("not", "not")}:
            return None
        if primitive == "absolute" and (inner.primitive in ("sqrt", "cum_count", "time_since_previous") or inner.family == "calendar"):
            return None  # never negative
        if primitive == "is_null" and (inner.kind == FLAG or inner.family == "calendar" or inner.primitive in ("cum_count", "absolute", "negate", "sine", "cosine", "tangent")):
            return None  # never missing, or missing where its input is
        if chain in {("absolute", "negate"), ("cosine", "negate"), ("cosine", "absolute")}:
            return _meaning(primitive, inner.inputs, known) or ("same", primitive, *inner.inputs)
        if chain == ("negate", "sub"):
            return ("sub", *reversed(inner.inputs))
        if chain == ("not", "eq") or chain == ("not", "ne"):
            return ({"eq": "ne", "ne": "eq"}[inner.primitive], *sorted(inner.inputs))
    if primitive in ("add", "mul", "eq", "ne", "and", "or"):
        return (primitive, *sorted(inputs))
    return (primitive, *inputs)


def grow(base: dict[str, str], levels: Sequence[Sequence[str]], allow: Callable[[Recipe], bool] = lambda r: True) -> list[Recipe]:
    """All recipes over the ``base`` columns (name -> kind): one level of families after the other, each over everything made so far,
    with at least one input of the level before. ``allow`` may leave recipes out."""
    known: dict[str, Recipe] = {}
    kind = dict(base)
    depth = {c: 0 for c in base}
    seen: set[tuple] = set()
    for level, families in enumerate(levels, 1):
        made: list[Recipe] = []
        for family in families:
            takes, primitives, _ = FAMILIES[family]
            fitting = [[c for c in kind if kind[c] == t] for t in takes]
            if len(takes) == 2:
                choices = product(*fitting) if family == "time_since" else combinations(fitting[0], 2)
            else:
                choices = ((c,) for c in fitting[0])
            for inputs in choices:
                if inputs[0] == inputs[-1] and len(inputs) == 2 or max(depth[c] for c in inputs) != level - 1:
                    continue
                for primitive in primitives:
                    recipe = Recipe(_name(primitive, inputs), family, primitive, inputs, _kind(primitive), level)
                    meaning = _meaning(primitive, inputs, known)
                    if meaning is None or meaning in seen or recipe.name in kind or not allow(recipe):
                        continue
                    seen.add(meaning)
                    made.append(recipe)
        for r in made:
            known[r.name], kind[r.name], depth[r.name] = r, r.kind, r.depth
    return list(known.values())


def closed(wanted: Iterable[Recipe], recipes: Iterable[Recipe]) -> list[Recipe]:
    """The wanted recipes with those that they are made from, in an order in which they can be made."""
    by_name = {r.name: r for r in recipes}
    need, stack = {}, list(wanted)
    while stack:
        r = stack.pop()
        if r.name not in need:
            need[r.name] = r
            stack += [by_name[c] for c in r.inputs if c in by_name]
    return sorted(need.values(), key=lambda r: (r.depth, r.name))


def _features(recipes: Sequence[Recipe]) -> list[ft.Feature]:
    """What computes the recipes; those of one family over the same columns are made together."""
    asked: dict[tuple, dict[str, Recipe]] = {}
    for r in recipes:
        asked.setdefault((r.family, r.inputs), {})[r.primitive] = r
    return [f._replace(name=of[f.params].name) for (family, inputs), of in asked.items() for f in FAMILIES[family].made(*inputs) if f.params in of]


def apply(df: DataFrame, recipes: Sequence[Recipe], key: str, order: str | Sequence[str], slices: Slices | None = None) -> DataFrame:
    """The frame with the columns of all recipes. Ordered primitives run along ``order`` within ``key``."""
    for level in sorted({r.depth for r in recipes}):
        now = [r for r in recipes if r.depth == level]
        plain = _features([r for r in now if r.family not in ORDERED])
        before = df.columns
        for family in ORDERED:
            for c in dict.fromkeys(r.inputs[0] for r in now if r.family == family):
                df = FAMILIES[family].made(df, key, as_list(order), c, slices)
        asked = {r.name for r in now}
        df = ft.dfs_transform(df.select(*before, *[c for c in df.columns if c not in before and c in asked]), plain)
    return df


def definitions(spark: SparkSession, recipes: Sequence[Recipe]) -> DataFrame:
    """``name, family, primitive, inputs, kind, depth``; the table that a frame can be made from again."""
    return spark.createDataFrame([tuple(r[:3]) + (list(r.inputs), r.kind, r.depth) for r in recipes], "name string, family string, primitive string, inputs array<string>, kind string, depth int")


def from_definitions(defs: DataFrame) -> list[Recipe]:
    """Recipes of a saved table: one row per feature column."""
    return [Recipe(r["name"], r["family"], r["primitive"], tuple(r["inputs"]), r["kind"], r["depth"]) for r in defs.orderBy("depth", "name").collect()]
