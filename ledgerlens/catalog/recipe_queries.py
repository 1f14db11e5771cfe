"""Features of features: recipe graphs over the loans, stated in SQL level by level."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.catalog.prefix_queries import _RUN_NAMES, _STEP_NAMES, _TIMES, _result
from ledgerlens.catalog.registry import ORACLE, query
from ledgerlens.catalog.synthesis import _CALENDAR, _L
from ledgerlens.catalog.synthesis import TS as _ORDERED_AT
from ledgerlens.catalog.views_sql import with_views
from ledgerlens.operators import recipes
from ledgerlens.operators.skew import measure
from ledgerlens.plans import feature_frame
from ledgerlens.schemas import KEY
from ledgerlens.session import materialise
from ledgerlens.sources.adapters import load_views

BASE = {"LOAN_AMOUNT": recipes.NUMBER, "TOTAL_INITIAL_AMOUNT": recipes.NUMBER, _L: recipes.TIME, "INITIAL_DATE": recipes.TIME}
FIRST = ("calendar", "unary", "pair", "time_since", "cumulative", "step")
ORDER = [_L, "LOAN_ID"]
#: Functions whose last digit may differ between engines are compared to six digits; the second level starts from numbers rounded like that.
DIGITS = 6
INEXACT = ("log", "sine", "cosine", "tangent", "expanding_std")
#: Arithmetic of the second level.
PAIRED = ("add", "sub", "mul", "div", "gt")

_UNARY = {
    "absolute": "abs({0})", "negate": "-{0}", "sqrt": "CASE WHEN {0} >= 0 THEN sqrt({0}) END", "log": "CASE WHEN {0} > 0 THEN ln({0}) END",
    "sine": "sin({0})", "cosine": "cos({0})", "tangent": "tan({0})", "is_null": "{0} IS NULL", "not": "NOT {0}",
}
_PAIR = {
    "add": "{0} + {1}", "sub": "{0} - {1}", "mul": "{0} * {1}", "div": "{0} / nullif({1}, 0)", "mod": "{0} % nullif({1}, 0)", "gt": "{0} > {1}",
    "ge": "{0} >= {1}", "eq": "{0} = {1}", "ne": "{0} <> {1}", "and": "{0} AND {1}", "or": "{0} OR {1}", "time_since": "(epoch_us({1}) - epoch_us({0})) / 1e6",
}
_TOTAL = "(sum({0}::VARCHAR::DECIMAL(28,10)) OVER c)::VARCHAR::DOUBLE"
_ORDERED = {
    "cum_sum": _TOTAL, "cum_count": "count({0}) OVER c", "cum_mean": _TOTAL + " / nullif(count({0}) OVER c, 0)", "cum_min": "min({0}) OVER c", "cum_max": "max({0}) OVER c",
    "expanding_std": "stddev_samp({0}) OVER c", "lag": "lag({0}) OVER w", "diff": "{0} - lag({0}) OVER w", "same": "{0} = lag({0}) OVER w",
    "rate": f"({{0}} - lag({{0}}) OVER w) / nullif((epoch_us({_L}) - epoch_us(lag({_L}) OVER w)) / 1e6, 0)",
    "time_since_previous": f"(epoch_us({_L}) - epoch_us(lag({_L}) OVER w)) / 1e6",
}


def _sql(r: recipes.Recipe) -> str:
    if r.family == "calendar":
        return f"{_CALENDAR[r.primitive].replace(_L, r.inputs[0])} AS {r.name}"
    form = (_UNARY | _PAIR | _ORDERED)[r.primitive].format(*r.inputs)
    return f"{f'round({form}, {DIGITS})' if r.primitive in INEXACT else form} AS {r.name}"


_WINDOWS = "WINDOW w AS (PARTITION BY MAIN_SYSTEM_ID ORDER BY LOAN_ISSUANCE_DATE, LOAN_ID), c AS (PARTITION BY MAIN_SYSTEM_ID ORDER BY LOAN_ISSUANCE_DATE, LOAN_ID ROWS UNBOUNDED PRECEDING)"


def two_levels(second):
    """Recipes of all families over the loans' own columns, and of some over those."""
    return recipes.grow(BASE, [FIRST, second], lambda r: r.depth == 1 or r.family != "pair" or (r.primitive in PAIRED and len(set(r.inputs) & set(BASE)) == 1))


def _level_sql(level, source, windows=""):
    return f"SELECT *, {', '.join(_sql(r) for r in level)} FROM {source} {windows}"


def _depth2_sql(graph, wanted):
    by_level = [[r for r in recipes.closed(wanted, graph) if r.depth == d] for d in (1, 2)]
    names = ", ".join(r.name for r in wanted)
    return with_views(f"SELECT LOAN_ID, {names} FROM b", f"a AS ({_level_sql(by_level[0], 'loans', _WINDOWS)})", f"b AS ({_level_sql(by_level[1], 'a')})", names="loans")


def rounded_levels(df, chosen, slices=None):
    """The recipes applied level by level, inexact functions rounded after each, so that both engines go on from equal numbers."""
    for depth in (1, 2):
        now = [r for r in chosen if r.depth == depth]
        inexact = {r.name for r in now if r.primitive in INEXACT}
        df = recipes.apply(df, now, KEY, ORDER, slices)
        df = df.select(*[F.round(c, DIGITS).alias(c) if c in inexact else c for c in df.columns])
    return df


def _depth2_query(name, second, family):
    graph = two_levels(second)
    wanted = [r for r in graph if r.depth == 2 and r.family in family]

    @query(name, _depth2_sql(graph, wanted))
    def _(spark, sf_dir):
        """Rebuilt from the saved table of definitions, as a later run would do it."""
        path = materialise(recipes.definitions(spark, recipes.closed(wanted, graph)))
        loans = load_views(spark, sf_dir)["loans"].select("LOAN_ID", KEY, *BASE)
        out = rounded_levels(loans, recipes.from_definitions(path), measure(loans, KEY, _L))
        return out.select("LOAN_ID", *[r.name for r in wanted])


_depth2_query("d12_depth2_all", ("unary", "not"), ("unary", "not"))
_depth2_query("d12_depth2_pairs", ("pair",), ("pair",))


def _joined(*names):
    """SQL of several registered queries joined on the loan."""
    parts = " JOIN ".join(f"({ORACLE[n]}) q{i}" if not i else f"({ORACLE[n]}) q{i} USING (LOAN_ID)" for i, n in enumerate(names))
    return f"SELECT * FROM {parts}"


_PAST = ["d13_times", "d5_at_issuance", "d10_at_issuance", "d13_mode_status"]


@query("d15_feature_frame_wide", _joined(*_PAST))
def _(spark, sf_dir):
    """The frame of more than a thousand columns; shown are those of its past that other queries compute on their own."""
    frame = feature_frame.build_feature_frame(load_views(spark, sf_dir), wide=True)[0]
    if len(frame.columns) <= 1000:
        raise AssertionError(f"only {len(frame.columns)} columns")
    facts = {f"purchases_{n}_{_ORDERED_AT}": f"{n}_{_ORDERED_AT}" for n in _TIMES}
    facts |= {f"purchases_{n}_DISCOUNT": f"{n}_DISCOUNT" for n in _RUN_NAMES} | {f"purchases_{n}_ORDER_PRICE": f"{n}_ORDER_PRICE" for n in _STEP_NAMES}
    facts |= {f"sales_{n}_STATUS": f"{n}_STATUS" for n in ("mode", "mode_count", "num_unique", "percent_unique", "entropy")}
    return _result(frame.select("LOAN_ID", *[F.col(c).alias(n) for c, n in facts.items()]), list(facts.values()))
