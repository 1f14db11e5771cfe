"""One wide frame of features for every loan of every retailer."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators import features as ft
from ledgerlens.operators import prefix, recipes, series
from ledgerlens.operators.shape import drop_leaky
from ledgerlens.operators.skew import Slices, measure
from ledgerlens.schemas import KEY
from ledgerlens.session import materialise

ISSUED = "LOAN_ISSUANCE_DATE"
ORDER = [ISSUED, "LOAN_ID"]

def entity_set(views: dict[str, DataFrame]) -> ft.EntitySet:
    """The lending tables as entities; ``STATUS`` and ``TOTAL_AMOUNT_PAID`` are known from ``UPDATED_AT`` on."""
    ignored = (KEY,)
    entities = {"loans": ft.Entity(drop_leaky(views["loans"]), "LOAN_ID", ISSUED, ignored=("LOAN_ID", KEY))}
    if "sales" in views:
        entities["sales"] = ft.Entity(views["sales"], "ID", "CREATED_AT", {"UPDATED_AT": ["STATUS", "TOTAL_AMOUNT_PAID"]}, ("ID", *ignored))
    if "purchases" in views:
        entities["purchases"] = ft.Entity(views["purchases"], "ORDER_ID", "ORDER_CREATION_DATE", ignored=("ORDER_ID", *ignored))
    return ft.EntitySet(KEY, "loans", entities)


def loan_transforms(loans: DataFrame, slices: Slices | None = None) -> tuple[DataFrame, list[ft.Feature]]:
    """Transforms of the loan's own columns, two levels deep, and its place in the retailer's sequence of loans."""
    amounts = ["LOAN_AMOUNT", "TOTAL_INITIAL_AMOUNT"]
    pairs = ft.pair_features(amounts)
    first = [*ft.calendar_features(ISSUED), *ft.unary_features(amounts), *pairs, *ft.time_since_features([ISSUED], "INITIAL_DATE")]
    second = ft.depth2_features(pairs, [("log", f.name) for f in pairs if "_add_" in f.name] + [("sqrt", f.name) for f in pairs if "_mul_" in f.name])
    wide = ft.dfs_transform(ft.dfs_transform(loans, first), second)
    wide = ft.cumulative_features(wide, KEY, ORDER, "LOAN_AMOUNT", slices)
    wide = ft.step_features(wide, KEY, ORDER, "LOAN_AMOUNT", slices)
    wide = ft.rolling_row_features(wide, KEY, ORDER, "LOAN_AMOUNT", 3, slices)
    known = {f.name for f in first + second}
    placed = [c for c in wide.columns if c not in loans.columns and c not in known]
    ordered = [ft.Feature(c, "ordered", ("LOAN_AMOUNT",), c, F.col(c)) for c in placed]
    return wide, [*first, *second, *ordered]


def with_history(loans: DataFrame, child: ft.Entity, name: str, slices: Slices | None = None) -> DataFrame:
    """Loans with what was known of a child table when each was issued; the loan's columns are carried along."""
    unique = ["STATUS"] if name == "sales" else []
    return ft.point_in_time(loans, child, KEY, child.numeric(), unique, prefix=f"{name}_", carry=True, slices=slices)


def retailer_features(child: ft.Entity, name: str, at: datetime) -> DataFrame:
    """Features of one child table per retailer over the whole history."""
    prefix = f"{name}_"
    out = ft.dfs_agg(child.df, KEY, child.numeric(), prefix)
    if name == "sales":
        out = out.join(ft.categorical_aggregates(child.df, KEY, "STATUS", prefix), KEY, "left")
    return out.join(ft.time_aggregates(child.df, KEY, child.time, at, prefix), KEY, "left")


def measured(es: ft.EntitySet, **limits) -> Slices | None:
    """Heavy retailers over loans and child rows together, and cuts of their times; one counting job over the keys."""
    times = [e.df.select(KEY, F.col(e.time).alias("_at")) for e in es.entities.values()]
    return measure(reduce(DataFrame.unionByName, times), KEY, "_at", **limits)


def issuance_frame(es: ft.EntitySet, slices: Slices | None = None) -> tuple[DataFrame, list[ft.Feature]]:
    """What was known when each loan was issued. ``slices``: of a frame that holds heavy retailers only.

    Each window over slices reads its input twice (the rows, and what earlier slices add up to), so the heavy rows are
    written after each step instead of repeating the steps before it.
    """
    step = (lambda df: df) if slices is None else materialise
    frame, made = loan_transforms(es.entities["loans"].df, slices)
    frame = step(frame)
    loans, before = es.entities[es.target], set(frame.columns)
    frame = step(ft.point_in_time(frame, loans, KEY, loans.numeric(), prefix="loans_", carry=True, slices=slices, strict=True))
    made += [ft.Feature(c, "earlier_loans", ("loans",), c, F.col(c)) for c in frame.columns if c not in before]
    for name, child in es.children().items():
        before = set(frame.columns)
        frame = step(with_history(frame, child, name, slices))
        made += [ft.Feature(c, "point_in_time", (name,), c, F.col(c)) for c in frame.columns if c not in before]
    return frame, made


def wide_issuance_frame(es: ft.EntitySet, slices: Slices | None = None) -> tuple[DataFrame, list[ft.Feature]]:
    """The issuance frame, more of every table's past, and features of features. The past is written before those are made: it
    is several windows, and they are many expressions."""
    frame, made = issuance_frame(es, slices)
    frame, past = with_past(frame, es, slices)
    frame, more = composed(materialise(frame), slices)
    return frame, [*made, *past, *more]


#: What the wide frame adds of each table: columns whose quartiles and whose most frequent values are of interest.
QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}
RANKED = {"loans": ["LOAN_AMOUNT"], "sales": ["TOTAL_AMOUNT_PAID"], "purchases": ["ORDER_PRICE"]}
COUNTED = {"sales": ["STATUS"], "purchases": ["DISCOUNT"]}


def with_past(frame: DataFrame, es: ft.EntitySet, slices: Slices | None = None) -> tuple[DataFrame, list[ft.Feature]]:
    """Shape, trend, runs, steps, gaps, quartiles and modes of every table's past, for each loan (see ``operators.prefix``).

    Only the loan's key and time go through the windows of each kind of facts. The frame is written once, and all facts are
    joined to it by the number of its row, each set as one column, so the wide rows are moved once and not with every window.
    """
    made = []
    numbered = materialise(frame.withColumn("_past_of", F.monotonically_increasing_id()))
    asking, joined, names = numbered.select("_past_of", KEY, ISSUED), numbered, list(frame.columns)

    def learn(name: str, found: DataFrame) -> None:
        nonlocal joined, names
        new = [c for c in found.columns if c not in asking.columns]
        made.extend(ft.Feature(c, "past", (name,), c, F.col(c)) for c in new if c not in frame.columns)
        joined = joined.join(found.select("_past_of", F.struct(*new).alias(f"_past{len(made)}")), "_past_of", "left")
        names = [c for c in names if c not in new] + [f"_past{len(made)}.`{c}`" for c in new]

    for name, child in es.entities.items():
        common = {"strict": name == es.target, "slices": slices}
        learn(name, prefix.history_so_far(asking, child, KEY, child.numeric(), prefix=f"{name}_", **common))
        for c in (c for c in COUNTED.get(name, []) if c in child.df.columns):
            learn(name, prefix.categories_so_far(asking, child, KEY, c, prefix=f"{name}_", **common))
        for c in (c for c in RANKED.get(name, []) if c in child.df.columns):
            learn(name, prefix.quantiles_so_far(asking, child, KEY, c, {f"{name}_{q}_{c}": p for q, p in QUARTILES.items()}, **common))
    return joined.select(*names), made


def composed(frame: DataFrame, slices: Slices | None = None) -> tuple[DataFrame, list[ft.Feature]]:
    """Features of features of the loan's own columns (see ``operators.recipes``); what the frame already has is not made again."""
    own = ("LOAN_AMOUNT", "TOTAL_INITIAL_AMOUNT", ISSUED, "INITIAL_DATE")
    first = ("calendar", "unary", "pair", "time_since", "cumulative", "step")
    arithmetic = lambda r: r.primitive in ("add", "sub", "mul", "div", "gt") and len(set(r.inputs) & set(own)) == 1
    graph = recipes.grow(recipes.kinds(frame, own), [first, ("unary", "not", "pair")], lambda r: r.depth == 1 or r.family != "pair" or arithmetic(r))
    missing = [r for r in graph if r.name not in frame.columns]
    return recipes.apply(frame, missing, KEY, ORDER, slices), [ft.Feature(r.name, f"depth{r.depth}", r.inputs, r.primitive, F.col(r.name)) for r in missing]


def build_feature_frame(
    views: dict[str, DataFrame], cutoff: str | None = "issuance", with_series: bool = False, at: datetime | None = None, wide: bool = False, **limits
) -> tuple[DataFrame, DataFrame]:
    """``LOAN_ID, MAIN_SYSTEM_ID`` and features, and the definitions of the features.

    ``cutoff="issuance"`` uses only what was known when the loan was issued; ``wide`` adds more of the past and features of
    features, more than a thousand columns in all. Heavy retailers (``limits``, see ``skew``) are
    measured once and set apart at the input: the chain of windows is planned once for the light and once for the heavy
    rows, and both are put together at the end. ``cutoff=None`` aggregates the whole history, with ages counted to ``at``, by
    default the newest time in the tables (an eager job); ``with_series`` adds time-series features of each retailer's order
    prices, which look at the whole history too and would tell an issuance frame what came later.
    """
    if cutoff == "issuance" and with_series:
        raise ValueError("series features cover the whole history; use cutoff=None")
    es = entity_set(views)
    if cutoff == "issuance":
        slices = measured(es, **limits)
        build = wide_issuance_frame if wide else issuance_frame
        if slices is None:
            frame, made = build(es)
        else:
            hot = F.broadcast(slices.hot)
            light, made = build(es.restricted(hot, "left_anti"))
            frame = light.unionByName(build(es.restricted(hot, "left_semi"), slices.alone())[0])
        return frame.drop(ISSUED, "INITIAL_DATE"), ft.feature_defs(frame.sparkSession, made)
    loans = es.entities["loans"].df
    if at is None:
        newest = [e.df.agg(F.max(e.time)).first()[0] for e in es.entities.values()]
        at = max((t for t in newest if t is not None), default=datetime(1970, 1, 1))
    frame, made = loan_transforms(loans, measure(loans, KEY, ISSUED))
    parents = []
    for name, child in es.children().items():
        parents.append(retailer_features(child, name, at))
        made += [ft.Feature(c, "aggregate", (name,), c, F.col(c)) for c in parents[-1].columns if c != KEY]
    if with_series and "purchases" in es.entities:
        parents.append(series.ts_features(es.entities["purchases"].df, KEY, ["ORDER_CREATION_DATE", "ORDER_ID"], "ORDER_PRICE", "ts_"))
        made += [ft.Feature(c, "series", ("purchases",), c, F.col(c)) for c in parents[-1].columns if c != KEY]
    if parents:
        frame = ft.dfs_direct(frame, KEY, *parents, slices=measure(loans, KEY, "LOAN_ID"))
    return frame.drop(ISSUED, "INITIAL_DATE"), ft.feature_defs(frame.sparkSession, made)
