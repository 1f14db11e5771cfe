"""Facts known at the moment of a loan: against plain Python over each loan's history, whole and in slices."""

from __future__ import annotations

import math
import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from conftest import assert_same

from ledgerlens.operators import prefix, skew
from ledgerlens.operators.features import Entity
from ledgerlens.operators.temporal import measure_sides

AT = "LOAN_ISSUANCE_DATE"
START = datetime(2024, 1, 1)
CHILD = "id long, k long, ts timestamp_ntz, later timestamp_ntz, x double, y double, s string"
LOANS = "LOAN_ID long, k long, LOAN_ISSUANCE_DATE timestamp_ntz, x string"


def history(rng, keys=6, rows=240, loans=80):
    day = lambda: START + timedelta(hours=rng.randrange(0, 24 * 40, 6))
    child = []
    for i in range(rows):
        k = rng.choice([0, 0, 0, *range(1, keys)])
        ts = None if rng.random() < 0.05 else day()
        later = None if ts is None or rng.random() < 0.1 else ts + timedelta(hours=rng.randrange(100))
        x = None if rng.random() < 0.1 else rng.choice([-2.0, -1.0, 0.0, 0.0, 1.5, 3.0, round(rng.gauss(5, 4), 2)])
        child.append((i, k if rng.random() > 0.03 else None, ts, later, x, rng.choice([None, 1.0, 2.0, 7.5]), rng.choice([None, "a", "b", "c"])))
    asked = [(1000 + i, rng.choice([None, *range(keys + 1)]) if rng.random() < 0.1 else rng.randrange(keys + 1), None if rng.random() < 0.05 else day(), "other") for i in range(loans)]
    return child, asked + [asked[0], asked[5]]


@pytest.fixture(scope="module")
def frames(spark):
    child, loans = history(random.Random(1))
    entity = Entity(spark.createDataFrame(child, CHILD), "id", "ts", {"later": ["y", "s"]})
    return child, loans, spark.createDataFrame(loans, LOANS).repartition(3), entity


def known(child, loan, col, strict=False):
    """(time, id, value) of what a loan knows, in time order."""
    at = {"x": (2, 4), "y": (3, 5), "s": (3, 6)}[col]
    rows = [(r[at[0]], r[0], r[at[1]]) for r in child if r[1] is not None and r[1] == loan[1] and r[at[0]] is not None and r[at[1]] is not None]
    return sorted(r for r in rows if loan[2] is not None and (r[0] < loan[2] or (r[0] == loan[2] and not strict)))


def same(df, want):
    """Rows by loan, doubles within a tolerance; loans may repeat."""
    got = sorted((tuple(r) for r in df.collect()), key=lambda t: tuple((x is None, str(x)) for x in t))
    want = sorted(want, key=lambda t: tuple((x is None, str(x)) for x in t))
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=lambda t: t[0]), sorted(want, key=lambda t: t[0])):
        for x, y in zip(a, b):
            assert x == (pytest.approx(y, rel=1e-9, abs=1e-9) if isinstance(y, float) else y), (a, b)


def cut_up(frames, pieces=5):
    _, _, loans, entity = frames
    slices = measure_sides(loans, entity.df, AT, entity.time, "k", hot_rows=60, share=0.0, pieces=pieces)
    assert slices is not None and 0 < slices.hot.count() < 7
    return slices


@pytest.mark.parametrize("col, fanout, strict, sliced", [("x", 16, False, False), ("x", 3, True, False), ("y", 2, False, False), ("x", 16, True, True), ("y", 4, False, True)])
def test_quantiles(frames, col, fanout, strict, sliced):
    child, loans, df, entity = frames
    probs = {"lo": 0.0, "q": 0.3, "med": 0.5, "hi": 1.0}
    want = []
    for loan in loans:
        v = [x for _, _, x in known(child, loan, col, strict)]
        want.append((loan[0], *[float(np.quantile(v, p)) if v else None for p in probs.values()]))
    slices = cut_up(frames) if sliced else None
    same(prefix.quantiles_so_far(df, entity, "k", col, probs, strict=strict, slices=slices, fanout=fanout).select("LOAN_ID", *probs), want)


@pytest.mark.parametrize("sliced", [False, True])
@pytest.mark.parametrize("col", ["x", "y", "s"])
def test_categories(frames, col, sliced):
    child, loans, df, entity = frames
    want = []
    for loan in loans:
        c = Counter(x for _, _, x in known(child, loan, col))
        n = sum(c.values())
        mode = min(((-m, v) for v, m in c.items()), default=(0, None))
        entropy = max(0.0, math.log(n) - sum(m * math.log(m) for m in c.values()) / n) if n else None
        want.append((loan[0], mode[1], -mode[0], len(c), len(c) / n if n else None, entropy))
    out = prefix.categories_so_far(df, entity, "k", col, slices=cut_up(frames) if sliced else None)
    same(out.drop("k", AT, "x"), want)


def longest(signs, sign):
    best = run = 0
    for s in signs:
        run = run + 1 if s == sign else 0
        best = max(best, run)
    return best


def plain_history(child, loan, col):
    rows = known(child, loan, col)
    v, t = np.array([r[2] for r in rows]), np.array([(r[0] - START).total_seconds() for r in rows])
    n = len(v)
    if not n:
        return (None,) * 7 + (0, 0, 0, 0) + (None,) * 3
    d, gap, signs = np.diff(v), np.diff(t), np.sign(v)
    m = v - v.mean()
    shaped = n > 2 and len(set(v.tolist())) > 1
    return (
        float(v[0]),
        float(v.var(ddof=1)) if n > 1 else None,
        float((m**3).mean() / (m**2).mean() ** 1.5) if shaped else None,
        float((m**4).mean() / (m**2).mean() ** 2 - 3) if shaped else None,
        float(np.polyfit(t / 86400 - t[0] / 86400, v, 1)[0]) if n > 1 and t[-1] > t[0] else None,
        bool((d >= 0).all()),
        bool((d <= 0).all()),
        *[longest(signs, s) for s in (1, 0, -1)],
        int((np.diff(signs) != 0).sum()),
        float(d[-1]) if n > 1 else None,
        float(d[-1] / gap[-1]) if n > 1 and gap[-1] else None,
        float(gap[-1]) if n > 1 else None,
    )


COLUMN = "first variance skew kurtosis trend increasing decreasing longest_positive longest_zero longest_negative sign_changes last_diff last_rate last_gap".split()
TIMES = "first last span avg_gap longest_gap days_since_first days_since_last n_days n_weeks n_months".split()


@pytest.mark.parametrize("pieces", [None, 2, 7])
@pytest.mark.parametrize("col", ["x", "y"])
def test_shape_trend_and_runs(frames, col, pieces):
    """Equal for the plain windows and however heavy keys are sliced."""
    child, loans, df, entity = frames
    slices = pieces and cut_up(frames, pieces)
    out = prefix.history_so_far(df, entity, "k", ["x", "y"], slices=slices).select("LOAN_ID", *[f"{n}_{col}" for n in COLUMN])
    same(out, [(loan[0], *plain_history(child, loan, col)) for loan in loans])


@pytest.mark.parametrize("strict, sliced", [(False, False), (True, True)])
def test_times(frames, sliced, strict):
    child, loans, df, entity = frames
    want = []
    for loan in loans:
        t = sorted(r[2] for r in child if None not in (r[1], loan[1], loan[2], r[2]) and r[1] == loan[1] and (r[2] < loan[2] or (r[2] == loan[2] and not strict)))
        if not t:
            want.append((loan[0], *[None] * 7, 0, 0, 0))
            continue
        gaps, span = [(b - a).total_seconds() for a, b in zip(t, t[1:])], (t[-1] - t[0]).total_seconds()
        since = [(loan[2] - x).total_seconds() / 86400 for x in (t[0], t[-1])]
        units = [len({x.date() for x in t}), len({x.isocalendar()[:2] for x in t}), len({(x.year, x.month) for x in t})]
        want.append((loan[0], t[0], t[-1], span, span / len(gaps) if gaps else None, max(gaps, default=None), *since, *units))
    out = prefix.history_so_far(df, entity, "k", [], strict=strict, slices=cut_up(frames) if sliced else None)
    same(out.select("LOAN_ID", *[f"{n}_ts" for n in TIMES]), want)


def test_empty_sides(spark, frames):
    _, _, loans, entity = frames
    none = Entity(entity.df.limit(0), "id", "ts", entity.secondary)
    for out, column in (
        (prefix.quantiles_so_far(loans, none, "k", "x", {"m": 0.5}), "m"),
        (prefix.categories_so_far(loans, none, "k", "s"), "mode_s"),
        (prefix.history_so_far(loans, none, "k", ["x"]), "trend_x"),
    ):
        assert out.count() == loans.count() and out.where(f"{column} is not null").isEmpty()
    for fn in (lambda e: prefix.quantiles_so_far(loans.limit(0), e, "k", "x", {"m": 0.5}), lambda e: prefix.history_so_far(loans.limit(0), e, "k", ["x"])):
        assert fn(entity).count() == 0


def test_one_exchange_by_key(frames, capsys):
    """All windows of light retailers share one partitioning; no step shuffles again."""
    _, _, loans, entity = frames
    for out in (prefix.history_so_far(loans, entity, "k", ["x", "y"], slices=None), prefix.categories_so_far(loans, entity, "k", "s", slices=None)):
        out.explain("simple")
        plan = capsys.readouterr().out
        assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_measured_by_default(frames, monkeypatch):
    """Loans and child rows are measured together."""
    _, _, loans, entity = frames
    seen = []
    monkeypatch.setattr(prefix, "measure_sides", lambda *a, **b: seen.append(a) or None)
    prefix.history_so_far(loans, entity, "k", ["x"])
    assert len(seen) == 1 and seen[0][0] is loans


def test_slices_of_quantile_sketch_do_not_change_results(frames):
    _, _, loans, entity = frames
    assert_same(
        prefix.categories_so_far(loans, entity, "k", "x", slices=skew.Slices(("k",), loans.select("k").where("k < 2").distinct(), (1.7055e15, 1.7060e15))),
        prefix.categories_so_far(loans, entity, "k", "x", slices=None),
    )
