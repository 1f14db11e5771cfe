from __future__ import annotations

import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

from ledgerlens.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(8, "6g", "tests")
    if not session.sparkContext.getCheckpointDir():
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    return session


@pytest.fixture(scope="session")
def views(spark):
    from ledgerlens.sources.adapters import load_views

    return {name: frame.persist() for name, frame in load_views(spark, SF).items()}


@pytest.fixture(scope="session")
def sparse(spark):
    from ledgerlens.sources.adapters import load_views

    return {name: frame.persist() for name, frame in load_views(spark, SF, "sparse").items()}


def rows(df, digits=7):
    """Sorted rows with rounded doubles, for comparing frames."""

    def plain(v):
        if isinstance(v, float):
            return "nan" if v != v else round(v, digits) + 0.0
        return v

    names = sorted(df.columns)
    return sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=lambda t: tuple((x is None, str(x)) for x in t))


def assert_same(left, right, tolerance=1e-7):
    """Equal columns and rows; doubles within a tolerance."""
    assert sorted(left.columns) == sorted(right.columns)
    names = sorted(left.columns)
    ordered = [names[i] for i in sorted(range(len(names)), key=lambda i: (dict(left.dtypes)[names[i]] == "double", i))]
    key = lambda t: tuple((x is None, str(round(x, 3)) if isinstance(x, float) else str(x)) for x in t)
    a, b = (sorted((tuple(r[n] for n in ordered) for r in df.collect()), key=key) for df in (left, right))
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x == pytest.approx(y, rel=tolerance, abs=tolerance, nan_ok=True) if all(isinstance(v, (int, float)) for v in x + y) else _alike(x, y, tolerance)


def _alike(x, y, tolerance):
    return all(p == pytest.approx(q, rel=tolerance, abs=tolerance, nan_ok=True) if isinstance(p, float) and isinstance(q, float) else p == q for p, q in zip(x, y))
