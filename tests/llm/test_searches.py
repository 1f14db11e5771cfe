"""Permutation index against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import permutation_index as P
from ledgerlens.llm import queries

SHAPE = "vec_id long, embedding array<double>, label int, v string, seg long"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SHAPE)


def brute(rows, asks, n):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for q, x in good:
        if asks(q):
            near = sorted(((-(y * x).sum(), i) for i, y in good if i != q))[:n]
            out.setdefault(q, [(i, -s) for s, i in near])
    return out


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_small_tables_are_exact_with_awkward_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, list(map(float, rng.normal(size=6) * rng.uniform(0.2, 5)))) for i in range(60)]
    rows += [(100, None), (101, [0.0] * 6), (102, [1.0, None, 1, 1, 1, 1]), (103, [float("nan")] * 6), (104, [float("inf")] + [1.0] * 5), (None, [1.0] * 6), (105, [1.0] * 3)]
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows]
    want = brute([r for r in rows if r[0] != 105], lambda q: q % 5 == 0, 7)
    have = got(P.search(table(spark, rows), F.col("vec_id") % 5 == 0, 7))
    assert have.keys() == want.keys()
    for q in want:
        assert [i for i, _ in have[q]] == [i for i, _ in want[q]]
        assert [s for _, s in have[q]] == pytest.approx([s for _, s in want[q]], rel=1e-12)


def test_copies_go_by_id_and_few_rows_are_all_returned(spark):
    rows = [(i, [1.0, 2.0]) for i in range(90, 0, -1)] + [(200, [3.0, 2.0])]
    have = got(P.search(table(spark, rows), F.col("vec_id") % 20 == 0, 20))
    assert [i for i, _ in have[20]] == [200] + list(range(1, 20))
    assert [i for i, _ in have[200]] == list(range(1, 21))
    few = got(P.search(table(spark, rows[-3:]), F.col("vec_id") > 0, 20))
    assert {q: len(v) for q, v in few.items()} == {1: 2, 2: 2, 200: 2}


def test_repeated_rows_count_once_and_each_vector_of_an_id_asks(spark):
    rng = np.random.default_rng(2)
    rows = [(i, list(map(float, rng.normal(size=6)))) for i in range(1, 61)]
    rows += rows[:45] + [rows[19]] * 30  # equal rows, one of them very often
    rows += [(40, list(map(float, rng.normal(size=6)))), (41, list(map(float, rng.normal(size=6))))]  # ids with two vectors
    rows += [(100, [9.0] * 6)] * 25 + [(i, [9.0] * 6) for i in range(101, 131)]  # an id that fills the cut of its vector
    once = [(i, np.array(v)) for i, v in sorted({(i, tuple(v)) for i, v in rows})]
    want = []
    for q, x in once:
        if q % 20 == 0:
            near = sorted((-(y * x).sum(), i) for i, y in once if i != q)[:20]
            want += [(q, k, i, round(-s, 9)) for k, (s, i) in enumerate(near, 1)]
    found = P.search(table(spark, rows), F.col("vec_id") % 20 == 0, 20)
    assert sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in found.collect()) == sorted(want)


def test_own_vectors_do_not_use_up_the_candidates():
    rng = np.random.default_rng(5)
    v = np.concatenate([[4.0, 0, 0, 0, 0] + rng.normal(size=(80, 5)) / 100, rng.normal(size=(120, 5))])
    ids = np.array([7] * 80 + list(range(100, 220)))
    longest = np.sqrt((v * v).sum(axis=1)).max()
    pivots = P.lifted(v[::10], longest)
    s = P.Segment(ids, v, pivots, longest, 20)
    order = P.orders(np.append(v[0] / np.linalg.norm(v[0]), 0.0)[None, :], pivots, 20)[0]
    found, _ = s.search(7, v[0], order, 20, 0.1, 21)
    assert len(found) == 20 and 7 not in found


def test_empty_table(spark):
    assert P.search(table(spark, []), F.col("vec_id") % 20 == 0).count() == 0


def test_recall_with_several_segments(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 24)) + 2 * rng.normal(size=(10, 24))[rng.integers(0, 10, 3000)]
    rows = [(i, list(map(float, v))) for i, v in enumerate(x)]
    have = got(P.search(table(spark, rows), F.col("vec_id") % 50 == 0, 20, segment=600))
    want = brute(rows, lambda q: q % 50 == 0, 20)
    hits = sum(len({i for i, _ in have[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.9


def recall(have, ids, x, asks):
    """Share of the 20 nearest by brute force that were found, over all queries."""
    asked, hits = np.flatnonzero(asks(ids)), 0
    for k in asked:
        scores = np.where(ids == ids[k], -np.inf, x @ x[k])
        hits += len(set(ids[np.lexsort((ids, -scores))[:20]].tolist()) & {i for i, _ in have[ids[k]]})
    return hits / (20 * len(asked))


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_of_the_registered_search(spark, size):
    """The figures of the README."""
    rows = spark.read.parquet(f"/root/testdata/{size}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    have = got(queries.QUERIES["op1_permutation_index"](spark, f"/root/testdata/{size}"))
    assert recall(have, rows["vec_id"].to_numpy(), np.array(rows["embedding"].tolist(), float), lambda i: i % 20 == 0) >= 0.95


def test_recall_of_ten_thousand_vectors(spark):
    x = np.random.default_rng(6).normal(size=(10_000, 64))
    have = got(P.search(table(spark, [(i, list(map(float, v))) for i, v in enumerate(x)]), F.col("vec_id") % 50 == 0, 20))
    assert recall(have, np.arange(len(x)), x, lambda i: i % 50 == 0) >= 0.95


@pytest.mark.parametrize("odd", [1e200, 1e-200, 1e300])
def test_a_very_long_or_short_vector_does_not_matter_to_the_others(spark, odd):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(2_000, 24)) * rng.choice([0.5, 1.0, 8.0], 2_000)[:, None]
    x[77] = odd * np.sign(rng.normal(size=24))
    rows = [(i, list(map(float, v))) for i, v in enumerate(x)]
    have = got(P.search(table(spark, rows), F.col("vec_id") % 100 == 0, 20))
    assert recall(have, np.arange(len(x)), x, lambda i: i % 100 == 0) >= 0.95
    if odd > 1:
        assert all(77 in {v[0][0], 77} for v in have.values())
        assert all((v[0][0] == 77) == (x[77] @ x[q] > 0) for q, v in have.items())


def test_footrule_of_a_segment():
    rng = np.random.default_rng(4)
    v, pivots = rng.normal(size=(30, 5)), P.lifted(rng.normal(size=(8, 5)), 5.0)
    longest = np.sqrt((v * v).sum(axis=1)).max()
    s = P.Segment(np.arange(30), v, pivots, longest, 4)
    seen = P.orders(P.lifted(v, longest), pivots, 4)
    order = seen[3]
    want = [sum(abs((list(o).index(p) if p in o else 4) - k) for k, p in enumerate(order)) for o in seen]
    assert s.footrule(order).tolist() == want
