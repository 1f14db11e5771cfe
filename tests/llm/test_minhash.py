"""MinHash near duplicates against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest
from samples import AWKWARD, docs_of  # noqa: F401
from test_duplicates import near_copies, noisy, plain_components

from ledgerlens.llm import minhash_dedup as M


def got(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in df.collect())


@pytest.mark.parametrize("size, percent", [(2, 80), (5, 80), (3, 90)])
def test_components_equal_all_pairs(docs_of, size, percent):  # noqa: F811
    rng = random.Random(size)
    rows = list(enumerate(near_copies(rng) + AWKWARD))
    rows += [(None, rows[5][1]), (None, "nobody has this text"), (None, None), (5, "another text of five"), rows[8], rows[8], (7000, "one"), (7001, "ONE")]
    found = M.near_duplicates(docs_of(rows), size, percent)
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert got(found) == plain_components(rows, size, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found.collect())


def test_links_between_members_that_are_no_links_of_the_centre(docs_of):  # noqa: F811
    """Chains: neighbours are links, members further apart are not, so most stars have centres without a link to the others."""
    rng = random.Random(9)
    rows = []
    for _ in range(12):
        words = [f"c{rng.randrange(10**6)}" for _ in range(40)]
        for _ in range(14):
            words = words[rng.choice([1, 2, 3]) :] + [f"c{rng.randrange(10**6)}" for _ in range(rng.choice([1, 2]))]
            rows.append((len(rows), " ".join(words)))
    rng.shuffle(rows)
    assert got(M.near_duplicates(docs_of(rows), 2, 80)) == plain_components(rows, 2, 80)


def test_large_groups(docs_of):  # noqa: F811
    """Copies beyond counting are one row; a large group of near copies and many documents around one passage stay linear."""
    rng = random.Random(3)
    base = " ".join(f"b{i}" for i in range(120))
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, base) for i in range(400)] + [(400 + i, noisy(rng, base, rng.randrange(1, 5))) for i in range(300)]
    rows += [(700 + i, passage + " " + " ".join(f"x{rng.randrange(10**6)}" for _ in range(12))) for i in range(300)]
    found = M.near_duplicates(docs_of(rows), 2, 80)
    assert got(found) == plain_components(rows, 2, 80)


def test_a_bucket_gives_one_edge_per_member_but_the_centre(docs_of):  # noqa: F811
    rng = random.Random(5)
    base = " ".join(f"b{i}" for i in range(200))
    sets = M.measured_sets(docs_of([(i, noisy(rng, base, 1)) for i in range(200)]), 2, 80, M.BANDS, M.ROWS, "doc_id", "text")
    members = M.stars(M.materialise(M.representatives(sets)))
    rows = members.collect()
    by_key = {}
    for r in rows:
        by_key.setdefault(r.key, []).append(r)
    for group in by_key.values():
        assert len(group) == group[0].k and {r.centre for r in group} == {min(r.id for r in group)}
    assert members.where("id <> centre").select("id", "centre").distinct().count() < 200 * 199 / 2 / 4


def test_densified_bins_agree_as_the_similarity_says():
    rng = np.random.default_rng(8)
    order = M.orders(160)
    for n, shared in ((4, 3), (20, 16), (200, 150), (5000, 4000)):
        agree, union = [], 2 * n - shared
        for _ in range(60):
            x = rng.integers(0, 1 << 63, union, dtype=np.uint64) * np.uint64(2)
            a, b = np.unique(x[:n]), np.unique(x[union - n :])
            agree.append((M.densified(a, order) == M.densified(b, order)).mean())
        assert np.mean(agree) == pytest.approx(shared / union, abs=0.06)


def test_sketches_hold_only_minima_of_the_set():
    rng = np.random.default_rng(1)
    order = M.orders(160)
    for n in (1, 2, 7, 160, 3000):
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        sketch = M.densified(x, order)
        assert np.isin(sketch, x).all() and len(sketch) == 160
        keys = M.band_keys(np.array([sketch, sketch]), 32)
        assert (keys[0] == keys[1]).all() and len(np.unique(keys[0])) == 32


def test_empty_tables(docs_of):  # noqa: F811
    assert M.near_duplicates(docs_of([])).count() == 0
    assert got(M.near_duplicates(docs_of([(1, None), (2, "")]))) == [("1", 0, "1"), ("2", 0, "2")]
