"""Jaccard join, components and repeated text against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import tracemalloc
from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from samples import AWKWARD, docs_of  # noqa: F401

from ledgerlens.llm import jaccard_join as J
from ledgerlens.llm import repeated_text as T
from ledgerlens.llm.components import components


def shingles(text, size):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def plain_components(rows, size, percent):
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            root[find(i)] = find(j)
    smallest = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            smallest[find(i)].append(d)
    return sorted((str(d), len(s), str(min(smallest[find(i)], default=None))) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def noisy(rng, base, edits):
    words = base.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def near_copies(rng):
    rows = []
    for n in (3, 8, 11, 13, 20, 22, 30, 60, 200):
        base = " ".join(f"b{n}x{rng.randrange(10**6)}" for _ in range(n))
        rows += [noisy(rng, base, rng.choice([0, 0, 1, 1, 2, 3, 5])) for _ in range(12)]
        rows += [base.upper(), base + " tail", base + " tail tail2", " ".join(base.split()[1:]), base]
    passage = " ".join(f"p{i}" for i in range(25))
    rows += [f"{passage} " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randint(1, 60))) for _ in range(30)]
    return rows + list(AWKWARD) + [AWKWARD[-1] + " more", "one", "ONE", "one two", "two one"]


@pytest.mark.parametrize("size, percent", [(3, 90), (5, 80), (1, 50)])
def test_components_equal_all_pairs(docs_of, size, percent):  # noqa: F811
    rng = random.Random(size)
    texts = near_copies(rng)
    rng.shuffle(texts)
    rows = list(enumerate(texts, 10)) + [(None, texts[0]), (None, "nobody has this one"), (12, texts[2]), (12, "another text of the same id")]
    out = J.near_duplicates(docs_of(rows), size, percent).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in out) == plain_components(rows, size, percent)


def test_every_split_into_light_and_heavy_and_short_blocks_give_the_same(docs_of, monkeypatch):  # noqa: F811
    rng = random.Random(9)
    rows = list(enumerate(near_copies(rng)[:140]))
    want = plain_components(rows, 3, 90)
    for boundary, block in ((1, 16_384), (J.light_limit(90), 16_384), (15, 3)):
        monkeypatch.setattr(J, "choose_boundary", lambda *a, b=boundary: b)
        monkeypatch.setattr(J, "BLOCK", block)
        out = J.near_duplicates(docs_of(rows), 3, 90).collect()
        assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in out) == want


def test_one_of_each_component_stays(docs_of):  # noqa: F811
    rng = random.Random(11)
    texts = near_copies(rng)
    rows = list(enumerate(texts)) + [(3, texts[3]), (3, texts[3]), (900, None), (901, "")]
    docs = docs_of(rows)
    out = J.one_of_each(docs)
    assert out.columns == docs.columns
    want = sorted({d for d, n, c in plain_components(rows, 5, 80) if n and d == c} | {str(d) for d, t in rows if not shingles(t, 5)}, key=int)
    assert sorted((str(r.doc_id) for r in out.collect()), key=int) == want


def test_one_of_each_plain_component_stays_whatever_the_ids(docs_of):  # noqa: F811
    rng = random.Random(12)
    texts = near_copies(rng)
    base = [" ".join(f"c{k}x{i}" for i in range(30)) for k in range(8)]
    rows = [(None if rng.random() < 0.4 else rng.randrange(60), t) for t in texts]  # ids with several texts, and none
    rows += [(None, t) for t in base[:3]] + [(None, base[0]), (None, base[1] + " tail")]
    rows += [(700, base[3]), (700, base[4]), (701, base[4]), (702, base[5]), (702, base[5] + " tail"), (702, base[5]), (None, base[5])]
    rows += [(703, base[6]), (703, base[6]), (703, base[7]), (703, ""), (703, ""), (None, ""), (None, None)]
    rng.shuffle(rows)
    sets = [shingles(t, 5) for _, t in rows]
    near = lambda a, b: a and b and 100 * len(a & b) >= 80 * len(a | b)
    root = list(range(len(rows)))
    for _ in rows:  # the smallest row number spreads until nothing changes
        before = list(root)
        for i, j in combinations(range(len(rows)), 2):
            if root[i] != root[j] and near(sets[i], sets[j]):
                root[i] = root[j] = min(root[i], root[j])
        if root == before:
            break
    members = defaultdict(list)
    for i, r in enumerate(root):
        members[r].append(rows[i])
    out = [(r.doc_id, r.text) for r in J.one_of_each(docs_of(rows)).collect()]
    order = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(str(r[0]) for r in out) == sorted(str(min(m, key=order)[0]) for m in members.values())
    component = defaultdict(set)
    for i, r in enumerate(root):
        component[rows[i]].add(r)
    left = [r for r in out if shingles(r[1], 5)]
    assert sorted(min(component[r]) for r in left) == sorted({r for r in root if sets[r]})
    assert all((None, t) in out for t in (base[2], "", None)) and {(700, base[3]), (700, base[4]), (703, base[6]), (703, base[7])} <= set(out)


def test_empty_tables(docs_of):  # noqa: F811
    assert J.near_duplicates(docs_of([])).count() == 0
    assert J.one_of_each(docs_of([])).count() == 0
    assert T.without_repeats(docs_of([])).count() == 0


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_bounds(percent):
    for n in range(1, 40):
        for m in range(n, 60):
            c = J.needed(n, m, percent)
            assert 100 * c >= percent * (n + m - c) and (c == 0 or 100 * (c - 1) < percent * (n + m - c + 1))
            if c <= n:
                assert n - c + 1 <= n - -(-percent * n // 100) + 1  # a posted set reaches every overlap
                if n != m:
                    assert c in J.subset_sizes(n, percent) and c in J.subset_sizes(m, percent)


def test_sketch_distance_never_exceeds_the_difference():
    rng = np.random.default_rng(0)
    for _ in range(200):
        x = np.unique(rng.integers(0, 1 << 40, 300, dtype=np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < 0.9], rng.integers(0, 1 << 40, 30, dtype=np.uint64)]))
        a, b = (np.frombuffer(J.parity(z, 64), np.uint64) for z in (x, y))
        assert np.bitwise_count(a ^ b).sum() <= len(np.setxor1d(x, y))


def test_components_of_chains_stars_and_cliques(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 70)] + [(500, 500 + i) for i in range(1, 60)] + [(900 + i, 900 + j) for i, j in combinations(range(6), 2)]
    links += [(2000 + rng.randrange(40), 2000 + rng.randrange(40)) for _ in range(30)]
    links = [(a, b) if rng.random() < 0.5 else (b, a) for a, b in links]
    root = {}
    for a, b in links:
        root.setdefault(a, a), root.setdefault(b, b)
    for _ in range(200):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    out = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.root for r in out} == {n: r for n, r in root.items() if any(n in x and x[0] != x[1] for x in links)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- repeated text


def test_frequent_cells_are_counted_across_batches_in_little_memory(spark):
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(300)) + " one shared passage" for _ in range(200)]
    one = np.concatenate(list(J.shingle_sets(np.frombuffer(b"one shared passage", np.uint8), np.array([0, 18]), 3)))
    cell = int(one[0] & np.uint64(J.CELLS - 1))
    batches = [pa.RecordBatch.from_arrays([pa.array([t])], names=["t"]) for t in texts]
    tracemalloc.start()
    found = {c: n for b in J.cell_counts(iter(batches), 3) for c, n in zip(*(x.to_pylist() for x in b.columns))}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found[cell] == len(texts)
    assert peak < J.CELLS * 8  # a table of all cells would not fit


def plain_removed(rows, width=50):
    order = lambda d: float("inf") if d is None else d
    first = {}
    data = [(d, (t or "").encode()) for d, t in rows]
    for d, b in data:
        for i in range(len(b) - width + 1):
            first[b[i : i + width]] = min(order(d), first.get(b[i : i + width], float("inf")))
    out = []
    for d, b in data:
        mask = np.zeros(len(b) + 1, dtype=int)
        for i in range(len(b) - width + 1):
            if first[b[i : i + width]] < order(d):
                mask[i : i + width] = 1
        kept = bytes(x for x, m in zip(b, mask) if not m)
        out.append((str(d), len(b), int(mask.sum()), int((np.diff(np.concatenate([[0], mask])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def repeated_rows(rng):
    letters = "abcdé "
    piece = lambda n: "".join(rng.choice(letters) for _ in range(n))
    shared = [piece(n) for n in (30, 49, 50, 51, 60, 83, 84, 85, 120, 400)]
    rows = []
    for i in range(120):
        parts = [piece(rng.randint(0, 60)) for _ in range(3)] + rng.sample(shared, rng.randint(0, 3))
        rng.shuffle(parts)
        rows.append((rng.randint(0, 150), "".join(parts)))
    rows += [(200 + i, "z" * n) for i, n in enumerate((10, 49, 50, 51, 100, 500))]  # one letter only: all grams equal
    rows += [(300, shared[-1]), (301, shared[-1]), (300, shared[-1]), (None, shared[-1]), (None, shared[-2] + shared[-1]), (302, shared[5] * 4)]
    return rows + [(400 + i, t) for i, t in enumerate(AWKWARD[:-1])] + [(500, AWKWARD[-1][:20_000]), (501, "x" + AWKWARD[-1][100:15_000])]


@pytest.mark.parametrize("limit", [T.CONTEXTS, 2])
def test_removed_bytes_equal_all_windows(docs_of, limit):  # noqa: F811
    rows = repeated_rows(random.Random(limit))
    out = T.without_repeats(docs_of(rows), limit=limit).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out) == plain_removed(rows)
    for r in out:
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and sum(e - s for s, e in r.spans) == r.n_removed


def test_slices_do_not_matter(docs_of, monkeypatch):  # noqa: F811
    rows = repeated_rows(random.Random(8))
    docs = docs_of(rows, parts=1)
    want = plain_removed(rows)
    data, offsets = np.frombuffer("".join(t or "" for _, t in rows).encode(), np.uint8), None
    assert len(data)
    whole = [T.anchors(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())])) for _, t in rows]
    lengths = [len((t or "").encode()) for _, t in rows]
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    row, at, start, end, a, c = T.anchors(data, offsets)
    for i, x in enumerate(whole):
        own = row == i
        assert (at[own] - offsets[i]).tolist() == x[1].tolist() and a[own].tolist() == x[4].tolist() and c[own].tolist() == x[5].tolist()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in T.without_repeats(docs).collect()) == want


def test_bucket_pointers_tell_equal_strings():
    rng = np.random.default_rng(2)
    text = rng.integers(97, 99, (40, 84), dtype=np.uint8)
    text[20:] = text[rng.integers(0, 20, 20)]
    text[30:, 60] ^= 1
    for width in (50, 16, 11, 9, 8):
        pointer = T.buckets(text, width)
        strings = [[bytes(r[i : i + width]) for i in range(84 - width + 1)] for r in text]
        by_pointer, by_string = defaultdict(set), defaultdict(set)
        for p, s in zip(pointer.ravel().tolist(), (x for r in strings for x in r)):
            by_pointer[p].add(s)
            by_string[s].add(p)
        assert all(len(v) == 1 for v in [*by_pointer.values(), *by_string.values()])


def test_folded_sketches_compare_sets_of_different_sizes():
    rng = np.random.default_rng(1)
    for n in (900, 2000, 5000):
        x = np.unique(rng.integers(0, 1 << 60, n, dtype=np.uint64))
        big, small = J.far_size(5000, 80), J.far_size(900, 80)
        assert big > small >= 0
        wide = np.frombuffer(J.parity(x, big), np.uint64)[None, :]
        assert J.folded(wide, 64).tobytes() == J.parity(x, 64)
        assert J.folded(wide, big).tobytes() == J.parity(x, big)
