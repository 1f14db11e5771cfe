"""Ranked search against a plain scan of all documents."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from samples import AWKWARD, docs_of  # noqa: F401

from ledgerlens.llm import bytehash
from ledgerlens.llm import ranked_search as R

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k=10):
    held = [(d, Counter(words(t)), len(words(t))) for d, t in docs if words(t)]
    n_docs, total = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(words(t))
    out = []
    for i, terms in asked.items():
        found = []
        for d, c, n in held:
            m = 10 + 90 * n * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out += [(i, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, 3, "x") for i, t in rows], "item_id long, text string, rank int, doc_id string")


def got(df):
    return sorted([(r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()], key=str)


def sample(rng, n=300):
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "日本", "STOP", "stop", "7up"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    docs = [(i, rng.choice([" ", "-", "\n"]).join(rng.choices(vocabulary, weights, k=rng.choice([1, 2, 5, 5, 5, 30, 200])))) for i in range(n)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 8])))) for i in range(30)]
    return docs, items


@pytest.mark.parametrize("k", [1, 10, 1000])
def test_equals_a_plain_scan(spark, docs_of, k):  # noqa: F811
    docs, items = sample(random.Random(k))
    docs += [(1000 + i, t) for i, t in enumerate(AWKWARD)] + [(None, "w1 w2"), (None, "w3 w1"), (7, "w1"), docs[3], docs[3], (9000, docs[3][1])]
    items += [(100, None), (101, "..."), (102, "absent words"), (None, "w1 w2 w3"), (5, "w40 w41"), (5, "w42")]
    assert got(R.search(docs_of(docs), items_of(spark, items), k)) == plain(docs, items, k)


def test_pieces_of_strata_and_blocks_of_items_do_not_matter(spark, docs_of, monkeypatch):  # noqa: F811
    """A third of all documents has one length and one text; postings come in very small chunks, items in several blocks."""
    rng = random.Random(4)
    docs, items = sample(rng, 200)
    docs += [(i, "w1 w2 w1 w5") for i in range(500, 600)]
    monkeypatch.setattr(R, "CHUNK", 64)
    monkeypatch.setattr(R, "FIRST_VISIT", 1)
    assert got(R.search(docs_of(docs, 5), items_of(spark, items), 10, block_terms=20)) == plain(docs, items)


def test_empty_tables(spark, docs_of):  # noqa: F811
    none = items_of(spark, [])
    assert R.search(docs_of([]), items_of(spark, [(1, "w1")])).count() == 0
    assert R.search(docs_of([(1, "w1")]), none).count() == 0
    assert R.search(docs_of([(1, None), (2, "..")]), items_of(spark, [(1, "w1")])).columns == ["item_id", "rank", "doc_id", "score"]


def test_terms_do_not_run_over_rows():
    texts = ["ab", "cd", "", "é-É", "x9_Y", None]
    data, offsets = bytehash.column_bytes(pa.array(texts))
    found, row = R.terms(data, offsets)
    assert [(r, t.decode()) for r, t in zip(row.tolist(), found.to_pylist())] == [(i, w) for i, t in enumerate(texts) for w in words(t)]


def test_impacts_are_computed_once_per_frequency_and_bounds_hold():
    rng = np.random.default_rng(2)
    n = 400
    lists = [np.unique(rng.integers(0, 12, 6)) for _ in range(n)]
    table = pa.table({
        "doc_id": pa.array(range(n)),
        "m": pa.array(np.sort(rng.integers(10, 20, n))),
        "terms": pa.array([x.tolist() for x in lists], pa.list_(pa.int32())),
        "tfs": pa.array([rng.integers(1, 4, len(x)).tolist() for x in lists], pa.list_(pa.int32())),
    })
    weights = np.arange(1, 13) * 100
    index = R._Index(table, weights)
    of = {(d, t): f for d, (ts, fs) in enumerate(zip(table["terms"].to_pylist(), table["tfs"].to_pylist())) for t, f in zip(ts, fs)}
    m = table["m"].to_pylist()
    for t in range(12):
        for entry in index.lists(np.array([t])):
            places = R._ranges(index.start[[entry]], index.count[[entry]])
            impacts = [int(weights[t]) * (10**9 * of[d, t] // (1000 * of[d, t] + 8 * m[d])) for d in index.doc[places].tolist()]
            assert impacts == index.impact[places].tolist() and impacts[0] == max(impacts) == index.most[entry]
