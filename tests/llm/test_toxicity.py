"""Toxicity: folding, matching, learning, held-out accuracy."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F
from samples import AWKWARD, docs_of  # noqa: F401

from ledgerlens.llm import toxicity as X


def test_folding():
    assert X.fold("1D10T") == " idiot "
    assert X.fold("Ѕtuріd, lо5er!") == " stupid loser "
    assert X.fold("tr@sh a$$ @home l@@k st​upid") == " trash a home l k stupid "
    assert X.fold("ｉｄｉｏｔ") == " idiot "
    assert X.fold("") == X.fold(" \n") == "  "


def test_matches_stand_at_word_starts_and_exceptions_do_not_count():
    lexicon = X.Lexicon({"trash": 2.0, "tras": 1.0, "clown": 3.0}, ("trash can", "clown fish"))
    machine = lexicon.automaton()
    total = lambda t: X.weighted(machine, X.fold(t))
    assert total("Trashy TRASH! petrash") == 4.0
    assert total("a trash can, the clown fish") == 0.0
    assert total("a trash canister and a clown") == 5.0
    assert total("nothing") == 0.0 == X.weighted(X.Lexicon({}).automaton(), " trash ")


def test_plain_search_agrees(docs_of):  # noqa: F811
    rng = random.Random(1)
    lexicon = X.Lexicon({"bad": 1.0, "badd": 2.5, "evil": 2.0}, ("evil eye", "bad"), (-3.0, 1.0, 0.5))
    vocabulary = ["bad", "badder", "b4d", "baddish", "evil", "eye", "eyes", "3vil", "good", "fine", "."]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 30)))) for i in range(200)] + [(300 + i, t) for i, t in enumerate(AWKWARD)] + [(None, "evil"), (1, "evil"), (1, "evil")]
    want = []
    for i, t in rows:
        words = X.fold(t or "").split()
        total = 0.0
        for k, w in enumerate(words):
            if w == "bad" or w == "evil" and words[k + 1 : k + 2] == ["eye"]:
                continue
            total += max([s for p, s in lexicon.weights.items() if w.startswith(p)], default=0.0)
        want.append((str(i), round(X.score(lexicon, total, len(words)), 12)))
    out = X.score_documents(docs_of(rows), lexicon).collect()
    assert sorted((str(r.doc_id), round(r.score, 12)) for r in out) == sorted(want)
    assert all(0 <= r.score <= 1 for r in out)


def labelled(spark, docs_of, n=900):  # noqa: F811
    rng = random.Random(2)
    words = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "su") for b in ("ra", "te", "no") for c in ("n", "l", "s", "x")]
    rows, labels = [], []
    for i in range(n):
        text, toxic = [rng.choice(words) for _ in range(rng.randint(15, 60))], int(rng.random() < 0.2)
        for _ in range(rng.randint(2, 5) if toxic else 0):
            text[rng.randrange(len(text))] = rng.choice(["vermin", "v3rmin", "ROTTER", "rottеr", "filthy"])
        if not toxic and rng.random() < 0.3:
            text.insert(3, "filthy lucre")
        rows.append((i, " ".join(text)))
        labels.append((i, 1, toxic if rng.random() > 0.01 else 1 - toxic))
    labels += [(None, 1, 1), (5, 1, None), (10**9, 0, 1)]
    return docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_learned_lexicon_holds_on_held_out_documents(spark, docs_of):  # noqa: F811
    docs, labels = labelled(spark, docs_of)
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    lexicon = X.learn(docs, labels, ~held)
    assert any(s.startswith("verm") for s in lexicon.weights) and any(s.startswith("rott") for s in lexicon.weights)
    rows = X.score_documents(docs, lexicon).where(held).join(labels, "doc_id").where("toxic is not null").collect()
    right = np.mean([(r.score >= 0.5) == bool(r.toxic) for r in rows])
    assert len(rows) > 100 and right > 0.95
    again = X.learn(docs.repartition(5), labels.repartition(2), ~held)
    assert again.weights == lexicon.weights and again.exceptions == lexicon.exceptions
    assert np.allclose(again.scale, lexicon.scale)


def test_no_usable_labels_give_zero_scores(spark, docs_of):  # noqa: F811
    docs = docs_of([(1, "vermin"), (2, None)])
    for rows in ([], [(1, 1, 1)], [(1, 0, 0), (1, 0, 1)]):
        lexicon = X.learn(docs, spark.createDataFrame(rows, "doc_id long, quality int, toxic int"))
        assert all(r.score < 1e-9 for r in X.score_documents(docs, lexicon).collect())
    assert X.score_documents(docs_of([]), X.Lexicon({})).count() == 0
