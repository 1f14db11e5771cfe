"""Host rules and mixing against plain versions."""

from __future__ import annotations

import random
import re
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F
from samples import AWKWARD, docs_of  # noqa: F401

from ledgerlens.llm import frames, host_rules, mixing

R = host_rules.Rules()


def plain(text):
    t = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, chars, symbols, dup = len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines))
    base = n < 10 or 100 * len(inside) > 20 * n
    soft = base or 100 * symbols > 10 * chars or 100 * dup > 50 * len(lines)
    return (n, chars, symbols, dup, len(inside), base, soft)


def random_text(rng):
    words = rng.choice([["a", "b", "c"], [f"w{i}" for i in range(50)], ["x#", "$$", "é", "|"]])
    return "".join(rng.choice(words) + rng.choice([" ", " ", "\n", "\t ", "  "]) for _ in range(rng.randint(0, 80)))


def test_measurements(docs_of):  # noqa: F811
    rng = random.Random(1)
    rows = [(i, random_text(rng)) for i in range(300)] + [(400 + i, t) for i, t in enumerate(AWKWARD)] + [(None, "a b"), (1, "q"), (1, "q")]
    out = host_rules.measured(docs_of(rows)).collect()
    have = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.soft_failed) for r in out)
    assert have == sorted((str(i), *plain(t)) for i, t in rows)


def corpus_rows():
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(i, good + f" {i}", f"h{i % 20}") for i in range(400)]
    rows += [(1000 + i, good + f" {i}" if i % 10 == 0 else "bad", "spam") for i in range(60)]
    rows += [(2000 + i, "bad", "tiny") for i in range(2)] + [(2010, good, "tiny")]
    return rows + [(3000 + i, good + f" n{i}", None) for i in range(5)]


def test_a_bad_host_takes_its_good_documents_along_and_a_tiny_one_does_not(docs_of):  # noqa: F811
    rows = corpus_rows()
    kept = {r.doc_id: r.kept for r in host_rules.host_quality(docs_of(rows)).collect()}
    want = {i: t != "bad" and h != "spam" for i, t, h in rows}
    assert kept == want
    docs = docs_of(rows)
    out = host_rules.keep_good(docs)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == {i for i, k in want.items() if k}


def test_prior_follows_the_spread_between_hosts():
    a, b = host_rules.beta_prior(1000, 100, 10 * 10 * 10 / 100 * 1.0, 10)  # all hosts alike
    assert (a + b, a / (a + b)) == (10_000, pytest.approx(0.1))
    a, b = host_rules.beta_prior(200, 100, 100.0, 2)  # one all bad, one all good
    assert a + b == 2 and a == b
    assert host_rules.beta_prior(0, 0, 0.0, 0) == (1.0, 1.0)


def test_empty_tables(docs_of):  # noqa: F811
    assert host_rules.host_quality(docs_of([])).count() == 0
    assert host_rules.keep_good(docs_of([])).count() == 0
    assert mixing.mix_plan(docs_of([])).count() == 0
    assert mixing.mix(docs_of([])).count() == 0


def test_many_keys_are_joined_without_a_full_broadcast(spark):
    rows = spark.range(4000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 700)).alias("key"), "id")
    facts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top")).where("key <> 'k1'")
    few = frames.attach(rows, facts, "key", "n")
    many = frames.attach(rows, facts, "key", "n", most=10)
    assert sorted(map(tuple, few.collect()), key=str) == sorted(map(tuple, many.select(few.columns).collect()), key=str)
    assert many.count() == 4000


# --- mixing


def plain_targets(sizes, weights=mixing.WEIGHTS):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = Fraction(3 * sum(sizes.values()), 2), set()
    while True:
        rest = [s for s in sizes if s not in capped]
        left = total - sum(2 * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        above = {s for s in rest if share[s] > 2 * sizes[s]}
        if not above or not rest:
            return {s: float(2 * sizes[s] if s in capped else share[s]) for s in sizes}
        capped |= above


@pytest.mark.parametrize("seed", range(4))
def test_targets_equal_a_plain_loop(docs_of, seed):  # noqa: F811
    rng = random.Random(seed)
    names = [f"s{i}" for i in range(rng.randint(1, 9))] + ["é", "😀", "￿", None, "Z", ""]
    rows = [(i, "w " * int(rng.paretovariate(0.6)) if rng.random() < 0.95 else None, rng.choice(names)) for i in range(120)]
    rows = [(i, t and t[:4000], s) for i, t, s in rows] + [(1, "dup a", "s0"), (1, "dup a", "s0"), (None, "no id", "s0")]
    out = mixing.mix_plan(docs_of(rows)).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = plain_targets(dict(sizes))
    for r in out:
        source = r.source_key[1:] if r.source_key[0] == "0" else None
        assert r.source_size == sizes[source]
        assert r.target == pytest.approx(want[source] if sizes[source] else 0.0, rel=1e-12)
        assert r.copies in ((0,) if not r.source_size else {int(r.rate), int(r.rate) + 1}) and r.copies <= 2
    again = mixing.mix_plan(docs_of(rows, parts=7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_taken_words_come_near_the_targets(docs_of):  # noqa: F811
    rows = [(i, "w " * (5 + i % 7), ["a", "a", "a", "b", "c"][i % 5]) for i in range(6000)]
    plan = mixing.mix_plan(docs_of(rows))
    for r in plan.groupBy("source_key", "target").agg(F.sum(F.col("size") * F.col("copies")).alias("taken")).collect():
        assert r.taken == pytest.approx(r.target, rel=0.05)


def test_documents_are_emitted_as_often_as_the_plan_says(docs_of):  # noqa: F811
    rows = [(i, "w " * (3 + i % 5), f"s{i % 6 if i % 2 else 0}") for i in range(300)] + [(900, None, None)]
    docs = docs_of(rows)
    copies = {r.doc_id: r.copies for r in mixing.mix_plan(docs).collect()}
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == {i: c for i, c in copies.items() if c}


def test_places_follow_the_order(spark):
    words = [f"k{i * 7919 % 500}" for i in range(500)]
    out = mixing.numbered(spark.createDataFrame([(w,) for w in words], "w string").repartition(6), "w", "place").collect()
    assert [r.w for r in sorted(out, key=lambda r: r.place)] == sorted(words)
    assert sorted(r.place for r in out) == list(range(500))
