"""The prefix trie against one that is built from whole texts."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from ledgerlens.llm import conversation_trie as C
from ledgerlens.operators import skew

SHAPE = "conv_id long, turn long, role string, text string, depth int, words string, size long, node int"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, "w", 2, 3) for r in rows], SHAPE).repartition(parts)


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            r, t = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(r)}:{r}{t}".encode()).digest(), (r, t)))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    members = defaultdict(set)
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].add(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out = []
    for p, ids in members.items():
        below, leaves, saved = [p], 0, 0
        while below:
            q = below.pop()
            below += children[q]
            leaves += not children[q]
            saved += (len(members[q]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) if q else 0)
        ends = ",".join(str(c) for c in sorted(ids) if built[c] == p)
        out.append((min(ids), len(p), min(members[p[:-1]]) if p else None, len(ids), len(children[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def got(df):
    assert df.columns == NAMES
    return sorted((tuple(r) for r in df.collect()), key=str)


def sample(rng, convs=90, longest=7):
    pool = ["Hello there", "hello there", "", None, "a b  c\n", "x" * 200, "日本 é", "one two three four"]
    rows = []
    for c in rng.sample(range(130), convs):
        for t in range(rng.randint(1, longest)):
            rows.append((c, t, rng.choice(["user", "assistant", None]) if rng.random() < 0.2 else "ua"[t % 2], rng.choice(pool[:3]) if t < 3 else rng.choice(pool)))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_equals_a_trie_of_whole_texts(spark, seed):
    rows = sample(random.Random(seed))
    assert got(C.prefix_trie(table(spark, rows))) == plain(rows)


def test_awkward_rows(spark):
    rows = [(None, 1, "u", "no conversation"), (3, None, "u", "first"), (3, 1, "a", "second"), (3, 1, "b", "tie"), (3, 1, "b", "tie"), (3, None, None, None)]
    rows += [(20, 0, "user", "shared"), (21, 5, "user", "own"), (22, 0, "u", "ser"), (23, 0, "us", "er"), (-7, 0, "u", "negative"), (-20, 0, "u", "base")]
    rows += [(40 + i, 0, "user", "same start") for i in range(60)] + [(40 + i, 1, "a", "same end") for i in range(60)]
    rows += [(200, t, "u", f"t{t % 5} w") for t in range(400)] + [(201, t, "u", f"t{t % 5} w") for t in range(399)]
    assert got(C.prefix_trie(table(spark, rows))) == plain(rows)


def test_copies_of_a_conversation_end_in_one_digest(spark, monkeypatch):
    """More conversations of equal turns than a piece of ids holds."""
    monkeypatch.setattr(C, "PIECE", 16)
    rows = [(20 * i, t, "u", f"turn {t}") for i in range(150) for t in range(3)]
    assert got(C.prefix_trie(table(spark, rows))) == plain(rows)


def test_a_long_conversation_is_cut_into_slices(spark, monkeypatch):
    rng = random.Random(7)
    rows = sample(rng, 40) + [(400, t, "u", f"t{t % 7} w w") for t in range(300)] + [(401, t, "u", f"t{t % 7} w w") for t in range(250)]
    measured = []

    def heavy(df, keys, order, **limits):
        measured.append(skew.measure(df, keys, order, hot_rows=100, share=0.01, pieces=5))
        return measured[-1]

    monkeypatch.setattr(C, "measure", heavy)
    monkeypatch.setattr(skew, "BLOCK", 32)
    assert got(C.prefix_trie(table(spark, rows))) == plain(rows)
    assert all(s is not None and s.hot.count() == 2 for s in measured)


def test_equal_fingerprints_of_different_prefixes_are_told_apart(spark, monkeypatch):
    """With a tiny modulus prefixes collide, are found out by their turns, and the next salt is tried."""
    tried = []
    real = C.trie_rows

    def counted(turns, salt=0):
        tried.append(salt)
        monkeypatch.setattr(C, "PRIME", 7 if salt == 0 else (1 << 61) - 1)
        return real(turns, salt)

    monkeypatch.setattr(C, "trie_rows", counted)
    rows = sample(random.Random(11), 60)
    assert got(C.prefix_trie(table(spark, rows))) == plain(rows)
    assert tried == [0, 1]


def test_different_turns_of_one_digest_are_an_error(spark):
    rows = spark.createDataFrame([(b"d", "u", "a"), (b"d", "u", "b"), (b"e", "u", "a")], "digest binary, role string, text string")
    shared = spark.createDataFrame([(b"d", (1, 1), (2, 1)), (b"e", (1, 1), (1, 1))], "digest binary, ref struct<c:long,p:long>, other_ref struct<c:long,p:long>")
    assert not C._contents_agree(rows, shared)
    assert C._contents_agree(rows.where("text = 'a'"), shared)


def test_empty_table(spark):
    assert C.prefix_trie(table(spark, [])).count() == 0
