"""Tokens, pieces, bins and token counts against plain versions."""

from __future__ import annotations

import itertools
import random
import subprocess
import sys
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from samples import AWKWARD, corpus, docs_of  # noqa: F401
from tokenizers import Tokenizer

from ledgerlens.llm import bytehash, frames, packing, token_counts
from ledgerlens.llm.queries import vocabulary

WORDS = vocabulary("word_bpe_49k.json")
HARD = ["A'S it's IT'S don't", "<|endoftext|> x", "<|ENDOFTEXT|>", "a\x1cb\x85c\xa0d e", "İİſK é é", "x." * 50, "ab.,c.! d?", "a\x00b 1,234.5 99%", "ΑΣ Σ ΣΑ", "👍🏽 ok!!", "a​b﻿"]


def ids_of(encoder, texts, end=None):
    """Ids of each text."""
    flat, rows = encoder(*bytehash.column_bytes(pa.array(texts, pa.string())), end)
    return [flat[a:b].tolist() for a, b in zip(rows, rows[1:])]


def test_ids_equal_the_tokenizer(corpus):
    texts = [r.text for r in corpus.collect()] + HARD + [t or "" for t in AWKWARD] + ["", "x <| y", "", "<|", "z"]
    want = [w.ids for w in Tokenizer.from_file(WORDS).encode_batch(texts, add_special_tokens=False)]
    assert ids_of(packing.Encoder(WORDS), texts) == want
    assert ids_of(packing.Encoder(WORDS), texts, 2) == [w + [2] for w in want]
    assert ids_of(packing.Encoder(WORDS), ["", None, " "]) == [[], [], []] and ids_of(packing.Encoder(WORDS), []) == []


def test_recent_values_survive_a_small_table():
    encoder = packing.Encoder(WORDS)
    encoder.recent = packing.Recent(3)
    texts = [f"word{i % 7} other{i % 5} same" for i in range(50)]
    want = ids_of(packing.Encoder(WORDS), texts)
    assert [ids_of(encoder, [t])[0] for t in texts] == want
    assert len(encoder.recent.new) + len(encoder.recent.old) < 15


def test_a_worker_holds_little_while_it_cuts():
    rng = random.Random(3)
    texts = pa.array([" ".join(f"{rng.choice('abcdefgh')}{rng.randrange(60_000)}" for _ in range(300)) for _ in range(1_500)], pa.large_string())
    data, offsets = bytehash.column_bytes(texts)
    encoder = packing.Encoder(WORDS)
    tracemalloc.start()
    for first, last in bytehash.slices(offsets, packing.SLICE):
        encoder(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], packing.END_ID)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 110 << 20


def test_pieces_cover_every_id_once_and_fit(spark, docs_of):
    rows = [(i, t) for i, t in enumerate(AWKWARD)] + [(50 + i, "tok " * (i * 37 % 400)) for i in range(120)] + [(7, "same"), (7, "same"), (None, "a b c")]
    out = packing.pack_documents(docs_of(rows), WORDS, capacity=256, group_pieces=40).collect()
    tokenizer, by_doc, bins = Tokenizer.from_file(WORDS), {}, {}
    for r in out:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
    total = 0
    for i, t in rows:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4")
        total += len(ids)
        have = {(p.start, p.length, p.ids_crc32) for p in by_doc[(i, len(ids))]}
        for s in range(0, len(ids), 256):
            piece = ids[s : s + 256]
            assert (s, len(piece), zlib.crc32(piece.tobytes())) in have
    assert total == sum(r.length for r in out)
    assert len(bins) * 256 < 1.3 * total


def test_first_fit_decreasing_equals_a_plain_loop():
    rng = random.Random(2)
    for _ in range(30):
        lengths = sorted((rng.randint(1, 100) for _ in range(rng.randint(1, 300))), reverse=True)
        room, want = [], []
        for n in lengths:
            at = next((i for i, r in enumerate(room) if r >= n), len(room))
            if at == len(room):
                room.append(100)
            want.append((at, 100 - room[at]))
            room[at] -= n
        assert list(zip(*packing.first_fit_decreasing(lengths, 100))) == want


def test_empty_tables(docs_of):
    assert packing.pack_documents(docs_of([]), WORDS).count() == 0
    assert token_counts.count_tokens(docs_of([]), vocabulary("piece_bpe_32k.model")).count() == 0


# --- token counts


def brute(word, score, unknown):
    """The best of all segmentations, then the fewest pieces."""
    best = (float("-inf"), 0)
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        parts, last = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                parts.append(word[last:i])
                last = i
        parts.append(word[last:])
        if all(p in score or len(p) == 1 for p in parts):
            total, n = 0.0, 0
            for p in parts:
                size = 1 if p in score else len(p.encode())
                total += score.get(p, unknown * size) if p in score else unknown * size
                n += size
            best = max(best, (total, -n))
    return -best[1]


def test_counts_equal_all_segmentations():
    score = {"a": -2.0, "b": -3.0, "ab": -4.0, "abc": -4.5, "c": -2.5, "ca": -2.75, "▁": -1.0, "▁a": -2.5, "bca": -5.25, "é": -7.0}
    model, rng = token_counts.Counter(score, -10.0), random.Random(4)
    words = {"▁" + "".join(rng.choice("abcéx日") for _ in range(rng.randint(0, 8))) for _ in range(300)}
    assert model.counts(words) == {w: brute(w, score, -10.0) for w in words}


def test_shared_prefixes_are_scored_once():
    model = token_counts.Counter({"a": -1.0})
    model.counts({"▁aaaa", "▁aaab", "▁aaac", "▁b"})
    assert model.nodes == 5 + 1 + 1 + 1


def test_documents_are_sums_over_their_words(docs_of):
    path = vocabulary("piece_bpe_32k.model")
    rows = [(i, t) for i, t in enumerate(AWKWARD)] + [(20, "The quick brown fox"), (20, "The quick brown fox"), (None, "Zz")]
    out = token_counts.count_tokens(docs_of(rows), path).collect()
    model = token_counts.Counter(token_counts.piece_scores(path))
    want = []
    for i, t in rows:
        words = [w.decode() for w in (t or "").encode().split()]
        one = {w: model.counts({"▁" + w})["▁" + w] for w in set(words)}
        want.append((str(i), len(words), sum(one[w] for w in words)))
    assert sorted((str(r.doc_id), r.n_words, r.n_tokens) for r in out) == sorted(want)


def test_a_full_table_of_words_changes_nothing(monkeypatch):
    texts = [f"one two{i} three{i % 3}".encode() for i in range(40)]
    path = vocabulary("piece_bpe_32k.model")
    want = token_counts.Counter(token_counts.piece_scores(path)).total(texts)
    monkeypatch.setattr(token_counts, "KEPT", 4)
    model = token_counts.Counter(token_counts.piece_scores(path))
    assert [model.total([t])[0] for t in texts] == want


@pytest.mark.parametrize("lengths", [[], [4096], [1]])
def test_single_bins(lengths):
    assert packing.first_fit_decreasing(lengths) == ([0] * len(lengths), [0] * len(lengths))


def test_small_slices_and_few_kept_chunks_give_the_same_rows(corpus):
    plain = packing.pack_documents(corpus, WORDS).collect()
    small = packing.pack_documents(corpus, WORDS, slice_bytes=700, kept=5).collect()
    assert plain and sorted(map(tuple, small)) == sorted(map(tuple, plain))


def test_long_texts_go_to_workers_in_small_batches(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    docs = spark.range(0, 6_000, 1, 1).selectExpr("id AS doc_id", "repeat('word ', 400) AS text")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], names=["n"])

    seen = [r.n for r in frames.materialise_lean(docs.mapInArrow(sizes, "n long")).collect()]
    assert sum(seen) > 12_000_000 and max(seen) < 2 * frames.BATCH_BYTES
    assert spark.conf.get(name) == before


def test_a_worker_tokenizes_without_threads_of_its_own():
    code = f"""
import os
import pyarrow as pa
from ledgerlens.llm import bytehash, packing
encode, before = packing.Encoder({WORDS!r}), len(os.listdir("/proc/self/task"))
encode(*bytehash.column_bytes(pa.array([f"Word-{{i}} {{i * 7919}}x" for i in range(5000)])))
assert len(os.listdir("/proc/self/task")) == before
"""
    subprocess.run([sys.executable, "-c", code], check=True)
