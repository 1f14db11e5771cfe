"""Token counts by a unigram model, with scores shared along a trie.

A text is its white-space pre-tokens, each with a mark for the word's start. The best segmentation of a pre-token into
pieces is found from left to right: the forward score of a prefix is the best over all pieces that end there. Prefixes
that several pre-tokens share are scored once: the distinct pre-tokens of a batch, in sorted order, are a depth-first walk
of their trie, a stack holds the scores of the open path, and only the part below the branching point is computed. The
number of pieces at each end of a word is stored and looked up for every occurrence.

Pieces come from a public vocabulary and are not trained here. Its scores are ranks, not probabilities; the model takes
the rank r of a piece as Zipf's law has it, log p = -log(r + 2). A character outside the vocabulary costs one unknown
piece per UTF-8 byte. Of equally good segmentations the one with fewer pieces counts.

Nothing is shuffled: a task counts its own documents, holding one batch and a bounded table of words it has counted.

Defined results: a missing or empty text, or one of white space only, has 0 tokens; rows that repeat are counted each; words
of any length are segmented whole; an empty table gives an empty result; other columns are not read and cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.frames import whole_text
from ledgerlens.llm.packing import batches_of

MARK = "▁"
#: Words kept by a worker; the table is emptied when full, which costs time but changes nothing.
KEPT = 300_000
UNKNOWN = -20.0
_COUNTERS: dict[str, Counter] = {}


class Counter:
    """Token counts of words under piece scores `score` (log probabilities)."""

    def __init__(self, score: dict[str, float], unknown: float = UNKNOWN):
        self.score, self.unknown = score, unknown
        self.longest = max(map(len, score), default=1)
        #: The lengths of pieces by their last character: other lengths need not be tried there.
        by_end: dict[str, set[int]] = {}
        for piece in score:
            by_end.setdefault(piece[-1], set()).add(len(piece))
        self.lengths = {c: sorted(n) for c, n in by_end.items()}
        self.kept: dict[bytes, int] = {}
        self.nodes = 0

    def counts(self, words: Iterable[str]) -> dict[str, int]:
        """Pieces of each distinct word; every prefix the words share is scored once."""
        out, last = {}, ""
        best, pieces = [0.0], [0]  # forward score and piece count of each prefix of the open path
        score, lengths, none = self.score, self.lengths, ()
        for word in sorted(words):
            shared, most = 0, min(len(word), len(last))
            while shared < most and word[shared] == last[shared]:
                shared += 1
            del best[shared + 1 :], pieces[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                char = word[end - 1]
                bytes_ = len(char.encode("utf-8", "replace"))
                top, n = best[end - 1] + self.unknown * bytes_, pieces[end - 1] + bytes_
                for length in lengths.get(char, none):
                    if length > end:
                        break
                    p = score.get(word[end - length : end])
                    if p is not None:
                        s, m = best[end - length] + p, pieces[end - length] + 1
                        if s > top or s == top and m < n:
                            top, n = s, m
                best.append(top)
                pieces.append(n)
            self.nodes += len(word) - shared
            out[word] = pieces[-1]
            last = word
        return out

    def total(self, texts: list[bytes]) -> list[tuple[int, int]]:
        """Pre-tokens and tokens of each text."""
        split = [t.split() for t in texts]
        new = set().union(*split) - self.kept.keys()
        if len(self.kept) + len(new) > KEPT:
            self.kept.clear()
            new = set().union(*split)
        if new:
            named = {w: MARK + w.decode("utf-8", "replace") for w in new}
            found = self.counts(set(named.values()))
            self.kept.update((w, found[name]) for w, name in named.items())
        get = self.kept.__getitem__
        return [(len(ws), sum(map(get, ws))) for ws in split]


def piece_scores(path: str) -> dict[str, float]:
    """log p = -log(rank + 2) of the ordinary pieces of a vocabulary file; control, unknown and byte pieces are left out."""
    from sentencepiece import SentencePieceProcessor

    v = SentencePieceProcessor(model_file=path)
    names = [v.id_to_piece(i) for i in range(v.get_piece_size()) if not (v.is_control(i) or v.is_unknown(i) or v.is_byte(i) or v.is_unused(i))]
    return {name: -math.log(rank + 2) for rank, name in enumerate(names)}


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(piece_scores(path))
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id, n_words, n_tokens`, one row per document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = counter(vocabulary)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary()).to_pylist()
            for first, last in batches_of(texts):
                found = model.total(texts[first:last])
                yield pa.RecordBatch.from_arrays([ids[first:last], pa.array([w for w, _ in found], pa.int64()), pa.array([t for _, t in found], pa.int64())], schema=schema)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("t")).mapInArrow(count, "doc_id long, n_words long, n_tokens long")
