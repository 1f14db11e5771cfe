"""Ranked lexical search over a length-stratified index.

The score of a document depends on its length only through an integer normaliser m, so documents of equal m form a
*stratum* in which a term's contribution depends on its frequency tf alone. Within a stratum the postings of a term are
grouped by tf, and the impact of a group is computed once, not once per posting. The impact of the largest tf bounds what a
term can give in the stratum; the sum over an item's terms bounds every score there. Strata are visited in the order of that
bound, until it lies below the score of the k-th best document found.

How it spreads: one pass over the texts keeps, per document, its length and the frequencies of terms that some item asks for
(only those postings can be read). The totals and document frequencies are summed per task first. Postings are then dealt
by ranges of (m, hash of the document), so that a stratum lies together, and one that holds a third of all documents is cut
into several pieces. A task builds the index of a bounded number of postings at a time, and passes on k documents per item.
Items are taken in blocks of a bounded number of terms, each with its own pass over the texts.

Terms are runs of letters A-Z in either case, digits, and characters beyond ASCII; A-Z are lower-cased, nothing else.

Awkward input: a document without text or terms (null, empty, marks only) is no document of the index and counts nowhere; an
item without terms finds nothing. Rows that repeat a document are documents of their own, with equal scores. Items that share
an id are one item with the terms of all. A missing doc_id comes after all others of its score. Empty tables give an empty
result. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm import bytehash
from ledgerlens.llm.frames import materialise, whole_text

#: Bytes of text handled at once, postings that one task holds as an index, and terms of one block of items.
SLICE, CHUNK, BLOCK_TERMS = 2 << 20, 1 << 20, 200_000
#: Strata visited at once; each further visit takes four times as many.
FIRST_VISIT = 4

_IS_TERM = np.zeros(256, dtype=bool)
_IS_TERM[np.r_[0x30:0x3A, 0x41:0x5B, 0x61:0x7B, 0x80:0x100]] = True


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All terms of the rows in their order, lower-cased, as bytes, and the row of each."""
    low = bytehash.lower(data)
    solid = _IS_TERM[low]
    edge = np.zeros(len(low) + 1, dtype=bool)
    edge[offsets] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    start = np.flatnonzero(first)
    kept = np.concatenate([[0], np.cumsum(solid)])
    ends = np.append(kept[start[1:]], kept[-1]) if len(start) else np.zeros(0, dtype=np.int64)
    places = np.concatenate([[0], ends]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(places), pa.py_buffer(low[solid])])
    return words, np.searchsorted(offsets, start, side="right") - 1


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """`item_id, term`, each pair once."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bytehash.column_bytes(batch.column(1))
            for first, last in bytehash.slices(offsets, SLICE):
                words, row = terms(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                ids = batch.column(0).take(pa.array(row + first))
                yield pa.RecordBatch.from_arrays([ids, words.cast(pa.large_string()).cast(pa.string())], names=["item_id", "term"])

    rows = items.select(F.col(item_id).alias("item_id"), whole_text(text).alias("t"))
    kind = rows.schema["item_id"].dataType.simpleString()
    return rows.mapInArrow(split, f"item_id {kind}, term string").distinct()


def postings(docs: DataFrame, vocabulary: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id, n, terms, tfs` of every document with a term: its length, and which terms of the vocabulary (by number) it
    holds how often."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = pa.array([t.encode() for t in shared.value], pa.large_binary())
        size = max(1, len(asked))
        for batch in batches:
            data, offsets = bytehash.column_bytes(batch.column(1))
            for first, last in bytehash.slices(offsets, SLICE):
                words, row = terms(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                n = np.bincount(row, minlength=last - first)
                found = pc.index_in(words, value_set=asked)
                known = found.is_valid().to_numpy(zero_copy_only=False)
                key = row[known] * size + found.drop_null().to_numpy()
                key, tf = np.unique(key, return_counts=True)
                ends = np.searchsorted(key, np.arange(last - first + 1) * size).astype(np.int32)
                listed = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (key % size, tf)]
                out = pa.RecordBatch.from_arrays([batch.column(0)[first:last], pa.array(n.astype(np.int64)), *listed], names=["doc_id", "n", "terms", "tfs"])
                yield out.filter(pa.array(n > 0))
        bytehash.tidy()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("t"))
    return rows.mapInArrow(read, "doc_id long, n long, terms array<int>, tfs array<int>")


def document_frequencies(listed: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each term of the vocabulary; one row per task and term is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "df"])

    sums = listed.select("terms").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    out = np.zeros(size, dtype=np.int64)
    for r in sums.collect():  # no more rows than the block of items has terms
        out[r["term"]] = r["df"]
    return out


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class _Index:
    """The strata of a chunk of documents. Postings stand by term, stratum and falling tf."""

    def __init__(self, table: pa.Table, weights: np.ndarray):
        ids, m, terms_, tfs = (table.column(c).combine_chunks() for c in ("doc_id", "m", "terms", "tfs"))
        self.nameless = ids.is_null().to_numpy(zero_copy_only=False)
        self.ids = pc.fill_null(ids, 0).to_numpy()
        length = pc.list_value_length(terms_).to_numpy()
        strata, stratum = np.unique(m.to_numpy(), return_inverse=True)
        term, tf = terms_.flatten().to_numpy(), tfs.flatten().to_numpy().astype(np.int64)
        doc = np.repeat(np.arange(len(length)), length)
        order = np.lexsort((-tf, stratum[doc], term))
        term, tf, self.doc = term[order], tf[order], doc[order]
        own = stratum[self.doc]
        cut = lambda *columns: np.flatnonzero(np.any([np.diff(c, prepend=-1) != 0 for c in columns], axis=0))
        # one impact per term, stratum and tf
        groups = cut(term, own, tf)
        f, norm = tf[groups], strata[own[groups]]
        impact = weights[term[groups]] * ((1_000_000_000 * f) // (1000 * f + 8 * norm))
        self.impact = np.repeat(impact, np.diff(np.append(groups, len(tf))))
        # per term and stratum: where its postings are; the first has the largest impact
        self.start = cut(term, own)
        self.count = np.diff(np.append(self.start, len(tf)))
        self.stratum, self.most = own[self.start], self.impact[self.start]
        self.of_term = np.searchsorted(term[self.start], np.arange(len(weights) + 1))
        self.n_strata, self.n_docs = len(strata), len(length)

    def lists(self, asked: np.ndarray) -> np.ndarray:
        """The (term, stratum) lists of the terms asked for."""
        return _ranges(self.of_term[asked], self.of_term[asked + 1] - self.of_term[asked])


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ..., start[1], ... with `count` numbers of each."""
    before = np.cumsum(count) - count
    return np.repeat(start - before, count) + np.arange(int(count.sum()))


class Best(NamedTuple):
    """The best documents found so far, best first."""

    score: np.ndarray
    nameless: np.ndarray
    doc: np.ndarray

    def with_more(self, score: np.ndarray, nameless: np.ndarray, doc: np.ndarray, k: int) -> Best:
        if len(score) > k:
            near = score >= np.partition(score, len(score) - k)[len(score) - k]
            score, nameless, doc = score[near], nameless[near], doc[near]
        all_ = [np.concatenate(p) for p in zip(self, (score, nameless, doc))]
        order = np.lexsort((all_[2], all_[1], -all_[0]))[:k]
        return Best(*(x[order] for x in all_))


def _none() -> Best:
    return Best(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))


def visit(index: _Index, asked: np.ndarray, best: Best, k: int, scores: np.ndarray) -> Best:
    """`best` with the documents of the strata that may hold better ones. `scores` is a zero per document, and is left so."""
    lists = index.lists(asked)
    bound = np.zeros(index.n_strata, dtype=np.int64)
    np.add.at(bound, index.stratum[lists], index.most[lists])
    order = np.argsort(-bound, kind="stable")
    order = order[bound[order] > 0]
    at, step = 0, FIRST_VISIT
    while at < len(order):
        least = best.score[-1] if len(best.score) == k else 1
        now = order[at : at + step]
        now = now[bound[now] >= least]
        if not len(now):
            break
        at, step = at + step, step * 4
        open_ = np.zeros(index.n_strata, dtype=bool)
        open_[now] = True
        own = lists[open_[index.stratum[lists]]]
        places = _ranges(index.start[own], index.count[own])
        doc = index.doc[places]
        np.add.at(scores, doc, index.impact[places])
        found = doc[scores[doc] >= least]
        found = np.unique(found)
        best = best.with_more(scores[found], index.nameless[found], index.ids[found], k)
        scores[doc] = 0
    return best


def _search_block(docs: DataFrame, asked: dict, k: int, doc_id: str, text: str) -> DataFrame | None:
    """`item, doc_id, score`: the best documents of every task for a block of items (item number -> its terms)."""
    vocabulary = sorted({t for ts in asked.values() for t in ts})
    number = {t: i for i, t in enumerate(vocabulary)}
    listed = materialise(postings(docs, vocabulary, doc_id, text))
    totals = listed.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms"), F.sum(F.size("terms").cast("long")).alias("postings")).first()
    if not totals["docs"]:
        return None
    frequency = document_frequencies(listed, len(vocabulary))
    weights = np.array([weight(totals["docs"], int(df)) for df in frequency], dtype=np.int64)
    of_item = {i: np.array(sorted(number[t] for t in ts), dtype=np.int64) for i, ts in asked.items()}
    shared = docs.sparkSession.sparkContext.broadcast((weights, of_item))

    def search_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, of_item = shared.value
        best = {i: _none() for i in of_item}

        def take(held: list[pa.RecordBatch]) -> None:
            index = _Index(pa.Table.from_batches(held), weights)
            scores = np.zeros(index.n_docs, dtype=np.int64)
            for i, asked in of_item.items():
                best[i] = visit(index, asked, best[i], k, scores)

        held, size = [], 0
        for batch in batches:
            ends = np.cumsum(pc.list_value_length(batch.column(2)).to_numpy().astype(np.int64))
            first = 0
            while first < batch.num_rows:  # a chunk ends with the document that fills it
                before = ends[first - 1] if first else 0
                last = min(batch.num_rows, int(np.searchsorted(ends, before + CHUNK - size)) + 1)
                held.append(batch.slice(first, last - first))
                size += int(ends[last - 1] - before)
                first = last
                if size >= CHUNK:
                    take(held)
                    held, size = [], 0
        if held:
            take(held)
        for i, b in best.items():
            if len(b.score):
                ids = pa.array(b.doc, mask=b.nameless)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.doc), i)), ids, pa.array(b.score)], names=["item", "doc_id", "score"])
        bytehash.tidy()

    norm = F.expr(f"10 + (90 * n * {totals['docs']}L) div {totals['terms']}L")
    rows = listed.where(F.size("terms") > 0).select("doc_id", norm.alias("m"), "terms", "tfs")
    parts = max(1, -(-(totals["postings"] or 0) // CHUNK))
    strata = rows.repartitionByRange(parts, "m", F.xxhash64("doc_id", "terms", "tfs")).sortWithinPartitions("m")
    return strata.mapInArrow(search_, "item long, doc_id long, score long")


def search(
    docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_terms: int = BLOCK_TERMS
) -> DataFrame:
    """`item_id, rank, doc_id, score`: the k best documents of every item, best first, equal scores by smaller doc_id."""
    spark = docs.sparkSession
    pairs = materialise(item_terms(items, item_id, item_text))
    blocks = max(1, -(-pairs.count() // block_terms))
    kind = pairs.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for block in range(blocks):
        asked: dict = {}
        for r in pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect():  # a block of bounded size
            asked.setdefault(r["item_id"], []).append(r["term"])
        names = list(asked)
        found = _search_block(docs, dict(enumerate(asked.values())), k, doc_id, text) if asked else None
        if found is None:
            continue
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").isNull(), "doc_id")
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        named = spark.createDataFrame(list(enumerate(names)), f"item long, item_id {kind}")
        out = out.unionByName(ranked.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score"))
    return out
