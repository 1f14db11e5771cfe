"""Exact substring deduplication: every byte that lies in a `width`-byte string which also starts in a document with a
smaller doc_id is found, over whole texts.

The suffixes to sort are narrowed without loss first. Of the q-grams in each window of `width` bytes the one with the
smallest hash is the window's anchor (the leftmost of equals). Equal windows have equal anchors, so only occurrences of the
same anchor need comparing, and only about one byte in sixteen is one. An occurrence carries its context, the bytes that
windows of this anchor can reach:

1. Occurrences with equal contexts are equal in all their windows: those outside the smallest document are covered. This
   is settled by hashes, first within a slice of text, then by (anchor, context) after one shuffle of hashes.
2. Anchors left with several contexts are sorted out by *bucket-pointer refinement* of the context's suffixes: suffixes start
   in buckets of equal 8-grams, and a bucket is refined by sorting its members on the bucket pointers found 8, 16 and 18
   bytes further on, each step using the pointers of the step before, until buckets hold equal `width`-byte strings. The
   smallest document of a bucket covers the others.
3. An anchor with more contexts than one task should hold is split by window: its windows are dealt by their own hash and
   settled as in step 1.

What is shuffled: hashes of anchors, contexts of ambiguous anchors, spans, and the texts once to meet the requests for contexts. A text that very many documents share is one row per slice in step 1 and one context in step 2.

Defined results: a missing or empty text, or one shorter than `width` bytes, has nothing to find and loses nothing; a document
without doc_id comes after all others, and such documents do not cover each other; rows with the same doc_id do not
cover each other, and equal rows get equal results; repeats inside one document are kept; an empty table gives an empty
result; other columns are not read and cannot clash. Contexts are equal by 112 bits of hash, windows of step 2 by their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import bytehash
from ledgerlens.llm.frames import materialise, release

WIDTH, Q, Q0 = 50, 20, 8
SLICE = 2 << 20
#: Text per part of a shuffle, and the least for which another part is made.
PART_BYTES, LEAST_PART = 32 << 20, 1 << 20
#: Contexts sorted together, and the number above which an anchor is split by window.
CONTEXTS = 10_000
#: Spans of at most so many bytes may be broadcast.
BROADCAST_BYTES = 16 << 20
_HIGH = np.uint64(0xFFFFFFFF00000000)
_LOW = np.uint64(0xFFFFFFFF)
LAST = (1 << 63) - 1


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """`uid` (one per doc_id and text), `ord` (the order of documents), `t`."""
    own = F.col(doc_id).cast("long")
    return docs.select(F.xxhash64(own, F.col(text)).alias("uid"), F.coalesce(own, F.lit(LAST)).alias("ord"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("t"))


# --- anchors


def anchors(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH, q: int = Q):
    """Row, start, context start, context end, anchor hash and context hash of every anchor of a slice."""
    n = len(data) - width + 1
    none = np.zeros(0, dtype=np.int64)
    if n <= 0:
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    sums = bytehash.prefix(data)
    g = bytehash.grams(sums, q)
    least = (g & _HIGH) | np.arange(len(g), dtype=np.uint64)
    span, step = width - q + 1, 1
    while 2 * step <= span:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < span:
        least = np.minimum(least[: len(least) - (span - step)], least[span - step :])
    ends = np.repeat(offsets[1:], np.diff(offsets))[:n]
    inside = np.arange(n) + width <= ends
    chosen = np.zeros(len(g), dtype=bool)
    chosen[(least[:n][inside] & _LOW).astype(np.int64)] = True
    at = np.flatnonzero(chosen)
    row = np.searchsorted(offsets, at, side="right") - 1
    start = np.maximum(offsets[row], at - (width - q))
    end = np.minimum(offsets[row + 1], at + width)
    context = bytehash.mix(bytehash.spans(sums, start, end) + (at - start).astype(np.uint64))
    return row, at, start, end, g[at] >> np.uint64(16), context


def _part_of(key: np.ndarray, parts: int) -> np.ndarray:
    return (bytehash.mix(key.astype(np.int64, copy=False).view(np.uint64)) % np.uint64(parts)).astype(np.int64)


class Packets:
    """Occurrences as a few wide rows: per part the documents with their number of occurrences, then anchors (48 bits of
    hash; two that agree in them are told apart by their contexts), contexts and places."""

    NAMES = ["kind", "part", "docs", "a", "c", "p", "x"]
    SQL = "kind int, part long, docs binary, a binary, c binary, p binary, x binary"
    SCHEMA = pa.schema([("kind", pa.int32()), ("part", pa.int64())] + [(n, pa.binary()) for n in NAMES[2:]])

    @staticmethod
    def rows(kind: int, part, uid, ord_, a, c, p, x=None) -> list[tuple]:
        order = np.lexsort((p, uid, part))
        part, uid, ord_, a, c, p = (v[order] for v in (part, uid, ord_, a, c, p))
        x = None if x is None else x[order]
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(part)]
        out = []
        for f, l in zip(cuts, cuts[1:]):
            if l == f:
                continue
            new = np.flatnonzero(np.concatenate([[True], uid[f + 1 : l] != uid[f : l - 1]]))
            docs = np.column_stack([uid[f:l][new], ord_[f:l][new], np.diff([*new, l - f])]).astype("<i8")
            high = (a[f:l] >> np.uint64(16)).astype("<u4").tobytes() + (a[f:l] & np.uint64(0xFFFF)).astype("<u2").tobytes()
            out.append((kind, int(part[f]), docs.tobytes(), high, c[f:l].astype("<u8").tobytes(), p[f:l].astype("<u4").tobytes(), b"" if x is None else x[f:l].tobytes()))
        return out

    @staticmethod
    def read(batch_rows: list[dict]) -> dict[str, np.ndarray]:
        cols: dict[str, list[np.ndarray]] = {k: [] for k in ("uid", "ord", "a", "c", "p")}
        for r in batch_rows:
            docs = np.frombuffer(r["docs"], "<i8").reshape(-1, 3)
            n = len(r["p"]) // 4
            high, low = np.frombuffer(r["a"], "<u4", n), np.frombuffer(r["a"], "<u2", n, 4 * n)
            cols["uid"].append(np.repeat(docs[:, 0], docs[:, 2]))
            cols["ord"].append(np.repeat(docs[:, 1], docs[:, 2]))
            cols["a"].append((high.astype(np.uint64) << np.uint64(16)) | low)
            cols["c"].append(np.frombuffer(r["c"], "<u8"))
            cols["p"].append(np.frombuffer(r["p"], "<u4").astype(np.int64))
        return {k: np.concatenate(v) for k, v in cols.items()}


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), Packets.SCHEMA.types)], schema=Packets.SCHEMA)


def _spans(uid, start, end, parts: int) -> list[tuple]:
    """Covered spans as packets, dealt by document."""
    zero = np.zeros(len(uid), dtype=np.uint64)
    return Packets.rows(1, _part_of(uid, parts), uid, np.zeros(len(uid), dtype=np.int64), zero, end.astype(np.uint64), start)


def _first_pass(parts: int, width: int, q: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids, ords = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data, offsets = bytehash.column_bytes(batch.column(2))
            for first, last in bytehash.slices(offsets, SLICE):
                base = offsets[first]
                own = offsets[first : last + 1] - base
                row, at, start, end, a, c = anchors(data[base : offsets[last]], own, width, q)
                if not len(at):
                    continue
                uid, ord_, zero = uids[first:last][row], ords[first:last][row], own[row]
                smallest = _smallest(np.lexsort((ord_, c, a)), (a, c), ord_)
                behind = ord_ > smallest
                rows = Packets.rows(0, _part_of(a, parts)[~behind], uid[~behind], ord_[~behind], a[~behind], c[~behind], (at - zero)[~behind])
                if behind.any():
                    rows += _spans(uid[behind], (start - zero)[behind], (end - zero)[behind], parts)
                yield _batch(rows)

    return run


def _smallest(order: np.ndarray, keys, ord_: np.ndarray) -> np.ndarray:
    """The smallest `ord_` of each occurrence's group; `order` sorts by the keys, then by `ord_`."""
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), dtype=ord_.dtype)
    out[order] = ord_[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    return out


def _parted(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of one part at a time, from batches sorted by part."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[-1]["part"] != row["part"]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _settled(rows: list[dict]) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences, their order by (anchor, context, document), the smallest document of each one's context, and which are behind it."""
    x = Packets.read(rows)
    order = np.lexsort((x["ord"], x["c"], x["a"]))
    smallest = _smallest(order, (x["a"], x["c"]), x["ord"])
    return x, order, smallest, x["ord"] > smallest


def _settle(parts: int, width: int, q: int, limit: int):
    """Step 1 after the shuffle: covers what has an equal context in a smaller document, and asks for the contexts of
    anchors that have several, in several documents (kind 2; kind 3 where they are more than `limit`). Spans pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for both in _parted(batches):
            if spans := [tuple(r[n] for n in Packets.NAMES) for r in both if r["kind"] == 1]:
                yield _batch(spans)
            rows = [r for r in both if r["kind"] == 0]
            if not rows:
                continue
            x, order, smallest, behind = _settled(rows)
            out = []
            if behind.any():
                # an end beyond the text's is cut off when the spans are applied
                p = x["p"][behind]
                out += _spans(x["uid"][behind], np.maximum(p - (width - q), 0), p + width, parts)
            a, c = x["a"][order], x["c"][order]
            new_a = np.concatenate([[True], a[1:] != a[:-1]])
            new_c = new_a | np.concatenate([[True], c[1:] != c[:-1]])
            group, at = np.cumsum(new_a) - 1, np.flatnonzero(new_a)
            contexts = np.bincount(group, weights=new_c)
            spread = np.minimum.reduceat(smallest[order], at) < np.maximum.reduceat(smallest[order], at)
            k = np.empty(len(order), dtype=np.int64)
            k[order] = np.where(spread, contexts, 1)[group]
            for kind, some in ((2, (k > 1) & (k <= limit) & ~behind), (3, (k > limit) & (k > 1) & ~behind)):
                if some.any():
                    out += Packets.rows(kind, _part_of(x["uid"][some], parts), x["uid"][some], x["ord"][some], x["a"][some], x["c"][some], x["p"][some])
            if out:
                yield _batch(out)

    return run


# --- contexts of ambiguous anchors


def _asked(parts: int):
    """Requests of one part as one row per document: uid, kind, places and anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _parted(batches):
            for kind in (2, 3):
                some = [r for r in rows if r["kind"] == kind]
                if not some:
                    continue
                x = Packets.read(some)
                order = np.lexsort((x["p"], x["uid"]))
                uid, p, a = x["uid"][order], x["p"][order], x["a"][order]
                cuts = np.concatenate([[0], np.flatnonzero(uid[1:] != uid[:-1]) + 1, [len(uid)]])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(uid[cuts[:-1]]),
                        pa.array(np.full(len(cuts) - 1, kind, dtype=np.int32)),
                        pa.array([p[f:l].astype("<u4").tobytes() for f, l in zip(cuts, cuts[1:])], pa.binary()),
                        pa.array([a[f:l].astype("<u8").tobytes() for f, l in zip(cuts, cuts[1:])], pa.binary()),
                    ],
                    names=["uid", "kind", "places", "marks"],
                )

    return run


def _contexts(parts: int, width: int, q: int):
    """The context bytes of every request (kind 2), or all its windows by hash (kind 3), dealt to parts."""
    left, size = width - q, 2 * width - q

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {2: [], 3: []}
        n = 0

        def flush() -> list[tuple]:
            out = []
            for kind, some in held.items():
                if not some:
                    continue
                part, uid, ord_, a, c, p, x = (np.concatenate(v) for v in zip(*some))
                out += Packets.rows(kind, part, uid, ord_, a, c, p, x)
                some.clear()
            return out

        for batch in batches:
            ords, uids, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3).to_numpy()
            for i, (t, places, marks) in enumerate(zip(batch.column(2), batch.column(4), batch.column(5))):
                data = np.frombuffer(t.as_buffer(), np.uint8)
                p, a = np.frombuffer(places.as_buffer(), "<u4").astype(np.int64), np.frombuffer(marks.as_buffer(), "<u8")
                if kinds[i] == 2:
                    padded = np.concatenate([np.zeros(left, np.uint8), data, np.zeros(width, np.uint8)])
                    x = np.lib.stride_tricks.sliding_window_view(padded, size)[p]
                    ends = np.minimum(p + width, len(data)) - np.maximum(p - left, 0)
                    # the context's first byte and its length go along with the bytes
                    x = np.column_stack([x, np.maximum(left - p, 0).astype(np.uint8), ends.astype(np.uint8)])
                    c = np.zeros(len(p), np.uint64)
                else:
                    first = np.maximum(p - left, 0)
                    p = np.unique(np.concatenate([np.arange(f, min(e + 1, len(data) - width + 1)) for f, e in zip(first, p)]))
                    sums = bytehash.prefix(data)
                    h = bytehash.spans(sums, p, p + width)
                    a, c, x = bytehash.mix(h ^ np.uint64(0x5BD1E995)) >> np.uint64(16), h, np.zeros((len(p), 0), np.uint8)
                part = _part_of(a, parts)
                held[int(kinds[i])].append((part, np.full(len(p), uids[i]), np.full(len(p), ords[i]), a, c, p, x))
                n += len(p)
                if n > 200_000:
                    if rows := flush():
                        yield _batch(rows)
                    n = 0
        if rows := flush():
            yield _batch(rows)

    return run


def refined(pointer: np.ndarray, length: int, step: int) -> np.ndarray:
    """Bucket pointers of strings of `length` + `step` bytes from those of `length` (at most one row's width apart).

    `pointer[k, i]` is the place of the first suffix of the bucket that the suffix at i of context k is in. Members of buckets
    with one member stay where they are; the others are sorted by the pointer found `step` bytes further on, and each
    sub-bucket gets the place of its own first member.
    """
    width = pointer.shape[1] - step
    now, later = np.ascontiguousarray(pointer[:, :width]).ravel(), np.ascontiguousarray(pointer[:, step:]).ravel()
    members = np.bincount(now)
    open_ = np.flatnonzero(members[now] > 1)
    order = open_[np.lexsort((later[open_], now[open_]))]
    bucket, next_ = now[order], later[order]
    first = np.ones(len(order), dtype=bool)
    first[1:] = (bucket[1:] != bucket[:-1]) | (next_[1:] != next_[:-1])
    opens = np.ones(len(order), dtype=bool)
    opens[1:] = bucket[1:] != bucket[:-1]
    places = np.arange(len(order))
    inside = places[first][np.cumsum(first) - 1] - places[opens][np.cumsum(opens) - 1]
    out = now.copy()
    out[order] = bucket + inside
    return out.reshape(pointer.shape[0], width)


def buckets(text: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Bucket pointers of all `width`-byte strings of the rows of `text` (contexts x bytes): equal pointers, equal strings."""
    grams = text.shape[1] - Q0 + 1
    key = np.zeros((text.shape[0], grams), dtype=np.uint64)
    for k in range(Q0):
        key = (key << np.uint64(8)) | text[:, k : k + grams]
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    pointer, length = starts[inverse].reshape(key.shape), Q0
    while length < width:
        step = min(length, width - length)
        pointer = refined(pointer, length, step)
        length += step
    return pointer


def _sort_out(parts: int, width: int, q: int):
    """Steps 2 and 3: refines the suffixes of each anchor's contexts and covers windows that a smaller document has too;
    windows that come by themselves are settled by their hashes."""
    left, size = width - q, 2 * width - q

    def covered(x: dict, text: np.ndarray) -> list[tuple]:
        windows = buckets(text[:, :size], width)
        skipped, length = text[:, size].astype(np.int64), text[:, size + 1].astype(np.int64)
        at = np.arange(windows.shape[1])
        real = (at >= skipped[:, None]) & (at + width <= (skipped + length)[:, None])
        smallest = np.full(int(windows.max()) + 1, LAST, dtype=np.int64)
        ord_ = np.broadcast_to(x["ord"][:, None], windows.shape)
        np.minimum.at(smallest, windows[real], ord_[real])
        hit = real & (smallest[windows] < ord_)
        edge = np.diff(np.pad(hit.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        (row, first), (_, last) = np.nonzero(edge == 1), np.nonzero(edge == -1)
        if not len(row):
            return []
        return _spans(x["uid"][row], x["p"][row] - left + first, x["p"][row] - left + last - 1 + width, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for both in _parted(batches):
            if windows := [r for r in both if r["kind"] == 3]:
                x, _, _, behind = _settled(windows)
                if behind.any():
                    yield _batch(_spans(x["uid"][behind], x["p"][behind], x["p"][behind] + width, parts))
            rows = [r for r in both if r["kind"] == 2]
            if not rows:
                continue
            x = Packets.read(rows)
            text = np.concatenate([np.frombuffer(r["x"], np.uint8).reshape(-1, size + 2) for r in rows])
            order = np.argsort(x["a"], kind="stable")
            x, text = {k: v[order] for k, v in x.items()}, text[order]
            cuts = [0, *(np.flatnonzero(x["a"][1:] != x["a"][:-1]) + 1), len(order)]
            first = 0
            for a, b in zip(cuts[1:], [*cuts[2:], None]):
                if b is None or b - first > CONTEXTS:
                    if found := covered({k: v[first:a] for k, v in x.items()}, text[first:a]):
                        yield _batch(found)
                    first = a

    return run


# --- the whole


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document with its maximal covered spans."""
    for rows in _parted(batches):
        x = Packets.read(rows)
        start, end = x["p"], x["c"].astype(np.int64)
        order = np.lexsort((start, x["uid"]))
        uid, start, end = x["uid"][order], start[order], end[order]
        new = np.concatenate([[True], uid[1:] != uid[:-1]])
        # a running end per document: documents are set apart by adding a number larger than any end
        shift = (np.cumsum(new) - 1) * (int(end.max()) + 1)
        reach = np.maximum.accumulate(end + shift)
        opens = np.concatenate([[True], (start + shift)[1:] > reach[:-1]]) | new
        first = np.flatnonzero(opens)
        last = np.concatenate([first[1:] - 1, [len(uid) - 1]])
        s, e, u = start[first], (reach - shift)[last], uid[first]
        cuts = np.concatenate([[0], np.flatnonzero(u[1:] != u[:-1]) + 1, [len(u)]])
        both = np.column_stack([s, e]).astype("<i8")
        yield pa.RecordBatch.from_arrays(
            [pa.array(u[cuts[:-1]]), pa.array([both[f:l].tobytes() for f, l in zip(cuts, cuts[1:])], pa.binary())], names=["uid", "spans"]
        )


def covered_spans(docs: DataFrame, width: int = WIDTH, q: int = Q, limit: int = CONTEXTS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`uid, spans`: per document with covered bytes its maximal spans as pairs of little-endian 64-bit numbers."""
    spark = docs.sparkSession
    rows = _keyed(docs, doc_id, text)
    total = rows.agg(F.sum(F.length("t")).alias("n")).first()["n"] or 0
    parts = int(max(1, -(-total // PART_BYTES), min(int(spark.conf.get("spark.sql.shuffle.partitions")), total // LEAST_PART)))
    dealt = lambda df: df.repartition(parts, "part").sortWithinPartitions("part")

    first = rows.select("uid", "ord", "t").mapInArrow(_first_pass(parts, width, q), Packets.SQL)
    settled = materialise(dealt(first).mapInArrow(_settle(parts, width, q, limit), Packets.SQL))
    release(spark)
    asked = materialise(dealt(settled.where("kind > 1")).mapInArrow(_asked(parts), "uid long, kind int, places binary, marks binary"))
    found = rows.join(asked.hint("merge"), "uid").select("ord", "uid", "t", "kind", "places", "marks")
    contexts = found.mapInArrow(_contexts(parts, width, q), Packets.SQL)
    spans = materialise(settled.where("kind = 1").unionByName(dealt(contexts).mapInArrow(_sort_out(parts, width, q), Packets.SQL)))
    release(spark)
    out = materialise(dealt(spans).mapInArrow(_merged, "uid long, spans binary"))
    release(spark)
    return out


def without_repeats(docs: DataFrame, width: int = WIDTH, limit: int = CONTEXTS, doc_id: str = "doc_id", text: str = "text", kept: bool = True) -> DataFrame:
    """`doc_id, n_bytes, n_removed, n_spans, spans, kept_sha256, kept` (the remaining bytes, if asked for), one row per document."""
    spans = covered_spans(docs, width, limit=limit, doc_id=doc_id, text=text)
    small = (spans.agg(F.sum(F.length("spans") + 40).alias("n")).first()["n"] or 0) <= BROADCAST_BYTES
    own = F.col(doc_id).cast("long")
    rows = docs.select(own.alias("doc_id"), F.xxhash64(own, F.col(text)).alias("uid"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("t"))
    joined = rows.join(F.broadcast(spans) if small else spans, "uid", "left").select("doc_id", "t", "spans")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256", "kept"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.string(), pa.binary()]
    schema = pa.schema(list(zip(names, types)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, t, found in zip(*(batch.column(i) for i in range(3))):
                data = memoryview(t.as_buffer())
                pairs = [] if found.as_py() is None else np.frombuffer(found.as_py(), "<i8").reshape(-1, 2)
                pairs = [[int(s), min(int(e), len(data))] for s, e in pairs]
                left, parts = 0, []
                for s, e in pairs:
                    parts.append(data[left:s])
                    left = e
                rest = b"".join([*parts, data[left:]])
                out.append((doc.as_py(), len(data), len(data) - len(rest), len(pairs), pairs, hashlib.sha256(rest).hexdigest(), rest if kept else None))
                if len(out) >= 500:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], schema=schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], schema=schema)

    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<array<long>>, kept_sha256 string, kept binary")
