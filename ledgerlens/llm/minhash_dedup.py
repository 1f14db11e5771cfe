"""Near duplicates by MinHash: one-permutation hashing with optimal densification, bands, and stars of candidate edges.

A document's set are its distinct shingles of `size` words. Every shingle is hashed once; the range of hashes is cut into
BANDS * ROWS bins, and the smallest hash of a bin is that bin's minimum. A bin without a shingle takes the minimum of another
one, which it picks by a fixed random order of its own (the same for all documents, independent of other bins), so bins agree
with the probability of the Jaccard similarity for small sets as well. ROWS bins are a band; equal bands put documents into
one bucket.

Documents of equal sets are folded to one representative first. A bucket of k representatives gives k - 1 candidate edges,
from its smallest member to the others, instead of all pairs. Sizes and parity sketches, exact bounds on the overlap, drop
edges that cannot be links; the others are confirmed on the full sets, which are made again from the texts they need.

Two members of a bucket may be linked though neither is to its centre. Buckets that then hold several components are given
stars around other centres, a few times; as each has a centre of its own, a document meets many members of its group. And
nothing is left to chance there: buckets (of three members at least) that hold several components even then are searched
for pairs across components, under the same exact bounds, in blocks. A pair with similarity 0.8 shares no bucket at all with a probability of
(1 - 0.8**5)**32 = 3e-6; that is what the method can lose.

Awkward input: a document without words (null, empty, white space) has an empty set and links with nothing; one with fewer
words than a shingle has the whole sequence as its only one. Repeated rows and equal texts are one class. A missing doc_id is
above all others, so a component gets it only if no member has an id. Rows of one doc_id with unlinked texts stay in components
of their own. Empty tables give an empty result. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import bytehash
from ledgerlens.llm.components import components
from ledgerlens.llm.frames import BROADCAST_ROWS, attach, materialise, whole_text
from ledgerlens.llm.jaccard_join import SHORT, SLICE, checked, far_size, fingerprint, folded, full_sets, needed, parity, shingle_sets

BANDS, ROWS = 32, 5
#: Times that stars are drawn, each time around other centres, before the buckets that still hold several components are searched.
TURNS = 4
#: Members of a bucket that are compared in one task; larger buckets are cut into blocks of that size, which meet in pairs.
BLOCK = 8_192
#: Sketches that are held at once.
HELD = 2_000
_STEP = np.uint64(0x9FB21C651E98DF25)


def orders(bins: int) -> np.ndarray:
    """For each bin a fixed random order of all bins: the place of bin j in the order of bin i."""
    random = np.random.default_rng(bins)
    return np.argsort(random.random((bins, bins)), axis=1).argsort(axis=1).astype(np.int16)


def densified(tokens: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The sketch of a set of sorted, distinct, well mixed hashes: its minimum in every bin. As hashes are sorted and a bin is a
    range of them, that is the first of each bin."""
    bins = np.uint64(len(order))
    bin_ = ((tokens >> np.uint64(32)) * bins >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(bin_, prepend=-1))
    full, least = bin_[first], tokens[first]
    out = np.empty(len(order), dtype=np.uint64)
    out[full] = least
    empty = np.setdiff1d(np.arange(len(order)), full, assume_unique=True)
    if len(empty):
        out[empty] = least[order[np.ix_(empty, full)].argmin(axis=1)]
    return out


def band_keys(sketches: np.ndarray, bands: int) -> np.ndarray:
    """The bucket of every sketch (a row each) in every band."""
    parts = sketches.reshape(len(sketches), bands, -1)
    with np.errstate(over="ignore"):
        key = bytehash.mix(np.arange(1, bands + 1, dtype=np.uint64) * _STEP)[None, :] + parts[:, :, 0]
        for i in range(1, parts.shape[2]):
            key = bytehash.mix(key) * _STEP + parts[:, :, i]
        return bytehash.mix(key)


def measured_sets(docs: DataFrame, size: int, percent: int, bands: int, rows: int, doc_id: str, text: str) -> DataFrame:
    """`doc_id, mark, n, fp, near, far, keys`: size and fingerprint of the set, its parity sketches and buckets; `mark` is a hash of
    the text."""
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), whole_text(text).alias("t"))
    names = ["doc_id", "mark", "n", "fp", "near", "far", "keys"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = orders(bands * rows)
        for batch in batches:
            data, offsets = bytehash.column_bytes(batch.column(2))
            for first, last in bytehash.slices(offsets, SLICE):
                sets = list(shingle_sets(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], size))
                for at in range(0, len(sets), HELD):
                    some = sets[at : at + HELD]
                    own = batch.slice(first + at, len(some))
                    sketches = [densified(x, order) for x in some if len(x)]
                    keys = iter(band_keys(np.array(sketches), bands).view(np.int64)) if sketches else iter(())
                    columns = [
                        pa.array([len(x) for x in some], pa.int64()),
                        pa.array([fingerprint(x) if len(x) else None for x in some], pa.binary()),
                        pa.array([parity(x, SHORT) for x in some], pa.binary()),
                        pa.array([parity(x, far) if (far := far_size(len(x), percent)) else b"" for x in some], pa.binary()),
                        pa.array([next(keys) if len(x) else None for x in some], pa.list_(pa.int64())),
                    ]
                    yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), *columns], names=names)
        bytehash.tidy()

    return texts.mapInArrow(measure, "doc_id long, mark long, n long, fp binary, near binary, far binary, keys array<long>")


def representatives(sets: DataFrame) -> DataFrame:
    """One row per distinct set, with a number: that of the smallest doc_id. Copies are folded per task before the shuffle."""
    row = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "mark", "n", "near", "far", "keys")
    folded_ = sets.where("n > 0").groupBy("fp").agg(F.min(row).alias("r"), F.count(F.lit(1)).alias("rows"))
    return folded_.select("fp", "rows", "r.doc_id", "r.mark", "r.n", "r.near", "r.far", "r.keys", F.monotonically_increasing_id().alias("id"))


def stars(reps: DataFrame) -> DataFrame:
    """`key, k, id, n, centre, centre_n`: the members of every bucket of several, with its smallest one."""
    posted = reps.select("id", "n", F.explode("keys").alias("key"))
    centre = F.min(F.struct("id", "n"))
    buckets = posted.groupBy("key").agg(F.count(F.lit(1)).alias("k"), centre.alias("c")).where("k > 1")
    buckets = materialise(buckets.select("key", "k", F.col("c.id").alias("centre"), F.col("c.n").alias("centre_n")))
    return attach(posted, buckets, "key", "k").where("centre is not null").select("key", "k", "id", "n", "centre", "centre_n")


def possible(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs `a, b` whose parity sketches do not rule out a link: their distance is at most the number of shingles that are
    in one set only."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(i).to_numpy() for i in (2, 3))
            most = n + m - 2 * needed(n, m, percent)
            near = [np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(len(n), SHORT // 8) for i in (4, 5)]
            ok = np.bitwise_count(near[0] ^ near[1]).sum(axis=1, dtype=np.int64) <= most
            x, y = (batch.column(i).to_pylist() for i in (6, 7))
            for i in np.flatnonzero(ok):
                ok[i] = _apart(x[i], y[i]) <= most[i]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok))

    sides = [reps.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("near").alias(f"near{c}"), F.col("far").alias(f"far{c}")) for c in "ab"]
    met = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "na", "nb", "neara", "nearb", "fara", "farb")
    return met.mapInArrow(keep, "a long, b long")


def across(members: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs `a, b` of `members` (`key, k, id, root`) that share a bucket, lie in different components and may be links by sizes
    and sketches. A pair is given once, by the smallest bucket that it shares."""
    held = members.groupBy("id", "root").agg(F.sort_array(F.collect_list(F.struct("key", "k"))).alias("buckets"))
    rows = held.join(reps.select("id", "n", "near", "far"), "id")
    rows = rows.select("id", "root", "n", "near", "far", F.col("buckets.key").alias("keys"), F.explode("buckets").alias("b"))
    blocks = F.ceil(F.col("b.k") / BLOCK).cast("int")
    rows = rows.withColumns({"own": F.pmod(F.hash("id"), blocks), "other": F.explode(F.sequence(F.lit(0), blocks - 1))})
    place = [F.col("b.key").alias("key"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.col("own") <= F.col("other")]
    rows = rows.select(*place[:3], place[3].alias("first"), "id", "root", "n", "near", "far", "keys")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, at = [], None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:3] != at:
                    if len(group) > 1:
                        yield _pairs(group, at, percent)
                    group, at = [], row[:3]
                group.append(row[3:])
        if len(group) > 1:
            yield _pairs(group, at, percent)
        bytehash.tidy()

    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "id").mapInArrow(search, "a long, b long")


def _pairs(group: list[tuple], at: tuple, percent: int) -> pa.RecordBatch:
    """The pairs of one bucket, or of two blocks of it. Members of the most frequent component only answer the others."""
    first, id_, root, n = (np.array(x) for x in list(zip(*group))[:4])
    near = np.frombuffer(b"".join(g[4] for g in group), np.uint64).reshape(len(group), SHORT // 8)
    roots, counts = np.unique(root, return_counts=True)
    main, place, out = roots[np.argmax(counts)], np.arange(len(group)), []
    for x in place[root != main] if len(roots) > 1 else ():
        ok = (root != root[x]) & ((root == main) | (place > x)) & (100 * np.minimum(n, n[x]) >= percent * np.maximum(n, n[x]))
        y = place[ok & (first != first[x]) if at[1] != at[2] else ok]
        most = n[y] + n[x] - 2 * needed(n[y], n[x], percent)
        y = y[np.bitwise_count(near[y] ^ near[x]).sum(axis=1, dtype=np.int64) <= most]
        own = set(group[x][6])
        for z in y.tolist():
            if next(k for k in group[z][6] if k in own) == at[0] and _apart(group[x][5], group[z][5]) <= n[x] + n[z] - 2 * needed(int(n[x]), int(n[z]), percent):
                out.append((min(id_[x], id_[z]), max(id_[x], id_[z])))
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in range(2)], names=["a", "b"])


def _apart(x: bytes, y: bytes) -> int:
    """Distance of two long sketches; 0 where one has none."""
    if not (x and y):
        return 0
    least = min(len(x), len(y))
    u, v = (folded(np.frombuffer(s, np.uint64)[None, :], least) for s in (x, y))
    return int(np.bitwise_count(u ^ v).sum())


def confirmed(docs: DataFrame, pairs: DataFrame, reps: DataFrame, size: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """The pairs that are links, by their full sets."""
    pairs = materialise(pairs)
    named = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    asked = reps.join(named, "id", "left_semi").select("id", "doc_id", "mark", "fp", "rows")
    return materialise(checked(pairs, materialise(full_sets(docs, asked, size, doc_id, text)), percent))


def near(n: str, m: str, percent: int) -> str:
    """Whether sets of n and m shingles can be linked at all."""
    return f"100 * least({n}, {m}) >= {percent} * greatest({n}, {m})"


def mixed(members: DataFrame, roots: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """Members of buckets of three or more with their component, and those buckets that hold several components, each with a new
    centre: a random member, another one in every bucket and turn."""
    named = members.where("k > 2").select("key", "k", "id", "n").join(roots, F.col("id") == F.col("node"), "left")
    named = named.select("key", "k", "id", "n", F.coalesce("root", "id").alias("root"))
    pick = F.min(F.struct(F.xxhash64("id", "key", F.lit(turn)).alias("h"), "id", "n", "root")).alias("c")
    several = named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("k").alias("rows"), pick).where("lo < hi")
    return named, materialise(several.select("key", "rows", F.col("c.id").alias("centre"), F.col("c.n").alias("centre_n"), F.col("c.root").alias("centre_root")))


def links(docs: DataFrame, reps: DataFrame, size: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """`node, root` of all representatives with links."""
    members = materialise(stars(reps))
    star = members.where("id <> centre and " + near("n", "centre_n", percent))
    edges = materialise(star.select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct())
    found = confirmed(docs, possible(edges, reps, percent), reps, size, percent, doc_id, text)
    roots = components(found)

    for turn in range(1, TURNS):
        open_, centres = mixed(members, roots, turn)
        met = attach(open_, centres, "key", "rows").where("root <> centre_root and " + near("n", "centre_n", percent))
        more = met.select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct().join(edges, ["a", "b"], "left_anti")
        more = materialise(more)
        if more.isEmpty():
            break
        edges = materialise(edges.unionByName(more))
        found = materialise(found.unionByName(confirmed(docs, possible(more, reps, percent), reps, size, percent, doc_id, text)))
        roots = components(found)

    open_, centres = mixed(members, roots, TURNS)
    left = attach(open_, centres.select("key", "rows"), "key", "rows").where("rows is not null").select("key", "k", "id", "root")
    rest = materialise(across(left, reps, percent).join(edges, ["a", "b"], "left_anti"))
    if rest.isEmpty():
        return roots
    return components(found.unionByName(confirmed(docs, rest, reps, size, percent, doc_id, text)))


def near_duplicates(
    docs: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """`doc_id, n_shingles, component_id, kept`, one row per document: the size of its set, the smallest doc_id that links lead to,
    and whether that is its own."""
    sets = materialise(measured_sets(docs, size, percent, bands, rows, doc_id, text))
    reps = materialise(representatives(sets))
    roots = links(docs, reps, size, percent, doc_id, text)
    known = reps.join(roots, F.col("id") == F.col("node"), "left").select("fp", "rows", "doc_id", F.coalesce("root", "id").alias("root"), "node")
    known = materialise(known.where("node is not null or rows > 1"))
    smallest = known.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id")).alias("r"))
    placed = materialise(known.join(smallest, "root").select("fp", F.col("rows").alias("copies"), F.col("r.doc_id").alias("component_id"), F.lit(True).alias("grouped")))
    all_ = sets.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("fp", F.lit(b"")).alias("fp"))
    component = F.when(F.col("grouped"), F.col("component_id")).otherwise(F.col("doc_id"))
    out = attach(all_, placed, "fp", "copies").select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
