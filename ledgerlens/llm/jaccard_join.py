"""Near duplicates by a size-aware join of shingle sets: every pair with a Jaccard similarity of at least `percent` is linked.

Documents with equal sets form a class, and only one set of each class is joined. Two linked sets of n and m shingles share at
least c(n, m) = ceil(percent * (n + m) / (100 + percent)) of them. That is used in two ways, by size:

- *light* sets (fewer than `boundary` shingles): all subsets of the sizes c(n, m) that a partner could ask for are
  enumerated. Sets that meet in a subset of the right size are linked without further checking, and linking each of them
  to the smallest set of the subset keeps all components.
- *heavy* sets: the rarest n - ceil(percent * n / 100) + 1 shingles are posted in inverted lists; linked sets share one. A list
  is scanned with exact filters (sizes, and parity sketches whose distance never exceeds the number of shingles that
  differ); what passes is checked on the full sets.

The boundary is the size at which enumerating costs as many rows as posting and scanning, from the numbers of sets by
size and the measured list lengths. Sets up to 100 / percent times smaller than the boundary are posted too, so no pair of
a light and a heavy set is missed.

Only components are asked for, so lists do not give all their pairs. A first scan offers, for each set, its closest
earlier neighbour; after checking, the sets are in provisional components, and a second scan offers every pair that
passes the filters and lies in two different ones. No link between two components is lost, and a group of thousands of near
copies gives as many checks as it has members. Lists longer than a block are scanned as pairs of blocks.

"Rarest" is a fixed order of all shingles: by a count kept for the most frequent hash cells (a bounded table), then by
hash. Any fixed order gives the same links; this one keeps passages that many documents share out of the lists.

Defined results: a missing or empty text, or one without words, has an empty set, links with nothing and is its own component;
a text with fewer words than a shingle has its whole sequence as one; repeated rows and equal texts are one class; a
component without any doc_id has none; an empty table gives an empty result; other columns are not read and cannot clash.
Shingles are compared by 64-bit hashes, classes and subsets by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import bytehash
from ledgerlens.llm.components import components
from ledgerlens.llm.frames import BROADCAST_ROWS, attach, packed, release, small_batches, whole_text
from ledgerlens.llm.frames import materialise_lean as materialise

#: Cells of the count table, the count a cell must reach within `COUNTED` bytes of text to be listed, and how many are kept.
CELLS, CELL_LEAST, HOT_CELLS = 1 << 22, 3, 200_000
COUNTED = 2 << 20
#: Bytes of text that are hashed together; a task holds some eighty bytes for each of them meanwhile.
SLICE = 1 << 20
#: Bytes of the short sketch. Sets that may differ in more shingles than it tells apart have a longer one too.
SHORT = 64
#: Sets of a list that are compared in one task, and the length up to which lists are scanned together.
BLOCK, SHORT_LIST = 16_384, 48
#: A light set enumerates at most so many subsets.
MOST_SUBSETS = 1_000
_STEP = np.uint64(0xD6E8FEB86659FD93)


def needed(n, m, percent: int):
    """The smallest overlap of linked sets of n and m shingles."""
    return -((-percent * (n + m)) // (100 + percent))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of every row."""
    low = bytehash.lower(data)
    start, end, row = bytehash.words(low, offsets)
    h = bytehash.spans(bytehash.prefix(low), start, end)
    counts = np.bincount(row, minlength=len(offsets) - 1)
    first = np.concatenate([[0], np.cumsum(counts)])

    def joined(parts) -> np.ndarray:
        out = bytehash.mix(parts[0] + np.uint64(len(parts)))
        with np.errstate(over="ignore"):
            for p in parts[1:]:
                out = bytehash.mix(out * _STEP + p)
        return out

    runs = joined([h[i : len(h) - size + 1 + i] for i in range(size)]) if len(h) >= size else h[:0]
    for f, c in zip(first, counts):
        if c >= size:
            yield np.unique(runs[f : f + c - size + 1])
        elif c:
            yield joined([h[f + i : f + i + 1] for i in range(c)])
        else:
            yield h[:0]


def _each_set(batch: pa.RecordBatch, column: int, size: int):
    """Row number and set of every row of a batch, a slice of text at a time."""
    data, offsets = bytehash.column_bytes(batch.column(column))
    for first, last in bytehash.slices(offsets, SLICE):
        sets = shingle_sets(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], size)
        yield first, last, list(sets)


def cell_counts(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Cells and counts of the first column's sets, of every `COUNTED` bytes of text; a worker never holds the table of cells."""
    held, length = [], 0

    def listed() -> pa.RecordBatch:
        cell, n = np.unique(np.concatenate(held), return_counts=True)
        often = n >= CELL_LEAST
        return pa.RecordBatch.from_arrays([pa.array(cell[often], pa.int64()), pa.array(n[often], pa.int64())], names=["cell", "n"])

    for batch in batches:
        data, offsets = bytehash.column_bytes(batch.column(0))
        for first, last in bytehash.slices(offsets, SLICE):
            some = data[offsets[first] : offsets[last]]
            held += [(x & np.uint64(CELLS - 1)).astype(np.uint32) for x in shingle_sets(some, offsets[first : last + 1] - offsets[first], size)]
            length += len(some)
            if length >= COUNTED:
                yield listed()
                held, length = [], 0
    if held:
        yield listed()
    bytehash.tidy()


def frequent_cells(texts: DataFrame, size: int) -> np.ndarray:
    """Counts by hash cell, 0 but for the most frequent cells. Sums are made per `COUNTED` bytes of text before anything is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return cell_counts(batches, size)

    sums = texts.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    with small_batches(texts.sparkSession):
        top = sums.orderBy(F.col("n").desc(), "cell").limit(HOT_CELLS).toPandas()
    cells = np.zeros(CELLS, dtype=np.int64)
    cells[top["cell"].to_numpy(dtype=np.int64)] = top["n"].to_numpy(dtype=np.int64)
    return cells.astype(np.uint32) if cells.max(initial=0) < 1 << 32 else cells


def parity(tokens: np.ndarray, size: int) -> bytes:
    """Bit i tells whether an odd number of tokens falls on it; the distance of two such sketches is at most the number of
    tokens that are in one set only."""
    at = (bytehash.mix(tokens) & np.uint64(8 * size - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=8 * size) & 1).astype(np.uint8)).tobytes()


def far_size(n: int, percent: int) -> int:
    """Bytes of the long sketch of a set of n shingles; 0 where the short one will do.

    Unrelated sets differ in half of b bits, give or take sqrt(b) / 2. The sketch is the smallest, as a power of two, in which
    that lies five deviations above the number of shingles in which two linked sets may differ."""
    most, size = 2 * n - 2 * needed(n, n, percent), SHORT
    while 4 * size - 2.5 * (8 * size) ** 0.5 < most:
        size *= 2
    return size if size > SHORT else 0


def folded(sketch: np.ndarray, size: int) -> np.ndarray:
    """Rows of sketches at a smaller size: halves that share a bit there are added."""
    parts = sketch.reshape(len(sketch), -1, size // 8)
    return np.bitwise_xor.reduce(parts, axis=1)


def fingerprint(tokens: np.ndarray) -> bytes:
    with np.errstate(over="ignore"):
        return np.array([bytehash.mix(tokens ^ _STEP).sum(), bytehash.mix(tokens + _STEP).sum()], dtype=np.uint64).tobytes()


def measured_sets(docs: DataFrame, size: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """`doc_id, mark, n, fp, rare, near, far, few`: size, fingerprint, the rarest shingles, sketches; `few` has all shingles of a
    set that could be light. `mark` is a hash of the text."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), whole_text(text).alias("t"))
    cells = docs.sparkSession.sparkContext.broadcast(frequent_cells(rows.select("t"), size))
    most = light_limit(percent)
    names = ["n", "fp", "rare", "near", "far", "few"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = cells.value
        for batch in batches:
            for first, last, sets in _each_set(batch, 2, size):
                rare = []
                for x in sets:
                    order = np.lexsort((x, counts[(x & np.uint64(CELLS - 1)).astype(np.int64)]))
                    n = len(x)
                    rare.append(x[order[: n + (-percent * n) // 100 + 1 if n else 0]].view(np.int64))
                columns = [
                    pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([fingerprint(x) if len(x) else None for x in sets], pa.binary()),
                    pa.array(rare, pa.list_(pa.int64())),
                    pa.array([parity(x, SHORT) for x in sets], pa.binary()),
                    pa.array([parity(x, far) if (far := far_size(len(x), percent)) else b"" for x in sets], pa.binary()),
                    pa.array([x.view(np.int64) if len(x) < most else None for x in sets], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:last], batch.column(1)[first:last], *columns], names=["doc_id", "mark", *names])
        bytehash.tidy()

    return rows.mapInArrow(measure, "doc_id long, mark long, n long, fp binary, rare array<long>, near binary, far binary, few array<long>")


# --- light sets


def subset_sizes(n: int, percent: int) -> list[int]:
    """The overlaps that partners of other sets could ask of a set of n shingles."""
    partners = [m for m in range(max(1, -((-percent * n) // 100)), 100 * n // percent + 1)]
    asked = {c for m in partners if (c := needed(n, m, percent)) <= min(n, m) and not (m == n and c == n)}
    return sorted(asked)


def subsets(n: int, percent: int) -> int:
    return sum(comb(n, c) for c in subset_sizes(n, percent))


def light_limit(percent: int) -> int:
    """The first size that has too many subsets for enumeration to be considered."""
    n = 1
    while subsets(n, percent) <= MOST_SUBSETS:
        n += 1
    return n


def choose_boundary(sizes: dict[int, int], percent: int, list_length: float) -> int:
    """The boundary with the least cost in rows: subsets of sets below it, postings and scanned entries of those posted."""
    post = lambda n: (n + (-percent * n) // 100 + 1) * (1 + list_length)
    best, least = 1, None
    for b in range(1, light_limit(percent) + 1):
        cost = sum(k * subsets(n, percent) for n, k in sizes.items() if n < b)
        cost += sum(k * post(n) for n, k in sizes.items() if n >= b or 100 * n >= percent * b)
        if least is None or cost < least:
            best, least = b, cost
    return best


def light_links(sets: DataFrame, percent: int, boundary: int) -> DataFrame:
    """Links `a, b` between sets (`id, n, few`) of fewer than `boundary` shingles."""

    def enumerate_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for id_, n, few in zip(*(batch.column(i).to_pylist() for i in range(3))):
                x = np.array(few, dtype=np.int64).view(np.uint64)
                with np.errstate(over="ignore"):
                    parts = np.column_stack([bytehash.mix(x ^ _STEP), bytehash.mix(x + _STEP)])
                    for c in subset_sizes(n, percent):
                        left = np.array(list(combinations(range(n), n - c)), dtype=np.int64).reshape(comb(n, c), n - c)
                        sums = parts.sum(axis=0) - parts[left].sum(axis=1)
                        out += [(id_, n, c, row.tobytes()) for row in sums]
                if len(out) > 50_000:
                    yield _rows(out, ["id", "n", "c", "subset"])
                    out = []
            if out:
                yield _rows(out, ["id", "n", "c", "subset"])

    small = sets.where(F.col("n") < boundary).select("id", "n", "few")
    keys = small.mapInArrow(enumerate_, "id long, n long, c long, subset binary")
    first = keys.groupBy("c", "subset").agg(F.min(F.struct("n", "id")).alias("f"), F.count(F.lit(1)).alias("k")).where("k > 1")
    met = keys.join(first.select("c", "subset", F.col("f.n").alias("m"), F.col("f.id").alias("a")), ["c", "subset"])
    linked = F.lit(percent) * (F.col("n") + F.col("m")) <= F.lit(100 + percent) * F.col("c")
    return met.where(linked & (F.col("a") != F.col("id"))).select("a", F.col("id").alias("b")).distinct()


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)


# --- heavy sets


def dense(sets: DataFrame, percent: int, boundary: int) -> DataFrame:
    """Heavy sets with those of their rare shingles that another one has too, each with the length of its list."""
    heavy = sets.where(100 * F.col("n") >= percent * boundary)
    # dealt by token once; the counts and the join below both read that exchange
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    posted = heavy.select("id", F.explode("rare").alias("token")).repartition(parts, "token")
    lists = posted.groupBy("token").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    kept = posted.join(lists, "token").groupBy("id").agg(F.collect_list(F.struct("token", "k")).alias("lists"))
    return heavy.select("id", "n", "near", "far").join(kept, "id")


def _entries(sets: DataFrame, all_pairs: bool) -> DataFrame:
    """One row per set and list; a list longer than a block is cut into blocks, met in pairs where all pairs are asked for."""
    rows = sets.select("id", "n", "near", "far", "root", F.explode("lists").alias("l"))
    blocks = F.ceil(F.col("l.k") / BLOCK).cast("long")
    rows = rows.withColumn("blocks", blocks).withColumn("own", F.when(blocks > 1, F.pmod(F.xxhash64("id"), blocks)).otherwise(0))
    if all_pairs:
        rows = rows.withColumn("other", F.explode(F.when(F.col("blocks") > 1, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(F.lit(0).cast("long")))))
    else:
        rows = rows.withColumn("other", F.col("own"))
    key = [F.col("l.token").alias("token"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side")]
    return rows.select(*key, "id", "n", "root", "near", "far")


class _List:
    """The entries of one list, in the order of their ids."""

    def __init__(self, batch: pa.RecordBatch, percent: int):
        self.percent = percent
        self.key = np.column_stack([batch.column(i).to_numpy() for i in range(3)])
        self.side, self.id, self.n, self.root = (batch.column(i).to_numpy() for i in (3, 4, 5, 6))
        self.near = np.frombuffer(b"".join(batch.column(7).to_pylist()), dtype=np.uint64).reshape(len(self.id), SHORT // 8)
        far = batch.column(8).to_pylist()
        self.size = np.array([len(x) for x in far], dtype=np.int64)
        self.at, self.far = np.zeros(len(far), dtype=np.int64), {}
        for size in np.unique(self.size[self.size > 0]).tolist():
            own = np.flatnonzero(self.size == size)
            self.at[own] = np.arange(len(own))
            self.far[size] = np.frombuffer(b"".join([far[i] for i in own]), dtype=np.uint64).reshape(len(own), size // 8)

    def passing(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs (x[k], y[k]) of entries pass the exact filters, and the distance of their sketches."""
        n, m = self.n[x], self.n[y]
        ok = (100 * np.minimum(n, m) >= self.percent * np.maximum(n, m)) & (self.id[x] != self.id[y])
        most = n + m - 2 * needed(n, m, self.percent)
        apart = np.full(len(ok), 1 << 30, dtype=np.int64)
        at = np.flatnonzero(ok)
        xs, ys = np.broadcast_to(x, ok.shape)[at], y[at]
        apart[at] = np.bitwise_count(self.near[xs] ^ self.near[ys]).sum(axis=1, dtype=np.int64)
        ok &= apart <= most
        left = np.broadcast_to(x, ok.shape)
        both = ok & (self.size[left] > 0) & (self.size[y] > 0)
        for p in self.far:
            for q in self.far:
                at = np.flatnonzero(both & (self.size[left] == p) & (self.size[y] == q))
                for some in np.array_split(at, max(1, len(at) * max(p, q) >> 24)):
                    if len(some):
                        least = min(p, q)
                        a, b = folded(self.far[p][self.at[left[some]]], least), folded(self.far[q][self.at[y[some]]], least)
                        apart[some] = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
                        ok[some] = apart[some] <= most[some]
        return ok, apart


def _short(l: _List, cuts: np.ndarray, all_pairs: bool) -> list[tuple[int, int, int]]:
    """What `_closest` or `_across` find in all lists of at most SHORT_LIST entries: entries are held against the one before
    them, then against the one before that, and so on, for all lists together."""
    starts = np.repeat(cuts[:-1], np.diff(cuts))
    at = np.flatnonzero(np.repeat(np.diff(cuts) <= SHORT_LIST, np.diff(cuts)))
    best, partner, out = np.full(len(l.id), 1 << 30), np.zeros(len(l.id), dtype=np.int64), []
    for d in range(1, SHORT_LIST):
        at = at[at - d >= starts[at]]
        if not len(at):
            break
        x, y = at, at - d
        if all_pairs:
            keep = (l.root[x] != l.root[y]) & ((l.key[x, 1] == l.key[x, 2]) | (l.side[x] != l.side[y]))
            x, y = x[keep], y[keep]
        ok, apart = l.passing(x, y)
        x, y, apart = x[ok], y[ok], apart[ok]
        if all_pairs:
            out += zip(np.minimum(l.id[x], l.id[y]).tolist(), np.maximum(l.id[x], l.id[y]).tolist(), apart.tolist())
        else:
            closer = apart < best[x]
            best[x[closer]], partner[x[closer]] = apart[closer], y[closer]
    if not all_pairs:
        i = np.flatnonzero(best < 1 << 30)
        out = list(zip(l.id[partner[i]].tolist(), l.id[i].tolist(), best[i].tolist()))
    return out


def _closest(l: _List, first: int, last: int) -> list[tuple[int, int, int]]:
    """For each entry its closest earlier one that passes."""
    out = []
    for i in range(first + 1, last):
        ok, apart = l.passing(np.int64(i), np.arange(first, i))
        if ok.any():
            j = first + int(np.argmin(np.where(ok, apart, 1 << 30)))
            out.append((int(l.id[j]), int(l.id[i]), int(apart[j - first])))
    return out


def _across(l: _List, first: int, last: int) -> list[tuple[int, int, int]]:
    """All passing pairs of entries with different roots. Entries with the most frequent root need not be tried with each
    other, so they only answer."""
    roots, counts = np.unique(l.root[first:last], return_counts=True)
    if len(roots) < 2:
        return []
    at = np.arange(first, last)
    main = roots[np.argmax(counts)]
    two_sided = l.key[first, 1] != l.key[first, 2]
    out = []
    for i in at[l.root[at] != main]:
        other = at[(l.root[at] != l.root[i]) & ((l.root[at] == main) | (at > i))]
        if two_sided:
            other = other[l.side[other] != l.side[i]]
        if len(other):
            ok, apart = l.passing(np.int64(i), other)
            out += [(min(l.id[i], l.id[j]), max(l.id[i], l.id[j]), int(d)) for j, d in zip(other[ok], apart[ok])]
    return out


def scan_lists(sets: DataFrame, percent: int, all_pairs: bool) -> DataFrame:
    """Candidates `a, b, apart` from the inverted lists of `dense` sets with a column `root`."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("apart", pa.int64())])
    pairs = _across if all_pairs else _closest

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def run(table: pa.Table) -> list[tuple]:
            l = _List(table.combine_chunks().to_batches()[0], percent)
            cuts = np.array([0, *(np.flatnonzero((np.diff(l.key, axis=0) != 0).any(axis=1)) + 1), len(l.id)])
            long = np.flatnonzero(np.diff(cuts) > SHORT_LIST)
            return _short(l, cuts, all_pairs) + [p for k in long for p in pairs(l, int(cuts[k]), int(cuts[k + 1]))]

        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            key = np.column_stack([table.column(i).to_numpy() for i in range(3)])
            open_from = int(np.flatnonzero((key != key[-1]).any(axis=1)).max(initial=-1)) + 1
            held = table.slice(open_from)
            if open_from and (found := run(table.slice(0, open_from))):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], schema=schema)
        if held is not None and (found := run(held)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], schema=schema)
        bytehash.tidy()

    entries = _entries(sets, all_pairs)
    dealt = entries.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "id")
    return dealt.mapInArrow(scan, "a long, b long, apart long")


def checked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs `a, b` whose full sets (`id, tokens`) are linked."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                shared = len(u) + len(v) - len(np.union1d(u, v))
                keep.append(100 * shared >= percent * (len(u) + len(v) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    left = sets.select(F.col("id").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("tokens").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def full_sets(docs: DataFrame, wanted: DataFrame, size: int, doc_id: str, text: str) -> DataFrame:
    """`id, tokens` of the wanted representatives (`id, doc_id, mark, fp, rows`), made again from their texts.

    Only representatives that stand in several rows (`rows` > 1) have to be gathered, to have one set of each."""
    wanted = materialise(wanted)
    few = wanted.count() <= BROADCAST_ROWS
    key = [F.coalesce(F.col("doc_id"), F.lit(0)).alias("d"), F.col("doc_id").isNull().alias("nameless"), "mark"]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), whole_text(text).alias("t")).select(*key, "t")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, sets in _each_set(batch, 2, size):
                own = [fingerprint(x) == fp for x, fp in zip(sets, batch.column(1)[first:last].to_pylist())]
                made = pa.RecordBatch.from_arrays([batch.column(0)[first:last], pa.array([x.tobytes() for x in sets], pa.binary())], names=["id", "tokens"])
                yield made.filter(pa.array(own))

    def made(asked: DataFrame) -> DataFrame:
        asked = asked.select("id", "fp", *key)
        found = rows.join(F.broadcast(asked) if few else asked, ["d", "nameless", "mark"]).select("id", "fp", "t")
        return found.mapInArrow(make, "id long, tokens binary")

    out, several = made(wanted.where("rows = 1")), wanted.where("rows > 1")
    if not several.isEmpty():
        out = out.unionByName(made(several).groupBy("id").agg(F.first("tokens").alias("tokens")))
    return out


def _linked(docs: DataFrame, pairs: DataFrame, reps: DataFrame, size: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """The pairs that are links, by the full sets of the representatives they name."""
    named = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    asked = reps.join(named, "id", "left_semi").select("id", "doc_id", "mark", "fp", "rows")
    full = materialise(full_sets(docs, asked, size, doc_id, text))
    return materialise(checked(pairs, full, percent))


def classes(docs: DataFrame, size: int, percent: int, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The measured documents, and per fingerprint `fp, copies, component_id, component_mark` of every class that has copies or
    links: the smallest doc_id of the component and the mark of the row it stands in."""
    sets = materialise(measured_sets(docs, size, percent, doc_id, text))
    by_fp = sets.where("n > 0").groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("r"), F.count(F.lit(1)).alias("copies"))
    named = by_fp.select("fp", F.col("r.doc_id").alias("doc_id"), F.col("r.mark").alias("mark"), "copies")
    firsts = sets.where("n > 0").join(named, (sets.fp == named.fp) & sets.doc_id.eqNullSafe(named.doc_id) & (sets.mark == named.mark), "left_semi")
    # rows that repeat a representative are the same set, mark and id; one of them stays
    others = [F.first(c).alias(c) for c in firsts.columns if c != "fp"]
    reps = materialise(firsts.groupBy("fp").agg(F.count(F.lit(1)).alias("rows"), *others).withColumn("id", F.monotonically_increasing_id()))
    release(docs.sparkSession)

    sizes = {r["n"]: r["k"] for r in reps.groupBy("n").agg(F.count(F.lit(1)).alias("k")).where(F.col("n") < 4 * light_limit(percent)).collect()}
    lists = reps.select(F.explode("rare").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("k"))
    scanned = lists.agg((F.sum(F.col("k") * F.col("k")) / F.sum("k")).alias("x")).first()["x"]
    boundary = choose_boundary(sizes, percent, float(scanned or 1.0))

    links = materialise(light_links(reps, percent, boundary))
    heavy = materialise(dense(reps, percent, boundary))
    release(docs.sparkSession)
    near = scan_lists(heavy.withColumn("root", F.col("id")), percent, all_pairs=False)
    near = materialise(near.groupBy("b").agg(F.min(F.struct("apart", "a")).alias("m")).select("b", F.col("m.a").alias("a")))
    release(docs.sparkSession)
    links = materialise(links.unionByName(_linked(docs, near, reps, size, percent, doc_id, text)))
    release(docs.sparkSession)
    roots = components(links)
    rest = scan_lists(heavy.join(roots, heavy.id == roots.node, "left").withColumn("root", F.coalesce("root", "id")), percent, all_pairs=True)
    rest = materialise(rest.select("a", "b").distinct().join(near.select("a", "b"), ["a", "b"], "left_anti"))
    release(docs.sparkSession)
    if not rest.isEmpty():
        roots = components(links.unionByName(_linked(docs, rest, reps, size, percent, doc_id, text)))

    group = reps.select("id", "fp", "doc_id", "mark").join(named.select("fp", "copies"), "fp").join(roots, F.col("id") == F.col("node"), "left")
    group = group.select("fp", "copies", "doc_id", "mark", F.coalesce("root", "id").alias("root"), F.col("root").isNotNull().alias("linked"))
    group = materialise(group.where("linked or copies > 1"))
    smallest = group.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("r"))
    named = [F.col("r.doc_id").alias("component_id"), F.col("r.mark").alias("component_mark")]
    return sets, group.join(smallest, "root").select("fp", "copies", *named)


def _placed(docs: DataFrame, size: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """`doc_id, mark, n_shingles, component_id, component_mark`, one row per document; the last is missing where a row is
    alone in its component."""
    sets, known = classes(docs, size, percent, doc_id, text)
    rows = sets.select("doc_id", "mark", F.col("n").alias("n_shingles"), F.coalesce("fp", F.lit(b"")).alias("fp"))
    out = attach(rows, materialise(known), "fp", "copies")
    return out.select("doc_id", "mark", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "component_mark")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id, mark, n_shingles, component_id`, one row per document."""
    return _placed(docs, size, percent, doc_id, text).drop("component_mark")


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without the near duplicates of another: of each component one row stays, that of the smallest doc_id.

    A row that is alone in its component stays, whatever its doc_id: documents without words, as nothing links to them, and
    unlinked texts that share a doc_id or have none. In a component, ids come before missing ones; of several texts with
    the id that stays, or of a component without ids, the one with the smallest hash stays; of rows that repeat it, one."""
    placed = materialise(_placed(docs, size, percent, doc_id, text).where("component_mark is not null"))
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("mark") == F.col("component_mark"))
    gone = materialise(placed.where(~stays).select(F.col("doc_id").alias("g"), F.col("mark").alias("h")).distinct())
    again = placed.where(stays).groupBy(F.col("doc_id").alias("g"), F.col("mark").alias("h")).agg(F.count(F.lit(1)).alias("k"))
    again = materialise(again.where("k > 1").select("g", "h"))
    rows = docs.select(packed(docs).alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"))
    same = F.col("doc_id").eqNullSafe(F.col("g")) & (F.col("mark") == F.col("h"))

    def matched(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
        return a.join(F.broadcast(b) if b.count() <= BROADCAST_ROWS else b, same, how)

    kept = matched(rows, gone, "left_anti")
    if again.isEmpty():
        return kept.select("row.*")
    one = matched(kept, again, "left_semi").dropDuplicates(["doc_id", "mark"])
    return matched(kept, again, "left_anti").unionByName(one).select("row.*")
