"""Nearest neighbours by a permutation index.

Pivots are picked from a bounded sample, each as far as possible from those before it. A vector is represented by the order
in which it sees its nearest pivots; every pivot's inverted file holds the places at which vectors have it. A query adds up
the files of its own pivots to the footrule distance between its order and that of every vector, takes the nearest by that
measure as candidates, and ranks those by the exact inner product.

Largest inner product is turned into nearest angle first: vectors get one more component that gives all of them the length
of the longest, queries get a zero there. One very long vector would make all others look alike, so vectors are dealt to bands
by the power of two of their length, and a segment knows no longer ones than its own.

The bands are dealt to segments of bounded size, each with its own inverted files; the stated queries visit all segments in
blocks, each segment answers with its best, and the best of those remain. Of the ids with the same vector only the
`neighbours` + 1 smallest can ever be an answer; the others ask but are not indexed, so a vector that fills a third of the
table costs nothing.

Defined results: rows without id, and vectors that are missing, zero, of another length than most, or hold missing or
non-finite components take no part; equal scores go by id; rows that repeat both id and vector count as one, as question
and as candidate; an id with several vectors is a candidate with each and asks with each, which gives one list, ranked from
1, for each of its vectors under its query_id; a row never answers the query of its own id, whatever its vector; fewer candidates than asked for are all returned; an empty table gives an empty
result; other columns are not read and cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.frames import materialise

PIVOTS = 128
#: Places of an order that are kept; shorter orders give shorter inverted files and lower recall.
PREFIX = 128
#: The pivots are picked from so many distinct vectors at most.
SAMPLE = 4_000
SEGMENT = 8_192
#: Smaller segments than this are not made to occupy more tasks.
SMALLEST_SEGMENT = 512
#: Share of a segment that is ranked exactly, and the least number.
RERANK_SHARE, RERANK_LEAST = 0.12, 256
SEED = 7


def _power(v: Column) -> Column:
    """The power of two at or below the length of a vector. Components are taken by their largest first, as squares of very long or
    short ones are no doubles any more."""
    largest = F.array_max(F.transform(v, F.abs))
    squares = F.aggregate(v, F.lit(0.0), lambda a, x: a + (x / largest) * (x / largest))
    return F.floor(F.log2(largest) + F.log2(squares) / 2).cast("int")


def usable(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """`vec_id, v` (doubles) of the vectors that take part."""
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.coalesce(fine, F.lit(False)))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.col("count").desc(), "n").first()
    return rows.where(F.size("v") == (size["n"] if size else 0))


def pick_pivots(sample: np.ndarray, pivots: int) -> np.ndarray:
    """Farthest first: each pivot is the sampled vector whose nearest pivot so far is farthest away."""
    chosen, near = [0], sample @ sample[0]
    while len(chosen) < min(pivots, len(sample)):
        at = int(np.argmin(near))
        chosen.append(at)
        near = np.maximum(near, sample @ sample[at])
    return sample[chosen]


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """Unit vectors with one more component, such that angles to a lifted query sort as inner products do."""
    rest = np.sqrt(np.maximum(0.0, longest * longest - (x * x).sum(axis=1)))
    return np.column_stack([x, rest]) / longest


def shortened(pivots: np.ndarray, longest: float) -> np.ndarray:
    """Pivots as lifted vectors for a segment whose vectors have at most this length."""
    length = np.sqrt((pivots * pivots).sum(axis=1))
    return lifted(pivots * np.minimum(1.0, longest / length)[:, None], longest)


def orders(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest pivots of each vector, nearest first."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :prefix]


class Segment:
    """Inverted files of one segment: files[p][i] is the place of pivot p in the order of vector i, or `prefix` if it has none."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, longest: float, prefix: int, power: int = 0):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.vectors, self.prefix = ids[by_id], vectors[by_id], prefix
        seen = orders(lifted(np.ldexp(self.vectors, -power), longest), pivots, prefix)
        self.files = np.full((len(pivots), len(ids)), prefix, dtype=np.int16)
        self.files[seen, np.arange(len(ids))[:, None]] = np.arange(seen.shape[1], dtype=np.int16)

    def footrule(self, order: np.ndarray) -> np.ndarray:
        """Sum over the query's pivots of how far their places lie apart."""
        total = np.zeros(len(self.ids), dtype=np.int32)
        for place, pivot in enumerate(order):
            total += np.abs(self.files[pivot] - np.int16(place))
        return total

    def search(self, own: int, q: np.ndarray, order: np.ndarray, n: int, share: float, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and inner products of the best n. Equal distances go by id."""
        mine = slice(np.searchsorted(self.ids, own), np.searchsorted(self.ids, own, "right"))
        reach = max(least, int(np.ceil(share * len(self.ids))), n + 1)
        if reach < len(self.ids) - (mine.stop - mine.start):
            far = self.footrule(order)
            far[mine] = np.iinfo(far.dtype).max
            limit = np.partition(far, reach - 1)[reach - 1]
            near = np.flatnonzero(far < limit)
            at = np.sort(np.concatenate([near, np.flatnonzero(far == limit)[: reach - len(near)]]))
        else:
            at = np.arange(len(self.ids))
        at = at[self.ids[at] != own]
        exact = (self.vectors[at] * q).sum(axis=1)
        best = np.lexsort((self.ids[at], -exact))[:n]
        return self.ids[at][best], exact[best]


def search(
    table: DataFrame,
    asks: Column,
    neighbours: int = 20,
    pivots: int = PIVOTS,
    prefix: int = PREFIX,
    segment: int = SEGMENT,
    share: float = RERANK_SHARE,
    least: int = RERANK_LEAST,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """`query_id, rank, vec_id, score` for the rows of `table` for which `asks` (a condition on vec_id) holds."""
    rows = materialise(usable(table, vec_id, embedding).distinct().withColumn("ask", F.monotonically_increasing_id()))
    same = Window.partitionBy("mark").orderBy("vec_id")
    marked = rows.withColumn("mark", F.struct(F.xxhash64("v"), F.hash("v")))
    indexed = marked.withColumn("n", F.row_number().over(same)).where(F.col("n") <= neighbours + 1).select("vec_id", "v", F.col("n") == 1)
    indexed = materialise(indexed.toDF("vec_id", "v", "first"))
    indexed = indexed.withColumn("band", _power(F.col("v")))
    tasks = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts, bands, segments = {}, [], 0
    for r in indexed.groupBy("band").count().orderBy("band").collect():  # no more bands than a double has powers of two
        own = max(1, -(-r["count"] // segment), min(tasks, r["count"] // SMALLEST_SEGMENT))
        parts[r["band"]] = (segments, own)
        bands += [r["band"]] * own
        segments += own
    segments = max(1, segments)
    drawn = indexed.where("first").orderBy(F.xxhash64(F.lit(SEED), "v"), "vec_id").limit(SAMPLE).select("v", "band").collect()
    sample = np.array([np.ldexp(r["v"], -r["band"]) for r in drawn], dtype=float)
    reach = float(np.sqrt((sample * sample).sum(axis=1).max())) if len(drawn) else 1.0
    picked = pick_pivots(lifted(sample, reach), pivots)[:, :-1] * reach if len(drawn) else np.zeros((0, 0))

    place = F.create_map(*[x for band, p in parts.items() for x in (F.lit(band), F.struct(F.lit(p[0]).alias("first"), F.lit(p[1]).alias("own")))]) if parts else None
    where = place[F.col("band")] if parts else F.struct(F.lit(0).alias("first"), F.lit(1).alias("own"))
    seg = where["first"] + F.pmod(F.xxhash64(F.lit(SEED), "v", "vec_id"), where["own"])
    data = indexed.select(seg.cast("long").alias("seg"), F.lit(0).alias("kind"), "vec_id", "v", F.lit(0).cast("long").alias("ask"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(segments - 1).cast("long")))
    queries = rows.where(asks).select(every.alias("seg"), F.lit(1).alias("kind"), "vec_id", "v", "ask")
    meet = data.unionByName(queries).repartition(segments, "seg").sortWithinPartitions("seg", "kind", "vec_id", "ask")
    schema = pa.schema([("ask", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        index, at, chosen = None, None, None
        for batch in batches:
            segs, kinds, ids = (batch.column(i).to_numpy() for i in range(3))
            v, asks = batch.column(3).flatten().to_numpy().reshape(len(ids), -1), batch.column(4).to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(segs) != 0) | (np.diff(kinds) != 0)) + 1), len(ids)]
            for a, b in zip(cuts, cuts[1:]):
                if segs[a] != at:
                    held, index, at = [], None, segs[a]
                if kinds[a] == 0:
                    held.append((ids[a:b], v[a:b]))
                    continue
                if index is None and held:
                    stored, power = np.concatenate([x for _, x in held]), bands[at]
                    longest = float(np.sqrt((np.ldexp(stored, -power) ** 2).sum(axis=1).max()))
                    chosen = shortened(picked, longest)
                    index = Segment(np.concatenate([i for i, _ in held]), stored, chosen, longest, prefix, power)
                    held = []
                if index is None:
                    continue
                for c in range(a, b, 256):
                    own, asked = ids[c : min(b, c + 256)], v[c : min(b, c + 256)]
                    unit = asked / np.abs(asked).max(axis=1)[:, None]
                    unit = unit / np.sqrt((unit * unit).sum(axis=1))[:, None]
                    seen = orders(np.column_stack([unit, np.zeros(len(asked))]), chosen, prefix)
                    found = [index.search(i, q, o, neighbours, share, least) for i, q, o in zip(own, asked, seen)]
                    counts = [len(i) for i, _ in found]
                    answers = [np.concatenate([i for i, _ in found]), np.concatenate([s for _, s in found])]
                    numbers = [np.repeat(asks[c : min(b, c + 256)], counts), np.repeat(own, counts)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in numbers + answers], schema=schema)

    best = Window.partitionBy("ask").orderBy(F.col("score").desc(), "vec_id")
    out = meet.mapInArrow(answer, "ask long, query_id long, vec_id long, score double").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= neighbours)
    return out.select("query_id", "rank", "vec_id", "score")
