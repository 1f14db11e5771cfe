"""Moments of all pairs of columns from one scan, in tiles.

Each task folds its rows into products of column blocks. What it passes on are tiles: for two blocks of ``TILE`` columns the
sums that a correlation needs (products, values and squares where the other is known, counts). Spark adds tiles of one
place up, and a tile becomes the correlations of its pairs where it lies, so neither a row nor the driver ever holds
columns x columns numbers. Values are taken less the mean of a few rows, which keeps the subtraction of moments accurate.

A task holds ``4 * columns**2`` numbers while it folds. From ``WIDEST`` columns on, the blocks are folded stripe by stripe, a
scan each, so that this stays bounded.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = 64
WIDEST = 2048
#: Rows whose mean is subtracted; any number would do, results differ only by rounding.
PEEK = 1000
#: Sums of a tile, in this order.
SUMS = ("xy", "x", "y", "xx", "yy", "n")


def numbers(df: DataFrame, columns: Sequence[str], *also: str) -> DataFrame:
    """The columns as doubles ``x0, x1, ..``, after the columns ``also``."""
    return df.select(*also, *[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(columns)])


def center(rows: DataFrame) -> np.ndarray:
    """What is subtracted from each column before its products are summed."""
    few = rows.limit(PEEK).toPandas().to_numpy(dtype=float)
    known = np.isfinite(few)
    total = np.where(known, few, 0.0).sum(axis=0)
    return total / np.maximum(known.sum(axis=0), 1)


def _stripes(blocks: int) -> list[range]:
    """Block rows that one scan folds."""
    each = max(1, WIDEST * WIDEST // (blocks * TILE * TILE))
    return [range(i, min(blocks, i + each)) for i in range(0, blocks, each)]


def tiles(df: DataFrame, columns: Sequence[str], middle: np.ndarray | None = None, by: str | None = None) -> DataFrame:
    """``i, j, v``: for blocks i <= j of ``TILE`` columns the six sums over rows, one after the other, of values less ``middle``.
    With ``by``, a column of a few whole numbers, for each of its numbers ``g``."""
    p = len(columns)
    middle = center(numbers(df, columns)) if middle is None else middle
    group = F.lit(0) if by is None else F.col(f"`{by}`").cast("int")
    rows = numbers(df.withColumn("_g", group), columns, "_g")
    blocks = -(-p // TILE)
    parts = None
    for stripe in _stripes(blocks):

        def fold(batches: Iterator[pa.RecordBatch], stripe: range = stripe) -> Iterator[pa.RecordBatch]:
            first, last = stripe[0] * TILE, min(p, (stripe[-1] + 1) * TILE)
            zeros = lambda: [np.zeros((last - first, p - first)) for _ in SUMS]
            groups = {0: zeros()} if by is None else {}
            for batch in batches:
                raw = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[first + 1 :]]).astype(float)
                known = ~np.isnan(raw)
                every, all_known = np.where(known, raw - middle[first:], 0.0), known.astype(float)
                group = batch.column(0).to_numpy()
                for g in np.unique(group):
                    x, m = (every, all_known) if (group == g).all() else (every[group == g], all_known[group == g])
                    sums = groups[int(g)] if int(g) in groups else groups.setdefault(int(g), zeros())
                    a, b = x[:, : last - first], m[:, : last - first]
                    for s, (u, v) in zip(sums, ((a, x), (a, m), (b, x), (a * a, m), (b, x * x), (b, m))):
                        s += u.T @ v
            for g, sums in groups.items():
                for i in stripe:
                    for j in range(i, blocks):
                        own = np.s_[i * TILE - first : (i + 1) * TILE - first, j * TILE - first : (j + 1) * TILE - first]
                        tile = np.concatenate([s[own].ravel() for s in sums])
                        place = [pa.array([n], pa.int32()) for n in (g, i, j)]
                        yield pa.RecordBatch.from_arrays([*place, pa.array([tile], pa.list_(pa.float64()))], names=["g", "i", "j", "v"])

        part = rows.mapInArrow(fold, "g int, i int, j int, v array<double>")
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("i", "j", *([] if by is None else ["g"])).agg(vector_to_array(Summarizer.sum(array_to_vector(F.col("v")))).alias("v"))


def pair_correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``i, j, corr``: Pearson correlation of columns number i < j over the rows where both are known; NULL where one is constant
    there."""
    p = len(columns)

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                wide, high = min(TILE, p - row.j * TILE), min(TILE, p - row.i * TILE)
                xy, x, y, xx, yy, n = np.asarray(row.v).reshape(len(SUMS), high, wide)
                with np.errstate(divide="ignore", invalid="ignore"):
                    cov = xy - x * y / n
                    spread = [np.where(s - t * t / n > 1e-12 * np.where(s > 0, s, 1.0), s - t * t / n, np.nan) for s, t in ((xx, x), (yy, y))]
                    corr = cov / np.sqrt(spread[0] * spread[1])
                a, b = np.meshgrid(np.arange(high) + row.i * TILE, np.arange(wide) + row.j * TILE, indexing="ij")
                upper = a < b
                yield pd.DataFrame({"i": a[upper], "j": b[upper], "corr": pd.array(corr[upper], dtype="Float64")})

    if p < 2:
        return df.sparkSession.createDataFrame([], "i int, j int, corr double")
    found = tiles(df, columns).mapInPandas(finish, "i int, j int, corr double")
    return found.withColumn("corr", F.when(~F.isnan("corr"), F.col("corr")))


def named_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``a, b, corr`` of every pair of columns, ``a`` before ``b``."""
    names = F.array(*[F.lit(c) for c in columns]) if columns else F.array(F.lit(""))
    return pair_correlations(df, columns).select(names[F.col("i")].alias("a"), names[F.col("j")].alias("b"), "corr")
