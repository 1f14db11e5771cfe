"""Fit a reduction of wide frames on some rows, apply it to others: selection, imputation, scaling, principal components.

Everything a reduction learns comes from the rows it is fitted on, so that a model that is validated on later rows has seen
nothing of them. Fitting takes two scans: facts per column, and the moments of all pairs of columns in tiles. The latter hold
the correlations that selection needs, the means, the deviations and the covariance of the filled and scaled columns.

Up to ``DENSE`` columns the covariance is a matrix of bounded size and is decomposed as it is. Beyond, the components come from
a randomised range finder: a block of a few vectors more than components is multiplied by the covariance, one scan each
time, and only columns x block numbers reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import StringIndexer, StringIndexerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.operators import moments
from ledgerlens.operators.selection import FACTS, column_facts, correlated_drops, numeric_frame, removal_report
from ledgerlens.session import materialise

DENSE = 512
#: Vectors beside the components, and scans, of the randomised range finder.
SPARE, SCANS = 20, 12


@dataclass(frozen=True)
class Reduction:
    """What was learned: columns that stay, their means and deviations, and the components (columns x k)."""

    ids: tuple[str, ...]
    indexer: StringIndexerModel | None
    columns: tuple[str, ...]
    mean: np.ndarray
    scale: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    reasons: dict[str, str]

    def apply(self, df: DataFrame, *also: str, name: str = "features") -> DataFrame:
        """Ids, further columns and the components of each row as a vector."""
        kept = [*self.ids, *[c for c in also if c not in self.ids]]
        if not self.columns:
            return df.select(*[F.col(f"`{c}`") for c in kept], array_to_vector(F.array().cast("array<double>")).alias(name))
        beside = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_beside")
        rows = _indexed(df.select(beside, *[F.col(f"`{c}`") for c in self._sources(df)]), self.indexer)
        packed = F.struct(*[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(self.columns)])
        rows = rows.select("_beside", packed.alias("_x"))
        schema = T.StructType([rows.schema["_beside"], T.StructField("_v", T.ArrayType(T.DoubleType()))])
        return rows.mapInArrow(self._project(), schema).select("_beside.*", array_to_vector("_v").alias(name))

    def standardised(self, df: DataFrame) -> DataFrame:
        """Ids and the filled and scaled columns as a vector."""
        p = len(self.columns)
        return replace(self, components=np.eye(p), variances=np.ones(p)).apply(df)

    def _sources(self, df: DataFrame) -> list[str]:
        """Columns of the frame that are read."""
        texts = self.indexer.getInputCols() if self.indexer else []
        return [c for c in df.columns if c in {*self.columns, *texts}]

    def _project(self):
        mean, matrix = self.mean, self.components / self.scale[:, None]

        def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column(1).flatten())
                out = np.where(np.isnan(x), 0.0, x - mean) @ matrix
                offsets = pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))], names=["_beside", "_v"])

        return project


def _matrix(columns: list) -> np.ndarray:
    return np.column_stack([c.to_numpy(zero_copy_only=False) for c in columns]).astype(float) if columns else np.zeros((0, 0))


def _indexed(df: DataFrame, indexer: StringIndexerModel | None) -> DataFrame:
    return indexer.transform(df) if indexer is not None else df


def _sums(df: DataFrame, columns: list[str], middle: np.ndarray) -> tuple[np.ndarray, ...]:
    """The six sums of ``moments.tiles`` as whole matrices, for a bounded number of columns."""
    return _whole(_gathered(moments.tiles(df, columns, middle), len(columns), 1)[0])


def _gathered(tiles: DataFrame, p: int, groups: int) -> np.ndarray:
    """Tiles put together on the driver: group x sum x column x column, blocks i <= j."""
    out = np.zeros((groups, len(moments.SUMS), p, p))
    for row in tiles.toLocalIterator():
        i, j = row["i"] * moments.TILE, row["j"] * moments.TILE
        high, wide = min(moments.TILE, p - i), min(moments.TILE, p - j)
        out[row["g"] if "g" in row else 0, :, i : i + high, j : j + wide] = np.asarray(row["v"]).reshape(len(moments.SUMS), high, wide)
    return out


def _whole(sums: np.ndarray) -> tuple[np.ndarray, ...]:
    # blocks i <= j are given; below them the roles of the two columns change
    xy, x, y, xx, yy, n = sums
    upper = np.triu(np.ones(xy.shape, dtype=bool))
    whole = lambda a, b: np.where(upper, a, b.T)
    return whole(xy, xy), whole(x, y), whole(y, x), whole(xx, yy), whole(yy, xx), whole(n, n)


def _text_indexer(frame: DataFrame, ids: Sequence[str]) -> tuple[list[str], StringIndexer | None]:
    texts = [c for c, t in frame.dtypes if t == "string" and c not in ids]
    return texts, StringIndexer(inputCols=texts, outputCols=[f"{c}_index" for c in texts], handleInvalid="keep") if texts else None


def fit(df: DataFrame, ids: Sequence[str], k: int = 10, max_null: float = 0.25, max_corr: float = 0.95, dense: int = DENSE) -> Reduction:
    """Learn a reduction to ``k`` components from the rows of ``df``; every column beside the ids is a feature.

    Columns that are mostly missing, constant or highly correlated with an earlier one go. Text is indexed by frequency.
    """
    frame = numeric_frame(df, ids)
    texts, unfitted = _text_indexer(frame, ids)
    indexer = unfitted.fit(frame.select(*texts)) if unfitted else None
    frame = _indexed(frame, indexer)
    columns = [c for c in frame.columns if c not in ids and c not in texts]
    reasons: dict[str, str] = {}
    rows = 0
    for row in removal_report(column_facts(frame, columns), max_null).collect():  # one row per column
        rows = row["rows"]
        for reason in ("highly_null", "low_information", "single_value"):
            if row[reason]:
                reasons.setdefault(row["column"], reason)
    open_ = [c for c in columns if c not in reasons]
    if len(open_) <= dense:
        center = moments.center(moments.numbers(frame, open_)) if open_ else np.zeros(0)
        return _from_sums(ids, indexer, open_, center, _sums(frame, open_, center) if open_ else None, rows, k, max_corr, reasons)
    strong = np.zeros((len(open_), len(open_)), dtype=bool)
    for r in moments.pair_correlations(frame, open_).where(F.abs("corr") >= max_corr).collect():  # strong pairs only
        strong[r["i"], r["j"]] = strong[r["j"], r["i"]] = True
    dropped = correlated_drops(strong, open_, 1.0)
    kept = [c for c in open_ if c not in dropped]
    mean, scale = _scales(frame, kept, rows)
    components, variances = randomised_components(frame, kept, mean, scale, rows, k)
    return _signed(ids, indexer, kept, mean, scale, components, variances, reasons | {c: "highly_correlated" for c in dropped})


def _from_sums(
    ids: Sequence[str], indexer: StringIndexerModel | None, open_: list[str], center: np.ndarray, sums: tuple | None, rows: int, k: int, max_corr: float, reasons: dict
) -> Reduction:
    """The reduction that the sums of all pairs of columns give."""
    mean, scale, cov, dropped = _from_tiles(sums, open_, center, rows, max_corr)
    kept = [c for c in open_ if c not in dropped]
    at = [i for i, c in enumerate(open_) if c in set(kept)]
    mean, scale, cov = mean[at], scale[at], cov[np.ix_(at, at)]
    values, vectors = np.linalg.eigh(cov) if kept else (np.zeros(0), np.zeros((0, 0)))
    best = np.argsort(-values)[:k]
    return _signed(ids, indexer, kept, mean, scale, vectors[:, best], values[best], reasons | {c: "highly_correlated" for c in dropped})


def _signed(ids: Sequence[str], indexer: StringIndexerModel | None, kept: list[str], mean: np.ndarray, scale: np.ndarray, components: np.ndarray, variances: np.ndarray, reasons: dict) -> Reduction:
    signs = np.sign(components[np.argmax(np.abs(components), axis=0), np.arange(components.shape[1])]) if len(components) else np.ones(0)
    return Reduction(tuple(ids), indexer, tuple(kept), mean, scale, components * np.where(signs == 0, 1, signs), variances, reasons)


def fit_before(df: DataFrame, ids: Sequence[str], fold: str, folds: int, k: int = 10, max_null: float = 0.25, max_corr: float = 0.95, dense: int = DENSE) -> list[Reduction]:
    """For every f = 1 .. ``folds`` what ``fit`` learns from the rows with ``fold`` < f.

    Counts, extremes and sums of pairs add up over folds, so each is one scan for all f, grouped by fold, and not one scan
    of all earlier rows for each f. Only the codes of texts differ from f to f: each f has index columns of its own.
    """
    frame = numeric_frame(df, [*ids, fold]).where(F.col(fold) < folds)
    texts, unfitted = _text_indexer(frame, [*ids, fold])
    numeric = [c for c in frame.columns if c not in {*ids, fold, *texts}]
    indexers = [unfitted.fit(frame.where(F.col(fold) < f).select(*texts)) if unfitted else None for f in range(1, folds + 1)]
    own = [{c: c for c in numeric} | {f"{c}_index": f"{c}_index of fold {f}" for c in texts} for f in range(folds)]
    for named, indexer in zip(own, indexers):
        if indexer is not None:
            frame = indexer.copy().setOutputCols([named[f"{c}_index"] for c in texts]).transform(frame)
    shown = list(dict.fromkeys(c for named in own for c in named.values()))
    rows, known, low, high = _facts_by_fold(frame, shown, fold, folds)
    open_, reasons = [], []
    for f, named in enumerate(own, 1):
        at = [shown.index(c) for c in named.values()]
        n, total = known[:f, at].sum(axis=0), rows[:f].sum()
        least, most = np.fmin.reduce(low[:f, at]), high[:f, at].max(axis=0, initial=-np.inf)
        constant = (n > 0) & ((least == most) | np.isnan(least))
        share = np.ones(len(at)) if total == 0 else 1 - n / total
        why = ["highly_null" if s >= max_null else "single_value" if c or not m else None for s, c, m in zip(share, constant, n)]
        why = ["low_information" if w == "single_value" and (not m or m == total) else w for w, m in zip(why, n)]
        reasons.append({c: w for c, w in zip(named, why) if w})
        open_.append([c for c in named if c not in reasons[-1]])
    if max(map(len, open_)) > dense:
        return [fit(df.where(F.col(fold) < f).drop(fold), ids, k, max_null, max_corr, dense) for f in range(1, folds + 1)]
    used = [c for c in shown if any(c == named[n] for named, names in zip(own, open_) for n in names)]
    center = moments.center(moments.numbers(frame.where(F.col(fold) == 0), used)) if used else np.zeros(0)
    sums = _gathered(moments.tiles(frame, used, center, fold), len(used), folds) if used else None
    out = []
    for f, (named, names) in enumerate(zip(own, open_), 1):
        at = [used.index(named[n]) for n in names]
        upto = tuple(m[np.ix_(at, at)] for m in _whole(sums[:f].sum(axis=0))) if names else None
        out.append(_from_sums(ids, indexers[f - 1], names, center[at], upto, int(rows[:f].sum()), k, max_corr, reasons[f - 1]))
    return out


def _facts_by_fold(frame: DataFrame, columns: list[str], fold: str, folds: int) -> tuple[np.ndarray, ...]:
    """Rows of each fold; per fold and column the known values and their extremes (NaN above all others, as Spark has it)."""
    rows, known = np.zeros(folds), np.zeros((folds, len(columns)))
    low, high = np.full(known.shape, np.nan), np.full(known.shape, -np.inf)
    for start in range(0, len(columns), FACTS):
        batch = [(i, columns[i].replace("`", "``")) for i in range(start, min(len(columns), start + FACTS))]
        facts = [F.expr(f"{what}(`{c}`) AS {what}{i}") for i, c in batch for what in ("count", "min", "max")]
        for row in frame.groupBy(fold).agg(F.expr("count(1) AS _rows"), *facts).collect():  # one row per fold
            f = row[fold]
            rows[f] = row["_rows"]
            for i, _ in batch:
                known[f, i] = row[f"count{i}"]
                if row[f"count{i}"]:
                    low[f, i], high[f, i] = row[f"min{i}"], row[f"max{i}"]
    return rows, known, low, high


def apply_all(reductions: Sequence[Reduction], df: DataFrame, fold: str, *also: str, name: str = "features") -> DataFrame:
    """Ids, further columns and, as ``features1, features2, ..``, the components by each of the reductions of ``fit_before``: one
    scan for all. Rows with ``fold`` > f take no part in reduction f and have no components there."""
    kept = [*reductions[0].ids, *[c for c in dict.fromkeys([*also, fold]) if c not in reductions[0].ids]]
    beside = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_beside")
    sources = dict.fromkeys(c for r in reductions for c in r._sources(df))
    rows = df.select(beside, F.col(f"`{fold}`").cast("int").alias("_fold"), *[F.col(f"`{c}`") for c in sources if c != fold])
    packed, steps = [], []
    for f, r in enumerate(reductions):
        texts = r.indexer.getOutputCols() if r.indexer else []
        named = {c: f"{c} of reduction {f}" for c in texts}
        if r.indexer:
            rows = r.indexer.copy().setOutputCols([*named.values()]).transform(rows)
        places = []
        for c in r.columns:
            source = named.get(c, c)
            if source not in packed:
                packed.append(source)
            places.append(packed.index(source))
        steps.append((places, r.mean, r.components / r.scale[:, None] if places else np.zeros((0, 0))))
    vector = F.struct(F.lit(0.0).alias("_"), *[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(packed)]).alias("_x")
    rows = rows.select("_beside", "_fold", vector)
    arrays = [T.StructField(f"_v{f}", T.ArrayType(T.DoubleType())) for f in range(1, len(reductions) + 1)]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, at = _matrix(batch.column(2).flatten())[:, 1:], batch.column(1).to_numpy()
            out = []
            for f, (places, mean, turn) in enumerate(steps, 1):
                part = x[:, places][at <= f]
                part = np.where(np.isnan(part), 0.0, part - mean) @ turn
                offsets = np.concatenate([[0], np.cumsum(at <= f)]) * part.shape[1]
                out.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(part.ravel())))
            yield pa.RecordBatch.from_arrays([batch.column(0), *out], names=["_beside", *[a.name for a in arrays]])

    found = rows.mapInArrow(project, T.StructType([rows.schema["_beside"], *arrays]))
    return found.select("_beside.*", *[array_to_vector(f"_v{f}").alias(f"{name}{f}") for f in range(1, len(reductions) + 1)])


def _from_tiles(sums: tuple | None, columns: list[str], center: np.ndarray, rows: int, max_corr: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Means, deviations and covariance of the filled and scaled columns, and columns that follow another one."""
    if not columns:
        return np.zeros(0), np.ones(0), np.zeros((0, 0)), []
    xy, x, y, xx, yy, n = sums
    with np.errstate(divide="ignore", invalid="ignore"):
        cov = xy - x * y / n
        spread = [np.where(s - t * t / n > 1e-12 * np.where(s > 0, s, 1.0), s - t * t / n, np.nan) for s, t in ((xx, x), (yy, y))]
        corr = cov / np.sqrt(spread[0] * spread[1])
    np.fill_diagonal(corr, 0.0)
    known = np.diag(n)
    moved = np.diag(x) / np.maximum(known, 1)
    # products about the means of all known values; a missing value is filled with the mean and adds nothing
    about = xy - moved[:, None] * y - moved[None, :] * x + n * np.outer(moved, moved)
    scale = np.sqrt(np.maximum(np.diag(about), 0.0) / max(rows - 1, 1))
    scale[scale == 0] = 1.0
    return center + moved, scale, about / max(rows - 1, 1) / np.outer(scale, scale), correlated_drops(corr, columns, max_corr)


def _scales(frame: DataFrame, columns: list[str], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of many columns, a batch of aggregates at a time."""
    mean, scale = [], []
    for start in range(0, len(columns), 100):
        batch = columns[start : start + 100]
        exprs = [e for c in batch for e in (F.avg(f"`{c}`"), F.var_pop(f"`{c}`") * F.count(f"`{c}`"))]
        row = frame.agg(*exprs).first()
        mean += [row[2 * i] or 0.0 for i in range(len(batch))]
        scale += [((row[2 * i + 1] or 0.0) / max(rows - 1, 1)) ** 0.5 or 1.0 for i in range(len(batch))]
    return np.array(mean), np.array(scale)


def randomised_components(
    frame: DataFrame, columns: Sequence[str], mean: np.ndarray, scale: np.ndarray, rows: int, k: int, spare: int = SPARE, scans: int = SCANS, seed: int = 7
) -> tuple[np.ndarray, np.ndarray]:
    """The leading ``k`` components of the filled and scaled columns and their variances, by subspace iteration.

    Each scan multiplies the covariance by a block of ``k + spare`` vectors: a task sums x (x' Q) over its rows and passes on
    columns x block numbers, in pieces of ``moments.TILE`` columns.
    """
    p = len(columns)
    width = min(p, k + spare)
    numbers = materialise(moments.numbers(frame, columns))
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(p, width)))[0]
    scans = 1 if width == p else scans
    for _ in range(scans):
        z = _multiplied(numbers, mean, scale, q) / max(rows - 1, 1)
        small = q.T @ z
        values, turn = np.linalg.eigh((small + small.T) / 2)
        best = np.argsort(-values)[:k]
        found, variances = q @ turn[:, best], values[best]
        q = np.linalg.qr(z)[0]
    return found, variances


def _multiplied(numbers: DataFrame, mean: np.ndarray, scale: np.ndarray, q: np.ndarray) -> np.ndarray:
    shared = numbers.sparkSession.sparkContext.broadcast(q)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        total = np.zeros_like(block)
        for batch in batches:
            raw = _matrix(batch.columns)
            x = np.where(np.isnan(raw), 0.0, (raw - mean) / scale)
            total += x.T @ (x @ block)
        for i in range(0, len(total), moments.TILE):
            piece = total[i : i + moments.TILE].ravel()
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([piece], pa.list_(pa.float64()))], names=["i", "v"])

    parts = numbers.mapInArrow(fold, "i int, v array<double>")
    sums = parts.groupBy("i").agg(vector_to_array(Summarizer.sum(array_to_vector(F.col("v")))).alias("v"))
    out = np.zeros_like(q)
    for row in sums.toLocalIterator():
        piece = np.asarray(row["v"]).reshape(-1, q.shape[1])
        out[row["i"] : row["i"] + len(piece)] = piece
    return out
