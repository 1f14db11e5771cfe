"""Feature selection and reduction."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, Imputer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.operators.features import BATCH
from ledgerlens.operators.moments import pair_correlations
from ledgerlens.operators.shape import split_columns
from ledgerlens.session import compiled_methods, materialise


#: Columns per aggregation of ``column_facts``: three buffers each stay below the 100 fields up to which Spark generates code.
FACTS = 32


def column_facts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, rows, non_null, null_share, constant`` per column; plain aggregates, a row per column. Extremes of texts are not of
    fixed size, which Spark aggregates by sorting, so texts are kept apart from the others."""
    kinds = dict(df.dtypes)
    texts = [c for c in columns if kinds[c] in ("string", "binary")]
    others = [c for c in columns if c not in set(texts)]
    frames = []
    for names in [part[i : i + FACTS] for part in (others, texts) for i in range(0, len(part), FACTS)]:
        # SQL text instead of column objects: one call per expression keeps wide plans quick to build
        batch = [(i, c.replace("`", "``")) for i, c in enumerate(names)]
        exprs = [F.expr("count(1) AS _rows")]
        for i, c in batch:
            exprs += [F.expr(f"count(`{c}`) AS n{i}"), F.expr(f"min(`{c}`) = max(`{c}`) AS c{i}")]
        rows = ", ".join(
            f"named_struct('column', '{c}', 'rows', _rows, 'non_null', n{i}, 'null_share', 1 - n{i} / _rows, 'constant', coalesce(c{i}, false))" for i, c in batch
        )
        frames.append(df.agg(*exprs).select(F.expr(f"inline(array({rows}))")))
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def removal_report(facts: DataFrame, max_null: float = 0.25) -> DataFrame:
    """Why a column goes: mostly missing, no information (one value counting NULL as one), a single known value."""
    empty = F.col("non_null") == 0
    return facts.select(
        "*",
        (F.col("null_share") >= max_null).alias("highly_null"),
        (empty | (F.col("constant") & (F.col("non_null") == F.col("rows")))).alias("low_information"),
        (empty | F.col("constant")).alias("single_value"),
    )


#: A column can only have all different values if the estimate of their number (five per cent is its deviation) is near the count.
NEARLY = 0.7


def maybe_unique(df: DataFrame, columns: Sequence[str]) -> tuple[dict[str, dict], list[str]]:
    """Counts per column, and the columns whose values are all different, exactly.

    One scan counts, takes extremes and estimates distinct values; only columns for which the estimate leaves the question open
    are grouped by value, and of those only repeated values would be shuffled further.
    """
    facts: dict[str, dict] = {}
    for start in range(0, len(columns), BATCH // 5):
        batch = columns[start : start + BATCH // 5]
        exprs = [F.count(F.lit(1)).alias("_rows")]
        for i, c in enumerate(batch):
            x = F.col(f"`{c}`")
            exprs += [F.count(x).alias(f"n{i}"), (F.min(x) == F.max(x)).alias(f"c{i}"), F.approx_count_distinct(x).alias(f"d{i}")]
            zero = (x == 0).cast("int") if isinstance(df.schema[c].dataType, T.NumericType) else F.lit(0)
            exprs.append(F.sum(zero).cast("long").alias(f"z{i}"))
        row = df.agg(*exprs).first()
        for i, c in enumerate(batch):
            facts[c] = {"rows": row["_rows"], "n": row[f"n{i}"], "constant": bool(row[f"c{i}"]), "zeros": row[f"z{i}"] or 0, "about": row[f"d{i}"]}
    open_ = [c for c in columns if facts[c]["n"] > 0 and facts[c]["about"] >= NEARLY * facts[c]["n"]]
    if not open_:
        return facts, []
    values = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("v")) for c in open_])))
    repeated = values.where("v IS NOT NULL").groupBy("column", "v").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("column").distinct()
    twice = {r["column"] for r in repeated.collect()}  # one row per column
    return facts, [c for c in open_ if c not in twice]


def low_signal(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns with one value, and columns whose values are all different."""
    facts, unique = maybe_unique(df, list(columns))
    rows = [(c, "constant") for c in columns if facts[c]["constant"]] + [(c, "identifier") for c in unique if not facts[c]["constant"]]
    return df.sparkSession.createDataFrame(rows, "column string, signal string")


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Pearson correlation of every pair of columns over the rows where both are known; NaN where one is constant.

    For as many columns as a matrix on the driver can have; ``moments.pair_correlations`` keeps the pairs in Spark.
    """
    corr = np.full((len(columns), len(columns)), np.nan)
    for row in pair_correlations(df, list(columns)).toLocalIterator():
        if row["corr"] is not None:
            corr[row["i"], row["j"]] = corr[row["j"], row["i"]] = row["corr"]
    own = column_facts(df, list(columns)).where("not constant and non_null > 0").collect()
    for name in {r["column"] for r in own}:
        i = list(columns).index(name)
        corr[i, i] = 1.0
    return corr


def strong_pairs(df: DataFrame, columns: Sequence[str], limit: float) -> np.ndarray:
    """Which pairs of columns are correlated by ``limit`` at least; only those reach the driver."""
    strong = np.zeros((len(columns), len(columns)), dtype=bool)
    with compiled_methods(df.sparkSession):
        found = pair_correlations(df, columns).where(F.abs("corr") >= limit).collect()
    for row in found:
        strong[row["i"], row["j"]] = strong[row["j"], row["i"]] = True
    return strong


def correlated_drops(corr: np.ndarray, columns: Sequence[str], limit: float = 0.95) -> list[str]:
    """Columns to drop so that no kept pair reaches ``limit``; the earlier column of a pair stays."""
    kept, dropped = [], []
    strong = np.abs(np.nan_to_num(corr)) >= limit
    for j in range(len(columns)):
        if any(strong[i, j] for i in kept):
            dropped.append(columns[j])
        else:
            kept.append(j)
    return dropped


def correlation_groups(corr: np.ndarray, columns: Sequence[str], limit: float = 0.95) -> list[list[str]]:
    """Columns connected by correlations of at least ``limit``."""
    strong = np.abs(np.nan_to_num(corr)) >= limit
    unseen, groups = set(range(len(columns))), []
    while unseen:
        stack, group = [min(unseen)], set()
        while stack:
            i = stack.pop()
            if i not in group:
                group.add(i)
                stack += [j for j in unseen if strong[i, j] and j not in group]
        unseen -= group
        if len(group) > 1:
            groups.append([columns[i] for i in sorted(group)])
    return groups


def select_features(df: DataFrame, ids: Sequence[str], max_null: float = 0.25, max_corr: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """Drop mostly missing, uninformative, constant and highly correlated columns.

    Returns the narrower frame and ``column, kept, reason`` for every feature column.
    """
    columns = [c for c in df.columns if c not in ids]
    reasons: dict[str, str] = {}
    with compiled_methods(df.sparkSession):
        facts = removal_report(column_facts(df, columns), max_null).collect()  # one row per column
    for row in facts:
        for reason in ("highly_null", "low_information", "single_value"):
            if row[reason]:
                reasons.setdefault(row["column"], reason)
    _, numeric = split_columns(df.select(*[F.col(f"`{c}`") for c in columns]), [c for c, t in df.dtypes if t.startswith(("timestamp", "date"))])
    candidates = [c for c in numeric if c not in reasons]
    if len(candidates) > 1:
        for c in correlated_drops(strong_pairs(df, candidates, max_corr), candidates, 1.0):
            reasons[c] = "highly_correlated"
    report = df.sparkSession.createDataFrame([(c, c not in reasons, reasons.get(c)) for c in columns], "column string, kept boolean, reason string")
    return df.drop(*reasons), report


def reduction_pipeline(df: DataFrame, ids: Sequence[str], k: int = 10, standardise: bool = False) -> Pipeline:
    """Index text, impute means, assemble and project on ``k`` principal components."""
    categorical, numeric = split_columns(df, ids)
    stages, inputs = [], []
    if numeric:
        for part in (numeric[i : i + FACTS] for i in range(0, len(numeric), FACTS)):  # means in aggregations that stay in compiled code
            stages.append(Imputer(inputCols=part, outputCols=[f"{c}_imputed" for c in part]))
        inputs += [f"{c}_imputed" for c in numeric]
    if categorical:
        stages.append(StringIndexer(inputCols=categorical, outputCols=[f"{c}_index" for c in categorical], handleInvalid="keep"))
        inputs += [f"{c}_index" for c in categorical]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="assembled_features"))
    source = "assembled_features"
    if standardise:
        stages.append(StandardScaler(inputCol=source, outputCol="scaled_features", withMean=True))
        source = "scaled_features"
    stages.append(PCA(k=min(k, len(inputs)), inputCol=source, outputCol="pca_features"))
    return Pipeline(stages=stages)


def numeric_frame(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Flags and numbers as double, other than the ids; time columns are left out."""
    kept = [(n, t) for n, t in df.dtypes if not t.startswith(("timestamp", "date"))]
    return df.select(*[F.col(f"`{n}`") if n in ids or t == "string" else F.col(f"`{n}`").cast("double").alias(n) for n, t in kept])


def reduce_features(df: DataFrame, ids: Sequence[str], k: int = 10, standardise: bool = False) -> tuple[DataFrame, PipelineModel]:
    """Ids and ``pca_features`` for each row, and the fitted pipeline.

    The assembled vectors are written, so that scaling and components, three scans, and the result read one column instead of
    filling and assembling all columns each time.
    """
    frame = numeric_frame(df, ids)
    stages = reduction_pipeline(frame, ids, k, standardise).getStages()
    ready = 1 + next(i for i, s in enumerate(stages) if isinstance(s, VectorAssembler))
    filled = Pipeline(stages=stages[:ready]).fit(frame)
    rows = materialise(filled.transform(frame).select(*ids, stages[ready - 1].getOutputCol()))
    projected = Pipeline(stages=stages[ready:]).fit(rows)
    return projected.transform(rows).select(*ids, "pca_features"), PipelineModel([*filled.stages, *projected.stages])
