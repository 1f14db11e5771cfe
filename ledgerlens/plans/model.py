"""Training, scoring and evaluation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.base import Estimator
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.scalar import flag
from ledgerlens.operators import reduction
from ledgerlens.operators.skew import measure, running
from ledgerlens.session import materialise

#: Fits of a search that run at the same time.
AT_ONCE = 4


def balance_weights(df: DataFrame, label: str = "label", name: str = "weight") -> DataFrame:
    """Weights that give both classes the same total; the weights of two classes come from one aggregation."""
    n = F.count(F.lit(1))
    facts = df.agg(F.struct(n.alias("n"), F.sum(flag(F.col(label) == 1)).alias("p")).alias("f")).select("f").scalar()
    share = F.when(F.col(label) == 1, facts["p"]).otherwise(facts["n"] - facts["p"])
    return df.withColumn(name, F.coalesce(F.try_divide(facts["n"].cast("double"), 2 * share.cast("double")), F.lit(1.0)))


def fit_classifier(train: DataFrame, features: str = "features", label: str = "label", depth: int = 10, trees: int = 10, seed: int = 7) -> Model:
    """Boosted trees with class balance; rows with ``is_validation`` stop the boosting early."""
    booster = GBTClassifier(
        featuresCol=features,
        labelCol=label,
        weightCol="weight",
        validationIndicatorCol="is_validation",
        maxDepth=depth,
        maxIter=trees,
        seed=seed,
    )
    return booster.fit(balance_weights(train, label))


def area_under_pr(scored: DataFrame, label: str = "label", score: str = "rawPrediction") -> float:
    """Area under the precision-recall curve of the score."""
    return BinaryClassificationEvaluator(labelCol=label, rawPredictionCol=score, metricName="areaUnderPR").evaluate(scored)


def f_beta(scored: DataFrame, beta: float, label: str = "label", prediction: str = "prediction") -> float:
    """F-beta of the positive class by the library's evaluator."""
    judge = MulticlassClassificationEvaluator(labelCol=label, predictionCol=prediction, metricName="fMeasureByLabel", metricLabel=1.0, beta=beta)
    return judge.evaluate(scored)


def classification_metrics(scored: DataFrame, label: Column, predicted: Column, betas: Sequence[float] = (2.0, 1.0, 0.5)) -> DataFrame:
    """One row: confusion counts, precision, recall and F-beta of the positive class, from one aggregation."""
    counts = scored.agg(
        F.sum(flag(label & predicted)).alias("tp"),
        F.sum(flag(~label & predicted)).alias("fp"),
        F.sum(flag(label & ~predicted)).alias("fn"),
        F.sum(flag(~label & ~predicted)).alias("tn"),
    )
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    scores = [
        F.coalesce(F.try_divide((1 + b * b) * tp, (1 + b * b) * tp + b * b * fn + fp), F.lit(0.0)).alias(f"f_{str(b).replace('.', '_')}") for b in betas
    ]
    return counts.select("*", F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"), *scores)


def regression_metrics(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: MAE, MSE, RMSE and R2."""
    y, error = F.col(label), F.col(label) - F.col(prediction)
    mse = F.avg(error * error)
    return scored.where(y.isNotNull() & F.col(prediction).isNotNull()).agg(
        F.avg(F.abs(error)).alias("mae"), mse.alias("mse"), F.sqrt(mse).alias("rmse"), (1 - F.try_divide(mse, F.var_pop(y))).alias("r2")
    )


def candidates(features: str = "features", label: str = "label", seed: int = 7) -> dict[str, Estimator]:
    """The regressors that are compared."""
    common = {"featuresCol": features, "labelCol": label}
    return {
        "random_forest": RandomForestRegressor(numTrees=20, maxDepth=8, seed=seed, **common),
        "boosted_trees": GBTRegressor(maxIter=10, maxDepth=4, seed=seed, **common),
        "linear": LinearRegression(regParam=0.01, **common),
    }


def grid(features: str = "features", label: str = "label", seed: int = 7) -> dict[str, Estimator]:
    """The regressors with two settings each."""
    common = {"featuresCol": features, "labelCol": label}
    out: dict[str, Estimator] = {}
    for depth in (5, 8):
        out[f"random_forest_{depth}"] = RandomForestRegressor(numTrees=20, maxDepth=depth, seed=seed, **common)
    for depth in (2, 4):
        out[f"boosted_trees_{depth}"] = GBTRegressor(maxIter=10, maxDepth=depth, seed=seed, **common)
    for penalty in (0.0, 0.01):
        out[f"linear_{penalty}"] = LinearRegression(regParam=penalty, **common)
    return out


def average_precision(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Step-wise area under the precision-recall curve: precision at every distinct score, weighted by the recall it adds.

    Rows are folded to one per distinct score first; the curve is a running total over those.
    """
    per_score = scored.where(F.col(score).isNotNull()).groupBy((-F.col(score)).alias("_at")).agg(
        F.sum(flag(F.col(label) == 1)).alias("_p"), F.count(F.lit(1)).alias("_n")
    )
    placed = running(per_score, [], "_at", {"_tp": ("sum", F.col("_p")), "_all": ("sum", F.col("_n"))}, measure(per_score, [], "_at", hot_rows=0))
    steps = placed.agg(F.sum(F.col("_tp") / F.col("_all") * F.col("_p")).alias("a"), F.sum("_p").alias("p"))
    return steps.select(F.try_divide("a", F.col("p").cast("double")).alias("average_precision"))


def reduced_folds(frame: DataFrame, ids: Sequence[str], aside: Sequence[str], folds: int, k: int = 10) -> list[DataFrame]:
    """For every fold f = 1 .. ``folds`` the rows up to it as ids, the columns ``aside`` and ``features``: selection, filling, scaling and
    components are learned from the folds before f only, so nothing of fold f or later is in them."""
    learned = reduction.fit_before(frame.drop(*[c for c in aside if c != "fold"]), ids, "fold", folds, k)
    rows = materialise(reduction.apply_all(learned, frame, "fold", *aside))
    return [rows.where(F.col("fold") <= f).select(*ids, *aside, F.col(f"features{f}").alias("features")) for f in range(1, folds + 1)]


def forward_search(
    folded: DataFrame | Sequence[DataFrame], grid: dict[str, Estimator], label: str = "label", folds: int = 5, whole: DataFrame | None = None
) -> tuple[Model, DataFrame]:
    """Fit each candidate on all folds before fold f and score it on fold f, f = 1 .. ``folds``; refit the best on all.

    ``folded`` has ``fold`` in time order (see ``split.time_folds``), so no model sees rows later than those it is scored on;
    or it is the list of ``reduced_folds``, whose features have not seen them either, with ``whole`` to refit on. The
    fits run over candidates and folds, ``AT_ONCE`` at a time because a fit is a chain of many short jobs; rows stay in Spark, in
    tables that every fit reads again.
    """
    if isinstance(folded, DataFrame):
        whole = materialise(folded)
        folded = [whole] * folds

    def scored(name: str, f: int) -> tuple:
        model = grid[name].fit(folded[f - 1].where(F.col("fold") < f))
        return name, f, *regression_metrics(model.transform(folded[f - 1].where(F.col("fold") == f)), label).first()

    spark = folded[0].sparkSession
    fits = [inheritable_thread_target(spark)(partial(scored, name, f)) for name in grid for f in range(1, len(folded) + 1)]
    with ThreadPool(AT_ONCE) as pool:
        results = pool.map(lambda fit: fit(), fits, 1)
    scores = spark.createDataFrame(results, "model string, fold int, mae double, mse double, rmse double, r2 double")
    means = {n: sum(r[5] if r[5] is not None else float("-inf") for r in results if r[0] == n) / len(folded) for n in grid}
    best = max(means, key=means.get)
    return grid[best].fit(whole if whole is not None else folded[-1]), scores.withColumn("best", F.col("model") == best)
