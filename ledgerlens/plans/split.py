"""Time-ordered train, validation and test splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.shape import vector_columns
from ledgerlens.operators.temporal import percent_rank_scaled

# Per class, where validation and test begin on the percent rank of time.
VALIDATION_FROM = {1: 0.5, 0: 0.6}
TEST_FROM = {1: 0.7, 0: 0.8}


def _reached(label: Column, cuts: dict[int, float]) -> Column:
    place = F.col("stratified_split")
    condition = F.lit(False)
    for value, cut in cuts.items():
        condition = condition | ((label == value) & (place >= cut))
    return condition


def stratified_time_split(
    df: DataFrame, order: str = "LOAN_ID", label: str = "label", valid_from: dict[int, float] = VALIDATION_FROM, test_from: dict[int, float] = TEST_FROM
) -> DataFrame:
    """Add ``stratified_split`` (percent rank of ``order``), ``split`` and ``is_validation``.

    Each class has its own cuts; ranges are half-open, so every row belongs to exactly one part. Rows whose label is
    neither class are left out: use ``time_split`` for a continuous label.
    """
    y = F.col(label)
    ranked = percent_rank_scaled(df, order).where(y.isin([*test_from]))
    part = F.when(_reached(y, test_from), "test").when(_reached(y, valid_from), "validation").otherwise("train")
    return ranked.withColumn("split", part).withColumn("is_validation", F.col("split") == "validation")


def time_split(df: DataFrame, order: str = "LOAN_ID", cut: float = 0.8) -> DataFrame:
    """One cut on the percent rank of ``order``."""
    ranked = percent_rank_scaled(df, order)
    return ranked.withColumn("split", F.when(F.col("stratified_split") >= cut, "test").otherwise("train"))


def time_folds(df: DataFrame, order: str = "LOAN_ID", folds: int = 5) -> DataFrame:
    """Add ``fold`` 0..folds in time order: fold f is validated by a model fitted on all folds before it."""
    ranked = percent_rank_scaled(df, order)
    return ranked.withColumn("fold", F.least(F.floor(F.col("stratified_split") * (folds + 1)), F.lit(folds)).cast("int"))


def split_audit(split: DataFrame, label: str = "label") -> DataFrame:
    """Rows per class and part."""
    return split.groupBy(label).pivot("split", ["train", "validation", "test"]).agg(F.count(F.lit(1))).fillna(0)


def train_rows(split: DataFrame) -> DataFrame:
    """Everything before the test cut, with the validation flag."""
    return split.where("split <> 'test'")


def test_rows(split: DataFrame) -> DataFrame:
    return split.where("split = 'test'")


def flat_layout(split: DataFrame, vector: str, width: int) -> DataFrame:
    """Ids, label and one column per vector entry."""
    return vector_columns(split.select("LOAN_ID", "MAIN_SYSTEM_ID", "label", vector), vector, width)


def write_layouts(parted: DataFrame, root: str, vector: str, width: int, files: int | None = None) -> None:
    """Train and test parts as ``{root}/{train,test}-{vector,flat}``; the split is computed once and read four times."""
    from ledgerlens.session import materialise
    from ledgerlens.sources.files import write_parquet

    parted = materialise(parted)
    for name, part in (("train", train_rows(parted)), ("test", test_rows(parted))):
        write_parquet(part, f"{root}/{name}-vector", files)
        write_parquet(flat_layout(part, vector, width), f"{root}/{name}-flat", files)
