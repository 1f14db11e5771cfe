"""Projections, filters, labels and row reshaping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.scalar import flag
from ledgerlens.schemas import AFTER_THE_FACT, LOW_SIGNAL


def drop_leaky(loans: DataFrame) -> DataFrame:
    """Remove columns without signal and columns known only after the loan was granted."""
    return loans.drop(*LOW_SIGNAL, *AFTER_THE_FACT)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast the columns named in ``schema`` and keep only those, in its order."""
    kinds = dict(df.dtypes)

    def cast(field: T.StructField) -> Column:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.TimestampNTZType) and kinds[field.name] == "string":
            column = F.to_timestamp_ntz(column)
        return column.cast(field.dataType).alias(field.name)

    return df.select(*[cast(field) for field in schema.fields])


def harmonise(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Numbers to double and booleans to int, except the id columns, so files of different origin merge."""

    def unify(name: str, kind: T.DataType) -> Column:
        column = F.col(f"`{name}`")
        if name in ids:
            return column
        if isinstance(kind, T.NumericType):
            return column.cast("double").alias(name)
        return column.cast("int").alias(name) if isinstance(kind, T.BooleanType) else column

    return df.select(*[unify(field.name, field.dataType) for field in df.schema.fields])


# Replacements that make feature names valid SQL identifiers.
NAME_REPLACEMENTS = {"(": "__", ")": "__", ",": "_", ".": "_", " % ": "_mod_", " / ": "_div_", " * ": "_mul_"}


def sanitise_name(name: str) -> str:
    for old, new in NAME_REPLACEMENTS.items():
        name = name.replace(old, new)
    return name


def sanitise_names(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{name}`").alias(sanitise_name(name)) for name in df.columns])


def split_columns(df: DataFrame, ids: Sequence[str]) -> tuple[list[str], list[str]]:
    """(categorical, numeric) feature columns; other types are an error."""
    categorical = [n for n, t in df.dtypes if t == "string" and n not in ids]
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.NumericType, T.BooleanType)) and f.name not in ids]
    left_over = set(df.columns) - set(categorical) - set(numeric) - set(ids)
    if left_over:
        raise ValueError(f"neither categorical nor numeric: {sorted(left_over)}")
    return categorical, numeric


def used_loans(loans: DataFrame) -> DataFrame:
    """Loans whose funds were used at all."""
    return loans.where("SPENT > 0")


def not_paid(status: str | Column = "PAYMENT_STATUS") -> Column:
    """True unless the status says paid; a missing status counts as not paid."""
    value = F.col(status) if isinstance(status, str) else status
    return ~F.lower(value).eqNullSafe("paid")


def targets(loans: DataFrame) -> DataFrame:
    """The possible prediction targets of each used loan."""
    return used_loans(loans).select(
        "LOAN_ID",
        "SPENT",
        flag(not_paid()).alias("LOAN_NOT_PAID"),
        flag(F.col("FIRST_TRAIL_DELAYS") > 0).alias("FIRST_TRAIL_DELAY"),
    )


def make_label(loans: DataFrame, target: str) -> DataFrame:
    """``LOAN_ID, label`` for the target named in any letter case."""
    offered = targets(loans)
    names = {c.lower(): c for c in offered.columns if c != "LOAN_ID"}
    if target.lower() not in names:
        raise ValueError(f"unknown target {target!r}; one of {sorted(names.values())}")
    return offered.select("LOAN_ID", F.col(names[target.lower()]).alias("label"))


def first_collection_default(loans: DataFrame, name: str = "LABEL") -> DataFrame:
    """Flag loans that were not repaid in full at the first collection."""
    return loans.withColumn(name, not_paid() | F.coalesce(F.col("FIRST_TRIAL_BALANCE") < 0, F.lit(False)))


def missed_first_collection(loans: DataFrame, yet_paid: bool = False) -> DataFrame:
    missed = loans.where("FIRST_TRIAL_BALANCE < 0")
    return missed.where("PAYMENT_STATUS = 'Paid'") if yet_paid else missed


def spend_ratio() -> Column:
    return F.try_divide(F.col("SPENT"), F.col("LOAN_AMOUNT"))


def overspent(loans: DataFrame) -> DataFrame:
    return loans.where(spend_ratio() > 1).select("MAIN_SYSTEM_ID", "LOAN_ID", "LOAN_AMOUNT", "SPENT")


def first_per_key(df: DataFrame, key: str, order: Sequence[str], k: int) -> DataFrame:
    """First ``k`` rows of each key. The rank limit is applied before the shuffle, so a heavy key sends ``k`` rows per task."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_rn", place).where(F.col("_rn") <= k).drop("_rn")


def transpose(df: DataFrame, ident: str, columns: Sequence[str]) -> DataFrame:
    """``(ident, attribute, value)`` with one row per listed column, values as text."""
    pairs = F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(ident, F.explode(pairs).alias("_p")).select(ident, "_p.attribute", "_p.value")


def first_row(df: DataFrame, key: str) -> DataFrame:
    """The row with the smallest key, columns in name order."""
    return df.select(*sorted(df.columns)).orderBy(key).limit(1)


def vector_columns(df: DataFrame, vector: str, width: int, prefix: str = "principal_component_") -> DataFrame:
    """Replace a vector column by ``width`` double columns."""
    from pyspark.ml.functions import vector_to_array

    rest = [c for c in df.columns if c != vector]
    values = df.select(*rest, vector_to_array(vector).alias("_v"))
    return values.select(*rest, *[F.col("_v")[i].alias(f"{prefix}{i}") for i in range(width)])


def vector_size(vector: str) -> Column:
    """Length of a vector column."""
    from pyspark.ml.functions import vector_to_array

    return F.size(vector_to_array(vector))
