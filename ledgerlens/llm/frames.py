"""Small helpers that several operators share."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens import session
from ledgerlens.session import materialise

#: A word is a run of anything but space and the characters 0x09-0x0D.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: A table of at most so many narrow rows may be broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 100_000
#: A key with at least this share of the rows is heavy. There are at most 1 / HEAVY_SHARE of them, which bounds their broadcast.
HEAVY_SHARE = 1e-3
#: Bytes of one Arrow batch between an executor and its Python workers, where whole texts go over. Spark's own bound is rows first,
#: and the executor and the worker both hold a batch more than once.
BATCH_BYTES = 2 << 20

__all__ = ["BROADCAST_ROWS", "HEAVY_SHARE", "SPACE", "WORD", "attach", "let", "materialise", "materialise_lean", "packed", "release", "small_batches", "table", "whole_text"]


@contextmanager
def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> Iterator[None]:
    """Jobs inside pass Arrow batches of about `most` bytes (or one longer row); the session's setting is put back at the end."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def materialise_lean(df: DataFrame) -> DataFrame:
    """`materialise` for frames whose Python functions read or return long rows."""
    with small_batches(df.sparkSession):
        return session.materialise(df)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """The whole text; a missing one is empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def packed(df: DataFrame) -> Column:
    """All columns of a frame as one struct, so that names added beside it cannot clash."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of phases whose results have been written; it finds them when garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def let(value: Column, body) -> Column:
    """body(value), with `value` computed once although the body names it often (also inside further lambdas)."""
    return F.transform(F.array(value), body)[0]


def attach(rows: DataFrame, facts: DataFrame, key: str, count: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """Left join of `rows` with `facts` (one row per non-null key, `count` = how many of `rows` have it).

    Up to `most` facts are broadcast. Beyond that the heavy keys are (at most 1 / HEAVY_SHARE of them), and the rows of all
    others, which are spread evenly, meet their facts by shuffle. `rows` is read twice then, so pass a written table.
    """
    if facts.count() <= most:
        return rows.join(F.broadcast(facts), key, "left")
    total = facts.agg(F.sum(count)).first()[0] or 0
    heavy = facts.where(F.col(count) >= HEAVY_SHARE * total)
    known = F.broadcast(heavy.select(key))
    hot = rows.join(known, key, "left_semi").join(F.broadcast(heavy), key, "left")
    rest = rows.join(known, key, "left_anti").join(facts.where(F.col(count) < HEAVY_SHARE * total), key, "left")
    return hot.unionByName(rest)
