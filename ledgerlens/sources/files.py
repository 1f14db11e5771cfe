"""Readers and writers for the lending files."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.operators.shape import conform
from ledgerlens.schemas import DECISIONS, LOANS, PURCHASES, SALES


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with header and declared types; columns are matched by position, as Spark does for a given schema."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def read_loans(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, LOANS)


def read_sales(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, SALES)


def read_orders(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, PURCHASES)


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DECISIONS).option("header", True).csv(path)


def read_untyped(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV read as text, then cast column by column."""
    return conform(spark.read.option("header", True).csv(path), schema)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_feature_frames(spark: SparkSession, path: str, drop: Sequence[str] = ("__index_level_0__",)) -> DataFrame:
    """Feature files with differing columns as one frame; missing columns are NULL, directory keys become columns."""
    return spark.read.option("mergeSchema", True).parquet(path).drop(*drop)


def local_rows(spark: SparkSession, rows: Sequence[tuple] | pd.DataFrame, schema: T.StructType | str) -> DataFrame:
    """A small driver-side table."""
    return spark.createDataFrame(rows, schema=schema)


def write_parquet(df: DataFrame, path: str, files: int | None = None) -> None:
    """Overwrite a Parquet folder, with at most ``files`` files if given; the stage before keeps its own parallelism."""
    (df.repartition(files) if files else df).write.mode("overwrite").parquet(path)


def write_by_retailer(df: DataFrame, path: str, key: str = "MAIN_SYSTEM_ID", buckets: int = 256, pieces: int | None = None, rows_per_file: int = 2_000_000) -> None:
    """Snappy Parquet in one folder per hash bucket of the retailer.

    A reader prunes to one folder per retailer without a folder for each of them. A bucket is spread over as many
    tasks and files as its largest retailer or its share of the table needs, so a heavy retailer is not written by one
    task; unless ``pieces`` is given, that takes one counting job.
    """
    if pieces is None:
        counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("all"), F.max("n").alias("most")).first()
        pieces = max(1, -(-max((counts["all"] or 0) // buckets, counts["most"] or 0) // rows_per_file))
    placed = df.withColumn("bucket", F.pmod(F.hash(key), F.lit(buckets))).withColumn("_piece", F.pmod(F.xxhash64(*df.columns), F.lit(pieces)))
    spread = placed.repartition("bucket", "_piece").drop("_piece")
    spread.write.mode("overwrite").option("compression", "snappy").partitionBy("bucket").parquet(path)


def read_retailer(spark: SparkSession, path: str, retailer: int, key: str = "MAIN_SYSTEM_ID", buckets: int = 256) -> DataFrame:
    """The rows of one retailer from a folder written by ``write_by_retailer``, reading one bucket."""
    rows = spark.read.parquet(path)
    bucket = F.pmod(F.hash(F.lit(retailer).cast(rows.schema[key].dataType)), F.lit(buckets))
    return rows.where((F.col("bucket") == bucket) & (F.col(key) == retailer)).drop("bucket")


def write_bucketed(df: DataFrame, table: str, path: str, key: str = "MAIN_SYSTEM_ID", buckets: int = 256) -> DataFrame:
    """A table whose rows are bucketed and sorted by the retailer, at ``path``.

    Windows, joins and groupings by the retailer over such tables (of one number of buckets, also several put together)
    need no exchange. Each task writes its own file per bucket, so a heavy retailer is not written by one task; reading, a
    bucket is one partition, and the rows of heavy retailers are cut into slices as always.
    """
    writer = df.write.mode("overwrite").option("path", path).format("parquet")
    writer.bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    return df.sparkSession.table(table)


def written_bytes(spark: SparkSession, path: str) -> int:
    """Size of all files of a written table, from their directory entries."""
    entries = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return int(entries.agg(F.sum("length")).first()[0] or 0)


def partitions_for(size: int, cores: int, target: int = 128 << 20) -> int:
    """Partitions of about ``target`` bytes each, in whole rounds of the cores, and no more than there are targets in the first round."""
    needed = max(1, -(-size // target))
    return needed if needed <= cores else -(-needed // cores) * cores


def sized(df: DataFrame, size: int, target: int = 128 << 20) -> DataFrame:
    """The frame in as many partitions as ``size`` bytes and the cores at hand call for."""
    return df.repartition(partitions_for(size, df.sparkSession.sparkContext.defaultParallelism, target))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header; times keep their microseconds, which the default format would cut to milliseconds."""
    writer = df.write.mode("overwrite").option("header", True)
    micros = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    writer.option("timestampNTZFormat", micros).option("timestampFormat", micros + "XXX").csv(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def to_report(df: DataFrame, limit: int = 10_000) -> pd.DataFrame:
    """An aggregated report as a pandas frame; refuses more than ``limit`` rows instead of cutting them off."""
    rows = df.limit(limit + 1).toPandas()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows; aggregate before collecting")
    return rows


def keep(df: DataFrame) -> DataFrame:
    """Persist in memory with overflow to disk."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)
