"""Session defaults. A cluster keeps whatever it has already configured."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = 8, memory: str = "8g", name: str = "ledgerlens") -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the folder the cluster names; fall back to a local one only where none is set and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current and (not named or named.rstrip("/") in current):
        return current
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = os.path.join(tempfile.gettempdir(), "ledgerlens-checkpoints")
    spark.sparkContext.setCheckpointDir(named)
    return spark.sparkContext.getCheckpointDir() or named


_SCOPES: list[list[str]] = []


@contextmanager
def temporary_tables() -> Iterator[None]:
    """Deletes, at its end, the tables that ``materialise`` writes inside it; write or collect results before that.

    ``with temporary_tables(): report(spark).write.parquet(...)``. Folders that Arrow's file systems cannot open are left.
    """
    paths: list[str] = []
    _SCOPES.append(paths)
    try:
        yield
    finally:
        _SCOPES.remove(paths)
        for path in paths:
            _delete(path)


def _delete(path: str) -> None:
    import pyarrow as pa
    from pyarrow import fs

    try:
        files, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        if files.get_file_info(name).type == fs.FileType.Directory:
            files.delete_dir(name)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
        return


#: Java leaves methods with more bytes of code to its interpreter. Spark's own limit, beyond which it does not join the steps of a
#: stage into one method, is 65,535, so that a projection of a hundred columns may run many times slower than its parts.
COMPILED = 8000


@contextmanager
def compiled_methods(spark: SparkSession) -> Iterator[None]:
    """Jobs inside run no generated method that Java would not compile; the session's setting is put back at the end."""
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), COMPILED)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialise(df: DataFrame) -> DataFrame:
    """Write a frame as Parquet to the shared checkpoint folder and continue from the written table.

    Later passes read only the columns they need, and a lost executor costs a re-read instead of the whole lineage.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/ledgerlens-{uuid.uuid4().hex}"
    with compiled_methods(spark):
        df.write.parquet(path)
    for paths in _SCOPES:
        paths.append(path)
    return spark.read.parquet(path)
