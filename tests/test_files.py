"""Sources and sinks."""

from __future__ import annotations

import glob
import os

import pytest
from conftest import assert_same
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from ledgerlens import schemas
from ledgerlens.operators.shape import harmonise
from ledgerlens.sources import files


@pytest.mark.parametrize("name,schema,reader", [("loans", schemas.LOANS, files.read_loans), ("purchases", schemas.PURCHASES, files.read_orders), ("sales", schemas.SALES, files.read_sales)])
def test_typed_csv_round_trip(spark, views, tmp_path, name, schema, reader):
    frame = views[name].select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
    files.write_csv(frame, str(tmp_path / name))
    back = reader(spark, str(tmp_path / name))
    assert back.schema == schema
    assert_same(back, frame)


def test_decisions_csv_has_declared_types(spark, tmp_path):
    decided = spark.createDataFrame([(1, True, False), (2, False, False)], "LOAN_ID long, CONSERVATIVE_DECISION boolean, AMBITIOUS_DECISION boolean")
    files.write_csv(decided, str(tmp_path / "d"))
    assert_same(files.read_decisions(spark, str(tmp_path / "d")), decided)


def test_untyped_csv_is_cast(spark, views, tmp_path):
    frame = views["purchases"].select(*schemas.PURCHASES.names)
    files.write_csv(frame, str(tmp_path / "u"))
    assert_same(files.read_untyped(spark, str(tmp_path / "u"), schemas.PURCHASES), frame)


def test_merged_schema_and_directory_key(spark, tmp_path):
    root = str(tmp_path / "frames")
    harmonise(spark.createDataFrame([(1, 2, True)], "LOAN_ID long, a int, b boolean"), ["LOAN_ID"]).write.parquet(f"{root}/MAIN_SYSTEM_ID=7")
    spark.createDataFrame([(2, 1.5, 0)], "LOAN_ID long, c double, __index_level_0__ long").write.parquet(f"{root}/MAIN_SYSTEM_ID=8")
    out = files.read_feature_frames(spark, root)
    assert set(out.columns) == {"LOAN_ID", "MAIN_SYSTEM_ID", "a", "b", "c"}
    got = {r["LOAN_ID"]: (r["MAIN_SYSTEM_ID"], r["a"], r["b"], r["c"]) for r in out.collect()}
    assert got == {1: (7, 2.0, 1, None), 2: (8, None, None, 1.5)}


def test_bounded_file_count(spark, tmp_path):
    files.write_parquet(spark.range(1000).repartition(20), str(tmp_path / "p"), files=3)
    assert len(glob.glob(str(tmp_path / "p" / "*.parquet"))) == 3
    files.write_parquet(spark.range(5), str(tmp_path / "p"))  # overwrites
    assert files.read_parquet(spark, str(tmp_path / "p")).count() == 5


def test_written_by_retailer_reads_one_bucket(spark, views, tmp_path):
    path = str(tmp_path / "r")
    files.write_by_retailer(views["purchases"], path, buckets=8, pieces=2)
    one = files.read_retailer(spark, path, 3, buckets=8)
    assert_same(one, views["purchases"].where("MAIN_SYSTEM_ID = 3"))
    assert "PartitionFilters: [isnotnull(bucket" in one._jdf.queryExecution().toString()
    assert all(".snappy." in f for f in glob.glob(f"{path}/*/*.parquet"))


def test_local_rows_and_report_limit(spark):
    assert files.local_rows(spark, [(1, "a")], "id long, s string").count() == 1
    assert len(files.to_report(spark.range(10), 10)) == 10
    with pytest.raises(ValueError, match="more than 9"):
        files.to_report(spark.range(10), 9)


def test_model_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    model = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="v")]).fit(df)
    files.save_model(model, str(tmp_path / "m"))
    files.save_model(model, str(tmp_path / "m"))  # overwrites
    assert files.load_model(str(tmp_path / "m")).transform(df).first()["v"].toArray().tolist() == [1.0, 2.0]


def test_keep_persists(spark):
    kept = files.keep(spark.range(3))
    assert kept.storageLevel.useDisk and kept.storageLevel.useMemory
    kept.unpersist()


def test_partitions_follow_size_and_cores():
    mb = 1 << 20
    assert [files.partitions_for(n * mb, 8) for n in (0, 1, 128, 129, 1000, 1100, 10_000)] == [1, 1, 1, 2, 8, 16, 80]


def test_sized_by_what_was_written(spark, tmp_path):
    df = spark.range(50_000).select("id", F.rand(1).alias("x"))
    for rows, path in ((50_000, "a"), (500, "b")):
        df.limit(rows).write.parquet(str(tmp_path / path))
    sizes = [files.written_bytes(spark, str(tmp_path / p)) for p in "ab"]
    assert sizes[0] == sum(f.stat().st_size for f in (tmp_path / "a").iterdir() if not f.name.startswith((".", "_"))) > sizes[1] > 0
    cores = spark.sparkContext.defaultParallelism
    chosen = [files.sized(df, n, 64 << 10).rdd.getNumPartitions() for n in sizes]
    assert chosen == [files.partitions_for(n, cores, 64 << 10) for n in sizes] and chosen[0] >= cores > chosen[1]


def test_temporary_tables_are_deleted(spark, tmp_path):
    from ledgerlens import session

    folder = session.ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    with session.temporary_tables():
        inner = session.materialise(spark.range(5))
        with session.temporary_tables():
            session.materialise(spark.range(7))
        assert inner.count() == 5 and len(set(os.listdir(folder)) - before) == 1
    assert set(os.listdir(folder)) == before
    assert session.materialise(spark.range(3)).count() == 3  # outside nothing is deleted
