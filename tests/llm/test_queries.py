"""Registered queries, the pipeline and what surrounds them."""

from __future__ import annotations

import importlib
import subprocess
import sys

import duckdb
import pytest
from samples import ROOT, SF

import corpus_pipeline
from ledgerlens.llm import host_rules, jaccard_join, mixing, queries
from tools import check


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in check.TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    got = check.ordered(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(queries.ORACLE[name])
    want = check.ordered([d[0] for d in cur.description], cur.fetchall())
    assert check.compare(got, want) == "ok"


COLUMNS = {
    "op1_permutation_index": {"query_id", "rank", "vec_id", "score"},
    "op3_pack": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
    "op4_token_counts": {"doc_id", "n_words", "n_tokens"},
    "op10_toxicity": {"doc_id", "held_out", "score", "predicted"},
}


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_query_without_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert set(df.columns) == COLUMNS[name] and df.count() > 0


def test_every_operator_is_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))


def test_stages_return_documents_and_their_decisions_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    at, kept = docs, [{r.doc_id for r in docs.select("doc_id").collect()}]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, at, SF).persist()
        assert after.columns == names
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        assert ids <= kept[-1]
        kept.append(ids)
        at = after
    good = {r.doc_id for r in host_rules.host_quality(docs).where("kept").collect()}
    assert kept[1] == good
    after_rules = docs.where(docs.doc_id.isin(sorted(good)))
    assert kept[2] == {r.doc_id for r in jaccard_join.near_duplicates(after_rules).collect() if r.doc_id == r.component_id}
    assert kept[3] == kept[2] and len(kept[2]) < len(kept[0])
    masked = corpus_pipeline.secrets(spark, after_rules, SF)
    assert kept[4] == {r.doc_id for r in mixing.mix_plan(masked.where(masked.doc_id.isin(sorted(kept[2])))).where("copies > 0").collect()}
    packed = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == kept[4]


def test_everything_else_works_without_the_subpackage(tmp_path):
    for p in ("__spark_entry__.py", "ledgerlens"):
        (tmp_path / p).symlink_to(ROOT / p) if p.endswith(".py") else None
    package = tmp_path / "ledgerlens"
    package.mkdir()
    for p in (ROOT / "ledgerlens").iterdir():
        if p.name != "llm":
            (package / p.name).symlink_to(p)
    entry = tmp_path / "entry.py"
    entry.write_text((ROOT / "__spark_entry__.py").read_text())
    code = "import entry; q = entry.queries(); assert q and 'pipeline' not in q and not any(n.startswith('op') for n in q); assert entry.oracle_sql()"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin", "PYTHONPATH": str(tmp_path)})
    assert done.returncode == 0, done.stderr


def test_the_rest_does_not_import_the_subpackage():
    for path in (ROOT / "ledgerlens").rglob("*.py"):
        if "llm" not in path.parts:
            assert "ledgerlens.llm" not in path.read_text()
    assert importlib.import_module("__spark_entry__").queries().keys() >= {"pipeline", "op1_permutation_index"}
