"""The corpus pipeline: quality rules, near-duplicate removal, secret masking, mixing and packing over `documents`.

Each stage takes all documents that its predecessor kept. All but the last return the columns of `documents`; the last returns
one row per packed piece. `run` writes what a stage keeps to the shared folder and reads it again, so a lost executor costs
one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm import host_rules, jaccard_join, mixing, packing, secret_links
from ledgerlens.llm.frames import materialise, table
from ledgerlens.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail their own rules, or whose host is rejected, go."""
    return host_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at a similarity of 0.8 over five words, the smallest doc_id of each component stays."""
    return jaccard_join.one_of_each(docs, size=5, percent=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found is masked in the text."""
    return secret_links.masked(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document is there as often as the mix takes it."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 4,096 tokens. The executors still hold what earlier stages left, so
    the workers take small slices and keep few chunks."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), slice_bytes=1 << 17, kept=20_000)


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", near_duplicates), ("secret scans", secrets), ("mixing", mix), ("packing", pack)]

#: Components, tokens and bins cannot be stated in SQL; the tests compare every stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
