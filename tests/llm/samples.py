"""Frames and awkward texts that the tests of this folder share."""

from __future__ import annotations

import os
import pathlib
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parent.parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept string, row string, id long, target string"


@pytest.fixture
def docs_of(spark):
    """Documents from (doc_id, text[, source]) with further columns whose names the operators use inside."""

    def make(rows, parts=3):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), 7, "k", "r", 5, "t") for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(parts)

    return make


@pytest.fixture
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


#: Awkward texts: missing, empty, white space, marks only, no space at all, accents, one that repeats, a very long one.
AWKWARD = [None, "", "   \n\t ", "...", "x" * 3000, "é́ ß İ 日本語 ✓", "a b c d e " * 40, " ".join(f"w{i}" for i in range(40_000))]
