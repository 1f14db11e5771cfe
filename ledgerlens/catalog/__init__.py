"""Every operator as a query over the benchmark tables."""

from __future__ import annotations

import importlib

from ledgerlens.catalog.registry import ORACLE, QUERIES

MODULES = ["lending", "tables", "whole_tables", "testing", "synthesis", "prefix_queries", "recipe_queries", "history_queries", "series_queries", "modelling", "storage"]


def load_catalog():
    for name in MODULES:
        importlib.import_module(f"ledgerlens.catalog.{name}")
    return dict(QUERIES), dict(ORACLE)
