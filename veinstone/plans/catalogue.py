"""All queries of the core with their SQL twins, collected from the modules of this subpackage."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("lexical", "governance", "similarity", "structure", "graphs", "feeds", "evidence", "understanding", "trees", "references", "relations", "indexing", "retrieval", "knowledge", "review", "catalog", "questions", "connectors", "profiles")


def _modules():
    return [importlib.import_module(f"veinstone.plans.{m}") for m in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _modules() for k, (f, _) in m.CATALOGUE.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for m in _modules() for k, (_, sql) in m.CATALOGUE.items() if sql}
