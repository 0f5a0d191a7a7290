"""Collects the registered queries of all families."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from adinsight.plans import registry

FAMILIES = ("trend_queries", "keyword_queries", "term_queries", "ad_queries", "expression_queries", "source_queries")

for _family in FAMILIES:
    importlib.import_module(f"adinsight.plans.{_family}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return registry.callables()


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)
