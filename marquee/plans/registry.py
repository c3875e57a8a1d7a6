"""Every registered query of the catalogue library with its SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marquee.plans.fixtures import view, with_views

MODULES = ("selection", "catalog", "reports", "jobs", "duplicates", "streams")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Views:
    """Attribute access to the views over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function from ``Views`` to a DataFrame, with SQL for the same rows."""

    def put(f: Callable[[Views], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = with_views(sql)
        return f

    return put


def load() -> None:
    """Import the modules that register queries."""
    for module in MODULES:
        importlib.import_module(f"marquee.plans.{module}")
