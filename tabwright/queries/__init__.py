"""Registered queries over the shared test tables, each with its SQL twin where one exists."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

MODULES = ("tables", "cleaning", "sampling", "metrics", "clusters", "reports", "catalog", "models")


def load() -> tuple[dict[str, Query], dict[str, str]]:
    for m in MODULES:
        import_module(f"tabwright.queries.{m}")
    from tabwright.queries.registry import QUERIES, SQL

    return dict(QUERIES), dict(SQL)
