"""Catalogue of named queries over the driver tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    build: Callable[[SparkSession, str], DataFrame]
    operators: tuple[str, ...]
    sql: str | None


CATALOG: dict[str, Query] = {}


def query(name: str, operators: str, sql: str | None = None):
    """Register a query builder under ``name`` with the operators it exercises."""
    def add(build: Callable[[SparkSession, str], DataFrame]):
        if name in CATALOG:
            raise ValueError(f"query {name} registered twice")
        CATALOG[name] = Query(build, tuple(operators.split()), sql)
        return build
    return add
