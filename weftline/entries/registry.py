"""Collects the queries and their checking SQL, and shares prepared tables within a session."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_PREPARED: dict[tuple, object] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with its checking SQL."""

    def register(function):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def prepared(function):
    """Keep what ``function(spark, sf_dir)`` wrote, as an index is built once and searched often."""

    def lookup(spark: SparkSession, sf_dir: str):
        key = (function.__name__, spark.sparkContext.applicationId, sf_dir)
        if key not in _PREPARED:
            _PREPARED[key] = function(spark, sf_dir)
        return _PREPARED[key]

    lookup.fresh = function
    return lookup
