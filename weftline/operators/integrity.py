"""Checks and effects of the store's keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def null_violations(rows: DataFrame, key: list[str], required: list[str]) -> DataFrame:
    """One row per required column that is null: the key and the column's name."""
    broken = F.filter(
        F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]), lambda c: c.isNotNull()
    )
    return rows.select(*key, F.explode(broken).alias("column_name"))


def duplicate_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def orphans(children: DataFrame, column: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose parent does not exist."""
    return children.join(parents.select(F.col(parent_key).alias(column)), column, "left_anti")


def cascade_delete(children: DataFrame, column: str, deleted: DataFrame) -> DataFrame:
    """Child rows that stay when the given keys are deleted."""
    return children.join(deleted.select(column), column, "left_anti")


def refused_deletes(wanted: DataFrame, column: str, *children: DataFrame) -> DataFrame:
    """Keys that may not be deleted because a child row refers to them."""
    used = children[0].select(column)
    for more in children[1:]:
        used = used.unionByName(more.select(column))
    return wanted.join(used, column, "left_semi")


def carry_key_updates(children: DataFrame, column: str, changes: DataFrame) -> DataFrame:
    """Child rows with their reference changed from ``old`` to ``new``."""
    moved = changes.select(F.col("old").alias(column), "new")
    return (
        children.join(moved, column, "left")
        .withColumn(column, F.coalesce("new", column))
        .drop("new")
        .select(*children.columns)
    )
