"""Vectors as the searches take them: valid ones only, equal ones once, and their results by row again."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from weftline.plans.lineage import materialize


def valid_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vec array<double>): finite vectors of the commonest length, with an id."""
    vec = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec"))
    fine = F.forall("vec", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0) & fine)
    lengths = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("vec") == (lengths[0]["n"] if lengths else 0))


def vector_classes(rows: DataFrame, keep: int) -> DataFrame:
    """Equal vectors as one row: (class_id, first, ids, vec) with the ``keep`` smallest ids.

    Ties go to smaller ids, so of equal vectors no others can be among the nearest. Ranks are
    limited before the shuffle, so a vector that many rows share stays cheap.
    """
    rank = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    few = rows.distinct().withColumn("_rank", rank).where(F.col("_rank") <= keep)
    classes = few.groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    return classes.select(F.xxhash64("vec").alias("class_id"), F.col("ids")[0].alias("first"), "ids", "vec")


def query_members(rows: DataFrame, asked: Column) -> DataFrame:
    """(query_id, class_id, vec) of the asked rows."""
    return rows.where(asked).select(F.col("vec_id").alias("query_id"), F.xxhash64("vec").alias("class_id"), "vec").distinct()


def ranked_results(found: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) from (query_class, score, first, ids): the best ``k`` rows of each query but its own.

    ``found`` holds each class once per query class, or more often with the same score.
    """
    best = found.dropDuplicates(["query_class", "first", "class_id"])
    order = Window.partitionBy("query_class").orderBy(F.desc("score"), "first")
    best = best.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k + 1)
    # a class of queries gets its k + 1 best ids once; its members then only leave out their own
    ids = best.select("query_class", "score", F.explode("ids").alias("vec_id"))
    place = Window.partitionBy("query_class").orderBy(F.desc("score"), "vec_id")
    ids = materialize(ids.withColumn("_rank", F.row_number().over(place)).where(F.col("_rank") <= k + 1), "vector-best")
    asked = materialize(members.select("query_id", F.col("class_id").alias("query_class")), "vector-queries")
    rows = asked.join(ids.drop("_rank"), "query_class").where("vec_id != query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def matrix(values) -> np.ndarray:
    """Rows of lists as a matrix."""
    return np.array([np.asarray(v, dtype=np.float64) for v in values])
