"""Connected components of a link table, as a loop of DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weftline.plans.lineage import cut


def _smallest(pairs: DataFrame) -> DataFrame:
    """(u, v) -> smallest of u and its v, per u."""
    return pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def _pull(pairs: DataFrame, only_larger: bool) -> DataFrame:
    """Hang the neighbours of each u (and u itself) on the smallest of them."""
    joined = pairs.join(_smallest(pairs), "u")
    if only_larger:
        return joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
        joined.select(F.col("u").alias("a"), F.col("m").alias("b"))
    )


def components(links: DataFrame) -> DataFrame:
    """Of links (a, b): every node of a link with the smallest node it reaches, as (node, component).

    Large-star and small-star steps by turns: each node hangs its larger
    neighbours, then its smaller ones, on its smallest neighbour, until only stars
    are left. Links are rows throughout, sums per node are partial before the shuffle
    (a hub is a skewed join that Spark splits), every round ends in a reliable checkpoint,
    and only a count and a checksum come to the driver.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    edges = cut(edges)
    state = _state(edges)
    while state[0]:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        large = _pull(both, only_larger=True).distinct()
        small = _pull(large.select(F.col("a").alias("u"), F.col("b").alias("v")), only_larger=False)
        edges = cut(small.where("a != b").distinct())
        now = _state(edges)
        if now == state:
            break
        state = now
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)")),
        F.bit_xor(F.xxhash64("a", "b")),
    ).first()
    return tuple(row)
