"""Exact top-k by integer inner product: a ball tree per shard, searched by branch and bound.

Vectors are dealt by hash into shards of bounded size; each task builds the ball tree of its shard and answers
a block of queries. A node's bound is the inner product with its centre plus the query's length times its radius;
nodes are visited by falling bound, and left alone once the bound is under the k-th score known so far. That
score starts from the longest vectors of the whole table, which are scored first and shared with all shards,
and rises as leaves are read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from weftline.llm.common import bound_batches
from weftline.llm.vectors import query_members, ranked_results, valid_vectors, vector_classes
from weftline.plans.lineage import materialize

SCALE = 1024
SHARD_ROWS, LEAF_ROWS = 8192, 64
BLOCK_QUERIES = 4096  # queries that go to the shards at a time
SEEDS = 1024  # longest vectors, for a first k-th score


def integers(values) -> np.ndarray:
    """Integer rows in a type in which inner products are exact: doubles where they stay under 2^53."""
    rows = np.array([np.asarray(v, dtype=np.int64) for v in values])
    peak = int(np.abs(rows).max()) if rows.size else 0
    return rows.astype(np.float64) if peak * peak * rows.shape[-1] < 1 << 53 else rows


def products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    if rows.dtype != query.dtype:
        rows, query = rows.astype(np.int64), query.astype(np.int64)
    return (rows @ query).astype(np.int64)


class BallTree:
    """Nodes halve their rows along the line between two far points; each knows its centre and radius."""

    def __init__(self, rows: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.rows = rows
        floats = rows.astype(np.float64)
        self.centres, self.radii, self.children, self.members = [], [], [], []
        todo = [(np.arange(len(rows)), -1)]
        while todo:
            own, parent = todo.pop()
            node = len(self.centres)
            if parent >= 0:
                self.children[parent].append(node)
            centre = floats[own].mean(axis=0)
            apart = np.sqrt(((floats[own] - centre) ** 2).sum(axis=1))
            self.centres.append(centre)
            self.radii.append(float(apart.max()))
            self.children.append([])
            self.members.append(None)
            if len(own) <= leaf_rows or not self.radii[node]:
                self.members[node] = own
                continue
            one = floats[own[np.argmax(apart)]]
            other = floats[own[np.argmax(((floats[own] - one) ** 2).sum(axis=1))]]
            order = np.argsort(floats[own] @ (other - one), kind="stable")
            half = len(own) // 2
            todo += [(own[order[:half]], node), (own[order[half:]], node)]
        self.centres, self.radii = np.array(self.centres), np.array(self.radii)
        self.visited = 0

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bounds of the scores in each node, a row per query, raised by more than rounding can take away."""
        queries = queries.astype(np.float64)
        length = np.sqrt((queries * queries).sum(axis=1))[:, None]
        inner = queries @ self.centres.T
        reach = length * self.radii[None, :]
        size = length * np.sqrt((self.centres * self.centres).sum(axis=1))[None, :]
        return inner + reach + 1e-9 * (size + reach) + 0.5

    def search(self, query: np.ndarray, bounds: np.ndarray, firsts: np.ndarray, k: int, least: int | None) -> list[tuple[int, int]]:
        """(row, score) of the best ``k`` (ties to the smaller first id) with a score of at least ``least``."""
        best: list[tuple[int, int, int]] = []  # (score, -first id, row), the worst on top
        kth = least if least is not None else None
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if kth is not None and -bound < kth:
                break
            own = self.members[node]
            if own is None:
                for child in self.children[node]:
                    if kth is None or bounds[child] >= kth:
                        heapq.heappush(heap, (-bounds[child], child))
                continue
            self.visited += 1
            scores = products(self.rows[own], query)
            if kth is not None:
                keep = scores >= kth
                own, scores = own[keep], scores[keep]
            for row, score in zip(own.tolist(), scores.tolist(), strict=True):
                entry = (score, -int(firsts[row]), row)
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
            if len(best) == k and (kth is None or best[0][0] > kth):
                kth = best[0][0]
        return [(row, score) for score, _, row in best]


def _shard_search(block, k: int):
    def search(frame: pd.DataFrame) -> pd.DataFrame:
        classes, queries, least = block.value
        rows = integers(frame["vec"])
        tree = BallTree(rows)
        bounds = tree.bounds(queries)
        firsts, ids, held = frame["first"].to_numpy(), frame["ids"].to_numpy(), frame["class_id"].to_numpy()
        out = []
        for i, own in enumerate(classes):
            for row, score in tree.search(queries[i], bounds[i], firsts, k + 1, least[i]):
                out.append((own, held[row], score, firsts[row], ids[row]))
        return pd.DataFrame(out, columns=["query_class", "class_id", "score", "first", "ids"])

    return search


def first_scores(queries: np.ndarray, seeds: np.ndarray, k: int) -> list[int | None]:
    """A score that the best ``k + 1`` classes of each query reach for certain."""
    if len(seeds) < k + 1:
        return [None] * len(queries)
    return [int(np.partition(products(seeds, q), len(seeds) - k - 1)[len(seeds) - k - 1]) for q in queries]


def top_products(
    df: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """The ``k`` highest integer inner products of every row whose id is divisible by ``every``: (query_id, rank, vec_id, score).

    Components are floor(1024 * x); ties go to the smaller id; a query doesn't find its own id. The result is exact as
    long as scores fit a long.

    * Vectors that are null, empty, hold null or non-finite components or have another length than most take no part, nor
      do rows without an id. Zero vectors take part.
    * Vectors with equal integers are searched once and all found. Rows that repeat id and vector count once; rows of one id with
      different vectors are candidates each, and their queries' results are ranked together.
    * Fewer than ``k`` candidates: all of them. Other columns are not read. An empty table gives an empty result.
    """
    spark = df.sparkSession
    bound_batches(spark)
    whole = F.transform("vec", lambda x: F.floor(x * SCALE)).alias("vec")
    rows = materialize(valid_vectors(df, id_col, vector_col).select("vec_id", whole), "top-rows")
    classes = materialize(vector_classes(rows, k + 1), "top-classes")
    shards = max(1, -(-classes.count() // SHARD_ROWS))
    dealt = classes.withColumn("shard", F.pmod(F.xxhash64("class_id", F.lit(3)), F.lit(shards)))
    length = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    seeds = classes.orderBy(F.desc(length), "first").limit(SEEDS).select("vec").toArrow().column(0).to_pylist()

    members = query_members(rows, F.col("vec_id") % every == 0)
    asked = members.select("class_id", "vec").distinct()
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    asked = materialize(asked.withColumn("block", F.pmod(F.xxhash64("class_id", F.lit(5)), F.lit(blocks))), "top-queries")
    kinds = "query_class long, class_id long, score long, first long, ids array<long>"
    found = None
    for n in range(blocks):  # a bounded block of queries at a time against all shards
        block = asked.where(F.col("block") == n).select("class_id", "vec").toArrow()
        queries = integers(block.column(1).to_pylist() or [[0]])[: block.num_rows]
        least = first_scores(queries, integers(seeds), k) if seeds else []
        sent = spark.sparkContext.broadcast((block.column(0).to_pylist(), queries, least))
        part = materialize(dealt.groupBy("shard").applyInPandas(_shard_search(sent, k), kinds), "top-found")
        found = part if found is None else found.unionByName(part)
    return ranked_results(found, members, k)
