"""Approximate nearest neighbours by cosine: balanced posting lists behind an in-memory graph of centroids.

Centroids are fitted on a bounded sample; all vectors are indexed. A vector near a
boundary goes to several lists: to those within a distance ratio of its nearest one, unless a
centroid already chosen is nearer to the next than the vector is. A query takes a number of nearest lists, more within a
distance ratio of its nearest centroid, and as many as hold enough vectors. Centroids are found through a graph of their
neighbours, kept in memory by every worker; lists and their queries meet in tiles of bounded size.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weftline.llm.common import bound_batches
from weftline.llm.vectors import matrix, query_members, ranked_results, valid_vectors, vector_classes
from weftline.plans.lineage import materialize

SAMPLE = 16_384  # vectors the centroids are fitted on
LIST_ROWS, MOST_LISTS = 200, 2048  # vectors a list should hold; more lists than MOST_LISTS don't fit the sample
ITERATIONS, BALANCE = 12, 0.05  # rounds of fitting; how much a full list repels
DEGREE, LONG_LINKS, ENTRIES = 16, 4, 8  # of the centroid graph
REPLICAS, REPLICA_RATIO = 6, 1.2  # lists of a vector; distances against its nearest list
PROBES, PROBE_SHARE, PROBE_RATIO = 48, 0.12, 1.5  # most lists of a query, or this share of all if that is more; distances against its nearest list
FEWEST_SHARE = 0.5  # of those lists, read whatever their distances are: a vector on its centroid says nothing about others
ENOUGH = 4  # times k + 1 different classes that the lists of a query hold at least, where there are so many
BEAM = 64  # candidates of a graph search
TILE_ROWS, TILE_QUERIES = 8192, 1024
SPARE = 4  # classes a tile scores exactly besides those it gives


def unit(rows: np.ndarray) -> np.ndarray:
    peak = np.abs(rows).max(axis=1, keepdims=True)
    rows = rows / peak
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def fit_centroids(sample: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """Spherical k-means whose lists repel more vectors the fuller they are."""
    rng = np.random.default_rng(seed)
    centers = sample[rng.choice(len(sample), lists, replace=False)]
    mean = len(sample) / lists
    load = np.zeros(lists)
    for _ in range(ITERATIONS):
        own = np.concatenate([np.argmax(part @ centers.T - BALANCE * load / mean, axis=1) for part in np.array_split(sample, 1 + len(sample) // 2048)])
        size = np.bincount(own, minlength=lists)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, sample)
        empty = np.flatnonzero(size == 0)
        sums[empty] = sample[rng.choice(len(sample), len(empty))]
        norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centers = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centers)
        load = 0.5 * load + 0.5 * size
    return centers


class CentroidGraph:
    """Neighbour graph of the centroids and a beam search over it, for many vectors at a time."""

    def __init__(self, centers: np.ndarray, seed: int = 11):
        self.centers = centers
        n = len(centers)
        rng = np.random.default_rng(seed)
        near = np.empty((n, min(DEGREE, max(1, n - 1))), dtype=np.int64)
        for at in range(0, n, 512):
            sims = centers[at : at + 512] @ centers.T
            sims[np.arange(len(sims)), np.arange(at, at + len(sims))] = -2 if n > 1 else 2
            near[at : at + 512] = np.argsort(-sims, axis=1, kind="stable")[:, : near.shape[1]]
        ring = (np.arange(n)[:, None] + 1) % n  # makes the graph connected
        self.links = np.concatenate([near, ring, rng.integers(0, n, (n, LONG_LINKS))], axis=1)
        self.entries = np.unique(np.linspace(0, n - 1, ENTRIES).astype(np.int64))

    def search(self, rows: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(centroid ids, squared distances) of each row, nearest first; -1 and infinity where there are fewer."""
        q, n = len(rows), len(self.centers)
        every = np.arange(q)[:, None]
        seen = np.zeros((q, n), dtype=bool)
        seen[:, self.entries] = True
        ids = np.full((q, beam), -1, dtype=np.int64)
        sims = np.full((q, beam), -np.inf)
        first = np.broadcast_to(self.entries[:beam], (q, min(beam, len(self.entries))))
        ids[:, : first.shape[1]] = first
        sims[:, : first.shape[1]] = rows @ self.centers[self.entries[:beam]].T
        open_ = ids >= 0
        while open_.any():
            at = np.argmax(np.where(open_, sims, -np.inf), axis=1)
            active = open_.any(axis=1)
            open_[np.arange(q), at] = False
            new = self.links[np.where(active, ids[np.arange(q), at], 0)]
            fresh = ~seen[every, new] & active[:, None]
            # the same centroid may be linked twice
            order = np.sort(np.where(fresh, new, -1), axis=1)
            order[:, 1:][order[:, 1:] == order[:, :-1]] = -1
            fresh = order >= 0
            seen[every, np.where(fresh, order, 0)] |= fresh
            found = np.where(fresh, np.einsum("qd,qnd->qn", rows, self.centers[order]), -np.inf)
            all_ids = np.concatenate([ids, order], axis=1)
            all_sims = np.concatenate([sims, found], axis=1)
            all_open = np.concatenate([open_, fresh], axis=1)
            best = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            ids, sims, open_ = all_ids[every, best], all_sims[every, best], all_open[every, best]
        return ids, np.where(ids >= 0, np.maximum(2 - 2 * sims, 0), np.inf)


def replica_lists(graph: CentroidGraph, rows: np.ndarray) -> list[list[int]]:
    """Lists of each vector: the nearest, and others within the ratio that no chosen one stands for."""
    ids, apart = graph.search(rows, min(BEAM, 4 * REPLICAS))
    limit = REPLICA_RATIO**2 * apart[:, :1] + 1e-12
    out = []
    for own, dist, most in zip(ids, apart, limit, strict=True):
        chosen: list[int] = []
        for k in np.flatnonzero(dist <= most)[: 4 * REPLICAS]:
            center = graph.centers[own[k]]
            if all(2 - 2 * float(center @ graph.centers[o]) >= dist[k] for o in chosen):
                chosen.append(int(own[k]))
            if len(chosen) == REPLICAS:
                break
        out.append(chosen)
    return out


def most_probes(lists: int) -> int:
    """Lists a query may read: a share of all, so that recall doesn't fall as their number grows."""
    return max(PROBES, math.ceil(PROBE_SHARE * lists))


def probe_lists(graph: CentroidGraph, rows: np.ndarray, own: np.ndarray, spread: np.ndarray, enough: int) -> list[list[int]]:
    """Lists a query reads: the nearest ones, more by distance ratio, and on until their ``own`` vectors are ``enough``.

    ``own`` counts vectors whose nearest list it is, so that none counts twice; ``spread`` is their mean squared distance
    from the centroid. The ratio starts from the nearest lists that hold ``enough``, and not under their spread: a query on
    its centroid is at no distance from it, but its neighbours are.
    """
    most = most_probes(len(graph.centers))
    ids, apart = graph.search(rows, max(BEAM, most))
    out = []
    for near, dist, row in zip(ids, apart, rows, strict=True):
        near = near[near >= 0][:most]
        dist = dist[: len(near)]
        first = 1 + min(np.searchsorted(np.cumsum(own[near]), enough), len(near) - 1)
        fits = dist <= PROBE_RATIO**2 * max(dist[first - 1], spread[near[:first]].max()) + 1e-12
        fits[: math.ceil(FEWEST_SHARE * most)] = True
        lists = near[fits].tolist()
        held = own[lists].sum()
        if held < enough:
            order = np.argsort(-(graph.centers @ row), kind="stable")
            order = order[~np.isin(order, lists)]
            lists += order[: 1 + np.searchsorted(held + np.cumsum(own[order]), enough)].tolist()
        out.append(lists)
    return out


def _routed(graph, lists_of):
    """Rows, once per list of theirs."""

    def route(batches):
        net = graph.value
        for batch in batches:
            for part in (batch.slice(at, 500) for at in range(0, batch.num_rows, 500)):
                at = part.schema.names.index("vec")
                points = unit(matrix(part.column(at).to_pylist()))
                lists = lists_of(net, points)
                rows = np.repeat(np.arange(part.num_rows), [len(x) for x in lists])
                taken = part.take(pa.array(rows))
                flat = pa.array([c for x in lists for c in x], pa.int64())
                firsts = np.array([x[0] for x in lists])
                apart = 2 - 2 * np.einsum("qd,qd->q", points, net.centers[firsts])
                # a row's distance from its nearest list, null in the others
                apart = pa.array([d if n == 0 else None for x, d in zip(lists, apart.tolist(), strict=True) for n in range(len(x))], pa.float64())
                yield pa.RecordBatch.from_arrays([flat, apart, *taken.columns], ["list", "apart", *part.schema.names])

    return route


def _tile_search(k: int):
    def search(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(held):
            return pd.DataFrame({c: [] for c in ("query_class", "class_id", "score", "first", "ids")})
        q, x = matrix(asked["vec"]), matrix(held["vec"])
        near = unit(q) @ unit(x).T
        n = min(k + 1 + SPARE, len(held))
        best = np.argpartition(-near, n - 1, axis=1)[:, :n]
        # ties at the edge: every class as near as the last chosen one, within rounding
        edge = np.take_along_axis(near, best, axis=1).min(axis=1) - 1e-12
        firsts, classes, ids = held["first"].to_numpy(), held["class_id"].to_numpy(), held["ids"].to_numpy()
        out = []
        for i, asked_class in enumerate(asked["class_id"]):
            at = np.flatnonzero(near[i] >= edge[i])
            score = (x[at] * q[i]).sum(axis=1) / (np.sqrt((x[at] * x[at]).sum(axis=1)) * np.sqrt((q[i] * q[i]).sum()))
            order = np.lexsort((firsts[at], -score))[: k + 1]
            at = at[order]
            out.append(pd.DataFrame({
                "query_class": asked_class, "class_id": classes[at], "score": score[order], "first": firsts[at], "ids": list(ids[at]),
            }))
        return pd.concat(out)

    return search


def nearest(
    df: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """The ``k`` nearest rows found for every row whose id is divisible by ``every``: (query_id, rank, vec_id, score).

    Nearness is the cosine of the original vectors in double precision; ties go to the smaller id; a query
    doesn't find its own id.

    * Vectors that are null, empty, zero, hold null or non-finite components or have another length than most take no
      part, nor do rows without an id.
    * Equal vectors are searched once and all found. Rows that repeat id and vector count once; rows of one id with
      different vectors are candidates each, and their queries' results are ranked together.
    * Fewer than ``k`` candidates: all of them. Other columns are not read. An empty table gives an empty result.
    """
    spark = df.sparkSession
    bound_batches(spark)
    rows = materialize(valid_vectors(df, id_col, vector_col).where(F.exists("vec", lambda x: x != 0)), "ann-rows")
    classes = materialize(vector_classes(rows, k + 1), "ann-classes")
    count = classes.count()
    sample = classes.orderBy(F.xxhash64("class_id"), "class_id").limit(SAMPLE).select("vec").toArrow()
    points = unit(matrix(sample.column(0).to_pylist())) if count else np.ones((1, 1))
    lists = max(1, min(MOST_LISTS, -(-count // LIST_ROWS), len(points)))
    graph = spark.sparkContext.broadcast(CentroidGraph(fit_centroids(points, lists)))

    kinds = "list long, apart double, class_id long, first long, ids array<long>, vec array<double>"
    held = materialize(classes.mapInArrow(_routed(graph, replica_lists), kinds), "ann-lists")
    loads = held.where("apart IS NOT NULL").groupBy("list").agg(F.count(F.lit(1)), F.avg("apart")).toArrow()  # a row per list, too
    own, spread = np.zeros(lists, dtype=np.int64), np.zeros(lists)
    own[loads.column(0).to_numpy()], spread[loads.column(0).to_numpy()] = loads.column(1).to_numpy(), loads.column(2).to_numpy()
    probes = partial(probe_lists, own=own, spread=spread, enough=ENOUGH * (k + 1))
    members = query_members(rows, F.col("vec_id") % every == 0)
    asked = materialize(
        members.select("class_id", "vec").distinct().mapInArrow(_routed(graph, probes), "list long, apart double, class_id long, vec array<double>"),
        "ann-probes",
    )
    sizes = held.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / TILE_ROWS).alias("row_tiles")).join(
        asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / TILE_QUERIES).alias("query_tiles")), "list"
    )
    sizes = materialize(sizes, "ann-sizes")  # a row per list, of which there are MOST_LISTS at most

    def tiled(side: DataFrame, own: str, other: str) -> DataFrame:
        dealt = side.join(F.broadcast(sizes), "list").withColumn(own, F.pmod(F.xxhash64("class_id", F.lit(own)), F.col(f"{own}s")))
        return dealt.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}s") - 1)))

    key = ["list", "row_tile", "query_tile"]
    left = tiled(asked, "query_tile", "row_tile").select(*key, "class_id", "vec")
    right = tiled(held, "row_tile", "query_tile").select(*key, "class_id", "first", "ids", "vec")
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(
        _tile_search(k), "query_class long, class_id long, score double, first long, ids array<long>"
    )
    return ranked_results(found, members, k)
