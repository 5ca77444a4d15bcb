"""A cover tree over norm-augmented vectors: inner products as angles between points of one sphere.

Every vector gets one more component that brings it to the length of the longest vector (``peak``), and a query gets a zero there. Then
the inner product with a query is |query| * peak * cosine of the angle between them, angles are a metric, and a
node whose rows lie within some angle of its centre bounds their products from both sides.
"""

from __future__ import annotations

import heapq

import numpy as np

from weftline.llm.top_k import products

LEAF_ROWS = 128
SMALL_ROWS = 8  # balls with fewer rows are read together, as rings around the centre of their parent
_SLACK = 1e-7  # more than rounding can change an angle by


def augmented(rows: np.ndarray, peak: float) -> np.ndarray:
    """Unit vectors of the rows with the component that brings them to the length ``peak``."""
    floats = rows.astype(np.float64)
    rest = np.sqrt(np.maximum(peak * peak - (floats * floats).sum(axis=1), 0.0))
    return np.concatenate([floats, rest[:, None]], axis=1) / peak


def angles(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(points @ centre, -1.0, 1.0))


def score_bounds(theta: np.ndarray, inner: np.ndarray, outer: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest product of a query with rows whose angle to a centre lies in [inner, outer].

    ``theta`` is the angle between query and centre, ``scale`` the query's length times ``peak``.
    """
    near = np.maximum(np.maximum(theta - outer, inner - theta) - _SLACK, 0.0)
    far = np.minimum(theta + outer + _SLACK, np.pi)
    slack = 0.5 + 1e-9 * scale
    return scale * np.cos(far) - slack, scale * np.cos(near) + slack


def net(points: np.ndarray, wanted: int) -> np.ndarray:
    """Rows of a net: each next one is the farthest from those before, so they cover the points at falling radii."""
    chosen, apart = [0], angles(points, points[0])
    while len(chosen) < wanted and apart.max() > 0:
        chosen.append(int(apart.argmax()))
        apart = np.minimum(apart, angles(points, points[chosen[-1]]))
    return np.array(chosen)


class CoverTree:
    """Balls of halved radius at each level; their centres are rows, more than that radius apart."""

    def __init__(self, rows: np.ndarray, peak: float, leaf_rows: int = LEAF_ROWS):
        self.rows, self.peak = rows, peak
        self.points = augmented(rows, peak)
        self.centre, self.inner, self.outer, self.children, self.members = [], [], [], [], []
        everything = np.arange(len(rows))
        todo = [(0, everything, angles(self.points, self.points[0]), np.pi, -1)]
        while todo:
            centre, own, apart, radius, parent = todo.pop()
            node = self._node(centre, 0.0, float(apart.max()), parent)
            if len(own) <= leaf_rows or apart.max() == 0:
                self.members[node] = own
                continue
            while apart.max() <= radius:  # levels on which the ball is its own only child
                radius /= 2
            loose = []
            for child, covered, distance in self._level(centre, own, apart, radius):
                if len(covered) < SMALL_ROWS:
                    loose.append(covered)
                else:
                    todo.append((child, covered, distance, radius, node))
            if loose:
                self._rings(centre, np.concatenate(loose), node, leaf_rows)
        self.centre, self.inner, self.outer = np.array(self.centre), np.array(self.inner), np.array(self.outer)
        self.visited = 0

    def _node(self, centre: int, inner: float, outer: float, parent: int) -> int:
        node = len(self.centre)
        self.centre.append(centre)
        self.inner.append(inner)
        self.outer.append(outer)
        self.children.append([])
        self.members.append(None)
        if parent >= 0:
            self.children[parent].append(node)
        return node

    def _level(self, centre: int, own: np.ndarray, apart: np.ndarray, radius: float):
        """(centre, rows, angles) of the balls of one level: what no ball covers yet gives the next centre."""
        near = apart <= radius
        yield centre, own[near], apart[near]
        left = own[~near]
        while len(left):
            distance = angles(self.points[left], self.points[left[0]])
            near = distance <= radius
            near[0] = True
            yield int(left[0]), left[near], np.where(left[near] == left[0], 0.0, distance[near])
            left = left[~near]

    def _rings(self, centre: int, own: np.ndarray, parent: int, leaf_rows: int) -> None:
        apart = angles(self.points[own], self.points[centre])
        order = np.argsort(apart, kind="stable")
        for at in range(0, len(own), leaf_rows):
            ring = order[at : at + leaf_rows]
            node = self._node(centre, float(apart[ring[0]]), float(apart[ring[-1]]), parent)
            self.members[node] = own[ring]

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest products in each node, a row per query."""
        floats = queries.astype(np.float64)
        length = np.sqrt((floats * floats).sum(axis=1))[:, None]
        units = floats / np.where(length > 0, length, 1.0)
        theta = np.arccos(np.clip(units @ self.points[self.centre, : floats.shape[1]].T, -1.0, 1.0))
        return score_bounds(theta, self.inner[None, :], self.outer[None, :], length * self.peak)

    def search(
        self, query: np.ndarray, low: np.ndarray, high: np.ndarray, firsts: np.ndarray, k: int,
        window: tuple[int | None, int | None] = (None, None), least: int | None = None, allowed: np.ndarray | None = None,
    ) -> list[tuple[int, int]]:
        """(row, score) of the best ``k`` rows with a score in the window and of at least ``least``; ties to the smaller first id.

        Nodes come by their greatest possible score inside the window; a node whose bounds miss the window, or can't reach the
        k-th score so far, is left alone. ``low`` and ``high`` are the query's ``bounds``, ``allowed`` marks the rows that may be found.
        """
        floor, ceiling = window
        kth = max((x for x in (floor, least) if x is not None), default=None)
        best: list[tuple[int, int, int]] = []  # (score, -first id, row), the worst on top

        def may_hold(node: int) -> bool:
            return (kth is None or high[node] >= kth) and (ceiling is None or low[node] <= ceiling)

        def place(node: int) -> float:
            return -(high[node] if ceiling is None else min(high[node], ceiling))

        heap = [(place(0), 0)] if may_hold(0) else []
        while heap:
            bound, node = heapq.heappop(heap)
            if kth is not None and -bound < kth:
                break
            own = self.members[node]
            if own is None:
                for child in self.children[node]:
                    if may_hold(child):
                        heapq.heappush(heap, (place(child), child))
                continue
            self.visited += 1
            scores = products(self.rows[own], query)
            keep = np.ones(len(own), dtype=bool) if allowed is None else allowed[own].copy()
            if kth is not None:
                keep &= scores >= kth
            if ceiling is not None:
                keep &= scores <= ceiling
            own, scores = own[keep], scores[keep]
            order = np.lexsort((firsts[own], -scores))[:k]
            for row, score in zip(own[order].tolist(), scores[order].tolist(), strict=True):
                entry = (score, -int(firsts[row]), row)
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
            if len(best) == k and (kth is None or best[0][0] > kth):
                kth = best[0][0]
        return [(row, score) for score, _, row in best]
