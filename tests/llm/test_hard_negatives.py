"""Cover trees and mined negatives against brute force."""

import numpy as np
import pytest

from weftline.llm import cover_tree as CT, hard_negatives as HN, sql
from weftline.llm.entries import _mined
from weftline.llm.top_k import products
from tests.compare import compare, connect

SCHEMA = "vec_id long, embedding array<float>, label int, class_id string, goal string, shard string"


def frame(spark, rows):
    fixed = [(i, None if v is None else [None if x is None else float(x) for x in v], label, "x", "y", "z") for i, v, label in rows]
    return spark.createDataFrame(fixed, SCHEMA).repartition(3)


def brute(rows, every, k, dim):
    kept = []
    for i, v, label in rows:
        if i is None or v is None or label is None or len(v) != dim or None in v:
            continue
        x = np.array(v, dtype=np.float32).astype(float)
        if np.isfinite(x).all():
            kept.append((i, tuple(np.floor(256 * x).astype(np.int64).tolist()), label))
    kept = list(dict.fromkeys(kept))
    matrix = np.array([v for _, v, _ in kept], dtype=np.int64)
    out = []
    for n, (anchor, v, label) in enumerate(kept):
        if anchor % every:
            continue
        scores = (matrix @ np.array(v, dtype=np.int64)).tolist()
        near = sorted((-s, kept[m][0]) for m, s in enumerate(scores) if m != n and kept[m][2] == label)[:k]
        for s, positive in near:
            s = -s
            fit = sorted((-t, kept[m][0]) for m, t in enumerate(scores) if kept[m][2] != label and 80 * s <= 100 * t <= 100 * s)[:k]
            out += [(anchor, positive, r + 1, i, s, -t) for r, (t, i) in enumerate(fit)]
    return sorted(out)


def mined(df, **options):
    return sorted(tuple(r) for r in HN.hard_negatives(df, **options).collect())


def rows_with_trouble():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8)) * 2
    rows = [(i, (centres[i % 6] + rng.normal(size=8) * 0.4).round(2).tolist(), int(rng.integers(0, 4))) for i in range(300)]
    same = (centres[0] * 1.1).round(2).tolist()
    rows += [(i, same, 1 + i % 2) for i in range(400, 480)] + [(500, same, 1), (500, same, 1), (500, same, 2), (500, (centres[1]).round(2).tolist(), 1)]
    rows += [(600, None, 1), (610, [], 1), (620, [0.0] * 8, 1), (630, [float("nan")] * 8, 1), (640, [float("inf")] * 8, 2), (650, [None] * 8, 1), (660, [1.0, 2.0], 1)]
    return rows + [(None, same, 1), (670, same, None), (680, [-9.0] * 8, 77), (690, [-9.0] * 8, 78), (700, same, 99)]


@pytest.mark.parametrize("shard_rows", [25, 4096])
def test_mining(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(HN, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(HN, "BLOCK_ANCHORS", 9)
    monkeypatch.setattr(CT, "LEAF_ROWS", 8)
    rows = rows_with_trouble()
    assert mined(frame(spark, rows), every=10, k=4) == brute(rows, 10, 4, 8)


def test_few_rows(spark):
    rows = [(0, [1.0] * 4, 1), (1, [1.0] * 4, 1), (2, [0.9] * 4, 2), (3, [1.0] * 4, 2), (4, [-1.0] * 4, 2), (10, [0.0] * 4, 5), (11, [0.0] * 4, 5)]
    assert mined(frame(spark, rows), every=10) == brute(rows, 10, 5, 4)
    for table in (frame(spark, rows).limit(0), frame(spark, [(1, None, 1)]), frame(spark, rows[:1])):
        assert mined(table) == []


def clustered(n):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 12)) * 300
    return np.floor(centres[rng.integers(0, 20, n)] * rng.uniform(0.5, 1.5, size=(n, 1)) + rng.normal(size=(n, 12)) * 10).astype(np.int64)


def test_tree_covers_and_bounds():
    rows = clustered(3000)
    peak = float(np.sqrt((rows * rows).sum(axis=1)).max())
    tree = CT.CoverTree(rows.astype(float), peak, 32)
    held = np.concatenate([m for m in tree.members if m is not None])
    assert sorted(held.tolist()) == list(range(3000))
    low, high = tree.bounds(rows[:40].astype(float))

    def below(node):
        own = tree.members[node]
        return own if own is not None else np.concatenate([below(c) for c in tree.children[node]])

    for node in range(len(tree.centre)):
        own = below(node)
        apart = CT.angles(tree.points[own], tree.points[tree.centre[node]])
        assert apart.max() <= tree.outer[node] + 1e-9 and apart.min() >= tree.inner[node] - 1e-7
        scores = rows[:40] @ rows[own].T
        assert (scores.max(axis=1) <= high[:, node]).all() and (scores.min(axis=1) >= low[:, node]).all()


def test_windows_prune_and_are_exact():
    rows = clustered(6000)
    peak = float(np.sqrt((rows * rows).sum(axis=1)).max())
    floats, firsts, kind = rows.astype(float), np.arange(6000)[::-1].copy(), np.arange(6000) % 3
    tree = CT.CoverTree(floats, peak, 32)
    low, high = tree.bounds(floats[:60])
    leaves = sum(m is not None for m in tree.members)
    for n in range(60):
        scores = products(floats, floats[n])
        for window in ((None, None), (int(scores.max() * 0.4), int(scores.max() * 0.5)), (0, 0)):
            fit = [(-s, f, r) for r, (s, f) in enumerate(zip(scores.tolist(), firsts.tolist(), strict=True)) if kind[r] != 0
                   and (window[0] is None or window[0] <= s <= window[1])]
            want = sorted((s, f) for s, f, _ in fit)[:5]
            got = tree.search(floats[n], low[n], high[n], firsts, 5, window, None, kind != 0)
            assert sorted((-s, int(firsts[r])) for r, s in got) == want
            least = -want[-1][0] if len(want) == 5 else None
            got = tree.search(floats[n], low[n], high[n], firsts, 5, window, least, kind != 0)
            assert sorted((-s, int(firsts[r])) for r, s in got) == want
    assert tree.visited < 0.35 * 360 * leaves


def test_net_covers():
    points = CT.augmented(clustered(2000).astype(float), 4000.0)
    chosen = CT.net(points, 20)
    apart = np.arccos(np.clip(points @ points[chosen].T, -1, 1))
    between = apart[chosen] + np.eye(len(chosen)) * 9
    assert len(set(chosen.tolist())) == 20 and apart.min(axis=1).max() <= between.min() + 1e-7
    assert len(CT.net(np.repeat(points[:1], 9, axis=0), 4)) <= 2


def test_query(spark, sf_dir):
    assert compare(spark, connect(sf_dir), sf_dir, "op12_hard_negatives", _mined, sql.HARD_NEGATIVES) is None
