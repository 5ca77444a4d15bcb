"""Searches against brute force."""

import numpy as np

from weftline.llm import ann, sql, top_k
from weftline.llm.entries import _nearest, _top
from tests.compare import compare, connect

SCHEMA = "vec_id long, embedding array<float>, score string, first string, label int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "x", "y", 1) for i, v in rows], SCHEMA).repartition(3)


def usable(rows, zeros):
    return [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows
            if i is not None and v is not None and len(v) == 8 and None not in v and np.isfinite(v).all() and (zeros or np.any(v))]


def brute(rows, every, k, score):
    out, rows = [], [(i, np.array(v)) for i, v in dict.fromkeys((i, tuple(v)) for i, v in rows)]
    for q, x in rows:
        if q % every == 0:
            found = sorted({(-score(x, y), i) for i, y in rows if i != q})
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found[:k])]
    return sorted(out)


def cosine(x, y):
    return float((x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum())))


def whole(x, y):
    return int((np.floor(1024 * x).astype(np.int64) * np.floor(1024 * y).astype(np.int64)).sum())


def rows_with_trouble():
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).round(2).tolist()) for i in range(150)]
    same = rng.normal(size=8).round(2).tolist()
    rows += [(i, same) for i in range(200, 260)] + [(300, same), (300, same)]
    rows += [(400, None), (401, []), (402, [0.0] * 8), (403, [float("nan")] * 8), (404, [float("inf")] * 8), (405, [None] * 8), (406, [1.0, 2.0]), (None, same)]
    return rows


def test_exact_products(spark, monkeypatch):
    monkeypatch.setattr(top_k, "SHARD_ROWS", 40)
    monkeypatch.setattr(top_k, "BLOCK_QUERIES", 5)
    monkeypatch.setattr(top_k, "SEEDS", 15)
    rows = rows_with_trouble()
    got = sorted(tuple(r) for r in top_k.top_products(frame(spark, rows), every=10, k=7).collect())
    assert got == brute(usable(rows, True), 10, 7, whole)


def test_few_rows(spark):
    rows = [(0, [1.0] * 8), (10, [2.0] * 8), (3, [-1.0] * 8)]
    exact = sorted(tuple(r) for r in top_k.top_products(frame(spark, rows), every=10).collect())
    near = sorted(tuple(r) for r in ann.nearest(frame(spark, rows), every=10).collect())
    assert exact == brute(usable(rows, True), 10, 10, whole)
    assert [r[:3] for r in near] == [r[:3] for r in brute(usable(rows, False), 10, 5, cosine)]
    for table in (frame(spark, rows).limit(0), frame(spark, [(1, None)])):
        assert top_k.top_products(table).count() == 0 and ann.nearest(table).count() == 0


def test_ball_tree_prunes_and_is_exact():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16)) * 500
    rows = np.floor(centres[rng.integers(0, 20, 4000)] + rng.normal(size=(4000, 16)) * 20)
    tree = top_k.BallTree(rows)
    queries = rows[:50]
    bounds = tree.bounds(queries)
    firsts = np.arange(4000)
    for q, b in zip(queries, bounds, strict=True):
        scores = top_k.products(rows, q)
        want = sorted(zip((-scores).tolist(), firsts.tolist(), strict=True))[:10]
        for least in (None, -want[-1][0]):
            assert sorted((-s, r) for r, s in tree.search(q, b, firsts, 10, least)) == want
    assert tree.visited < 0.5 * 100 * sum(m is not None for m in tree.members)
    big = np.full((3, 4), 1 << 28, dtype=np.int64)
    assert top_k.products(top_k.integers(big), top_k.integers(big)[0]).tolist() == [4 << 56] * 3


def test_nearest_on_troubled_rows(spark):
    rows = rows_with_trouble()
    got = sorted(tuple(r) for r in ann.nearest(frame(spark, rows), every=10).collect())
    want = brute(usable(rows, False), 10, 5, cosine)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], atol=1e-12)


def recall(got, rows, every, k):
    hits = total = 0
    x = np.array([v for _, v in rows])
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    ids = np.array([i for i, _ in rows])
    for n in np.flatnonzero(ids % every == 0):
        sims = x @ x[n]
        sims[n] = -2
        want = set(ids[np.argsort(-sims)[:k]].tolist())
        hits += len(want & got.get(int(ids[n]), set()))
        total += len(want)
    return hits / total


def test_query_recall(spark, sf_dir):
    """Many lists, boundary copies and pruning on the given table; recall against brute force in double precision."""
    for folder in (sf_dir, sf_dir.replace("sf0.001", "sf0.1")):
        rows = [(r.vec_id, np.array(r.embedding, dtype=float)) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
        got = {}
        for r in _nearest(spark, folder).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        assert set(got) == {i for i, _ in rows if i % 50 == 0}
        assert recall(got, rows, 50, 5) >= 0.9


def test_recall_with_many_lists(spark, monkeypatch):
    """Probes follow the number of lists: 1,500 lists of vectors without clusters."""
    monkeypatch.setattr(ann, "LIST_ROWS", 10)
    rng = np.random.default_rng(9)
    rows = [(i, v.astype(float)) for i, v in enumerate(rng.normal(size=(15_000, 64)).astype(np.float32))]
    got = {}
    for r in ann.nearest(frame(spark, [(i, v.tolist()) for i, v in rows]), every=100).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert all(len(x) == 5 for x in got.values()) and recall(got, rows, 100, 5) >= 0.9


def test_isolated_vectors(spark, monkeypatch):
    """Queries that are their own centroid, among tight clusters."""
    monkeypatch.setattr(ann, "LIST_ROWS", 20)
    rng = np.random.default_rng(13)
    rows = rng.normal(size=(10, 64))[rng.integers(0, 10, 6000)] + 0.01 * rng.normal(size=(6000, 64))
    rows[::20] = rng.normal(size=(300, 64))
    rows = [(i, v.astype(float)) for i, v in enumerate(rows.astype(np.float32))]
    got = {}
    for r in ann.nearest(frame(spark, [(i, v.tolist()) for i, v in rows]), every=20).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert len(got) == 300 and all(len(x) == 5 for x in got.values()) and recall(got, rows, 20, 5) >= 0.9


def test_probes_go_on_until_lists_hold_enough():
    rng = np.random.default_rng(15)
    graph = ann.CentroidGraph(ann.unit(rng.normal(size=(600, 24))))
    row = graph.centers[:1]
    far = np.argsort(graph.centers @ row[0])[:100]
    own = np.zeros(600, dtype=np.int64)
    own[far] = 1
    (lists,) = ann.probe_lists(graph, row, own, np.zeros(600), 24)
    assert own[lists].sum() == 24 and len(set(lists)) == len(lists)
    assert sorted(ann.probe_lists(graph, row, own, np.zeros(600), 1000)[0]) == list(range(600))


def test_graph_search_finds_near_centroids():
    rng = np.random.default_rng(5)
    points = ann.unit(rng.normal(size=(6000, 24)))
    graph = ann.CentroidGraph(ann.fit_centroids(points, 300))
    ids, apart = graph.search(points[:200], 64)
    best = np.argmax(points[:200] @ graph.centers.T, axis=1)
    assert (ids[:, 0] == best).mean() > 0.95 and (np.diff(apart, axis=1) >= 0).all()
    assert all(len(set(row[row >= 0].tolist())) == (row >= 0).sum() for row in ids)
    lists = ann.replica_lists(graph, points[:200])
    assert all(1 <= len(x) <= ann.REPLICAS for x in lists) and max(map(len, lists)) > 1


def test_top_query(spark, sf_dir):
    assert compare(spark, connect(sf_dir), sf_dir, "op9_top_products", _top, sql.TOP_PRODUCTS) is None
