"""The skew-safe paths, forced with tiny bounds, against the plain forms."""

import random

from pyspark.sql import functions as F

from weftline.operators.orders import cart_lines, order_headers, with_carts
from weftline.plans import shaping


def test_dense_number_is_contiguous_over_partitions(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    got = sorted((r.n, r.k) for r in shaping.dense_number(rows, ["k"], "n", start=5).collect())
    assert got == [(k + 5, k) for k in range(1000)]


def test_dense_number_of_nothing(spark):
    assert shaping.dense_number(spark.range(0), ["id"], "n").count() == 0


def test_nest_cuts_every_key_into_ordered_blocks(spark):
    rows = [("hot", i) for i in range(220)] + [("cold", i) for i in range(5)] + [("cold", 3), (None, 1)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v int").repartition(5)
    blocks = sorted(shaping.nest(df, ["k"], F.struct("v"), "vs", block_rows=50).collect(), key=lambda b: b.block)
    by_key = {}
    for b in blocks:
        by_key.setdefault(b.k, []).append([x.v for x in b.vs])
    assert by_key == {"hot": [list(range(k, min(k + 50, 220))) for k in range(0, 220, 50)], "cold": [[0, 1, 2, 3, 3, 4]], None: [[1]]}


def test_nest_spreads_copies_of_one_item(spark):
    df = spark.createDataFrame([("hot", 1)] * 500 + [("hot", 2)] * 3 + [("cold", 1)] * 4, "k string, v int")
    blocks = sorted(shaping.nest(df, ["k"], F.struct("v"), "vs", block_rows=20).collect(), key=lambda b: b.block)
    hot = [[x.v for x in b.vs] for b in blocks if b.k == "hot"]
    assert [len(b) for b in hot] == [20] * 25 + [3] and sum(hot, []) == [1] * 500 + [2] * 3
    assert [[x.v for x in b.vs] for b in blocks if b.k == "cold"] == [[1] * 4]


def test_a_cart_larger_than_a_block_has_one_header_and_numbered_lines(spark):
    orders = spark.createDataFrame([(1, "a"), (2, "b")], "order_id long, username string")
    lines = spark.createDataFrame([(1, n, n % 3, 1) for n in range(25)], "order_id long, line long, product_id long, quantity long")
    requests = with_carts(orders, lines, block_rows=10)
    assert sorted((r.order_id, r.block, len(r.cart)) for r in requests.collect()) == [(1, 0, 10), (1, 1, 10), (1, 2, 5), (2, 0, 0)]
    assert sorted(r.order_id for r in order_headers(requests).collect()) == [1, 2]
    assert [(r.line, r.product_id) for r in cart_lines(requests, block_rows=10).orderBy("line").collect()] == [(n, n % 3) for n in range(25)]


def test_running_before_over_spans(spark):
    rng = random.Random(3)
    rows = [("hot", p, rng.randint(1, 9)) for p in range(300)] + [("cold", p, 2) for p in range(0, 300, 37)]
    df = spark.createDataFrame(rows, "k string, pos bigint, a bigint")
    got = {(r.k, r.pos): r.before for r in shaping.running_before(df, "k", "pos", {"before": F.col("a")}, 16).collect()}
    want = {(k, p): sum(a for k2, p2, a in rows if k2 == k and p2 < p) for k, p, _ in rows}
    assert got == want


def test_heavy_keys_are_counted_exactly(spark):
    rows = [("a",)] * 40 + [("b",)] * 30 + [(None,)] * 35 + [(f"k{i}",) for i in range(200)]
    df = spark.createDataFrame(rows, "k string").repartition(5).cache()
    assert {r[0] for r in shaping.heavy_keys(df, "k", 31).collect()} == {"a", None}
    assert shaping.heavy_keys(df, "k", 100) is None and shaping.heavy_keys(df, "k", 1000) is None


def test_running_sums_split_heavy_keys_only(spark):
    rng = random.Random(4)
    rows = [("hot", p, rng.randint(1, 9)) for p in range(300)] + [(f"k{n % 7}", n, 2) for n in range(0, 300, 11)] + [(None, p, 1) for p in range(50)]
    df = spark.createDataFrame(rows, "k string, pos bigint, a bigint").cache()
    want = {(k, p): sum(a for k2, p2, a in rows if k2 == k and p2 < p) for k, p, _ in rows}
    heavy = shaping.heavy_keys(df, "k", 16)
    assert sorted(str(r[0]) for r in heavy.collect()) == ["None", "hot"]
    for keys in (heavy, None):
        got = shaping.running_by_key(df, "k", "pos", {"before": F.col("a")}, 16, keys)
        assert {(r.k, r.pos): r.before for r in got.collect()} == want
    # keys that aren't heavy have one window and one shuffle, however far apart their rows lie
    plan = shaping.running_by_key(df, "k", "pos", {"before": F.col("a")}, 16)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
