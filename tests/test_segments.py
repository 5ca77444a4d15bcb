"""Incremental indexes and counts against those built anew."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import index as I, orders as O, segments as G
from weftline.plans import commits as K
from weftline.plans.lineage import scratch_path
from weftline.streaming import incremental as S

SCHEMA = "dataset string, doc bigint, url string, title string, text string"


@pytest.fixture(autouse=True)
def few_folders(monkeypatch):
    monkeypatch.setattr(G, "BUCKETS", 2)


def tables(index):
    rows = {name: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in frame.select(*columns).collect()), key=repr) for name, frame, columns in (
        ("postings", index.postings, ["dataset", "term", "doc", "count", "total_words", "weight", "mag"]), ("terms", index.terms, ["dataset", "term", "df", "n", "idf"]),
        ("docs", index.docs, ["dataset", "doc", "url", "title", "total_words", "mag"]), ("blocks", index.blocks, ["dataset", "term", "slice", "postings", "best"]),
    )}
    return rows


def batches():
    rng = random.Random(6)
    words = [f"w{k}" for k in range(30)]
    text = lambda: " ".join(rng.choices(words, k=rng.randint(0, 12)))
    first = [("d", i, f"u{i}", "t1", text()) for i in range(30)] + [("e", i, f"e{i}", "t1", text()) for i in range(5)]
    second = [("d", i, f"u{i}", "t2", text()) for i in range(20, 45)] + [("e", 1, "e1", "t2", None)]
    third = [("d", i, f"u{i}", "t3", text()) for i in range(0, 60, 7)] + [("f", 0, "f0", "t3", "only one")]
    return [first, second, third]


def test_index_after_three_batches_equals_the_index_built_anew(spark, tmp_path):
    path, state = str(tmp_path / "index"), {}
    for n, rows in enumerate(batches()):
        removed = [("d", 3), ("d", 999), ("e", 4)] if n == 1 else []
        gone = spark.createDataFrame(removed, "dataset string, doc bigint") if removed else None
        assert G.add_documents(spark, path, spark.createDataFrame(rows, SCHEMA).repartition(2), n, removed=gone)
        state.update({r[:2]: r for r in rows})
        for key in removed:
            state.pop(key, None)
    assert not G.add_documents(spark, path, spark.createDataFrame(batches()[2], SCHEMA), 2)
    want = tables(I.build_index(spark.createDataFrame(list(state.values()), SCHEMA), shards=2))
    assert tables(G.current_index(spark, path, shards=2)) == want
    G.merge_segments(spark, path, 1)  # the newer two; what they replace in the oldest stays noted
    assert [s.level for s in K.read_manifest(spark, path).segments] == [0, 1] and tables(G.current_index(spark, path, shards=2)) == want
    G.merge_segments(spark, path)
    K.remove_unused(spark, path, keep_versions=1)
    manifest = K.read_manifest(spark, path)
    assert len(manifest.segments) == 1 and tables(G.current_index(spark, path, shards=2)) == want
    assert K.read_table(spark, path, manifest.segments, "replaced", G.REPLACED).count() == 0
    # a merged index takes further batches
    assert G.add_documents(spark, path, spark.createDataFrame([("d", 7, "u7", "t4", "w1 new")], SCHEMA), 3)
    state["d", 7] = ("d", 7, "u7", "t4", "w1 new")
    assert tables(G.current_index(spark, path, shards=2)) == tables(I.build_index(spark.createDataFrame(list(state.values()), SCHEMA), shards=2))


def test_last_version_in_a_batch_counts(spark, tmp_path):
    rows = [("d", 1, "u1", "t", "a b", 1), ("d", 1, "u1", "t", "c", 2), ("d", 2, "u2", "t", "a", 1), ("d", 2, "u2", "t", "b", 1), ("d", 3, "u3", "t", "x y", 0)]
    G.add_documents(spark, str(tmp_path / "index"), spark.createDataFrame(rows, SCHEMA + ", version int"), 0)
    want = I.build_index(spark.createDataFrame([("d", 1, "u1", "t", "c"), ("d", 2, "u2", "t", "b"), ("d", 3, "u3", "t", "x y")], SCHEMA), shards=2)
    assert tables(G.current_index(spark, str(tmp_path / "index"), shards=2)) == tables(want)


def test_failed_batch_does_not_show(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    one, two, _ = batches()
    G.add_documents(spark, path, spark.createDataFrame(one, SCHEMA), 0)
    before = tables(G.current_index(spark, path, shards=2))
    monkeypatch.setattr(G, "commit", lambda *args: (_ for _ in ()).throw(RuntimeError("gone")))
    with pytest.raises(RuntimeError):
        G.add_documents(spark, path, spark.createDataFrame(two, SCHEMA), 1)
    monkeypatch.undo()
    assert tables(G.current_index(spark, path, shards=2)) == before
    assert G.add_documents(spark, path, spark.createDataFrame(two, SCHEMA), 1)


def test_links_seen_stay_out_of_memory(spark):
    """Counts over many batches, with links that come again later; segments are merged on the way."""
    path, checkpoint, inbox = (scratch_path(spark, x) for x in ("degrees", "state", "inbox"))
    rng = random.Random(9)
    links = set()
    for n in range(5):
        rows = [(rng.choice("de"), f"s{rng.randrange(8)}", f"t{rng.randrange(5)}") for _ in range(25)]
        spark.createDataFrame(rows, "dataset string, src string, dst string").write.mode("append").parquet(inbox)
        links |= set(rows)
        S.count_in_degrees(spark.readStream.schema("dataset string, src string, dst string").parquet(inbox), path, checkpoint, buckets=3, fan=2)
        want = {}
        for d, _, t in links:
            want[d, t] = want.get((d, t), 0) + 1
        assert {(r.dataset, r.url): r.in_degree for r in S.latest_in_degrees(spark, path).collect()} == want
    manifest = K.read_manifest(spark, path)
    assert manifest.applied == {"links": 4} and len(manifest.segments) < 5
    assert K.read_table(spark, path, manifest.segments, "seen", S.SEEN).select("dataset", "src", "dst").count() == len(links)


def test_late_orders_wait_for_earlier_ones(spark):
    """Batches out of order, within the delay: decisions and stock of one batch in order of time; segments are merged on the way."""
    rng = random.Random(12)
    orders = [(n, f"u{n}" if n % 9 else "", n) for n in range(40)]
    lines = [(n, k, rng.choice([1, 1, 2, 3]), rng.randint(1, 5)) for n in range(40) for k in range(rng.randint(0, 3))]
    carts = spark.createDataFrame(lines, "order_id bigint, line bigint, product_id bigint, quantity bigint").groupBy("order_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("line", "product_id", "quantity"))), lambda x: F.struct(x["product_id"].alias("product_id"), x["quantity"].alias("quantity"))).alias("cart")
    )
    heads = spark.createDataFrame(orders, "order_id bigint, username string, day int")
    requests = heads.select("order_id", "username", F.timestamp_seconds(F.col("day") * 86_400).alias("at")).join(carts, "order_id", "left")
    products = spark.createDataFrame([(1, "one", 30), (2, "two", 12), (3, "three", 9)], "id bigint, name string, stock bigint")
    rows = requests.collect()
    rng.shuffle(rows)
    rows.sort(key=lambda r: r.order_id // 13 * 13 + rng.choice([0, 14]))  # up to about 27 days late
    path, checkpoint, inbox = (scratch_path(spark, x) for x in ("orders", "state", "inbox"))
    for part in (rows[:15], rows[15:28], rows[28:]):
        spark.createDataFrame(part, requests.schema).coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(requests.schema).parquet(inbox)
        S.allocate_orders(stream, products, path, checkpoint, ["at", "order_id"], "30 days", fan=2)
    early = S.stored_decisions(spark, path).count()
    S.decide_waiting(requests.limit(0), products, path, ["at", "order_id"])
    want = O.allocate(requests.select("order_id", "username", "at"), O.cart_lines(requests), products, ["at", "order_id"])
    got = S.stored_decisions(spark, path)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect())) and early < 40
    left = {r.id: r.stock for r in O.stock_after(products, O.cart_lines(requests), want).collect()}
    assert {r.id: r.stock for r in S.stock_now(spark, products, path).collect()} == left
    assert any(s.level for s in K.read_manifest(spark, path).segments)


def test_a_segment_holds_a_row_per_document(spark, tmp_path):
    path = str(tmp_path / "index")
    docs = spark.createDataFrame([("d", 1, "u1", "t", "b a b"), ("d", 2, "u2", "t", "a"), ("d", 3, "u3", "t", "")], "dataset string, doc bigint, url string, title string, text string")
    G.add_documents(spark, path, docs, 0)
    rows = spark.read.parquet(f"{path}/tables/counts").select("doc", "total_words", "terms", "counts").collect()
    assert sorted((r.doc, r.total_words, r.terms, r.counts) for r in rows) == [(1, 3, "a b", [1, 2]), (2, 1, "a", [1])]
    assert {r.term: r.df for r in G.term_sums(spark, path).collect()} == {"a": 2, "b": 1}
