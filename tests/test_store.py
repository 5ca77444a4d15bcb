import json
import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import catalog as C, orders as O, reviews as R
from weftline.plans import commits as K
from weftline.sources import pages as P, products as SP

ORDERS = "order_id bigint, username string"
LINES = "order_id bigint, line bigint, product_id bigint, quantity bigint"
PRODUCTS = "id bigint, name string, price double, stock bigint"


def fold(orders, lines, stock, names):
    """One order after the other."""
    left, out = dict(stock), {}
    for order_id, user in orders:
        own = sorted(x[1:] for x in lines if x[0] == order_id)
        if not user or not own or any(q is None or q <= 0 for _, _, q in own):
            out[order_id] = (False, "Invalid order format", None)
            continue
        for _, product, quantity in own:
            if product not in left:
                out[order_id] = (False, f"Product {product} does not exist", product)
                break
            if left[product] < quantity:
                out[order_id] = (False, f"Insufficient stock for product {names[product]}", product)
                break
        else:
            for _, product, quantity in own:
                left[product] -= quantity
            out[order_id] = (True, None, None)
    return out, left


def both_ways(spark, orders, lines, stock, span=O.SPAN):
    names = {p: f"p{p}" for p in stock}
    frames = (
        spark.createDataFrame(orders, ORDERS),
        spark.createDataFrame(lines, LINES),
        spark.createDataFrame([(p, names[p], 1.0, s) for p, s in stock.items()], PRODUCTS),
    )
    got = O.allocate(*frames, ["order_id"], span=span).cache()
    after = {r.id: r.stock for r in O.stock_after(frames[2], frames[1], got).collect()}
    want, left = fold(orders, lines, stock, names)
    assert {r.order_id: (r.accepted, r.reason, r.failed_product) for r in got.collect()} == want
    assert after == left


def test_allocation_by_hand(spark):
    orders = [(1, "a"), (2, "b"), (3, "c"), (4, ""), (5, "e"), (6, "f"), (7, "g")]
    lines = [
        (1, 0, 10, 8), (2, 0, 10, 5), (2, 1, 11, 1), (3, 0, 10, 2), (4, 0, 10, 1), (6, 0, 99, 1), (6, 1, 10, 50),
        # the same product twice: each line fits alone, both are taken
        (7, 0, 11, 3), (7, 1, 11, 3),
    ]
    both_ways(spark, orders, lines, {10: 10, 11: 4})


@pytest.mark.parametrize("seed, span", [(1, O.SPAN), (2, 16)])
def test_allocation_of_random_orders(spark, seed, span):
    rng = random.Random(seed)
    orders = [(i, f"u{i}") for i in range(150)]
    # product 0 takes a third of all lines
    lines = [(i, n, rng.choice([0, 0, 0, *range(1, 9)]), rng.randint(1, 6)) for i in range(150) for n in range(rng.randint(0, 4))]
    both_ways(spark, orders, lines, {p: rng.randint(0, 200) for p in range(8)}, span)


def test_rounds_read_only_what_is_undecided(spark, monkeypatch):
    seen, write = [], O.materialize

    def recorded(df, label, *more):
        written = write(df, label, *more)
        if label == "allocation-round":
            seen.append(written.groupBy("status").count().rdd.collectAsMap())
        return written

    monkeypatch.setattr(O, "materialize", recorded)
    # every order of a chain depends on the one before; 80 others fit at once
    chain = [(i, n, 1000 + i + n, 2) for i in range(6) for n in range(2)]
    both_ways(spark, [(i, "u") for i in range(100)], chain + [(i, 0, i, 1) for i in range(20, 100)], {**{1000 + i: 3 for i in range(8)}, **{i: 1 for i in range(20, 100)}})
    sizes = [sum(s.values()) for s in seen]
    # a row is judged until it is decided, and then no more
    assert len(sizes) > 2 and sizes[0] == 92 and sizes[1] <= 12
    assert all(now == before.get(O.OPEN, 0) for now, before in zip(sizes[1:], seen))


def test_products_from_json(spark, tmp_path):
    item = {"id": 1, "name": "Ring", "price": 2, "dimensions": {"x": 1, "y": 2, "z": 3}, "stock": 0}
    folder = tmp_path / "array"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps([item, {**item, "id": 2, "reviews": [{"name": "n", "rating": 5, "text": "t"}]}], indent=2))
    rows = {r.id: r for r in SP.read_products(spark, str(folder)).collect()}
    assert rows[1].reviews == [] and rows[2].reviews[0].rating == 5.0 and rows[1].dimensions.z == 3.0
    for name, body in (("object", json.dumps(item)), ("broken", "[{oops")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.json").write_text(body)
        assert SP.read_products(spark, str(tmp_path / name)).count() == 0
    assert SP.read_products(spark, str(tmp_path / "nowhere")).count() == 0


def test_written_products_are_files_of_bounded_size(spark, tmp_path):
    rows = spark.range(250).select("id", F.lit("n").alias("name"), F.lit(1.0).alias("price"), F.col("id").alias("stock"))
    SP.write_products(rows, str(tmp_path / "out"), rows_per_file=40)
    assert len(list((tmp_path / "out").glob("block=*"))) > 1
    assert sorted(r.id for r in SP.read_products(spark, str(tmp_path / "out")).collect()) == list(range(250))


def test_product_requests(spark):
    rows = [
        (1, None, "1", "1", "1", "1", "1"), (2, "n", None, "1", "1", "1", "1"), (3, "n", "1", "-1", "1", "1", "1"),
        (4, "n", "1", "1", "1", "1", "1.5"), (5, "  ", "", "1", "1", "1", ""), (6, "", "x", "x", "x", "x", "x"),
    ]
    requests = spark.createDataFrame(rows, "request_id int, name string, price string, x string, y string, z string, stock string")
    checked = C.check_products(requests)
    assert [r.error for r in checked.orderBy("request_id").collect()] == [
        "Missing product name", "Invalid price", "Invalid dimensions", "Invalid stock", None, "Missing product name",
    ]
    only = C.accepted_products(checked).collect()
    assert len(only) == 1 and only[0].name == "" and only[0].price == 0.0 and only[0].stock == 0


def test_review_requests(spark):
    products = spark.createDataFrame([(1, "a", 1.0, 1)], PRODUCTS)
    rows = [(1, "5", "n"), (1, "0", "n"), (1, None, "n"), (1, "10", ""), (2, "bad", "n")]
    requests = spark.createDataFrame(rows, "product_id bigint, rating string, name string").select(
        "*", F.lit("").alias("text"), F.current_timestamp().alias("date")
    )
    checked = R.check_reviews(requests, products)
    wrong = "Rating must be a number from 1 to 10"
    assert {(r.product_id, r.rating): r.error for r in checked.collect()} == {
        (1, "5"): None, (1, "0"): wrong, (1, None): wrong, (1, "10"): None, (2, "bad"): "Product not found",
    }
    assert {(r.rating, r.name, r.text) for r in R.accepted_reviews(checked).collect()} == {(5.0, "n", None), (10.0, None, None)}


def test_lowest_free_ids(spark):
    used = spark.createDataFrame([(0,), (1,), (4,)], "id bigint")
    rows = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "k string")
    got = {r.k: r.id for r in C.lowest_free_ids(rows, ["k"], used).collect()}
    assert got == {"a": 2, "b": 3, "c": 5, "d": 6}


def test_name_filters_differ(spark):
    names = spark.createDataFrame([("100% ring",), ("100x ring",), ("RING",)], "name string")
    assert [r.name for r in names.where(C.name_contains("0% R")).collect()] == ["100% ring"]
    assert sorted(r.name for r in names.where(C.name_like("0% r")).collect()) == ["100% ring", "100x ring"]
    assert sorted(r.name for r in names.where(C.name_matches(" ^.*x r|^ring$ ")).collect()) == ["100x ring", "RING"]


def test_page_upsert_leaves_other_folders_alone(spark, tmp_path):
    path = str(tmp_path / "pages")
    def batch(rows):
        return spark.createDataFrame(rows, "dataset string, url string, content string, t string").select(
            "dataset", "url", "content", F.array(F.lit("x")).alias("outgoing"), F.to_timestamp("t").alias("fetched_at")
        )

    links = spark.createDataFrame([("d", "a", "s"), ("d", "b", "s"), ("d", "a", "a")], "dataset string, src string, dst string")
    P.upsert_pages(spark, path, batch([("d", "a", "1", "2024-01-01"), ("e", "b", "1", "2024-01-01")]), links, buckets=4)
    untouched = {str(f): f.stat().st_mtime_ns for f in (tmp_path / "pages").rglob("*.parquet")}
    P.upsert_pages(spark, path, batch([("d", "a", "2", "2024-01-02"), ("d", "a", "old", "2024-01-01")]), None, buckets=4)
    rows = {(r.dataset, r.url): r for r in P.stored_pages(spark, path).collect()}
    assert set(rows) == {("d", "a"), ("d", "s"), ("e", "b")}
    assert rows["d", "a"].content == "2" and rows["d", "a"].incoming_count == 1
    assert rows["d", "s"].content == "" and rows["d", "s"].incoming_count == 2 and rows["d", "s"].outgoing == []
    after = {str(f): f.stat().st_mtime_ns for f in (tmp_path / "pages").rglob("*.parquet")}
    # a batch writes its own rows only: here the one folder of its one page
    assert untouched.items() <= after.items() and {f.rsplit("/", 2)[-2] for f in after.keys() - untouched.keys()} == {"bucket=" + str(spark.range(1).select(P.bucket_of(F.lit("a"), 4)).first()[0])}


def test_page_store_keeps_its_layout_and_the_newest_capture(spark, tmp_path):
    path = str(tmp_path / "pages")

    def batch(content, day):
        rows = spark.createDataFrame([("d", f"u{k}", content) for k in range(20)], "dataset string, url string, content string")
        return rows.withColumn("outgoing", F.array(F.lit("x"))).withColumn("fetched_at", F.to_timestamp(F.lit(day)))

    links = spark.createDataFrame([("d", "u1", "u2"), ("d", "u1", "u3")], "dataset string, src string, dst string")
    P.upsert_pages(spark, path, batch("new", "2024-01-02"), links, buckets=4)
    P.upsert_pages(spark, path, batch("new", "2024-01-02"), links)  # once more, as after a failure
    P.upsert_pages(spark, path, batch("new", "2024-01-02"), links.where("dst = 'u2'").withColumn("src", F.lit("u9")))
    assert sorted(map(tuple, P.stored_links(spark, path).collect())) == [("d", "u1", "u2"), ("d", "u1", "u3"), ("d", "u9", "u2")]
    P.upsert_pages(spark, path, batch("late", "2024-01-01"))
    with pytest.raises(ValueError):
        P.upsert_pages(spark, path, batch("other", "2024-01-03"), buckets=256)
    pages = P.stored_pages(spark, path).collect()
    assert len(pages) == 20 and {r.content for r in pages} == {"new"}
    one = P.read_page(spark, path, "d", "u7", "url", "content")
    assert [tuple(r) for r in one.collect()] == [("u7", "new")]
    assert "bucket" in one._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1].split("PushedFilters")[0]


def stored(spark, path):
    pages = sorted(tuple(r) for r in P.stored_pages(spark, path).select("dataset", "url", "content", F.array_join("outgoing", " "), "incoming_count").collect())
    return pages, sorted(map(tuple, P.stored_links(spark, path).collect()))


def page_batch(spark, n):
    rows = [("d", f"u{k}", f"{n}", ["x", str(n)], f"2024-01-0{(n * 5) % 9 + 1}") for k in range(n, n + 6)]
    captures = spark.createDataFrame(rows, "dataset string, url string, content string, outgoing array<string>, t string")
    links = spark.createDataFrame([("d", f"u{k}", f"u{k % 3}") for k in range(n, n + 4)], "dataset string, src string, dst string")
    return captures.withColumn("fetched_at", F.to_timestamp("t")).drop("t"), links


def model_store(batches):
    newest, counts, links = {}, {}, set()
    for turn, n in enumerate(batches):
        time = (n * 5) % 9 + 1
        for k in range(n, n + 6):
            newest[f"u{k}"] = max(newest.get(f"u{k}", (0,)), (time, turn, str(n)))
        for k in range(n, n + 4):
            counts[f"u{k % 3}"] = counts.get(f"u{k % 3}", 0) + 1
            links.add(("d", f"u{k}", f"u{k % 3}"))
    pages = []
    for u in newest.keys() | counts.keys():
        content = newest[u][2] if u in newest else ""
        pages.append(("d", u, content, f"x {content}" if content else "", counts.get(u, 0)))
    return sorted(pages), sorted(links)


def test_repeated_batches_and_merged_segments_change_nothing(spark, tmp_path):
    path, order = str(tmp_path / "store"), []
    for n in (3, 0, 7, 1, 5, 2):
        captures, links = page_batch(spark, n)
        number = len(order)
        assert P.upsert_pages(spark, path, captures, links, 4, batch=number, fan=3)
        order.append(n)
        assert stored(spark, path) == model_store(order)
        before = K.read_manifest(spark, path)
        assert not P.upsert_pages(spark, path, captures, links, batch=number) and K.read_manifest(spark, path) == before
    # six batches of level 0, merged by threes
    assert [s.level for s in before.segments] == [1, 1] and before.applied == {"captures": 5}
    P.merge_pages(spark, path)
    assert stored(spark, path) == model_store(order) and len(K.read_manifest(spark, path).segments) == 1
    gone = K.remove_unused(spark, path, keep_versions=1)
    assert len(gone) == 8 and stored(spark, path) == model_store(order)


def test_failure_before_the_manifest_does_not_show(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    P.upsert_pages(spark, path, *page_batch(spark, 0), 4, batch=0)
    before = stored(spark, path)
    for step in ("write_segment", "commit"):
        work = getattr(P, step)

        def fail(*args, work=work, step=step):
            if step == "write_segment":  # pages are written, links are not
                spark_, path_, tables = args
                work(spark_, path_, {"captures": tables["captures"]})
            raise RuntimeError("executor and driver are gone")

        monkeypatch.setattr(P, step, fail)
        with pytest.raises(RuntimeError):
            P.upsert_pages(spark, path, *page_batch(spark, 2), batch=1)
        monkeypatch.setattr(P, step, work)
        assert stored(spark, path) == before
    P.upsert_pages(spark, path, *page_batch(spark, 2), batch=1)
    assert stored(spark, path) == model_store([0, 2])


def test_two_writers_cannot_commit_one_version(spark, tmp_path):
    path = str(tmp_path / "store")
    seen = K.read_manifest(spark, path)
    assert seen.version == -1 and not seen.has("a", 0)
    first = K.commit(spark, path, seen, [], {"a": 0}, {})
    with pytest.raises(K.CommitConflict):
        K.commit(spark, path, seen, [], {"b": 0}, {})
    assert K.read_manifest(spark, path) == first and first.has("a", 0) and not first.has("b", 0)


def test_segments_are_merged_by_level():
    level = lambda *x: [K.Segment(str(n), v, ()) for n, v in enumerate(x)]
    assert K.merge_due([], 3) is None and K.merge_due(level(0, 0), 3) is None
    assert K.merge_due(level(1, 0, 0, 0), 3) == 1 and K.merge_due(level(1, 1, 1), 3) == 0 and K.merge_due(level(2, 1, 1, 0), 2) is None


def test_placed_orders(spark):
    """Accepted orders are numbered in order of arrival and priced; the others leave no trace in documents and stock."""
    orders = spark.createDataFrame([(5, "a", 3), (6, "b", 1), (7, "c", 2), (8, "", 0), (9, "e", 4)], "order_id bigint, username string, at int")
    lines = spark.createDataFrame([(5, 0, 1, 2), (5, 1, 2, 1), (6, 0, 1, 3), (7, 0, 1, 9), (9, 0, 1, 1), (9, 1, 77, 1)], LINES)
    products = spark.createDataFrame([(1, "one", 2.5, 6), (2, "two", 1.0, 1)], "id bigint, name string, price double, stock bigint")
    stored, decisions, stock = O.place_orders(orders, lines, products, ["at", "order_id"], issued=40)
    got = {r.order_id: (r.id, r.at, r.total, [(i.product_id, i.name, i.quantity, i.price) for i in r["items"]]) for r in stored.collect()}
    assert got == {6: (40, 1, 7.5, [(1, "one", 3, 2.5)]), 5: (41, 3, 6.0, [(1, "one", 2, 2.5), (2, "two", 1, 1.0)])}
    assert sorted(r.order_id for r in decisions.where("accepted").collect()) == [5, 6] and decisions.count() == 5
    assert {r.id: r.stock for r in stock.collect()} == {1: 1, 2: 0}
    documents = O.order_documents(orders, lines, products)
    assert sorted(r.order_id for r in documents.collect()) == [5, 6, 7]
