"""Catalogue, reviews, orders and key checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline import bindings as B
from weftline.entries import sql as Q
from weftline.entries.registry import prepared, query
from weftline.functions import numbers as N
from weftline.operators import catalog as C, integrity as K, orders as O, reviews as R
from weftline.plans.lineage import materialize, scratch_path
from weftline.sources import products as P

FLAT = "id, name, price, dim_x, dim_y, dim_z, stock"


def flat(df):
    return df.select(*FLAT.split(", "))


def product_sql(where: str) -> str:
    return f"WITH {Q.PRODUCTS} SELECT {FLAT} FROM products WHERE {where}"


def review_text(column="reviews"):
    """Review lists as text: rating, name and comment of each."""
    return F.array_join(
        F.transform(column, lambda r: F.concat_ws(":", r["rating"].cast("string"), r["name"], r["text"])), " "
    )


REVIEW_LISTS = """review_lists AS (SELECT product_id, block, string_agg(rating || ':' || name || ':' || text, ' ' ORDER BY rating, name, text) AS reviews
  FROM (SELECT *, (row_number() OVER (PARTITION BY product_id ORDER BY rating, name, text) - 1) // 100000 AS block FROM reviews) GROUP BY 1, 2)"""


# ---- sources and sinks -------------------------------------------------------------------------------

@query(
    "src1_product_json",
    f"WITH {Q.PRODUCTS} SELECT id, name, price, to_json(struct_pack(x := dim_x, y := dim_y, z := dim_z))::VARCHAR AS dimensions, stock, 0 AS n_reviews FROM products",
)
def product_json(spark, sf_dir):
    path = scratch_path(spark, "products-json")
    nested = C.nested_dimensions(B.products(spark, sf_dir)).select("id", "name", "price", "dimensions", "stock")
    P.write_products(nested, path, rows_per_file=1000)
    return P.read_products(spark, path).select(
        "id", "name", "price", F.to_json("dimensions").alias("dimensions"), "stock", F.size("reviews").alias("n_reviews")
    )


@query("src2_seed_once", product_sql("true"))
def seed_once(spark, sf_dir):
    path = scratch_path(spark, "products")
    P.seed_products(B.products(spark, sf_dir), path)
    P.seed_products(B.products(spark, sf_dir).withColumn("price", F.lit(0.0)), path)
    return flat(spark.read.parquet(path))


@query("src4_find_product", f"WITH {Q.PRODUCTS} SELECT id, name FROM products WHERE id = (SELECT max(id) FROM products)")
def find_product(spark, sf_dir):
    products = B.products(spark, sf_dir)
    highest = products.agg(F.max("id")).first()[0]
    return products.where(C.id_is(str(highest))).select("id", "name")


@query("src5_all_products", product_sql("true"))
def all_products(spark, sf_dir):
    return flat(B.products(spark, sf_dir))


@query("src5_all_orders", f"WITH {Q.ORDERS} SELECT order_id, username, '/orders/' || order_id AS href FROM heads")
def all_orders(spark, sf_dir):
    return B.orders(spark, sf_dir).select("order_id", "username", F.concat(F.lit("/orders/"), "order_id").alias("href"))


VALID = f"""valid AS (SELECT request_id, {Q.trim('name')} AS name, {Q.number('price')} AS price, {Q.number('x')} AS dim_x, {Q.number('y')} AS dim_y,
  {Q.number('z')} AS dim_z, ({Q.number('stock')})::BIGINT AS stock FROM requests WHERE name <> '' AND {Q.number('price')} >= 0
  AND {Q.number('x')} >= 0 AND {Q.number('y')} >= 0 AND {Q.number('z')} >= 0 AND {Q.number('stock')} >= 0 AND {Q.number('stock')} = floor({Q.number('stock')}))"""


@query(
    "snk3_append_products",
    f"""WITH {Q.PRODUCTS}, {Q.PRODUCT_REQUESTS}, {VALID} SELECT {FLAT} FROM products UNION ALL
    SELECT (SELECT max(id) FROM products) + row_number() OVER (ORDER BY request_id), name, price, dim_x, dim_y, dim_z, stock FROM valid""",
)
def append_products(spark, sf_dir):
    path = scratch_path(spark, "products")
    products = B.products(spark, sf_dir)
    P.seed_products(flat(products), path)
    accepted = C.accepted_products(C.check_products(B.product_requests(spark, sf_dir)))
    P.append_rows(flat(C.row_ids(accepted, ["request_id"], products)), path)
    return flat(spark.read.parquet(path))


@prepared
def order_requests(spark, sf_dir):
    """Orders with their cart as an array, as a request brings them."""
    carts = O.with_carts(B.orders(spark, sf_dir), B.order_lines(spark, sf_dir))
    cart = F.transform("cart", lambda c: F.struct(c["product_id"].alias("product_id"), c["quantity"].alias("quantity")))
    return materialize(carts.select("order_id", "username", "block", cart.alias("cart")), "order-requests")


@query("snk4_append_orders", f"WITH {Q.ORDERS}, {Q.LINES} SELECT order_id, username, product_id, quantity FROM heads JOIN lines USING (order_id)")
def append_orders(spark, sf_dir):
    requests = order_requests(spark, sf_dir)
    heads, lines = scratch_path(spark, "orders"), scratch_path(spark, "carts")
    P.append_rows(O.order_headers(requests), heads)
    P.append_rows(O.cart_lines(requests), lines)
    return spark.read.parquet(heads).join(spark.read.parquet(lines), "order_id").select("order_id", "username", "product_id", "quantity")


@query("snk5_append_reviews", f"WITH {Q.REVIEWS} SELECT product_id, name, rating, text FROM reviews UNION ALL SELECT product_id, name, rating, text FROM reviews")
def append_reviews(spark, sf_dir):
    path = scratch_path(spark, "reviews")
    P.append_rows(B.reviews(spark, sf_dir), path)
    P.append_rows(B.reviews(spark, sf_dir), path)
    return spark.read.parquet(path)


# ---- filters -------------------------------------------------------------------------------------------

def product_filter(name, predicate, where):
    @query(name, product_sql(where))
    def run(spark, sf_dir):
        return flat(B.products(spark, sf_dir).where(predicate()))

    return run


product_filter("flt1_id", lambda: C.id_is("17"), "id = 17")
product_filter("flt2_name_contains", lambda: C.name_contains("WIDG"), "contains(lower(name), 'widg')")
product_filter("flt3_name_pattern", lambda: C.name_like("R_d%t"), "lower(name) LIKE '%r_d%t%'")
product_filter("flt4_name_expression", lambda: C.name_matches(" ^(red|Blue)\\s.*[gt]$ "), "regexp_matches(name, '(?i)^(red|blue)\\s.*[gt]$')")
product_filter("flt5_price_at_most", lambda: C.price_at_most(905.5), "price <= 905.5")
product_filter("flt6_price_range", lambda: C.price_between(902.0, 910.0), "price BETWEEN 902 AND 910")
product_filter("flt6_price_from", lambda: C.price_between(low=0.0), "price >= 0")
product_filter("flt7_dimension_box", lambda: C.inside_box({"x": 20, "z": 6}), "dim_x BETWEEN 0 AND 20 AND dim_z BETWEEN 0 AND 6")
product_filter("flt8_dimension_limits", lambda: C.dimensions_at_most({"x": 0, "y": 3, "z": 6}), "dim_y <= 3 AND dim_z <= 6")
product_filter("flt9_in_stock", C.in_stock, "stock > 0")
product_filter("flt9_stock_mode", lambda: C.stock_mode("INSTOCK"), "stock > 0")
product_filter(
    "flt10_all_of", lambda: C.all_of([C.name_contains("ring"), C.in_stock(), C.price_at_most(920)]),
    "contains(lower(name), 'ring') AND stock > 0 AND price <= 920",
)


@query("flt11_orders_of_user", f"WITH {Q.ORDERS}, {Q.LINES} SELECT order_id, username, count(product_id) AS lines FROM heads LEFT JOIN lines USING (order_id) WHERE username = 'customer 7' GROUP BY 1, 2")
def orders_of_user(spark, sf_dir):
    found = O.find_orders(B.orders(spark, sf_dir), username="customer 7")
    return O.with_carts(found, B.order_lines(spark, sf_dir)).groupBy("order_id", "username").agg(F.sum(F.size("cart")).alias("lines"))


@query("flt12_lines_of_product", f"WITH {Q.LINES} SELECT product_id, quantity FROM lines WHERE product_id = 3")
def lines_of_product(spark, sf_dir):
    return O.find_lines(B.order_lines(spark, sf_dir), product_id=3)


@query("flt13_reviews_by_rating", f"WITH {Q.REVIEWS} SELECT name, rating, text FROM reviews WHERE name = '3' AND rating = 5")
def reviews_by_rating(spark, sf_dir):
    return R.find_reviews(B.reviews(spark, sf_dir), username="3", rating=5)


# ---- projections and joins -------------------------------------------------------------------------------

@query("prj1_addresses", f"WITH {Q.PRODUCTS} SELECT id, '/products/' || id AS href, '/products/' || id || '/reviews' AS reviews_href FROM products")
def addresses(spark, sf_dir):
    return C.with_links(B.products(spark, sf_dir)).select("id", "href", "reviews_href")


@query("prj4_nested_dimensions", f"WITH {Q.PRODUCTS} SELECT id, to_json(struct_pack(x := dim_x, y := dim_y, z := dim_z))::VARCHAR AS dimensions FROM products")
def nested_dimensions(spark, sf_dir):
    return C.nested_dimensions(B.products(spark, sf_dir)).select("id", F.to_json("dimensions").alias("dimensions"))


VIEW = "SELECT id AS product_id, name AS product_name, coalesce(block, 0) AS block, coalesce(reviews, '') AS reviews, '/products/' || id || '/reviews' AS href, '/products/' || id AS product_href FROM products LEFT JOIN review_lists ON product_id = id"


def _view(df):
    return df.select("product_id", "product_name", "block", review_text().alias("reviews"), "href", "product_href")


@query("prj5_reviews_view", f"WITH {Q.PRODUCTS}, {Q.REVIEWS}, {REVIEW_LISTS} {VIEW}")
def reviews_view(spark, sf_dir):
    return _view(R.reviews_view(B.products(spark, sf_dir), B.reviews(spark, sf_dir)))


@query("rev1_reviews_of_product", f"WITH {Q.PRODUCTS}, {Q.REVIEWS}, {REVIEW_LISTS} {VIEW} WHERE id = 11")
def reviews_of_product(spark, sf_dir):
    products = B.products(spark, sf_dir).where(C.id_is(11))
    return _view(R.reviews_view(products, B.reviews(spark, sf_dir).where("product_id = 11")))


@query("rev1_unknown_products", f"WITH {Q.PRODUCTS}, {Q.REVIEWS} SELECT DISTINCT product_id FROM reviews WHERE product_id NOT IN (SELECT id FROM products)")
def unknown_products(spark, sf_dir):
    return R.unknown_products(B.reviews(spark, sf_dir), B.products(spark, sf_dir))


@query("jn1_products_with_reviews", f"WITH {Q.PRODUCTS}, {Q.REVIEWS}, {REVIEW_LISTS} SELECT id, price, coalesce(block, 0) AS block, coalesce(reviews, '') AS reviews FROM products LEFT JOIN review_lists ON product_id = id")
def products_with_reviews(spark, sf_dir):
    return R.with_reviews(B.products(spark, sf_dir), B.reviews(spark, sf_dir)).select("id", "price", "block", review_text().alias("reviews"))


CARTS = f"""{Q.ORDERS}, {Q.LINES}, carts AS (
  SELECT order_id, block, string_agg(line || ':' || product_id || ':' || quantity, ' ' ORDER BY line, product_id, quantity) AS cart
  FROM (SELECT *, (row_number() OVER (PARTITION BY order_id ORDER BY line, product_id, quantity) - 1) // 100000 AS block FROM lines) GROUP BY 1, 2)"""


def _cart_text(column="cart"):
    fields = ("line", "product_id", "quantity")
    return F.array_join(F.transform(column, lambda c: F.concat_ws(":", *[c[f].cast("string") for f in fields])), " ")


@query("jn2_orders_with_carts", f"WITH {CARTS} SELECT order_id, username, coalesce(block, 0) AS block, coalesce(cart, '') AS cart FROM heads LEFT JOIN carts USING (order_id)")
def orders_with_carts(spark, sf_dir):
    return O.with_carts(B.orders(spark, sf_dir), B.order_lines(spark, sf_dir)).select("order_id", "username", "block", _cart_text().alias("cart"))


@query("jn3_priced_lines", f"WITH {Q.PRODUCTS}, {Q.SHIFTED} SELECT order_id, line, product_id, quantity, name, price FROM lines LEFT JOIN products ON id = product_id")
def priced_lines(spark, sf_dir):
    return O.priced_lines(B.shifted_lines(spark, sf_dir), B.products(spark, sf_dir)).drop("stock")


@query("jn3_missing_products", f"WITH {Q.PRODUCTS}, {Q.SHIFTED} SELECT order_id, line, product_id, quantity FROM lines WHERE product_id NOT IN (SELECT id FROM products)")
def missing_products(spark, sf_dir):
    return O.missing_lines(B.shifted_lines(spark, sf_dir), B.products(spark, sf_dir))


@query("ag11_order_totals", f"WITH {Q.PRODUCTS}, {Q.LINES} SELECT order_id, round(sum(price * quantity), 4) AS total FROM lines JOIN products ON id = product_id GROUP BY 1")
def order_totals(spark, sf_dir):
    totals = O.order_totals(O.priced_lines(B.order_lines(spark, sf_dir), B.products(spark, sf_dir)))
    return totals.withColumn("total", F.round("total", 4))


@query("ag12_row_count", "SELECT count(*) AS n FROM part")
def row_count(spark, sf_dir):
    return B.products(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))


# ---- catalogue searches ------------------------------------------------------------------------------------

@query("cat1_box_search", product_sql("contains(lower(name), 'e') AND price <= 950 AND dim_x BETWEEN 0 AND 40 AND dim_y BETWEEN 0 AND 5 AND stock > 0"))
def box_search(spark, sf_dir):
    return flat(C.search_box(B.products(spark, sf_dir), name="E", price=950, dimensions={"x": 40, "y": 5}, in_stock_only=True))


@query(
    "cat2_search_with_reviews",
    f"WITH {Q.PRODUCTS}, {Q.REVIEWS}, {REVIEW_LISTS} SELECT id, name, to_json(struct_pack(x := dim_x, y := dim_y, z := dim_z))::VARCHAR AS dimensions, "
    "coalesce(block, 0) AS block, coalesce(reviews, '') AS reviews FROM products LEFT JOIN review_lists ON product_id = id "
    "WHERE lower(name) LIKE '%r%d%' AND price BETWEEN 900 AND 960 AND dim_x <= 30 AND stock > 0",
)
def search_with_reviews(spark, sf_dir):
    found = C.search_with_reviews(
        B.products(spark, sf_dir), B.reviews(spark, sf_dir), name="r%d", price=(900, 960), dimensions={"x": 30, "y": 0}, in_stock_only=True
    )
    return C.nested_dimensions(found).select("id", "name", F.to_json("dimensions").alias("dimensions"), "block", review_text().alias("reviews"))


@query("cat3_listing", f"WITH {Q.PRODUCTS} SELECT id, name, '/products/' || id AS href FROM products WHERE regexp_matches(name, '(?i)b.l') AND stock > 0")
def listing(spark, sf_dir):
    return C.search_listing(B.products(spark, sf_dir), " B.l ", "inStock").select("id", "name", "href")


# ---- validation and ids ----------------------------------------------------------------------------------------

@query(
    "val1_product_requests",
    f"""WITH {Q.PRODUCT_REQUESTS} SELECT request_id, CASE
      WHEN name = '' THEN 'Missing product name' WHEN NOT coalesce({Q.number('price')} >= 0, false) THEN 'Invalid price'
      WHEN NOT coalesce({Q.number('x')} >= 0 AND {Q.number('y')} >= 0 AND {Q.number('z')} >= 0, false) THEN 'Invalid dimensions'
      WHEN NOT coalesce({Q.number('stock')} >= 0 AND {Q.number('stock')} = floor({Q.number('stock')}), false) THEN 'Invalid stock' END AS error FROM requests""",
)
def product_requests(spark, sf_dir):
    return C.check_products(B.product_requests(spark, sf_dir)).select("request_id", "error")


@query("val1_accepted_products", f"WITH {Q.PRODUCT_REQUESTS}, {VALID} SELECT * FROM valid")
def accepted_products(spark, sf_dir):
    return C.accepted_products(C.check_products(B.product_requests(spark, sf_dir)))


CHECKED = f"""{Q.REVIEW_REQUESTS}, checked AS (SELECT *, CASE WHEN product_id NOT IN (SELECT p_partkey FROM part) THEN 'Product not found'
  WHEN rating NOT BETWEEN 1 AND 10 THEN 'Rating must be a number from 1 to 10' END AS error FROM review_requests)"""


@query("val2_review_requests", f"WITH {CHECKED} SELECT product_id, name, rating::VARCHAR AS rating, error FROM checked")
def review_requests(spark, sf_dir):
    return R.check_reviews(B.review_requests(spark, sf_dir), B.products(spark, sf_dir)).select("product_id", "name", "rating", "error")


@query("val2_accepted_reviews", f"WITH {CHECKED} SELECT product_id, name, rating::DOUBLE AS rating, text FROM checked WHERE error IS NULL")
def accepted_reviews(spark, sf_dir):
    return R.accepted_reviews(R.check_reviews(B.review_requests(spark, sf_dir), B.products(spark, sf_dir))).drop("date")


@query(
    "fn12_lenient_numbers",
    f"WITH {Q.PRODUCT_REQUESTS} SELECT request_id, {Q.number('price')} AS price, {Q.number('z')} AS z, {Q.number('stock')} AS stock, "
    f"coalesce({Q.number('stock')} = floor({Q.number('stock')}), false) AS whole FROM requests",
)
def lenient_numbers(spark, sf_dir):
    number = {c: N.lenient_number(F.col(c)) for c in ("price", "z", "stock")}
    return B.product_requests(spark, sf_dir).select(
        "request_id", *[n.alias(c) for c, n in number.items()], N.is_whole(number["stock"]).alias("whole")
    )


@query("id1_counter_ids", f"WITH {Q.ORDERS} SELECT order_id, row_number() OVER (ORDER BY ordered_at, order_id) - 1 AS id FROM heads")
def counter_ids(spark, sf_dir):
    return C.counter_ids(B.orders(spark, sf_dir), ["ordered_at", "order_id"]).select("order_id", "id")


TRIPLED = "SELECT p_partkey * 3 AS id FROM part"


@query(
    "id2_lowest_free_ids",
    f"""WITH used AS ({TRIPLED}), free AS (SELECT i AS id, row_number() OVER (ORDER BY i) AS k FROM range((SELECT count(*) FROM part) * 2) t(i)
      WHERE i NOT IN (SELECT id FROM used)), fresh AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS k FROM customer)
    SELECT c_custkey, id FROM fresh JOIN free USING (k)""",
)
def lowest_free_ids(spark, sf_dir):
    used = B.table(spark, sf_dir, "part").select((F.col("p_partkey") * 3).alias("id"))
    return C.lowest_free_ids(B.table(spark, sf_dir, "customer").select("c_custkey"), ["c_custkey"], used)


@query("set4_free_ids", f"WITH used AS ({TRIPLED}) SELECT i AS id FROM range((SELECT count(*) FROM part) * 3) t(i) WHERE i NOT IN (SELECT id FROM used)")
def free_ids(spark, sf_dir):
    used = B.table(spark, sf_dir, "part").select((F.col("p_partkey") * 3).alias("id"))
    return spark.range(used.count() * 3).join(used, "id", "left_anti")


@query("id3_row_ids", f"WITH {Q.PRODUCTS} SELECT c_custkey, (SELECT max(id) FROM products) + row_number() OVER (ORDER BY c_custkey) AS id FROM customer")
def row_ids(spark, sf_dir):
    rows = B.table(spark, sf_dir, "customer").select("c_custkey", F.lit(0).alias("id"))
    return C.row_ids(rows, ["c_custkey"], B.products(spark, sf_dir))


# ---- orders ---------------------------------------------------------------------------------------------------------

@query("ord1_plain_intake", f"WITH {Q.ORDERS}, {Q.LINES} SELECT order_id, username, count(*) AS lines, sum(quantity) AS pieces FROM heads JOIN lines USING (order_id) GROUP BY 1, 2")
def plain_intake(spark, sf_dir):
    requests = order_requests(spark, sf_dir)
    sizes = O.cart_lines(requests).groupBy("order_id").agg(F.count(F.lit(1)).alias("lines"), F.sum("quantity").alias("pieces"))
    return O.order_headers(requests).join(sizes, "order_id")


@query(
    "ord2_order_format",
    f"""WITH {Q.ORDERS}, {Q.LINES}, changed AS (SELECT order_id, quantity - 1 AS quantity FROM lines),
    sizes AS (SELECT order_id, min(quantity) AS least FROM changed GROUP BY 1)
    SELECT order_id, CASE WHEN coalesce(least, 0) <= 0 THEN 'Invalid order format' END AS error FROM heads LEFT JOIN sizes USING (order_id)""",
)
def order_format(spark, sf_dir):
    lines = B.order_lines(spark, sf_dir).withColumn("quantity", F.col("quantity") - 1)
    return O.check_orders(B.orders(spark, sf_dir), lines).select("order_id", "error")


@prepared
def decisions(spark, sf_dir):
    """Every order decided against the stock."""
    found = O.allocate(B.orders(spark, sf_dir), B.order_lines(spark, sf_dir), B.stocked_products(spark, sf_dir), ["ordered_at", "order_id"])
    return materialize(found, "decisions")


# rounds over (order, product) rows: accept what fits even if all undecided orders before it are accepted,
# reject what does not fit even if none of them is
ALLOCATION = f"""{Q.ORDERS}, {Q.LINES},
placed AS MATERIALIZED (SELECT order_id, row_number() OVER (ORDER BY ordered_at, order_id) AS pos FROM heads),
need AS MATERIALIZED (SELECT pos, product_id, max(quantity) AS m, sum(quantity) AS s, any_value(p_size) * 20 AS stock
  FROM lines JOIN placed USING (order_id) JOIN part ON p_partkey = product_id GROUP BY 1, 2),
rounds(round, pos, product_id, m, s, stock, state) AS (
  SELECT 0, pos, product_id, m, s, stock, 0 FROM need
  UNION ALL
  SELECT round + 1, pos, product_id, m, s, stock, CASE WHEN state <> 0 THEN state
      WHEN bool_and(stock - hi >= m) OVER o THEN 1 WHEN bool_or(stock - lo < m) OVER o THEN 2 ELSE 0 END
  FROM (SELECT *, coalesce(sum(CASE WHEN state < 2 THEN s ELSE 0 END) OVER p, 0) AS hi,
               coalesce(sum(CASE WHEN state = 1 THEN s ELSE 0 END) OVER p, 0) AS lo
        FROM rounds WHERE (SELECT bool_or(state = 0) FROM rounds)
        WINDOW p AS (PARTITION BY product_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  WINDOW o AS (PARTITION BY pos)),
final AS MATERIALIZED (SELECT pos, product_id, any_value(stock) AS stock, any_value(s) AS s, max(state) AS state FROM rounds GROUP BY 1, 2),
at_turn AS MATERIALIZED (SELECT *, stock - coalesce(sum(CASE WHEN state = 1 THEN s ELSE 0 END) OVER (PARTITION BY product_id ORDER BY pos
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS available FROM final),
first_fail AS (SELECT order_id, first(product_id ORDER BY line, product_id, quantity) AS failed_product
  FROM lines JOIN placed USING (order_id) JOIN at_turn USING (pos, product_id) WHERE state = 2 AND quantity > available GROUP BY 1),
decided AS MATERIALIZED (SELECT order_id, coalesce(state = 1, false) AS accepted, failed_product,
    CASE WHEN state IS NULL THEN 'Invalid order format' WHEN state = 2 THEN 'Insufficient stock for product ' || p_name END AS reason
  FROM placed LEFT JOIN (SELECT DISTINCT pos, state FROM final) USING (pos) LEFT JOIN first_fail USING (order_id)
  LEFT JOIN part ON p_partkey = failed_product)"""


@query("ord3_stock_allocation", f"WITH RECURSIVE {ALLOCATION} SELECT order_id, accepted, reason, failed_product FROM decided")
def stock_allocation(spark, sf_dir):
    return O.allocate(B.orders(spark, sf_dir), B.order_lines(spark, sf_dir), B.stocked_products(spark, sf_dir), ["ordered_at", "order_id"])


# an order with an unknown product has no document
KNOWN_LINES = "known_lines AS (SELECT * FROM lines WHERE order_id NOT IN (SELECT order_id FROM lines WHERE product_id NOT IN (SELECT id FROM products)))"
ITEM_LISTS = f"""{KNOWN_LINES}, item_lists AS (
  SELECT order_id, block, any_value(total) AS total,
    string_agg(line || ':' || product_id || ':' || name || ':' || quantity || ':' || price, ' ' ORDER BY line, product_id, name, quantity) AS items
  FROM (SELECT k.*, name, price, round(sum(price * quantity) OVER (PARTITION BY order_id), 4) AS total,
          (row_number() OVER (PARTITION BY order_id ORDER BY line, product_id, name, quantity) - 1) // 100000 AS block
        FROM known_lines k JOIN products ON id = product_id) GROUP BY 1, 2)"""
ITEMS = f"{Q.PRODUCTS}, {CARTS}, {ITEM_LISTS}"


def _items(df, *more):
    fields = ("line", "product_id", "name", "quantity", "price")
    text = F.array_join(F.transform("items", lambda c: F.concat_ws(":", *[c[f].cast("string") for f in fields])), " ")
    return df.select(*more, "order_id", "username", "block", F.round("total", 4).alias("total"), text.alias("items"))


@query("ord4_order_documents", f"WITH {ITEMS} SELECT order_id, username, block, total, items FROM heads JOIN item_lists USING (order_id)")
def order_documents(spark, sf_dir):
    return _items(O.order_documents(B.orders(spark, sf_dir), B.order_lines(spark, sf_dir), B.products(spark, sf_dir)))


@query("ord4_refused_documents", f"WITH {Q.PRODUCTS}, {Q.ORDERS}, {Q.SHIFTED}, {ITEM_LISTS} SELECT order_id, username, block, total, items FROM heads JOIN item_lists USING (order_id)")
def refused_documents(spark, sf_dir):
    """Documents of orders some of which name an unknown product; these have none."""
    return _items(O.order_documents(B.orders(spark, sf_dir), B.shifted_lines(spark, sf_dir), B.products(spark, sf_dir)))


@query(
    "ord4_order_job",
    f"""WITH RECURSIVE {ALLOCATION}, {Q.PRODUCTS}, {ITEM_LISTS},
    numbered AS (SELECT order_id, username, ordered_at, 99 + row_number() OVER (ORDER BY ordered_at, order_id) AS id FROM heads JOIN decided USING (order_id) WHERE accepted)
    SELECT id, order_id, username, ordered_at, block, total, items FROM numbered JOIN item_lists USING (order_id)""",
)
def order_job(spark, sf_dir):
    """Requests in, stored orders out: decided, numbered, priced and dated."""
    stored, _, _ = O.place_orders(
        B.orders(spark, sf_dir), B.order_lines(spark, sf_dir), B.stocked_products(spark, sf_dir), ["ordered_at", "order_id"], issued=100
    )
    return _items(stored, "id", "ordered_at")


@query(
    "ord5_stock_after",
    f"""WITH RECURSIVE {ALLOCATION}, sold AS (SELECT product_id, sum(quantity) AS n FROM lines JOIN decided USING (order_id) WHERE accepted GROUP BY 1)
    SELECT p_partkey AS id, p_size * 20 - coalesce(n, 0) AS stock FROM part LEFT JOIN sold ON product_id = p_partkey""",
)
def stock_after(spark, sf_dir):
    after = O.stock_after(B.stocked_products(spark, sf_dir), B.order_lines(spark, sf_dir), decisions(spark, sf_dir))
    return after.select("id", "stock")


@query("ord6_order_with_cart", f"WITH {CARTS} SELECT order_id, username, block, cart FROM heads JOIN carts USING (order_id) WHERE order_id = (SELECT max(order_id) FROM lines)")
def order_with_cart(spark, sf_dir):
    lines = B.order_lines(spark, sf_dir)
    wanted = lines.agg(F.max("order_id")).first()[0]
    found = O.find_orders(B.orders(spark, sf_dir), order_id=wanted)
    return O.with_carts(found, lines.where(F.col("order_id") == wanted)).select("order_id", "username", "block", _cart_text().alias("cart"))


# ---- keys -----------------------------------------------------------------------------------------------------------------

@query(
    "chk1_missing_values",
    f"""WITH {Q.PRODUCT_REQUESTS}, r AS (SELECT request_id, nullif(name, '') AS name, z, nullif(stock, '') AS stock FROM requests)
    SELECT request_id, 'name' AS column_name FROM r WHERE name IS NULL UNION ALL
    SELECT request_id, 'z' FROM r WHERE z IS NULL UNION ALL SELECT request_id, 'stock' FROM r WHERE stock IS NULL""",
)
def missing_values(spark, sf_dir):
    rows = B.product_requests(spark, sf_dir).select(
        "request_id", F.nullif("name", F.lit("")).alias("name"), "z", F.nullif("stock", F.lit("")).alias("stock")
    )
    return K.null_violations(rows, ["request_id"], ["name", "z", "stock"])


@query("chk2_duplicate_keys", f"WITH {Q.LINES} SELECT order_id, product_id, count(*) AS copies FROM lines GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return K.duplicate_keys(B.order_lines(spark, sf_dir), ["order_id", "product_id"])


@query("chk3_orphan_lines", f"WITH {Q.PRODUCTS}, {Q.SHIFTED} SELECT order_id, line, product_id, quantity FROM lines WHERE NOT EXISTS (SELECT 1 FROM products WHERE id = product_id)")
def orphan_lines(spark, sf_dir):
    return K.orphans(B.shifted_lines(spark, sf_dir), "product_id", B.products(spark, sf_dir), "id")


@query("chk4_cascade_delete", f"WITH {Q.LINES} SELECT order_id, line, product_id, quantity FROM lines WHERE order_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def cascade_delete(spark, sf_dir):
    deleted = B.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("order_id"))
    return K.cascade_delete(B.order_lines(spark, sf_dir), "order_id", deleted)


@query(
    "chk4_refused_deletes",
    f"WITH {Q.SHIFTED}, {Q.REVIEWS} SELECT p_partkey AS product_id FROM part WHERE p_partkey IN (SELECT product_id FROM lines) OR p_partkey IN (SELECT product_id FROM reviews)",
)
def refused_deletes(spark, sf_dir):
    wanted = B.products(spark, sf_dir).select(F.col("id").alias("product_id"))
    return K.refused_deletes(wanted, "product_id", B.shifted_lines(spark, sf_dir), B.reviews(spark, sf_dir))


@query("chk5_key_updates", f"WITH {Q.LINES} SELECT order_id, line, CASE WHEN p_size > 25 THEN product_id + 1000000 ELSE product_id END AS product_id, quantity FROM lines JOIN part ON p_partkey = product_id")
def key_updates(spark, sf_dir):
    changes = B.table(spark, sf_dir, "part").where("p_size > 25").select(
        F.col("p_partkey").alias("old"), (F.col("p_partkey") + 1000000).alias("new")
    )
    return K.carry_key_updates(B.order_lines(spark, sf_dir), "product_id", changes)
