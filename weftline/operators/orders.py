"""Orders: carts, priced documents and exact sequential stock allocation.

Orders are ``order_id, username`` plus arrival columns, lines are
``order_id, line, product_id, quantity``; equal lines of an order are interchangeable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from weftline.plans.lineage import broadcast_if_small, materialize
from weftline.plans.shaping import BLOCK_ROWS, dense_number, heavy_keys, nest, running_by_key

_LINE = ("line", "product_id", "quantity")
# positions per running-sum span of a product with more rows than that; a product has at most one row per position
SPAN = 100_000


def order_headers(requests: DataFrame) -> DataFrame:
    """Headers of order requests (``order_id, username, cart``, and ``block`` where carts come in blocks)."""
    return (requests.where("block = 0") if "block" in requests.columns else requests).select("order_id", "username")


def cart_lines(requests: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Cart lines of order requests, with their place in the whole cart."""
    before = F.col("block") * block_rows if "block" in requests.columns else F.lit(0).cast("long")
    return requests.select("order_id", before.alias("_before"), F.posexplode("cart").alias("line", "_item")).select(
        "order_id", (F.col("_before") + F.col("line")).alias("line"), "_item.product_id", "_item.quantity"
    )


def find_orders(orders: DataFrame, order_id=None, username: str | None = None) -> DataFrame:
    """Orders by id and user."""
    found = orders
    if order_id is not None:
        found = found.where(F.col("order_id") == order_id)
    if username:
        found = found.where(F.col("username") == username)
    return found


def find_lines(lines: DataFrame, order_id=None, product_id=None) -> DataFrame:
    """Cart lines by order and product."""
    found = lines
    if order_id is not None:
        found = found.where(F.col("order_id") == order_id)
    if product_id is not None:
        found = found.where(F.col("product_id") == product_id)
    return found.select("product_id", "quantity")


def with_carts(orders: DataFrame, lines: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Orders with their lines nested, a row per block of the cart; an order without lines has an empty cart."""
    carts = nest(lines, ["order_id"], F.struct(*_LINE), "cart", block_rows)
    empty = F.array().cast(carts.schema["cart"].dataType)
    return (
        orders.join(carts, "order_id", "left")
        .withColumn("block", F.coalesce("block", F.lit(0)))
        .withColumn("cart", F.coalesce("cart", empty))
    )


def check_orders(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Add ``error`` to orders without name, without lines or with a missing or non-positive quantity."""
    sizes = lines.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("_lines"),
        F.bool_or(~F.coalesce(F.col("quantity") > 0, F.lit(False))).alias("_bad"),
    )
    bad = (
        (F.coalesce("username", F.lit("")) == "") | F.col("_lines").isNull() | F.coalesce("_bad", F.lit(False))
    )
    return (
        orders.join(sizes, "order_id", "left")
        .withColumn("error", F.when(bad, F.lit("Invalid order format")))
        .drop("_lines", "_bad")
    )


def priced_lines(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Lines with name and price of their product; both are null for a missing product."""
    priced = products.select(F.col("id").alias("product_id"), "name", "price", "stock")
    return lines.join(priced, "product_id", "left")


def missing_lines(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Lines whose product does not exist."""
    return lines.join(products.select(F.col("id").alias("product_id")), "product_id", "left_anti")


def order_totals(priced: DataFrame) -> DataFrame:
    """Sum of price times quantity per order."""
    return priced.groupBy("order_id").agg(F.sum(F.col("price") * F.col("quantity")).alias("total"))


def order_documents(orders: DataFrame, lines: DataFrame, products: DataFrame) -> DataFrame:
    """Orders with items as bought (name and price at order time) and total; an order with an unknown product is refused as a whole."""
    facts = products.select(F.col("id").alias("product_id"), "name", "price", F.lit(True).alias("_known"))
    priced = materialize(lines.join(facts, "product_id", "left"), "priced-lines")
    refused = materialize(priced.where("_known is null").select("order_id").distinct(), "refused-orders")
    priced = priced.drop("_known")
    if refused.limit(1).count():
        priced = priced.join(broadcast_if_small(refused), "order_id", "left_anti")
    items = nest(priced, ["order_id"], F.struct("line", "product_id", "name", "quantity", "price"), "items")
    return orders.join(order_totals(priced), "order_id").join(items, "order_id")


def place_orders(
    orders: DataFrame, lines: DataFrame, products: DataFrame, arrival: list[str], issued: int = 0
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From requests to stored orders: documents of the accepted orders, the decision on every order, and the stock after them.

    Orders are decided in order of ``arrival`` (``allocate``). Accepted ones get ids (column ``id``) from a counter that has handed out
    ``issued`` ids so far, and become documents with priced items and total; their columns, the date among them, stay.
    """
    decisions = materialize(allocate(orders, lines, products, arrival), "placed-decisions")
    accepted = decisions.where("accepted").select("order_id")
    numbered = dense_number(orders.join(accepted, "order_id"), arrival, "id", issued, stored=True)
    taken = lines.join(accepted, "order_id", "left_semi")
    return order_documents(numbered, taken, products), decisions, stock_after(products, lines, decisions)


# what a round has found out about an order
OPEN, ACCEPTED, REJECTED = 0, 1, 2


def allocate(
    orders: DataFrame, lines: DataFrame, products: DataFrame, arrival: list[str], span: int = SPAN
) -> DataFrame:
    """Decide every order as if they came one after the other: ``order_id, accepted, reason, failed_product``.

    An order is accepted if each of its lines, taken alone, fits the stock left by
    the accepted orders before it; then all its lines are taken. A rejected order
    changes nothing. ``reason`` tells of the first failing line.

    Rounds narrow two bounds on the stock taken before an order: by accepted
    orders (at least that) and by accepted or undecided ones (at most that).
    An order that fits the second bound is accepted, one that misses the first
    is rejected. The earliest undecided order has equal bounds, so each round
    decides some, in practice nearly all. A round reads the rows of undecided orders,
    and those accepted in the round before, which are taken off the stock left to later rows and go then.
    """
    checked = check_orders(orders.select(*dict.fromkeys(["order_id", "username", *arrival])), lines)
    kept = checked.select(*dict.fromkeys(["order_id", *arrival]), "error")
    by_place = materialize(dense_number(kept, arrival, "pos", stored=True).select("order_id", "pos", "error"), "orders")
    demand = (
        lines.join(by_place.where("error is null").select("order_id", "pos"), "order_id")
        # the join has put the lines of an order together
        .groupBy("order_id", "pos", "product_id")
        # ``other``: what the lines but the largest add, mostly 0, which takes no room in shuffles
        .agg(F.sum("quantity").alias("amount"), (F.sum("quantity") - F.max("quantity")).alias("other"))
        .drop("order_id")
    )
    demand = materialize(demand, "demand")
    heavy = heavy_keys(demand, "product_id", span)
    state = _with_stock(demand, products, heavy).withColumnRenamed("stock", "left").withColumn("status", F.lit(OPEN))
    decided = None
    while True:
        judged = materialize(_allocation_round(state, span, heavy), "allocation-round")
        found = judged.where(F.col("status") != OPEN).drop("left")
        decided = found if decided is None else decided.unionByName(found)
        if not judged.where(F.col("status") == OPEN).limit(1).count():
            return _explain_decisions(by_place, lines, products, decided, span, heavy)
        state = judged.where(F.col("status") != REJECTED)


def _with_stock(rows: DataFrame, products: DataFrame, heavy: DataFrame | None) -> DataFrame:
    """Rows with the stock of their product, null for a missing one."""
    stocked = rows.join(products.select(F.col("id").alias("product_id"), "stock"), "product_id", "left")
    # running sums by product go on in the layout of the join; heavy products are split by it and written first
    return stocked if heavy is None else materialize(stocked, "stocked")


def _allocation_round(state: DataFrame, span: int, heavy: DataFrame | None) -> DataFrame:
    """The open rows of ``state`` with the stock left to them at most (``left``) and the ``status`` of their orders."""
    taken = F.when(F.col("status") == ACCEPTED, F.col("amount")).otherwise(F.lit(0))
    bounds = running_by_key(state, "product_id", "pos", {"most": F.col("amount"), "least": taken}, span, heavy)
    largest, left = F.col("amount") - F.col("other"), F.col("left") - F.col("least")
    fits, fails = F.col("left") - F.col("most") >= largest, F.coalesce(left < largest, F.lit(True))
    alone = F.when(fails, F.lit(REJECTED)).when(fits, F.lit(ACCEPTED)).otherwise(F.lit(OPEN))
    rows = bounds.where(F.col("status") == OPEN).select("pos", "product_id", "amount", "other", left.alias("left"), alone.alias("status"))
    order = Window.partitionBy("pos")
    worst, least = F.max("status").over(order), F.min("status").over(order)
    return rows.withColumn("status", F.when(worst == REJECTED, worst).otherwise(least))


def _explain_decisions(
    by_place: DataFrame, lines: DataFrame, products: DataFrame, decided: DataFrame, span: int, heavy: DataFrame | None
) -> DataFrame:
    winners = decided.where(F.col("status") == ACCEPTED).select("pos").distinct().withColumn("won", F.lit(True))
    sold = F.when(F.col("status") == ACCEPTED, F.col("amount")).otherwise(F.lit(0))
    turns = running_by_key(_with_stock(decided, products, heavy), "product_id", "pos", {"before": sold}, span, heavy)
    short = (
        turns.select("pos", "product_id", (F.col("amount") - F.col("other")).alias("largest"), "status", (F.col("stock") - F.col("before")).alias("left"))
        .where((F.col("status") == REJECTED) & F.coalesce(F.col("left") < F.col("largest"), F.lit(True)))
        .join(by_place.select("pos", "order_id"), "pos")
        .select(F.col("order_id").alias("_order"), F.col("product_id").alias("_product"), "left")
    )
    failing = (
        lines.join(short, (F.col("order_id") == F.col("_order")) & F.col("product_id").eqNullSafe(F.col("_product")))
        .where("left is null or quantity > left")
        .groupBy("order_id")
        .agg(
            F.min_by(
                F.struct("product_id", F.col("left").isNull().alias("absent")),
                F.struct("line", "product_id", "quantity"),
            ).alias("first")
        )
        .select("order_id", F.col("first.product_id").alias("failed_product"), F.col("first.absent").alias("absent"))
    )
    names = products.select(F.col("id").alias("failed_product"), "name")
    reason = (
        F.when(F.col("accepted"), F.lit(None).cast("string"))
        .when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("absent"), F.concat(F.lit("Product "), "failed_product", F.lit(" does not exist")))
        .otherwise(F.concat(F.lit("Insufficient stock for product "), "name"))
    )
    return (
        by_place.join(winners, "pos", "left")
        .withColumn("accepted", F.coalesce("won", F.lit(False)))
        .join(failing, "order_id", "left")
        .join(names, "failed_product", "left")
        .select("order_id", "accepted", reason.alias("reason"), "failed_product")
    )


def lower_stock(products: DataFrame, sold: DataFrame) -> DataFrame:
    """Products with their stock lowered by what was sold (``product_id, amount``)."""
    return (
        products.join(sold, products.id == sold.product_id, "left")
        .withColumn("stock", F.col("stock") - F.coalesce("amount", F.lit(0)))
        .drop("product_id", "amount")
    )


def stock_after(products: DataFrame, lines: DataFrame, decisions: DataFrame) -> DataFrame:
    """Products with their stock lowered by all lines of the accepted orders."""
    taken = lines.join(decisions.where("accepted").select("order_id"), "order_id", "left_semi")
    return lower_stock(products, taken.groupBy("product_id").agg(F.sum("quantity").alias("amount")))
