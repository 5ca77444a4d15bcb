"""Product filters, catalogue searches, validation and id assignment.

Products are flat: ``id, name, price, dim_x, dim_y, dim_z, stock``.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from weftline.functions.numbers import is_finite, is_whole, lenient_number
from weftline.functions.text import trim_white
from weftline.operators.reviews import with_reviews
from weftline.plans.lineage import materialize
from weftline.plans.shaping import dense_number

AXES = ("x", "y", "z")


def id_is(value) -> Column:
    return F.col("id") == F.lit(value).cast("long")


def name_contains(value: str) -> Column:
    """Literal part of the name, case ignored."""
    return F.lower("name").contains(value.lower())


def name_like(value: str) -> Column:
    """SQL pattern anywhere in the name, case ignored; ``%`` and ``_`` in the value are live."""
    return F.like(F.lower("name"), F.lit(f"%{value.lower()}%"), F.lit("\x01"))


def name_matches(value: str) -> Column:
    """Regular expression found in the name, case ignored; the value is trimmed."""
    return F.col("name").rlike("(?i)" + value.strip())


def price_at_most(value: float) -> Column:
    return F.col("price") <= value


def price_between(low: float | None = None, high: float | None = None) -> Column:
    """Price range with optional bounds."""
    bounds = []
    if low is not None:
        bounds.append(F.col("price") >= low)
    if high is not None:
        bounds.append(F.col("price") <= high)
    return all_of(bounds)


def inside_box(limits: Mapping[str, float | None]) -> Column:
    """Each given axis lies between 0 and its limit."""
    return all_of([F.col(f"dim_{a}").between(0, limits[a]) for a in AXES if limits.get(a) is not None])


def dimensions_at_most(limits: Mapping[str, float | None]) -> Column:
    """Each given axis is at most its limit; a limit of 0 counts as none."""
    return all_of([F.col(f"dim_{a}") <= limits[a] for a in AXES if limits.get(a)])


def in_stock() -> Column:
    return F.col("stock") > 0


def stock_mode(mode: str | None) -> Column:
    """``inStock`` in any case keeps products in stock, everything else keeps all."""
    return in_stock() if (mode or "all").lower() == "instock" else F.lit(True)


def all_of(predicates: list[Column]) -> Column:
    """Conjunction of the given predicates; none keeps everything."""
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def search_box(
    products: DataFrame, id=None, name: str | None = None, price: float | None = None,
    dimensions: Mapping[str, float | None] | None = None, in_stock_only: bool = False,
) -> DataFrame:
    """Filter by id, literal name part, highest price, dimension box and stock."""
    tests = []
    if id is not None:
        tests.append(id_is(id))
    if name is not None:
        tests.append(name_contains(name))
    if price is not None:
        tests.append(price_at_most(price))
    if dimensions is not None:
        tests.append(inside_box(dimensions))
    if in_stock_only:
        tests.append(in_stock())
    return products.where(all_of(tests))


def search_with_reviews(
    products: DataFrame, reviews: DataFrame, id=None, name: str | None = None,
    price: tuple[float | None, float | None] | None = None,
    dimensions: Mapping[str, float | None] | None = None, in_stock_only: bool = False,
) -> DataFrame:
    """Filter by id, name pattern, price range, dimension limits and stock; reviews nested."""
    tests = []
    if id is not None:
        tests.append(id_is(id))
    if name:
        tests.append(name_like(name))
    if price:
        tests.append(price_between(*price))
    if dimensions:
        tests.append(dimensions_at_most(dimensions))
    if in_stock_only:
        tests.append(in_stock())
    return with_reviews(products.where(all_of(tests)), reviews)


def search_listing(products: DataFrame, name: str | None = None, stock: str | None = None) -> DataFrame:
    """Filter by name expression and stock mode; adds the address of each product."""
    tests = [stock_mode(stock)]
    if name and name.strip():
        tests.append(name_matches(name))
    return with_links(products.where(all_of(tests)))


def with_links(products: DataFrame) -> DataFrame:
    """Addresses of a product and of its reviews."""
    return products.withColumn("href", F.concat(F.lit("/products/"), "id")).withColumn(
        "reviews_href", F.concat(F.lit("/products/"), "id", F.lit("/reviews"))
    )


def nested_dimensions(products: DataFrame) -> DataFrame:
    """The three axis columns as one struct."""
    box = F.struct(*[F.col(f"dim_{a}").alias(a) for a in AXES])
    return products.withColumn("dimensions", box).drop(*[f"dim_{a}" for a in AXES])


def check_products(requests: DataFrame) -> DataFrame:
    """Add ``error`` to product requests (text fields ``name, price, x, y, z, stock``); null when valid.

    The first failing rule wins: name, price, dimensions, stock. Blank numbers read as 0.
    """
    price, stock = lenient_number(F.col("price")), lenient_number(F.col("stock"))
    axes = all_of([is_finite(lenient_number(F.col(a))) & (lenient_number(F.col(a)) >= 0) for a in AXES])
    error = (
        F.when(F.coalesce(F.col("name"), F.lit("")) == "", F.lit("Missing product name"))
        .when(~F.coalesce(is_finite(price) & (price >= 0), F.lit(False)), F.lit("Invalid price"))
        .when(~F.coalesce(axes, F.lit(False)), F.lit("Invalid dimensions"))
        .when(~F.coalesce(is_whole(stock) & (stock >= 0), F.lit(False)), F.lit("Invalid stock"))
    )
    return requests.withColumn("error", error)


def accepted_products(checked: DataFrame) -> DataFrame:
    """Valid requests as typed products without id."""
    numbers = [lenient_number(F.col(c)).alias(n) for c, n in (("price", "price"), *[(a, f"dim_{a}") for a in AXES])]
    return checked.where("error is null").select(
        "request_id",
        trim_white(F.col("name")).alias("name"),
        *numbers,
        lenient_number(F.col("stock")).cast("long").alias("stock"),
    )


def counter_ids(rows: DataFrame, order: list[str], issued: int = 0) -> DataFrame:
    """Contiguous ids from a counter that has handed out ``issued`` ids so far (the first is 0)."""
    return dense_number(rows, order, "id", issued)


def row_ids(rows: DataFrame, order: list[str], existing: DataFrame) -> DataFrame:
    """Ids after the highest existing one, from 1 in an empty table; ids in the rows are ignored."""
    highest = existing.agg(F.max("id")).first()[0] or 0
    return dense_number(rows.drop("id"), order, "id", highest + 1)


def lowest_free_ids(rows: DataFrame, order: list[str], used: DataFrame) -> DataFrame:
    """The k-th new row gets the k-th unused id, counting from 0."""
    new = materialize(dense_number(rows, order, "_k"), "new-rows")
    taken = materialize(used.select("id").distinct(), "used-ids")
    candidates = rows.sparkSession.range(taken.count() + new.count())
    free = dense_number(candidates.join(taken, "id", "left_anti"), ["id"], "_k")
    return new.join(free, "_k").drop("_k")
