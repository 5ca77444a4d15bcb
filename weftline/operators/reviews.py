"""Reviews: nesting below products, lookups and validation.

Reviews are rows ``product_id, name, rating, text`` (plus ``date`` where given).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weftline.functions.numbers import is_finite, lenient_number
from weftline.plans.shaping import nest

_ITEM = ("rating", "name", "text")


def find_reviews(reviews: DataFrame, product_id=None, username: str | None = None, rating=None) -> DataFrame:
    """Reviews by product, user and exact rating."""
    found = reviews
    if product_id is not None:
        found = found.where(F.col("product_id") == product_id)
    if username:
        found = found.where(F.col("name") == username)
    if rating is not None:
        found = found.where(F.col("rating") == rating)
    return found.select("name", "rating", "text")


def nested_reviews(reviews: DataFrame) -> DataFrame:
    """Review lists per product, in bounded blocks."""
    return nest(reviews, ["product_id"], F.struct(*_ITEM), "reviews")


def with_reviews(products: DataFrame, reviews: DataFrame) -> DataFrame:
    """Products with their reviews; none reads as an empty list."""
    lists = nested_reviews(reviews)
    empty = F.array().cast(lists.schema["reviews"].dataType)
    return (
        products.join(lists, products.id == lists.product_id, "left")
        .drop("product_id")
        .withColumn("block", F.coalesce("block", F.lit(0)))
        .withColumn("reviews", F.coalesce("reviews", empty))
    )


def reviews_view(products: DataFrame, reviews: DataFrame) -> DataFrame:
    """Review page of each product with its addresses."""
    return with_reviews(products.select("id", "name"), reviews).select(
        F.col("id").alias("product_id"),
        F.col("name").alias("product_name"),
        "block",
        "reviews",
        F.concat(F.lit("/products/"), "id", F.lit("/reviews")).alias("href"),
        F.concat(F.lit("/products/"), "id").alias("product_href"),
    )


def unknown_products(wanted: DataFrame, products: DataFrame) -> DataFrame:
    """Requested product ids that do not exist."""
    return wanted.select("product_id").distinct().join(
        products.select(F.col("id").alias("product_id")), "product_id", "left_anti"
    )


def check_reviews(requests: DataFrame, products: DataFrame) -> DataFrame:
    """Add ``error`` to review requests (``rating`` as text); the product is checked first."""
    known = products.select(F.col("id").alias("product_id"), F.lit(True).alias("_known"))
    rating = lenient_number(F.col("rating"))
    fine = F.coalesce(is_finite(rating) & rating.between(1, 10), F.lit(False))
    return (
        requests.join(known, "product_id", "left")
        .withColumn(
            "error",
            F.when(F.col("_known").isNull(), F.lit("Product not found")).when(
                ~fine, F.lit("Rating must be a number from 1 to 10")
            ),
        )
        .drop("_known")
    )


def accepted_reviews(checked: DataFrame) -> DataFrame:
    """Valid requests as typed reviews; blank reviewer or comment is left out (null)."""
    return checked.where("error is null").select(
        "product_id",
        F.nullif("name", F.lit("")).alias("name"),
        lenient_number(F.col("rating")).alias("rating"),
        F.nullif("text", F.lit("")).alias("text"),
        "date",
    )
