"""Schemas of the tables the jobs read and write."""

from __future__ import annotations

from pyspark.sql import types as T

REVIEW = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("rating", T.DoubleType()),
        T.StructField("text", T.StringType()),
    ]
)
DIMENSIONS = T.StructType([T.StructField(axis, T.DoubleType()) for axis in "xyz"])
PRODUCT = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("dimensions", DIMENSIONS),
        T.StructField("stock", T.LongType()),
        T.StructField("reviews", T.ArrayType(REVIEW)),
    ]
)
CAPTURE = T.StructType(
    [
        T.StructField("dataset", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
        T.StructField("fetched_at", T.TimestampType()),
    ]
)
ORDER_LINE = T.StructType(
    [
        T.StructField("order_id", T.LongType()),
        T.StructField("line", T.LongType()),
        T.StructField("product_id", T.LongType()),
        T.StructField("quantity", T.LongType()),
    ]
)
