"""Reading, seeding and appending the product catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.utils import AnalysisException

from weftline.plans.lineage import is_missing_path, materialize
from weftline.plans.shaping import nest
from weftline.schemas import PRODUCT
from weftline.sources.json_arrays import array_elements


def read_products(spark: SparkSession, path: str) -> DataFrame:
    """Products from JSON files that each hold one array.

    Missing ``reviews`` read as an empty list. A missing path, a file that is not
    JSON and a file whose document is not an array of objects give no products. Files
    are read in parallel, a large one by many tasks (``json_arrays``).
    """
    try:
        elements = array_elements(spark, path).where("whole")
    except AnalysisException as error:
        if not is_missing_path(error):
            raise
        return spark.createDataFrame([], PRODUCT)
    schema = StructType([*PRODUCT.fields, StructField("_broken", StringType())])
    parsed = elements.select("file", F.from_json("text", schema, {"columnNameOfCorruptRecord": "_broken"}).alias("p"))
    parsed = materialize(parsed.select("file", "p.*"), "products-json")
    # one element that is not JSON makes its file none
    broken = parsed.where("_broken is not null").select("file").distinct()
    fields = [F.col(f.name) for f in PRODUCT.fields if f.name != "reviews"]
    empty = F.array().cast(PRODUCT["reviews"].dataType)
    return parsed.join(broken, "file", "left_anti").select(*fields, F.coalesce("reviews", empty).alias("reviews"))


def write_products(products: DataFrame, path: str, rows_per_file: int = 10_000) -> None:
    """Write products as JSON array files of bounded size."""
    row = F.struct(*[c for c in products.columns])
    grouped = nest(
        products.withColumn("_all", F.lit(0)), ["_all"], row, "items", block_rows=rows_per_file
    )
    grouped.select("block", F.to_json("items").alias("value")).write.mode("error").partitionBy("block").text(path)


def seed_products(products: DataFrame, path: str) -> None:
    """Write the table unless it exists already."""
    products.write.mode("ignore").parquet(path)


def append_rows(rows: DataFrame, path: str) -> None:
    """Append to a table."""
    rows.write.mode("append").parquet(path)
