"""Files that each hold one JSON array of objects, read by as many tasks as their size asks for.

A file is cut at closing braces, which Spark's text source does for each byte range on its own. Whether a piece begins inside a string, how deep
it lies and which element it belongs to are running sums over the pieces before it: inside a byte range, and over the ranges'
totals. So no task holds a whole file; an element is put together again from its pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from weftline.plans.lineage import broadcast_if_small, materialize

RANGE = ["file", "range"]


def _signs(text: Column, signs: str) -> Column:
    """Occurrences of any of the signs."""
    return F.length(text) - F.length(F.translate(text, signs, ""))


def _deeper(text: Column) -> Column:
    """Brackets opened less those closed in a piece, strings left out; an unfinished string ends with the piece."""
    outside = F.regexp_replace(text, '(?s)"[^"]*("|$)', "")
    return (_signs(outside, "[{") - _signs(outside, "]")).cast("long")


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, range, at, last, stray, value, quotes, deeper, deeper_inside) of the text between closing braces."""
    rows = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"),
        F.col("_metadata.file_size").alias("size"), F.monotonically_increasing_id().alias("at"), "value",
    )
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    rows = rows.withColumn("_plain", plain).select(
        *RANGE, "size", "at", "value", _signs(F.col("_plain"), '"').cast("long").alias("quotes"),
        _deeper(F.col("_plain")).alias("deeper"), _deeper(F.concat(F.lit('"'), "_plain")).alias("deeper_inside"),
    )
    rows = materialize(rows, "json-pieces")
    # the text after a file's last brace is its last piece; a brace at the very end of the file can only be told by its size
    bytes_cut = F.sum(F.octet_length("value") + 1)
    ends = rows.groupBy("file").agg(F.max(F.struct("range", "at")).alias("_end"), (bytes_cut == F.max("size")).alias("stray"))
    last = F.struct("range", "at") == F.col("_end")
    return rows.join(broadcast_if_small(materialize(ends, "json-ends")), "file").withColumn("last", last).drop("_end", "size")


def _running(rows: DataFrame, amount: Column, name: str) -> DataFrame:
    """The sum of ``amount`` over the earlier pieces of the file."""
    rows = rows.withColumn("_amount", amount)
    totals = rows.groupBy(*RANGE).agg(F.sum("_amount").alias("_total"))
    before = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # one row per byte range of a file
    bases = totals.select(*RANGE, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    bases = broadcast_if_small(materialize(bases, "json-ranges"))
    inside = Window.partitionBy(*RANGE).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.coalesce(F.sum("_amount").over(inside), F.lit(0)))
    return rows.join(bases, RANGE).withColumn(name, F.col("_base") + F.col("_before")).drop("_amount", "_before", "_base")


def array_elements(spark: SparkSession, path: str) -> DataFrame:
    """(file, element, text, whole): the objects of the arrays, numbered from 0 in their file.

    ``whole`` says of each file whether it is one array of objects with nothing but commas and blanks between them; it holds for all rows
    of a file or for none. An empty array has no row.
    """
    rows = _running(_pieces(spark, path), F.col("quotes"), "quotes_before")
    starts_inside, ends_inside = F.col("quotes_before") % 2 == 1, (F.col("quotes_before") + F.col("quotes")) % 2 == 1
    brace = F.when(F.col("last") | ends_inside, F.lit(0)).otherwise(F.lit(1))
    rows = rows.withColumn("brace", brace).withColumn("change", F.when(starts_inside, F.col("deeper_inside")).otherwise(F.col("deeper")) - brace)
    rows = _running(rows, F.col("change"), "depth").withColumn("closes", (F.col("brace") == 1) & (F.col("depth") + F.col("change") == 1))
    rows = _running(rows, F.col("closes").cast("long"), "element")
    pieces = F.array_sort(F.collect_list(F.struct("range", "at", "value")))
    elements = rows.groupBy("file", "element").agg(
        F.array_join(F.transform(pieces, lambda p: p["value"]), "}").alias("joined"), F.max("closes").alias("closed"),
        F.max("stray").alias("stray"), F.max(F.when(F.col("last"), F.col("depth") + F.col("change"))).alias("left_open"),
    )
    elements = materialize(elements, "json-elements")
    # the array's opening bracket, or the comma after the element before
    opening = F.when(F.col("element") == 0, F.lit(r"^[\s\x{feff}]*\[\s*")).otherwise(F.lit(r"^\s*,\s*"))
    text = F.concat(F.regexp_replace("joined", opening, ""), F.lit("}"))
    fine = F.rlike(F.col("joined"), opening) & text.startswith("{")
    rest = F.when(F.col("element") == 0, F.col("joined").rlike(r"^[\s\x{feff}]*\[\s*\]\s*$")).otherwise(F.col("joined").rlike(r"^\s*\]\s*$"))
    checked = elements.select("file", "element", text.alias("text"), "closed", F.when(F.col("closed"), fine).otherwise(rest & (F.col("left_open") == 0) & ~F.col("stray")).alias("_fine"))
    files = checked.groupBy("file").agg((F.min("_fine") & (F.sum(F.when(F.col("closed"), 0).otherwise(1)) == 1)).alias("whole"))
    return checked.where("closed").join(files, "file").select("file", "element", "text", "whole")
