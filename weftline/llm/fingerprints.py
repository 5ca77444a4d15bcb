"""Document fingerprints: the ``k`` smallest hashes of a text's distinct word shingles, in column functions alone.

The smallest hashes of a union are among the smallest hashes of its parts, so sketches of parts of a text,
or of several texts, merge into the sketch of the whole. Two sketches tell how much two texts resemble each other, how much
of one lies in the other, and how many different shingles each has. A hash is the first ``DIGITS`` hexadecimal digits of
the MD5 digest of the shingle's words joined by spaces; a sketch is the ascending array of these.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from weftline.llm.common import WORD_PATTERN
from weftline.plans.lineage import materialize

WIDTH = 5  # words of a shingle
K = 128
DIGITS = 16
PART_WORDS = 4096  # shingles hashed at a time; longer texts are sketched in such parts, and the sketches merged
BLOCK_ROWS = 256  # documents next to each other that share a window

_ROW_BITS = 33  # monotonically_increasing_id() keeps the row number below
_SEPARATORS = WORD_PATTERN.replace("^", "", 1)


def words(text: Column) -> Column:
    """Words of a text, in order; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _SEPARATORS, -1), "")


def _merged(a: Column, b: Column, k: int) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def sketch(word_list: Column, width: int = WIDTH, k: int = K) -> Column:
    """Sketch of an array of words (best a column of its own, as it is read many times).

    Fewer than ``width`` words are one shingle; no words give an empty sketch.
    """
    last = F.greatest(F.size(word_list) - width, F.lit(0))

    def add(found: Column, start: Column) -> Column:
        size = F.least(F.lit(PART_WORDS), last + 1 - start)
        # get() is null behind the last word, and concat_ws leaves nulls out
        part = F.transform(
            F.slice(word_list, start + 1, size),
            lambda word, i: F.md5(F.concat_ws(" ", word, *[F.get(word_list, start + i + n) for n in range(1, width)]).cast("binary")),
        )
        return _merged(found, part, k)

    nothing = F.array().cast("array<string>")
    smallest = F.aggregate(F.sequence(F.lit(0), last, F.lit(PART_WORDS)), nothing, add)
    return F.transform(smallest, lambda digest: F.substring(digest, 1, DIGITS))


def union_sketch(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of two texts, or two parts, together."""
    return _merged(a, b, k)


def shingle_count(a: Column, k: int = K) -> Column:
    """Distinct shingles: exact below ``k``, else estimated from the largest hash kept."""
    place = F.conv(F.substring(F.get(a, F.lit(k - 1)), 1, 15), 16, 10).cast("double") / F.lit(float(1 << 60))
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(float(k - 1)) / place)


def _shared(a: Column, b: Column, both: Column) -> Column:
    return F.size(F.array_intersect(F.array_intersect(both, a), b)).cast("double")


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Shared part of all distinct shingles of two texts, 0 to 1; two texts without words are alike (1)."""
    both = union_sketch(a, b, k)
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(_shared(a, b, both) / F.size(both))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Part of the distinct shingles of ``a`` that ``b`` has too, 0 to 1; what is empty is contained (1)."""
    whole = shingle_count(union_sketch(a, b, k), k)
    part = resemblance(a, b, k) * whole / shingle_count(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), part))


def fingerprint(a: Column) -> Column:
    """A sketch as one string: its hashes put together, ``DIGITS`` digits each."""
    return F.array_join(a, "")


def sketch_of(text: Column) -> Column:
    """The sketch that a fingerprint string holds."""
    places = F.sequence(F.lit(1), F.length(text) - DIGITS + 1, F.lit(DIGITS))
    return F.when(F.length(text) >= DIGITS, F.transform(places, lambda at: F.substring(text, at, DIGITS))).otherwise(F.array().cast("array<string>"))


def merge_sketches(parts: DataFrame, keys: Sequence[str], column: str = "sketch", k: int = K) -> DataFrame:
    """One sketch per key from the sketches of its parts: (keys, column).

    Hashes travel as rows, and Spark limits the ranks before the shuffle, so a key with very many parts stays cheap.
    Null keys are a key of their own; keys without any hash get an empty sketch.
    """
    held = [F.col(key).alias(f"_{i}") for i, key in enumerate(keys)]
    names = [f"_{i}" for i in range(len(keys))]
    rows = parts.select(*held, F.explode_outer(column).alias("_hash")).distinct()
    rank = F.row_number().over(Window.partitionBy(*names).orderBy(F.col("_hash").asc_nulls_last()))
    few = rows.withColumn("_rank", rank).where(F.col("_rank") <= k)
    whole = few.groupBy(*names).agg(F.sort_array(F.collect_list("_hash")).alias("_sketch"))
    return whole.select(*[F.col(n).alias(key) for n, key in zip(names, keys, strict=True)], F.col("_sketch").alias(column))


def document_sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, k: int = K) -> DataFrame:
    """(doc_id, n_chars, sketch) of every row: no shuffle. Other columns are not read; null texts are empty."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    split = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), words(F.col("text")).alias("_words"))
    return split.select("doc_id", "n_chars", sketch(F.col("_words"), width, k).alias("sketch"))


def _in_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, at, block, extra): documents numbered in order, in blocks that end with the document after their last one."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    ordered = rows.orderBy(F.col("doc_id").asc_nulls_last(), F.md5(F.col("text").cast("binary")))
    ordered = materialize(ordered.withColumn("_row", F.monotonically_increasing_id()), "fingerprint-ordered")
    part = F.shiftrightunsigned("_row", _ROW_BITS)
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    # one row per partition: the window and the broadcast are bounded by the number of partitions
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"), F.sum("_size").over(Window.partitionBy()).alias("_all")
    )
    number = F.col("_offset") + F.col("_row").bitwiseAND((1 << _ROW_BITS) - 1)
    numbered = ordered.withColumn("_part", part).join(F.broadcast(offsets), "_part").select("doc_id", "text", number.alias("at"), "_all")
    # the first document also follows the last one
    behind = F.when(F.col("at") == 0, F.col("_all")).otherwise(F.col("at"))
    own = F.struct(F.col("at").alias("at"), F.floor(F.col("at") / BLOCK_ROWS).alias("block"), F.lit(False).alias("extra"))
    extra = F.struct(behind.alias("at"), F.floor((behind - 1) / BLOCK_ROWS).alias("block"), F.lit(True).alias("extra"))
    places = F.when(F.col("at") % BLOCK_ROWS == 0, F.array(own, extra)).otherwise(F.array(own))
    return numbered.select("doc_id", "text", F.explode(places).alias("_place")).select("doc_id", "text", "_place.*")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, k: int = K) -> DataFrame:
    """Each document, its edited text and its successor by their sketches, a row per row.

    (doc_id, n_chars, text, sketch, edited, edited_sketch, next_sketch). The edited text has the last floor(n_chars / 2) code
    points replaced by the first as many (or all) of the next document by ascending id; the first follows the last.

    * A null text is empty. Null ids come last; equal ids, repeated rows included, follow each other by the MD5 of their texts.
    * Texts without words have an empty sketch, texts with fewer words than ``width`` one shingle.
    * A single row is its own successor. An empty table gives an empty result. Other columns are not read.
    """
    near = Window.partitionBy("block").orderBy("at")
    rows = _in_blocks(docs, id_col, text_col).withColumn("_next", F.lead("text").over(near))
    rows = rows.withColumn("_words", words(F.col("text")))
    rows = rows.withColumn("sketch", sketch(F.col("_words"), width, k)).drop("_words")
    rows = rows.withColumn("next_sketch", F.lead("sketch").over(near)).where("not extra")
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("_next", F.lit(1), half))
    rows = rows.withColumn("edited", edited).withColumn("_words", words(F.col("edited")))
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), "text", "sketch",
        "edited", sketch(F.col("_words"), width, k).alias("edited_sketch"), "next_sketch",
    )
