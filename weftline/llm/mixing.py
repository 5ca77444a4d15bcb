"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations alone.

The documents of a source, in an order shuffled by hash, are one stream of words, cut into
blocks of ``BLOCK_WORDS``. A source's target says how many blocks it gives. The slots of the mix are points of a golden-ratio
sequence, mapped through the sources' cumulative shares: so every stretch of the mix holds
the sources close to their shares. The k-th slot of a source takes its k-th block, starting over when
the stream is through; the last block is cut so that the source gives its target to the word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from weftline.llm.common import WORD_PATTERN
from weftline.plans.lineage import materialize
from weftline.plans.shaping import dense_number, running_before

WEIGHTS = (5, 2, 1)
SHARE = 1.5  # of all words
MOST = 2.0  # times a source's own words
BLOCK_WORDS = 1024
CHUNK_ROWS = 4096  # documents, on average, whose running sums are one window
SLOT_SPAN = 65_536  # slots whose ranks are one window
CELLS = 4096  # parts of the unit interval by which slots meet sources

# the sequence i * STEP mod POINTS: STEP / POINTS is the golden ratio's fraction, and products stay in 62 bits
POINTS = 1 << 31
STEP = 1_327_217_885


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long"), F.lit(0).cast("long"))


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source_no, source, source_size, weight, target) of rows (source, size).

    Sources are numbered by code point, null last, and weigh ``weights`` in turn. They share
    ``share`` times all words by weight; what is above ``most`` times a source's words is shared
    again among the others, until none is above.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbered = dense_number(sums, [F.col("source").asc_nulls_last()], "source_no")
    place = (F.col("source_no") % len(weights)).cast("int") + 1
    numbered = numbered.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), place))
    # by the level that caps them: the first source that stays below its cap, with all before it capped, sets the level
    ordered = dense_number(numbered, [F.col("source_size") / F.col("weight"), "source_no"], "turn").withColumn("all", F.lit(0))
    sums_before = {"capped": F.col("source_size"), "lighter": F.col("weight").cast("long")}
    ordered = materialize(running_before(ordered, "all", "turn", sums_before), "mix-sources")
    total, weight = ordered.agg(F.sum("source_size"), F.sum("weight")).first()
    height = (F.lit(share * (total or 0)) - most * F.col("capped")) / (F.lit(weight) - F.col("lighter"))
    free = ordered.withColumn("height", height).where(F.col("height") * F.col("weight") <= most * F.col("source_size"))
    level = free.agg(F.min_by("height", "turn")).first()[0]
    target = most * F.col("source_size")
    if level is not None:
        target = F.least(target, F.col("weight") * F.lit(level))
    return ordered.select("source_no", "source", "source_size", "weight", target.cast("double").alias("target"))


def _streams(sized: DataFrame) -> DataFrame:
    """Documents with the place of their first word in the shuffled stream of their source."""
    chunks = max(1, -(-sized.count() // CHUNK_ROWS))
    head = F.conv(F.substring("shuffled", 1, 8), 16, 10).cast("long")
    rows = sized.withColumn("chunk", F.floor(head * chunks / F.lit(1 << 32)))
    inside = Window.partitionBy("source_no", "chunk").orderBy("shuffled", "doc_id", "size", "text_hash")
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("source_no", "chunk").agg(F.sum("size").alias("words"))
    over = Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("source_no", "chunk", F.coalesce(F.sum("words").over(over), F.lit(0)).alias("base"))
    rows = rows.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return rows.join(bases, ["source_no", "chunk"]).withColumn("start", F.col("start") + F.col("base")).drop("chunk", "base")


def slots(sources: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The schedule: (slot, source_no, rank, epoch, block, words), a row per block that the mix takes."""
    wanted = F.floor("target").cast("long")
    per_epoch = F.ceil(F.col("source_size") / block_words)
    facts = sources.where("source_size > 0").select(
        "source_no", "source_size", wanted.alias("wanted"), per_epoch.alias("per_epoch"),
        (F.floor(wanted / F.col("source_size")) * per_epoch + F.ceil(wanted % F.col("source_size") / block_words)).alias("need"),
    )
    one = F.lit(0)
    facts = materialize(running_before(facts.withColumn("all", one), "all", "source_no", {"before": F.col("need")}), "mix-shares")
    count = facts.agg(F.sum("need")).first()[0] or 0
    scale = POINTS / max(count, 1)
    low = F.floor(F.col("before") * scale)
    after = F.col("before") + F.col("need")
    high = F.when(after == count, F.lit(POINTS)).otherwise(F.floor(after * scale))
    width = POINTS // CELLS
    shares = facts.select("source_no", low.alias("low"), high.alias("high")).where("low < high")
    shares = shares.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))))

    spark = sources.sparkSession
    points = spark.range(count).withColumnRenamed("id", "slot")
    points = points.withColumn("point", (F.col("slot") % POINTS) * STEP % POINTS).withColumn("cell", F.floor(F.col("point") / width))
    dealt = points.join(shares, "cell").where("point >= low and point < high").select("slot", "source_no")
    ranked = running_before(dealt, "source_no", "slot", {"rank": F.lit(1)}, block_span=SLOT_SPAN)
    ranked = materialize(ranked, "mix-slots")
    # the sequence misses a share by a few slots at most; what is missing comes at the end, what is too much goes
    got = ranked.groupBy("source_no").agg(F.count(F.lit(1)).alias("got"))
    short = facts.join(got, "source_no", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < need")
    tail = short.select("source_no", F.explode(F.expr("sequence(got, need - 1)")).alias("rank"))
    tail = tail.select((F.col("rank") + F.lit(count)).alias("slot"), "source_no", "rank")
    taken = ranked.select("slot", "source_no", "rank").unionByName(tail).join(facts.drop("before", "all"), "source_no")
    taken = taken.where("rank < need")
    epoch, block = F.floor(F.col("rank") / F.col("per_epoch")), F.col("rank") % F.col("per_epoch")
    done = epoch * F.col("source_size") + block * block_words
    words = F.least(F.lit(block_words), F.col("source_size") - block * block_words, F.col("wanted") - done)
    return taken.select("slot", "source_no", "rank", epoch.alias("epoch"), block.alias("block"), words.alias("words"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"),
        word_count(F.col(text_col).cast("string")).alias("size"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("shuffled"),
    )


def schedule(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS
) -> DataFrame:
    """The mix as pieces of documents: (doc_id, text_hash, source, size, source_size, target, start, slot, epoch, first, words).

    A row per document and block that takes some of it: words ``first`` to ``first + words - 1`` of the document come in place
    ``slot`` of the mix; documents the mix leaves out have one row with a null slot and 0 words.
    """
    sized = materialize(_sized(docs, id_col, text_col, source_col), "mix-sizes")
    sources = source_targets(sized.select("source", "size"))
    sources = materialize(sources, "mix-targets")
    owned = sized.join(sources.drop("weight").withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    streams = _streams(owned)
    last = F.floor((F.col("start") + F.col("size") - 1) / block_words)
    blocks = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / block_words), last))
    pieces = streams.withColumn("block", F.explode_outer(blocks))
    met = pieces.join(slots(sources, block_words).drop("rank"), ["source_no", "block"], "left")
    begin = F.greatest(F.col("start"), F.col("block") * block_words)
    end = F.least(F.col("start") + F.col("size"), F.col("block") * block_words + F.col("words"))
    words = F.when(F.col("words").isNotNull(), F.greatest(end - begin, F.lit(0))).otherwise(F.lit(0))
    return met.select(
        "doc_id", "text_hash", "source", "size", "source_size", "target", "source_no", "start",
        F.when(words > 0, F.col("slot")).alias("slot"), F.when(words > 0, F.col("epoch")).alias("epoch"),
        F.when(words > 0, begin - F.col("start")).alias("first"), words.alias("words"),
    )


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """What the mix takes of each document: (doc_id, size, source_size, target, taken, first_slot, n_pieces, source, text_hash), a row per row.

    ``size`` counts the words (runs outside space and tab to carriage return), ``taken`` counts repeats; it is
    at most twice the size. A source's ``taken`` add up to its target, rounded down. ``first_slot`` is the place in the schedule
    where the mix first takes words of the document, ``n_pieces`` the number of places. The same rows give the same mix.

    * Null or empty text: size 0, taken 0. Null source: a source of its own, the last. Null ids come first in
      the order of equal hashes.
    * What is not taken has a null first slot and no pieces.
    * Repeated ids: rows are independent; rows that are the same in all columns are interchangeable.
    * Other columns are not read. An empty table, or one without words, takes nothing.
    """
    pieces = schedule(docs, **options)
    own = ["doc_id", "size", "source_size", "target", "source", "text_hash", "source_no", "start"]
    # rows of size 0 share their place with others, and equal ones are told apart by their count
    words = pieces.groupBy(*own).agg(
        F.sum("words").alias("taken"), F.when(F.col("size") > 0, F.lit(1)).otherwise(F.count(F.lit(1))).alias("rows"),
        F.min("slot").alias("first_slot"), F.count("slot").alias("n_pieces"),
    )
    each = words.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows").cast("long"))))
    return each.select(
        "doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), "first_slot", "n_pieces", "source", "text_hash"
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as often as the mix takes them, in the order of the schedule: 0, 1 or 2 times, each at its first slot.

    A document that is cut by a block's end counts as whole. All columns stay as they are, whatever their names; rows that
    repeat id and text come at the same slots. Rows of one slot are in the order of their ids.
    """
    text_col, id_col = options.get("text_col", "text"), options.get("id_col", "doc_id")
    taken = schedule(docs, **options).where("words > 0")
    times = taken.groupBy("doc_id", "text_hash", "epoch").agg(F.min("slot").alias("slot"))
    packed = docs.select(F.struct(*docs.columns).alias("row"))
    own_id, own_text = F.col("row")[id_col].cast("long"), F.col("row")[text_col].cast("string")
    joined = packed.join(times, own_id.eqNullSafe(F.col("doc_id")) & (F.xxhash64(own_text) == F.col("text_hash")))
    ordered = joined.orderBy("slot", "doc_id", "text_hash")
    return ordered.select(*[F.col("row")[c].alias(c) for c in docs.columns])
