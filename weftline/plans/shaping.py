"""Skew-safe building blocks: numbering, nesting and running sums.

Each of them has a textbook one-liner that puts a whole group (or the whole
table) into one task. These keep every task bounded and stay exact.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from weftline.plans.lineage import broadcast_if_small, cut, materialize

# monotonically_increasing_id() keeps the row number in the low 33 bits
_ROW_BITS = 33
# items in one array of a nested list
BLOCK_ROWS = 100_000


def dense_number(df: DataFrame, order: Sequence[Column | str], name: str, start: int = 0, stored: bool = False) -> DataFrame:
    """Number all rows 0, 1, 2, ... (plus ``start``) in the given total order.

    The rows are range-sorted over all partitions, each partition numbers its
    own rows, and the partition sizes (one row per partition) give the offsets.
    No task ever sees more than its own range. ``stored``: the sorted rows are written as parquet, which takes
    a fraction of a checkpoint's room, and the result can be read as often as a written table.
    """
    tagged = df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())
    tagged = materialize(tagged, "numbered") if stored else cut(tagged)
    part = F.shiftrightunsigned("_at", _ROW_BITS)
    sizes = tagged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition: the window and the broadcast are bounded by the partition count
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    in_part = F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1)
    return (
        tagged.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + in_part + F.lit(start).cast("long"))
        .drop("_at", "_part", "_offset")
    )


def nest(
    rows: DataFrame,
    keys: Sequence[str],
    item: Column,
    name: str,
    block_rows: int = BLOCK_ROWS,
    lists: bool = False,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Collect ``item`` per key into sorted arrays of at most ``block_rows`` items (columns ``keys, block, name``).

    One rule for every key: its items are numbered in their order, and item n is in block
    n div ``block_rows``, so the blocks of a key put end to end are its sorted list. Keys of one block are
    collected in one shuffle. Items of keys with more (found by a count, few whatever the table) are range-sorted over
    all partitions, copies of one item too, so no task and no array has to hold a whole hot
    group. ``item`` is a struct whose leading fields give the order; ``rows`` should be cheap to read twice.
    ``lists``: ``item`` is a list of items, and its row stands for all of them; the result is that of a row for each.
    ``sizes`` (``keys, _size``) has the items of each key, where they have been counted before.
    """
    keys = list(keys)
    if sizes is None:
        sizes = rows.groupBy(*keys).agg((F.sum(F.size(item)) if lists else F.count(F.lit(1))).alias("_size"))
    large = materialize(sizes.where(F.col("_size") > block_rows).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]), "nest-large")
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    items = rows.select(*keys, item.alias("_item"))
    whole = F.sort_array(F.collect_list("_item")).alias(name)
    together = F.sort_array(F.flatten(F.collect_list("_item"))).alias(name) if lists else whole
    one_block = F.lit(0).cast("long").alias("block")
    if not large.limit(1).count():
        return items.groupBy(*keys, one_block).agg(together)
    # at most a row per ``block_rows`` items
    large = F.broadcast(large)
    small = items.join(large, same, "left_anti").groupBy(*keys, one_block).agg(together)
    items = items.join(large, same, "left_semi")
    items = (items.select(*keys, F.explode("_item").alias("_item")) if lists else items).withColumn("_tie", F.monotonically_increasing_id())
    numbered = dense_number(items, [*keys, "_item", "_tie"], "_n", stored=True).drop("_tie")
    starts = numbered.groupBy(*keys).agg(F.min("_n").alias("_first"))
    starts = materialize(starts.toDF(*[f"_k{i}" for i in range(len(keys))], "_first"), "nest-starts")
    block = F.floor((F.col("_n") - F.col("_first")) / block_rows).alias("block")
    return small.unionByName(numbered.join(F.broadcast(starts), same).groupBy(*keys, block).agg(whole))


def heavy_keys(rows: DataFrame, key: str, bound: int) -> DataFrame | None:
    """Keys (``_key``, their rows ``_n``) with more than ``bound`` rows, and with at least a ten-thousandth of them; None where there are none. ``rows`` is a written table.

    One pass keeps a bounded number of candidates in each task, a second one counts these; no row is shuffled by its key.
    """
    total = rows.count()
    if total <= bound:
        return None
    candidates = rows.stat.freqItems([key], max(bound / total, 1e-4)).first()[0]
    wanted = rows.sparkSession.createDataFrame([(k,) for k in candidates], f"_key {rows.schema[key].dataType.simpleString()}")
    counts = rows.join(F.broadcast(wanted), F.col(key).eqNullSafe(F.col("_key"))).groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    heavy = materialize(counts.where(F.col("_n") > bound), "heavy-keys")
    return heavy if heavy.limit(1).count() else None


def running_by_key(
    rows: DataFrame, key: str, position: str, amounts: dict[str, Column], span: int = 100_000, heavy: DataFrame | None = None
) -> DataFrame:
    """Sum of each amount over the earlier positions of the same key, by one shuffle of the rows.

    Only ``heavy`` keys (``heavy_keys``) are split into spans of positions, as in ``running_before``; where rows of a key lie far apart, spans
    for all keys would be as many as rows.
    """
    if heavy is None:
        before = Window.partitionBy(key).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
        return rows.select(*rows.columns, *[F.coalesce(F.sum(a).over(before), F.lit(0)).alias(n) for n, a in amounts.items()])
    heavy = heavy.select("_key")
    is_heavy = rows.join(F.broadcast(heavy.withColumn("_heavy", F.lit(True))), F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
    split = is_heavy.withColumn("_span", F.when(F.col("_heavy"), F.floor(F.col(position) / span)).otherwise(F.lit(0))).drop("_heavy")
    before = Window.partitionBy(key, "_span").orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    local = split.select(*rows.columns, "_span", *[F.coalesce(F.sum(a).over(before), F.lit(0)).alias(f"_i_{n}") for n, a in amounts.items()])
    # a row per heavy key and span
    spans = split.join(F.broadcast(heavy), F.col(key).eqNullSafe(F.col("_key"))).groupBy("_key", F.col("_span").alias("_at"))
    spans = spans.agg(*[F.sum(a).alias(f"_s_{n}") for n, a in amounts.items()])
    over_spans = Window.partitionBy("_key").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    bases = spans.select("_key", "_at", *[F.coalesce(F.sum(f"_s_{n}").over(over_spans), F.lit(0)).alias(f"_b_{n}") for n in amounts])
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_span") == F.col("_at"))
    return local.join(broadcast_if_small(materialize(bases, "span-sums")), same, "left").select(
        *rows.columns, *[(F.col(f"_i_{n}") + F.coalesce(f"_b_{n}", F.lit(0))).alias(n) for n in amounts]
    )


def running_before(
    rows: DataFrame,
    key: str,
    position: str,
    amounts: dict[str, Column],
    block_span: int = 100_000,
) -> DataFrame:
    """Sum of each amount over the earlier positions of the same key.

    ``position`` is a dense number and unique within a key. Positions are cut
    into spans; sums inside a span and sums of whole spans are separate windows,
    so even a key holding a third of the table is split into bounded groups.
    """
    span = F.floor(F.col(position) / block_span)
    tagged = rows.withColumn("_span", span)
    for name, amount in amounts.items():
        tagged = tagged.withColumn(f"_a_{name}", amount)
    inside = Window.partitionBy(key, "_span").orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    spans = tagged.groupBy(key, "_span").agg(*[F.sum(f"_a_{n}").alias(f"_s_{n}") for n in amounts])
    over_spans = Window.partitionBy(key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    bases = spans.select(
        key, "_span", *[F.coalesce(F.sum(f"_s_{n}").over(over_spans), F.lit(0)).alias(f"_b_{n}") for n in amounts]
    )
    local = tagged.select(
        *rows.columns,
        "_span",
        *[F.coalesce(F.sum(f"_a_{n}").over(inside), F.lit(0)).alias(f"_i_{n}") for n in amounts],
    )
    return local.join(bases, [key, "_span"]).select(
        *rows.columns, *[(F.col(f"_i_{n}") + F.col(f"_b_{n}")).alias(n) for n in amounts]
    )
