"""Prefix trie of conversations, by collapsing whole sequences first.

Turns are numbered by a range sort and known by digests, so texts don't move. The name of a prefix is the exclusive or of one
hash per (place, turn), twice 64 bits: a running value that is put together from spans of bounded size, so
one conversation may hold any share of all turns. Identical conversations become one weighted sequence with the list of those that
end there; sequences that are proper prefixes of others are found by an anti-join, the rest are leaves; then the prefixes of
the distinct sequences are added up.

A subtree's savings are one sum as well: each node belongs to the smallest of its members, and what a member owns is a
tail of its own path. So the words of all nodes below a node are the owned tails of its members, and no node meets its ancestors.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from weftline.llm.mixing import word_count
from weftline.plans.lineage import materialize
from weftline.plans.shaping import dense_number

GROUP = 20  # conversations that borrow from the same one
MOST = 4  # a conversation borrows fewer turns than this
SPAN = 4096  # turns whose running values are one window
KEY = ["depth", "k1", "k2"]
NO_ENDS = hashlib.sha256(b"").hexdigest()


class Trie(NamedTuple):
    """``nodes``: a row per node. ``sequences``: (conv_id, length, weight, k1, k2), a row per distinct conversation, by its
    smallest id. ``ends``: (conv_id, length, k1, k2) of every conversation, which tell in which node it ends."""

    nodes: DataFrame
    sequences: DataFrame
    ends: DataFrame


def _digest(role: Column, text: Column) -> Column:
    return F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)


def _plain(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) without nulls in role and text; rows without a conversation are left out."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    return df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).where(
        F.col("conv_id").isNotNull()
    )


def _halves(digest: Column) -> tuple[Column, Column]:
    return tuple(F.conv(F.substring(digest, at, 15), 16, 10).cast("long").alias(name) for at, name in ((1, "a"), (16, "b")))


def _spans(table: DataFrame, first: Column, last: Column) -> DataFrame:
    """A row per span of SPAN places that a conversation touches, so that joins with its turns stay even."""
    return table.withColumn("span", F.explode(F.sequence(F.floor(first / SPAN), F.floor(last / SPAN))))


def rebuilt_turns(conversations: DataFrame, group: int = GROUP, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """The turns of every rebuilt conversation and their numbers: (conv_id, depth, length, a, b, words), (conv_id, length).

    Conversation c starts with the first h turns of conversation c - c % ``group`` (as many as there are) and goes on with its own
    from h on; h is the CRC32 of c in decimal modulo ``most``. Turns are ordered by ``turn``, null first, equal ones by
    the digest of role and text; ``a`` and ``b`` are 120 bits of that digest.
    """
    rows = _plain(conversations).select("conv_id", "turn", _digest(F.col("role"), F.col("text")).alias("digest"), word_count(F.col("text")).alias("words"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "digest", "_tie"]
    numbered = dense_number(rows.withColumn("_tie", F.monotonically_increasing_id()), order, "n")
    turns = materialize(numbered.select("conv_id", "n", *_halves(F.col("digest")), "words"), "trie-turns")

    sizes = materialize(turns.groupBy("conv_id").agg(F.min("n").alias("first"), F.count(F.lit(1)).alias("size")), "trie-sizes")
    heads = sizes.select(
        "*", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h")
    )
    lent = sizes.select(F.col("conv_id").alias("base"), F.col("size").alias("lent"))
    borrowed = F.least(F.col("h"), F.coalesce("lent", F.lit(0)))
    shapes = heads.join(lent, "base", "left").withColumn("borrowed", borrowed)
    length = F.col("borrowed") + F.greatest(F.col("size") - F.col("h"), F.lit(0))
    shapes = materialize(shapes.withColumn("length", length).drop("lent"), "trie-shapes")

    parts = _spans(shapes, F.col("first"), F.col("first") + F.col("size") - 1)
    placed = turns.withColumn("span", F.floor(F.col("n") / SPAN)).join(parts, ["conv_id", "span"]).withColumn("place", F.col("n") - F.col("first") + 1)
    own = placed.where("place > h").withColumn("depth", F.col("borrowed") + F.col("place") - F.col("h"))
    lend = placed.where((F.col("place") < most) & (F.col("conv_id") == F.col("base"))).select("base", F.col("place").alias("depth"), "a", "b", "words")
    taken = shapes.where("borrowed > 0").select("conv_id", "base", "length", "h").join(lend, "base").where("depth <= h")
    columns = ["conv_id", "depth", "length", "a", "b", "words"]
    return own.select(*columns).unionByName(taken.select(*columns)), shapes.select("conv_id", "length")


def _prefixes(turns: DataFrame) -> DataFrame:
    """The name of the prefix that ends with each turn (k1, k2) and of the one before it (p1, p2), and the words before."""
    rows = turns.withColumn("span", F.floor(F.col("depth") / SPAN))
    rows = rows.withColumn("z1", F.xxhash64("depth", "a")).withColumn("z2", F.xxhash64("depth", "b"))
    rows = materialize(rows, "trie-rebuilt")
    inside = Window.partitionBy("conv_id", "span").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = rows.groupBy("conv_id", "span").agg(F.bit_xor("z1").alias("x1"), F.bit_xor("z2").alias("x2"), F.sum("words").alias("w"))
    before = Window.partitionBy("conv_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    bases = sums.select(
        "conv_id", "span", F.coalesce(F.bit_xor("x1").over(before), zero).alias("b1"),
        F.coalesce(F.bit_xor("x2").over(before), zero).alias("b2"), F.coalesce(F.sum("w").over(before), zero).alias("bw"),
    )
    rows = rows.select("*", F.bit_xor("z1").over(inside).alias("i1"), F.bit_xor("z2").over(inside).alias("i2"), F.sum("words").over(inside).alias("iw"))
    rows = rows.join(bases, ["conv_id", "span"])
    k1, k2 = F.col("i1").bitwiseXOR(F.col("b1")), F.col("i2").bitwiseXOR(F.col("b2"))
    return rows.select(
        "conv_id", "span", "depth", "length", "a", "b", "words", k1.alias("k1"), k2.alias("k2"),
        k1.bitwiseXOR(F.col("z1")).alias("p1"), k2.bitwiseXOR(F.col("z2")).alias("p2"), (F.col("bw") + F.col("iw") - F.col("words")).alias("before"),
    )


def prefix_trie(turns: DataFrame, lengths: DataFrame) -> Trie:
    """The trie of conversations given as (conv_id, depth, length, a, b, words), depth from 1, and (conv_id, length).

    Nodes: depth, k1, k2 (the name of the sequence), conv_id (smallest member), a, b (digest of the last turn), parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, and ends_at: the sequence whose conversations end in the node, or null.

    Conversations without turns end in the root. Without conversations there is no node.
    """
    paths = materialize(_prefixes(turns), "trie-prefixes")
    zero = F.lit(0).cast("long")
    empty = lengths.where("length = 0").select("conv_id", "length", zero.alias("k1"), zero.alias("k2"), zero.alias("total"))
    last = paths.where("depth = length").select("conv_id", "length", "k1", "k2", (F.col("before") + F.col("words")).alias("total"))
    ends = materialize(last.unionByName(empty), "trie-ends")
    sequences = ends.groupBy("length", "k1", "k2").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("weight"), F.max("total").alias("total")
    )
    sequences = materialize(sequences, "trie-sequences")

    # the prefixes of each distinct sequence, the empty one included
    of_spans = _spans(sequences.select("conv_id", "length"), F.lit(0), F.col("length")).drop("length")
    kept = paths.join(of_spans, ["conv_id", "span"], "left_semi").drop("words")
    none = F.lit(None).cast("long")
    roots = sequences.select(
        "conv_id", zero.alias("span"), zero.alias("depth"), "length", none.alias("a"), none.alias("b"),
        zero.alias("k1"), zero.alias("k2"), none.alias("p1"), none.alias("p2"), zero.alias("before"),
    )
    kept = materialize(kept.unionByName(roots), "trie-paths")

    owned = kept.groupBy(*KEY).agg(
        F.min(F.struct("conv_id", "before")).alias("owner"), F.max(F.col("depth") < F.col("length")).alias("inner")
    )
    owned = materialize(owned, "trie-owned")
    inner = owned.where("inner").select(F.col("depth").alias("length"), "k1", "k2")
    leaves = sequences.join(inner, ["length", "k1", "k2"], "left_anti").select("conv_id", F.lit(1).cast("long").alias("leaf"))
    tops = owned.groupBy(F.col("owner.conv_id").alias("conv_id")).agg(F.min(F.struct("depth", "owner.before")).alias("top"))
    facts = sequences.join(tops, "conv_id", "left").join(leaves, "conv_id", "left")
    facts = facts.select("conv_id", "length", "weight", "total", F.col("top.before").alias("top_before"), F.coalesce("leaf", zero).alias("leaf"))
    facts = materialize(facts, "trie-facts")

    rows = kept.join(_spans(facts, F.lit(0), F.col("length")).drop("length"), ["conv_id", "span"])
    repeated = F.col("weight") * (F.col("total") - F.col("before"))
    own_words = F.when(F.col("top_before").isNotNull(), F.col("total") - F.greatest("before", "top_before")).otherwise(zero)
    nodes = rows.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.min("a").alias("a"), F.min("b").alias("b"), F.min("p1").alias("p1"), F.min("p2").alias("p2"),
        F.sum("weight").alias("n_convs"), F.sum("leaf").alias("n_leaves"), F.sum(repeated - own_words).alias("saved_tokens"),
        F.max(F.when(F.col("depth") == F.col("length"), F.col("conv_id"))).alias("ends_at"),
    )
    nodes = materialize(nodes, "trie-nodes")
    parent = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")]
    children = nodes.where("depth > 0").groupBy(*parent).agg(F.count(F.lit(1)).alias("n_children"))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    done = nodes.join(children, KEY, "left").join(above, ["depth", "p1", "p2"], "left")
    done = done.withColumn("n_children", F.coalesce("n_children", zero)).drop("p1", "p2")
    return Trie(done, sequences.drop("total"), ends.drop("total"))


def _digest_runs(batches):
    """(conv_id, ends_sha256) of each run of equal names; runs may go on from batch to batch, and only their digest is held."""
    name, first, running = None, None, None
    for batch in batches:
        names = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:3]], axis=1)
        convs = batch.column(3).to_pylist()
        starts = np.flatnonzero(np.r_[True, (names[1:] != names[:-1]).any(axis=1)]) if len(names) else []
        ids, digests = [], []
        for start, stop in zip(starts, [*starts[1:], len(names)], strict=True):
            own, text = tuple(names[start].tolist()), ",".join(map(str, convs[start:stop])).encode()
            if own == name:
                running.update(b"," + text)
                continue
            if name is not None:
                ids.append(first)
                digests.append(running.hexdigest())
            name, first, running = own, convs[start], hashlib.sha256(text)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.string())], ["conv_id", "ends_sha256"])
    if name is not None:
        yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([running.hexdigest()], pa.string())], ["conv_id", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(conv_id, ends_sha256): SHA-256 of the ascending decimal ids, joined by commas, of the conversations of each sequence.

    A sequence's ids are read in order as a stream, so however many there are, a task holds one digest and one batch.
    """
    ordered = ends.select("length", "k1", "k2", "conv_id").repartition("length", "k1", "k2").sortWithinPartitions("length", "k1", "k2", "conv_id")
    return ordered.mapInArrow(_digest_runs, "conv_id long, ends_sha256 string")


def conversation_trie(conversations: DataFrame, group: int = GROUP, most: int = MOST) -> Trie:
    """The trie of rebuilt conversations (conv_id, turn, role, text).

    * Null role or text is empty. Rows without conv_id take no part. A null turn comes first; equal turns, repeated rows
      included, are turns of their own in the order of their digests.
    * Texts may be of any length: only digests and word counts of them move. Other columns are not read.
    * A conversation that is left without turns ends in the root. An empty table has no node.
    """
    return prefix_trie(*rebuilt_turns(conversations, group, most))


def with_texts(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """``nodes`` with role and text of their last turn (null in the root)."""
    rows = _plain(conversations)
    texts = rows.select(*_halves(_digest(F.col("role"), F.col("text"))), "role", "text").dropDuplicates(["a", "b"])
    return nodes.join(texts, ["a", "b"], "left")
