"""Near-duplicate documents: MinHash bands propose, odd sketches sift, full shingle sets decide.

Every document gives the set of its shingles, ``SAMPLES`` MinHash samples of it,
band keys over the first samples, and an odd sketch: the samples folded into a parity
bitmap. The number of ones in the exclusive or of two bitmaps estimates the
similarity with a standard error of about 0.03 where similarities are high, so pairs far below the
limit are put aside without looking at their texts; all others are decided on full sets.

What moves stays linear in groups of copies: documents with equal sets become one node,
and a bucket first proposes each member to its leader only (not all pairs). Buckets
that still hold several components go to tiles of bounded size, first with bitmaps, then
with the texts of those members that bitmaps leave a partner in the tile; a tile joins the components
it finds linked and gives back one link for each joining, at most one less than it has members. So no link between different
components is missed among documents that share a band.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weftline.llm.common import bound_batches, free_worker, id_and_text, mix64, shingle_set, text_bytes, thin_out
from weftline.llm.components import components
from weftline.plans.lineage import materialize

SAMPLES = 256  # MinHash samples in a sketch
BANDS, BAND_ROWS = 24, 4  # a pair of similarity 0.8 shares no band with probability 3e-6
BITMAP_BITS = 512
SIFT_BELOW = 0.62  # estimated similarity under which a pair is put aside: six standard errors under 0.8
TILE, TILE_SHINGLES = 1024, 2_000_000  # half of the members, and of their shingles, that meet in one tile

_rng = np.random.default_rng(20240229)
_MUL = (_rng.integers(0, 1 << 31, SAMPLES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)
_TAG = mix64(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
_BAND_TAG = mix64(np.arange(7, 7 + BANDS, dtype=np.uint64) * np.uint64(0x165667B19E3779F9))

SKETCH = "doc_id long, n_shingles long, digest binary, bands array<long>, bitmap array<long>"


def min_samples(shingles: np.ndarray) -> np.ndarray:
    """SAMPLES minima of the set, each under its own order of the hash values."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(SAMPLES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(low), 2048):
        part = np.multiply.outer(_MUL, low[at : at + 2048])
        part += _ADD[:, None]
        np.minimum(best, part.min(axis=1), out=best)
    return best


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity bitmap of the (place, sample) pairs, as 64-bit words."""
    place = (mix64(samples.astype(np.uint64) + _TAG) >> np.uint64(55)).astype(np.int64)
    parity = (np.bincount(place, minlength=BITMAP_BITS) & 1).astype(np.uint8)
    return np.packbits(parity).view(np.int64)


def band_keys(samples: np.ndarray) -> np.ndarray:
    rows = samples[: BANDS * BAND_ROWS].astype(np.uint64).reshape(BANDS, BAND_ROWS)
    key = _BAND_TAG.copy()
    for k in range(BAND_ROWS):
        key = mix64(key + rows[:, k] * np.uint64(0x9E3779B97F4A7C15))
    return key.view(np.int64)


def differing_bits(similarity: float) -> int:
    """Ones expected in the exclusive or of the bitmaps of two sets of this similarity."""
    return int(BITMAP_BITS / 2 * (1 - np.exp(-4 * SAMPLES * (1 - similarity) / BITMAP_BITS)))


def _sketcher(width: int):
    def sketch(batches):
        free_worker()
        for batch in batches:
            out = {k: [] for k in ("doc_id", "n_shingles", "digest", "bands", "bitmap")}
            for doc, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                found = shingle_set(text, width)
                out["doc_id"].append(doc)
                out["n_shingles"].append(len(found))
                if len(found):
                    samples = min_samples(found)
                    out["digest"].append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                    out["bands"].append(band_keys(samples))
                    out["bitmap"].append(odd_sketch(samples))
                else:
                    for name in ("digest", "bands", "bitmap"):
                        out[name].append(None)
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))

    return sketch


def _linker(width: int, percent: int):
    def link(batches):
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            left, right = text_bytes(batch.column(2)), text_bytes(batch.column(3))
            keep, last, last_set = [], None, None
            for k in range(batch.num_rows):
                if left[k] != last or last_set is None:  # rows of one leader often come together
                    last, last_set = left[k], shingle_set(left[k], width)
                other = shingle_set(right[k], width)
                both = len(np.intersect1d(last_set, other, assume_unique=True))
                if both and 100 * both >= percent * (len(last_set) + len(other) - both):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays(
                [pa.array([a[k] for k in keep], pa.int64()), pa.array([b[k] for k in keep], pa.int64())], ["a", "b"]
            )

    return link


def _bits_apart(x: str, y: str):
    return F.expr(f"aggregate(zip_with({x}, {y}, (p, q) -> bit_count(p ^ q)), 0, (s, c) -> s + c)")


def _sift(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and bitmaps allow the similarity."""
    side = sketches.select(F.col("doc_id"), "n_shingles", "bitmap")
    both = pairs.join(side.toDF("a", "na", "ma"), "a").join(side.toDF("b", "nb", "mb"), "b")
    sizes = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    return both.where(sizes).where(_bits_apart("ma", "mb") <= differing_bits(SIFT_BELOW)).select("a", "b")


class _Tile:
    """Members that meet in one tile, and which of them may be linked by sizes and bitmaps."""

    def __init__(self, frame: pd.DataFrame, percent: int):
        self.percent = percent
        key, self.low, self.high = (int(frame[c].iloc[0]) for c in ("key", "low", "high"))
        self.ids, self.sizes, self.block = (frame[c].to_numpy() for c in ("doc_id", "n_shingles", "block"))
        self.words = np.array(frame["bitmap"].tolist(), dtype=np.int64).view(np.uint64)
        self.bands = np.array(frame["bands"].tolist(), dtype=np.int64)
        self.before = np.arange(BANDS) < np.argmax(self.bands == key, axis=1).max()
        self.comp = np.unique(frame["component"].to_numpy(), return_inverse=True)[1]

    def partners(self, i: int) -> np.ndarray:
        """Later members of other components that ``i`` may be linked with."""
        fits = (self.comp != self.comp[i]) & (np.arange(len(self.ids)) > i)
        if self.low != self.high:
            fits &= self.block != self.block[i]
        fits &= 100 * np.minimum(self.sizes, self.sizes[i]) >= self.percent * np.maximum(self.sizes, self.sizes[i])
        at = np.flatnonzero(fits)
        at = at[np.bitwise_count(self.words[at] ^ self.words[i]).sum(axis=1) <= differing_bits(SIFT_BELOW)]
        # a pair that shares an earlier band as well is decided in that band's bucket
        return at[~((self.bands[at] == self.bands[i]) & self.before).any(axis=1)]


def _sifter(percent: int):
    """Members of one tile that may be linked with another one there; only their texts are fetched."""

    def sift(frame: pd.DataFrame) -> pd.DataFrame:
        tile = _Tile(frame, percent)
        fits = np.zeros(len(frame), dtype=bool)
        for i in range(len(frame)):
            at = tile.partners(i)
            if len(at):
                fits[i] = True
                fits[at] = True
        return frame.loc[fits, ["key", "low", "high", "doc_id"]].drop_duplicates()

    return sift


def _joiner(width: int, percent: int):
    """Joins the components of one tile; gives the links it used."""

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "block"], kind="stable").reset_index(drop=True)
        tile = _Tile(frame, percent)
        ids, comp = tile.ids, tile.comp
        sets = [shingle_set(t.encode(), width) for t in frame["text"]]
        # postings: members by shingle, so one pass over a member's shingles counts its overlap with all others
        member = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        shingles, place = np.unique(np.concatenate(sets), return_inverse=True)
        holders = member[np.argsort(place, kind="stable")]
        first = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=len(shingles)))])
        ends = np.cumsum([len(x) for x in sets])
        out = []
        for i in range(len(sets)):
            at = tile.partners(i)
            if not len(at):
                continue
            own = place[ends[i] - len(sets[i]) : ends[i]]
            runs = first[own + 1] - first[own]
            spots = np.repeat(first[own] - np.concatenate([[0], np.cumsum(runs)[:-1]]), runs) + np.arange(runs.sum())
            both = np.bincount(holders[spots], minlength=len(sets))[at]
            for j in at[100 * both >= percent * (len(sets[i]) + np.array([len(sets[j]) for j in at]) - both)]:
                if comp[j] != comp[i]:
                    out.append((ids[i], ids[j]))
                    comp[comp == comp[j]] = comp[i]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return join


class _Links:
    """Verified links so far and the components they make."""

    def __init__(self, texts: DataFrame, sketches: DataFrame, width: int, percent: int):
        self.texts, self.sketches, self.width, self.percent = texts, sketches, width, percent
        self.links: DataFrame | None = None
        self.component: DataFrame | None = None  # (node, component)

    def decide(self, pairs: DataFrame) -> None:
        """Decide pairs (a, b) on full sets and join the components."""
        left = self.texts.toDF("a", "left_text")
        right = self.texts.toDF("b", "right_text")
        both = pairs.join(right, "b").join(left, "a").select("a", "b", "left_text", "right_text")
        self.add(both.mapInArrow(_linker(self.width, self.percent), "a long, b long"))

    def add(self, found: DataFrame) -> None:
        """Join what the links (a, b) connect; earlier components stand for their links."""
        if self.component is not None:
            found = found.unionByName(self.component.toDF("a", "b"))
        self.component = materialize(components(found), "near-components")

    def labelled(self, members: DataFrame) -> DataFrame:
        """Members with their component so far."""
        if self.component is None:
            return members.withColumn("component", F.col("doc_id"))
        known = self.component.withColumnRenamed("node", "doc_id")
        return members.join(known, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))


def _open_buckets(members: DataFrame) -> DataFrame:
    """Members of buckets that hold more than one component besides the leader, who has met all."""
    rows = members.where("doc_id != leader")
    spans = rows.groupBy("key").agg(F.min("component").alias("_least"), F.max("component").alias("_most"))
    return rows.join(spans.where("_least != _most").select("key"), "key")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """Sets, components and survivors: (doc_id, n_shingles, component_id, kept), a row per row of ``docs``.

    Words are the runs of characters outside space and tab to carriage return, A-Z read as
    a-z; a document's set holds its distinct ``width``-word shingles (with fewer words the
    whole sequence is the one shingle). Documents are linked when
    100 * |intersection| >= percent * |union|; ``component_id`` is the smallest id that can be
    reached, ``kept`` says that it is the document's own.

    * Null, empty or blank text: an empty set, linked with nothing, kept.
    * Null id: the row is given back with a null component, kept, and links nothing.
    * Repeated rows and repeated ids: each row has its own set and is given back; two documents are
      linked when any of their rows are.
    * Other columns are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    source = id_and_text(docs, id_col, text_col)
    sketches = materialize(source.mapInArrow(_sketcher(width), SKETCH), "near-sketches")

    classes = materialize(
        sketches.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep")).where("rep is not null"),
        "near-classes",
    )
    nodes = materialize(
        sketches.join(classes, (sketches["digest"] == classes["digest"]) & (sketches["doc_id"] == classes["rep"]), "left_semi")
        .dropDuplicates(["doc_id", "digest"]).drop("digest"),
        "near-nodes",
    )

    in_bands = nodes.select(F.explode("bands").alias("key"), "doc_id")
    shared = in_bands.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("leader")).where("n > 1")
    shared = materialize(shared, "near-shared")  # both sides of the next join are plain scans, so Spark can split hot keys
    members = materialize(in_bands.join(shared, "key"), "near-members")
    wanted = members.select("doc_id").distinct()
    # texts of all documents that share a band with another one, whole
    texts = materialize(thin_out(source, "doc_id", wanted).distinct(), "near-texts")
    state = _Links(texts, nodes, width, percent)

    stars = members.where("doc_id != leader").select(F.col("leader").alias("a"), F.col("doc_id").alias("b")).distinct()
    state.decide(_sift(stars, nodes, percent))

    rows = materialize(_open_buckets(state.labelled(members.where("n > 2"))), "near-open")
    state.add(materialize(_tile_links(rows, nodes, texts, width, percent), "near-links"))

    classes = classes.join(state.component.toDF("rep", "component_id"), "rep", "left")
    classes = classes.select("digest", F.coalesce("component_id", "rep").alias("component_id"))
    result = sketches.select("doc_id", "n_shingles", "digest").join(classes, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return result.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def _tile_links(rows: DataFrame, nodes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links that join the components of open buckets; a large bucket is dealt into tiles of bounded size.

    Tiles see sizes, bitmaps and bands first; texts follow only for the members that may be linked in the tile.
    """
    rows = rows.select("key", "doc_id", "component").join(nodes, "doc_id")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / TILE, F.sum("n_shingles") / TILE_SHINGLES)).alias("blocks")
    dealt = (
        rows.join(rows.groupBy("key").agg(blocks), "key")
        .withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
                "block", "doc_id", "component", "n_shingles", "bands", "bitmap")
    )
    tile = ["key", "low", "high"]
    sifted = dealt.groupBy(*tile).applyInPandas(_sifter(percent), "key long, low long, high long, doc_id long")
    with_text = dealt.join(materialize(sifted, "near-sifted"), [*tile, "doc_id"], "left_semi").join(texts, "doc_id")
    return with_text.groupBy(*tile).applyInPandas(_joiner(width, percent), "a long, b long")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that are not kept; all columns stay as they are, whatever their names."""
    dropped = near_duplicates(docs, **options).where("not kept").select("doc_id").distinct()
    packed = docs.select(F.struct(*docs.columns).alias("row"))
    key = F.col("row")[options.get("id_col", "doc_id")].cast("long")
    left = packed.join(dropped, key == F.col("doc_id"), "left_anti")
    return left.select(*[F.col("row")[c].alias(c) for c in docs.columns])
