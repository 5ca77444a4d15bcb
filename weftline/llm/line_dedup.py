"""Repeated runs of lines: winnowed line hashes find them, positions join, matches grow both ways.

Only lines that are not blank count. A window is a shortest run of consecutive lines with
at least ``min_words`` words, starting at a line or ending at one. Its fingerprint is the smallest
line hash in it (the last of equal ones): the same lines choose the same fingerprint
wherever they stand, so two documents that share such a run share a fingerprint for certain.

1. Line hashes and word counts of each document are written once; all later steps read them, not texts.
2. Fingerprints that occur at two places or more are kept; their places are the join positions.
3. Around each such place, every window that chose it is hashed as a whole and joined with
   the first place of the same window. As windows reach from the fingerprint to both sides, overlapping
   matches put together grow to the longest common run.
4. Lines inside a window that stands, without overlap, further forward in the corpus are deleted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from weftline.llm.common import WORD_PATTERN, bound_batches, free_worker, list_arrays, mix64, power_tables
from weftline.plans.lineage import materialize

MIN_WORDS = 50
_BLANK = b" \t\n\x0b\x0c\r"

KEY = ["doc_id", "text_hash"]


def split_lines(text: bytes) -> list[bytes]:
    return text.split(b"\n")


def _line_table(batches):
    free_worker()
    for batch in batches:
        hashes, words, places, lines = [], [], [], []
        for text in batch.column(2).cast(pa.binary()).to_pylist():
            h, w, p = [], [], []
            found = split_lines(text) if text else []
            for n, line in enumerate(found):
                tokens = line.strip(_BLANK).split()
                if tokens:
                    h.append(xxhash.xxh3_64_intdigest(line.strip(_BLANK)))
                    w.append(len(tokens))
                    p.append(n)
            hashes.append(np.array(h, dtype=np.uint64).view(np.int64))
            words.append(np.array(w, dtype=np.int32))
            places.append(np.array(p, dtype=np.int32))
            lines.append(len(found))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(lines, pa.int64()), pa.array(hashes, pa.list_(pa.int64())),
             pa.array(words, pa.list_(pa.int32())), pa.array(places, pa.list_(pa.int32()))],
            ["doc_id", "text_hash", "n_lines", "hashes", "words", "places"],
        )


def windows(words: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last lines of the shortest runs with ``min_words`` words from each line on, and up to each line."""
    total = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum(words, out=total[1:])
    n = len(words)
    after = np.searchsorted(total, total[:-1] + min_words)  # the line behind the run
    starts = np.flatnonzero(after <= n)
    first = np.searchsorted(total, total[1:] - min_words, side="right") - 1
    ends = np.flatnonzero(total[1:] >= min_words)
    spans = np.unique(np.concatenate([starts * (n + 1) + after[starts] - 1, first[ends] * (n + 1) + ends]))
    return spans // (n + 1), spans % (n + 1)


def chosen_hashes(hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The smallest line hash of each window."""
    if not len(first):
        return hashes[:0]
    padded = np.append(hashes, np.uint64(0xFFFFFFFFFFFFFFFF))
    return np.minimum.reduceat(padded, np.stack([first, last + 1], axis=1).ravel())[::2]


def whole_hashes(hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of all lines of each window, in their order."""
    up, down = power_tables(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(mix64(hashes) * up[: len(hashes)], out=sums[1:])
    return mix64(mix64((sums[last + 1] - sums[first]) * down[first]) + (last - first).astype(np.uint64))


def _fingerprints(min_words: int):
    def emit(batches):
        for batch in batches:
            out = [np.array([], dtype=np.uint64)]
            for h, w in zip(list_arrays(batch.column(0)), list_arrays(batch.column(1)), strict=True):
                # once per place: windows with the same fingerprint line count as one, equal lines do not
                first, last = windows(w, min_words)
                hashes = h.view(np.uint64)
                chosen = chosen_hashes(hashes, first, last)
                out.append(hashes[np.isin(hashes, chosen)])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64))], ["fingerprint"])

    return emit


def _matches(min_words: int):
    """Windows whose fingerprint is repeated, hashed as a whole."""

    def emit(batches):
        for batch in batches:
            rows, found, starts, ends = [], [], [], []
            lists = (list_arrays(batch.column(k)) for k in (2, 3, 4))
            for n, (h, w, repeated) in enumerate(zip(*lists, strict=True)):
                hashes = h.view(np.uint64)
                first, last = windows(w, min_words)
                keep = np.isin(chosen_hashes(hashes, first, last), repeated.view(np.uint64))
                first, last = first[keep], last[keep]
                rows.append(np.full(len(first), n))
                found.append(whole_hashes(hashes, first, last).view(np.int64))
                starts.append(first)
                ends.append(last)
            at = pa.array(np.concatenate([np.array([], dtype=np.int64), *rows]), pa.int64())
            own = [batch.column(k).take(at) for k in (0, 1)]
            flat = [np.concatenate([np.array([], dtype=np.int64), *x]) for x in (found, starts, ends)]
            kinds = (pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                own + [pa.array(v.astype(t.to_pandas_dtype()), t) for v, t in zip(flat, kinds, strict=True)],
                ["doc_id", "text_hash", "window", "first", "last"],
            )

    return emit


def _cut_lines(batches):
    """Texts without the lines of the given runs; n_lines etc. come along."""
    for batch in batches:
        texts, gone = batch.column(batch.schema.names.index("text")), np.zeros(batch.num_rows, dtype=np.int64)
        spans, places = (batch.column(batch.schema.names.index(c)) for c in ("spans", "places"))
        hit = np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False))
        if len(hit):
            texts = texts.to_pylist()
            for n in hit.tolist():
                own = places[n].as_py()
                drop: set[int] = set()
                for run in spans[n].as_py():
                    drop.update(range(own[run["first"]], own[run["last"]] + 1))
                texts[n] = "\n".join(x for k, x in enumerate(texts[n].split("\n")) if k not in drop)
                gone[n] = len(drop)
            texts = pa.array(texts, pa.string())
        rest = [c for c in batch.schema.names if c not in ("text", "places", "spans")]
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in rest] + [texts, pa.array(gone)], [*rest, "text", "n_removed"]
        )


def _on_key():
    return F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t"))


def remove_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS
) -> DataFrame:
    """Texts without later copies of repeated runs: (doc_id, text_hash, carried, n_lines, text, n_removed), a row per row.

    Lines end at a line feed and are compared without spaces at their ends; blank lines don't
    count, and go when they stand inside a deleted run. A line is deleted exactly when it
    lies in a run of consecutive lines of at least ``min_words`` words in all that stands
    further forward too: in a document of smaller (doc_id, text_hash), or before it in the same one without
    overlap. ``n_lines`` and ``n_removed`` count lines with blank ones; ``carried`` holds the row as it was, without its text.

    * Null text stays null, empty stays empty (no lines). Null ids come first.
    * Rows that repeat id and text are the same document: they get the same result and don't
      delete each other's lines. Rows that repeat the id alone are ordered by the hash of the text.
    * Other columns are only carried, inside ``carried``, so their names can't clash. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    source = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.xxhash64(F.col(text_col).cast("string")), F.lit(0)).alias("text_hash"),
        F.col(text_col).cast("string").alias("text"),
        F.struct(*[F.col(c) for c in docs.columns if c != text_col]).alias("carried"),
    )
    lines = materialize(
        source.select("doc_id", "text_hash", "text").mapInArrow(
            _line_table,
            "doc_id long, text_hash long, n_lines long, hashes array<long>, words array<int>, places array<int>",
        ).dropDuplicates(KEY),
        "line-table",
    )
    own = lines.where("size(hashes) > 0")

    prints = own.select("hashes", "words").mapInArrow(_fingerprints(min_words), "fingerprint long")
    repeated = materialize(
        prints.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fingerprint"), "line-prints"
    )
    # repeated fingerprints of each document: a row per place, then per document (at most its lines)
    spots = own.select(*KEY, F.explode(F.array_distinct("hashes")).alias("fingerprint")).join(repeated, "fingerprint")
    spots = spots.groupBy(*KEY).agg(F.collect_set("fingerprint").alias("repeated")).toDF("d", "t", "repeated")
    found = materialize(
        own.select(*KEY, "hashes", "words").join(spots, _on_key()).select(*KEY, "hashes", "words", "repeated").mapInArrow(
            _matches(min_words), "doc_id long, text_hash long, window long, first int, last int"
        ),
        "line-windows",
    )
    place = F.struct("doc_id", "text_hash", "first", "last")
    fronts = found.groupBy("window").agg(F.min(place).alias("front"), F.count(F.lit(1)).alias("n")).where("n > 1")
    fronts = materialize(fronts.select("window", "front"), "line-fronts")
    elsewhere = ~(F.col("doc_id").eqNullSafe(F.col("front.doc_id")) & (F.col("text_hash") == F.col("front.text_hash")))
    later = found.join(fronts, "window").where(elsewhere | (F.col("first") > F.col("front.last")))
    runs = later.groupBy(*KEY).agg(F.collect_set(F.struct("first", "last")).alias("spans")).toDF("d", "t", "spans")
    marked = lines.join(runs, _on_key(), "left").select(
        F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), "n_lines", F.when(F.col("spans").isNotNull(), F.col("places")).alias("places"), "spans"
    )
    marked = materialize(marked, "line-runs")
    whole = source.join(marked, _on_key()).select(*KEY, "carried", "n_lines", "text", "places", "spans")
    kinds = [whole.schema[c] for c in (*KEY, "carried", "n_lines", "text")]
    return whole.mapInArrow(_cut_lines, T.StructType([*kinds, T.StructField("n_removed", T.LongType())]))


def without_repeated_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with cleaned texts; documents of which nothing is left go, ``n_chars`` follows the text."""
    text_col = options.get("text_col", "text")
    done = remove_repeated_lines(docs, **options)
    done = done.where((F.col("n_removed") == 0) | F.col("text").rlike(WORD_PATTERN))
    out = {c: F.col("carried")[c] for c in docs.columns if c != text_col} | {text_col: F.col("text")}
    if "n_chars" in out:
        out["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(out["n_chars"])
    return done.select(*[out[c].alias(c) for c in docs.columns])
