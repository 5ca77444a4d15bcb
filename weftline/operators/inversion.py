"""Words of documents counted, looked up and inverted inside the tasks that hold the documents.

Functions for ``mapInArrow``. Which documents a task holds, and where its rows go, is Spark's (``operators.index``); a task works off its documents
in groups, so it holds a bounded number of words whatever its partition has. Rows of words would be some seven times as many as rows
of words and lists of documents, and each carries its word, so words leave a task with the list of their documents there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

GROUP_BYTES = 8 << 20  # text that is counted together
GROUP_POSTINGS = 2_000_000  # words of documents that are worked on together
RUN_SLICES = 1_024  # slices in one list of documents
BATCH_ROWS = 20_000  # rows given back at a time


class Words:
    """Words of each dataset with their idf; a bounded table (``index.COMMON_TERMS``)."""

    def __init__(self, words: DataFrame):
        rows = words.select("dataset", "term", "idf").toArrow()
        self.of: dict[object, tuple[pa.Array, np.ndarray]] = {}
        for dataset in pc.unique(rows["dataset"]):
            part = rows.filter(pc.equal(rows["dataset"], dataset)).combine_chunks()
            self.of[dataset.as_py()] = (_one(part["term"]), _one(part["idf"]).to_numpy(zero_copy_only=False))

    def lookup(self, dataset: object, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``names`` are among the words, and their idf (0 for others)."""
        if dataset not in self.of:
            return np.zeros(len(names), bool), np.zeros(len(names))
        terms, idf = self.of[dataset]
        place = pc.fill_null(pc.index_in(names, value_set=terms), -1).to_numpy(zero_copy_only=False)
        return place >= 0, np.where(place >= 0, idf[place], 0.0)


def _one(column: pa.ChunkedArray) -> pa.Array:
    """A column as one array."""
    found = column.combine_chunks()
    return found if isinstance(found, pa.Array) else pa.concat_arrays(found.chunks)


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    return _one(column).to_numpy(zero_copy_only=False)


def _lists(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, BATCH_ROWS):
        yield batch.slice(start, BATCH_ROWS)


def _starts(changes: np.ndarray) -> np.ndarray:
    """Places where a run begins, from whether each value but the first differs from the one before."""
    return np.flatnonzero(np.concatenate([[True], changes]))


# ---- texts to word lists ------------------------------------------------------------------------------

def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word lists (``index.word_lists``) from ``dataset, doc, words``: the words of a text, one at least, joined by blanks."""
    for batch in batches:
        size = pc.binary_length(batch.column("words")).to_numpy(zero_copy_only=False)
        group = np.cumsum(size, dtype=np.int64) // GROUP_BYTES
        ends = [*_starts(group[1:] != group[:-1])[1:], batch.num_rows] if batch.num_rows else []
        for start, end in zip([0, *ends], ends, strict=False):
            yield _counted(batch.slice(start, end - start))


def _counted(texts: pa.RecordBatch) -> pa.RecordBatch:
    lists = pc.split_pattern(texts.column("words"), " ")
    total = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    words = lists.flatten().dictionary_encode()
    order = pc.array_sort_indices(words.dictionary).to_numpy(zero_copy_only=False)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    key = np.repeat(np.arange(len(total)) * len(order), total) + rank[words.indices.to_numpy(zero_copy_only=False)]
    key.sort()
    starts = _starts(key[1:] != key[:-1])
    doc, word = np.divmod(key[starts], len(order))
    offsets = np.searchsorted(doc, np.arange(len(total) + 1))
    terms = words.dictionary.take(pa.array(order[word]))
    counts = pa.array(np.diff(starts, append=len(key)), pa.int32())
    return pa.RecordBatch.from_arrays(
        [texts.column("dataset"), texts.column("doc"), pa.array(total, pa.int64()), pc.binary_join(_lists(offsets, terms), " "), _lists(offsets, counts)],
        names=["dataset", "doc", "total_words", "terms", "counts"],
    )


# ---- groups of word lists -----------------------------------------------------------------------------

def _groups(batches: Iterator[pa.RecordBatch], together: str | None) -> Iterator[pa.Table]:
    """Documents with ``GROUP_POSTINGS`` words or a little more; neighbours that agree in the column ``together`` aren't parted."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += len(batch.column("counts").flatten())
        if size < GROUP_POSTINGS:
            continue
        rows = pa.Table.from_batches(held)
        ends = np.cumsum(pc.list_value_length(_one(rows["counts"])).to_numpy(zero_copy_only=False), dtype=np.int64)
        if together is None:
            cuts = np.arange(1, rows.num_rows + 1)
        else:
            of = _numbers(rows[together])
            cuts = np.flatnonzero(of[1:] != of[:-1]) + 1
        start = done = 0
        while True:
            full = np.searchsorted(ends, done + GROUP_POSTINGS) + 1  # rows that make up a group
            at = np.searchsorted(cuts, full)
            if full > rows.num_rows or at == len(cuts):
                break
            yield rows.slice(start, cuts[at] - start)
            start = cuts[at]
            done = ends[start - 1]
        held, size = rows.slice(start).to_batches(), ends[-1] - done
    if held:
        yield pa.Table.from_batches(held)


class _Documents:
    """Documents of one dataset: distinct ``names``, and for each word of a document the place of its name (``word``) and of the document (``row``)."""

    def __init__(self, dataset: pa.Scalar, rows: pa.Table):
        self.dataset, self.rows = dataset, rows
        lists = pc.split_pattern(_one(rows["terms"]), " ")
        words = lists.flatten().dictionary_encode()
        self.names, self.word = words.dictionary, words.indices.to_numpy(zero_copy_only=False)
        self.row = np.repeat(np.arange(rows.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        self.count = _one(rows["counts"]).flatten().to_numpy(zero_copy_only=False)
        self.total = _numbers(rows["total_words"])

    def part(self) -> np.ndarray:
        """``log2(1 + tf)`` of each word in its document."""
        return np.log2(1.0 + self.count / self.total[self.row])


def _documents(batches: Iterator[pa.RecordBatch], together: str | None = None) -> Iterator[_Documents]:
    for rows in _groups(batches, together):
        for dataset in pc.unique(rows["dataset"]):
            yield _Documents(dataset, rows.filter(pc.equal(rows["dataset"], dataset)))


# ---- word lists to frequencies, norms and postings ----------------------------------------------------

def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each group with the number of its documents that have them: ``dataset, term, df``."""
    for docs in _documents(batches):
        n = np.bincount(docs.word, minlength=len(docs.names))
        yield from _pieces(pa.RecordBatch.from_arrays(
            [pa.repeat(docs.dataset, len(n)), docs.names, pa.array(n, pa.int64())], names=["dataset", "term", "df"]
        ))


def squares(words: Words):
    """Sum of the squared weights of each document's words that are in ``words``: ``dataset, doc, total_words, square``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs in _documents(batches):
            idf = words.lookup(docs.dataset.as_py(), docs.names)[1]
            weight = docs.part() * idf[docs.word]
            total = np.bincount(docs.row, weight * weight, minlength=docs.rows.num_rows)
            yield pa.RecordBatch.from_arrays(
                [*(_one(docs.rows[c]) for c in ("dataset", "doc", "total_words")), pa.array(total)],
                names=["dataset", "doc", "total_words", "square"],
            )

    return work


def other_words(words: Words, *more: str):
    """The documents' words that are not in ``words``, a row each: ``dataset, doc, total_words``, columns ``more`` of the document, ``term, count``."""
    columns = ["dataset", "doc", "total_words", *more]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs in _documents(batches):
            others = np.flatnonzero(~words.lookup(docs.dataset.as_py(), docs.names)[0][docs.word])
            row = pa.array(docs.row[others])
            yield from _pieces(pa.RecordBatch.from_arrays(
                [*(_one(docs.rows[c]).take(row) for c in columns), docs.names.take(pa.array(docs.word[others])), pa.array(docs.count[others], pa.int64())],
                names=[*columns, "term", "count"],
            ))

    return work


def inverted(words: Words):
    """Entries (``index.entry_columns``) of the documents' words that are in ``words``.

    The documents come sorted by slice, with their norm; all of a slice are in one entry of a word, so blocks are whole.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs in _documents(batches, "slice"):
            known, idf = words.lookup(docs.dataset.as_py(), docs.names)
            kept = np.flatnonzero(known[docs.word])
            if not len(kept):
                continue
            # by word, documents in their order: the place is part of the number that is sorted
            key = docs.word[kept].astype(np.int64) * len(kept) + np.arange(len(kept))
            key.sort()
            word, place = np.divmod(key, len(kept))
            at = kept[place]
            row = docs.row[at]
            doc = _one(docs.rows["doc"]).take(pa.array(row))
            yield from _entries(docs.dataset, docs.names, idf, word, doc, _numbers(docs.rows["slice"])[row], docs.count[at], docs.total[row], _numbers(docs.rows["mag"])[row])

    return work


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries from rows of words (``dataset, term, idf, doc, slice, count, total_words, mag``) dealt by word; a task holds a bounded number of them."""
    held = [batch for batch in batches if batch.num_rows]
    if not held:
        return
    every = pa.Table.from_batches(held)
    held.clear()
    for dataset in pc.unique(every["dataset"]):
        rows = every.filter(pc.equal(every["dataset"], dataset))
        words = _one(rows["term"]).dictionary_encode()
        word = words.indices.to_numpy(zero_copy_only=False)
        idf = np.empty(len(words.dictionary))
        idf[word] = _numbers(rows["idf"])
        order = np.lexsort((_numbers(rows["doc"]), word))
        columns = [_numbers(rows[c])[order] for c in ("slice", "count", "total_words", "mag")]
        yield from _entries(dataset, words.dictionary, idf, word[order], _one(rows["doc"]).take(pa.array(order)), *columns)


def _entries(
    dataset: pa.Scalar, names: pa.Array, idf: np.ndarray, word: np.ndarray, doc: pa.Array, slice_no: np.ndarray, count: np.ndarray, total: np.ndarray, mag: np.ndarray
) -> Iterator[pa.RecordBatch]:
    """Entries of postings that are sorted by word and document; ``word`` are places in ``names`` and ``idf``."""
    blocks = _starts((word[1:] != word[:-1]) | (slice_no[1:] != slice_no[:-1]))
    sizes = np.diff(blocks, append=len(word))
    # entries begin with a word, and anew after so many of its blocks
    of_word = _starts(word[blocks][1:] != word[blocks][:-1])
    in_word = np.arange(len(blocks)) - np.repeat(of_word, np.diff(of_word, append=len(blocks)))
    at = np.flatnonzero(in_word % RUN_SLICES == 0)
    starts, block_ends = blocks[at], np.append(at, len(blocks))
    ends = np.append(starts, len(word))
    share = np.divide(np.log2(1.0 + count / total), mag, out=np.zeros(len(word)), where=mag > 0)
    share = np.where(sizes > 1, np.maximum.reduceat(share, blocks), 0.0)
    single = np.diff(block_ends) == np.diff(ends)  # entries whose blocks have one document each
    columns = {
        "dataset": pa.repeat(dataset, len(starts)), "term": names.take(pa.array(word[starts])), "idf": pa.array(idf[word[starts]]),
        "doc": _lists(ends, doc), "count": _lists(ends, pa.array(count, pa.int32())), "total_words": _lists(ends, pa.array(total, pa.int32())),
        "mag": _lists(ends, pa.array(mag)), "first": _lists(block_ends, pa.array(blocks - np.repeat(starts, np.diff(block_ends)), pa.int32())),
        "share": _shares(share, block_ends, single),
    }
    yield from _pieces(pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns)))


def _shares(share: np.ndarray, ends: np.ndarray, missing: np.ndarray) -> pa.Array:
    """Lists of the blocks' shares, null for the entries that are ``missing``."""
    sizes = np.where(missing, 0, np.diff(ends))
    kept = share[np.repeat(~missing, np.diff(ends))]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(kept), mask=pa.array(missing))
