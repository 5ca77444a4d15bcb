"""Helpers that several operators of this package share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The word separators of the query contracts (space, and tab to carriage return)
SEPARATOR_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

# bits of the map that thins out a table before it is joined on ids: 8 million bits, 1 MB on the driver
FILTER_BITS = 1 << 23


def bound_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Small Arrow batches for whole texts, so that a Python worker holds few of them at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


_tables: dict[str, object] = {}  # what an operator keeps in its worker from task to task


def give_back() -> None:
    """Give free memory of this worker back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def free_worker() -> None:
    """Drop what earlier operators keep in this worker, and give free memory back to the system.

    Spark hands workers on from stage to stage, so tables of a stage that is over would stand beside those of the next ones.
    """
    if _tables:
        _tables.clear()
        gc.collect()
    give_back()


def worker_tables(key: str, make: Callable[[], object]) -> object:
    """What the operator of ``key`` keeps in this worker from task to task; those of others go."""
    if key not in _tables:
        free_worker()
        _tables[key] = make()
    return _tables[key]


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, under its own names; other columns can't clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def byte_groups(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Places and numbers of the texts of these sizes that are worked on together: ``most`` at most, or one text."""
    groups, start, total = [], 0, 0
    for n, size in enumerate(sizes):
        if n > start and total + size > most:
            groups.append((start, n - start))
            start, total = n, 0
        total += size
    return [*groups, (start, len(sizes) - start)] if sizes else []


def text_bytes(values: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null reads as empty."""
    return [v or b"" for v in values.cast(pa.binary()).to_pylist()]


def _slot(id_col: Column) -> Column:
    return F.pmod(F.xxhash64(id_col), F.lit(FILTER_BITS))


def thin_out(df: DataFrame, id_col: str, wanted: DataFrame) -> DataFrame:
    """Rows of ``df`` whose id may be in ``wanted`` (one column); all rows with a wanted id are kept.

    A map of FILTER_BITS bits marks the hashes of the wanted ids. It has a fixed
    size whatever the data (at most FILTER_BITS / 64 rows), so it can be sent to all
    executors; the rows that stay by chance go in the exact join that follows.
    It spares that join the shuffle of rows that nobody asked for.
    """
    slot = _slot(F.col(wanted.columns[0]))
    bits = wanted.select(
        F.floor(slot / 64).alias("_cell"), F.expr("1L").alias("_one"), F.pmod(slot, F.lit(64)).cast("int").alias("_at")
    )
    cells = bits.groupBy("_cell").agg(F.bit_or(F.expr("shiftleft(_one, _at)")).alias("_bits"))
    here = _slot(F.col(id_col))
    marked = df.withColumn("_cell", F.floor(here / 64)).withColumn("_at", F.pmod(here, F.lit(64)).cast("int"))
    hit = marked.join(F.broadcast(cells), "_cell").where(F.expr("shiftright(_bits, _at) & 1L") == 1)
    return hit.select(*df.columns)


def list_arrays(column: pa.Array) -> list[np.ndarray]:
    """The lists of an array column as numpy arrays, without a Python object per value."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat, at = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return [flat[s:e] for s, e in zip(at[:-1], at[1:], strict=True)]


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit integers (multiply, shift and exclusive or)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _odd_powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, dtype=np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


_WINDOW = 1 << 16
_BASE = 0x9E3779B97F4A7C15
_UP = _odd_powers(_BASE, _WINDOW + 1)
_DOWN = _odd_powers(pow(_BASE, -1, 1 << 64), _WINDOW + 1)


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64, and of its inverse: differences of sums times powers are hashes of what lies between."""
    if n <= _WINDOW:
        return _UP, _DOWN
    return _odd_powers(_BASE, n), _odd_powers(pow(_BASE, -1, 1 << 64), n)


_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_LOWER = _VALUE.copy()
_LOWER[65:91] = _VALUE[97:123]
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[list(SEPARATOR_BYTES)] = False


def _window_hashes(data: np.ndarray) -> np.ndarray:
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = _IS_WORD[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[0::2], edges[1::2]
    n = len(data)
    up, down = power_tables(n)  # longer ones where one word is longer than a window
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_LOWER[data] * up[:n], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of the text, A-Z read as a-z.

    Long texts are read in windows that end at a separator, so temporaries stay small.
    """
    data = np.frombuffer(text, dtype=np.uint8)
    if len(data) <= _WINDOW:
        return _window_hashes(data)
    parts, at = [], 0
    while at < len(data):
        end = min(at + _WINDOW, len(data))
        if end < len(data):
            gaps = np.flatnonzero(~_IS_WORD[data[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:
                while end < len(data) and _IS_WORD[data[end]]:
                    step = np.flatnonzero(~_IS_WORD[data[end : end + _WINDOW]])
                    end = end + int(step[0]) if len(step) else min(end + _WINDOW, len(data))
        parts.append(_window_hashes(data[at:end]))
        at = end
    return np.concatenate(parts)


_PLACE = mix64(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles; fewer words count as one shingle."""
    words = word_hashes(text)
    if len(words) == 0:
        return words
    if len(words) < width:
        whole = (words * _PLACE[: len(words)]).sum(dtype=np.uint64) + np.uint64(len(words))
        return mix64(np.array([whole], dtype=np.uint64))
    n = len(words) - width + 1
    total = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        total += words[k : k + n] * _PLACE[k]
    return np.unique(mix64(total))
