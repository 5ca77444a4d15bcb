"""Token-id output: documents packed into rows of one length by best-fit decreasing.

Each task encodes its documents and packs them in blocks of a bounded number of tokens, so nothing is
shuffled and a task's memory does not grow with its input. A block's pieces are placed longest first, each into the row with
the least room that still holds it; a segment tree over the amounts of room finds that row.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from weftline.llm.common import bound_batches, id_and_text
from weftline.plans.lineage import materialize

DEFAULT_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
END_ID = 50256  # fixed value: the free id behind the vocabulary; ends each document and pads rows
ROW_TOKENS = 2048
BLOCK_TOKENS = 2_000_000

SEGMENT = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int32()), ("length", pa.int32())])
SCHEMA = (
    "block long, row int, n_tokens int, n_pad int, ids binary, positions binary, cu_seqlens array<int>, "
    "segments array<struct<doc_id: long, piece: int, start: int, length: int>>"
)


class RoomTree:
    """Rows by their room: a segment tree over room 0..capacity that tells the least room of at least n."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        at = room + self.size
        while at:
            self.count[at] += 1
            at //= 2

    def take(self, least: int) -> tuple[int, int] | None:
        """A row with the least room of at least ``least``, taken out."""
        at = least + self.size
        if not self.count[at]:
            # up to the first subtree on the right that holds a row, then down to its leftmost one
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at //= 2
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.size
        while at:
            self.count[at] -= 1
            at //= 2
        return room, self.rows[room].pop()


def place(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: the pieces of each row, in the order they were placed."""
    tree, rows = RoomTree(capacity), []
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        found = tree.take(lengths[k])
        if found is None:
            room, row = capacity, len(rows)
            rows.append([])
        else:
            room, row = found
        rows[row].append(k)
        if room > lengths[k]:
            tree.put(room - lengths[k], row)
    return rows


def pack(pieces: list[tuple], capacity: int, block: int) -> pa.RecordBatch:
    """One block: pieces (doc_id, piece, ids) as rows."""
    cols = {k: [] for k in ("row", "n_tokens", "n_pad", "ids", "positions", "cu_seqlens", "segments")}
    for row, members in enumerate(place([len(p[2]) for p in pieces], capacity)):
        ids = np.full(capacity, END_ID, dtype="<u2")
        positions = np.zeros(capacity, dtype="<u2")
        ends, segments = [0], []
        for k in members:
            doc, piece, own = pieces[k]
            start = ends[-1]
            ends.append(start + len(own))
            ids[start : ends[-1]] = own
            positions[start : ends[-1]] = np.arange(len(own))
            segments.append({"doc_id": doc, "piece": piece, "start": start, "length": len(own)})
        positions[ends[-1] :] = np.arange(capacity - ends[-1])
        for name, value in zip(cols, (row, ends[-1], capacity - ends[-1], ids.tobytes(), positions.tobytes(), ends, segments), strict=True):
            cols[name].append(value)
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(SEGMENT))
    arrays = [pa.array(v, t) for v, t in zip(cols.values(), kinds, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([block] * len(cols["row"]), pa.int64()), *arrays], ["block", *cols])


_encodings: dict = {}  # one per vocabulary and worker process


def encoding(content: bytes):
    import tiktoken

    if content not in _encodings:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
        name = hashlib.sha256(content).hexdigest()
        _encodings[content] = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[content]


def pack_documents(
    docs: DataFrame, ranks: str = DEFAULT_RANKS, row_tokens: int = ROW_TOKENS, block_tokens: int = BLOCK_TOKENS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """All documents as rows of ``row_tokens`` ids: (block, row, n_tokens, n_pad, ids, positions, cu_seqlens, segments).

    ``ids`` and ``positions`` are little-endian 16-bit matrices row by row (block by block they are
    the packed id matrix); positions start at 0 again in each segment and in the padding.
    ``cu_seqlens`` are the cumulative segment lengths from 0 on, ``segments`` say which piece of which document
    stands where. A document is its ids and END_ID; one that is longer than a row is cut into whole rows and a rest, so
    pieces put together in order give it back. Rows are filled up with END_ID.

    * Null or empty text: END_ID alone. Null ids are kept, repeated rows are packed each.
    * Equal lengths keep the order of the input. Other columns are not read. An empty table gives no rows.
    * Block numbers follow the input's partitions: other partitions give other blocks of the same documents.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    with open(ranks, "rb") as file:
        content = spark.sparkContext.broadcast(file.read())

    def emit(batches):
        codec = encoding(content.value)
        block = TaskContext.get().partitionId() << 33
        pieces, held = [], 0
        for batch in batches:
            for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.array([*codec.encode_ordinary(text or ""), END_ID], dtype="<u2")
                for n, at in enumerate(range(0, len(ids), row_tokens)):
                    pieces.append((doc, n, ids[at : at + row_tokens]))
                    held += len(pieces[-1][2])
                    if held >= block_tokens:
                        yield pack(pieces, row_tokens, block)
                        pieces, held, block = [], 0, block + 1
        if pieces:
            yield pack(pieces, row_tokens, block)

    return id_and_text(docs, id_col, text_col).mapInArrow(emit, SCHEMA)


def write_packed(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write the packed rows (to the shared scratch folder without a path) and read them."""
    packed = pack_documents(docs, **options)
    if path is None:
        return materialize(packed, "packed")
    packed.write.parquet(path)
    return docs.sparkSession.read.schema(packed.schema).parquet(path)
