"""Encoding and decoding of whole documents by the trie encoder, batch by batch in the workers."""

from __future__ import annotations

import json

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from weftline.llm.bpe_trie import TextEncoder
from weftline.llm.common import bound_batches, byte_groups, give_back, id_and_text, worker_tables

DEFAULT_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

# of texts that are encoded together: the more there are, the more words and prefixes they share, and the more room they take
GROUP_BYTES = 1_000_000


def _encoder(content: str) -> TextEncoder:
    """One per vocabulary and worker process; its tables are bounded."""
    return worker_tables(content, lambda: TextEncoder(json.loads(content)))


def _groups(column: pa.Array) -> list[tuple[int, int]]:
    """Places and numbers of the texts that go together: GROUP_BYTES at most, or one text."""
    return byte_groups(pc.fill_null(pc.binary_length(column), 0).to_pylist(), GROUP_BYTES)


def encode_documents(
    docs: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Ids and decoded text of every whole document: (doc_id, n_tokens, ids, decoded), a row per row.

    ``ids`` are decimal ids joined by one space (``id_array`` makes arrays of them); no special tokens are
    added, those written out in a text are taken as such. ``decoded`` is what the ids decode to, with special tokens.
    The vocabulary file (its size is known) goes to the workers; nothing is shuffled.

    * Null or empty text, or white space alone: no tokens, empty strings.
    * Null and repeated ids: rows are independent, each is given back.
    * Other columns are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    with open(tokenizer, encoding="utf-8") as file:
        content = spark.sparkContext.broadcast(file.read())

    def encode(batches):
        encoder = _encoder(content.value)
        for batch in batches:
            for part in (batch.slice(*group) for group in _groups(batch.column(1))):
                found = encoder.arrays([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), *found], ["doc_id", "n_tokens", "ids", "decoded"])
                del found
                give_back()  # what a group needs besides the tables, before the next one comes

    return id_and_text(docs, id_col, text_col).mapInArrow(encode, "doc_id long, n_tokens long, ids string, decoded string")


def id_array(ids: str = "ids"):
    """The ids of ``encode_documents`` as array<int>."""
    return F.when(F.col(ids) == "", F.array().cast("array<int>")).otherwise(F.split(ids, " ").cast("array<int>"))
