"""Token counts of whole texts by a two-tier lookup of pre-token lengths.

No piece of the vocabulary goes on past a blank or holds a line feed, so the pre-tokens (a run of blanks
with what follows it up to the next blank or line feed) are encoded independently and their lengths add up.
The lengths of the most frequent pre-tokens are worked out once and sent to all workers as one table of at
most ``TABLE_SIZE`` entries; all others are encoded by the library once and kept in a bounded table of the worker.
Pre-tokens are never shuffled: to choose the frequent ones, each task gives the top of a bounded summary of its own.
"""

from __future__ import annotations

from collections import Counter

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from weftline.llm.common import bound_batches, byte_groups, id_and_text

DEFAULT_MODEL = public_tokenizers.path("piece_bpe_32k.model")
TABLE_SIZE = 32_768  # entries of the table that is sent to the workers
SUMMARY, SUMMARY_OUT = 150_000, 16_384  # counters a task keeps, and gives
MOST_CACHED = 400_000  # entries a worker keeps besides
MOST_HELD = 32_000_000  # characters of their keys
LONGEST_KEPT = 256  # characters of a key that is kept; longer ones go with the texts they stand in
GROUP_BYTES = 4_000_000  # of texts whose keys are learned together
LONGEST_FREQUENT = 64  # characters of a pre-token in the table, which bounds its bytes

BLANK_MARK = "▁"  # fixed value: how the vocabulary spells a blank
_PRE_TOKENS = regex.compile(r" +[^ ]*|[^ ]+")


def pre_tokens(text: str) -> list[str]:
    """Keys of a text's pre-tokens: without their first blank; with a line feed before those that start a line without blank."""
    if not text:
        return []
    if BLANK_MARK in text:
        text = text.replace(BLANK_MARK, " ")
    lines = text.split("\n")
    lines[0] = " " + lines[0]  # the library puts a blank before each text
    out: list[str] = []
    for line in lines:
        if "  " in line or line.endswith(" "):
            out += [p[1:] if p[0] == " " else "\n" + p for p in _PRE_TOKENS.findall(line)]
        else:
            head, *rest = line.split(" ")
            if head:
                out.append("\n" + head)
            out += rest
    return out


class Lengths(dict):
    """Lengths by key; what is missing is encoded. Bounded by entries and by the characters of their keys."""

    def __init__(self, encoder, known=()):
        super().__init__(known)
        self.encoder, self.fixed = encoder, dict(known)
        self.held = 0
        self.passing: list[str] = []

    def learn(self, keys: set[str]) -> None:
        new = [k for k in keys if k not in self]
        if len(self) + len(new) > MOST_CACHED + len(self.fixed) or self.held > MOST_HELD:
            self.clear()
            self.update(self.fixed)
            self.held = 0
            new = [k for k in keys if k not in self]
        self.passing = [k for k in new if len(k) > LONGEST_KEPT]
        self.held += sum(map(len, new)) - sum(map(len, self.passing))
        if new:
            # a lone blank is one piece; a line's start is encoded behind a line feed, which makes two pieces with the blank before it
            counts = [len(ids) for ids in self.encoder.encode(new, num_threads=1)]
            for key, n in zip(new, counts, strict=True):
                self[key] = 1 if key == "" else n - 2 if key[0] == "\n" else n

    def count(self, texts: list[str]) -> list[int]:
        counts = []
        for start, n in byte_groups([len(t) for t in texts], GROUP_BYTES):
            part = texts[start : start + n]
            keys = [pre_tokens(t) for t in part]
            self.learn(set().union(*keys))
            counts += [sum(map(self.__getitem__, ks)) + t.count("\n") for ks, t in zip(keys, part, strict=True)]
            for key in self.passing:
                del self[key]
        return counts


_processors: dict = {}  # one per model and worker process


def _processor(content: bytes):
    import sentencepiece

    if content not in _processors:
        _processors[content] = sentencepiece.SentencePieceProcessor(model_proto=content)
    return _processors[content]


def check_model(processor) -> None:
    """Whether pre-tokens may be encoded on their own."""
    pieces = [processor.id_to_piece(k) for k in range(processor.vocab_size())]
    if any(BLANK_MARK in p.lstrip(BLANK_MARK) or "\n" in p for p in pieces) or len(processor.encode("a  \n b")) != 4:
        raise ValueError("pieces of this model go on past blanks or line feeds")


def _summaries(batches):
    """The top of a task's pre-token counts; the smallest counters go when there are too many."""
    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column(1).to_pylist():
            if text:
                counts.update(k for k in pre_tokens(text) if len(k) <= LONGEST_FREQUENT)
            if len(counts) > SUMMARY:
                counts = Counter(dict(counts.most_common(SUMMARY // 2)))
    top = counts.most_common(SUMMARY_OUT)
    yield pa.RecordBatch.from_arrays(
        [pa.array([k for k, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["key", "n"]
    )


def frequent_pre_tokens(source: DataFrame) -> list[str]:
    """At most TABLE_SIZE frequent keys over all texts (a choice for speed; counts don't depend on it)."""
    parts = source.mapInArrow(_summaries, "key string, n long")
    top = parts.groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(TABLE_SIZE)
    return [r["key"] for r in top.collect()]


def count_tokens(
    docs: DataFrame, model: str = DEFAULT_MODEL, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Sizes of every whole text: (doc_id, n_bytes, n_tokens, over_limit), a row per row.

    ``n_tokens`` is what the library's ``encode`` gives, without begin and end; special strings in a
    text are ordinary text. ``over_limit``: n_tokens > limit.

    * Null or empty text: 0 bytes, 0 tokens. Null and repeated ids: rows are independent.
    * Other columns are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    source = id_and_text(docs, id_col, text_col)
    with open(model, "rb") as file:
        content = file.read()
    processor = _processor(content)
    check_model(processor)
    frequent = Lengths(processor)
    frequent.learn(set(frequent_pre_tokens(source)))
    table = spark.sparkContext.broadcast((content, dict(frequent)))

    def count(batches):
        content, known = table.value
        lengths = Lengths(_processor(content), known)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            sizes = pa.array([len(t) if t.isascii() else len(t.encode()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), sizes, pa.array(lengths.count(texts), pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
            )

    done = source.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return done.withColumn("over_limit", F.col("n_tokens") > limit)
