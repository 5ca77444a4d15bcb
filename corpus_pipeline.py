"""The corpus pipeline: documents through the operators of ``weftline.llm``, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm.bpe_text import encode_documents, id_array
from weftline.llm.language_id import without_rejected
from weftline.llm.line_dedup import without_repeated_lines
from weftline.llm.mixing import mixed_documents
from weftline.llm.near_dup import drop_near_duplicates
from weftline.plans.lineage import materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model rejects go: those without a letter, and those it is not sure of."""
    return without_rejected(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of lines of at least 50 words that stand in an earlier document too are deleted; what is empty then goes."""
    return without_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8) stays."""
    return drop_near_duplicates(docs, width=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix of their sources takes them: not at all, once or twice."""
    return mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded text of each document of the mix: (doc_id, n_tokens, ids, decoded)."""
    return encode_documents(docs).withColumn("ids", id_array())


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("encoding", encoding),
]
# a trained model and a tokenizer decide, which SQL can't express; tests/llm/test_pipeline.py holds the rows against plain Python
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over the whole table of documents; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
