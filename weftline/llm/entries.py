"""Registered queries of the operators: each applies its operator to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.bindings import table
from weftline.entries.registry import query
from weftline.llm import sql
from weftline.llm.ann import nearest
from weftline.llm.bpe_text import encode_documents
from weftline.llm.fingerprints import containment, fingerprint, fingerprints, resemblance, shingle_count
from weftline.llm.hard_negatives import hard_negatives
from weftline.llm.language_id import identify
from weftline.llm.line_dedup import remove_repeated_lines
from weftline.llm.mixing import mix_sources
from weftline.llm.near_dup import near_duplicates
from weftline.llm.packing import write_packed
from weftline.llm.prefix_trie import NO_ENDS, conversation_trie, end_digests
from weftline.llm.token_counts import count_tokens
from weftline.llm.top_k import top_products
from weftline.llm.warc import round_trip


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query("op4_minhash_near_dedup")
def _near(spark, sf_dir):
    return near_duplicates(_documents(spark, sf_dir), width=4, percent=80)


@query("op1_line_dedup", sql.LINE_DEDUP)
def _lines(spark, sf_dir):
    done = remove_repeated_lines(_documents(spark, sf_dir))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


@query("op2_token_packing")
def _packed(spark, sf_dir):
    rows = write_packed(_documents(spark, sf_dir))
    return rows.select(
        "block", "row", "n_tokens", "n_pad", "cu_seqlens",
        F.col("segments.doc_id").alias("doc_ids"), F.col("segments.piece").alias("pieces"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("positions", 256).alias("positions_sha256"),
    )


@query("op6_bpe_trie")
def _encoded(spark, sf_dir):
    done = encode_documents(_documents(spark, sf_dir))
    return done.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@query("op7_token_counts")
def _counted(spark, sf_dir):
    return count_tokens(_documents(spark, sf_dir))


@query("op3_warc", sql.WARC)
def _archived(spark, sf_dir):
    records = round_trip(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op8_source_mixing", sql.MIXING)
def _mixed(spark, sf_dir):
    return mix_sources(_documents(spark, sf_dir)).drop("text_hash")


@query("op5_nearest_vectors")
def _nearest(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"), every=50, k=5)


@query("op9_top_products", sql.TOP_PRODUCTS)
def _top(spark, sf_dir):
    return top_products(table(spark, sf_dir, "embeddings"), every=100, k=10)


@query("op10_language_id")
def _languages(spark, sf_dir):
    return identify(_documents(spark, sf_dir))


@query("op11_conversation_trie", sql.PREFIX_TRIE)
def _trie(spark, sf_dir):
    trie = conversation_trie(table(spark, sf_dir, "conversations"))
    ends = end_digests(trie.ends).withColumnRenamed("conv_id", "ends_at")
    rows = trie.nodes.join(ends, "ends_at", "left")
    return rows.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )


@query("op12_hard_negatives", sql.HARD_NEGATIVES)
def _mined(spark, sf_dir):
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved), every=100, k=5)


@query("op13_document_fingerprints", sql.FINGERPRINTS)
def _fingerprinted(spark, sf_dir):
    rows = fingerprints(_documents(spark, sf_dir))
    own, edited = F.col("sketch"), F.col("edited_sketch")
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(own).alias("fingerprint"), fingerprint(edited).alias("edited_fingerprint"),
        resemblance(own, edited).alias("near_edited"), resemblance(own, F.col("next_sketch")).alias("near_next"),
        F.round(shingle_count(own), 6).alias("n_shingles"), F.round(containment(own, edited), 9).alias("kept_edited"),
    )
