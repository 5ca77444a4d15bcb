"""An index that grows by batches of documents: word counts in segments, frequencies as sums over them.

A batch cuts only its own documents into words. A document that comes again replaces its older version: the batch notes the older one as
replaced and takes its words off the document frequencies, so corpus sizes and frequencies are sums over the segments. Weights and norms
depend on all documents; ``current_index`` derives them from the counts, without a text being read again.
Batches are committed by number (``plans.commits``): one that comes again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from weftline.functions import text as T
from weftline.operators.index import SHARDS, SearchIndex, each_word, index_of_lists, word_lists
from weftline.plans.commits import FAN, commit, merge_due, read_manifest, read_table, write_segment
from weftline.plans.lineage import broadcast_if_small, materialize, spread

BUCKETS = 64  # folders per dataset of documents and counts: a batch looks up older versions in the folders of its own documents
VERSION = ["dataset", "doc", "turn"]
# tables of a segment; ``turn`` is the place of a batch among all
# the words of a document are one row (``index.word_lists``), so neither batches, merges nor the index derived from them move rows of words
COUNTS = "doc bigint, total_words bigint, terms string, counts array<int>, turn bigint, dataset string, bucket int"
DOCS = "doc bigint, url string, title string, turn bigint, dataset string, bucket int"
REPLACED = "doc bigint, turn bigint, dataset string"
TERMS = "term string, df bigint, dataset string"
SIZES = "n bigint, dataset string"
TABLES = {"counts": COUNTS, "docs": DOCS, "replaced": REPLACED, "terms": TERMS, "sizes": SIZES}


def _bucket(doc: Column) -> Column:
    return F.pmod(F.xxhash64(doc), F.lit(BUCKETS)).cast("int")


def _in_folders(rows: DataFrame, *folders: str) -> tuple[DataFrame, list[str]]:
    return rows.hint("rebalance", *folders), list(folders)


def _sums(rows: DataFrame, *keys: str) -> DataFrame:
    """Added up changes, without what has come to nothing."""
    value = next(c for c in rows.columns if c not in keys)
    return rows.groupBy(*keys).agg(F.sum(value).alias(value)).where(F.col(value) != 0)


def _tables(spark: SparkSession, path: str, segments) -> dict[str, DataFrame]:
    return {name: read_table(spark, path, segments, name, schema) for name, schema in TABLES.items()}


def _words(lists: DataFrame) -> DataFrame:
    """A row per word of each document."""
    return each_word(lists.select("dataset", "terms", "counts")).select("dataset", "term")


def _live(rows: DataFrame, replaced: DataFrame) -> DataFrame:
    return rows.join(broadcast_if_small(replaced), VERSION, "left_anti")


def add_documents(
    spark: SparkSession, path: str, docs: DataFrame, batch: int, source: str = "documents", removed: DataFrame | None = None, fan: int = FAN
) -> bool:
    """Commit a batch of documents (``dataset, doc, url, title, text``) to the index at ``path``; whether it was new.

    ``doc`` is unique in a dataset and gives the document order. Of versions of one document in a batch the one with the largest
    ``version`` counts, where there is such a column (ties: the largest text). ``removed`` (``dataset, doc``) are documents that go.
    """
    seen = read_manifest(spark, path)
    if seen.has(source, batch):
        return False
    turn = F.lit(seen.facts.get("turns", 0)).cast("long").alias("turn")
    if "version" in docs.columns:
        last = Window.partitionBy("dataset", "doc").orderBy(F.col("version").desc(), F.col("text").desc())
        docs = docs.withColumn("_n", F.row_number().over(last)).where("_n = 1")
    docs = materialize(docs.select("dataset", "doc", "url", "title", "text"), "segment-docs")
    counts = materialize(word_lists(spread(docs)).withColumn("turn", turn).withColumn("bucket", _bucket(F.col("doc"))), "segment-counts")

    named = docs.select("dataset", "doc")
    if removed is not None:
        named = named.unionByName(removed.select("dataset", "doc")).distinct()
    named = materialize(named.withColumn("bucket", _bucket(F.col("doc"))), "segment-named")
    old = _tables(spark, path, seen.segments)
    # the folders of the named documents only
    versions = old["docs"].join(broadcast_if_small(named), ["dataset", "bucket", "doc"], "left_semi").select(*VERSION, "bucket")
    replaced = materialize(versions.join(old["replaced"], VERSION, "left_anti"), "segment-replaced")
    old_counts = old["counts"].join(broadcast_if_small(replaced), ["dataset", "bucket", "doc", "turn"], "left_semi")

    one = F.lit(1).cast("long")
    terms = _words(counts).withColumn("df", one).unionByName(_words(old_counts).withColumn("df", -one))
    sizes = docs.select("dataset", one.alias("n")).unionByName(replaced.select("dataset", (-one).alias("n")))
    table = docs.select("dataset", "doc", "url", "title", turn, _bucket(F.col("doc")).alias("bucket"))
    segment = write_segment(spark, path, {
        "counts": _in_folders(counts, "dataset", "bucket"), "docs": _in_folders(table, "dataset", "bucket"),
        "replaced": _in_folders(replaced.select(*VERSION), "dataset"), "terms": _in_folders(_sums(terms, "dataset", "term"), "dataset"),
        "sizes": _in_folders(_sums(sizes, "dataset"), "dataset"),
    })
    facts = {**seen.facts, "turns": seen.facts.get("turns", 0) + 1}
    seen = commit(spark, path, seen, [*seen.segments, segment], {**seen.applied, source: batch}, facts)
    start = merge_due(seen.segments, fan)
    if start is not None:
        merge_segments(spark, path, start)
    return True


def merge_segments(spark: SparkSession, path: str, start: int = 0) -> None:
    """Make one segment of those from place ``start`` on: versions replaced among them go, the index stays as it is."""
    seen = read_manifest(spark, path)
    segments = seen.segments[start:]
    if len(segments) < 2:
        return
    old = _tables(spark, path, segments)
    replaced = materialize(old["replaced"], "merge-replaced")
    earlier = replaced.join(old["docs"].select(*VERSION), VERSION, "left_anti")  # versions in older segments
    segment = write_segment(spark, path, {
        "counts": _in_folders(_live(old["counts"], replaced), "dataset", "bucket"), "docs": _in_folders(_live(old["docs"], replaced), "dataset", "bucket"),
        "replaced": _in_folders(earlier, "dataset"), "terms": _in_folders(_sums(old["terms"], "dataset", "term"), "dataset"),
        "sizes": _in_folders(_sums(old["sizes"], "dataset"), "dataset"),
    }, segments[-1].level + 1)
    commit(spark, path, seen, [*seen.segments[:start], segment], seen.applied, seen.facts)


def term_sums(spark: SparkSession, path: str) -> DataFrame:
    """Words with document frequency, corpus size and inverse document frequency, as sums over the segments."""
    tables = _tables(spark, path, read_manifest(spark, path).segments)
    sizes = broadcast_if_small(materialize(_sums(tables["sizes"], "dataset"), "segment-sizes"))
    frequencies = _sums(tables["terms"], "dataset", "term").join(sizes, "dataset")
    return frequencies.withColumn("idf", T.inverse_document_frequency(F.col("df"), F.col("n")))


def current_index(spark: SparkSession, path: str, shards: int = SHARDS) -> SearchIndex:
    """The search index of all documents committed so far."""
    tables = _tables(spark, path, read_manifest(spark, path).segments)
    replaced = materialize(tables["replaced"], "segment-replaced")
    counts = _live(tables["counts"], replaced).select("dataset", "doc", "total_words", "terms", "counts")
    docs = _live(tables["docs"], replaced).select("dataset", "doc", "url", "title")
    return index_of_lists(materialize(counts, "lists", packed=True), docs, shards, term_sums(spark, path))
