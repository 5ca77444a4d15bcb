"""Reading pages, and the page store: captures, incoming counts and links that grow by committed batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from weftline.plans.commits import FAN, commit, merge_due, read_manifest, read_table, write_segment
from weftline.plans.lineage import materialize

PAGE_KEY = ["dataset", "url"]
# folders per dataset of a new store
BUCKETS = 256
# tables of a segment: the newest capture of a page in it, links counted per fetch, the set of links; ``turn`` orders the batches
CAPTURES = "url string, content string, outgoing array<string>, fetched_at timestamp, turn bigint, dataset string, bucket int"
INCOMING = "url string, added bigint, dataset string, bucket int"
LINKS = "src string, dst string, dataset string, bucket int"
FOLDERS = ["dataset", "bucket"]


def bucket_of(url: Column, buckets: int) -> Column:
    """Folder of a page."""
    return F.pmod(F.xxhash64(url), F.lit(buckets)).cast("int")


def scan_pages(spark: SparkSession, path: str, dataset: str | None = None) -> DataFrame:
    """A page table in folders by dataset, one dataset only if named (its folders alone are read)."""
    pages = spark.read.parquet(path)
    if dataset is not None:
        pages = pages.where(F.col("dataset") == dataset)
    return pages


def find_page(pages: DataFrame, dataset: str, url: str, *columns: str) -> DataFrame:
    """One page by key, with the wanted columns only."""
    return pages.where((F.col("dataset") == dataset) & (F.col("url") == url)).select(*(columns or ["*"]))


def select_datasets(config: DataFrame, name: str | None) -> DataFrame:
    """Configured datasets by case-insensitive name; ``all`` or none takes every one."""
    wanted = (name or "all").lower()
    chosen = config if wanted == "all" else config.where(F.lower("dataset") == wanted)
    if chosen.limit(1).count() == 0:
        raise ValueError(f"unknown dataset: {name}")
    return chosen


def newest_captures(captures: DataFrame) -> DataFrame:
    """The newest capture of each page; of captures of one time, that of the later batch. Spark limits the ranks before the shuffle."""
    newest = Window.partitionBy(*PAGE_KEY).orderBy(F.col("fetched_at").desc(), F.col("turn").desc())
    return captures.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def incoming_counts(links: DataFrame) -> DataFrame:
    """Links per target (``dataset, url, added``) of rows ``dataset, src, dst``, one per link and fetch."""
    return links.groupBy("dataset", F.col("dst").alias("url")).agg(F.count(F.lit(1)).alias("added"))


def link_set(links: DataFrame) -> DataFrame:
    """The distinct links."""
    return links.select("dataset", "src", "dst").distinct()


def _in_folders(rows: DataFrame, key: str, buckets: int) -> tuple[DataFrame, list[str]]:
    """Rows with their folder, laid out so that a folder is one file where its size allows; AQE splits large ones."""
    return rows.withColumn("bucket", bucket_of(F.col(key), buckets)).hint("rebalance", *FOLDERS), FOLDERS


def _merged(spark: SparkSession, path: str, segments, folders: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Captures, incoming counts and links of the segments together; of pages in some folders only, where these are given."""
    captures = read_table(spark, path, segments, "captures", CAPTURES)
    incoming = read_table(spark, path, segments, "incoming", INCOMING)
    if folders is not None:  # before segments are merged, or Spark would read all folders
        captures, incoming = captures.where(folders), incoming.where(folders)
    links = read_table(spark, path, segments, "links", LINKS)
    if len(segments) > 1:  # keys are unique inside a segment
        captures = newest_captures(captures)
        incoming = incoming.groupBy(*PAGE_KEY, "bucket").agg(F.sum("added").alias("added"))
        links = links.distinct()
    return captures, incoming, links


def upsert_pages(
    spark: SparkSession, path: str, captures: DataFrame, links: DataFrame | None = None, buckets: int | None = None,
    source: str = "captures", batch: int | None = None, fan: int = FAN,
) -> bool:
    """Commit a batch of captures, and the links found in them, to the store at ``path``; whether it was new.

    ``batch`` numbers the batches of a ``source`` in rising order; a number that was committed before changes nothing, neither pages nor
    links nor counts. Without a number the batch is always new. ``buckets``, the folders per dataset, are settled by the first batch; a
    later call may leave them out, and another number is refused. Each batch writes its own rows only; an older capture that comes late
    changes no page.
    """
    seen = read_manifest(spark, path)
    if batch is not None and seen.has(source, batch):
        return False
    settled = seen.facts.get("buckets", buckets or BUCKETS)
    if buckets not in (None, settled):
        raise ValueError(f"the page store has {settled} folders per dataset, not {buckets}")
    number = seen.applied.get(source, -1) + 1 if batch is None else batch
    turn = seen.facts.get("turns", 0)
    rows = captures.select(*PAGE_KEY, "content", "outgoing", "fetched_at", F.lit(turn).cast("long").alias("turn"))
    tables = {"captures": _in_folders(newest_captures(rows), "url", settled)}
    if links is not None:
        links = materialize(links.select("dataset", "src", "dst"), "links")
        tables["incoming"] = _in_folders(incoming_counts(links), "url", settled)
        tables["links"] = _in_folders(link_set(links), "dst", settled)
    segment = write_segment(spark, path, tables)
    seen = commit(
        spark, path, seen, [*seen.segments, segment], {**seen.applied, source: number}, {**seen.facts, "buckets": settled, "turns": turn + 1}
    )
    start = merge_due(seen.segments, fan)
    if start is not None:
        merge_pages(spark, path, start)
    return True


def merge_pages(spark: SparkSession, path: str, start: int = 0) -> None:
    """Make one segment of those from place ``start`` on; pages, links and counts stay as they are."""
    seen = read_manifest(spark, path)
    old = seen.segments[start:]
    if len(old) < 2:
        return
    names, buckets = ("captures", "incoming", "links"), seen.facts["buckets"]
    keys = {"captures": "url", "incoming": "url", "links": "dst"}
    tables = {n: _in_folders(rows.drop("bucket"), keys[n], buckets) for n, rows in zip(names, _merged(spark, path, old), strict=True)}
    segment = write_segment(spark, path, tables, old[-1].level + 1)
    commit(spark, path, seen, [*seen.segments[:start], segment], seen.applied, seen.facts)


def stored_pages(spark: SparkSession, path: str, dataset: str | None = None, url: str | None = None) -> DataFrame:
    """``dataset, url, content, outgoing, fetched_at, incoming_count`` of all stored pages and stubs; stubs have no time.

    With ``dataset``, and ``url``, only the folders of that dataset, or that page, are read.
    """
    manifest = read_manifest(spark, path)
    folders = None if dataset is None else F.col("dataset") == dataset
    if url is not None:
        place = (F.col("bucket") == bucket_of(F.lit(url), manifest.facts.get("buckets", BUCKETS))) & (F.col("url") == url)
        folders = place if folders is None else folders & place
    captures, incoming, _ = _merged(spark, path, manifest.segments, folders)
    return captures.drop("bucket", "turn").join(incoming.drop("bucket"), PAGE_KEY, "full_outer").select(
        *PAGE_KEY,
        F.coalesce("content", F.lit("")).alias("content"),
        F.coalesce("outgoing", F.array().cast("array<string>")).alias("outgoing"),
        "fetched_at",
        F.coalesce("added", F.lit(0)).alias("incoming_count"),
    )


def stored_links(spark: SparkSession, path: str, dataset: str | None = None) -> DataFrame:
    """The set of links (``dataset, src, dst``) that the batches have brought."""
    links = _merged(spark, path, read_manifest(spark, path).segments)[2].select("dataset", "src", "dst")
    return links if dataset is None else links.where(F.col("dataset") == dataset)


def read_page(spark: SparkSession, path: str, dataset: str, url: str, *columns: str) -> DataFrame:
    """One page of the store; only the folders of its key are read."""
    return find_page(stored_pages(spark, path, dataset, url), dataset, url, *columns)
