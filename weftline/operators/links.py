"""From captured pages to a link graph: link extraction, page table, in-degrees, reachability.

Captures have ``dataset, seq, url, html, fetched_at``; ``url`` carries no fragment.
Links are kept as rows ``dataset, src, dst``; a list of incoming links is built only
where one page is shown, because a popular page may hold a large share of all links.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from weftline.functions import html as H, text as T, urls as U
from weftline.operators.pagerank import SOURCE_BLOCK
from weftline.plans.lineage import broadcast_if_small, cut, fixed_layout, layout_size, materialize, spread
from weftline.plans.shaping import nest

# document number of pages that are only known as link targets: after all captured ones
STUB_SEQ = 1 << 62


def prefixes_or_default(seeds: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Allowed prefixes per dataset; a dataset without any gets the directory of its seed."""
    return seeds.join(prefixes, "dataset", "left").select(
        "dataset", F.coalesce("prefix", U.directory_prefix(F.col("seed"))).alias("prefix")
    )


def _prefix_lengths(prefixes: DataFrame) -> DataFrame:
    """One row per dataset, with at most as many lengths as its longest prefix has characters."""
    return prefixes.groupBy(F.col("dataset").alias("_ds")).agg(F.collect_set(F.length("prefix")).alias("_lengths"))


def _cuts(rows: DataFrame, url: str, lengths: DataFrame, shorter: bool = False) -> DataFrame:
    """Rows once per prefix length of their dataset (below their own length, or up to it), with ``url`` cut to it (``_cut``)."""
    own = F.length(url)
    fitting = F.filter("_lengths", lambda n: (n < own) if shorter else (n <= own))
    held = rows.join(lengths, F.col("dataset") == F.col("_ds")).withColumn("_length", F.explode(fitting))
    return held.withColumn("_cut", F.substring(url, F.lit(1), F.col("_length")))


def shortest_prefixes(prefixes: DataFrame) -> DataFrame:
    """The prefixes (``dataset, prefix``) that no other one of their dataset is a prefix of; they allow the same addresses."""
    every = materialize(prefixes.select("dataset", "prefix").where("prefix is not null").distinct(), "prefixes")
    whole = every.select(F.col("dataset").alias("_in"), F.col("prefix").alias("_whole"))
    cuts = _cuts(every, "prefix", _prefix_lengths(every), shorter=True)
    covered = cuts.join(whole, (F.col("dataset") == F.col("_in")) & (F.col("_cut") == F.col("_whole")), "left_semi")
    return every.join(covered.select("dataset", "prefix").distinct(), ["dataset", "prefix"], "left_anti")


def within_prefixes(rows: DataFrame, url: str, prefixes: DataFrame) -> DataFrame:
    """Rows whose ``url`` starts with any prefix of their dataset.

    Each address is cut to the lengths that prefixes of its dataset have, and the cuts are joined with the prefixes by equality. No
    prefix begins with another one then, so a row meets one of them at most.
    """
    allowed = materialize(shortest_prefixes(prefixes), "shortest-prefixes")
    lengths = broadcast_if_small(materialize(_prefix_lengths(allowed), "prefix-lengths"))
    names = broadcast_if_small(allowed.select(F.col("dataset").alias("_in"), F.col("prefix").alias("_prefix")))
    met = _cuts(rows, url, lengths).join(names, (F.col("dataset") == F.col("_in")) & (F.col("_cut") == F.col("_prefix")), "left_semi")
    return met.select(*rows.columns)


def raw_links(captures: DataFrame) -> DataFrame:
    """Every link value of every capture: ``dataset, seq, fetched_at, src, position, href``."""
    return spread(captures).select(
        "dataset",
        "seq",
        "fetched_at",
        F.col("url").alias("src"),
        F.posexplode(H.link_values(F.col("html"))).alias("position", "href"),
    )


def fetched_links(captures: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Distinct allowed links of every capture: ``dataset, seq, fetched_at, src, dst, position``."""
    usable = raw_links(captures).where(U.usable_href(F.col("href"))).withColumn("href", T.trim_white(F.col("href")))
    found = within_prefixes(U.with_resolved(usable, "href", "src", "dst"), "dst", prefixes)
    return found.groupBy("dataset", "seq", "fetched_at", "src", "dst").agg(F.min("position").alias("position"))


def distinct_links(fetched: DataFrame) -> DataFrame:
    """Links over all captures: ``dataset, src, dst``, when last seen and at which place then."""
    latest = F.max(F.struct("fetched_at", "seq", (-F.col("position")).alias("back"))).alias("_latest")
    return (
        fetched.groupBy("dataset", "src", "dst")
        .agg(latest)
        .select(
            "dataset", "src", "dst", (-F.col("_latest.back")).alias("position"),
            F.col("_latest.fetched_at").alias("last_seen"), F.col("_latest.seq").alias("last_seq"),
        )
    )


def current_links(links: DataFrame, captures: DataFrame) -> DataFrame:
    """Links that the latest capture of their page still has: what the page links to now."""
    newest = (
        captures.groupBy("dataset", F.col("url").alias("src"))
        .agg(F.max(F.struct("fetched_at", "seq")).alias("_newest"))
    )
    return (
        links.join(newest, ["dataset", "src"])
        .where((F.col("last_seen") == F.col("_newest.fetched_at")) & (F.col("last_seq") == F.col("_newest.seq")))
        .select("dataset", "src", "dst", "position")
    )


def latest_captures(captures: DataFrame) -> DataFrame:
    """The last capture of each page. The limit runs before the shuffle, so re-captures do not pile up."""
    newest = Window.partitionBy("dataset", "url").orderBy(F.col("fetched_at").desc(), F.col("seq").desc())
    return captures.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def in_degrees(links: DataFrame) -> DataFrame:
    """Sources per target; ``links`` are distinct."""
    return links.groupBy("dataset", F.col("dst").alias("url")).agg(F.count(F.lit(1)).alias("in_degree"))


def link_counters(fetched: DataFrame) -> DataFrame:
    """Links per target counted again at every capture."""
    return fetched.groupBy("dataset", F.col("dst").alias("url")).agg(F.count(F.lit(1)).alias("incoming_count"))


def page_table(captures: DataFrame, links: DataFrame, current: DataFrame) -> DataFrame:
    """Captured pages plus a stub for every link target that was not captured.

    Incoming links are those of all captures, outgoing ones those of the latest. Columns ``dataset, seq, url, content, out_degree, in_degree, fetched_at``.
    """
    pages = latest_captures(captures).select("dataset", "url", "seq", F.col("html").alias("content"), "fetched_at")
    incoming = in_degrees(links)
    outgoing = current.groupBy("dataset", F.col("src").alias("url")).agg(F.count(F.lit(1)).alias("out_degree"))
    return (
        pages.join(incoming, ["dataset", "url"], "full_outer")
        .join(outgoing, ["dataset", "url"], "left")
        .select(
            "dataset",
            F.coalesce("seq", F.lit(STUB_SEQ)).alias("seq"),
            "url",
            F.coalesce("content", F.lit("")).alias("content"),
            F.coalesce("out_degree", F.lit(0)).alias("out_degree"),
            F.coalesce("in_degree", F.lit(0)).alias("in_degree"),
            "fetched_at",
        )
    )


def outgoing_lists(current: DataFrame) -> DataFrame:
    """Outgoing links per page in page order; no longer than the page they come from."""
    ordered = F.sort_array(F.collect_list(F.struct("position", "dst")))
    return current.groupBy("dataset", F.col("src").alias("url")).agg(
        F.transform(ordered, lambda e: e["dst"]).alias("outgoing")
    )


def incoming_lists(links: DataFrame, block_rows: int = 100_000) -> DataFrame:
    """Incoming links per page as sorted arrays of bounded length (``dataset, url, block, incoming``)."""
    rows = links.select("dataset", F.col("dst").alias("url"), "src")
    return nest(rows, ["dataset", "url"], F.col("src"), "incoming", block_rows)


def popular_pages(pages: DataFrame, base_url: str, count: int = 10) -> DataFrame:
    """The pages with the most incoming links per dataset, ties by url."""
    order = Window.partitionBy("dataset").orderBy(F.col("in_degree").desc(), "url")
    return (
        pages.select("dataset", "url", "in_degree")
        .withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= count)
        .select("dataset", "position", detail_address(base_url).alias("link"), F.col("url").alias("orig_url"), "in_degree")
    )


def detail_address(base_url: str) -> Column:
    """Address of the detail view of a page."""
    return F.concat(
        F.lit(base_url.rstrip("/") + "/"), "dataset", F.lit("/page?webUrl="), U.encode_component(F.col("url"))
    )


def word_frequency(pages: DataFrame, count: int = 50) -> DataFrame:
    """The most frequent paragraph words of each page, ties by first occurrence."""
    words = spread(pages).select(
        "dataset", "url", F.posexplode(T.tokens(H.paragraph_text(F.col("content")))).alias("place", "word")
    )
    counted = words.groupBy("dataset", "url", "word").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("place"))
    order = Window.partitionBy("dataset", "url").orderBy(F.col("n").desc(), "place")
    return (
        counted.withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= count)
        .select("dataset", "url", "position", "word", "n")
    )


def word_frequency_map(frequencies: DataFrame) -> DataFrame:
    """Word counts of a page as one map (at most 50 entries)."""
    entries = F.sort_array(F.collect_list(F.struct("position", "word", "n")))
    return frequencies.groupBy("dataset", "url").agg(
        F.map_from_entries(F.transform(entries, lambda e: F.struct(e["word"], e["n"]))).alias("word_frequency")
    )


def page_details(pages: DataFrame, links: DataFrame, current: DataFrame, ranks: DataFrame) -> DataFrame:
    """Detail rows: title, rank, links both ways and word counts of each given page.

    A page with more incoming links than fit one block has one row per block.
    """
    key = ["dataset", "url"]
    return (
        pages.select(*key, H.page_title(F.col("content")).alias("title"))
        .join(ranks.select(*key, "pr"), key, "left")
        .join(incoming_lists(links), key, "left")
        .join(outgoing_lists(current), key, "left")
        .join(word_frequency_map(word_frequency(pages)), key, "left")
        .select(
            *key,
            F.coalesce("block", F.lit(0)).alias("block"),
            "title",
            F.coalesce("pr", F.lit(0.0)).alias("page_rank"),
            F.coalesce("incoming", F.array().cast("array<string>")).alias("incoming_links"),
            F.coalesce("outgoing", F.array().cast("array<string>")).alias("outgoing_links"),
            F.coalesce("word_frequency", F.create_map().cast("map<string,bigint>")).alias("word_frequency"),
        )
    )


def reachable(
    edges: DataFrame, seeds: DataFrame, max_pages: int | None = None, source_block: int = SOURCE_BLOCK
) -> DataFrame:
    """Pages reachable from the seeds: ``dataset, url, depth``.

    ``seeds`` holds ``dataset, url``. With ``max_pages`` each dataset stops once that
    many pages are known; new pages enter by depth, then url. Edges are laid out
    once by source, sources with more than ``source_block`` links in blocks; a step
    joins only the newest pages to them.
    """
    spark = edges.sparkSession
    links = materialize(edges.select("dataset", "src", "dst").distinct(), "reach-links")
    parts = layout_size(spark, links.count())
    keys, source = ["dataset", "url"], ["dataset", "src"]
    hot = materialize(
        links.groupBy(*source)
        .agg(F.ceil(F.count(F.lit(1)) / source_block).alias("blocks"))
        .where("blocks > 1"),
        "reach-hot",
    )
    placed = source
    if hot.limit(1).count():
        hot, placed = broadcast_if_small(hot), [*source, "block"]
        spread_over = F.coalesce(F.pmod(F.xxhash64("dst"), F.col("blocks")), F.lit(0).cast("long"))
        links = materialize(links.join(hot, source, "left").select(*source, "dst", spread_over.alias("block")), "reach-links")
    with fixed_layout(spark, parts):
        # known pages keep one partitioning, so that no step has to move them again
        known = cut(seeds.select(*keys).distinct().repartition(parts, *keys).withColumn("depth", F.lit(0)))
        layout = cut(links.repartition(parts, *placed)).persist()
        frontier, depth, levels = known, 0, 0
        while True:
            depth += 1
            newest = frontier.select("dataset", F.col("url").alias("src"))
            if "block" in placed:
                every = F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", F.lit(1).cast("long")) - 1)
                newest = newest.join(hot, source, "left").select(*source, F.explode(every).alias("block"))
            fresh = (
                newest.join(layout, placed)
                .select("dataset", F.col("dst").alias("url"))
                .distinct()
                .join(known, keys, "left_anti")
                .withColumn("depth", F.lit(depth))
            )
            if max_pages is not None:
                sizes = known.groupBy("dataset").agg((F.lit(max_pages) - F.count(F.lit(1))).alias("_left"))
                order = Window.partitionBy("dataset").orderBy("url")
                # the constant bound lets Spark cut every partition before the shuffle
                fresh = (
                    fresh.withColumn("_n", F.row_number().over(order))
                    .where(F.col("_n") <= max_pages)
                    .join(sizes, "dataset")
                    .where("_n <= _left")
                    .select(*keys, "depth")
                )
            frontier = cut(fresh)
            if frontier.limit(1).count() == 0:
                break
            # every level is written once; a long list of levels is put together now and then
            known = known.unionByName(frontier)
            levels += 1
            if levels % 16 == 0:
                known = cut(known.repartition(parts, *keys))
        layout.unpersist()
    return known
