"""PageRank by power iteration, for one or many link graphs at once.

``alpha`` is the teleport share; rank that reaches a page without links is lost,
not spread; self-links count; a step is the last one when the Euclidean distance
to the step before is below ``epsilon``, and its vector is the result.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from weftline.plans.lineage import broadcast_if_small, cut, fixed_layout, layout_size, materialize, settings
from weftline.plans.shaping import heavy_keys

# links of one source page that share a partition; larger sources are split
SOURCE_BLOCK = 500_000


def out_degrees(edges: DataFrame) -> DataFrame:
    """Links per source page; ``edges`` holds distinct ``dataset, src, dst``."""
    return edges.groupBy("dataset", "src").agg(F.count(F.lit(1)).alias("out_degree"))


def dataset_sizes(nodes: DataFrame) -> DataFrame:
    """Pages per dataset, a row each, sent to the pages where they are few: a join would shuffle all pages by dataset."""
    sizes = nodes.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))
    return broadcast_if_small(materialize(sizes, "sizes"))


def uniform_ranks(nodes: DataFrame) -> DataFrame:
    """Start vector: every page of a dataset has rank 1/n."""
    sizes = dataset_sizes(nodes)
    return nodes.select("dataset", "url").join(sizes, "dataset").select("dataset", "url", (1.0 / F.col("n")).alias("pr"))


def contributions(ranks: DataFrame, edges: DataFrame) -> DataFrame:
    """What each link hands on: the rank of its source over the source's out-degree."""
    shares = ranks.join(
        out_degrees(edges), (ranks.url == F.col("src")) & (ranks.dataset == edges.dataset)
    ).select(ranks.dataset, "src", (F.col("pr") / F.col("out_degree")).alias("share"))
    return edges.join(shares, ["dataset", "src"]).select("dataset", "src", "dst", "share")


def received(ranks: DataFrame, edges: DataFrame) -> DataFrame:
    """Rank received per target page."""
    return contributions(ranks, edges).groupBy("dataset", F.col("dst").alias("url")).agg(F.sum("share").alias("received"))


def rank_step(ranks: DataFrame, edges: DataFrame, alpha: float = 0.1) -> DataFrame:
    """One step of the iteration as a plain DataFrame plan."""
    return (
        ranks.join(dataset_sizes(ranks), "dataset")
        .join(received(ranks, edges), ["dataset", "url"], "left")
        .select(
            "dataset",
            "url",
            F.col("pr").alias("previous"),
            (alpha / F.col("n") + (1 - alpha) * F.coalesce("received", F.lit(0.0))).alias("pr"),
        )
    )


def distance(step: DataFrame) -> DataFrame:
    """Euclidean distance between ``pr`` and ``previous`` per dataset."""
    gap = F.col("pr") - F.col("previous")
    return step.groupBy("dataset").agg(F.sqrt(F.sum(gap * gap)).alias("distance"))


def pagerank(
    nodes: DataFrame,
    edges: DataFrame,
    alpha: float = 0.1,
    epsilon: float = 1e-4,
    max_steps: int = 1000,
    source_block: int = SOURCE_BLOCK,
) -> DataFrame:
    """Ranks of all pages at convergence: ``dataset, url, pr, steps``.

    ``nodes`` holds ``dataset, url``, ``edges`` distinct ``dataset, src, dst``.
    Links to pages outside ``nodes`` count in the out-degree and hand their share
    to nobody. A dataset without pages gives no rows; a dataset that has
    converged takes no part in later rounds.

    Pages are numbered once and the links are laid out once, by source number and
    sorted by target. A step looks the ranks up where the links lie (each task holds those of its own
    sources), adds up runs of equal targets as they come, and moves only those sums, which meet the pages in their layout.
    Every step ends in a checkpoint of the rank vector. Sources with more than ``source_block`` links are split into blocks.
    """
    spark = nodes.sparkSession
    graph = _number_graph(nodes, edges)
    parts = layout_size(spark, graph.links.count())
    heavy = heavy_keys(graph.links, "src", source_block)
    keys = ["src"] if heavy is None else ["src", "block"]
    sizes = graph.pages.groupBy("code").agg(F.count(F.lit(1)).alias("n"))

    finished: list[DataFrame] = []
    with fixed_layout(spark, parts), settings(spark, spark__sql__execution__replaceHashWithSortAgg="true"):
        layout = _lay_out(graph.links, heavy, source_block, parts).persist()
        degrees = layout.groupBy("src").agg(F.count(F.lit(1)).alias("out"))
        state = cut(
            # one row per dataset on the broadcast side
            graph.pages.join(broadcast_if_small(cut(sizes)), "code")
            .repartition(parts, "id")
            .join(degrees.withColumnRenamed("src", "id"), "id", "left")
            .select("id", "code", (alpha / F.col("n")).alias("base"), F.coalesce("out", F.lit(0)).alias("out"), (1.0 / F.col("n")).alias("pr"))
        )
        step, running = 0, sizes.count()
        while step < max_steps and running:
            step += 1
            state = cut(_next_state(state, layout, keys, heavy, source_block, alpha))
            done = _converged(state, epsilon, last=step == max_steps)
            if done:
                ends = F.broadcast(spark.createDataFrame([(code,) for code in done], "code long"))
                finished.append(state.join(ends, "code", "left_semi").select("id", "pr", F.lit(step).alias("steps")))
                running -= len(done)
                state = state.join(ends, "code", "left_anti")
        layout.unpersist()
    if not finished:
        return graph.pages.select("dataset", "url", F.lit(0.0).alias("pr"), F.lit(0).alias("steps")).limit(0)
    ranks = finished[0]
    for more in finished[1:]:
        ranks = ranks.unionByName(more)
    return graph.pages.join(ranks, "id").select("dataset", "url", "pr", "steps")


def _converged(state: DataFrame, epsilon: float, last: bool) -> list[int]:
    """Datasets (by code) that finish with this step: all of them, if it is the last.

    Every dataset comes to the driver once in the whole run.
    """
    gap = F.col("pr") - F.col("previous")
    distances = state.groupBy("code").agg(F.sqrt(F.sum(gap * gap)).alias("distance"))
    return [row.code for row in (distances if last else distances.where(F.col("distance") < epsilon)).select("code").collect()]


class NumberedGraph(NamedTuple):
    """``pages(dataset, code, url, id)`` and ``links(src, dst)`` by number; ``dst`` is null for unknown pages."""

    pages: DataFrame
    links: DataFrame


def _number_graph(nodes: DataFrame, edges: DataFrame) -> NumberedGraph:
    # checkpointed first, so that the numbers can never be drawn twice
    codes = cut(nodes.select("dataset").distinct()).select("dataset", F.monotonically_increasing_id().alias("code"))
    distinct = cut(nodes.select("dataset", "url").dropDuplicates())
    pages = materialize(
        distinct.withColumn("id", F.monotonically_increasing_id())
        .join(broadcast_if_small(codes), "dataset")
        .select("dataset", "code", "url", "id"),
        "rank-pages",
    )
    sources = pages.select("dataset", F.col("url").alias("src"), F.col("id").alias("src_id"))
    targets = pages.select("dataset", F.col("url").alias("dst"), F.col("id").alias("dst_id"))
    links = materialize(
        edges.select("dataset", "src", "dst")
        .join(sources, ["dataset", "src"])
        .join(targets, ["dataset", "dst"], "left")
        .select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst")),
        "rank-links",
    )
    return NumberedGraph(pages, links)


def _blocks(links: Column, source_block: int) -> Column:
    return F.ceil(links / source_block)


def _lay_out(links: DataFrame, heavy: DataFrame | None, source_block: int, parts: int) -> DataFrame:
    """Links by source (and block, where there are heavy sources), sorted by target; links to unknown pages come first."""
    if heavy is None:
        return links.repartition(parts, "src").sortWithinPartitions("dst")
    spans = F.broadcast(heavy.select(F.col("_key").alias("src"), _blocks(F.col("_n"), source_block).alias("blocks")))
    block = F.coalesce(F.pmod(F.xxhash64("dst"), F.col("blocks")), F.lit(0).cast("long"))
    split = links.join(spans, "src", "left").select("src", block.alias("block"), "dst")
    return split.repartition(parts, "src", "block").sortWithinPartitions("dst")


def _next_state(state: DataFrame, layout: DataFrame, keys: list[str], heavy: DataFrame | None, source_block: int, alpha: float) -> DataFrame:
    """The state after one more step; ``previous`` is the rank before it."""
    shares = state.where("out > 0").select(F.col("id").alias("src"), "out", (F.col("pr") / F.col("out")).alias("share"))
    if heavy is not None:
        blocks = F.when(F.col("out") > source_block, _blocks(F.col("out"), source_block)).otherwise(F.lit(1).cast("long"))
        blocks = F.sequence(F.lit(0).cast("long"), blocks - 1)
        # the block of a link follows from its source's number of links, all of which ``out`` counts
        shares = shares.select("src", "share", F.explode(blocks).alias("block"))
    # the side that is hashed is that of the ranks, so the links stay in the order of their targets
    rows = layout.where("dst IS NOT NULL").join(shares.select(*keys, "share").hint("shuffle_hash"), keys)
    received = rows.groupBy(F.col("dst").alias("id")).agg(F.sum("share").alias("received"))
    rank = F.col("base") + F.lit(1 - alpha) * F.coalesce("received", F.lit(0.0))
    return state.join(received.hint("shuffle_hash"), "id", "left").select("id", "code", "base", "out", F.col("pr").alias("previous"), rank.alias("pr"))


def top_ranked(ranks: DataFrame, count: int) -> DataFrame:
    """The ``count`` best pages of every dataset, ties by url."""
    order = Window.partitionBy("dataset").orderBy(F.col("sort_pr").desc(), "url")
    return (
        ranks.select("dataset", "url", "pr", F.round("pr", 12).alias("sort_pr"))
        .withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= count)
        .select("dataset", "position", "url", "pr")
    )


def lookup_ranks(ranks: DataFrame, wanted: DataFrame, priorities: DataFrame) -> DataFrame:
    """Rank of each wanted url from the first dataset, by priority, that holds it.

    ``wanted`` has ``url``; ``priorities`` has ``dataset, priority`` (a configuration).
    A url in no dataset gives no row.
    """
    found = wanted.select("url").dropDuplicates().join(ranks, "url").join(broadcast_if_small(priorities), "dataset")
    return found.groupBy("url").agg(
        F.min_by("dataset", "priority").alias("dataset"), F.min_by("pr", "priority").alias("pr")
    )


def compare_ranks(ranks: DataFrame, expected: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Expected ranks next to the computed ones and whether they agree."""
    gap: Column = F.abs(F.col("pr") - F.col("expected"))
    return expected.join(ranks.select("dataset", "url", "pr"), ["dataset", "url"], "left").select(
        "dataset", "url", "expected", "pr", F.coalesce(gap < tolerance, F.lit(False)).alias("matches")
    )
