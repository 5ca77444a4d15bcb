"""PageRank and what is read from it."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline import bindings as B
from weftline.entries import sql as Q
from weftline.entries.registry import prepared, query
from weftline.entries.web import FREQUENCY, open_crawl
from weftline.operators import links as L, pagerank as R
from weftline.plans.lineage import materialize

ALL_GRAPHS = f"""{Q.OPEN_CRAWL},
trade_lines AS (SELECT DISTINCT 's' || l_suppkey AS s, 'p' || l_partkey AS p FROM lineitem),
errs AS (SELECT 'u' || user_id AS u, lead('u' || user_id) OVER (ORDER BY ts, event_id) AS v FROM events WHERE event_type = 'error'),
g_edges AS MATERIALIZED (
  SELECT 'trade' AS dataset, s AS src, p AS dst FROM trade_lines UNION ALL SELECT 'trade', p, s FROM trade_lines
  UNION ALL SELECT DISTINCT 'succession', u, v FROM errs WHERE v IS NOT NULL
  UNION ALL SELECT dataset, src, dst FROM current_links),
g_nodes AS MATERIALIZED (
  SELECT DISTINCT dataset, src AS url FROM g_edges WHERE dataset = 'trade'
  UNION ALL SELECT DISTINCT 'succession', u FROM errs
  UNION ALL SELECT dataset, url FROM page)"""

PAGE_GRAPH = f"{Q.OPEN_CRAWL}, g_edges AS (SELECT dataset, src, dst FROM current_links), g_nodes AS (SELECT dataset, url FROM page)"
PAGE_RANKS = f"{PAGE_GRAPH}, {Q.rank_sql('g_nodes', 'g_edges')}"


@prepared
def page_ranks(spark, sf_dir):
    """Ranks of the captured pages and their stubs."""
    found = open_crawl(spark, sf_dir)
    return materialize(R.pagerank(found.pages.select("dataset", "url"), found.current), "page-ranks")


def _shown(ranks):
    return ranks.select("dataset", "url", F.round("pr", 9).alias("pr"), "steps")


@query("pr2_pagerank_trade", f"WITH RECURSIVE {Q.TRADE}, {Q.rank_sql('g_nodes', 'g_edges')} SELECT dataset, url, round(pr, 9) AS pr, steps FROM ranks")
def pagerank_trade(spark, sf_dir):
    return _shown(R.pagerank(*B.trade_graph(spark, sf_dir)))


@query(
    "pr2_pagerank_succession",
    f"WITH RECURSIVE {Q.SUCCESSION}, {Q.rank_sql('g_nodes', 'g_edges')} SELECT dataset, url, round(pr, 9) AS pr, steps FROM ranks",
)
def pagerank_succession(spark, sf_dir):
    return _shown(R.pagerank(*B.succession_graph(spark, sf_dir)))


@query("pr3_pagerank_all", f"WITH RECURSIVE {ALL_GRAPHS}, {Q.rank_sql('g_nodes', 'g_edges')} SELECT dataset, url, round(pr, 9) AS pr, steps FROM ranks")
def pagerank_all(spark, sf_dir):
    found = open_crawl(spark, sf_dir)
    nodes, links = found.pages.select("dataset", "url"), found.current.select("dataset", "src", "dst")
    for more_nodes, more_links in (B.trade_graph(spark, sf_dir), B.succession_graph(spark, sf_dir)):
        nodes, links = nodes.unionByName(more_nodes), links.unionByName(more_links)
    return _shown(R.pagerank(nodes, links))


ONE_STEP = f"""{PAGE_GRAPH}, n AS (SELECT dataset, count(*) AS n FROM g_nodes GROUP BY 1),
outs AS (SELECT dataset, src, count(*) AS o FROM g_edges GROUP BY 1, 2),
got AS (SELECT e.dataset, e.dst AS url, sum((1.0::DOUBLE / n.n) / o.o) AS received FROM g_edges e JOIN outs o USING (dataset, src)
  JOIN n USING (dataset) GROUP BY 1, 2),
step AS (SELECT g.dataset, g.url, 1.0::DOUBLE / n.n AS previous, 0.1 / n.n + 0.9 * coalesce(received, 0) AS pr
  FROM g_nodes g JOIN n USING (dataset) LEFT JOIN got USING (dataset, url))"""


def _first_step(spark, sf_dir):
    found = open_crawl(spark, sf_dir)
    return R.uniform_ranks(found.pages), found.current.select("dataset", "src", "dst")


@query("pr1_rank_step", f"WITH {ONE_STEP} SELECT dataset, url, round(previous, 9) AS previous, round(pr, 9) AS pr FROM step")
def rank_step(spark, sf_dir):
    return R.rank_step(*_first_step(spark, sf_dir)).select(
        "dataset", "url", F.round("previous", 9).alias("previous"), F.round("pr", 9).alias("pr")
    )


@query(
    "jn7_links_with_rank",
    f"WITH {ONE_STEP} SELECT e.dataset, e.src, e.dst, round((1.0::DOUBLE / n.n) / o.o, 9) AS share FROM g_edges e "
    "JOIN outs o USING (dataset, src) JOIN n USING (dataset)",
)
def links_with_rank(spark, sf_dir):
    return R.contributions(*_first_step(spark, sf_dir)).withColumn("share", F.round("share", 9))


@query("ag9_received_rank", f"WITH {ONE_STEP} SELECT dataset, url, round(received, 9) AS received FROM got")
def received_rank(spark, sf_dir):
    return R.received(*_first_step(spark, sf_dir)).withColumn("received", F.round("received", 9))


@query("ag10_distance", f"WITH {ONE_STEP} SELECT dataset, round(sqrt(sum((pr - previous) * (pr - previous))), 9) AS distance FROM step GROUP BY 1")
def distance(spark, sf_dir):
    step = R.rank_step(*_first_step(spark, sf_dir))
    return R.distance(step).withColumn("distance", F.round("distance", 9))


@query(
    "tk4_top_ranked",
    f"""WITH RECURSIVE {PAGE_RANKS} SELECT dataset, position, url, round(pr, 9) AS pr FROM (
    SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY round(pr, 12) DESC, url) AS position FROM ranks) WHERE position <= 10""",
)
def top_ranked(spark, sf_dir):
    return R.top_ranked(page_ranks(spark, sf_dir), 10).withColumn("pr", F.round("pr", 9))


def _two_crawls(spark, sf_dir):
    """Page ranks twice, as found under two dataset names of different priority."""
    ranks = page_ranks(spark, sf_dir)
    second = ranks.withColumn("dataset", F.concat(F.lit("old "), "dataset")).withColumn("pr", F.col("pr") / 2)
    order = [("example.net", 1), ("old example.com", 2), ("example.com", 3), ("old example.org", 4)]
    return ranks.unionByName(second), spark.createDataFrame(order, "dataset string, priority int")


TWO_CRAWLS = f"""{PAGE_RANKS}, both_ranks AS (
  SELECT dataset, url, pr FROM ranks UNION ALL SELECT 'old ' || dataset, url, pr / 2 FROM ranks),
prio AS (SELECT * FROM (VALUES ('example.net', 1), ('old example.com', 2), ('example.com', 3), ('old example.org', 4)) v(dataset, priority)),
looked AS (SELECT url, min_by(dataset, priority) AS dataset, min_by(pr, priority) AS pr
  FROM both_ranks JOIN prio USING (dataset) WHERE url IN (SELECT regexp_replace(url, '#.*$', '') FROM pages) GROUP BY 1)"""


@query("pr4_rank_lookup", f"WITH RECURSIVE {TWO_CRAWLS} SELECT url, dataset, round(pr, 9) AS pr FROM looked")
def rank_lookup(spark, sf_dir):
    ranks, priorities = _two_crawls(spark, sf_dir)
    wanted = B.captures(spark, sf_dir).select("url")
    return R.lookup_ranks(ranks, wanted, priorities).withColumn("pr", F.round("pr", 9))


@query("jn11_first_dataset", f"WITH RECURSIVE {TWO_CRAWLS} SELECT dataset, count(*) AS urls FROM looked GROUP BY 1")
def first_dataset(spark, sf_dir):
    ranks, priorities = _two_crawls(spark, sf_dir)
    wanted = B.captures(spark, sf_dir).select("url")
    return R.lookup_ranks(ranks, wanted, priorities).groupBy("dataset").agg(F.count(F.lit(1)).alias("urls"))


@query(
    "pr5_rank_comparison",
    f"""WITH RECURSIVE {PAGE_RANKS} SELECT dataset, url, round(pr, 9) AS pr, in_degree % 2 = 0 AS matches
    FROM ranks JOIN page USING (dataset, url)""",
)
def rank_comparison(spark, sf_dir):
    ranks = page_ranks(spark, sf_dir)
    # expected values that are off for pages with an odd number of incoming links
    pages = open_crawl(spark, sf_dir).pages.select("dataset", "url", "in_degree")
    expected = ranks.join(pages, ["dataset", "url"]).select(
        "dataset", "url", (F.col("pr") + F.when(F.col("in_degree") % 2 == 0, F.lit(1e-7)).otherwise(F.lit(1e-5))).alias("expected")
    )
    return R.compare_ranks(ranks, expected).select("dataset", "url", F.round("pr", 9).alias("pr"), "matches")


DETAIL = f"""{PAGE_RANKS}, {FREQUENCY},
ins AS (SELECT dataset, dst AS url, string_agg(src, ' ' ORDER BY src) AS incoming FROM (SELECT DISTINCT dataset, src, dst FROM links) GROUP BY 1, 2),
outs AS (SELECT dataset, src AS url, string_agg(dst, ' ' ORDER BY position) AS outgoing FROM current_links GROUP BY 1, 2),
wf AS (SELECT dataset, url, string_agg(word || '=' || n, ' ' ORDER BY position) AS words FROM freq50 GROUP BY 1, 2)
SELECT p.dataset, p.url, {Q.title('content')} AS title, round(pr, 9) AS page_rank, coalesce(incoming, '') AS incoming,
  coalesce(outgoing, '') AS outgoing, coalesce(words, '') AS words
FROM page p JOIN ranks USING (dataset, url) LEFT JOIN ins USING (dataset, url) LEFT JOIN outs USING (dataset, url) LEFT JOIN wf USING (dataset, url)"""


def _details(spark, sf_dir, pages):
    found = open_crawl(spark, sf_dir)
    words = F.transform(F.map_entries("word_frequency"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return L.page_details(pages, found.links, found.current, page_ranks(spark, sf_dir)).select(
        "dataset", "url", "title", F.round("page_rank", 9).alias("page_rank"),
        F.array_join("incoming_links", " ").alias("incoming"), F.array_join("outgoing_links", " ").alias("outgoing"),
        F.array_join(words, " ").alias("words"),
    )


@query("prj3_page_details", f"WITH RECURSIVE {DETAIL}")
def page_details(spark, sf_dir):
    return _details(spark, sf_dir, open_crawl(spark, sf_dir).pages)


@query("grf4_one_page", f"WITH RECURSIVE {DETAIL} WHERE p.url = (SELECT min(url) FROM page WHERE content <> '')")
def one_page(spark, sf_dir):
    pages = open_crawl(spark, sf_dir).pages
    url = pages.where("content <> ''").agg(F.min("url")).first()[0]
    return _details(spark, sf_dir, pages.where(F.col("url") == url))


@query(
    "jn6_pages_with_rank",
    f"""WITH RECURSIVE {TWO_CRAWLS} SELECT p.dataset, p.url, round(coalesce(l.pr, 0.0), 9) AS pr
    FROM page p LEFT JOIN looked l ON l.url = p.url""",
)
def pages_with_rank(spark, sf_dir):
    ranks, priorities = _two_crawls(spark, sf_dir)
    looked = R.lookup_ranks(ranks, B.captures(spark, sf_dir).select("url"), priorities).drop("dataset")
    pages = open_crawl(spark, sf_dir).pages.select("dataset", "url")
    return pages.join(looked, "url", "left").fillna({"pr": 0.0}).withColumn("pr", F.round("pr", 9))
