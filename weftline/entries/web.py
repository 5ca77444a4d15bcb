"""Captures, text, links, page table and popularity."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from weftline import bindings as B
from weftline.entries import sql as Q
from weftline.entries.registry import prepared, query
from weftline.functions import html as H, text as T, urls as U
from weftline.operators import integrity, links as L
from weftline.plans.lineage import materialize, scratch_path
from weftline.sources import pages as P

BASE = "http://localhost:3000"


class Crawl(NamedTuple):
    captures: DataFrame
    prefixes: DataFrame
    fetched: DataFrame
    links: DataFrame
    current: DataFrame
    pages: DataFrame


def _crawl(captures, prefixes) -> Crawl:
    prefixes = materialize(prefixes, "prefixes")
    kept = L.within_prefixes(captures, "url", prefixes)
    fetched = materialize(L.fetched_links(kept, prefixes), "fetched")
    links = materialize(L.distinct_links(fetched), "links")
    current = materialize(L.current_links(links, kept), "current")
    return Crawl(kept, prefixes, fetched, links, current, materialize(L.page_table(kept, links, current), "pages"))


@prepared
def crawl(spark, sf_dir) -> Crawl:
    """Link graph and page table under the configured prefixes."""
    prefixes = L.prefixes_or_default(B.seeds(spark, sf_dir), B.configured_prefixes(spark))
    return _crawl(B.captures(spark, sf_dir), prefixes)


@prepared
def open_crawl(spark, sf_dir) -> Crawl:
    """Link graph and page table with every address allowed."""
    return _crawl(B.captures(spark, sf_dir), B.open_prefixes(spark))


def joined(column, separator=" "):
    return F.array_join(column, separator)


# ---- sources and sinks -------------------------------------------------------------------------

@query("src3_scan_dataset", f"WITH {Q.CAPTURES} SELECT seq, url, length(html) AS n FROM captures WHERE dataset = 'example.net'")
def scan_dataset(spark, sf_dir):
    path = scratch_path(spark, "pages")
    B.captures(spark, sf_dir).write.partitionBy("dataset").parquet(path)
    return P.scan_pages(spark, path, "example.net").select("seq", "url", F.length("html").alias("n"))


@query(
    "src4_find_page",
    f"WITH {Q.OPEN_CRAWL} SELECT dataset, url, in_degree FROM page "
    "WHERE dataset = 'example.com' AND url = (SELECT min(url) FROM page WHERE dataset = 'example.com')",
)
def find_page(spark, sf_dir):
    pages = open_crawl(spark, sf_dir).pages
    url = pages.where("dataset = 'example.com'").agg(F.min("url")).first()[0]
    return P.find_page(pages, "example.com", url, "dataset", "url", "in_degree")


@query("src6_dataset_choice", f"WITH {Q.CAPTURES}, {Q.SEEDS} SELECT dataset, seed FROM seeds WHERE lower(dataset) = 'example.org'")
def dataset_choice(spark, sf_dir):
    return P.select_datasets(B.seeds(spark, sf_dir), "Example.ORG")


def _stored_twice(spark, sf_dir):
    """The page store after two crawls, the second one a day later over changed pages."""
    found = crawl(spark, sf_dir)
    outgoing = L.outgoing_lists(found.current)
    first = L.latest_captures(found.captures).join(outgoing, ["dataset", "url"], "left").select(
        "dataset", "url", F.col("html").alias("content"),
        F.coalesce("outgoing", F.array().cast("array<string>")).alias("outgoing"), "fetched_at",
    )
    second = first.select(
        "dataset", "url", F.concat("content", F.lit("<!-- again -->")).alias("content"), "outgoing",
        (F.col("fetched_at") + F.expr("INTERVAL 1 DAY")).alias("fetched_at"),
    )
    path = scratch_path(spark, "page-store")
    P.upsert_pages(spark, path, first, found.fetched, buckets=4, batch=0)
    P.upsert_pages(spark, path, second, found.fetched, batch=1)
    P.upsert_pages(spark, path, second, found.fetched, batch=1)  # once more, as after a failure: changes nothing
    sources = L.in_degrees(P.stored_links(spark, path))
    return P.stored_pages(spark, path).join(sources, ["dataset", "url"], "left").fillna({"in_degree": 0})


TWICE = f"""{Q.CRAWL}, latest AS (SELECT dataset, url, max_by(html, seq) AS html FROM kept GROUP BY 1, 2),
outs AS (SELECT dataset, src AS url, string_agg(dst, ' ' ORDER BY position) AS outgoing FROM current_links GROUP BY 1, 2),
ins AS (SELECT dataset, dst AS url, 2 * count(*) AS incoming_count, count(DISTINCT src) AS in_degree FROM fetched GROUP BY 1, 2)"""


@query(
    "snk1_page_upsert",
    f"""WITH {TWICE} SELECT l.dataset, l.url, length(html) + 14 AS content_length, coalesce(outgoing, '') AS outgoing,
    coalesce(incoming_count, 0) AS incoming_count, coalesce(in_degree, 0) AS in_degree FROM latest l LEFT JOIN outs USING (dataset, url) LEFT JOIN ins USING (dataset, url)""",
)
def page_upsert(spark, sf_dir):
    return _stored_twice(spark, sf_dir).where("fetched_at is not null").select(
        "dataset", "url", F.length("content").alias("content_length"), joined("outgoing").alias("outgoing"), "incoming_count", "in_degree"
    )


@query(
    "snk2_incoming_upsert",
    f"""WITH {TWICE} SELECT dataset, url, incoming_count, in_degree FROM ins
    WHERE NOT EXISTS (SELECT 1 FROM latest l WHERE l.dataset = ins.dataset AND l.url = ins.url)""",
)
def incoming_upsert(spark, sf_dir):
    return _stored_twice(spark, sf_dir).where("fetched_at is null and content = ''").select("dataset", "url", "incoming_count", "in_degree")


# ---- column functions ----------------------------------------------------------------------------

@query("fn1_words", f"SELECT doc_id, array_to_string({Q.words('text')}, ' ') AS words, len({Q.words('text')}) AS n FROM documents")
def words(spark, sf_dir):
    tokens = T.tokens(F.col("text"))
    return B.texts(spark, sf_dir, "documents").select("doc_id", joined(tokens).alias("words"), F.size(tokens).alias("n"))


@query("fn2_raw_words", f"SELECT doc_id, array_to_string({Q.raw_words('text')}, '|') AS words FROM documents")
def raw_words(spark, sf_dir):
    return B.texts(spark, sf_dir, "documents").select("doc_id", joined(T.raw_tokens(F.col("text")), "|").alias("words"))


BASE_DIR = "regexp_extract(url, '^(https?://[^/?#]+/(?:[^?#]*/)?)', 1)"
ORIGIN = "regexp_extract(url, '^(https?://[^/?#]+)', 1)"
WORD = Q.encode_path("href")
# the same link word written in eight ways, and what each must resolve to on its page
FORMS = {
    "root": ("'/' || w", f"{ORIGIN} || '/' || e"),
    "plain": ("w", f"{BASE_DIR} || e"),
    "here": ("'./' || w", f"{BASE_DIR} || e"),
    "up": ("'../../../' || w", f"{ORIGIN} || '/' || e"),
    "query": ("'?' || w", "regexp_replace(url, '[?].*$', '') || '?' || e"),
    "fragment": ("'#' || w", "url"),
    "host": ("'//Other.example.com:443/a/../' || w", "regexp_extract(url, '^(https?:)', 1) || '//other.example.com' || CASE WHEN url LIKE 'https:%' THEN '' ELSE ':443' END || '/' || e"),
    "full": ("'HTTP://Other.example.com:80/x y/' || w", "'http://other.example.com/x%20y/' || e"),
    "mail": ("'mailto:' || w", None),
}


def _forms_sql() -> str:
    parts = [
        f"SELECT dataset, url AS page, '{k}' AS form, {h} AS href, {x} AS target FROM given" for k, (h, x) in FORMS.items() if x
    ]
    return (
        f"WITH {Q.CAPTURES}, {Q.RAW_LINKS}, given AS (SELECT DISTINCT dataset, src AS url, href[2:] AS w, "
        f"{Q.encode_path('href[2:]')} AS e FROM raw_links) " + " UNION ALL ".join(parts)
    )


@query("fn6_resolve_links", _forms_sql())
def resolve_links(spark, sf_dir):
    given = L.raw_links(B.captures(spark, sf_dir)).select(
        "dataset", F.col("src").alias("page"), F.expr("substring(href, 2)").alias("w")
    ).distinct()
    forms = F.array(*[F.struct(F.lit(k).alias("form"), F.expr(h).alias("href")) for k, (h, _) in FORMS.items()])
    rows = given.select("dataset", "page", F.inline(forms))
    usable = rows.where(U.usable_href(F.col("href")))
    return U.with_resolved(usable, "href", "page", "target")


@query("fn7_directory", f"SELECT page_id, {BASE_DIR} AS directory FROM pages")
def directory(spark, sf_dir):
    return B.texts(spark, sf_dir, "pages").select("page_id", U.directory_prefix(F.col("url")).alias("directory"))


@query(
    "fn8_encode_component",
    f"SELECT page_id, {Q.encode_component('url')} AS encoded, {Q.encode_component(Q.title('html'))} AS encoded_title FROM pages",
)
def encode_component(spark, sf_dir):
    return B.texts(spark, sf_dir, "pages").select(
        "page_id", U.encode_component(F.col("url")).alias("encoded"),
        U.encode_component(H.page_title(F.col("html"))).alias("encoded_title"),
    )


@query("fn9_trim", f"SELECT doc_id, {Q.trim('chr(160) || chr(9) || text || chr(8195)')} AS trimmed FROM documents")
def trim(spark, sf_dir):
    edge = F.concat(F.lit(" \t"), "text", F.lit(" "))
    return B.texts(spark, sf_dir, "documents").select("doc_id", T.trim_white(edge).alias("trimmed"))


@query(
    "fn10_math",
    "SELECT p_partkey, round(log2(p_retailprice), 9) AS lg, round(sqrt(p_retailprice), 9) AS root, "
    "greatest(p_size, 10) AS hi, least(p_size, 10) AS lo, abs(p_size - 25) AS gap FROM part",
)
def math(spark, sf_dir):
    size = F.col("p_size")
    return B.table(spark, sf_dir, "part").select(
        "p_partkey", F.round(F.log2("p_retailprice"), 9).alias("lg"), F.round(F.sqrt("p_retailprice"), 9).alias("root"),
        F.greatest(size, F.lit(10)).alias("hi"), F.least(size, F.lit(10)).alias("lo"), F.abs(size - 25).alias("gap"),
    )


@query(
    "fn11_sizes",
    f"WITH {Q.OPEN_CRAWL}, o AS (SELECT dataset, src, count(*) AS n FROM current_links GROUP BY 1, 2) "
    "SELECT p.dataset, p.url, coalesce(n, 0) AS n FROM page p LEFT JOIN o ON o.dataset = p.dataset AND o.src = p.url",
)
def sizes(spark, sf_dir):
    found = open_crawl(spark, sf_dir)
    empty = F.array().cast("array<string>")
    return found.pages.join(L.outgoing_lists(found.current), ["dataset", "url"], "left").select(
        "dataset", "url", F.size(F.coalesce("outgoing", empty)).alias("n")
    )


@query("fn13_time_text", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS iso FROM events")
def time_text(spark, sf_dir):
    return B.table(spark, sf_dir, "events").select(
        "event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("iso")
    )


@query("fn14_json", "SELECT event_id, (props->>'k')::BIGINT AS k, json_object('id', event_id, 'type', event_type)::VARCHAR AS body FROM events")
def json_both_ways(spark, sf_dir):
    return B.table(spark, sf_dir, "events").select(
        "event_id", F.from_json("props", "k bigint")["k"].alias("k"),
        F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("body"),
    )


@query("fn15_last_part", "SELECT page_id, string_split(url, '/')[-1] AS part FROM pages")
def last_part(spark, sf_dir):
    return B.texts(spark, sf_dir, "pages").select("page_id", U.last_part(F.col("url")).alias("part"))


# ---- text and links of pages ----------------------------------------------------------------------

@query("html1_paragraphs", f"SELECT page_id, {Q.paragraphs('html')} AS text FROM pages")
def paragraphs(spark, sf_dir):
    return B.texts(spark, sf_dir, "pages").select("page_id", H.paragraph_text(F.col("html")).alias("text"))


@query("html2_title", f"SELECT page_id, {Q.title('html')} AS title FROM pages")
def title(spark, sf_dir):
    return B.texts(spark, sf_dir, "pages").select("page_id", H.page_title(F.col("html")).alias("title"))


@query("html3_paragraphs_keep_empty", f"SELECT page_id, {Q.paragraphs('html', True)} AS text FROM pages")
def paragraphs_keep_empty(spark, sf_dir):
    return B.texts(spark, sf_dir, "pages").select("page_id", H.paragraph_text_keep_empty(F.col("html")).alias("text"))


@query("html4_link_values", f"WITH {Q.CAPTURES}, {Q.RAW_LINKS} SELECT dataset, src, position, href FROM raw_links")
def link_values(spark, sf_dir):
    return L.raw_links(B.captures(spark, sf_dir)).select("dataset", "src", "position", "href")


@query(
    "flt14_usable_links",
    f"""WITH {Q.CAPTURES}, {Q.RAW_LINKS}, v AS (
    SELECT DISTINCT dataset, src, unnest([href, 'mailto:' || href, ' javascript:' || href, 'tel:' || href, '  ', 'MAILTO:' || href]) AS href FROM raw_links)
    SELECT * FROM v WHERE {Q.trim('href')} <> '' AND NOT regexp_matches({Q.trim('href')}, '^(mailto:|javascript:|tel:)')""",
)
def usable_links(spark, sf_dir):
    h = F.col("href")
    forms = F.array(h, F.concat(F.lit("mailto:"), h), F.concat(F.lit(" javascript:"), h), F.concat(F.lit("tel:"), h), F.lit("  "),
                    F.concat(F.lit("MAILTO:"), h))
    rows = L.raw_links(B.captures(spark, sf_dir)).select("dataset", "src", F.explode(forms).alias("href")).distinct()
    return rows.where(U.usable_href(h))


@query("flt15_allowed_pages", f"WITH {Q.CRAWL} SELECT dataset, seq, url FROM kept")
def allowed_pages(spark, sf_dir):
    return crawl(spark, sf_dir).captures.select("dataset", "seq", "url")


@query(
    "jn8_links_by_prefix",
    f"""WITH {Q.CAPTURES}, {Q.SEEDS}, {Q.PREFIXES}, {Q.RAW_LINKS}, {Q.TARGETS}
    SELECT dataset, src, dst FROM targets t WHERE EXISTS (
      SELECT 1 FROM prefixes p WHERE p.dataset = t.dataset AND starts_with(t.dst, p.prefix)) GROUP BY 1, 2, 3""",
)
def links_by_prefix(spark, sf_dir):
    return L.within_prefixes(open_crawl(spark, sf_dir).links, "dst", crawl(spark, sf_dir).prefixes).select("dataset", "src", "dst")


@query("lnk1_page_links", f"WITH {Q.CRAWL} SELECT dataset, src, dst, position FROM current_links")
def page_links(spark, sf_dir):
    found = crawl(spark, sf_dir)
    links = L.distinct_links(L.fetched_links(found.captures, found.prefixes))
    return L.current_links(links, found.captures)


@query("lnk2_default_prefixes", f"WITH {Q.CAPTURES}, {Q.SEEDS}, {Q.PREFIXES} SELECT dataset, prefix FROM prefixes")
def default_prefixes(spark, sf_dir):
    return L.prefixes_or_default(B.seeds(spark, sf_dir), B.configured_prefixes(spark))


FREQUENCY = f"""freq AS (
  SELECT dataset, url, word, count(*) AS n, min(place) AS place FROM (
    SELECT dataset, url, unnest(w) AS word, unnest(range(len(w))) AS place
    FROM (SELECT dataset, url, {Q.words(Q.paragraphs('content'))} AS w FROM page)) GROUP BY ALL),
freq50 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset, url ORDER BY n DESC, place) AS position FROM freq)
  WHERE position <= 50)"""


@query("wf1_word_frequency", f"WITH {Q.OPEN_CRAWL}, {FREQUENCY} SELECT dataset, url, position, word, n FROM freq50")
def word_frequency(spark, sf_dir):
    return L.word_frequency(open_crawl(spark, sf_dir).pages)


@query("tk5_top_words", f"WITH {Q.OPEN_CRAWL}, {FREQUENCY} SELECT dataset, url, word, n FROM freq50 WHERE position = 1")
def top_words(spark, sf_dir):
    return L.word_frequency(open_crawl(spark, sf_dir).pages, 1).drop("position")


# ---- link graph ---------------------------------------------------------------------------------------

@query("deg1_in_degree", f"WITH {Q.OPEN_CRAWL} SELECT dataset, url, in_degree FROM page")
def in_degree(spark, sf_dir):
    found = open_crawl(spark, sf_dir)
    return found.pages.select("dataset", "url").join(L.in_degrees(found.links), ["dataset", "url"], "left").fillna({"in_degree": 0})


@query("deg2_incoming_counter", f"WITH {Q.OPEN_CRAWL} SELECT dataset, dst AS url, 2 * count(*) AS incoming_count FROM fetched GROUP BY 1, 2")
def incoming_counter(spark, sf_dir):
    fetched = open_crawl(spark, sf_dir).fetched
    return L.link_counters(fetched.unionByName(fetched))


@query(
    "deg3_out_degree",
    f"WITH {Q.OPEN_CRAWL} SELECT p.dataset, p.url, count(l.dst) AS out_degree FROM page p "
    "LEFT JOIN current_links l ON l.dataset = p.dataset AND l.src = p.url GROUP BY 1, 2",
)
def out_degree(spark, sf_dir):
    return open_crawl(spark, sf_dir).pages.select("dataset", "url", "out_degree")


@query("dst1_distinct_links", f"WITH {Q.CAPTURES}, {Q.RAW_LINKS} SELECT DISTINCT dataset, src, href FROM raw_links")
def distinct_links(spark, sf_dir):
    return L.raw_links(B.captures(spark, sf_dir)).select("dataset", "src", "href").distinct()


@query("set2_pages_and_stubs", f"WITH {Q.OPEN_CRAWL} SELECT dataset, url, content = '' AS stub FROM page")
def pages_and_stubs(spark, sf_dir):
    return open_crawl(spark, sf_dir).pages.select("dataset", "url", (F.col("content") == "").alias("stub"))


@query(
    "grf1_page_table",
    f"""WITH {Q.CRAWL}, latest AS (SELECT dataset, url, max_by(html, seq) AS html, max(seq) AS seq FROM kept GROUP BY 1, 2),
    ins AS (SELECT dataset, dst, count(DISTINCT src) AS n, string_agg(DISTINCT src, ' ' ORDER BY src) AS incoming FROM links GROUP BY 1, 2),
    outs AS (SELECT dataset, src, count(*) AS n, string_agg(dst, ' ' ORDER BY position) AS outgoing FROM current_links GROUP BY 1, 2)
    SELECT coalesce(l.dataset, i.dataset) AS dataset, coalesce(l.url, i.dst) AS url, coalesce(seq, 4611686018427387904) AS seq,
      length(coalesce(html, '')) AS content_length, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree,
      coalesce(incoming, '') AS incoming, coalesce(outgoing, '') AS outgoing
    FROM latest l FULL JOIN ins i ON i.dataset = l.dataset AND i.dst = l.url
    LEFT JOIN outs o ON o.dataset = l.dataset AND o.src = l.url""",
)
def page_table(spark, sf_dir):
    found = crawl(spark, sf_dir)
    key = ["dataset", "url"]
    return (
        L.page_table(found.captures, found.links, found.current)
        .join(L.incoming_lists(found.links), key, "left")
        .join(L.outgoing_lists(found.current), key, "left")
        .select(
            *key, "seq", F.length("content").alias("content_length"), "out_degree", "in_degree",
            F.coalesce(joined("incoming"), F.lit("")).alias("incoming"), F.coalesce(joined("outgoing"), F.lit("")).alias("outgoing"),
        )
    )


POPULAR = "row_number() OVER (PARTITION BY dataset ORDER BY in_degree DESC, url)"


@query(
    "grf3_popular_pages",
    f"""WITH {Q.OPEN_CRAWL} SELECT * FROM (SELECT dataset, {POPULAR} AS position,
    '{BASE}/' || dataset || '/page?webUrl=' || {Q.encode_component('url')} AS link, url AS orig_url, in_degree FROM page) WHERE position <= 10""",
)
def popular_pages(spark, sf_dir):
    return L.popular_pages(open_crawl(spark, sf_dir).pages, BASE)


@query("tk1_most_linked", f"WITH {Q.OPEN_CRAWL} SELECT dataset, url, in_degree FROM (SELECT *, {POPULAR} AS position FROM page) WHERE position <= 10")
def most_linked(spark, sf_dir):
    return L.popular_pages(open_crawl(spark, sf_dir).pages, BASE).select("dataset", F.col("orig_url").alias("url"), "in_degree")


@query(
    "prj2_popularity_rows",
    f"WITH {Q.OPEN_CRAWL} SELECT url AS orig_url, '{BASE}/' || dataset || '/page?webUrl=' || {Q.encode_component('url')} AS link FROM page",
)
def popularity_rows(spark, sf_dir):
    return open_crawl(spark, sf_dir).pages.select(F.col("url").alias("orig_url"), L.detail_address(BASE).alias("link"))


@query(
    "ag13_crawl_summary",
    f"WITH {Q.CRAWL} SELECT c.dataset, count(DISTINCT c.url) AS visited, count(*) AS processed FROM captures c GROUP BY 1",
)
def crawl_summary(spark, sf_dir):
    return B.captures(spark, sf_dir).groupBy("dataset").agg(
        F.count_distinct("url").alias("visited"), F.count(F.lit(1)).alias("processed")
    )


# ---- reachability ---------------------------------------------------------------------------------

def _reach_sql(graph: str, seed: str) -> str:
    return f"""WITH RECURSIVE {graph}, seed AS (SELECT dataset, {seed} AS url FROM g_nodes GROUP BY 1),
    hop(dataset, url, depth) USING KEY (dataset, url) AS (
      SELECT dataset, url, 0 FROM seed
      UNION
      SELECT e.dataset, e.dst, h.depth + 1 FROM hop h JOIN g_edges e ON e.dataset = h.dataset AND e.src = h.url
      WHERE NOT EXISTS (SELECT 1 FROM recurring.hop k WHERE k.dataset = e.dataset AND k.url = e.dst))
    SELECT dataset, url, depth FROM hop"""


def _seed_of(nodes: DataFrame, pick) -> DataFrame:
    return nodes.groupBy("dataset").agg(pick("url").alias("url"))


@query("grf2_reachable_trade", _reach_sql(Q.TRADE, "min(url)"))
def reachable_trade(spark, sf_dir):
    nodes, edges = B.trade_graph(spark, sf_dir)
    return L.reachable(edges, _seed_of(nodes, F.min))


@query("grf2_reachable_succession", _reach_sql(Q.SUCCESSION, "max(url)"))
def reachable_succession(spark, sf_dir):
    nodes, edges = B.succession_graph(spark, sf_dir)
    return L.reachable(edges, _seed_of(nodes, F.max))


@query(
    "grf2_budgeted_crawl",
    f"""WITH RECURSIVE {Q.TRADE}, seed AS (SELECT dataset, min(url) AS url FROM g_nodes GROUP BY 1),
    hop(dataset, url, depth) USING KEY (dataset, url) AS (
      SELECT dataset, url, 0 FROM seed
      UNION
      SELECT e.dataset, e.dst, h.depth + 1 FROM hop h JOIN g_edges e ON e.dataset = h.dataset AND e.src = h.url
      WHERE NOT EXISTS (SELECT 1 FROM recurring.hop k WHERE k.dataset = e.dataset AND k.url = e.dst))
    SELECT dataset, url, depth FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY depth, url) AS n FROM hop) WHERE n <= 500""",
)
def budgeted_crawl(spark, sf_dir):
    nodes, edges = B.trade_graph(spark, sf_dir)
    return L.reachable(edges, _seed_of(nodes, F.min), max_pages=500)


@query(
    "jn10_unvisited_links",
    f"""WITH {Q.CRAWL} SELECT DISTINCT dataset, dst AS url FROM links l
    WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.dataset = l.dataset AND k.url = l.dst)""",
)
def unvisited_links(spark, sf_dir):
    found = crawl(spark, sf_dir)
    targets = found.links.select("dataset", F.col("dst").alias("url")).distinct()
    return targets.join(found.captures, ["dataset", "url"], "left_anti")


@query(
    "chk2_page_keys",
    f"WITH {Q.CAPTURES} SELECT dataset, url, 2 * count(*) AS copies FROM captures GROUP BY 1, 2",
)
def page_keys(spark, sf_dir):
    captures = B.captures(spark, sf_dir).select("dataset", "url")
    return integrity.duplicate_keys(captures.unionByName(captures), ["dataset", "url"])
