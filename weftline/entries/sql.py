"""Building blocks of the checking SQL (DuckDB dialect)."""

from __future__ import annotations

from weftline.functions.text import HIGH_WHITE, LOW_WHITE

WHITE = f"[{LOW_WHITE}{HIGH_WHITE}]"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{WHITE}+|{WHITE}+$', '', 'g')"


def decode(x: str) -> str:
    """Entities that occur in the given pages; the ampersand last."""
    for entity, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{char}')"
    return x


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '{WHITE}+'), lambda w: w <> '')"


def raw_words(x: str) -> str:
    return f"regexp_split_to_array({x}, '{WHITE}+')"


def clean(html: str) -> str:
    return f"regexp_replace({html}, '(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>', '', 'g')"


def paragraphs(html: str, keep_empty: bool = False) -> str:
    """Paragraph text by splitting at opening tags and cutting each piece at the next block tag."""
    cut = "'(?is)</?(?:p|article|body|html|div|footer|h1|ul|li|nav)(?:\\s[^>]*)?>.*$'"
    piece = trim(decode(f"regexp_replace(regexp_replace(c, {cut}, ''), '<[^>]*>', '', 'g')"))
    pieces = f"list_transform(regexp_split_to_array({clean(html)}, '(?i)<p(?:\\s[^>]*)?>')[2:], lambda c: {piece})"
    if not keep_empty:
        pieces = f"list_filter({pieces}, lambda t: t <> '')"
    return f"coalesce(array_to_string({pieces}, ' '), '')"


def title(html: str) -> str:
    first = trim(decode(f"regexp_extract({clean(html)}, '(?is)<title>(.*?)</title>', 1)"))
    second = trim(decode(f"regexp_replace(regexp_extract({clean(html)}, '(?is)<h1>(.*?)</h1>', 1), '<[^>]*>', '', 'g')"))
    return f"coalesce(nullif({first}, ''), nullif({second}, ''), 'Untitled')"


def idf(df: str, n: str) -> str:
    return f"CASE WHEN {df} > 0 THEN greatest(0.0, log2({n}::DOUBLE / (1 + {df}))) ELSE 0.0 END"


def clamp(text: str) -> str:
    number = f"try_cast(nullif(regexp_extract({trim(f'coalesce({text}, chr(32))')}, '^[+-]?[0-9]+'), '') AS BIGINT)"
    return f"least(50, greatest(1, coalesce(nullif({number}, 0), 10)))"


def encode_path(x: str) -> str:
    return f"replace(replace(url_encode({x}), '%2F', '/'), '%2C', ',')"


def encode_component(x: str) -> str:
    x = f"url_encode({x})"
    for code, char in (("%21", "!"), ("%27", "''"), ("%28", "("), ("%29", ")"), ("%2A", "*")):
        x = f"replace({x}, '{code}', '{char}')"
    return x


CAPTURES = r"""captures AS MATERIALIZED (
  SELECT regexp_extract(url, '^https?://(?:[^/?#]*\.)?(example\.(?:com|net|org))(?:[/?#:]|$)', 1) AS dataset,
         page_id AS seq, regexp_replace(url, '#.*$', '') AS url, html
  FROM pages)"""

SEEDS = "seeds AS (SELECT dataset, min_by(url, seq) AS seed FROM captures GROUP BY dataset)"

RAW_LINKS = f"""raw_links AS (
  SELECT dataset, seq, url AS src, unnest(hrefs) AS href, unnest(range(len(hrefs))) AS position
  FROM (SELECT dataset, seq, url, regexp_extract_all({clean('html')}, '<a href="([^"]*)"', 1) AS hrefs FROM captures))"""

# the given links are all root-relative
TARGETS = f"""targets AS (
  SELECT dataset, seq, src, regexp_extract(src, '^(https?://[^/?#]+)', 1) || {encode_path('href')} AS dst, position
  FROM raw_links WHERE {trim('href')} <> '' AND NOT regexp_matches({trim('href')}, '^(mailto:|javascript:|tel:)'))"""

PREFIXES = r"""prefixes AS (
  SELECT * FROM (VALUES ('example.com', 'https://'), ('example.com', 'http://'), ('example.net', 'https://')) v(dataset, prefix)
  UNION ALL
  SELECT dataset, regexp_extract(seed, '^(https?://[^/?#]+/(?:[^?#]*/)?)', 1) FROM seeds
  WHERE dataset NOT IN ('example.com', 'example.net'))"""

# links over all captures, and those that the latest capture of a page still has
LINKS = """links AS MATERIALIZED (SELECT DISTINCT dataset, src, dst FROM fetched),
newest AS (SELECT dataset, url AS src, max(seq) AS seq FROM captures GROUP BY 1, 2),
current_links AS MATERIALIZED (SELECT f.dataset, f.src, f.dst, f.position FROM fetched f JOIN newest USING (dataset, src, seq))"""

# links and page table of the crawl with the configured prefixes
CRAWL = f"""{CAPTURES}, {SEEDS}, {PREFIXES}, {RAW_LINKS}, {TARGETS},
kept AS MATERIALIZED (SELECT * FROM captures c WHERE EXISTS (
  SELECT 1 FROM prefixes p WHERE p.dataset = c.dataset AND starts_with(c.url, p.prefix))),
fetched AS MATERIALIZED (
  SELECT t.dataset, t.seq, t.src, t.dst, min(t.position) AS position FROM targets t
  WHERE EXISTS (SELECT 1 FROM prefixes p WHERE p.dataset = t.dataset AND starts_with(t.dst, p.prefix))
    AND EXISTS (SELECT 1 FROM kept k WHERE k.dataset = t.dataset AND k.seq = t.seq)
  GROUP BY 1, 2, 3, 4),
{LINKS.replace('captures', 'kept')}"""

# the same with every address allowed
OPEN_CRAWL = f"""{CAPTURES}, {RAW_LINKS}, {TARGETS},
fetched AS MATERIALIZED (SELECT dataset, seq, src, dst, min(position) AS position FROM targets GROUP BY 1, 2, 3, 4),
{LINKS},
latest AS MATERIALIZED (SELECT dataset, url, max_by(html, seq) AS html, max(seq) AS seq FROM captures GROUP BY 1, 2),
page AS MATERIALIZED (
  SELECT coalesce(l.dataset, i.dataset) AS dataset, coalesce(l.url, i.dst) AS url, coalesce(l.html, '') AS content,
         coalesce(l.seq, 4611686018427387904) AS seq, coalesce(i.in_degree, 0) AS in_degree
  FROM latest l FULL JOIN (SELECT dataset, dst, count(DISTINCT src) AS in_degree FROM links GROUP BY 1, 2) i
    ON l.dataset = i.dataset AND l.url = i.dst)"""


def rank_sql(nodes: str, edges: str) -> str:
    """PageRank by a recursive query over one graph: ``nodes(dataset, url)`` and ``edges(dataset, src, dst)``."""
    return f"""pr_n AS MATERIALIZED (SELECT dataset, count(*) AS n FROM {nodes} GROUP BY 1),
pr_out AS MATERIALIZED (SELECT dataset, src, count(*) AS o FROM {edges} GROUP BY 1, 2),
pr_edges AS MATERIALIZED (SELECT e.dataset, e.src, e.dst, o.o FROM {edges} e JOIN pr_out o USING (dataset, src)),
walk(dataset, url, n, pr, step, d) AS (
  SELECT v.dataset, v.url, s.n, 1.0::DOUBLE / s.n, 0, 1.0::DOUBLE FROM {nodes} v JOIN pr_n s USING (dataset)
  UNION ALL
  SELECT dataset, url, n, new, step, sqrt(sum((new - pr) * (new - pr)) OVER (PARTITION BY dataset)) FROM (
    SELECT w.dataset, w.url, w.n, w.pr, w.step + 1 AS step, 0.1 / w.n + 0.9 * coalesce(r.got, 0.0) AS new
    FROM walk w LEFT JOIN (
      SELECT e.dataset, e.dst, sum(x.pr / e.o) AS got FROM walk x JOIN pr_edges e ON e.dataset = x.dataset AND e.src = x.url
      GROUP BY 1, 2) r ON r.dataset = w.dataset AND r.dst = w.url
    WHERE w.d >= 0.0001 AND w.step < 1000)),
ranks AS MATERIALIZED (SELECT dataset, url, arg_max(pr, step) AS pr, max(step) AS steps FROM walk GROUP BY 1, 2)"""


TRADE = """trade_lines AS (SELECT DISTINCT 's' || l_suppkey AS s, 'p' || l_partkey AS p FROM lineitem),
g_edges AS MATERIALIZED (SELECT 'trade' AS dataset, s AS src, p AS dst FROM trade_lines
  UNION ALL SELECT 'trade', p, s FROM trade_lines),
g_nodes AS MATERIALIZED (SELECT DISTINCT dataset, src AS url FROM g_edges)"""

SUCCESSION = """errs AS (SELECT 'u' || user_id AS u, lead('u' || user_id) OVER (ORDER BY ts, event_id) AS v
  FROM events WHERE event_type = 'error'),
g_edges AS MATERIALIZED (SELECT DISTINCT 'succession' AS dataset, u AS src, v AS dst FROM errs WHERE v IS NOT NULL),
g_nodes AS MATERIALIZED (SELECT DISTINCT 'succession' AS dataset, u AS url FROM errs)"""

DOCS = """docs AS MATERIALIZED (SELECT lang AS dataset, doc_id AS doc, '/documents/' || doc_id AS url, source AS title, text FROM documents),
doc_ranks AS (SELECT lang AS dataset, '/documents/' || doc_id AS url, 1.0 / (1.0 + doc_id % 97) AS pr FROM documents)"""

PAGE_DOCS = f"""docs AS MATERIALIZED (
  SELECT dataset, row_number() OVER (ORDER BY seq, dataset, url) - 1 AS doc, url, {title('content')} AS title,
         {paragraphs('content')} AS text FROM page)"""

INDEX = f"""tok AS MATERIALIZED (SELECT dataset, doc, {words('text')} AS w FROM docs),
counts AS MATERIALIZED (
  SELECT dataset, doc, total_words, term, count(*) AS count
  FROM (SELECT dataset, doc, len(w) AS total_words, unnest(w) AS term FROM tok) GROUP BY ALL),
corpus AS MATERIALIZED (SELECT dataset, count(*) AS n FROM docs GROUP BY 1),
terms AS MATERIALIZED (SELECT dataset, term, df, n, {idf('df', 'n')} AS idf FROM (
  SELECT dataset, term, count(*) AS df FROM counts GROUP BY 1, 2) JOIN corpus USING (dataset)),
postings AS MATERIALIZED (
  SELECT dataset, term, doc, count, total_words, log2(1 + count::DOUBLE / total_words) * idf AS weight
  FROM counts JOIN terms USING (dataset, term)),
norms AS MATERIALIZED (SELECT dataset, doc, sqrt(sum(weight * weight)) AS mag FROM postings GROUP BY 1, 2)"""

REQUESTS = f"""asked AS MATERIALIZED (
  SELECT item_id AS query_id, l.lang AS dataset, text, item_id % 2 = 1 AS boost,
         {clamp("(item_id % 12)::VARCHAR")} AS max_results
  FROM benchmark, (SELECT DISTINCT lang FROM documents) l)"""

QUERY_TERMS = f"""qtok AS (SELECT query_id, dataset, {words('text')} AS w FROM asked),
qterms AS MATERIALIZED (
  SELECT query_id, dataset, total, term, count(*) AS count, min(place) AS place
  FROM (SELECT query_id, dataset, len(w) AS total, unnest(w) AS term, unnest(range(len(w))) AS place FROM qtok) GROUP BY ALL),
known AS MATERIALIZED (SELECT q.*, t.df, t.idf FROM qterms q JOIN terms t USING (dataset, term)),
qweights AS MATERIALIZED (
  SELECT query_id, dataset, term, place, q_weight FROM (
    SELECT *, log2(1 + count::DOUBLE / total) * idf AS q_weight FROM known) WHERE q_weight <> 0),
qnorms AS MATERIALIZED (SELECT query_id, dataset, sqrt(sum(q_weight * q_weight)) AS q_mag FROM qweights GROUP BY 1, 2),
dots AS MATERIALIZED (
  SELECT q.query_id, q.dataset, p.doc, sum(q_weight * weight) AS dot, sqrt(sum(weight * weight)) AS shared_mag, min(place) AS place
  FROM qweights q JOIN postings p USING (dataset, term) GROUP BY 1, 2, 3)"""


def padded(scored: str, asked: str) -> str:
    """Results cut to the limit and filled with score-0 documents in document order.

    ``scored(query_id, dataset, doc, score, tie)``, ``asked(query_id, dataset, max_results)``.
    """
    return f"""best AS (
  SELECT s.* FROM (SELECT *, row_number() OVER (PARTITION BY query_id, dataset ORDER BY round(score, 12) DESC, tie, doc) AS position
    FROM {scored}) s JOIN {asked} a USING (query_id, dataset) WHERE position <= a.max_results),
fill AS (
  SELECT a.query_id, a.dataset, d.doc, a.max_results, b.n AS found,
         row_number() OVER (PARTITION BY a.query_id, a.dataset ORDER BY d.doc) AS k
  FROM {asked} a LEFT JOIN (SELECT query_id, dataset, count(*) AS n FROM best GROUP BY 1, 2) b USING (query_id, dataset)
  JOIN docs d ON d.dataset = a.dataset
  WHERE NOT EXISTS (SELECT 1 FROM best x WHERE x.query_id = a.query_id AND x.dataset = a.dataset AND x.doc = d.doc)),
results AS (
  SELECT query_id, dataset, doc, score, position FROM best
  UNION ALL SELECT query_id, dataset, doc, 0.0, coalesce(found, 0) + k FROM fill WHERE coalesce(found, 0) + k <= max_results)"""


PRODUCTS = """products AS MATERIALIZED (
  SELECT p_partkey AS id, p_name AS name, p_retailprice AS price, p_size::DOUBLE AS dim_x, (p_size % 7 + 1)::DOUBLE AS dim_y,
         (p_partkey % 11 + 1)::DOUBLE AS dim_z, (p_partkey * 7) % 50 AS stock FROM part)"""
LINES = """lines AS MATERIALIZED (
  SELECT l_orderkey AS order_id, l_linenumber::BIGINT AS line, l_partkey AS product_id, l_quantity::BIGINT AS quantity FROM lineitem)"""
SHIFTED = """lines AS MATERIALIZED (
  SELECT l_orderkey AS order_id, l_linenumber::BIGINT AS line, l_partkey + 5 AS product_id, l_quantity::BIGINT AS quantity FROM lineitem)"""
ORDERS = """heads AS MATERIALIZED (
  SELECT o_orderkey AS order_id, 'customer ' || o_custkey AS username, o_orderdate AS ordered_at FROM orders)"""
REVIEW_REQUESTS = """review_requests AS MATERIALIZED (
  SELECT event_id % ((SELECT count(*) FROM part) + 5) AS product_id, user_id::VARCHAR AS name,
         floor(value)::BIGINT % 12 AS rating, event_type AS text, ts AS date FROM events)"""
REVIEWS = REVIEW_REQUESTS + """,
reviews AS MATERIALIZED (SELECT product_id, name, rating::DOUBLE AS rating, text FROM review_requests)"""
PRODUCT_REQUESTS = """requests AS MATERIALIZED (
  SELECT p_partkey AS request_id,
    CASE p_partkey % 10 WHEN 0 THEN '' WHEN 7 THEN '  ' ELSE ' ' || p_name END AS name,
    CASE p_partkey % 10 WHEN 1 THEN '-1' WHEN 2 THEN 'abc' ELSE p_retailprice::VARCHAR END AS price,
    CASE p_partkey % 10 WHEN 6 THEN '-2' ELSE p_size::VARCHAR END AS x, p_size::VARCHAR AS y,
    CASE p_partkey % 10 WHEN 4 THEN NULL ELSE p_size::VARCHAR END AS z,
    CASE p_partkey % 10 WHEN 3 THEN '1.5' WHEN 5 THEN '' ELSE p_size::VARCHAR END AS stock FROM part)"""


def number(x: str) -> str:
    return f"CASE WHEN trim({x}) = '' THEN 0.0 ELSE try_cast({x} AS DOUBLE) END"
