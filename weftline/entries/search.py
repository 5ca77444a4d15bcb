"""Index tables and searches over documents and captured pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline import bindings as B
from weftline.entries import sql as Q
from weftline.entries.ranks import PAGE_RANKS, page_ranks
from weftline.entries.registry import prepared, query
from weftline.entries.web import open_crawl
from weftline.functions import html as H, text as T
from weftline.operators import index as I, links as L, search as S
from weftline.plans.lineage import materialize, scratch_path, spread

R9 = "round({0}, 9) AS {0}"
INDEX = f"{Q.DOCS}, {Q.INDEX}"
ASKED = f"{INDEX}, {Q.REQUESTS}, {Q.QUERY_TERMS}"


@prepared
def document_index(spark, sf_dir) -> I.SearchIndex:
    """Index of the text documents, one dataset per language."""
    return I.build_index(B.documents(spark, sf_dir))


@prepared
def ranked_index(spark, sf_dir) -> I.SearchIndex:
    """The same index with the documents' ranks."""
    return I.with_ranks(document_index(spark, sf_dir), B.document_ranks(spark, sf_dir))


@prepared
def page_index(spark, sf_dir) -> I.SearchIndex:
    """Index of the captured pages and stubs."""
    return I.build_index(I.documents_of_pages(open_crawl(spark, sf_dir).pages))


def _asked(spark, sf_dir):
    return B.search_requests(spark, sf_dir)


def _known(spark, sf_dir):
    return S.known_terms(S.query_terms(_asked(spark, sf_dir)), document_index(spark, sf_dir))


def _weights(spark, sf_dir):
    return S.query_weights(_known(spark, sf_dir))


def rounded(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.round(c, 9))
    return df


# ---- index ------------------------------------------------------------------------------------------

@query("ag1_term_counts", f"WITH {INDEX} SELECT dataset, doc, total_words, term, count FROM counts")
def term_counts(spark, sf_dir):
    return I.term_counts(B.documents(spark, sf_dir))


@query("ag2_word_totals", f"SELECT lang AS dataset, doc_id AS doc, len({Q.words('text')}) AS total_words FROM documents")
def word_totals(spark, sf_dir):
    return I.tokenised(spread(B.documents(spark, sf_dir))).select("dataset", "doc", "total_words")


@query("ag3_document_frequency", f"WITH {INDEX} SELECT dataset, term, df FROM terms")
def document_frequency(spark, sf_dir):
    return I.document_frequencies(I.term_counts(B.documents(spark, sf_dir)))


@query("ag4_postings_list", f"WITH {INDEX} SELECT dataset, term, block, string_agg(doc, ' ' ORDER BY doc) AS docs "
       "FROM (SELECT *, (row_number() OVER (PARTITION BY dataset, term ORDER BY doc) - 1) // 100000 AS block FROM counts) GROUP BY 1, 2, 3")
def postings_list(spark, sf_dir):
    from weftline.plans.shaping import nest

    index, key = document_index(spark, sf_dir), ["dataset", "term"]
    sizes = index.terms.select(*key, F.col("df").alias("_size"))
    lists = nest(index.entries, key, F.col("doc"), "docs", lists=True, sizes=sizes)
    return lists.select("dataset", "term", "block", F.array_join(F.col("docs").cast("array<string>"), " ").alias("docs"))


@query("ag5_corpus_size", f"WITH {INDEX} SELECT dataset, n FROM corpus")
def corpus_size(spark, sf_dir):
    return I.corpus_sizes(B.documents(spark, sf_dir))


@query("ag6_document_norm", f"WITH {INDEX} SELECT dataset, doc, {R9.format('mag')} FROM norms")
def document_norm(spark, sf_dir):
    docs = document_index(spark, sf_dir).docs
    return rounded(docs.where("total_words > 0").select("dataset", "doc", "mag"), "mag")


@query(
    "idx1_build_index",
    f"WITH {INDEX} SELECT dataset, term, doc, count, total_words, {R9.format('weight')}, {R9.format('mag')} FROM postings JOIN norms USING (dataset, doc)",
)
def build_index(spark, sf_dir):
    """Builds the index anew, stores it by dataset and reads it back."""
    path = scratch_path(spark, "index")
    I.write_index(I.build_index(B.documents(spark, sf_dir), written=False), path)
    postings = I.read_index(spark, path).postings
    nine = [(F.floor(F.col(c) * 1e9 + 0.5) / 1e9).alias(c) for c in ("weight", "mag")]  # as the SQL rounds, without a decimal for each value
    return postings.select("dataset", "term", "doc", "count", "total_words", *nine)


@query("idx1_page_index", f"WITH {Q.OPEN_CRAWL}, {Q.PAGE_DOCS}, {Q.INDEX} SELECT d.dataset, d.doc, url, title, coalesce(len(w), 0) AS total_words, round(coalesce(mag, 0.0), 9) AS mag FROM docs d LEFT JOIN tok USING (dataset, doc) LEFT JOIN norms USING (dataset, doc)")
def page_index_docs(spark, sf_dir):
    return rounded(page_index(spark, sf_dir).docs.select("dataset", "doc", "url", "title", "total_words", "mag"), "mag")


@query("idx2_tokenised_documents", f"SELECT lang AS dataset, doc_id AS doc, array_to_string({Q.words('text')}, ' ') AS words FROM documents")
def tokenised_documents(spark, sf_dir):
    return I.tokenised(spread(B.documents(spark, sf_dir))).select("dataset", "doc", F.array_join("tokens", " ").alias("words"))


@query("fn3_term_frequency", f"WITH {INDEX} SELECT dataset, doc, term, round(count::DOUBLE / total_words, 9) AS tf FROM counts")
def term_frequency(spark, sf_dir):
    tf = T.term_frequency(F.col("count"), F.col("total_words"))
    return document_index(spark, sf_dir).postings.select("dataset", "doc", "term", F.round(tf, 9).alias("tf"))


@query("fn4_inverse_document_frequency", f"WITH {INDEX} SELECT dataset, term, n, {R9.format('idf')} FROM terms")
def inverse_document_frequency(spark, sf_dir):
    return rounded(document_index(spark, sf_dir).terms.select("dataset", "term", "n", "idf"), "idf")


@query("fn5_weight", f"WITH {INDEX} SELECT dataset, doc, term, {R9.format('weight')} FROM postings")
def weight(spark, sf_dir):
    return rounded(document_index(spark, sf_dir).postings.select("dataset", "doc", "term", "weight"), "weight")


# ---- query vectors -----------------------------------------------------------------------------------

@query("jn4_known_words", f"WITH {ASKED} SELECT query_id, dataset, term, df FROM known")
def known_words(spark, sf_dir):
    return _known(spark, sf_dir).select("query_id", "dataset", "term", "df")


@query("ag7_query_weights", f"WITH {ASKED} SELECT query_id, dataset, term, {R9.format('q_weight')}, {R9.format('q_mag')} FROM qweights JOIN qnorms USING (query_id, dataset)")
def query_weights(spark, sf_dir):
    weights = materialize(_weights(spark, sf_dir), "weights")
    both = weights.join(S.query_norms(weights), ["query_id", "dataset"])
    return rounded(both.select("query_id", "dataset", "term", "q_weight", "q_mag"), "q_weight", "q_mag")


@query(
    "jn5_matches",
    f"WITH {ASKED} SELECT query_id, dataset, term, count(*) AS docs, sum(doc)::BIGINT AS doc_sum FROM qweights JOIN postings USING (dataset, term) GROUP BY 1, 2, 3",
)
def matches(spark, sf_dir):
    """Documents of each query word: their number, and the sum of their numbers."""
    return S.word_matches(materialize(_weights(spark, sf_dir), "weights"), document_index(spark, sf_dir))


@query("set1_candidates", f"WITH {ASKED} SELECT query_id, dataset, count(*) AS docs, sum(doc)::BIGINT AS doc_sum FROM dots GROUP BY 1, 2")
def candidates(spark, sf_dir):
    """Documents with a word of each query."""
    return S.candidates(materialize(_weights(spark, sf_dir), "weights"), document_index(spark, sf_dir))


def _ten(rows: str, measure: str, columns: str) -> str:
    """SQL of the ten best of each query, ties in document order."""
    order = f"PARTITION BY query_id, dataset ORDER BY round({measure}, 12) DESC, doc"
    return f"SELECT query_id, dataset, doc, {columns} FROM (SELECT *, row_number() OVER ({order}) AS n FROM {rows}) WHERE n <= 10"


def _top_ten(df, measure: str):
    return S.top_matches(df.withColumn("score", F.col(measure)), S.FIXED_LIMIT, "doc")


@query("ag8_dot_product", f"WITH {ASKED} {_ten('dots', 'dot', R9.format('dot'))}")
def dot_product(spark, sf_dir):
    """The ten largest dot products of each query."""
    found = S.largest_dot_products(materialize(_weights(spark, sf_dir), "weights"), document_index(spark, sf_dir))
    return rounded(found.select("query_id", "dataset", "doc", "dot"), "dot")


@query(
    "ag14_document_vector",
    f"""WITH {ASKED}, cand AS (SELECT DISTINCT query_id, dataset, doc FROM known JOIN postings USING (dataset, term)),
    vectors AS (SELECT query_id, dataset, doc, count(*) AS size, sum(CASE WHEN weight IS NULL THEN 1 ELSE 0 END) AS absent,
      sqrt(sum(coalesce(weight * weight, 0))) AS magnitude
    FROM cand JOIN known USING (query_id, dataset) LEFT JOIN postings USING (dataset, term, doc) GROUP BY 1, 2, 3)
    {_ten('vectors', 'magnitude', 'size, absent, ' + R9.format('magnitude'))}""",
)
def document_vector(spark, sf_dir):
    """The ten longest document vectors of each query."""
    vectors = S.longest_vectors(document_index(spark, sf_dir), _asked(spark, sf_dir))
    return vectors.select(
        "query_id", "dataset", "doc", F.size("vector").alias("size"),
        (F.size("vector") - F.col("present")).alias("absent"), F.round("magnitude", 9).alias("magnitude"),
    )


@query("clp1_limits", f"SELECT doc_id, {Q.clamp('text')} AS of_text, {Q.clamp('(doc_id - 20)::VARCHAR')} AS of_number FROM documents")
def limits(spark, sf_dir):
    docs = B.texts(spark, sf_dir, "documents")
    return docs.select(
        "doc_id", T.clamp_limit(F.col("text")).alias("of_text"),
        T.clamp_limit((F.col("doc_id") - 20).cast("string")).alias("of_number"),
    )


# ---- full-norm search -----------------------------------------------------------------------------------

SCORED = f"""scored AS (
  SELECT d.query_id, d.dataset, d.doc, place AS tie,
    CASE WHEN q_mag * mag = 0 THEN 0.0 ELSE dot / (q_mag * mag) END * CASE WHEN boost THEN 1 + 10 * coalesce(r.pr, 0.0) ELSE 1.0 END AS score
  FROM dots d JOIN qnorms USING (query_id, dataset) JOIN norms n ON n.dataset = d.dataset AND n.doc = d.doc
  JOIN asked a ON a.query_id = d.query_id AND a.dataset = d.dataset
  JOIN docs x ON x.dataset = d.dataset AND x.doc = d.doc LEFT JOIN all_ranks r ON r.dataset = x.dataset AND r.url = x.url)"""
BATCH = f"{ASKED}, all_ranks AS (SELECT * FROM doc_ranks), {SCORED}, {Q.padded('scored', 'asked')}"
SHOWN = """SELECT r.query_id, r.dataset, position, d.url, title, round(score, 9) AS score, round(coalesce(a.pr, 0.0), 9) AS pr
  FROM results r JOIN docs d USING (dataset, doc) LEFT JOIN all_ranks a ON a.dataset = d.dataset AND a.url = d.url"""


@query("srch5_batch_search", f"WITH {BATCH} {SHOWN}")
def batch_search(spark, sf_dir):
    found = S.search(ranked_index(spark, sf_dir), _asked(spark, sf_dir), B.document_ranks(spark, sf_dir))
    return rounded(found, "score", "pr")


def _fixed_sql(words, boost="false", limit="NULL"):
    return f"""asked AS MATERIALIZED (SELECT DISTINCT 0 AS query_id, lang AS dataset, '{words}' AS text, {boost} AS boost,
    {Q.clamp(f"{limit}::VARCHAR")} AS max_results FROM documents)"""


REQUEST = "The und de, thand erle the LA unwhord"


def _single_sql(words, boost, limit, ranks="doc_ranks"):
    return f"{INDEX}, {_fixed_sql(words, boost, limit)}, {Q.QUERY_TERMS}, all_ranks AS (SELECT * FROM {ranks}), {SCORED}, {Q.padded('scored', 'asked')}"


@query("srch1_search", f"WITH {_single_sql(REQUEST, 'false', 'NULL')} {SHOWN}")
def single_search(spark, sf_dir):
    found = S.search(document_index(spark, sf_dir), B.fixed_request(spark, REQUEST), B.document_ranks(spark, sf_dir))
    return rounded(found, "score", "pr")


@query("srch1_search_boosted", f"WITH {_single_sql(REQUEST, 'true', 12)} {SHOWN}")
def boosted_search(spark, sf_dir):
    asked = B.fixed_request(spark, REQUEST, boost=True, limit="12")
    return rounded(S.search(ranked_index(spark, sf_dir), asked, B.document_ranks(spark, sf_dir)), "score", "pr")


@query("srch1_search_unknown", f"WITH {_single_sql('qqq zzz1', 'false', 5)} {SHOWN}")
def unknown_search(spark, sf_dir):
    asked = B.fixed_request(spark, "qqq zzz1", limit="5")
    return rounded(S.search(document_index(spark, sf_dir), asked, B.document_ranks(spark, sf_dir)), "score", "pr")


PAGE_ASKED = f"""asked AS MATERIALIZED (
  SELECT item_id AS query_id, d.dataset, text, true AS boost, 10 AS max_results
  FROM benchmark, (SELECT DISTINCT dataset FROM docs) d)"""


@query(
    "srch1_page_search",
    f"WITH RECURSIVE {PAGE_RANKS}, {Q.PAGE_DOCS}, {Q.INDEX}, {PAGE_ASKED}, {Q.QUERY_TERMS}, all_ranks AS (SELECT dataset, url, pr FROM ranks), "
    f"{SCORED}, {Q.padded('scored', 'asked')} {SHOWN}",
)
def page_search(spark, sf_dir):
    asked = B.page_requests(spark, sf_dir)
    return rounded(S.search(page_index(spark, sf_dir), asked, page_ranks(spark, sf_dir)), "score", "pr")


def _best(spark, sf_dir, limit, *ties):
    """The best boosted matches of the batch."""
    weights = materialize(_weights(spark, sf_dir), "weights")
    asked = materialize(_asked(spark, sf_dir).select(*S.QUERY, "boost", limit.alias("max_results")), "asked")
    return S.best_matches(ranked_index(spark, sf_dir), weights, asked, ties)


@query("bst1_rank_boost", f"WITH {ASKED}, all_ranks AS (SELECT * FROM doc_ranks), {SCORED} {_ten('scored', 'score', R9.format('score'))}")
def rank_boost(spark, sf_dir):
    """The ten best boosted scores of each query."""
    best = _best(spark, sf_dir, F.lit(S.FIXED_LIMIT), "doc")
    return best.select("query_id", "dataset", "doc", F.round("score", 9).alias("score"))


@query("tk2_top_results", f"WITH {BATCH} SELECT query_id, dataset, doc, position FROM best")
def top_results(spark, sf_dir):
    best = _best(spark, sf_dir, T.clamp_limit(F.col("limit")), "place", "doc")
    return best.select("query_id", "dataset", "doc", "position")


def _half(spark, sf_dir):
    """Top results of a request too rare to fill its limit."""
    index = document_index(spark, sf_dir)
    asked = B.fixed_request(spark, "unwhord thand", limit="50").withColumn("max_results", F.lit(50))
    weights = materialize(S.query_weights(S.known_terms(S.query_terms(asked), index)), "weights")
    return index, asked, S.best_matches(index, weights, asked)


HALF = _single_sql("unwhord thand", "false", 50)


@query("pad1_padded_results", f"WITH {HALF} SELECT query_id, dataset, doc, position, {R9.format('score')} FROM results")
def padded_results(spark, sf_dir):
    index, asked, top = _half(spark, sf_dir)
    return rounded(S.pad(top, asked, index.heads), "score")


@query("jn9_unmatched_documents", f"WITH {HALF} SELECT d.dataset, d.doc FROM docs d WHERE NOT EXISTS (SELECT 1 FROM best b WHERE b.dataset = d.dataset AND b.doc = d.doc)")
def unmatched_documents(spark, sf_dir):
    index, _, top = _half(spark, sf_dir)
    return index.docs.select("dataset", "doc").join(top, ["dataset", "doc"], "left_anti")


@query("set3_results_then_padding", f"WITH {HALF} SELECT dataset, score > 0 AS matched, count(*) AS n FROM results GROUP BY 1, 2")
def results_then_padding(spark, sf_dir):
    index, asked, top = _half(spark, sf_dir)
    return S.pad(top, asked, index.heads).groupBy("dataset", (F.col("score") > 0).alias("matched")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "tk6_first_documents",
    f"WITH {Q.DOCS} SELECT dataset, doc, url FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY doc) AS n FROM docs) WHERE n <= 10",
)
def first_documents(spark, sf_dir):
    """What a request without any known word gets."""
    index = document_index(spark, sf_dir)
    asked = B.fixed_request(spark, "").select("query_id", "dataset", F.lit(10).alias("max_results"))
    nothing = index.docs.select(F.lit(0).cast("long").alias("query_id"), "dataset", "doc", F.lit(0.0).alias("score"), F.lit(0).alias("position")).where("false")
    return S.pad(nothing, asked, index.heads).join(index.docs, ["dataset", "doc"]).select("dataset", "doc", "url")


@query("snk6_result_document", f"""WITH {BATCH}, shown AS ({SHOWN})
  SELECT query_id, dataset, string_agg(url || ' ' || title, ' ' ORDER BY position) AS listed FROM shown GROUP BY 1, 2""")
def result_document(spark, sf_dir):
    body = S.result_document(batch_search(spark, sf_dir))
    path = scratch_path(spark, "results")
    body.write.json(path)
    back = spark.read.schema("query_id bigint, dataset string, body string").json(path)
    parsed = F.from_json("body", "result array<struct<url:string,score:double,title:string,pr:double>>")["result"]
    listed = F.transform(parsed, lambda r: F.concat(r["url"], F.lit(" "), r["title"]))
    return back.select("query_id", "dataset", F.array_join(listed, " ").alias("listed"))


# ---- query-space variants ---------------------------------------------------------------------------------

SPACE = f"""spaced AS (SELECT query_id, dataset, doc, 0 AS tie, CASE WHEN q_mag * shared_mag = 0 THEN 0.0 ELSE dot / (q_mag * shared_mag) END AS score
  FROM dots JOIN qnorms USING (query_id, dataset)),
answerable AS (SELECT DISTINCT query_id, dataset, 10 AS max_results FROM known), {Q.padded('spaced', 'answerable')}"""
SPACE_SHOWN = "SELECT query_id, dataset, position, url, round(score, 9) AS score FROM results JOIN docs USING (dataset, doc)"


@query("srch2_query_space_search", f"WITH {ASKED}, {SPACE} {SPACE_SHOWN}")
def query_space_search(spark, sf_dir):
    return rounded(S.search_query_space(document_index(spark, sf_dir), _asked(spark, sf_dir)), "score")


@query("tk3_ten_best", f"WITH {ASKED}, {SPACE} SELECT query_id, dataset, doc, position FROM best")
def ten_best(spark, sf_dir):
    weights = materialize(_weights(spark, sf_dir), "weights")
    return S.best_query_space_matches(document_index(spark, sf_dir), weights).select("query_id", "dataset", "doc", "position")


def _variant_sql(asked: str, split, query_text: str, doc_text: str, all_queries: bool = True) -> str:
    """Two frequency tables, one per text; ``docs`` has both texts."""
    return f"""{asked},
qtok AS (SELECT query_id, dataset, {split('text')} AS w FROM asked),
qterms AS MATERIALIZED (SELECT query_id, dataset, total, term, count(*) AS count FROM (
  SELECT query_id, dataset, len(w) AS total, unnest(w) AS term FROM qtok) GROUP BY ALL),
corpus AS MATERIALIZED (SELECT dataset, count(*) AS n FROM docs GROUP BY 1),
qdf AS MATERIALIZED (SELECT dataset, term, count(DISTINCT doc) AS df FROM (
  SELECT dataset, doc, unnest({split(query_text)}) AS term FROM docs) WHERE term IN (SELECT term FROM qterms) GROUP BY 1, 2),
dcount AS MATERIALIZED (SELECT dataset, doc, total, term, count(*) AS count FROM (
  SELECT dataset, doc, len(w) AS total, unnest(w) AS term FROM (SELECT dataset, doc, {split(doc_text)} AS w FROM docs))
  WHERE term IN (SELECT term FROM qterms) GROUP BY ALL),
ddf AS MATERIALIZED (SELECT dataset, term, count(*) AS df FROM dcount GROUP BY 1, 2),
qw AS MATERIALIZED (SELECT query_id, dataset, term, log2(1 + count::DOUBLE / total) * {Q.idf('coalesce(df, 0)', 'n')} AS q_weight
  FROM qterms LEFT JOIN qdf USING (dataset, term) JOIN corpus USING (dataset)),
dw AS MATERIALIZED (SELECT dataset, term, doc, log2(1 + count::DOUBLE / total) * {Q.idf('df', 'n')} AS weight
  FROM dcount JOIN ddf USING (dataset, term) JOIN corpus USING (dataset)),
qn AS (SELECT query_id, dataset, sqrt(sum(q_weight * q_weight)) AS q_mag FROM qw GROUP BY 1, 2),
pairs AS (SELECT query_id, dataset, doc, sum(q_weight * weight) AS dot, sqrt(sum(weight * weight)) AS d_mag FROM qw JOIN dw USING (dataset, term) GROUP BY 1, 2, 3),
spaced AS (SELECT * FROM (SELECT query_id, dataset, doc, 0 AS tie, CASE WHEN q_mag * d_mag = 0 THEN 0.0 ELSE dot / (q_mag * d_mag) END AS score
  FROM pairs JOIN qn USING (query_id, dataset)) WHERE score <> 0),
ten AS (SELECT DISTINCT query_id, dataset, 10 AS max_results FROM asked), {Q.padded('spaced', 'ten')}"""


def _two_texts(spark, sf_dir):
    """Pages with raw content and paragraph text, empty paragraphs kept; numbered in page order."""
    pages = open_crawl(spark, sf_dir).pages
    texts = spread(pages).select("dataset", "url", F.col("content").alias("raw"), H.paragraph_text_keep_empty(F.col("content")).alias("text"))
    # only the keys are sorted; the texts join them once
    numbers = I.dense_number(pages.select("seq", "dataset", "url"), ["seq", "dataset", "url"], "doc").drop("seq")
    return materialize(texts.join(numbers, ["dataset", "url"]), "raw-pages")


@prepared
def raw_word_index(spark, sf_dir) -> I.TextIndex:
    """Case-sensitive index: words of queries by the raw pages, words of documents by their paragraphs."""
    return I.build_text_index(_two_texts(spark, sf_dir), "raw", "text", T.raw_tokens)


@prepared
def word_index(spark, sf_dir) -> I.TextIndex:
    """The same without case and empty words."""
    return I.build_text_index(_two_texts(spark, sf_dir), "raw", "text", T.tokens)


RAW_DOCS = f"""docs AS MATERIALIZED (SELECT dataset, row_number() OVER (ORDER BY seq, dataset, url) - 1 AS doc, url, content AS raw,
  {Q.paragraphs('content', True)} AS text FROM page)"""


PAGE_REQUESTS = "asked AS MATERIALIZED (SELECT item_id AS query_id, d.dataset, text FROM benchmark, (SELECT DISTINCT dataset FROM page) d)"


@query(
    "srch3_case_sensitive_search",
    f"WITH {Q.OPEN_CRAWL}, {RAW_DOCS}, {_variant_sql(PAGE_REQUESTS, Q.raw_words, 'raw', 'text')} {SPACE_SHOWN}",
)
def case_sensitive_search(spark, sf_dir):
    return rounded(S.search_texts(raw_word_index(spark, sf_dir), B.page_requests(spark, sf_dir)), "score")


@query(
    "srch4_scores_on_texts",
    f"WITH {Q.OPEN_CRAWL}, {RAW_DOCS}, {_variant_sql(PAGE_REQUESTS, Q.words, 'raw', 'text')} {_ten('spaced', 'score', R9.format('score'))}",
)
def scores_on_texts(spark, sf_dir):
    """The ten best scores of each request."""
    found = S.score_texts(word_index(spark, sf_dir), B.page_requests(spark, sf_dir))
    return rounded(_top_ten(found, "score").drop("position"), "score")
