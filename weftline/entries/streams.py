"""The incremental jobs, fed with the given tables in four parts that arrive one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weftline import bindings as B
from weftline.entries import search, sql as Q
from weftline.entries.registry import ORACLES, prepared, query
from weftline.entries.store import CHECKED, order_requests
from weftline.operators import links as L, segments as G
from weftline.plans.lineage import scratch_path
from weftline.plans.shaping import dense_number
from weftline.sources import pages as P
from weftline.streaming import incremental as S

PARTS = 4


def _arrivals(rows: DataFrame, order: list[str]):
    """The whole table in four consecutive parts by arrival order."""
    numbered = dense_number(rows, order, "_n", stored=True)
    total = numbered.count()
    part = F.floor(F.col("_n") * PARTS / total)
    for k in range(PARTS):
        yield numbered.where(part == k).drop("_n")


def _feed(spark, rows, order, run):
    """Let each part arrive in a folder and run the job after it."""
    inbox = scratch_path(spark, "inbox")
    for part in _arrivals(rows, order):
        part.write.mode("append").parquet(inbox)
        run(spark.readStream.schema(part.schema).parquet(inbox))


@query(
    "st1_capture_stream",
    f"""WITH {Q.OPEN_CRAWL},
    outs AS (SELECT dataset, src AS url, string_agg(dst, ' ' ORDER BY position) AS outgoing FROM current_links GROUP BY 1, 2),
    counted AS (SELECT dataset, dst AS url, count(*) AS incoming_count FROM fetched GROUP BY 1, 2)
    SELECT dataset, url, length(content) AS content_length, coalesce(outgoing, '') AS outgoing, coalesce(incoming_count, 0) AS incoming_count
    FROM page LEFT JOIN outs USING (dataset, url) LEFT JOIN counted USING (dataset, url)""",
)
def capture_stream(spark, sf_dir):
    path, checkpoint = scratch_path(spark, "stream-pages"), scratch_path(spark, "stream-state")
    prefixes = B.open_prefixes(spark)
    _feed(spark, B.captures(spark, sf_dir), ["seq"], lambda s: S.ingest_captures(s, prefixes, path, checkpoint, buckets=4))
    return P.stored_pages(spark, path).select(
        "dataset", "url", F.length("content").alias("content_length"), F.array_join("outgoing", " ").alias("outgoing"), "incoming_count"
    )


@query("idx1_index_stream", ORACLES["idx1_build_index"])
def index_stream(spark, sf_dir):
    """The index after four batches, the first of which brings older versions of every fifth document."""
    path, checkpoint = scratch_path(spark, "stream-index"), scratch_path(spark, "stream-state")
    docs = B.documents(spark, sf_dir).withColumn("version", F.lit(1)).withColumn("arrival", F.col("doc"))
    older = docs.where("doc % 5 = 0").withColumn("version", F.lit(0)).withColumn("arrival", F.lit(-1).cast("long"))
    older = older.withColumn("text", F.concat(F.lit("an older text "), F.substring("text", 1, 200)))
    _feed(spark, older.unionByName(docs), ["arrival", "doc"], lambda s: S.index_documents(s, path, checkpoint))
    rows = G.current_index(spark, path).postings.select("dataset", "term", "doc", "count", "total_words", "weight", "mag")
    return search.rounded(rows, "weight", "mag")


@query("st2_in_degree_stream", f"WITH {Q.OPEN_CRAWL} SELECT dataset, dst AS url, count(*) AS in_degree FROM links GROUP BY 1, 2")
def in_degree_stream(spark, sf_dir):
    path, checkpoint = scratch_path(spark, "stream-degrees"), scratch_path(spark, "stream-state")
    events = L.fetched_links(B.captures(spark, sf_dir), B.open_prefixes(spark)).select("seq", "dataset", "src", "dst")
    # every link arrives twice
    both = events.unionByName(events.withColumn("seq", F.col("seq") + 1))
    _feed(spark, both, ["seq", "dataset", "src", "dst"], lambda s: S.count_in_degrees(s, path, checkpoint, buckets=4))
    return S.latest_in_degrees(spark, path)


@prepared
def _order_stream(spark, sf_dir):
    """Orders that come up to 200 days late, in four parts."""
    path, checkpoint = scratch_path(spark, "stream-orders"), scratch_path(spark, "stream-state")
    requests = order_requests(spark, sf_dir).join(B.orders(spark, sf_dir).select("order_id", "ordered_at"), "order_id")
    products, arrival = B.stocked_products(spark, sf_dir), ["ordered_at", "order_id"]
    late = F.col("ordered_at") + F.make_dt_interval(days=F.pmod(F.xxhash64("order_id"), F.lit(200)).cast("int"))
    parts = requests.withColumn("came_at", late)
    _feed(spark, parts, ["came_at", "order_id"], lambda s: S.allocate_orders(s.drop("came_at"), products, path, checkpoint, arrival, "200 days"))
    S.decide_waiting(requests.limit(0), products, path, arrival)
    return path


@query("st3_order_stream", ORACLES["ord3_stock_allocation"])
def order_stream(spark, sf_dir):
    # the line numbers of a request are places in its cart, which keep the order of the given ones
    return S.stored_decisions(spark, _order_stream(spark, sf_dir))


@query("st3_stock_after_stream", ORACLES["ord5_stock_after"])
def stock_after_stream(spark, sf_dir):
    return S.stock_now(spark, B.stocked_products(spark, sf_dir), _order_stream(spark, sf_dir)).select("id", "stock")


@query(
    "st4_review_stream",
    f"WITH {CHECKED} SELECT product_id, name, rating::DOUBLE AS rating, error FROM checked",
)
def review_stream(spark, sf_dir):
    path, checkpoint = scratch_path(spark, "stream-reviews"), scratch_path(spark, "stream-state")
    requests, products = B.review_requests(spark, sf_dir), B.products(spark, sf_dir)
    _feed(spark, requests, ["date", "product_id", "name"], lambda s: S.validate_reviews(s, products, path, checkpoint))
    accepted = S.read_batches(spark, f"{path}/accepted", "product_id bigint, name string, rating double")
    rejected = S.read_batches(spark, f"{path}/rejected", "product_id bigint, name string, rating string, error string")
    columns = ["product_id", "name", "rating", "error"]
    return accepted.withColumn("error", F.lit(None).cast("string")).select(*columns).unionByName(
        rejected.withColumn("rating", F.col("rating").cast("double")).select(*columns)
    )
