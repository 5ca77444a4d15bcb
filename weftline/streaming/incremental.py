"""Incremental forms of the writing jobs as Structured Streaming micro-batches.

Each function starts a query that works off everything that has arrived and stops;
running it again later goes on from its checkpoint. A batch is committed under its number, or writes
below it, so repeating a batch after a failure changes nothing, or replaces its output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

from weftline.operators import orders as O, reviews as R
from weftline.operators.links import fetched_links, latest_captures, outgoing_lists
from weftline.operators.segments import add_documents
from weftline.plans.commits import FAN, commit, merge_due, read_manifest, read_table, write_segment
from weftline.plans.lineage import broadcast_if_small, is_missing_path, materialize
from weftline.sources.pages import BUCKETS, upsert_pages


def _run(stream: DataFrame, handle, checkpoint: str) -> None:
    """Work off what is there, in micro-batches, and wait for the end."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).foreachBatch(handle).start().awaitTermination()


def _batch_path(path: str, batch: int) -> str:
    return f"{path}/batch={batch}"


def ingest_captures(
    stream: DataFrame, prefixes: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS, source: str = "captures"
) -> None:
    """Commit captured pages, with the links found in them, to the page store at ``path``.

    A batch is committed under its number and the name of its ``source``: repeated after a failure, it changes nothing.
    """

    def handle(batch: DataFrame, number: int) -> None:
        if read_manifest(batch.sparkSession, path).has(source, number):
            return
        captures = materialize(batch, "batch")
        links = materialize(fetched_links(captures, prefixes), "batch-links")
        newest = latest_captures(captures)
        current = links.join(newest.select("dataset", "seq"), ["dataset", "seq"], "left_semi")
        pages = newest.join(outgoing_lists(current), ["dataset", "url"], "left").select(
            "dataset",
            "url",
            F.col("html").alias("content"),
            F.coalesce("outgoing", F.array().cast("array<string>")).alias("outgoing"),
            "fetched_at",
        )
        upsert_pages(batch.sparkSession, path, pages, links, buckets, source, number)

    _run(stream, handle, checkpoint)


def index_documents(stream: DataFrame, path: str, checkpoint: str, source: str = "documents") -> None:
    """Commit arriving documents (``dataset, doc, url, title, text``, and ``version`` where there is one) to the segmented index at ``path``."""

    def handle(batch: DataFrame, number: int) -> None:
        add_documents(batch.sparkSession, path, materialize(batch, "batch"), number, source)

    _run(stream, handle, checkpoint)


# tables of the in-degree store: the links seen, and what each batch adds to the counts
SEEN = "src string, dst string, dataset string, bucket int"
ADDED = "url string, added bigint, dataset string"


def count_in_degrees(stream: DataFrame, path: str, checkpoint: str, buckets: int = 256, source: str = "links", fan: int = FAN) -> None:
    """Count distinct sources per target of a stream of ``dataset, src, dst``.

    The links seen lie in folders by hash at ``path``, not in memory: a batch reads the folders of its own links, keeps those that are
    new, and commits them with what they add to the counts. A batch that comes again changes nothing.
    """

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        seen = read_manifest(spark, path)
        if seen.has(source, number):
            return
        settled = seen.facts.get("buckets", buckets)
        bucket = F.pmod(F.xxhash64("dataset", "src", "dst"), F.lit(settled)).cast("int")
        links = materialize(batch.select("dataset", "src", "dst").distinct().withColumn("bucket", bucket), "batch-links")
        # at most datasets x buckets rows: Spark prunes the other folders when the join runs
        touched = broadcast_if_small(materialize(links.select("dataset", "bucket").distinct(), "batch-folders"))
        known = read_table(spark, path, seen.segments, "seen", SEEN).join(touched, ["dataset", "bucket"], "left_semi")
        fresh = materialize(links.join(known, ["dataset", "bucket", "src", "dst"], "left_anti"), "fresh-links")
        added = fresh.groupBy("dataset", F.col("dst").alias("url")).agg(F.count(F.lit(1)).alias("added"))
        segment = write_segment(spark, path, {"seen": _folders(fresh, "dataset", "bucket"), "added": _folders(added, "dataset")})
        seen = commit(spark, path, seen, [*seen.segments, segment], {**seen.applied, source: number}, {"buckets": settled})
        start = merge_due(seen.segments, fan)
        if start is not None:
            old = seen.segments[start:]
            sums = _added_up(read_table(spark, path, old, "added", ADDED))
            whole = {"seen": _folders(read_table(spark, path, old, "seen", SEEN), "dataset", "bucket"), "added": _folders(sums, "dataset")}
            commit(spark, path, seen, [*seen.segments[:start], write_segment(spark, path, whole, old[-1].level + 1)], seen.applied, seen.facts)

    _run(stream, handle, checkpoint)


def _folders(rows: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    return rows.hint("rebalance", *names), list(names)


def _added_up(added: DataFrame) -> DataFrame:
    return added.groupBy("dataset", "url").agg(F.sum("added").alias("added"))


def latest_in_degrees(spark: SparkSession, path: str) -> DataFrame:
    """Current counts: what all batches have added."""
    added = _added_up(read_table(spark, path, read_manifest(spark, path).segments, "added", ADDED))
    return added.withColumnRenamed("added", "in_degree")


# tables of the order store: the decisions, what each batch sold, and the orders not decided yet (those of the last segment count)
DECISIONS = "order_id bigint, accepted boolean, reason string, failed_product bigint"
SOLD = "product_id bigint, amount bigint"


def _sold(spark: SparkSession, path: str, segments) -> DataFrame:
    return read_table(spark, path, segments, "sold", SOLD).groupBy("product_id").agg(F.sum("amount").alias("amount"))


def _decide(requests: DataFrame, products: DataFrame, path: str, arrival: list[str], commit_as: tuple[str, int], delay: str | None, fan: int) -> None:
    """Decide the requests, and those waiting, that no earlier one can come before any more; commit decisions, sales and the rest."""
    spark, (source, number) = requests.sparkSession, commit_as
    seen = read_manifest(spark, path)
    if seen.has(source, number):
        return
    waiting = read_table(spark, path, seen.segments[-1:], "waiting", requests.schema)
    known = materialize(waiting.unionByName(requests), "waiting")
    time = F.col(arrival[0]).cast("timestamp")
    if delay is None:
        ready, rest, horizon = known, known.limit(0), seen.facts.get("horizon")
    else:
        # the horizon only moves on: what is at most as late as ``delay`` comes before it
        late = known.agg((F.max(time) - F.expr(f"INTERVAL {delay}")).cast("double")).first()[0]
        horizon = max((x for x in (late, seen.facts.get("horizon")) if x is not None), default=None)
        due = F.coalesce(time.cast("double") <= F.lit(horizon).cast("double"), F.lit(True))
        ready, rest = known.where(due), known.where(~due)
    lines = materialize(O.cart_lines(ready), "batch-lines")
    heads = ready.where("block = 0") if "block" in ready.columns else ready
    stock = O.lower_stock(products, _sold(spark, path, seen.segments))
    found = materialize(O.allocate(heads.select("order_id", "username", *arrival), lines, stock, arrival), "batch-decisions")
    taken = lines.join(found.where("accepted").select("order_id"), "order_id", "left_semi")
    sold = taken.groupBy("product_id").agg(F.sum("quantity").alias("amount"))
    found = found.select("order_id", "accepted", "reason", "failed_product")
    segment = write_segment(spark, path, {"decisions": (found, []), "sold": (sold, []), "waiting": (rest, [])})
    facts = {**seen.facts, "horizon": horizon}
    seen = commit(spark, path, seen, [*seen.segments, segment], {**seen.applied, source: number}, facts)
    start = merge_due(seen.segments, fan)
    if start is not None:
        old = seen.segments[start:]
        whole = {
            "decisions": (read_table(spark, path, old, "decisions", DECISIONS), []), "sold": (_sold(spark, path, old), []),
            "waiting": (read_table(spark, path, old[-1:], "waiting", requests.schema), []),
        }
        commit(spark, path, seen, [*seen.segments[:start], write_segment(spark, path, whole, old[-1].level + 1)], seen.applied, seen.facts)


def allocate_orders(
    stream: DataFrame, products: DataFrame, path: str, checkpoint: str, arrival: list[str], delay: str | None = None, source: str = "orders", fan: int = FAN
) -> None:
    """Decide arriving orders, in order of ``arrival``, against the stock left by all earlier ones.

    ``stream`` has ``order_id, username, cart`` and the arrival columns, the first of which is the order's time. With ``delay`` (an interval, as
    "2 days") orders wait until one has come that is later by so much: batches may then bring them out of order by up to that, and the decisions
    are those of one batch in order; ``decide_waiting`` ends the wait. Without it, orders must come in batches that follow arrival order. A batch adds
    its decisions and sales; the stock isn't rewritten (``stock_now``). An order that is later still is decided when it comes.
    """

    def handle(batch: DataFrame, number: int) -> None:
        _decide(batch, products, path, arrival, (source, number), delay, fan)

    _run(stream, handle, checkpoint)


def decide_waiting(requests: DataFrame, products: DataFrame, path: str, arrival: list[str], fan: int = FAN) -> None:
    """Decide all orders that still wait; ``requests`` gives their columns, its rows (none, as a rule) are decided with them."""
    done = read_manifest(requests.sparkSession, path).applied.get("closing", -1)
    _decide(requests, products, path, arrival, ("closing", done + 1), None, fan)


def stored_decisions(spark: SparkSession, path: str) -> DataFrame:
    """All decisions so far."""
    return read_table(spark, path, read_manifest(spark, path).segments, "decisions", DECISIONS)


def stock_now(spark: SparkSession, products: DataFrame, path: str) -> DataFrame:
    """Products with the stock that all decisions so far leave."""
    return O.lower_stock(products, _sold(spark, path, read_manifest(spark, path).segments))


def validate_reviews(stream: DataFrame, products: DataFrame, path: str, checkpoint: str) -> None:
    """Append valid reviews to ``path/accepted`` and the others, with their error, to ``path/rejected``."""

    def handle(batch: DataFrame, number: int) -> None:
        checked = materialize(batch, "checked")
        R.accepted_reviews(checked).write.mode("overwrite").parquet(_batch_path(f"{path}/accepted", number))
        rejected = checked.where("error is not null")
        rejected.write.mode("overwrite").parquet(_batch_path(f"{path}/rejected", number))

    _run(R.check_reviews(stream, products), handle, checkpoint)


def read_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All batches of an output, none if nothing was written."""
    try:
        return spark.read.parquet(path).drop("batch")
    except AnalysisException as error:
        if not is_missing_path(error):
            raise
        return spark.createDataFrame([], schema)
