"""The given tables in the shapes that the jobs take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.plans.lineage import materialize, spread
from weftline.plans.shaping import dense_number


# configured datasets: languages of the documents, domains of the captured pages
LANGUAGES = ("de", "en", "es", "fr")
DOMAINS = ("example.com", "example.net", "example.org")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of texts, over all cores."""
    return spread(table(spark, sf_dir, name))


def trade_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers and parts that trade, linked in both directions."""
    # written once: both directions and the nodes are read from it
    pairs = materialize(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct(), "trade")
    lines = pairs.select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("s"), F.concat(F.lit("p"), F.col("l_partkey")).alias("p"))
    both = lines.select(F.col("s").alias("src"), F.col("p").alias("dst")).unionByName(
        lines.select(F.col("p").alias("src"), F.col("s").alias("dst"))
    )
    edges = both.select(F.lit("trade").alias("dataset"), "src", "dst")
    nodes = edges.select("dataset", F.col("src").alias("url")).distinct()
    return nodes, edges


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured pages; the dataset is the registered domain of the host."""
    return table(spark, sf_dir, "pages").select(
        F.regexp_extract("url", r"^https?://(?:[^/?#]*\.)?(example\.(?:com|net|org))(?:[/?#:]|$)", 1).alias("dataset"),
        F.col("page_id").alias("seq"),
        F.regexp_replace("url", "#.*$", "").alias("url"),
        "html",
        F.timestamp_seconds(F.col("page_id") + 1_704_067_200).alias("fetched_at"),
    )


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dataset configuration: every dataset with its first page as seed."""
    return captures(spark, sf_dir).groupBy("dataset").agg(F.min_by("url", "seq").alias("seed"))


def configured_prefixes(spark: SparkSession) -> DataFrame:
    """Allowed prefixes as configured: one dataset has two, one has one, one has none."""
    rows = [("example.com", "https://"), ("example.com", "http://"), ("example.net", "https://")]
    return spark.createDataFrame(rows, "dataset string, prefix string")


def open_prefixes(spark: SparkSession) -> DataFrame:
    """Every http(s) address allowed."""
    rows = [(f"example.{tld}", p) for tld in ("com", "net", "org") for p in ("http://", "https://")]
    return spark.createDataFrame(rows, "dataset string, prefix string")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text documents; the dataset is the language."""
    return table(spark, sf_dir, "documents").select(
        F.col("lang").alias("dataset"),
        F.col("doc_id").alias("doc"),
        F.concat(F.lit("/documents/"), "doc_id").alias("url"),
        F.col("source").alias("title"),
        "text",
    )


def document_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in rank for documents, which have no links."""
    return table(spark, sf_dir, "documents").select(
        F.col("lang").alias("dataset"),
        F.concat(F.lit("/documents/"), "doc_id").alias("url"),
        (1.0 / (1.0 + F.col("doc_id") % 97)).alias("pr"),
    )


def for_datasets(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Repeat rows once per configured dataset."""
    return rows.withColumn("dataset", F.explode(F.array(*[F.lit(n) for n in names])))


def search_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark text asked of every language, with varying limit and boost."""
    asked = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"),
        "text",
        (F.col("item_id") % 2 == 1).alias("boost"),
        (F.col("item_id") % 12).cast("string").alias("limit"),
    )
    return for_datasets(asked, LANGUAGES)


def page_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark text asked of every crawled dataset, boosted."""
    asked = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), "text", F.lit(True).alias("boost"), F.lit("10").alias("limit")
    )
    return for_datasets(asked, DOMAINS)


def fixed_request(spark: SparkSession, text: str, boost: bool = False, limit: str | None = None) -> DataFrame:
    """One request asked of every language."""
    one = spark.createDataFrame([(0, text, boost, limit)], "query_id bigint, text string, boost boolean, limit string")
    return for_datasets(one, LANGUAGES)


def succession_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Users linked to the user of the next error event in time; some link to themselves."""
    errors = table(spark, sf_dir, "events").where("event_type = 'error'").select("ts", "event_id", "user_id")
    numbered = materialize(dense_number(errors, ["ts", "event_id"], "n"), "errors")
    user = F.concat(F.lit("u"), F.col("user_id"))
    now = numbered.select("n", user.alias("src"))
    then = numbered.select((F.col("n") - 1).alias("n"), user.alias("dst"))
    edges = now.join(then, "n").select(F.lit("succession").alias("dataset"), "src", "dst").distinct()
    nodes = numbered.select(F.lit("succession").alias("dataset"), user.alias("url")).distinct()
    return nodes, edges


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat catalogue."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.col("p_retailprice").alias("price"),
        F.col("p_size").cast("double").alias("dim_x"),
        (F.col("p_size") % 7 + 1).cast("double").alias("dim_y"),
        (F.col("p_partkey") % 11 + 1).cast("double").alias("dim_z"),
        ((F.col("p_partkey") * 7) % 50).alias("stock"),
    )


def stocked_products(spark: SparkSession, sf_dir: str, factor: int = 20) -> DataFrame:
    """Catalogue with a stock that order batches exhaust."""
    return products(spark, sf_dir).drop("stock").join(
        table(spark, sf_dir, "part").select(
            F.col("p_partkey").alias("id"), (F.col("p_size") * factor).cast("long").alias("stock")
        ),
        "id",
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order headers; they arrive by date, then key."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.concat(F.lit("customer "), "o_custkey").alias("username"),
        F.col("o_orderdate").alias("ordered_at"),
    )


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").cast("long").alias("line"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").cast("long").alias("quantity"),
    )


def shifted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with product ids raised by 5, so the highest ones name no product."""
    return order_lines(spark, sf_dir).withColumn("product_id", F.col("product_id") + 5)


def review_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as review requests; some name no product, some ratings are out of range."""
    count = table(spark, sf_dir, "part").count()
    return table(spark, sf_dir, "events").select(
        (F.col("event_id") % (count + 5)).alias("product_id"),
        F.col("user_id").cast("string").alias("name"),
        (F.floor("value") % 12).cast("string").alias("rating"),
        F.col("event_type").alias("text"),
        F.col("ts").alias("date"),
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events as stored reviews."""
    return review_requests(spark, sf_dir).select(
        "product_id", "name", F.col("rating").cast("double").alias("rating"), "text"
    )


def product_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue as product requests, with defects that depend on the key."""
    kind = F.col("p_partkey") % 10
    price, size = F.col("p_retailprice").cast("string"), F.col("p_size").cast("string")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("request_id"),
        F.when(kind == 0, F.lit("")).when(kind == 7, F.lit("  ")).otherwise(F.concat(F.lit(" "), "p_name")).alias("name"),
        F.when(kind == 1, F.lit("-1")).when(kind == 2, F.lit("abc")).otherwise(price).alias("price"),
        F.when(kind == 6, F.lit("-2")).otherwise(size).alias("x"),
        size.alias("y"),
        F.when(kind != 4, size).alias("z"),
        F.when(kind == 3, F.lit("1.5")).when(kind == 5, F.lit("")).otherwise(size).alias("stock"),
    )
