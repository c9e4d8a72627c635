"""The engine's input schemas as views over the given tables (definitions in FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from titlegauge.functions.text import clean_title
from titlegauge.functions.urls import norm_url, url_host
from titlegauge.operators.ingest import external_links
from titlegauge.operators.score import draft_lines

LINES_PER_DOC = 1_000_000
AB_MIN_IMPRESSIONS = 100
# One more than there are communities, so some drafts have no model.
DRAFT_COMMUNITIES = 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows of a small table over all cores.

    A small file is one row group, hence one task. A table with more splits than twice the
    cores is left alone, so large inputs are not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < 2 * cores else df


def raw_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One post per line of every document; its numbers come from one row of orders."""
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    orders = table(spark, sf_dir, "orders")
    verdicts = table(spark, sf_dir, "labels")
    lines = documents.select(
        "doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    ).withColumn("o_orderkey", F.pmod(F.col("doc_id") * 15 + F.col("line_no"), F.lit(orders.count())))
    title = (
        F.when(F.col("toxic") == 1, F.lit("[removed]"))
        .when(F.col("quality") == 0, F.lit("[deleted]"))
        .otherwise(F.col("line"))
    )
    unscored = F.col("o_orderpriority") == "4-NOT SPECIFIED"
    pending = F.col("o_orderstatus") == "P"
    untimed = pending & (F.col("o_orderpriority") == "5-LOW")
    epoch = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    return (
        lines.join(orders, "o_orderkey")
        .join(verdicts, "doc_id", "left")
        .select(
            F.concat_ws("_", _hex("doc_id"), _hex("line_no")).alias("id"),
            title.alias("title"),
            F.col("source").alias("subreddit"),
            F.when(unscored, F.lit("n/a"))
            .otherwise(F.floor(F.col("o_totalprice") / 1000).cast("string"))
            .alias("score"),
            F.when(pending, F.lit("x"))
            .otherwise(F.col("o_custkey").cast("string"))
            .alias("num_comments"),
            F.when(untimed, F.lit("unknown")).otherwise(epoch.cast("string")).alias("created_utc"),
        )
    )


def _hex(name: str) -> Column:
    return F.lower(F.hex(F.col(name).cast("long")))


def raw_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One link post per event, to the page of its number modulo the pages.

    Every third post has the page's title, the others the first line of a document, so a page is
    posted under several titles. What comes from a URL or a title alone is worked out once per page or
    document: ``nurl`` is the normalised URL, ``clean`` the clean title.
    """
    pages = table(spark, sf_dir, "pages")
    documents = table(spark, sf_dir, "documents")
    events = table(spark, sf_dir, "events").select(
        "event_id",
        F.pmod("event_id", F.lit(pages.count())).alias("page_no"),
        F.pmod("event_id", F.lit(documents.count())).alias("doc_no"),
        F.floor("value").cast("string").alias("score"),
        (F.regexp_extract("props", "([0-9]+)", 1).cast("double") / 100).alias("upvote_ratio"),
        F.col("user_id").alias("num_comments"),
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("created_utc"),
        (F.col("event_type") == "signup").alias("is_self"),
    )
    linked = pages.select(
        "page_id", "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("page_title"),
        F.regexp_extract(url_host(F.col("url")), r"([^.]+)$", 1).alias("sub"),
        norm_url(F.col("url")).alias("nurl"),
    ).withColumn("page_clean", clean_title(F.col("page_title")))
    first_lines = documents.select("doc_id", F.substring_index("text", "\n", 1).alias("line"))
    first_lines = first_lines.withColumn("line_clean", clean_title(F.col("line")))
    own = F.col("event_id") % 3 == 0
    # A page's title goes along only where it is wanted.
    paged = events.join(linked, F.col("page_no") == F.col("page_id")).withColumns(
        {name: F.when(own, F.col(name)) for name in ("page_title", "page_clean")}
    )
    posts = paged.join(first_lines, F.col("doc_no") == F.col("doc_id"))
    return posts.select(
        F.concat(F.lit("l"), _hex("event_id")).alias("id"),
        "sub", "url", "nurl",
        F.when(own, F.col("page_title")).otherwise(F.col("line")).alias("title"),
        F.when(own, F.col("page_clean")).otherwise(F.col("line_clean")).alias("clean"),
        "score", "upvote_ratio", "num_comments", "created_utc", "is_self",
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean link posts of ``raw_links``."""
    return external_links(raw_links(spark, sf_dir), identity=F.col("nurl"), title=F.col("clean"))


def ab_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part")
    returned = F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)
    return (
        lineitem.join(part, lineitem.l_partkey == part.p_partkey)
        .groupBy(
            F.col("l_suppkey").alias("clickability_test_id"),
            F.col("l_linestatus").alias("eyecatcher_id"),
            F.col("p_name").alias("headline"),
        )
        .agg(F.sum("l_quantity").alias("impressions"), F.sum(returned).alias("clicks"))
    )


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every turn is a draft; a conversation is one request."""
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("request_id"),
        F.concat(F.lit("src"), F.col("conv_id") % DRAFT_COMMUNITIES).alias("subreddit"),
        (F.col("turn") * LINES_PER_DOC).alias("position"),
        F.col("text").alias("drafts"),
    )
    return draft_lines(turns)


def post_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, embedding) of each post whose document has a precomputed vector."""
    embeddings = table(spark, sf_dir, "embeddings")
    number = F.conv(F.substring_index("id", "_", 1), 16, 10).cast("long")
    ids = raw_posts(spark, sf_dir).select("id", number.alias("vec_id"))
    return ids.join(embeddings.select("vec_id", "embedding"), "vec_id").select("id", "embedding")


def pair_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A logit per part and presentation order, as a pair model would write them."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pair_id"))
    both = part.select("pair_id", F.explode(F.array(F.lit("wl"), F.lit("lw"))).alias("ordering"))
    digest = F.md5(F.concat(F.col("pair_id").cast("string"), F.col("ordering")))
    number = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return both.withColumn("logit", (number % 1000) / 1000)
