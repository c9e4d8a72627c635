"""Summaries of post, pair and variant tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titlegauge.functions.values import seeded_order
from titlegauge.operators.ranking import exact_quantiles, interpolated


def one_row(*frames: DataFrame) -> DataFrame:
    """Single-row summaries side by side, without a cross join."""
    stacked = frames[0]
    for frame in frames[1:]:
        stacked = stacked.unionByName(frame, allowMissingColumns=True)
    return stacked.agg(*[F.max(name).alias(name) for name in stacked.columns])


def community_profile(posts: DataFrame) -> DataFrame:
    """Rows, median, 90th percentile (whole number) and maximum score, largest first."""
    sizes = posts.groupBy("subreddit").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max("score").alias("max_score")
    )
    quantiles = exact_quantiles(
        posts, ["subreddit"], "score",
        {"median_score": interpolated(0.5), "p90": interpolated(0.9)},
    )
    return (
        sizes.join(quantiles, "subreddit")
        .select(
            "subreddit", "n_rows", "median_score",
            F.floor("p90").cast("long").alias("p90_score"), "max_score",
        )
        .orderBy(F.desc("n_rows"), "subreddit")
    )


def rows_per(posts: DataFrame, keys: Sequence[str], out: str = "n_rows") -> DataFrame:
    return posts.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))


def hash_sample(posts: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """A reproducible random sample of ``n`` rows."""
    return posts.orderBy(seeded_order(F.col("id"), seed), "id").limit(n)


def table_summary(posts: DataFrame) -> DataFrame:
    return posts.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("subreddit").alias("n_communities"),
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
    )


def variant_summary(variants: DataFrame) -> DataFrame:
    """Rows, tests, median and 10th percentile of the impressions (whole numbers)."""
    counts = variants.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("clickability_test_id").alias("n_tests"),
    )
    spread = exact_quantiles(
        variants, [], "impressions", {"median": interpolated(0.5), "p10": interpolated(0.1)}
    )
    return one_row(counts, spread).select(
        "n_rows", "n_tests",
        F.floor("median").cast("long").alias("median_impressions"),
        F.floor("p10").cast("long").alias("p10_impressions"),
    )


def ab_pair_summary(pairs: DataFrame) -> DataFrame:
    """Pairs, distinct tests, median and 90th percentile of the CTR margin."""
    counts = pairs.agg(
        F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("group_id").alias("n_groups")
    )
    margin = F.when(F.col("ctr_lose") == 0, F.lit(float("inf"))).otherwise(
        F.col("ctr_win") / F.nullif(F.col("ctr_lose"), F.lit(0.0))
    )
    names = {"median_margin": interpolated(0.5), "p90_margin": interpolated(0.9)}
    return one_row(counts, exact_quantiles(pairs.withColumn("margin", margin), [], "margin", names))


def ratio_summary(links: DataFrame) -> DataFrame:
    """Rows with an upvote ratio, its median and its 10th percentile."""
    rated = links.filter(F.col("upvote_ratio").isNotNull())
    counts = rated.agg(F.count(F.lit(1)).alias("n_rows"))
    spread = exact_quantiles(
        rated, [], "upvote_ratio",
        {"median_ratio": interpolated(0.5), "p10_ratio": interpolated(0.1)},
    )
    return one_row(counts, spread)
