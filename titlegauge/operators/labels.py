"""Era-aware labels (empirical distribution per community and era) and hold-out splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titlegauge.functions.values import seeded_order
from titlegauge.operators.joins import lookup_join
from titlegauge.operators.ranking import mark_lowest
from titlegauge.session import cut_lineage

TEST_SHARE = 0.2
ECDF_KEYS = ["subreddit", "era", "score"]
NO_ERA = -(1 << 31)


def with_hash_order(df: DataFrame, key: Column, seed: int, out: str = "_hash") -> DataFrame:
    return df.withColumn(out, seeded_order(key, seed))


def stratified_split(
    posts: DataFrame, share: float = TEST_SHARE, seed: int = 0, strata: str = "year"
) -> DataFrame:
    """Add ``is_test``: the given share of every (community, stratum), in hash order.

    A stratum of one row stays in training.
    """

    def quota(total: Column) -> Column:
        wanted = F.greatest(F.lit(1.0), F.floor(total * F.lit(share) + 0.5))
        return F.when(total >= 2, wanted).otherwise(0)

    hashed = with_hash_order(posts, F.col("id"), seed)
    return mark_lowest(hashed, ["subreddit", strata], "_hash", "id", quota, "is_test").drop(
        "_hash"
    )


def group_split(
    pairs: DataFrame, keys: Sequence[str], share: float, seed: int = 0
) -> DataFrame:
    """Add ``is_test`` so that all rows of one content key fall on the same side.

    ceil(share * keys) keys are test keys, by hash order of the key.
    """
    keys = list(keys)
    joined = F.concat_ws("\x1f", *[F.col(name).cast("string") for name in keys])
    # The keys are read several times while the boundary is found; the pairs are not.
    groups = cut_lineage(
        pairs.select(*keys)
        .distinct()
        .withColumn("_hash", seeded_order(joined, seed))
        .withColumn("_tie", F.xxhash64(*keys))
    )
    marked = mark_lowest(
        groups, [], "_hash", "_tie", lambda total: F.ceil(total * F.lit(share)), "is_test"
    )
    return lookup_join(pairs, marked.select(*keys, "is_test"), keys)


def fit_ecdf(train: DataFrame, era: str = "year") -> DataFrame:
    """(subreddit, era, score, cum_n, n): training posts at or below each distinct score.

    ``era`` null holds the whole community, the fallback for eras unseen in training.
    """
    per_era = (
        train.groupBy("subreddit", F.col(era).cast("int").alias("era"), "score")
        .agg(F.count(F.lit(1)).alias("k"))
    )
    whole = (
        per_era.groupBy("subreddit", "score")
        .agg(F.sum("k").alias("k"))
        .withColumn("era", F.lit(None).cast("int"))
    )
    # The windows run over distinct scores, not over posts.
    group = Window.partitionBy("subreddit", "era")
    so_far = group.orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    return per_era.unionByName(whole).select(
        *ECDF_KEYS,
        F.sum("k").over(so_far).alias("cum_n"),
        F.sum("k").over(group).alias("n"),
    )


def apply_ecdf(posts: DataFrame, ecdf: DataFrame, era: str = "year") -> DataFrame:
    """Add ``label``: the share of training posts of the same community and era whose score is
    at most this one; the community share where the era has no training post.

    Labels are worked out once per distinct (community, era, score) and looked up by the posts.
    """
    # Posts without an era share a stand-in for it, so that they can be looked up.
    placed = posts.withColumn("_era", F.coalesce(F.col(era).cast("int"), F.lit(NO_ERA)))
    asked = placed.select("subreddit", F.col("_era").alias("post_era"), "score").distinct()
    trained = ecdf.select("subreddit", "era").distinct().withColumn("known", F.lit(True))
    eras = trained.filter(F.col("era").isNotNull()).withColumnRenamed("era", "post_era")
    points = asked.join(eras, ["subreddit", "post_era"], "left").withColumn(
        "era", F.when(F.col("known"), F.col("post_era"))
    )
    steps = ecdf.select(*ECDF_KEYS, "cum_n", "n")
    questions = points.select("subreddit", "era", "score").distinct()
    merged = steps.withColumn("is_step", F.lit(True)).unionByName(
        questions.withColumn("is_step", F.lit(False)), allowMissingColumns=True
    )
    group = Window.partitionBy("subreddit", "era")
    so_far = group.orderBy("score", F.desc("is_step")).rowsBetween(Window.unboundedPreceding, 0)
    reached = F.coalesce(F.last("cum_n", ignorenulls=True).over(so_far), F.lit(0))
    answers = (
        merged.withColumn("label", reached / F.max("n").over(group))
        .filter(~F.col("is_step"))
        .select(*ECDF_KEYS, "label")
    )
    same_era = F.col("p.era").eqNullSafe(F.col("q.era"))
    labelled = (
        points.alias("p")
        .join(
            answers.alias("q"),
            (F.col("p.subreddit") == F.col("q.subreddit"))
            & same_era
            & (F.col("p.score") == F.col("q.score")),
        )
        .select("p.subreddit", F.col("p.post_era").alias("_era"), "p.score", "q.label")
    )
    return lookup_join(placed, labelled, ["subreddit", "_era", "score"], spread=["id"]).drop("_era")


def era_percentile(posts: DataFrame, era: str = "year", test: str = "is_test") -> DataFrame:
    """Fit the distributions on the training rows and label every row."""
    return apply_ecdf(posts, fit_ecdf(posts.filter(~F.col(test)), era), era)
