"""How stable engagement labels are for identical content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titlegauge.operators.pairs import GROUP, rated_links, repost_groups, with_posting_time
from titlegauge.operators.profile import one_row
from titlegauge.operators.ranking import exact_quantiles, interpolated
from titlegauge.operators.ratio_order import PairRatios
from titlegauge.session import cut_lineage


def _variation(value: Column) -> Column:
    mean = F.avg(value)
    return F.when(mean != 0, F.stddev_pop(value) / F.nullif(mean, F.lit(0.0))).otherwise(0.0)


def group_variation(links: DataFrame) -> DataFrame:
    """Population coefficient of variation of each label inside each content group."""
    return (
        rated_links(links)
        .groupBy(*GROUP)
        .agg(
            _variation(F.col("score") + 1).alias("cv_score"),
            _variation(F.col("upvote_ratio") + 0.01).alias("cv_ratio"),
            _variation(F.col("num_comments") + 1).alias("cv_comments"),
            F.countDistinct("title").alias("n_titles"),
        )
        .filter(F.col("n_titles") >= 2)
        .drop("n_titles")
    )


def within_group_cv(links: DataFrame) -> DataFrame:
    """Median over groups of each coefficient of variation."""
    groups = group_variation(links)
    names = ["cv_score", "cv_ratio", "cv_comments"]
    return one_row(
        *[exact_quantiles(groups, [], name, {name: interpolated(0.5)}) for name in names]
    )


def winner_agreement(links: DataFrame) -> DataFrame:
    """Share of groups whose best-scored title is also the best-rated one.

    Score ties go to the largest id, ratio ties to the smallest.
    """
    winners = (
        rated_links(links)
        .groupBy(*GROUP)
        .agg(
            F.max_by("title", F.struct("score", "id")).alias("by_score"),
            F.min_by("title", F.struct(-F.col("upvote_ratio"), F.col("id"))).alias("by_ratio"),
            F.countDistinct("title").alias("n_titles"),
        )
        .filter(F.col("n_titles") >= 2)
    )
    same = (F.col("by_score") == F.col("by_ratio")).cast("double")
    return winners.agg(F.count(F.lit(1)).alias("n_groups"), F.avg(same).alias("agreement"))


def time_matched_noise(links: DataFrame) -> DataFrame:
    """Median score ratio of same-content pairs with different titles, all and time-matched.

    No pair is listed: posts of a group fold into (score, hour, weekend) cells, the medians are order
    statistics over sweeps of the cells, and the pairs with equal titles are counted the same way and
    taken off. Posts without group, title or a score above -1 have no ratio; posts without a posting time
    are in no time-matched pair.
    """
    rated = with_posting_time(rated_links(links)).filter("score > -1").dropna(subset=[*GROUP, "title"])
    clock = F.col("hour") + F.when(F.col("weekend"), 24).otherwise(0)
    cell = ["x", "time_class"]
    timed = rated.withColumns({"x": F.col("score") + 1, "time_class": F.coalesce(clock, F.lit(-1))})
    titled = timed.groupBy(*GROUP, "title", *cell).agg(F.count(F.lit(1)).alias("n"))
    titled = cut_lineage(titled)
    merged = titled.groupBy(*GROUP, *cell).agg(F.sum("n").alias("n"))
    medians = PairRatios([(merged, GROUP, 1), (titled, [*GROUP, "title"], -1)]).medians()
    (n_all, median_all), (n_matched, median_matched) = medians[False], medians[True]
    return links.sparkSession.createDataFrame(
        [(n_all, median_all, n_matched, median_matched)],
        "n_all long, median_all double, n_matched long, median_matched double",
    )
