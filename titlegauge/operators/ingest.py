"""From raw posts to clean posts: parsing, cleaning, de-duplication, quotas, time strides."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titlegauge.functions.text import clean_title
from titlegauge.functions.urls import norm_url
from titlegauge.functions.values import utc_month, utc_year, whole_number
from titlegauge.operators.ranking import first_n, mark_lowest

QUOTA_SALTS = 64
CLEAN_COLUMNS = ["id", "title", "subreddit", "score", "num_comments", "year", "created_utc"]


def in_communities(posts: DataFrame, communities: DataFrame | Sequence[str]) -> DataFrame:
    """Keep posts of the wanted communities (a short list or a table of names)."""
    if isinstance(communities, DataFrame):
        return posts.join(communities.select("subreddit"), "subreddit", "left_semi")
    return posts.filter(F.col("subreddit").isin(list(communities)))


def clean_posts(
    raw: DataFrame, min_score: int = 1, bad_time: str = "drop", keep: Sequence[str] = ()
) -> DataFrame:
    """Clean titles, parse numbers, keep score >= ``min_score`` and add the UTC year.

    ``bad_time``: an unreadable timestamp drops the row (recent pulls) or gives year 0
    (historical dumps).
    """
    if bad_time not in ("drop", "zero"):
        raise ValueError("bad_time is 'drop' or 'zero'")
    # A generator's column: a filter on it is not pushed below, where the title would be cleaned again.
    parsed = raw.select(
        "id",
        F.explode_outer(F.array(clean_title(F.col("title")))).alias("title"),
        "subreddit",
        whole_number(raw, "score").alias("score"),
        F.coalesce(whole_number(raw, "num_comments"), F.lit(0).cast("long")).alias(
            "num_comments"
        ),
        whole_number(raw, "created_utc").alias("created_utc"),
        *keep,
    ).filter(F.col("title").isNotNull() & (F.col("score") >= min_score))
    if bad_time == "drop":
        parsed = parsed.filter(F.col("created_utc").isNotNull())
    year = F.coalesce(utc_year(F.col("created_utc")), F.lit(0)).cast("int")
    return parsed.withColumn("year", year).select(*CLEAN_COLUMNS, *keep)


def first_per_id(posts: DataFrame, order: Sequence[Column], key: str = "id") -> DataFrame:
    """One row per ``key``: the first in ``order``. Copies collapse in the map tasks."""
    return first_n(posts, [key], order, 1)


def newest_first() -> list[Column]:
    return [F.col("created_utc").desc(), F.col("id")]


def latest_per_community(
    posts: DataFrame, n: int, before: int | None = None, community: str = "subreddit"
) -> DataFrame:
    """The newest ``n`` posts of each community created before epoch second ``before``."""
    eligible = posts if before is None else posts.filter(F.col("created_utc") < before)
    return first_n(eligible, [community], newest_first(), n, salts=QUOTA_SALTS)


def strided_months(months: DataFrame, stride: int) -> DataFrame:
    """Every ``stride``-th of the distinct months, in month order.

    The window has no partition key, but ranks distinct months only.
    """
    distinct = months.select("month").distinct()
    position = F.dense_rank().over(Window.orderBy("month"))
    return (
        distinct.withColumn("_position", position)
        .filter(F.pmod(F.col("_position") - 1, F.lit(stride)) == 0)
        .select("month")
    )


def month_stride_scan(rows: DataFrame, stride: int, file: str | None = None) -> DataFrame:
    """Rows of every ``stride``-th month; with ``file``, of the first file of those months.

    Where ``month`` is a partition column the semi join prunes the scan.
    """
    if file is None:
        return rows.join(strided_months(rows, stride), "month", "left_semi")
    first_files = rows.groupBy("month").agg(F.min(file).alias(file))
    chosen = first_files.join(strided_months(first_files, stride), "month", "left_semi")
    return rows.join(chosen, ["month", file], "left_semi")


def two_level_quota(
    posts: DataFrame, per_community: int, n_files: int, month: str = "month"
) -> DataFrame:
    """At most ceil(per_community / n_files) posts per community and month, then at most
    ``per_community`` per community, both oldest first."""
    per_month = math.ceil(per_community / n_files)
    oldest = [F.col("created_utc"), F.col("id")]
    monthly = first_n(posts, ["subreddit", month], oldest, per_month, salts=QUOTA_SALTS)
    return first_n(
        monthly, ["subreddit"], [F.col(month), *oldest], per_community, salts=QUOTA_SALTS
    )


def scan_bound(raw: DataFrame, rows_per_month: int, order: str, tie: str = "id") -> DataFrame:
    """Only the first ``rows_per_month`` raw rows of each month, by (order, tie)."""

    def quota(total: Column) -> Column:
        return F.least(total, F.lit(rows_per_month))

    return mark_lowest(raw, ["month"], order, tie, quota, "_first").filter("_first").drop("_first")


def historical_sample(
    raw: DataFrame, communities: Sequence[str], stride: int, per_community: int,
    rows_per_month: int | None = None, min_score: int = 1,
) -> DataFrame:
    """Stride over months, bound the scan, clean (year 0 on bad time), fill the quotas, then
    de-duplicate by id. Quotas count cleaned rows before the de-duplication."""
    staged = month_stride_scan(raw, stride)
    n_files = strided_months(raw, stride).count()
    if rows_per_month is not None:
        staged = scan_bound(staged, rows_per_month, "file_order")
    wanted = in_communities(staged, communities)
    cleaned = clean_posts(wanted, min_score, bad_time="zero", keep=["month"])
    kept = two_level_quota(cleaned, per_community, n_files)
    return first_per_id(kept, [F.col("month"), F.col("created_utc")]).select(*CLEAN_COLUMNS)


def recent_sample(
    raw: DataFrame, communities: Sequence[str], per_community: int, before: int | None = None,
    min_score: int = 1,
) -> DataFrame:
    """De-duplicate, clean (drop bad time) and keep the newest posts per community."""
    cleaned = clean_posts(in_communities(raw, communities), min_score, bad_time="drop")
    unique = first_per_id(cleaned, newest_first())
    return latest_per_community(unique, per_community, before)


def external_links(
    raw: DataFrame, key: Column | None = None, identity: Column | None = None, title: Column | None = None
) -> DataFrame:
    """Link posts with a content key: no self posts, no skipped hosts, clean title, whole score.

    ``key`` replaces the normalised URL as the content key. ``identity`` and ``title``: the normalised
    URL and the clean title, where they already exist as columns.
    """
    # The URL must qualify either way; ``key`` only changes how content is grouped.
    identity = norm_url(F.col("url")) if identity is None else identity
    return (
        raw.filter(~F.coalesce(F.col("is_self"), F.lit(False)))
        .withColumn("_identity", identity)
        .filter(F.col("_identity").isNotNull())
        .select(
            "sub",
            (F.col("_identity") if key is None else key).alias("nurl"),
            (clean_title(F.col("title")) if title is None else title).alias("title"),
            whole_number(raw, "score").alias("score"),
            "upvote_ratio",
            "num_comments",
            "id",
            "created_utc",
        )
        .filter(F.col("title").isNotNull() & F.col("score").isNotNull() & F.col("nurl").isNotNull())
    )


def with_month(rows: DataFrame) -> DataFrame:
    """Add the UTC month of ``created_utc`` and the row's place in its monthly file.

    Unreadable timestamps share the month '0000-00' and the place 0.
    """
    seconds = whole_number(rows, "created_utc")
    return rows.withColumns(
        {
            "month": F.coalesce(utc_month(seconds), F.lit("0000-00")),
            "file_order": F.coalesce(seconds, F.lit(0).cast("long")),
        }
    )
