"""Content-controlled title pairs: repost groups, A/B pairs, dual-label pairs, orientation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titlegauge.functions.values import (
    is_weekend, margin_bucket, number_or_zero, seeded_order, smoothed_ratio, time_matched, utc_hour,
)
from titlegauge.functions.text import strip_spaces
from titlegauge.operators.joins import lookup_join, pairs_within
from titlegauge.operators.ranking import (
    exact_quantiles, first_n, global_index, interpolated, upper_median,
)
from titlegauge.session import cut_lineage

GROUP = ["sub", "nurl"]
PAIRS_PER_GROUP = 10
# Posts up to which a group is looked at whole, and posts of a part of a larger group.
PLAIN_GROUP, PAIR_BLOCK = 200, 20_000
MIN_IMPRESSIONS = 1000
MIN_GROUPS, MIN_ROWS = 5, 60
DECISIVE_SCORE_RATIO, DECISIVE_CTR_RATIO = 5.0, 1.5


def _either(condition: Column, yes: Column, no: Column) -> Column:
    return F.when(condition, yes).otherwise(no)


def repost_groups(links: DataFrame, min_titles: int = 2) -> DataFrame:
    """Groups of at least two posts and ``min_titles`` distinct titles, with score spread."""
    return (
        links.groupBy(*GROUP)
        .agg(
            F.count(F.lit(1)).alias("n_posts"),
            F.countDistinct("title").alias("n_titles"),
            F.min("score").alias("min_score"),
            F.max("score").alias("max_score"),
        )
        .filter((F.col("n_posts") >= 2) & (F.col("n_titles") >= min_titles))
        .withColumn("ratio", smoothed_ratio(F.col("max_score"), F.col("min_score")))
    )


def noise_floor(groups: DataFrame) -> DataFrame:
    """Upper median of the score ratio over groups, and the share of groups at 5x or more."""
    shares = groups.agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.avg((F.col("ratio") >= 5).cast("double")).alias("share_5x"),
    )
    median = exact_quantiles(groups, [], "ratio", {"median_ratio": upper_median()})
    stacked = shares.unionByName(median, allowMissingColumns=True)
    return stacked.agg(*[F.max(name).alias(name) for name in stacked.columns])


def top_posts_per_group(links: DataFrame, min_titles: int = 3, n: int = 4) -> DataFrame:
    """The ``n`` best-scored posts of every group with ``min_titles`` distinct titles."""
    top = first_n(links, GROUP, [F.desc("score"), F.col("id")], n, rank="place")
    wanted = repost_groups(links, min_titles).select(*GROUP)
    return top.join(wanted, GROUP, "left_semi").select(*GROUP, "place", "score", "title")


def first_pair_candidates(
    links: DataFrame, cap: int = PAIRS_PER_GROUP, plain: int = PLAIN_GROUP, block: int = PAIR_BLOCK
) -> DataFrame:
    """A subset of each group that holds its first ``cap`` qualifying pairs, with ``pos``, the place in it.

    A group of up to ``plain`` posts is kept whole; of a larger one, 5 * cap posts. A pair (a, b), a before
    b, qualifies when titles and scores both differ. If (a, b) is among the first ``cap`` pairs in (a, b)
    order, then:

    * fewer than ``cap`` copies of b (same title and score) precede b, since each of them forms
      an earlier pair with a; the same holds for a. So ``cap`` copies per (title, score) suffice.
    * among the rows left, fewer than ``cap`` posts with b's title and a score unlike a's precede
      b, plus at most ``cap`` with a's score: 2 * cap rows per title suffice, and likewise
      2 * cap rows per score.
    * every post before b (other than a) that qualifies with a forms an earlier pair with a, so
      there are fewer than ``cap``; the rest share a's title or a's score, at most 2 * cap each.
      So 5 * cap rows per group suffice, which leaves fewer than (5 * cap)^2 / 2 pairs to test.

    Fewer still precede a post in a part of its group, so the steps may first be taken in each part: a
    group is cut into parts of about ``block`` posts. All steps of a part, and the places of a group, are
    ranked after one shuffle. ``links`` is read more than once.
    """
    posts = links.select(*GROUP, "title", "score", "created_utc", "id")
    order = [F.col("created_utc").desc(), F.col("id")]

    def pruned(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        kept = first_n(rows.repartition(*keys), [*keys, "title", "score"], order, cap)
        kept = first_n(kept, [*keys, "title"], order, 2 * cap)
        kept = first_n(kept, [*keys, "score"], order, 2 * cap)
        return first_n(kept, keys, order, 5 * cap)

    place = F.row_number().over(Window.partitionBy(*GROUP).orderBy(*order))
    large = cut_lineage(posts.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > plain))
    if large.isEmpty():
        return posts.repartition(*GROUP).withColumn("pos", place)
    sized = lookup_join(posts, large, GROUP, how="left", spread=["id"])
    part = F.pmod(F.xxhash64("id", "title"), F.ceil(F.col("_n") / block).cast("long"))
    parts = pruned(sized.filter("_n is not null").withColumn("_part", part), [*GROUP, "_part"])
    kept = pruned(parts.select(posts.columns), GROUP)
    whole = sized.filter("_n is null").select(posts.columns).unionByName(kept)
    return whole.repartition(*GROUP).withColumn("pos", place)


def repost_pairs(
    links: DataFrame, cap: int = PAIRS_PER_GROUP, plain: int = PLAIN_GROUP, block: int = PAIR_BLOCK
) -> DataFrame:
    """The first ``cap`` pairs per group (newest posts first) whose titles and scores differ,
    oriented winner / loser, without repeats.

    The candidates of a group become one array, whose pairs are cut to ``cap`` in the row, so rejected
    pairs and later ones are never rows.
    """

    def side(a: Column, b: Column) -> Column:
        a_wins = a["score"] > b["score"]
        return F.struct(
            _either(a_wins, a["title"], b["title"]).alias("title_win"),
            F.greatest(a["score"], b["score"]).alias("score_win"),
            _either(a_wins, b["title"], a["title"]).alias("title_lose"),
            F.least(a["score"], b["score"]).alias("score_lose"),
        )

    def pairs_of(a: Column) -> Column:
        later = F.slice("_posts", a["pos"] + 1, F.size("_posts"))
        differing = F.filter(later, lambda b: (a["title"] != b["title"]) & (a["score"] != b["score"]))
        return F.transform(F.slice(differing, 1, cap), lambda b: side(a, b))

    candidates = first_pair_candidates(links.dropna(subset=GROUP), cap, plain, block)
    posts = F.sort_array(F.collect_list(F.struct("pos", "title", "score")))
    groups = candidates.groupBy(*GROUP).agg(posts.alias("_posts"))
    none = F.transform(F.slice("_posts", 1, 0), lambda a: side(a, a))
    # Posts after the one that fills the cap are not looked at.
    first = F.aggregate(
        "_posts", none, lambda found, a: F.when(F.size(found) >= cap, found).otherwise(F.concat(found, pairs_of(a)))
    )
    staged = groups.select(*GROUP, F.array_distinct(F.slice(first, 1, cap)).alias("_pairs"))
    return staged.select(F.col("sub").alias("subreddit"), "nurl", F.explode("_pairs").alias("_p")).select(
        "subreddit", "nurl", "_p.*"
    )


def ab_click_rates(variants: DataFrame, min_impressions: float = MIN_IMPRESSIONS) -> DataFrame:
    """Complete variants with enough impressions, trimmed headline and click-through rate."""
    complete = variants.dropna(subset=["headline", "impressions", "clicks", "eyecatcher_id"])
    return complete.filter(F.col("impressions") >= min_impressions).select(
        "clickability_test_id", "eyecatcher_id", "impressions",
        strip_spaces(F.col("headline")).alias("headline"),
        (F.col("clicks") / F.col("impressions")).alias("ctr"),
    )


def ab_pairs(
    variants: DataFrame, min_impressions: float = MIN_IMPRESSIONS, source: str = "ab_test"
) -> DataFrame:
    """Headline pairs of one test and picture with different click-through rates.

    One row per headline (the first by impressions) enters; a (winner, loser) pair found in
    several tests keeps the first test. Both sides of the reduction combine in the map tasks.
    """
    test = ["clickability_test_id", "eyecatcher_id"]
    order = [F.col("impressions").desc(), F.col("ctr").desc()]
    rows = first_n(ab_click_rates(variants, min_impressions), [*test, "headline"], order, 1)

    def differ(a, b):
        return (a("headline") < b("headline")) & (a("ctr") != b("ctr"))

    def sides(a, b):
        a_wins = a("ctr") > b("ctr")
        return [
            *[a(key).alias(key) for key in test],
            _either(a_wins, a("headline"), b("headline")).alias("title_win"),
            _either(a_wins, b("headline"), a("headline")).alias("title_lose"),
            F.greatest(a("ctr"), b("ctr")).alias("ctr_win"),
            F.least(a("ctr"), b("ctr")).alias("ctr_lose"),
        ]

    pairs = pairs_within(rows, test, ["headline"], differ, sides)
    # The least (test, picture) first: struct order decides which test a pair is kept from.
    first = F.min(F.struct(*test, "ctr_win", "ctr_lose")).alias("first")
    return pairs.groupBy("title_win", "title_lose").agg(first).select(
        "title_win", "title_lose",
        F.col("first.ctr_win").alias("ctr_win"),
        F.col("first.ctr_lose").alias("ctr_lose"),
        F.col("first.clickability_test_id").cast("string").alias("group_id"),
        F.lit(source).alias("source"),
    )


def rated_links(links: DataFrame) -> DataFrame:
    """Links with an upvote ratio; numbers as double, unreadable comment counts as 0."""
    return links.dropna(subset=["upvote_ratio"]).withColumns(
        {
            "score": F.col("score").cast("double"),
            "upvote_ratio": F.col("upvote_ratio").cast("double"),
            "num_comments": number_or_zero(F.col("num_comments")),
        }
    )


def with_posting_time(links: DataFrame) -> DataFrame:
    epoch = F.col("created_utc")
    return links.withColumns({"hour": utc_hour(epoch), "weekend": is_weekend(epoch)})


def dual_label_pairs(links: DataFrame) -> DataFrame:
    """All pairs of same-content posts with different titles, with both labels of both sides.

    Posts alike in title, labels, hour and weekend flag are folded first, so copies never meet
    one by one: ``n_pairs`` says how many pairs of posts a row stands for. ``ta`` < ``tb``.
    """
    signature = ["title", "score", "upvote_ratio", "hour", "weekend"]
    folded = (
        with_posting_time(rated_links(links))
        .groupBy(*GROUP, *signature)
        .agg(F.count(F.lit(1)).alias("copies"))
    )

    def ordered(a, b):
        return a("title") < b("title")

    def sides(a, b):
        matched = time_matched(a("hour"), a("weekend"), b("hour"), b("weekend"))
        return [
            *[a(key).alias(key) for key in GROUP],
            a("title").alias("ta"), b("title").alias("tb"),
            a("score").alias("sa"), b("score").alias("sb"),
            a("upvote_ratio").alias("ua"), b("upvote_ratio").alias("ub"),
            matched.alias("time_matched"),
            smoothed_ratio(a("score"), b("score")).alias("sratio"),
            (a("copies") * b("copies")).alias("n_pairs"),
        ]

    return pairs_within(folded, GROUP, signature, ordered, sides)


def dual_viability(
    links: DataFrame, min_groups: int = MIN_GROUPS, min_rows: int = MIN_ROWS
) -> DataFrame:
    """``viability`` of the dual-label pairs per community, from counts: posts of one title make no
    pair with each other, all others do."""
    titles = rated_links(links).groupBy(*GROUP, "title").agg(F.count(F.lit(1)).alias("n"))
    groups = titles.groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("n_titles"), F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("n")).alias("squares"),
    )
    counted = groups.filter("n_titles > 1").groupBy("sub").agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.sum(F.expr("(n * n - squares) div 2")).alias("n_pairs"),
    )
    viable = (F.col("n_groups") >= min_groups) & (F.col("n_pairs") >= min_rows)
    return counted.withColumn("viable", viable)


def balanced_pairs(pairs: DataFrame, key: Sequence[str], seed: int = 0) -> DataFrame:
    """Alternate the presentation order: even rows show the winner first (y = 1), odd rows the
    loser (y = 0), over a reproducible total order of the pairs."""
    joined = F.concat_ws("\x1f", *[F.col(name).cast("string") for name in key])
    indexed = global_index(pairs, seeded_order(joined, seed), key, "pair_index")
    winner_first = F.col("pair_index") % 2 == 0
    return indexed.withColumns(
        {
            "title_a": _either(winner_first, F.col("title_win"), F.col("title_lose")),
            "title_b": _either(winner_first, F.col("title_lose"), F.col("title_win")),
            "y": winner_first.cast("int"),
        }
    )


def symmetric_examples(pairs: DataFrame) -> DataFrame:
    """Each pair in both orders: (winner, loser, 1) and (loser, winner, 0)."""
    example = F.explode(
        F.array(
            F.struct(
                F.col("title_win").alias("title_a"), F.col("title_lose").alias("title_b"),
                F.lit(1).alias("y"),
            ),
            F.struct(
                F.col("title_lose").alias("title_a"), F.col("title_win").alias("title_b"),
                F.lit(0).alias("y"),
            ),
        )
    )
    kept = [name for name in pairs.columns if name not in ("title_win", "title_lose")]
    return pairs.select(*kept, example.alias("_e")).select(*kept, "_e.*")


def decisive_reposts(pairs: DataFrame, ratio: float = DECISIVE_SCORE_RATIO) -> DataFrame:
    return pairs.filter((F.col("score_win") + 1) / (F.col("score_lose") + 1) >= ratio)


def decisive_ab(pairs: DataFrame, ratio: float = DECISIVE_CTR_RATIO) -> DataFrame:
    # win >= ratio * lose keeps pairs whose loser has no clicks (an unbounded margin).
    return pairs.filter(F.col("ctr_win") >= ratio * F.col("ctr_lose"))


def viability(
    pairs: DataFrame, keys: Sequence[str], content: str, weight: str | None = None,
    min_groups: int = MIN_GROUPS, min_rows: int = MIN_ROWS,
) -> DataFrame:
    """Per ``keys``: distinct content groups, pairs, and whether a study is worth running."""
    size = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return (
        pairs.groupBy(*keys)
        .agg(F.countDistinct(content).alias("n_groups"), size.alias("n_pairs"))
        .withColumn(
            "viable", (F.col("n_groups") >= min_groups) & (F.col("n_pairs") >= min_rows)
        )
    )


def with_margin(pairs: DataFrame) -> DataFrame:
    ratio = (F.col("score_win") + 1) / (F.col("score_lose") + 1)
    return pairs.withColumn("margin", margin_bucket(ratio))
