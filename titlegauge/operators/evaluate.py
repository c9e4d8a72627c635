"""Rank and pair metrics per community, result tables, model comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titlegauge.functions.text import structural
from titlegauge.operators.joins import lookup_join
from titlegauge.operators.ranking import average_ranks, mark_lowest
from titlegauge.session import cut_lineage

TOP_SHARE = 0.10
MEAN_ROW = "MEAN"


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, out: str) -> DataFrame:
    """Rank correlation of ``x`` and ``y`` per group; null where either is constant.

    Rows fold into (x, y) cells first. Ranks are centred on their known mean, which keeps the
    sums small in large groups.
    """
    keys = list(keys)
    cells = df.groupBy(*keys, x, y).agg(F.count(F.lit(1)).alias("_n"))
    rank_x = average_ranks(cells, keys, x, "_rx", "_n")
    rank_y = average_ranks(cells, keys, y, "_ry", "_n").drop("total")
    ranked = cells.join(rank_x, [*keys, x]).join(rank_y, [*keys, y])
    middle = (F.col("total") + 1) / 2
    a, b, n = F.col("_rx") - middle, F.col("_ry") - middle, F.col("_n")
    spread = F.sqrt(F.sum(n * a * a) * F.sum(n * b * b))
    return ranked.groupBy(*keys).agg(
        (F.sum(n * a * b) / F.nullif(spread, F.lit(0.0))).alias(out)
    )


def top_count(total: Column, share: float = TOP_SHARE) -> Column:
    """max(1, share of the rows), halves rounded to the even number."""
    return F.greatest(F.lit(1), F.bround(total * F.lit(share), 0).cast("long"))


def top_decile(
    df: DataFrame, keys: Sequence[str], prediction: str, truth: str, share: float = TOP_SHARE
) -> DataFrame:
    """Per group: rows, k, precision of the predicted top k against the true top k, k / rows.

    Ties go to the smaller id. No join: two flags per row, counted together.
    """
    keys = list(keys)
    flagged = df.withColumns({"_p": -F.col(prediction), "_t": -F.col(truth)})
    for value, flag in (("_p", "_in_p"), ("_t", "_in_t")):
        flagged = mark_lowest(
            flagged, keys, value, "id", lambda total: top_count(total, share), flag
        )
    n = F.count(F.lit(1))
    hits = F.sum((F.col("_in_p") & F.col("_in_t")).cast("long"))
    return flagged.groupBy(*keys).agg(
        n.alias("n_test"),
        top_count(n, share).alias("k"),
        (hits / top_count(n, share)).alias("top10_model"),
        (top_count(n, share) / n).alias("top10_random"),
    )


def naive_spearman(labelled: DataFrame) -> DataFrame:
    """Rank correlation of the word count with the label."""
    counted = labelled.select(
        "subreddit", structural(F.col("title"))["n_words"].alias("n_words"), "label"
    )
    return spearman(counted, ["subreddit"], "n_words", "label", "rho_naive")


def with_mean_row(table: DataFrame, name: str = "subreddit") -> DataFrame:
    """Append the plain mean of the group rows of every numeric column."""
    numeric = [c for c, kind in table.dtypes if c != name and kind not in ("string", "boolean")]
    # One row per community, read twice below.
    as_double = cut_lineage(table.withColumns({c: F.col(c).cast("double") for c in numeric}))
    mean = as_double.agg(*[F.avg(c).alias(c) for c in numeric]).withColumn(name, F.lit(MEAN_ROW))
    return as_double.unionByName(mean, allowMissingColumns=True)


def evaluation_rows(predicted: DataFrame, train_sizes: DataFrame) -> DataFrame:
    """Per community: sizes, naive and model rank correlation, top-decile precision.

    ``predicted``: held-out posts with label, prediction and title.
    """
    # A row per community each, written, as planning all three at once takes longer than running them.
    top = cut_lineage(top_decile(predicted, ["subreddit"], "prediction", "label").drop("k"))
    rho = cut_lineage(spearman(predicted, ["subreddit"], "prediction", "label", "rho_model"))
    naive = cut_lineage(naive_spearman(predicted))
    return (
        train_sizes.join(top, "subreddit").join(naive, "subreddit", "left")
        .join(rho, "subreddit", "left")
        .select(
            "subreddit", "n_train", "n_test", "rho_naive", "rho_model",
            "top10_model", "top10_random",
        )
    )


def community_overlap(pairs: DataFrame, models: DataFrame) -> DataFrame:
    """Communities of the pairs, marked by whether a model exists for them."""
    wanted = pairs.select("subreddit").distinct()
    modelled = models.select("subreddit").distinct()
    have = wanted.intersect(modelled).withColumn("modelled", F.lit(True))
    return have.unionByName(
        wanted.exceptAll(modelled).withColumn("modelled", F.lit(False))
    )


def modelled_pairs(pairs: DataFrame, models: DataFrame) -> DataFrame:
    return lookup_join(
        pairs, models.select("subreddit").distinct(), ["subreddit"], how="left_semi"
    )


def scored_pairs(pairs: DataFrame, title_scores: DataFrame) -> DataFrame:
    """Pairs with the score of either title; ``title_scores``: (subreddit, title, band).

    Each distinct title is scored once, whatever the number of pairs it takes part in. Titles meet by two
    64-bit numbers, so that no text is shuffled that nobody reads; the scores are read twice.
    """
    number = ["_t1", "_t2"]

    def numbered(df: DataFrame, title: str) -> DataFrame:
        known = F.col(title).isNotNull()
        return df.withColumns({n: F.when(known, F.xxhash64(F.lit(i), F.col(title))) for i, n in enumerate(number, 1)})

    scores = numbered(title_scores, "title")
    for name in ("win", "lose"):
        side = scores.select("subreddit", *number, F.col("band").alias(f"band_{name}"))
        pairs = numbered(pairs, f"title_{name}").join(side, ["subreddit", *number]).drop(*number)
    return pairs


def distinct_titles(pairs: DataFrame) -> DataFrame:
    titles = F.explode(F.array("title_win", "title_lose"))
    return pairs.select("subreddit", titles.alias("title")).distinct()


def _accuracy(correct: Column) -> list[Column]:
    return [F.count(F.lit(1)).alias("pairs"), F.avg(correct.cast("double")).alias("accuracy")]


def pair_accuracy(scored: DataFrame) -> DataFrame:
    """Share of pairs whose winner scores higher, per community and overall (null).

    A tie counts as wrong; ``ties`` tells how many there are.
    """
    win, lose = F.col("band_win"), F.col("band_lose")
    ties = F.sum((win == lose).cast("long")).alias("ties")
    return scored.rollup("subreddit").agg(*_accuracy(win > lose), ties)


def margin_accuracy(judged: DataFrame) -> DataFrame:
    """Accuracy per margin bucket; ``judged`` has margin and a boolean ``correct``."""
    return (
        judged.filter(F.col("margin").isNotNull()).groupBy("margin").agg(*_accuracy(F.col("correct")))
    )


def order_symmetric(logits: DataFrame) -> DataFrame:
    """Per pair: logit(win, lose) - logit(lose, win) and whether it is positive."""

    def shown(order: str) -> Column:
        return F.max(F.when(F.col("ordering") == order, F.col("logit")))

    margins = logits.groupBy("pair_id").agg((shown("wl") - shown("lw")).alias("logit_margin"))
    return margins.withColumn("correct", F.col("logit_margin") > 0)


def order_symmetric_accuracy(logits: DataFrame) -> DataFrame:
    return order_symmetric(logits).agg(*_accuracy(F.col("correct")))


def compare_metrics(
    base: DataFrame, other: DataFrame, metric: str, base_name: str, other_name: str
) -> DataFrame:
    """Both metrics side by side with their difference, plus the mean row."""
    left = base.select("subreddit", F.col(metric).alias(base_name))
    right = other.select("subreddit", F.col(metric).alias(other_name))
    joined = left.join(right, "subreddit").withColumn(
        "delta", F.col(other_name) - F.col(base_name)
    )
    return with_mean_row(joined)
