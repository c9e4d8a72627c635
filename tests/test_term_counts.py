"""Folded term counts against the same terms counted title by title."""

import pytest
from pyspark.sql import functions as F

from titlegauge.operators import features, term_counts

TITLES = [
    ("a", "The cat, the CAT and the hat", 2, 0.5), ("a", "the cat\t sat  on x mat", 1, None), ("a", "Été à la x ab 😀😀ab", 3, 0.25),
    ("b", "the cat", 1, 1.0), ("b", None, 1, 0.75), ("b", "", 5, 0.1), ("b", "a b", None, 0.3), (None, "the hat", 4, None),
    ("b", "the cat", 1, 1.0), ("a", "word " * 30 + "ЖЖ 漢字漢字", 1, 0.2),
]


@pytest.mark.parametrize("analyzer", ["word", "char"])
@pytest.mark.parametrize("step", [1, 7, 200_000])
def test_folded_terms_are_the_totals_of_title_terms(spark, monkeypatch, analyzer, step):
    monkeypatch.setattr(term_counts, "STEP_WORDS", step)
    posts = spark.createDataFrame(
        [(f"i{i}", *row) for i, row in enumerate(TITLES)], "id string, subreddit string, title string, w int, label double"
    ).coalesce(2)
    keys = ["subreddit", "feature"]
    one = features.title_terms(posts, analyzer, keep=["w", "label"])
    known = F.when(F.col("label").isNotNull(), F.col("w"))
    want = one.filter("w is not null").groupBy(*keys).agg(
        F.sum(F.col("tf") * F.col("w")), F.sum("w"), F.round(F.sum(F.col("label") * F.col("w")), 9), F.sum(known)
    )
    many = features.title_terms(posts, analyzer, keep=["label"], folded=True, weight="w")
    got = many.groupBy(*keys).agg(
        F.sum("tf"), F.sum("df"), F.round(F.sum("sum_0"), 9), F.sum("n_0")
    )

    def plain(df):
        return sorted((tuple(0 if x is None else x for x in row) for row in df.collect()), key=repr)

    assert plain(got) == plain(want)


def test_a_term_of_many_titles_is_one_row_per_stretch(spark):
    posts = spark.range(5_000).select(
        F.col("id").cast("string").alias("id"), F.lit("a").alias("subreddit"), F.lit("same few words").alias("title")
    ).coalesce(1)
    rows = features.title_terms(posts, folded=True).collect()
    assert len(rows) == 5 and {(r.tf, r.df) for r in rows} == {(5_000, 5_000)}


def test_no_titles(spark):
    posts = spark.createDataFrame([], "id string, subreddit string, title string")
    assert features.title_terms(posts, "char", folded=True).count() == 0
