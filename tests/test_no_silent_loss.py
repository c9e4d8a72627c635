"""Inputs that once lost rows, values or whole tables without a word."""

import math

from pyspark.sql import functions as F

from titlegauge.operators import ingest, labels, profile, score
from titlegauge.sources import model_store


def test_numbers_of_any_type_are_parsed(spark):
    rows = [("1", "a", "s", 12.0, 3.7, 1.7e9), ("2", "b", "s", float("nan"), None, 1.7e9)]
    raw = spark.createDataFrame(
        rows, "id string, title string, subreddit string, score double, num_comments double, created_utc double"
    )
    assert [(r.id, r.score, r.num_comments, r.year) for r in ingest.clean_posts(raw).collect()] == [("1", 12, 3, 2023)]


def test_posts_without_an_era_get_the_community_share(spark):
    rows = [(1, "s", 2020, 1, False), (2, "s", 2020, 3, False), (3, "s", None, 2, True), (4, "s", 2021, 9, True)]
    df = spark.createDataFrame(rows, "id long, subreddit string, year int, score long, is_test boolean")
    got = {r.id: (r.year, r.label) for r in labels.era_percentile(df).collect()}
    assert got == {1: (2020, 0.5), 2: (2020, 1.0), 3: (None, 0.5), 4: (2021, 1.0)}


def test_unbounded_margins_stay_unbounded(spark):
    rows = [(i, 2.0 + i, 1.0) for i in range(9)] + [(9, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "group_id long, ctr_win double, ctr_lose double")
    got = profile.ab_pair_summary(df).first()
    assert got.median_margin == 6.5 and math.isinf(got.p90_margin)


def test_drafts_without_a_model_are_named(spark):
    model = spark.createDataFrame(
        [("s", "i", "(intercept)", 0.0, 1.0, 0.5)],
        "subreddit string, kind string, feature string, center double, factor double, coef double",
    )
    posts = spark.createDataFrame([(1, "s", "a"), (2, "t", "b")], "id long, subreddit string, title string")
    got = {r.id: (r.band, r.error) for r in score.score_titles(posts, model, ["id", "subreddit", "title"]).collect()}
    assert got == {1: (50.0, None), 2: (None, "no model for t")}


def test_storing_one_community_keeps_the_others(spark, tmp_path):
    def bundle(name, coef):
        model = spark.createDataFrame([(name, "t", "go", coef)], "subreddit string, kind string, feature string, coef double")
        return model, model.select("subreddit", F.lit(1).alias("score")), model.select("subreddit", F.lit(0.5).alias("rho"))

    folder = str(tmp_path / "store")
    for name, coef in (("007", 1.0), ("b", 2.0), ("007", 3.0)):
        model_store.write_models(folder, *bundle(name, coef))
    stored = model_store.read_models(spark, folder)
    assert {(r.subreddit, r.coef) for r in stored["model"].collect()} == {("007", 3.0), ("b", 2.0)}
    assert {r.subreddit for r in model_store.read_models(spark, folder, ["007"])["metrics"].collect()} == {"007"}
