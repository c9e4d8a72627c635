import random

from pyspark.sql import functions as F

from titlegauge.operators import features, labels

POST = "id long, title string, subreddit string, score long, year int"


def make_posts(spark, n=400, seed=1):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "What", "why", "12", "go!"]
    rows = [
        (i, " ".join(rng.choices(words, k=rng.randrange(1, 9))), "hot" if i % 3 else f"s{i % 4}",
         rng.randrange(30), 2015 + rng.randrange(4))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, POST)


def test_ecdf_bounds_and_fallback(spark):
    rows = [(1, "a", "s", 5, 2020, False), (2, "a", "s", 7, 2020, False),
            (3, "a", "s", 9, 2021, False), (4, "a", "s", 9, 2020, True),
            (5, "a", "s", 1, 2020, True), (6, "a", "s", 7, 1999, True)]
    df = spark.createDataFrame(rows, POST + ", is_test boolean")
    got = {r.id: r.label for r in labels.era_percentile(df).collect()}
    assert got[4] == 1.0 and got[5] == 0.0
    assert got[6] == 2 / 3  # unseen era: the whole community
    assert got[1] == 0.5 and got[3] == 1.0


def test_labels_grow_with_score(spark):
    split = labels.stratified_split(make_posts(spark))
    got = labels.era_percentile(split).collect()
    assert len(got) == 400 and all(0 <= r.label <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault((r.subreddit, r.year), []).append((r.score, r.label))
    for members in by.values():
        members.sort()
        assert [m[1] for m in members] == sorted(m[1] for m in members)


def test_stratified_split_shares(spark):
    got = labels.stratified_split(make_posts(spark)).collect()
    by = {}
    for r in got:
        by.setdefault((r.subreddit, r.year), []).append(r.is_test)
    for flags in by.values():
        n = len(flags)
        assert sum(flags) == (max(1, int(0.2 * n + 0.5)) if n >= 2 else 0)


def test_group_split_keeps_content_together(spark):
    df = spark.range(300).select("id", F.concat(F.lit("u"), F.col("id") % 37).alias("nurl"))
    got = labels.group_split(df, ["nurl"], 0.25).collect()
    sides = {}
    for r in got:
        sides.setdefault(r.nurl, set()).add(r.is_test)
    assert len(got) == 300 and all(len(s) == 1 for s in sides.values())
    assert sum(s == {True} for s in sides.values()) == 10  # ceil(0.25 * 37)


def test_test_rows_do_not_reach_the_fitted_tables(spark):
    split = labels.stratified_split(make_posts(spark)).cache()
    changed = split.withColumn(
        "title", F.when(F.col("is_test"), F.lit("zzz zzz 99!")).otherwise(F.col("title"))
    ).withColumn("score", F.when(F.col("is_test"), 999).otherwise(F.col("score")))

    def fitted(df):
        train = df.filter("not is_test")
        space = features.fit_space(train).collect()
        ecdf = labels.fit_ecdf(train).collect()
        return sorted(map(str, space)), sorted(map(str, ecdf))

    assert fitted(split) == fitted(changed)


def test_tfidf_rows_have_unit_length(spark):
    posts = make_posts(spark)
    weights = features.tfidf(posts, features.vocabulary(posts)).groupBy("id").agg(
        F.sum(F.col("weight") * F.col("weight")).alias("norm")
    )
    assert all(abs(r.norm - 1) < 1e-9 for r in weights.collect())


def test_vocabulary_limits(spark):
    rows = [(i, t, "s", 1, 2020) for i, t in enumerate(["aa bb", "aa bb", "aa cc", "dd", "dd dd"])]
    df = spark.createDataFrame(rows, POST)
    got = {r.feature: (r.tf, r.df) for r in features.vocabulary(df, min_df=2).collect()}
    assert got == {"aa": (3, 3), "bb": (2, 2), "aa bb": (2, 2), "dd": (3, 2)}
    top = features.vocabulary(df, min_df=2, max_features=2).collect()
    assert {r.feature for r in top} == {"aa", "dd"}
