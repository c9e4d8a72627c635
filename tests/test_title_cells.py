import math

from pyspark.sql import functions as F

from titlegauge.operators import features, ranking, title_cells

SPACE = "subreddit string, kind string, feature string, center double, factor double, coef double"
ROWS = [
    ("s", "t", "go", 0.0, 2.0, 0.5), ("s", "t", "go stop", 0.0, 3.0, -1.0), ("s", "s", "n_words", 2.0, 0.5, 0.1),
    ("s", "i", "(intercept)", 0.0, 1.0, 0.25), ("s", "c", "go ", 0.0, 1.5, 0.2), ("s", "e", "e1", 0.0, 1.0, 4.0),
    ("t", "t", "stop", 0.0, 1.0, None), (None, "t", "go", 0.0, 1.0, 1.0),
]


def titles(spark):
    rows = [
        (1, "s", "Go stop go", [5.0, 0.5]), (2, "s", None, None), (3, "t", "stop", None), (4, "u", "go", None),
        (None, "s", "go", None), (None, "s", "go now", None), (5, None, "go", None), (6, "t", "calm", None),
    ]
    return spark.createDataFrame(rows, "id long, subreddit string, title string, embedding array<float>")


def cells(df):
    return {r.id: {(f.kind, f.feature): round(f.value, 9) for f in r.features} for r in df.collect() if r.subreddit == "s"}


def test_no_feature_is_a_row(spark):
    space = spark.createDataFrame(ROWS, SPACE)
    keys = ["subreddit", "id"]
    for made in (
        features.featurize(titles(spark), space, keys, "word_char", "embedding", extra=["coef"]),
        features.weighted_sums(titles(spark), space, keys, "word_char", "embedding"),
    ):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "explode(" not in plan.replace("explode(sequence(", "") and "explode_outer" not in plan
        assert "collect_list" not in plan


def test_cells_of_titles(spark, monkeypatch):
    space = spark.createDataFrame(ROWS, SPACE)
    keys = ["subreddit", "id"]
    wide = features.featurize(titles(spark), space, keys, "word_char", "embedding", extra=["coef"])
    got = cells(wide)
    a, b = (1 + math.log(2)) * 2, 3.0
    length = math.hypot(a, b)
    assert got[1] == {
        ("c", "go "): 1.0, ("e", "e1"): 0.5, ("i", "(intercept)"): 1.0, ("s", "n_words"): 0.5,
        ("t", "go"): round(a / length, 9), ("t", "go stop"): round(b / length, 9),
    }
    assert got[2] == {("i", "(intercept)"): 1.0, ("s", "n_words"): -1.0}
    # Rows of equal keys, null or not, are one title.
    both = [r for r in wide.filter("id is null and subreddit = 's'").collect()]
    assert len(both) == 1 and [f.kind for f in both[0].features] == ["c", "c", "i", "i", "s", "s", "t", "t"]
    assert round(sum(f.value**2 for f in both[0].features if f.kind == "t"), 9) == 1.0
    # A title without a feature in the space, or of no known community, has no row.
    assert {(r.subreddit, r.id) for r in wide.collect()} == {("s", 1), ("s", 2), ("s", None), ("t", 3)}
    summed = features.weighted_sums(titles(spark), space, keys, "word_char", "embedding")
    totals = {(r.subreddit, r.id): r.prediction for r in summed.collect()}
    for r in wide.collect():
        want = sum(f.value * (f.coef or 0.0) for f in r.features)
        assert math.isclose(totals[r.subreddit, r.id], want, abs_tol=1e-9)
    # Chunks of one title each give the same.
    monkeypatch.setattr(title_cells, "CHUNK_TEXT", 1)
    monkeypatch.setattr(title_cells, "LEAST_TEXT", 1)
    monkeypatch.setattr(title_cells, "BROADCAST_BYTES", 0)
    parts = features.weighted_sums(titles(spark), space, keys, "word_char", "embedding")
    assert {(r.subreddit, r.id): round(r.prediction, 9) for r in parts.collect()} == {k: round(v, 9) for k, v in totals.items()}


def test_boundaries_are_found_before_rows_are_marked(spark):
    df = spark.range(100).select(F.lit("s").alias("g"), (F.col("id") % 10).alias("v"), "id")
    marked = ranking.mark_lowest(df, ["g"], "v", "id", lambda total: F.lit(15), "low")
    plan = marked._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
    assert {r.id for r in marked.filter("low").collect()} == {*range(0, 100, 10), 1, 11, 21, 31, 41}


def test_pairs_are_arrays_of_differences(spark):
    space = spark.createDataFrame(ROWS, SPACE)
    pairs = spark.createDataFrame(
        [(1, "go stop", "stop go go"), (2, None, "x y z"), (3, "go", "go")], "k int, title_a string, title_b string"
    )
    found = features.pair_features(pairs, space, ["k"], F.lit("s"), "word", ["kind", "feature", "value", "coef"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "explode_outer" not in plan
    got = {r.k: {f.feature: (round(f.value, 9), f.coef) for f in r.features} for r in found.collect()}
    length = math.hypot(2.0, 3.0)
    assert got[1] == {
        "n_words": (-0.5, 0.1), "go": (round(2 / length - 1, 9), 0.5), "go stop": (round(3 / length, 9), -1.0),
    }
    assert got[2] == {"n_words": (-1.5, 0.1)} and got[3] == {"n_words": (0.0, 0.1), "go": (0.0, 0.5)}
    flat = features.pair_differences(pairs, space, ["k"], F.lit("s"), "word", ["coef"])
    assert flat.columns == ["k", "kind", "feature", "coef", "value"]
    assert {(r.k, r.feature): (round(r.value, 9), r.coef) for r in flat.collect()} == {(k, f): v for k, c in got.items() for f, v in c.items()}
