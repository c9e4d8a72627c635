import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from titlegauge.functions.text import with_structural
from titlegauge.operators import evaluate, features, score
from titlegauge.plans import pair_study
from titlegauge.session import cut_lineage


def test_confidence_levels(spark):
    rows = [("a", float("nan")), ("b", None), ("c", 0.25), ("d", 0.15), ("e", 0.1499)]
    got = {r.subreddit: r for r in score.confidence(
        spark.createDataFrame(rows, "subreddit string, rho double")).collect()}
    assert [got[k].level for k in "abcde"] == ["unknown", "unknown", "high", "moderate", "low"]
    assert got["a"].rho is None and got["a"].note == score.NOTE_NAN
    assert got["b"].note == score.NOTE_MISSING


def test_draft_lines(spark):
    df = spark.createDataFrame(
        [(1, "s", 0, " a \n\n b\r\nc\n\t\n\td\u00a0"), (2, "s", 0, None)],
        "request_id long, subreddit string, position long, drafts string",
    )
    got = [(r.position, r.title) for r in score.draft_lines(df).orderBy("position").collect()]
    assert got == [(0, "a"), (2, "b"), (3, "c"), (5, "d")]


def scored(spark, bands):
    rows = [(1, i, "s", f"t{i}", float(b), "x") for i, b in enumerate(bands)]
    rows.append((2, 0, "s", "alone", 10.0, "x"))
    rows.append((3, 0, "no", "unknown", None, None))
    rows.append((3, 1, "s", "known", 5.0, "x"))
    return spark.createDataFrame(
        rows, "request_id long, position long, subreddit string, title string, band double, verdict string"
    )


def test_rank_ties_keep_input_order(spark):
    df = scored(spark, [50, 100, 100, 0, 50])
    got = score.rank_drafts(df).orderBy("rank").collect()
    assert [r.position for r in got if r.request_id == 1] == [1, 2, 0, 4, 3]
    status = {(r.request_id, r.position): (r.rank, r.status) for r in got if r.request_id > 1}
    assert status == {(2, 0): (1, "too few drafts"), (3, 0): (2, "no model"), (3, 1): (1, "ranked")}
    assert {r.status for r in score.rank_drafts(df, min_drafts=1).collect()} == {"ranked", "no model"}
    best = {r.request_id: r.position for r in score.strongest_draft(df).collect()}
    assert best == {1: 1, 2: 0, 3: 1}


MODEL = "subreddit string, kind string, feature string, center double, factor double, coef double"


def model(spark):
    rows = [
        ("s", "i", "(intercept)", 0.0, 1.0, 0.5),
        ("s", "t", "go", 0.0, 1.0, 0.2),
        ("s", "t", "stop", 0.0, 1.0, -0.3),
        ("s", "s", "has_exclaim", 0.5, 2.0, -0.1),
        ("s", "s", "n_words", 0.0, 1.0, 0.0),
    ]
    return spark.createDataFrame(rows, MODEL)


def test_explain_wording_and_order(spark):
    posts = spark.createDataFrame(
        [(1, "s", "go stop"), (2, "s", "calm!"), (3, "t", "go")],
        "id long, subreddit string, title string",
    )
    predicted = score.predict(posts, model(spark), ["subreddit", "id"])
    got = {r.id: r for r in score.explain(predicted).collect()}
    assert set(got) == {1, 2}  # no model for community t
    one = got[1]
    assert one.prediction == pytest.approx(0.5 + (0.2 - 0.3) / math.sqrt(2) + 0.1)
    assert [b.label for b in one.boosts] == ['"go"', "no exclamation mark"]
    assert [h.label for h in one.hurts] == ['"stop"']
    assert [h.label for h in got[2].hurts] == ["has an exclamation mark"] and got[2].boosts == []
    text = score.explain(predicted).select("id", score.explanation_text(F.col("boosts")))
    assert dict(map(tuple, text.collect()))[2] == score.NOTHING_NOTABLE


def test_unknown_communities(spark):
    metrics = spark.createDataFrame([("b", 0.1), ("a", 0.2)], "subreddit string, rho double")
    asked = spark.createDataFrame([("a",), ("z",)], "subreddit string")
    got = score.unknown_communities(asked, metrics).collect()
    assert [tuple(r) for r in got] == [("z", "no model for z; trained: a, b")]
    with pytest.raises(LookupError, match="trained: a, b"):
        score.require_models(asked, metrics)
    assert score.require_models(asked.limit(1), metrics).count() == 1
    assert "none trained yet" in score.unknown_communities(asked, metrics.limit(0)).first().error


def brute_rank(values):
    order = sorted(values)
    return [order.index(v) + (order.count(v) + 1) / 2 for v in values]


def test_spearman(spark):
    rng = random.Random(0)
    rows = [(i, "hot" if i % 3 else "s", rng.randrange(12), rng.random()) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, subreddit string, x int, y double")
    got = {r.subreddit: r.rho for r in evaluate.spearman(df, ["subreddit"], "x", "y", "rho").collect()}
    for key in ("hot", "s"):
        x = brute_rank([r[2] for r in rows if r[1] == key])
        y = brute_rank([r[3] for r in rows if r[1] == key])
        assert got[key] == pytest.approx(np.corrcoef(x, y)[0, 1])
    same = evaluate.spearman(df.withColumn("z", F.col("x")), ["subreddit"], "x", "z", "rho")
    assert all(r.rho == pytest.approx(1.0) for r in same.collect())
    flat = evaluate.spearman(df.withColumn("z", F.lit(1)), ["subreddit"], "x", "z", "rho")
    assert all(r.rho is None for r in flat.collect())


@pytest.mark.parametrize("n, k", [(5, 1), (14, 1), (25, 2)])
def test_top_decile_size(spark, n, k):
    df = spark.range(n).select(
        "id", F.lit("s").alias("subreddit"), F.col("id").cast("double").alias("p"),
        (-F.col("id")).cast("double").alias("t"),
    )
    row = evaluate.top_decile(df, ["subreddit"], "p", "t").first()
    assert (row.k, row.n_test, row.top10_model) == (k, n, 0.0)
    assert evaluate.top_decile(df, ["subreddit"], "p", "p").first().top10_model == 1.0


def test_constant_logits_are_never_right(spark):
    rows = [(i, o, 0.5) for i in range(4) for o in ("wl", "lw")]
    df = spark.createDataFrame(rows, "pair_id long, ordering string, logit double")
    assert evaluate.order_symmetric_accuracy(df).first().accuracy == 0.0


def test_pair_ties_count_as_wrong(spark):
    rows = [("s", "a", "b"), ("s", "b", "a"), ("s", "a", "c")]
    pairs = spark.createDataFrame(rows, "subreddit string, title_win string, title_lose string")
    bands = spark.createDataFrame(
        [("s", "a", 100.0), ("s", "b", 40.0), ("s", "c", 100.0)],
        "subreddit string, title string, band double",
    )
    got = {r.subreddit: r for r in evaluate.pair_accuracy(evaluate.scored_pairs(pairs, bands)).collect()}
    assert got["s"].accuracy == pytest.approx(1 / 3) and got[None].ties == 1


def test_mean_row(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("b", 3, None)], "subreddit string, n long, r double")
    row = evaluate.with_mean_row(df).filter("subreddit = 'MEAN'").first()
    assert (row.n, row.r) == (2.0, 0.5)


def test_sums_equal_gathered_features(spark):
    posts = spark.createDataFrame(
        [(1, "s", "go stop go"), (2, "s", "calm!"), (3, "t", "go"), (4, "s", ""), (5, "s", None), (1, "s", "stop")],
        "id long, subreddit string, title string",
    )
    keys = ["subreddit", "id"]
    gathered = score.predict(posts, model(spark), keys)
    summed = score.predict(posts, model(spark), keys, with_features=False)
    want = {r.id: r.prediction for r in gathered.collect()}
    assert {r.id: r.prediction for r in summed.collect()} == pytest.approx(want) and set(want) == {1, 2, 4, 5}
    cells = features.feature_cells(posts, model(spark), keys, extra=["coef"])
    one_by_one = features.long_features(gathered, keys)

    def listed(df):
        names = (*keys, "kind", "feature", "value", "raw", "coef")
        return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*names).collect())

    assert listed(cells) == listed(one_by_one)
    plan = summed._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan


def test_scored_pairs_shuffle_no_titles(spark):
    pairs = spark.createDataFrame(
        [("s", "a", "b"), ("s", "b", None), ("t", "a", "b")], "subreddit string, title_win string, title_lose string"
    )
    bands = spark.createDataFrame(
        [("s", "a", 1.0), ("s", "b", 2.0), ("s", None, 3.0)], "subreddit string, title string, band double"
    )
    scored = evaluate.scored_pairs(pairs, bands)
    assert [tuple(r) for r in scored.collect()] == [("s", "a", "b", 1.0, 2.0)]
    read = evaluate.scored_pairs(pairs.hint("merge"), bands.hint("merge")).select("subreddit", "band_win", "band_lose")
    plan = read._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert moved and not any("title" in line for line in moved)


def test_titles_of_pairs_are_scored_once(spark):
    pairs = spark.createDataFrame([("s", "go", "stop")], "subreddit string, title_win string, title_lose string")
    bands = pair_study.title_bands(pairs, model(spark))
    plan = bands._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and {r.title for r in bands.collect()} == {"go", "stop"}


@pytest.mark.parametrize("analyzer", [None, "word"])
def test_pair_differences_move_titles_only(spark, analyzer):
    pairs = spark.createDataFrame([(1, "Go on 3", "stop?"), (2, "calm!", "go go")], "k long, title_a string, title_b string")
    community = F.lit("all")
    titles = features.pair_titles(pairs, ["k"], community).withColumn("id", F.col("k"))
    space = cut_lineage(features.fit_space(titles, 1, 100, analyzer))
    found = features.pair_differences(pairs, space, ["k"], community, analyzer)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and found.count() > 0


def test_letters_are_counted_once(spark):
    found = with_structural(spark.createDataFrame([("Go ON 3",)], "title string")).select("caps_ratio")
    assert found.first()[0] == pytest.approx(3 / 4)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[^\\p{L}]+") == 1
