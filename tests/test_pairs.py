import itertools
import random
import statistics

import pytest
from pyspark.sql import functions as F

from titlegauge.operators import noise, pairs

LINK = "sub string, nurl string, title string, score long, upvote_ratio double, num_comments long, id long, created_utc long"


def make_links(spark, seed, n=240):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        hot = i % 3 == 0
        nurl = "hot" if hot else f"u{rng.randrange(25)}"
        # The hot group is mostly copies of one title and score.
        title = "copy" if hot and rng.random() < 0.8 else f"t{rng.randrange(6)}"
        score = 7 if title == "copy" else rng.randrange(4)
        rows.append(("s", nurl, title, score, rng.randrange(100) / 100, rng.randrange(9), i,
                     1_700_000_000 + rng.randrange(40) * 3600))
    return rows, spark.createDataFrame(rows, LINK)


def by_group(rows):
    out = {}
    for r in rows:
        out.setdefault(r[:2], []).append(r)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
@pytest.mark.parametrize("cap", [1, 3, 10])
def test_repost_pairs_equal_brute_force(spark, seed, cap):
    rows, df = make_links(spark, seed)
    expected = set()
    for (sub, nurl), members in by_group(rows).items():
        ordered = sorted(members, key=lambda r: (-r[7], r[6]))
        combos = [(a, b) for a, b in itertools.combinations(ordered, 2)
                  if a[2] != b[2] and a[3] != b[3]]
        for a, b in combos[:cap]:
            w, lo = (a, b) if a[3] > b[3] else (b, a)
            expected.add((sub, nurl, w[2], w[3], lo[2], lo[3]))
    got = pairs.repost_pairs(df, cap).collect()
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)


@pytest.mark.parametrize("seed, plain, block", [(1, 5, 20), (2, 12, 7), (3, 0, 3), (4, 90, 20)])
def test_large_groups_are_pruned_in_parts(spark, seed, plain, block):
    _, df = make_links(spark, seed)
    whole = {tuple(r) for r in pairs.repost_pairs(df, 3, plain=10_000).collect()}
    assert {tuple(r) for r in pairs.repost_pairs(df, 3, plain, block).collect()} == whole


def test_posts_of_plain_groups_are_shuffled_once(spark):
    _, df = make_links(spark, 1)
    found = pairs.repost_pairs(df.filter("nurl != 'hot'"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_ten_of_fifteen(spark):
    rows = [("s", "u", f"t{i}", i, 0.5, 1, i, 100 - i) for i in range(6)]
    assert pairs.repost_pairs(spark.createDataFrame(rows, LINK)).count() == 10


def _hour_weekend(ts):
    return ts // 3600 % 24, (ts // 86400 + 3) % 7 >= 5


def brute_dual(rows):
    out = []
    for members in by_group(rows).values():
        for a, b in itertools.combinations(members, 2):
            if a[2] == b[2]:
                continue
            (ha, wa), (hb, wb) = _hour_weekend(a[7]), _hour_weekend(b[7])
            gap = min(abs(ha - hb), 24 - abs(ha - hb))
            out.append(((max(a[3], b[3]) + 1) / (min(a[3], b[3]) + 1), gap <= 3 and wa == wb))
    return out


def test_dual_pairs_and_their_noise(spark):
    rows, df = make_links(spark, 9)
    expected = brute_dual(rows)
    dual = pairs.dual_label_pairs(df)
    assert dual.agg(F.sum("n_pairs")).first()[0] == len(expected)
    got = noise.time_matched_noise(df).first()
    matched = [r for r, m in expected if m]
    assert (got.n_all, got.n_matched) == (len(expected), len(matched))
    assert got.median_all == pytest.approx(statistics.median(r for r, _ in expected))
    assert got.median_matched == pytest.approx(statistics.median(matched))


def test_balanced_pairs_alternate_and_agree_with_scores(spark):
    _, df = make_links(spark, 5)
    reposts = pairs.repost_pairs(df)
    got = pairs.balanced_pairs(
        reposts, ["subreddit", "nurl", "title_win", "score_win", "title_lose", "score_lose"]
    ).collect()
    ones = sum(r.y for r in got)
    assert abs(2 * ones - len(got)) <= 1
    for r in got:
        score_a = r.score_win if r.title_a == r.title_win else r.score_lose
        assert (r.y == 1) == (score_a == r.score_win)


def test_symmetric_examples(spark):
    df = spark.createDataFrame([("w", "l")], "title_win string, title_lose string")
    got = {tuple(r) for r in pairs.symmetric_examples(df).collect()}
    assert got == {("w", "l", 1), ("l", "w", 0)}


def test_ab_pairs_keep_first_test(spark):
    schema = "clickability_test_id long, eyecatcher_id string, headline string, impressions double, clicks double"
    rows = [
        (2, "x", "A", 1000.0, 10.0), (2, "x", "B", 1000.0, 5.0),
        (1, "y", "A", 1000.0, 9.0), (1, "y", " B ", 1000.0, 3.0),
        (1, "y", "C", 999.0, 100.0), (3, "x", None, 5000.0, 1.0), (4, None, "A", 5000.0, 1.0),
    ]
    got = pairs.ab_pairs(spark.createDataFrame(rows, schema)).collect()
    assert [(r.title_win, r.title_lose, r.group_id, r.ctr_lose) for r in got] == [
        ("A", "B", "1", 0.003)
    ]


def test_variation_uses_population_deviation(spark):
    rows = [("s", "u", "a", 1, 0.5, 1, 1, 0), ("s", "u", "b", 3, 0.5, 1, 2, 0)]
    got = noise.group_variation(spark.createDataFrame(rows, LINK)).first()
    assert got.cv_score == pytest.approx(1 / 3) and got.cv_ratio == 0.0


def test_viability_gate(spark):
    rows = [("all", f"u{i % 5}") for i in range(60)]
    df = spark.createDataFrame(rows, "k string, nurl string")
    assert pairs.viability(df, ["k"], "nurl").first().viable
    assert not pairs.viability(df.limit(59), ["k"], "nurl").first().viable


def test_blocks_of_a_hot_group_meet_in_small_cells(spark):
    """One group cut into blocks gives every pair once; a cell's rows fall with the block count."""
    from titlegauge.operators.joins import pairs_within

    rows = spark.range(400).selectExpr("'g' AS g", "id")

    def found(block_rows):
        return pairs_within(
            rows, ["g"], ["id"], lambda a, b: a("id") < b("id"),
            lambda a, b: [a("id").alias("x"), b("id").alias("y"), a("_a_block").alias("i"), b("_b_block").alias("j")],
            block_rows=block_rows,
        ).collect()

    whole, cut = found(1_000), found(50)
    assert sorted((r.x, r.y) for r in whole) == sorted((r.x, r.y) for r in cut) and len(cut) == 400 * 399 // 2
    cells = {}
    for r in cut:
        cells.setdefault((r.i, r.j), (set(), set()))
        cells[r.i, r.j][0].add(r.x)
        cells[r.i, r.j][1].add(r.y)
    assert len(cells) >= 60 and max(len(a) + len(b) for a, b in cells.values()) <= 2 * 80


def test_repost_pairs_are_made_in_the_row(spark):
    _, df = make_links(spark, 5)
    assert "Join" not in pairs.repost_pairs(df)._jdf.queryExecution().optimizedPlan().toString()


def test_links_clean_titles_and_urls_once_per_page_or_document(spark, small_dir):
    from titlegauge.operators import ingest
    from titlegauge.sources import fixtures

    per_post = ingest.external_links(fixtures.raw_links(spark, small_dir).drop("nurl", "clean"))
    got = fixtures.links(spark, small_dir)
    assert got.columns == per_post.columns
    assert got.exceptAll(per_post).isEmpty() and per_post.exceptAll(got).isEmpty()
