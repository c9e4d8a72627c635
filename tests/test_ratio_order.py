import random
import statistics

import pytest
from pyspark.sql import functions as F

from titlegauge.operators import noise
from titlegauge.operators import ratio_order as m

CELLS = "g string, t string, x double, time_class int, n long"


def _near(a, b):
    if a < 0 or b < 0 or a // 24 != b // 24:
        return False
    gap = abs(a % 24 - b % 24)
    return min(gap, 24 - gap) <= 3


def _brute(rows):
    """Ratios of the pairs of posts that share g and differ in t, all and time-matched."""
    posts = [r[:4] for r in rows for _ in range(r[4])]
    pairs = [
        (max(a[2], b[2]) / min(a[2], b[2]), _near(a[3], b[3]))
        for i, a in enumerate(posts) for b in posts[i + 1 :] if a[0] == b[0] and a[1] != b[1]
    ]
    return [r for r, _ in pairs], [r for r, near in pairs if near]


def _rows(seed):
    rng = random.Random(seed)
    hot = [("hot", f"t{rng.randrange(60)}", rng.randrange(1, 90) / rng.choice([1, 3]), rng.randrange(-1, 48), 1 + rng.randrange(2)) for _ in range(250)]
    small = [(rng.choice("abcd"), rng.choice("uv"), float(rng.randrange(1, 5)), rng.randrange(48), 1) for _ in range(60)]
    return hot + small


def _medians(spark, rows):
    df = spark.createDataFrame(rows, CELLS).groupBy("g", "t", "x", "time_class").agg(F.sum("n").alias("n"))
    merged = df.groupBy("g", "x", "time_class").agg(F.sum("n").alias("n"))
    return m.PairRatios([(merged, ["g"], 1), (df, ["g", "t"], -1)]).medians()


@pytest.mark.parametrize("block", [100_000, 30], ids=["whole groups", "blocks"])
def test_medians_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(m, "BLOCK_ROWS", block)
    rows = _rows(4)
    got, (every, near) = _medians(spark, rows), _brute(rows)
    assert got == {False: (len(every), statistics.median(every)), True: (len(near), statistics.median(near))}


def test_no_pairs_and_one_pair(spark):
    assert _medians(spark, [("a", "u", 3.0, 1, 5)]) == {False: (0, None), True: (0, None)}
    assert _medians(spark, [("a", "u", 3.0, 1, 1), ("a", "v", 7.0, -1, 1)]) == {False: (1, 7 / 3), True: (0, None)}
    assert _medians(spark, [("a", "u", 3.0, 1, 2), ("a", "v", 3.0, 4, 1)]) == {False: (2, 1.0), True: (2, 1.0)}


def test_noise_of_an_empty_table(spark):
    schema = "sub string, nurl string, title string, score long, upvote_ratio double, num_comments long, created_utc long, id string"
    row = noise.time_matched_noise(spark.createDataFrame([], schema)).first()
    assert (row.n_all, row.median_all, row.n_matched, row.median_matched) == (0, None, 0, None)


@pytest.mark.parametrize("few", [256, 20, 0], ids=["pairs", "some swept", "most swept"])
def test_small_groups_pair_by_pair_give_the_same(spark, monkeypatch, few):
    monkeypatch.setattr(m, "PAIR_ROWS", few)
    rows = _rows(6)
    got, (every, near) = _medians(spark, rows), _brute(rows)
    assert got == {False: (len(every), statistics.median(every)), True: (len(near), statistics.median(near))}


def test_small_groups_need_few_passes(spark, monkeypatch):
    passes, counts = [], m.PairRatios.counts
    monkeypatch.setattr(m.PairRatios, "counts", lambda self, bounds: passes.append(1) or counts(self, bounds))
    rows = [(f"g{i % 9}", f"t{i}", 1.0 + i * i % 97, i % 48, 1) for i in range(90)]
    assert _medians(spark, rows)[False] == (len(_brute(rows)[0]), statistics.median(_brute(rows)[0]))
    assert len(passes) <= 7
