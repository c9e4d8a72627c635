"""Exact ranks and quantiles against brute force, with one key holding a third of the rows."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from titlegauge.operators import ranking
from titlegauge.operators.joins import lookup_join, pairs_within


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for i in range(900):
        key = "hot" if i % 3 == 0 else f"k{rng.randrange(20)}"
        out.append((i, key, rng.choice([1.0, 1.0, 2.5, -3.0, float(rng.randrange(200))])))
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, k string, v double").cache()


def groups(rows):
    out = {}
    for i, k, v in rows:
        out.setdefault(k, []).append((i, v))
    return out


def test_first_n_salted(frame, rows):
    order = [F.col("v").desc(), F.col("id")]
    for salts in (1, 4):
        got = ranking.first_n(frame, ["k"], order, 7, salts).collect()
        for key, members in groups(rows).items():
            expected = sorted(members, key=lambda m: (-m[1], m[0]))[:7]
            assert sorted(r.id for r in got if r.k == key) == sorted(m[0] for m in expected)


def test_exact_quantiles(frame, rows):
    wanted = {"med": ranking.interpolated(0.5), "p90": ranking.interpolated(0.9),
              "up": ranking.upper_median()}
    got = {r.k: r for r in ranking.exact_quantiles(frame, ["k"], "v", wanted).collect()}
    for key, members in groups(rows).items():
        values = sorted(v for _, v in members)
        assert got[key].med == pytest.approx(statistics.median(values))
        assert got[key].p90 == pytest.approx(np.quantile(values, 0.9))
        assert got[key].up == values[len(values) // 2]


def test_weighted_quantile_equals_repeated_rows(spark):
    df = spark.createDataFrame([(1.0, 3), (5.0, 1), (9.0, 4)], "v double, w long")
    got = ranking.exact_quantiles(df, [], "v", {"m": ranking.interpolated(0.5)}, "w").first().m
    assert got == statistics.median([1, 1, 1, 5, 9, 9, 9, 9])


def test_average_ranks(frame, rows):
    got = {(r.k, r.v): r.r for r in ranking.average_ranks(frame, ["k"], "v", "r").collect()}
    for key, members in groups(rows).items():
        values = [v for _, v in members]
        for v in set(values):
            below = sum(x < v for x in values)
            assert got[key, v] == below + (values.count(v) + 1) / 2


def test_mark_lowest(frame, rows):
    got = ranking.mark_lowest(frame, ["k"], "v", "id", lambda n: F.floor(n * 0.3), "low").collect()
    chosen = {r.id for r in got if r.low}
    assert len(got) == len(rows)
    for members in groups(rows).values():
        expected = sorted(members, key=lambda m: (m[1], m[0]))[: int(len(members) * 0.3)]
        assert {m[0] for m in expected} == chosen & {m[0] for m in members}


def test_mark_lowest_whole_table(frame, rows):
    got = ranking.mark_lowest(frame, [], "v", "id", lambda n: F.lit(100), "low").collect()
    expected = sorted(rows, key=lambda m: (m[2], m[0]))[:100]
    assert {r.id for r in got if r.low} == {m[0] for m in expected}


def test_ordinal_rank(frame, rows):
    got = {r.id: r.r for r in ranking.ordinal_rank(frame, ["k"], "v", "id", "r").collect()}
    for members in groups(rows).values():
        for place, (i, _) in enumerate(sorted(members, key=lambda m: (m[1], m[0])), 1):
            assert got[i] == place


def test_global_index_is_dense(frame):
    order = F.pmod(F.xxhash64("id"), F.lit(1 << 32))
    got = ranking.global_index(frame, order, ["id"], "at", buckets=16).collect()
    assert sorted(r["at"] for r in got) == list(range(len(got)))


def test_buckets_keep_order(spark):
    values = [-1e18, -5.0, -0.5, 0.0, 1e-9, 0.5, 1.0, 1.0001, 3.0, 1e6, 1e15, 1e300]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.orderBy("v").select(ranking.order_bucket(F.col("v"))).collect()]
    assert got == sorted(got)


def test_lookup_join_salted_equals_broadcast(spark, frame):
    table = frame.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    plain = lookup_join(frame, table, ["k"]).collect()
    salted = lookup_join(frame, table, ["k"], broadcast_rows=0, salts=5).collect()
    assert sorted(map(tuple, plain)) == sorted(map(tuple, salted)) and len(plain) == 900


def test_lookup_join_keeps_unmatched_facts(spark, frame):
    table = frame.filter("k = 'hot'").select("k").distinct().withColumn("n", F.lit(1))
    for limit in (10, 0):
        got = lookup_join(frame, table, ["k"], how="left", broadcast_rows=limit, salts=3)
        assert got.count() == 900 and got.filter("n = 1").count() == 300


def test_pairs_of_a_split_group(frame, rows):
    def newer(a, b):
        return (a("id") < b("id")) & (a("v") != b("v"))

    def sides(a, b):
        return [a("id").alias("x"), b("id").alias("y")]

    expected = {
        (i, j) for members in groups(rows).values() for i, v in members for j, w in members
        if i < j and v != w
    }
    for block in (17, 10_000):
        got = pairs_within(frame, ["k"], ["id"], newer, sides, block_rows=block).collect()
        assert len(got) == len(expected) and {tuple(r) for r in got} == expected


def test_texts_with_a_common_prefix_fall_into_many_buckets(spark):
    values = [("g", f"shared/prefix/{i:05d}", i) for i in range(3000)] + [("h", "one", 1), ("h", None, 2)]
    frame = spark.createDataFrame(values, "k string, t string, n long").repartition(6)
    staged = ranking.with_bucket(frame, ["k"], "t", "bucket")
    sizes = {r.bucket: r["count"] for r in staged.filter("k = 'g'").groupBy("bucket").count().collect()}
    assert len(sizes) >= ranking.SPLITTERS and max(sizes.values()) < 3000 / 20
    counted = ranking.cumulative_counts(ranking.value_counts(frame, ["k"], "t"), ["k"], "t")
    got = {r.t: r.below for r in counted.filter("k = 'g'").collect()}
    assert got == {t: i for k, t, i in values if k == "g"}
    numbered = ranking.ordinal_rank(frame.filter("k = 'g'").withColumn("v", F.lit(1.0)), ["k"], "v", "t", "r")
    assert {r.t: r.r for r in numbered.collect()} == {t: i + 1 for k, t, i in values if k == "g"}
