import math
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from titlegauge.operators import ingest
from titlegauge.plans import catalog
from titlegauge.plans.ingest import ingest_historical, ingest_recent
from titlegauge.sources import fixtures, model_store, tables

RAW = "id string, title string, subreddit string, score string, num_comments string, created_utc string"


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="titlegauge-test-")


def test_clean_posts_policies(spark):
    rows = [
        ("1", " a  b ", "s", "3", "x", "1700000000"), ("2", "[removed]", "s", "3", "1", "1"),
        ("3", "c", "s", "n/a", "1", "1"), ("4", "d", "s", "0", "1", "1"),
        ("5", "e", "s", "2", None, "bad"), ("6", None, "s", "2", "1", "1"),
    ]
    raw = spark.createDataFrame(rows, RAW)
    recent = ingest.clean_posts(raw).collect()
    assert [(r.id, r.title, r.score, r.num_comments, r.year) for r in recent] == [
        ("1", "a b", 3, 0, 2023)
    ]
    old = {r.id: r for r in ingest.clean_posts(raw, bad_time="zero").collect()}
    assert set(old) == {"1", "5"} and old["5"].year == 0 and old["5"].created_utc is None
    with pytest.raises(ValueError):
        ingest.clean_posts(raw, bad_time="other")


def test_a_title_is_cleaned_once(spark):
    raw = spark.createDataFrame([("1", " a  b ", "s", "3", "x", "1700000000")], RAW)
    plan = ingest.clean_posts(raw)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1


def test_quota_limits_hold_and_nothing_eligible_is_lost(spark):
    rng = random.Random(1)
    rows = [
        (i, "hot" if i % 3 else f"s{rng.randrange(3)}", f"2020-0{rng.randrange(1, 5)}", i)
        for i in range(600)
    ]
    df = spark.createDataFrame(rows, "id long, subreddit string, month string, created_utc long")
    got = ingest.two_level_quota(df, per_community=50, n_files=4).collect()
    expected = set()
    for sub in {r[1] for r in rows}:
        kept = []
        for month in sorted({r[2] for r in rows}):
            kept += [r[0] for r in rows if r[1] == sub and r[2] == month][: math.ceil(50 / 4)]
        expected |= set(kept[:50])
    assert {r.id for r in got} == expected


def test_scan_bound(spark):
    df = spark.range(100).select(
        "id", (F.col("id") % 3).cast("string").alias("month"), (-F.col("id")).alias("file_order")
    )
    got = ingest.scan_bound(df, 10, "file_order").collect()
    assert len(got) == 30 and min(r.id for r in got) == 70
    assert ingest.scan_bound(df, 1000, "file_order").count() == 100


def test_strided_months(spark):
    df = spark.createDataFrame([(m,) for m in ("b", "a", "d", "c", "e", "a")], "month string")
    assert sorted(r.month for r in ingest.strided_months(df, 2).collect()) == ["a", "c", "e"]


def test_self_posts_and_skipped_hosts_go(spark):
    rows = [
        (1, "s", "https://a.com/x?utm_a=1", "t", "3", False), (2, "s", "https://i.redd.it/x", "t", "3", False),
        (3, "s", "https://a.com/x", "t", "3", True), (4, "s", "https://a.com/x/", "t", "3", None),
    ]
    raw = spark.createDataFrame(
        rows, "id long, sub string, url string, title string, score string, is_self boolean"
    ).withColumns({"upvote_ratio": F.lit(0.5), "num_comments": F.lit(1), "created_utc": F.lit(1)})
    got = ingest.external_links(raw).collect()
    assert {r.id: r.nurl for r in got} == {1: "a.com/x", 4: "a.com/x"}


def test_csv_with_line_breaks_and_quotes(spark, folder):
    rows = [("1", "e", 'He said "go"\nnow, ok', 1000.0, 5.0)]
    df = spark.createDataFrame(rows, tables.AB_SCHEMA)
    tables.write_csv(df, f"{folder}/ab")
    assert [tuple(r) for r in tables.read_ab_csv(spark, f"{folder}/ab").collect()] == rows


def test_json_pull_keeps_bad_numbers_as_text(spark, folder):
    spark.createDataFrame([('{"id":"x1","title":"t","score":"n/a","created_utc":5}',)], "v string") \
        .write.text(f"{folder}/pull")
    row = tables.read_raw_posts_json(spark, f"{folder}/pull").first()
    assert (row.id, row.score, row.created_utc, row.num_comments) == ("x1", "n/a", "5", None)


def test_model_store_prunes_to_the_wanted_communities(spark, folder):
    model = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "subreddit string, coef double")
    model_store.write_models(folder, model, model, model)
    stored = model_store.read_models(spark, folder, ["a"])
    assert [r.coef for r in stored["model"].collect()] == [1.0]
    plan = stored["model"]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(subreddit" in plan or "PartitionFilters: [subreddit" in plan


def test_ingest_plans_write_and_profile(spark, small_dir, folder):
    raw = fixtures.raw_posts(spark, small_dir)
    recent = ingest_recent(raw, catalog.WANTED, f"{folder}/recent", per_community=20)
    assert recent["summary"].first().n_communities == len(catalog.WANTED)
    assert max(r.n_rows for r in recent["communities"].collect()) <= 20
    old = ingest_historical(raw, catalog.WANTED, f"{folder}/old", per_community=40, rows_per_month=50)
    assert old["posts"].count() > 0 and old["sample"].count() <= 5
