import math

from pyspark.sql import functions as F

from titlegauge.functions import text, urls, values


def one(spark, expression, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v"))).first()[0]


def test_clean_title(spark):
    for raw, expected in [
        ("  a \t b  c \n", "a b c"), ("[deleted]", None), (" [removed] ", None),
        ("", None), (None, None), ("　", None),
    ]:
        assert one(spark, text.clean_title, raw) == expected


def structure(spark, title):
    df = spark.createDataFrame([(title,)], "title string")
    return text.with_structural(df).select(*text.STRUCTURAL_NAMES).first().asDict()


def test_structural_features_of_empty_titles(spark):
    assert set(structure(spark, "").values()) == {0.0}
    assert set(structure(spark, None).values()) == {0.0}
    blank = structure(spark, "   ")
    assert (blank["n_chars"], blank["n_words"], blank["avg_word_len"]) == (3.0, 0.0, 0.0)


def test_structural_features(spark):
    assert structure(spark, '"WHY?" she said')["starts_wh"] == 1.0
    assert structure(spark, "'What' now")["starts_wh"] == 1.0
    assert structure(spark, "somewhat odd")["starts_wh"] == 0.0
    row = structure(spark, "Été 12 Ok!")
    assert row["n_words"] == 3.0 and row["n_chars"] == 10.0
    assert math.isclose(row["avg_word_len"], 10 / 3)
    assert row["caps_ratio"] == 2 / 5 and row["has_number"] == 1.0 and row["has_exclaim"] == 1.0


def terms(spark, title, analyzer="word"):
    df = spark.createDataFrame([(title,)], "title string")
    return {t.feature: t.tf for t in text.with_term_counts(df, "title", analyzer).first()["terms"]}


def test_words_and_bigrams(spark):
    assert terms(spark, "Été à la x ab") == {
        "été": 1, "la": 1, "ab": 1, "été la": 1, "la ab": 1,
    }
    assert terms(spark, "go go GO") == {"go": 3, "go go": 2}
    assert terms(spark, "a b") == {} and terms(spark, None) == {}


def brute_char_grams(title, low=3, high=5):
    out = {}
    for word in title.lower().split():
        padded = f" {word} "
        for n in range(low, high + 1):
            for start in range(len(padded) - n + 1):
                gram = padded[start:start + n]
                out[gram] = out.get(gram, 0) + 1
    return out


def test_char_grams(spark):
    for title in ("a bc Defgh", "aaaa aaaa", "x"):
        assert terms(spark, title, "char") == brute_char_grams(title)


def test_norm_url(spark):
    cases = {
        "HTTPS://www.Ex.com:80/A/?b=2&utm_x=1&a=1&c=#f": "ex.com:80/A?a=1&b=2",
        "https://i.redd.it/x": None,
        "example.com/x": None,
        "//ex.com/p//": "ex.com/p",
        "https://ex.com/w?v=a%20b+%zz~*&t=3": "ex.com/w?v=a+b+%25zz~%2A",
        "https://ex.com": "ex.com",
        " https://ex.com/a?REF=1&q=1=2&q=0 ": "ex.com/a?q=0&q=1%3D2",
    }
    for url, expected in cases.items():
        assert one(spark, urls.norm_url, url) == expected


def test_whole_numbers(spark):
    for raw, expected in [
        ("12", 12), (" -3 ", -3), ("12.7", None), ("1e3", None), ("", None), (None, None),
        ("99999999999999999999", None),
    ]:
        df = spark.createDataFrame([(raw,)], "x string")
        assert df.select(values.whole_number(df, "x")).first()[0] == expected
    for raw, expected in [(12.0, 12), (12.7, 12), (-3.9, -3), (None, None), (float("nan"), None), (1e300, None)]:
        df = spark.createDataFrame([(raw,)], "x double")
        assert df.select(values.whole_number(df, "x")).first()[0] == expected
    df = spark.createDataFrame([(7,)], "x int")
    assert df.select(values.whole_number(df, "x")).first()[0] == 7


def test_hours_and_weekends(spark):
    df = spark.createDataFrame([(23, False, 1, False), (23, False, 1, True), (0, True, 4, True)],
                               "h1 int, w1 boolean, h2 int, w2 boolean")
    got = df.select(
        values.hour_distance(F.col("h1"), F.col("h2")),
        values.time_matched(F.col("h1"), F.col("w1"), F.col("h2"), F.col("w2")),
    ).collect()
    assert [tuple(r) for r in got] == [(2, True), (2, False), (4, False)]


def test_verdicts(spark):
    for band, expected in [(75.0, "strong"), (74.9, "above average"), (50.0, "above average"),
                           (25.0, "below average"), (24.9, "weak")]:
        assert one(spark, values.verdict, band, "double") == expected


def test_gaps_of_every_kind_are_found(spark):
    spaces = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2005\u200a\u2028\u2029\u202f\u205f\u3000"
    others = "\x00\x1b\x7f\x84\x86\xa1\u167f\u1681\u1fff\u200b\u2027\u202a\u202e\u2030\u205e\u2060\u2fff\u3001\uffff\U0001f600\U0010ffff"
    rows = [(f"a{c}b", "a b") for c in spaces] + [(f"a {c} b{c}", "a b") for c in spaces]
    rows += [(f"a{c}b", f"a{c}b") for c in others] + [("  a  b c ", "a b c"), ("a b", "a b"), ("", ""), (None, None)]
    df = spark.createDataFrame(rows, "t string, want string")
    assert [(r.t, r.got) for r in df.select("t", text.collapse_spaces(F.col("t")).alias("got")).collect()] == rows
