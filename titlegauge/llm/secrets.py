r"""Secrets: pattern matches, and words that look random to a pair of character Markov models.

DataFrame functions only. Positions follow from splitting a text by a pattern: the lengths of the
pieces between the matches and of the matches themselves add up to the matches' places.

Models: both give each character after its predecessor (digits, letters and one class for signs). One
is trained on all distinct values that the patterns match, the other on all other distinct long ordinary
words of the texts. A word's score is the mean log-likelihood ratio of its character pairs, random over ordinary.
The threshold lies above all but ``TAIL`` of the ordinary words, and at ``LEAST_THRESHOLD`` or more.

Candidates are all runs of key characters in every whole text that are long enough and mix digits
with letters. One is added if it scores above the threshold and overlaps no pattern match. Pattern
matches always stay.

Cases: null or empty text has no spans; very long texts are one row, whose work grows with its matches
times their root; spans that start together are ordered by kind as listed; repeated rows give repeated results; extra columns are not read; where there is nothing to learn, only pattern matches are
returned; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titlegauge.llm.common import id_and_text, written
from titlegauge.operators.ranking import exact_quantiles, interpolated

KINDS = ("assign", "access", "hex")
ADDED = "random"

# The three patterns, and the least length of an assigned value.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE_AT_LEAST = 6
# A run that is too short holds no shorter run that is long enough, so these have their length inside.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ORDINARY = r"[A-Za-z][A-Za-z_]{11,}"
TAIL = 0.001
LEAST_THRESHOLD = 0.5
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
N_CLASSES = len(ALPHABET) + 1
SPAN = "array<struct<start:int,end:int,kind:string,value:string>>"


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, where ``value`` is computed once however often ``use`` reads it."""
    return F.transform(F.array(value), use)[0]


def _chunks(values: Column) -> Column:
    """A non-empty array cut into about as many parts as a part has members."""
    width = F.ceil(F.sqrt(F.size(values))).cast("int")
    return F.transform(F.sequence(F.lit(1), F.size(values), width), lambda i: F.slice(values, i, width))


def _sums_before(sizes: Column) -> Column:
    """For each member the sum of those before it; for short arrays, as a step copies what it has."""
    first = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("before"))

    def step(state: Column, size: Column) -> Column:
        return F.struct(
            (state["sum"] + size).alias("sum"), F.concat(state["before"], F.array(state["sum"])).alias("before")
        )

    return F.aggregate(sizes, first, step, lambda state: state["before"])


def _total(sizes: Column) -> Column:
    return F.aggregate(sizes, F.lit(0), lambda sum_, size: sum_ + size)


def _starts(text: Column, pattern: str, whole: Column) -> Column:
    """Start of each match in code points. Sums run inside chunks and over chunks, so the work of a text
    with n matches is of order n * sqrt(n), not n * n."""
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    # The piece after the last match has no match beside it.
    pieces = F.filter(
        F.zip_with(gaps, F.transform(whole, F.char_length), _gap_and_size), lambda p: p["size"].isNotNull()
    )

    def placed(chunks: Column) -> Column:
        offsets = _sums_before(F.transform(chunks, lambda c: _total(F.transform(c, lambda p: p["gap"] + p["size"]))))

        def inside(chunk: Column, offset: Column) -> Column:
            before = _sums_before(F.transform(chunk, lambda p: p["gap"] + p["size"]))
            return F.zip_with(chunk, before, lambda p, sum_: offset + sum_ + p["gap"])

        return F.flatten(F.zip_with(chunks, offsets, inside))

    return _let(pieces, lambda p: _let(_chunks(p), placed))


def _gap_and_size(gap: Column, size: Column) -> Column:
    return F.struct(gap.alias("gap"), size.alias("size"))


def _spans(text: Column, pattern: str, whole: Column, value: Column, kind: str) -> Column:
    def span(start: Column, pair: Column) -> Column:
        return F.struct(
            start.alias("start"), (start + F.char_length(pair["whole"])).cast("int").alias("end"),
            F.lit(kind).alias("kind"), pair["value"].alias("value"),
        )

    pairs = F.arrays_zip(whole.alias("whole"), value.alias("value"))
    none = F.array().cast(SPAN)
    return F.when(F.size(whole) > 0, F.zip_with(_starts(text, pattern, whole), pairs, span)).otherwise(none)


def _plausible(value: Column) -> Column:
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]")


def _in_order(spans: Column) -> Column:
    """By start, then kind as listed."""

    def keyed(s: Column) -> Column:
        rank = F.coalesce(*[F.when(s["kind"] == k, F.lit(i)) for i, k in enumerate((*KINDS, ADDED))])
        return F.struct(s["start"], rank.alias("rank"), s["end"], s["kind"], s["value"])

    return F.transform(F.sort_array(F.transform(spans, keyed)), _without_rank)


def _without_rank(s: Column) -> Column:
    return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))


def matched(docs: DataFrame) -> DataFrame:
    """doc_id, base (the spans of the patterns) and maybe (the other candidates), for every text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select(
        "doc_id", text.alias("text"),
        _all(text, ASSIGN).alias("assign"), _all(text, ACCESS).alias("access"),
        _all(text, HEX).alias("hex"), _all(text, CANDIDATE).alias("candidate"),
    )
    body = F.col("text")
    assign = _spans(body, ASSIGN, F.col("assign"), _all(body, ASSIGN, 1), "assign")
    kept = F.filter(assign, lambda s: F.char_length(s["value"]) >= ASSIGN_VALUE_AT_LEAST)
    candidates = _spans(body, CANDIDATE, F.col("candidate"), F.col("candidate"), ADDED)
    placed = found.select(
        "doc_id",
        F.concat(
            kept,
            _spans(body, ACCESS, F.col("access"), F.col("access"), "access"),
            _spans(body, HEX, F.col("hex"), F.col("hex"), "hex"),
        ).alias("base"),
        F.when(F.exists("candidate", _plausible), F.filter(candidates, lambda s: _plausible(s["value"])))
        .otherwise(F.array().cast(SPAN))
        .alias("maybe"),
    )
    sorted_base = placed.select("doc_id", _in_order(F.col("base")).alias("base"), "maybe")
    apart = F.when((F.size("maybe") > 0) & (F.size("base") > 0), _apart(F.col("maybe"), F.col("base")))
    return sorted_base.select("doc_id", "base", F.coalesce(apart, F.col("maybe")).alias("maybe"))


def _apart(spans: Column, others: Column) -> Column:
    """The spans that overlap none of ``others`` (ordered by start); each looks at the chunks it can meet."""

    def bounded(chunk: Column) -> Column:
        ends = F.array_max(F.transform(chunk, lambda s: s["end"]))
        return F.struct(chunk[0]["start"].alias("start"), ends.alias("end"), chunk.alias("spans"))

    def meets(span: Column, other: Column) -> Column:
        return (other["start"] < span["end"]) & (span["start"] < other["end"])

    def free(chunks: Column) -> Column:
        return F.filter(
            spans, lambda m: ~F.exists(chunks, lambda c: meets(m, c) & F.exists(c["spans"], lambda o: meets(m, o)))
        )

    return _let(others, lambda o: _let(F.transform(_chunks(o), bounded), free))


def _classes(token: Column) -> Column:
    """Class of each character: its place in the alphabet from 1, or 0."""
    return F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))


def _pairs(classes: Column) -> Column:
    """Class pairs of neighbours as one number each."""
    return F.zip_with(
        F.slice(classes, F.lit(1), F.size(classes) - 1),
        F.slice(classes, F.lit(2), F.size(classes) - 1),
        lambda a, b: a * N_CLASSES + b,
    )


def _score(token: Column, ratios: list[float]) -> Column:
    """Mean log-likelihood ratio of the pairs of a token of two characters or more."""
    weights = F.array(*[F.lit(r) for r in ratios])
    pairs = _pairs(_classes(token))
    total = F.aggregate(pairs, F.lit(0.0), lambda sum_, pair: sum_ + F.get(weights, pair))
    return F.when(F.char_length(token) > 1, total / (F.char_length(token) - 1)).otherwise(F.lit(0.0))


def training_tokens(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(token, random): the distinct words of all texts; one that a pattern matched anywhere is random."""
    values = found.select(F.explode("base.value").alias("token"), F.lit(True).alias("random"))
    words = docs.select(
        F.explode(_all(F.coalesce(F.col("text"), F.lit("")), ORDINARY)).alias("token"), F.lit(False).alias("random")
    )
    tokens = values.unionByName(words).filter(F.char_length("token") > 1)
    return tokens.groupBy("token").agg(F.max("random").alias("random"))


def fit(tokens: DataFrame) -> tuple[list[float], float] | None:
    """(log-likelihood ratio of each class pair, threshold); None without samples of both kinds."""
    counted = (
        tokens.select("random", F.explode(_pairs(_classes(F.col("token")))).alias("pair"))
        .groupBy("random", "pair")
        .agg(F.count("*").alias("n"))
        .collect()  # at most two rows per class pair
    )
    if {r["random"] for r in counted} != {True, False}:
        return None
    likelihood = {}
    for kind in (True, False):
        n = [0.5] * (N_CLASSES * N_CLASSES)
        for r in counted:
            if r["random"] == kind:
                n[r["pair"]] += r["n"]
        sums = [sum(n[a * N_CLASSES : (a + 1) * N_CLASSES]) for a in range(N_CLASSES)]
        likelihood[kind] = [log(n[i] / sums[i // N_CLASSES]) for i in range(len(n))]
    ratios = [r - o for r, o in zip(likelihood[True], likelihood[False], strict=True)]
    scored = tokens.filter("not random").select(_score(F.col("token"), ratios).alias("score"))
    tail = exact_quantiles(scored.withColumn("all", F.lit(1)), ["all"], "score", {"q": interpolated(1 - TAIL)}).first()["q"]
    return ratios, max(LEAST_THRESHOLD, tail)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans: start, end (code points, end exclusive), kind, value; added ones are ``random``."""
    docs = id_and_text(docs, id_col, text_col)
    found = written(matched(docs))
    model = fit(written(training_tokens(docs, found)))
    if model is None:
        return found.select("doc_id", F.col("base").alias("spans"))
    ratios, threshold = model
    added = F.filter("maybe", lambda s: _score(s["value"], ratios) > threshold)
    with_added = F.when(F.size("maybe") > 0, _in_order(F.concat("base", added))).otherwise(F.col("base"))
    return found.select("doc_id", with_added.alias("spans"))


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def contract_spans(docs: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["kind"] != ADDED)
    return find_secrets(docs).select(
        "doc_id",
        *[_count(kind) for kind in KINDS],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )
