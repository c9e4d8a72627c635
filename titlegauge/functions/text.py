"""Title text as Column expressions: cleaning, structure, tokens, n-grams, term counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
REMOVED_TITLES = ["[deleted]", "[removed]", ""]
QUESTION_WORDS = ["what", "why", "how", "when", "where", "who", "which", "whose", "whom"]
OPENER_PUNCTUATION = "?.!,\"'"
STRUCTURAL_NAMES = [
    "n_words", "n_chars", "avg_word_len", "has_number",
    "has_question", "has_exclaim", "caps_ratio", "starts_wh",
]

# Java regex syntax. White space other than the plain space; runs that are not one plain space
# (most gaps are, so most text is left untouched); word runs of two or more characters.
OTHER_SPACE = r"\t\n\x0b\f\r\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
IRREGULAR_GAP = rf" *[{OTHER_SPACE}][ {OTHER_SPACE}]*| {{2,}}"
# Some character outside these ranges of what is no such white space: found faster than a gap, and
# where there is none, two plain spaces are the only gap.
GAP_SUSPECT = r"[^\x20-\x7e\u00a1-\u167f\u1681-\u1fff\u200b-\u2027\u202a-\u202e\u2030-\u205e\u2060-\u2fff\u3001-\x{10ffff}]"
WORD_RUN = r"[\p{L}\p{N}_]{2,}"
# Lengths of the character n-grams.
GRAM_SIZES = (3, 4, 5)


def collapse_spaces(text: Column) -> Column:
    suspect = text.contains("  ") | text.rlike(GAP_SUSPECT)
    return F.trim(F.when(suspect, F.regexp_replace(text, IRREGULAR_GAP, " ")).otherwise(text))


def strip_spaces(text: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(text, rf"^[ {OTHER_SPACE}]+|[ {OTHER_SPACE}]+$", "")


def clean_title(text: Column) -> Column:
    """White-space runs become one space; removed or empty titles become null."""
    # In an array, as a condition and a value would each go through the text.
    return F.get(F.filter(F.array(collapse_spaces(text)), lambda title: ~title.isin(REMOVED_TITLES)), F.lit(0))


def _letters(raw: Column) -> Column:
    return F.length(F.regexp_replace(raw, r"[^\p{L}]+", ""))


def structural(text: Column, flat: Column | None = None, letters: Column | None = None) -> dict[str, Column]:
    """The eight structural signals, in the order of STRUCTURAL_NAMES.

    ``flat``: the text with collapsed white space, ``letters``: its letters, where they already exist
    as columns.
    """
    raw = F.coalesce(text, F.lit(""))
    flat = collapse_spaces(raw) if flat is None else flat
    spaces = F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit("")))
    words = F.when(flat == "", F.lit(0)).otherwise(spaces + 1).cast("double")
    chars = F.length(raw).cast("double")
    letters = _letters(raw) if letters is None else letters
    capitals = F.length(F.regexp_replace(raw, r"[^\p{Lu}]+", ""))
    opener = F.btrim(F.lower(F.substring_index(flat, " ", 1)), F.lit(OPENER_PUNCTUATION))

    def flag(condition: Column) -> Column:
        return condition.cast("double")

    return {
        "n_words": words,
        "n_chars": chars,
        "avg_word_len": F.when(words > 0, chars / words).otherwise(0.0),
        "has_number": flag(raw.rlike(r"\p{Nd}")),
        "has_question": flag(raw.contains("?")),
        "has_exclaim": flag(raw.contains("!")),
        "caps_ratio": F.when(letters > 0, capitals / letters).otherwise(0.0),
        "starts_wh": flag(opener.isin(QUESTION_WORDS)),
    }


def with_structural(df: DataFrame, text: str = "title") -> DataFrame:
    raw = F.coalesce(F.col(text), F.lit(""))
    # Columns first, as a condition and a value would each go through the text.
    staged = df.withColumns({"_flat": collapse_spaces(raw), "_letters": _letters(raw)})
    return staged.withColumns(structural(F.col(text), F.col("_flat"), F.col("_letters"))).drop("_flat", "_letters")


def words(text: Column) -> Column:
    """Lower-cased word tokens of at least two characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD_RUN), F.lit(0))


def bigrams(tokens: Column) -> Column:
    pairs = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.zip_with(
        F.slice(tokens, F.lit(1), pairs),
        F.slice(tokens, F.lit(2), pairs),
        lambda left, right: F.concat_ws(" ", left, right),
    )


def spaced_words(text: Column) -> Column:
    """Lower-cased parts of the text between white space."""
    parts = F.split(collapse_spaces(F.lower(F.coalesce(text, F.lit("")))), " ")
    return F.filter(parts, lambda word: word != "")


def word_boundary_grams(text: Column, low: int = GRAM_SIZES[0], high: int = GRAM_SIZES[-1]) -> Column:
    """Character n-grams inside each space-padded word."""
    padded = F.transform(spaced_words(text), lambda word: F.concat(F.lit(" "), word, F.lit(" ")))

    def grams(word: Column) -> Column:
        return F.flatten(
            F.transform(
                F.sequence(F.lit(low), F.least(F.lit(high), F.length(word))),
                lambda n: F.transform(
                    F.sequence(F.lit(1), F.length(word) - n + 1),
                    lambda start: F.substring(word, start, n),
                ),
            )
        )

    return F.flatten(F.transform(padded, grams))


def with_term_counts(
    df: DataFrame, text: str = "title", analyzer: str = "word", out: str = "terms"
) -> DataFrame:
    """Add ``out``: array<struct<feature, tf>> with one entry per distinct term of the row.

    Counting happens inside the row (sort, then run lengths), so no token is shuffled. Each step
    is its own projection because the later ones read the earlier array many times.
    ``analyzer``: word = words and bigrams, char = word-boundary character n-grams.
    """
    if analyzer == "word":
        staged = df.withColumn("_words", words(F.col(text)))
        terms = F.concat(F.col("_words"), bigrams(F.col("_words")))
    elif analyzer == "char":
        staged, terms = df, word_boundary_grams(F.col(text))
    else:
        raise ValueError(f"unknown analyzer {analyzer!r}")
    staged = staged.withColumn("_sorted", F.sort_array(terms))
    size = F.size("_sorted")
    run_starts = F.filter(
        F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))),
        lambda i: (size > 0)
        & ((i == 0) | (F.get(F.col("_sorted"), i) != F.get(F.col("_sorted"), i - 1))),
    )
    staged = staged.withColumn("_starts", run_starts)
    ends = F.concat(
        F.slice(F.col("_starts"), F.lit(2), F.greatest(F.size("_starts") - 1, F.lit(0))),
        F.when(F.size("_starts") > 0, F.array(size)).otherwise(F.array().cast("array<int>")),
    )
    counted = F.zip_with(
        F.col("_starts"),
        ends,
        lambda start, end: F.struct(
            F.get(F.col("_sorted"), start).alias("feature"), (end - start).alias("tf")
        ),
    )
    return staged.withColumn(out, counted).drop("_words", "_sorted", "_starts")
