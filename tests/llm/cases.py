"""Odd inputs that every operator has to take, and small invented texts."""

from __future__ import annotations

import random

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ", size long, kept string, component_id string, row long, spans string, score string, k1 string"


def prose(seed: int, n_words: int) -> str:
    rng = random.Random(seed)
    parts = ["ba", "ke", "li", "mo", "nu", "ra", "se", "ti", "vo", "za", "the", "and", "in"]
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(n_words))


def odd_rows() -> list[tuple]:
    same = prose(1, 60)
    return [
        (1, same, "en", "a", 1),
        (1, same, "en", "a", 1),  # a repeated row
        (2, same, "en", "b", 1),  # a copy
        (3, None, "en", "a", None),
        (4, "", None, None, 0),
        (None, prose(2, 40), "de", "a", 5),
        (None, None, None, None, None),
        (5, "  \n\t ", "fr", "c", 5),
        (6, "one", "en", "c", 3),
        (7, prose(3, 30_000), "en", "b", 9),  # a very long text
        (8, "Été\n\n" + prose(4, 30) + "\nÉté\n" + "x" * 700, "es", "a", 9),
        (9, prose(5, 25) + " " + same, "en", "a", 1),
    ]


def odd_documents(spark):
    """The odd rows, with extra columns whose names operators use themselves."""
    rows = [(*r, 7, "x", "x", 7, "x", "x", "x") for r in odd_rows()]
    return spark.createDataFrame(rows, DOCUMENTS + CLASHING)


def documents(spark, texts: dict[int, str | None], source: str = "s"):
    rows = [(i, t, "en", source, len(t or "")) for i, t in texts.items()]
    return spark.createDataFrame(rows, DOCUMENTS)


def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)
