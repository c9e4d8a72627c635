"""Term counts folded over many titles at once, so that a term of a title is never a row.

Spark cuts titles to words and sums what the tasks find; a task counts the terms of a stretch of titles
as numbers (Arrow dictionaries) and gives one row per community and term of the stretch.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from titlegauge.functions.text import GRAM_SIZES, spaced_words, words
from titlegauge.session import let_workers_import

#: Words whose terms a task holds at once; a longer title is a step of its own.
STEP_WORDS = 200_000


def folded_terms(
    posts: DataFrame, analyzer: str = "word", weight: str | None = None, means: Sequence[str] = ()
) -> DataFrame:
    """(subreddit, feature, tf, df, and per column of ``means`` sum_0, n_0, ...): partial sums per term.

    ``tf``: occurrences, ``df``: titles, a row with a ``weight`` counting as that many (without one if
    null); ``sum_i``: the column's total over the titles that hold the term, ``n_i``: titles where it is
    known. A term has a row per stretch of titles; their sums are the totals.
    """
    let_workers_import(posts.sparkSession)
    if analyzer not in ("word", "char"):
        raise ValueError(f"unknown analyzer {analyzer!r}")
    cut = words(F.col("title")) if analyzer == "word" else spaced_words(F.col("title"))
    whole = weight is None or isinstance(posts.schema[weight].dataType, T.IntegralType)
    count = "long" if whole else "double"
    times = (F.col(weight) if weight else F.lit(1)).cast(count)
    asked = posts.select(
        "subreddit", times.alias("times"), cut.alias("words"),
        *[F.col(name).cast("double").alias(f"mean_{i}") for i, name in enumerate(means)],
    ).filter("times is not null")
    sums = "".join(f", sum_{i} double, n_{i} {count}" for i in range(len(means)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _steps(batch):
                yield from _folded(part, analyzer, len(means)).to_batches()

    return asked.mapInArrow(run, f"subreddit string, feature string, tf {count}, df {count}{sums}")


def _steps(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    ends = np.cumsum(pc.list_value_length(batch["words"]).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < batch.num_rows:
        limit = (ends[begin - 1] if begin else 0) + STEP_WORDS
        end = max(begin + 1, int(np.searchsorted(ends, limit, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def _word_terms(title: np.ndarray, word: np.ndarray, known: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words and pairs of neighbours: (title, term) of each, and the terms."""
    inside = title[1:] == title[:-1]
    size = max(len(known), 1)
    pairs = pa.array((word[:-1] * size + word[1:])[inside]).dictionary_encode()
    first, second = np.divmod(pairs.dictionary.to_numpy(), size)
    names = pc.binary_join_element_wise(known.take(pa.array(first)), known.take(pa.array(second)), " ")
    terms = np.concatenate([word, len(known) + pairs.indices.to_numpy().astype(np.int64)])
    return np.concatenate([title, title[:-1][inside]]), terms, pa.concat_arrays([known, names])


def _char_terms(title: np.ndarray, word: np.ndarray, known: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Character n-grams of the words, each between two spaces; a word is cut once per step.

    A gram's number is that of the gram without its last character and of that character, so any
    alphabet will do; only different grams become texts.
    """
    padded = [f" {text} " for text in known.to_pylist()]
    size = np.array([len(text) for text in padded], np.int64)
    joined = "".join(padded)
    letters = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(letters))
    place = np.arange(len(letters))
    number, names, starts, numbers = letters, [], [], []
    for n in range(2, GRAM_SIZES[-1] + 1):
        whole = left[place] >= n
        place, number = place[whole], number[whole]
        encoded = pa.array((number << 21) | letters[place + n - 1]).dictionary_encode()
        number = encoded.indices.to_numpy().astype(np.int64)
        if n in GRAM_SIZES:
            first = np.zeros(len(encoded.dictionary), np.int64)
            first[number[::-1]] = place[::-1]
            numbers.append(number + len(names))
            names += [joined[i : i + n] for i in first.tolist()]
            starts.append(place)
    # Grams in the order of their words.
    owner = np.repeat(np.arange(len(size)), size)[np.concatenate(starts)]
    grams = np.concatenate(numbers)[np.argsort(owner, kind="stable")]
    held = np.bincount(owner, minlength=len(size))
    each = held[word]
    at = np.arange(each.sum()) + np.repeat((np.cumsum(held) - held)[word] - (np.cumsum(each) - each), each)
    return np.repeat(title, each), grams[at], pa.array(names, known.type)


def _folded(part: pa.RecordBatch, analyzer: str, n_means: int) -> pa.Table:
    """One row per community and term of these titles."""
    cut, community = part["words"], part["subreddit"].dictionary_encode("encode")
    encoded = cut.flatten().dictionary_encode()
    title = pc.list_parent_indices(cut).to_numpy().astype(np.int64)
    find = _word_terms if analyzer == "word" else _char_terms
    title, term, names = find(title, encoded.indices.to_numpy().astype(np.int64), encoded.dictionary)
    # In order of community, term and title, the last from the key's remainder.
    n, rows = max(len(names), 1), part.num_rows
    key = (community.indices.to_numpy().astype(np.int64)[title] * n + term) * rows + title
    key.sort()
    begin = np.flatnonzero(np.diff(key, prepend=-1))
    tf = np.diff(begin, append=len(key))
    group, title = np.divmod(key[begin], rows)
    first = np.flatnonzero(np.diff(group, prepend=-1))
    times = part["times"].to_numpy()
    weight = times[title]

    def total(x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, first) if len(first) else x

    of, term = np.divmod(group[first], n)
    columns = {
        "subreddit": community.dictionary.take(pa.array(of)), "feature": names.take(pa.array(term)),
        "tf": total(tf * weight), "df": total(weight),
    }
    for i in range(n_means):
        value, known = part[f"mean_{i}"].fill_null(0.0).to_numpy(), part[f"mean_{i}"].is_valid().to_numpy(zero_copy_only=False)
        columns[f"sum_{i}"] = total((value * known * times)[title])
        columns[f"n_{i}"] = total((known * times)[title])
    return pa.table(columns)
