"""The in-space features of many titles at once, so that a feature of a title is never a row.

Titles are dealt to chunks of one community, each of which meets the community's feature space as one
packed row. Spark cuts titles to words and measures their structure; a task counts the terms of a stretch
of titles as numbers (Arrow dictionaries), looks the different ones up in the space, and weighs them.

Memory: a chunk has about ``CHUNK_TEXT`` characters of titles, and a community's space is bounded by its
vocabulary limits. A hot community is many chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from titlegauge.functions.text import STRUCTURAL_NAMES, spaced_words, with_structural, words
from titlegauge.operators.joins import lookup_join
from titlegauge.operators.term_counts import STEP_WORDS, _char_terms, _word_terms
from titlegauge.session import cut_lineage, let_workers_import

#: Characters of titles in a chunk: at most (a longer title is a chunk's), and at least if there are many cores.
CHUNK_TEXT, LEAST_TEXT = 2_000_000, 64_000
#: Bytes of packed spaces that every task may have; more are sent to the chunks.
BROADCAST_BYTES = 32 << 20
#: Characters that a title counts for besides its own, for its structure and its keys.
TITLE_TEXT = 64
INTERCEPT = "(intercept)"
#: What cuts the text of a counter to words, and words to terms.
COUNTERS = {"word": (words, _word_terms), "char": (spaced_words, _char_terms)}


@dataclass
class Cells:
    """Weighted features of a chunk, in order of title, kind, feature; ``place`` is a row of ``space``."""

    first: np.ndarray  # the first row of each title in the chunk
    title: np.ndarray
    place: np.ndarray
    value: np.ndarray
    raw: np.ndarray
    space: pa.Table

    def per_title(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.title, weights, len(self.first)).astype(float)

    def offsets(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(np.bincount(self.title, minlength=len(self.first)))])


def codes(rows: pa.Table, keys: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """A number per row, equal where the keys are (nulls too), and the first row of each number."""
    code = np.zeros(rows.num_rows, np.int64)
    for key in keys:
        column = rows[key].combine_chunks().dictionary_encode("encode")
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        code = code * max(len(column.dictionary), 1) + column.indices.to_numpy()
        code = np.unique(code, return_inverse=True)[1]
    _, first, inverse = np.unique(code, return_index=True, return_inverse=True)
    return inverse, first


def _stretches(cut: pa.ListArray) -> Iterator[tuple[int, pa.ListArray]]:
    """Parts of ``STEP_WORDS`` words, each with the place of its first title."""
    ends = np.cumsum(pc.list_value_length(cut).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < len(cut):
        limit = (ends[begin - 1] if begin else 0) + STEP_WORDS
        end = max(begin + 1, int(np.searchsorted(ends, limit, side="right")))
        yield begin, cut.slice(begin, end - begin)
        begin = end


def _text_cells(cut: pa.ListArray, find: Callable, known: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, place in ``known``, occurrences) of the known terms, a stretch of titles at a time."""
    size = max(len(known), 1)
    for begin, part in _stretches(cut):
        encoded = part.flatten().dictionary_encode()
        title = pc.list_parent_indices(part).to_numpy().astype(np.int64)
        title, term, names = find(title, encoded.indices.to_numpy().astype(np.int64), encoded.dictionary)
        found = pc.index_in(names.cast(known.type), value_set=known).fill_null(-1).to_numpy().astype(np.int64)
        place = found[term]
        held = place >= 0
        key = title[held] * size + place[held]
        key.sort()
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        row, place = np.divmod(key[starts], size)
        yield row + begin, place, np.diff(starts, append=len(key)).astype(float)


def _vector_cells(vectors: pa.ListArray, known: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    row = pc.list_parent_indices(vectors).to_numpy().astype(np.int64)
    value = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    held = np.bincount(row, minlength=len(vectors))
    at = np.arange(len(row)) - (np.cumsum(held) - held)[row]
    longest = int(at.max()) + 1 if len(at) else 0
    names = pa.array([f"e{i}" for i in range(longest)], known.type)
    place = pc.index_in(names, value_set=known).fill_null(-1).to_numpy().astype(np.int64)[at]
    inside = place >= 0
    return row[inside], place[inside], value[inside]


def cells_of(
    rows: pa.Table, space: pa.Table, keys: Sequence[str], text_kinds: dict[str, str], embedding: str | None
) -> Cells:
    """``rows``: titles with their structure (``s0``, ...), their words (``words_KIND``) and their vector;
    ``space`` in order of kind and feature. Text weights have unit length per title; rows of equal keys are
    one title."""
    kind, names = space["kind"].combine_chunks(), space["feature"].combine_chunks()
    title_of, first = codes(rows, keys)
    parts = []

    def known(wanted: str) -> tuple[int, pa.Array]:
        held = np.flatnonzero(pc.equal(kind, wanted).fill_null(False).to_numpy(zero_copy_only=False))
        return (int(held[0]), names.slice(held[0], len(held))) if len(held) else (0, names.slice(0, 0))

    n = rows.num_rows
    low, mine = known("s")
    for i, place in enumerate(pc.index_in(pa.array(STRUCTURAL_NAMES, names.type), value_set=mine).to_pylist()):
        if place is not None:
            x = rows[f"s{i}"].to_numpy()
            parts.append((np.arange(n), np.full(n, low + place), x, x))
    low, mine = known("i")
    place = pc.index_in(pa.array([INTERCEPT], names.type), value_set=mine)[0].as_py()
    if place is not None:
        parts.append((np.arange(n), np.full(n, low + place), np.ones(n), np.ones(n)))
    if embedding:
        low, mine = known("e")
        row, place, x = _vector_cells(rows[embedding].combine_chunks(), mine)
        parts.append((row, low + place, x, x))
    for wanted, counter in text_kinds.items():
        low, mine = known(wanted)
        for row, place, times in _text_cells(rows[f"words_{wanted}"].combine_chunks(), COUNTERS[counter][1], mine):
            parts.append((row, low + place, 1 + np.log(times), times))
    row, place, x, raw = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)] * 2
    size = max(space.num_rows, 1)
    center, factor = (space[c].to_numpy() for c in ("center", "factor"))
    value = (x - center[place]) * factor[place]
    own = np.zeros(size, bool)
    own[known("i")[0] : known("i")[0] + len(known("i")[1])] = True
    value = np.where(own[place], factor[place], value)
    title = title_of[row]
    order = np.argsort(title * size + place, kind="stable")
    if len(first) < n:
        order = np.lexsort((raw, value, title * size + place))
    title, place, value, raw = title[order], place[order], value[order], raw[order]
    for wanted in ("t", "c"):
        low, mine = known(wanted)
        text = np.flatnonzero((place >= low) & (place < low + len(mine)))
        length = np.sqrt(np.bincount(title[text], value[text] ** 2, len(first)))
        value[text] /= length[title[text]]
    return Cells(first, title, place, value, raw, space)


def packed(space: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(subreddit, space): the space of each community as one value, in order of kind and feature."""

    def pack(key: tuple, mine: pa.Table) -> pa.Table:
        mine = mine.drop_columns(["subreddit"]).sort_by([("kind", "ascending"), ("feature", "ascending")])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, mine.schema) as writer:
            writer.write_table(mine)
        sent = pa.array([sink.getvalue().to_pybytes()], pa.binary())
        return pa.table({"subreddit": pa.array([key[0].as_py()], pa.string()), "space": sent})

    asked = space.filter("subreddit is not null").select("subreddit", *columns)
    return asked.groupBy("subreddit").applyInArrow(lambda key, mine: pack(key, mine), "subreddit string, space binary")


def per_chunk(
    posts: DataFrame, space: DataFrame, keys: Sequence[str], text_kinds: dict[str, str], embedding: str | None,
    columns: Sequence[str], work: Callable[[pa.Table, Cells], pa.Table], schema: T.StructType, deal: Sequence[str] = (),
) -> DataFrame:
    """``work`` of every chunk's titles and their cells. ``columns`` of ``space`` go along; titles that share
    ``deal`` (without it, ``keys``) are in one chunk."""
    spark = posts.sparkSession
    let_workers_import(spark)
    spaces = cut_lineage(packed(space, ["kind", "feature", "center", "factor", *columns]))
    asked = dict.fromkeys([*keys, "subreddit", "title", *([embedding] if embedding else [])])
    text = F.sum(F.coalesce(F.length("title"), F.lit(0)) + TITLE_TEXT).alias("text")
    sizes = cut_lineage(posts.groupBy("subreddit").agg(text).join(spaces.select("subreddit"), "subreddit"))
    cores = spark.sparkContext.defaultParallelism
    total = sizes.agg(F.sum("text")).first()[0] or 0
    most = min(CHUNK_TEXT, max(LEAST_TEXT, total // (4 * cores)))
    chunked = sizes.select("subreddit", F.ceil(F.col("text") / most).cast("int").alias("_chunks"))
    deals = F.pmod(F.xxhash64(*(deal or keys)), F.col("_chunks")).cast("int").alias("_chunk")
    dealt = lookup_join(posts.select(*asked), chunked, ["subreddit"], spread=list(asked)).select(*asked, deals)
    by = ["subreddit", "_chunk"]
    # A number of its own, as small tables would end in a few tasks.
    tasks = max(cores, min(2 * (total // most + 1), 2_000))
    dealt = with_structural(dealt.repartition(tasks, *by).sortWithinPartitions(*by))
    cut = {f"words_{kind}": COUNTERS[counter][0](F.col("title")) for kind, counter in text_kinds.items()}
    named = [c for c in [*asked, "_chunk"] if c != "title" or c in keys]
    staged = dealt.select(
        *named, *[F.col(name).alias(f"s{i}") for i, name in enumerate(STRUCTURAL_NAMES)],
        *[words.alias(name) for name, words in cut.items()],
    )
    nothing = to_arrow_schema(schema).empty_table()

    def read(rows: pa.Table, sent: pa.Buffer) -> pa.Table:
        found = pa.ipc.open_stream(sent).read_all()
        return work(rows, cells_of(rows, found, keys, text_kinds, embedding))

    if (spaces.agg(F.sum(F.length("space"))).first()[0] or 0) <= BROADCAST_BYTES:
        everywhere = spark.sparkContext.broadcast({r["subreddit"]: bytes(r["space"]) for r in spaces.collect()})
        return staged.groupBy(*by).applyInArrow(
            lambda rows: read(rows, pa.py_buffer(everywhere.value[rows["subreddit"][0].as_py()])), schema
        )
    sent = spaces.join(chunked, "subreddit").select(
        "subreddit", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("_chunk"), "space"
    )

    def run(rows: pa.Table, given: pa.Table) -> pa.Table:
        return read(rows, given["space"][0].as_buffer()) if rows.num_rows and given.num_rows else nothing

    return staged.groupBy(*by).cogroup(sent.groupBy(*by)).applyInArrow(lambda rows, given: run(rows, given), schema)
