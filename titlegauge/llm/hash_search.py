"""Nearest neighbours by multi-index hashing over learned binary codes.

Method. Unit vectors are centred, rotated by matrices learned on a bounded sample (alternating
between signs and the best rotation onto them) and cut at zero: one bit a direction, several
rotations until there are ``BITS`` bits. A code is split into substrings of 16 bits, and a block of
rows has one index per substring: rows in order of its value. If two codes differ in at most r bits,
some substring differs in few: with r = s * m + a over m substrings, one of the first a + 1 in at
most s bits or one of the others in at most s - 1. So probing each index with all values that near
finds every code within radius r. Those rows are compared by exact cosine on the original vectors.

The radius is per query and grows with what it has to reach. The bits of two vectors at angle t
differ with chance t / pi each, so the distance of codes is about binomial. Every query first meets
the sample; the angle t of its fifth best there bounds the angle of its true neighbours, and the
radius is the mean distance at t plus ``MARGIN`` standard deviations. Large tables have nearer
neighbours and get smaller radii. Recall is measured in the tests and in the README.

Plan: rows go to blocks by a hash, queries to blocks of their own, and each cell (row block, query
block) is one group of bounded size in a cogroup. A cell gives the best few of each of its queries,
and a window over these finds the answer, so nothing grows with the pairs, and a crowd of equal or
near-equal vectors is spread over all blocks. Work is the rows of a cell times its queries at worst
(spread-out vectors have no near codes), which no index avoids at high recall; it is done a block at
a time and never listed.

Defined cases. Vectors that are null, empty, zero or hold a null or non-finite component take no
part, nor do vectors of another length than most have (the longer on a tie). Of several vectors
under one id the least counts; rows without an id can be found (with a null id, after all ids on
ties) but do not ask, equal ones once. Fewer than five candidates are all given. Extra columns are
not read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titlegauge.llm.common import let_workers_import, record_batch, written

#: Bits of a code (its substrings have 16), and rows the rotations are learned on.
BITS, SAMPLE_ROWS = 256, 4_096
#: Directions that one rotation keeps at most, and steps of its fit.
DIRECTIONS, FIT_STEPS = 256, 25
#: Standard deviations of the code distance that the radius adds.
MARGIN = 1.0
#: Rows and queries of a cell at most on average, and rows of a block where there are tasks to spare.
BLOCK_ROWS, BLOCK_QUERIES, LEAST_ROWS = 65_536, 16_384, 256
#: Codes are whole words of so many bits.
WORD = 64


@dataclass(frozen=True)
class Coder:
    """Centre and directions (one column a bit) learned from a sample."""

    centre: np.ndarray
    directions: np.ndarray

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """A row of 16-bit substrings per vector."""
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        bits = (unit - self.centre) @ self.directions > 0
        return np.packbits(bits, axis=1).view(np.uint16)


def learn_coder(sample: np.ndarray, bits: int = BITS, seed: int = 7) -> Coder:
    """Rotations that put the signs of the sample's vectors as near to the vectors as they can be."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    centre = unit.mean(axis=0)
    centred = unit - centre
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, :DIRECTIONS]
    flat = centred @ axes
    rng, parts, width = np.random.default_rng(seed), [], axes.shape[1]
    bits = -(-max(bits, width) // WORD) * WORD
    while sum(p.shape[1] for p in parts) < bits:
        rotation = np.linalg.qr(rng.normal(size=(width, width)))[0]
        for _ in range(FIT_STEPS):
            left, _, right = np.linalg.svd(np.where(flat @ rotation > 0, 1.0, -1.0).T @ flat)
            rotation = (left @ right).T
        parts.append(axes @ rotation)
    return Coder(centre, np.concatenate(parts, axis=1)[:, :bits])


def radius_at(cosine: np.ndarray, bits: int, margin: float = MARGIN) -> np.ndarray:
    """Code distance that vectors of this cosine stay within, ``margin`` deviations above the mean."""
    chance = np.arccos(np.clip(cosine, -1.0, 1.0)) / math.pi
    return np.minimum(bits, np.ceil(bits * chance + margin * np.sqrt(bits * chance * (1 - chance)) + 1)).astype(np.int64)


def cosines(vectors: np.ndarray, norms: np.ndarray, query: np.ndarray, norm: float) -> np.ndarray:
    """Row by row, so that equal vectors get equal numbers wherever they lie."""
    return (vectors * query).sum(axis=1) / (norms * norm)


class BlockIndex:
    """The substring indexes of one block of codes: values, the rows of each, and each row's value."""

    def __init__(self, codes: np.ndarray):
        self.words = np.ascontiguousarray(codes).view(np.uint64)
        self.indexes = []
        for j in range(codes.shape[1]):
            values, place, counts = np.unique(codes[:, j], return_inverse=True, return_counts=True)
            order = np.argsort(place, kind="stable")
            self.indexes.append((values, place, order, np.concatenate([[0], np.cumsum(counts)])))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """The rows whose code differs from ``code`` in at most ``radius`` bits, in order."""
        most, first = divmod(int(radius), len(self.indexes))
        seen = np.zeros(len(self.words), bool)
        for j, (values, place, order, starts) in enumerate(self.indexes):
            near = most if j <= first else most - 1
            if near < 0:
                break
            if near == 0:
                at = int(np.searchsorted(values, code[j]))
                if at < len(values) and values[at] == code[j]:
                    seen[order[starts[at] : starts[at + 1]]] = True
            else:
                seen |= (np.bitwise_count(values ^ code[j]) <= near)[place]
        rows = np.flatnonzero(seen)
        distance = np.bitwise_count(self.words[rows] ^ code.view(np.uint64)).sum(axis=1)
        return rows[distance <= radius]


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties to the smaller id."""
    places = np.arange(len(scores))
    if len(scores) > k:
        places = np.flatnonzero(scores >= -np.partition(-scores, k - 1)[k - 1])
    return places[np.lexsort((ids[places], -scores[places]))][:k]


def _matrix(column: pa.Array) -> np.ndarray:
    """List rows of one length as a matrix of doubles."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(flat), -1) if len(flat) else np.zeros((0, 1))


def usable_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, row, vector): one row per id, or per distinct vector without an id; ``row`` names it."""
    let_workers_import(table.sparkSession)
    plain = table.select(
        table[id_col].cast("long").alias("vec_id"), table[vector_col].cast("array<double>").alias("vector")
    )
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    plain = plain.filter(F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0))
    unnamed = F.when(F.col("vec_id").isNull(), F.xxhash64("vector"))
    kept = plain.groupBy("vec_id", unnamed.alias("unnamed")).agg(F.min("vector").alias("vector"))
    return kept.select("vec_id", F.coalesce("unnamed", F.lit(0)).alias("unnamed"), "vector")


def _pmod(columns: list[str], n: int, salt: int) -> Column:
    return F.pmod(F.xxhash64(*columns, F.lit(salt)), F.lit(n)).cast("int")


KEY = ["vec_id", "unnamed"]
FOUND = "query_id long, vec_id long, unnamed long, score double"


def nearest(
    table: DataFrame, asks: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
    bits: int = BITS, margin: float = MARGIN,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest of every row whose ``asks`` holds (a condition
    on ``vec_id``)."""
    spark = table.sparkSession
    vectors = written(usable_vectors(table, id_col, vector_col))
    common = vectors.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    vectors = vectors.filter(F.size("vector") == common["dims"])
    sample = vectors.orderBy(F.xxhash64(*KEY), *KEY).limit(SAMPLE_ROWS).toArrow()
    coder = learn_coder(_matrix(sample["vector"]), bits)
    queries = vectors.filter(F.col("vec_id").isNotNull() & asks)
    sized = written(_with_radius(queries, sample, coder, k, margin))

    rows_in, asked = common["count"], sized.count()
    spare = int(spark.conf.get("spark.sql.shuffle.partitions"))
    row_blocks = max(-(-rows_in // BLOCK_ROWS), min(spare, -(-rows_in // LEAST_ROWS)))
    query_blocks = max(1, -(-asked // BLOCK_QUERIES))
    everywhere = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.select("*", _pmod(KEY, row_blocks, 1).alias("row_block"), everywhere(query_blocks).alias("query_block"))
    right = sized.select(
        F.col("vec_id").alias("query_id"), "vector", "radius",
        everywhere(row_blocks).alias("row_block"), _pmod(["vec_id"], query_blocks, 2).alias("query_block"),
    )
    cell = ["row_block", "query_block"]
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(_searcher(coder, k), FOUND)
    seeds = sized.select(F.col("vec_id").alias("query_id"), F.explode("seeds").alias("s")).select("query_id", "s.*")
    # The sample's rows are found a second time in their blocks.
    once = found.unionByName(seeds).groupBy("query_id", *KEY).agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "unnamed")
    ranked = once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _with_radius(queries: DataFrame, sample: pa.Table, coder: Coder, k: int, margin: float) -> DataFrame:
    """Queries with the radius of their search and their best rows of the sample (``seeds``)."""
    rows = _matrix(sample["vector"])
    ids, unnamed = sample["vec_id"].to_pylist(), sample["unnamed"].to_pylist()
    order = np.array([math.inf if i is None else i for i in ids])
    norms, bits = np.linalg.norm(rows, axis=1), coder.directions.shape[1]

    def size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            asked, own = _matrix(batch.column("vector")), batch.column("vec_id").to_pylist()
            radius, seeds = [], []
            for query, name in zip(asked, own, strict=True):
                scores = cosines(rows, norms, query, np.linalg.norm(query))
                places = best(scores, order, k + 1)
                places = [p for p in places if ids[p] != name][:k]
                enough = len(places) == k
                radius.append(int(radius_at(scores[places[-1]], bits, margin)) if enough else bits)
                seeds.append([{"vec_id": ids[p], "unnamed": unnamed[p], "score": float(scores[p])} for p in places])
            kind = pa.list_(pa.struct([("vec_id", pa.int64()), ("unnamed", pa.int64()), ("score", pa.float64())]))
            yield record_batch(
                vec_id=batch.column("vec_id"), vector=batch.column("vector"),
                radius=pa.array(radius, pa.int32()), seeds=pa.array(seeds, kind),
            )

    schema = "vec_id long, vector array<double>, radius int, seeds array<struct<vec_id: long, unnamed: long, score: double>>"
    return queries.select("vec_id", "vector").mapInArrow(size, schema)


def _searcher(coder: Coder, k: int):
    """The search of one cell: its rows are indexed, its queries probe the indexes."""

    def search(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if rows.num_rows and queries.num_rows:
            vectors, asked = _matrix(rows["vector"]), _matrix(queries["vector"])
            ids, unnamed = rows["vec_id"].to_pylist(), rows["unnamed"].to_pylist()
            order = np.array([math.inf if i is None else i for i in ids])
            norms, index = np.linalg.norm(vectors, axis=1), BlockIndex(coder.codes(vectors))
            codes = coder.codes(asked)
            for i, (name, radius) in enumerate(zip(queries["query_id"].to_pylist(), queries["radius"].to_pylist(), strict=True)):
                near = index.within(codes[i], radius)
                near = near[order[near] != name]
                scores = cosines(vectors[near], norms[near], asked[i], np.linalg.norm(asked[i]))
                for p in best(scores, order[near], k):
                    for column, value in zip(out, (name, ids[near[p]], unnamed[near[p]], float(scores[p])), strict=True):
                        column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        names = [field.split()[0] for field in FOUND.split(", ")]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, out, kinds, strict=True)})

    return search


def contract_neighbours(embeddings: DataFrame) -> DataFrame:
    return nearest(embeddings, F.col("vec_id") % 50 == 0, k=5)
