"""L2 logistic regression by Newton steps, several models at once, over chunks of rows.

A step is one aggregation: each chunk gives the weighted products of the columns its rows hold (the
normal equations of the step, as sparse sums), its gradient and its loss; sums are added map-side and
shuffled by entry; a model's equations, bounded by its features squared, are solved in one group. A
step that does not lower the loss is halved. A model stops when its gradient vanishes.

The loss of a model is sum(weight * log loss) + |w|^2 / (2 c); the intercept is not penalised.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titlegauge.operators.ridge import TOTALS, Chunk, over_chunks
from titlegauge.session import cut_lineage, let_workers_import

#: Rows of a chunk, which is the work of one task in a step.
CHUNK_ROWS = 16_384
#: Gradient, per unit of row weight, at which a fit stops, and steps after which it has failed.
TOLERANCE, MAX_STEPS = 1e-9, 100
#: Products that a chunk expands at once, and cells of a table that they are added to (8 bytes each).
PRODUCTS, TABLE_CELLS = 4_000_000, 16_000_000


def chunked(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (subreddit, label, weight, idx, value) dealt to chunks, and sizes (subreddit, chunks)."""
    let_workers_import(rows.sparkSession)
    sizes = cut_lineage(
        rows.groupBy("subreddit").agg(F.ceil(F.count(F.lit(1)) / CHUNK_ROWS).cast("int").alias("chunks"))
    )
    deal = F.pmod(F.xxhash64("label", "idx", "value", "weight"), F.col("chunks")).cast("int")
    dealt = rows.join(F.broadcast(sizes), "subreddit").select(
        "subreddit", deal.alias("chunk"), "label", "weight", "idx", "value"
    )
    # A number of its own, so that few chunks do not end in the same task.
    spark, chunks = rows.sparkSession, sizes.agg(F.sum("chunks")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, min(4 * int(chunks), 400))
    return dealt.repartition(tasks, "subreddit", "chunk").sortWithinPartitions("subreddit", "chunk").persist(), sizes


def _pairs(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every pair of places that share a row, the first no later than the second; ``rows`` is sorted."""
    counts = np.bincount(rows)
    ends = np.cumsum(counts)[rows]
    each = ends - np.arange(len(rows))
    left = np.repeat(np.arange(len(rows)), each)
    inside = np.arange(len(left)) - np.repeat(np.cumsum(each) - each, each)
    return left, left + inside


def _ordered(row: np.ndarray, idx: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells in order of row and feature; those of one feature of a row are one."""
    order = np.lexsort((idx, row))
    row, idx, value = row[order], idx[order], value[order]
    new = np.r_[True, (row[1:] != row[:-1]) | (idx[1:] != idx[:-1])][: len(row)]
    if new.all():
        return row, idx, value
    return row[new], idx[new], np.add.reduceat(value, np.flatnonzero(new))


def _equations(chunk: Chunk, parameters: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Upper triangle of the weighted products (i * size + j), gradient (-2 - j), loss (-1)."""
    size, n = len(parameters), len(chunk.label)
    z = chunk.times(parameters) + parameters[-1]
    chance = 0.5 * (1 + np.tanh(z / 2))
    slope, bend = chunk.weight * (chance - chunk.label), chunk.weight * chance * (1 - chance)
    loss = (chunk.weight * (np.logaddexp(0, z) - chunk.label * z)).sum()
    row, idx, value = _ordered(
        np.concatenate([chunk.row, np.arange(n)]), np.concatenate([chunk.idx, np.full(n, size - 1)]).astype(np.int64),
        np.concatenate([chunk.value, np.ones(n)]),
    )
    gradient = np.bincount(idx, value * slope[row], size)
    keys, sums = [np.array([TOTALS]), -2 - np.arange(size)], [np.array([loss]), gradient]
    held = np.bincount(row, minlength=n)
    work = np.concatenate([[0], np.cumsum(held * (held + 1) // 2)])
    # A table of all products, where it is no larger than a few parts of them; sorting finds each part's otherwise.
    table = np.zeros(size * size) if size * size <= TABLE_CELLS else None
    bent, begin = value * bend[row], 0
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(work, work[begin] + PRODUCTS, side="right")) - 1)
        low, high = np.searchsorted(row, [begin, end])
        left, right = _pairs(row[low:high] - begin)
        entry = (idx[low:high] * size)[left] + idx[low:high][right]
        product = bent[low:high][left] * value[low:high][right]
        if table is not None:
            table += np.bincount(entry, product, size * size)
        else:
            entry, place = np.unique(entry, return_inverse=True)
            keys.append(entry)
            sums.append(np.bincount(place, product, len(entry)))
        begin = end
    if table is not None:
        keys.append(np.flatnonzero(table))
        sums.append(table[keys[-1]])
    return np.concatenate(keys), [np.concatenate(sums)]


@dataclass
class Newton:
    """One model on its way: parameters (features, then intercept) and the last step."""

    parameters: np.ndarray
    weight: float
    penalty: float
    intercept: bool = True
    step: np.ndarray | None = None
    loss: float = np.inf
    open: bool = True

    def advance(self, idx: np.ndarray, sums: np.ndarray) -> None:
        size, w = len(self.parameters), self.parameters[:-1]
        loss = sums[idx == TOTALS].sum() + 0.5 * self.penalty * (w @ w)
        if self.step is not None and loss > self.loss + 1e-12 * abs(self.loss):
            self.step = self.step / 2
            self.parameters = self.parameters - self.step
            return
        gradient = np.zeros(size)
        gradient[-2 - idx[idx < TOTALS]] = sums[idx < TOTALS]
        gradient[:-1] += self.penalty * w
        if not self.intercept:
            gradient[-1] = 0.0
        if np.abs(gradient).max() <= TOLERANCE * self.weight:
            self.open = False
            return
        table = np.zeros((size, size))
        table.flat[idx[idx >= 0]] = sums[idx >= 0]
        table += np.triu(table, 1).T
        table[np.arange(size - 1), np.arange(size - 1)] += self.penalty
        # Rows of one label only leave the intercept without bend at last.
        table[-1, -1] += 1e-12 * max(1.0, self.weight)
        if not self.intercept:
            table[-1, :] = table[:, -1] = 0.0
            table[-1, -1] = 1.0
        self.step, self.loss = -np.linalg.solve(table, gradient), loss
        self.parameters = self.parameters + self.step


STATE = "subreddit string, chunks int, open boolean, sent binary, state binary"


def _row(name: str, chunks: int, state: Newton) -> pa.Table:
    values = (name, chunks, state.open, pickle.dumps(state.parameters), pickle.dumps(state))
    kinds = (pa.string(), pa.int32(), pa.bool_(), pa.binary(), pa.binary())
    names = [f.split()[0] for f in STATE.split(", ")]
    return pa.table({n: pa.array([v], t) for n, v, t in zip(names, values, kinds, strict=True)})


def fit(rows: DataFrame, n_features: DataFrame, c: float = 1.0, intercept: bool = True) -> DataFrame:
    """(subreddit, idx, coef) of every model; the intercept has idx -1.

    ``rows``: (subreddit, label 0 or 1, weight, idx array, value array), ``subreddit`` naming the model;
    ``n_features``: (subreddit, m). A model's features bound its group: m squared doubles.
    """
    dealt, sizes = chunked(rows)
    weights = dealt.groupBy("subreddit").agg(F.sum("weight").alias("weight"))
    asked = sizes.join(n_features, "subreddit").join(weights, "subreddit")

    def begin(key: tuple, size: pa.Table) -> pa.Table:
        start = Newton(np.zeros(size["m"][0].as_py() + 1), size["weight"][0].as_py(), 1.0 / c, intercept)
        return _row(key[0].as_py(), size["chunks"][0].as_py(), start)

    def step(key: tuple, old: pa.Table, sums: pa.Table) -> pa.Table:
        if not sums.num_rows:
            return old
        state = pickle.loads(old["state"][0].as_py())
        state.advance(sums["idx"].to_numpy(), sums["s0"].to_numpy())
        return _row(key[0].as_py(), old["chunks"][0].as_py(), state)

    def coefficients(key: tuple, mine: pa.Table) -> pa.Table:
        found = pickle.loads(mine["sent"][0].as_py())
        names = pa.array([key[0].as_py()] * len(found), pa.string())
        return pa.table({"subreddit": names, "idx": pa.array([*range(len(found) - 1), TOTALS], pa.int32()), "coef": found})

    try:
        state = cut_lineage(asked.groupBy("subreddit").applyInArrow(begin, STATE))
        for _ in range(MAX_STEPS):
            left = state.filter("open")
            if left.select("open").isEmpty():
                return state.groupBy("subreddit").applyInArrow(coefficients, "subreddit string, idx int, coef double")
            sums = over_chunks(dealt, left, 1, _equations)
            state = cut_lineage(state.groupBy("subreddit").cogroup(sums.groupBy("subreddit")).applyInArrow(step, STATE))
    finally:
        dealt.unpersist()
    raise RuntimeError(f"no optimum after {MAX_STEPS} steps")
