"""Ridge models of all communities at once, by conjugate gradients over chunks of rows.

Every community is a least-squares problem of its own; with folds it is several (one per fold, which
leaves the fold out, and one on all rows), and each is wanted for several penalties. All of them
advance together, and a step is one pass over the rows:

* rows lie in chunks of one community, shuffled once and kept; a chunk meets the search directions of
  its community (one per system), multiplies by its rows and back, and gives one partial sum per
  feature it holds;
* the partial sums of a feature are added map-side and shuffled by (community, feature);
* a community's vectors, bounded by its vocabulary limit, meet their sums in one group, which makes
  the step: new residuals, solutions, directions.

The penalties need no passes of their own: all systems X'X + alpha I of one X'y share their search
space, so the solutions of the larger penalties follow from the steps of the smallest one by scalar
recurrences (multi-shift conjugate gradients). Features and labels are centred in the arithmetic, so
the intercept is not penalised and never a column. A system stops when its residual is ``TOLERANCE``
of its start (``FOLD_TOLERANCE`` for the folds, which are only compared); a community whose systems
have all stopped sends no directions. Nothing but the question whether one is left comes to the
driver. A community of one chunk has all its rows at hand and makes the same steps where it lies, in
the first pass.

Memory: a chunk has about ``CHUNK_ROWS`` rows and ``CHUNK_CELLS`` non-zero features at most (16 bytes each
while it is worked on), a community's vectors have (systems + 1) * penalties * features doubles. A hot
community is many chunks; its vectors are one group whatever its rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titlegauge.functions.values import seeded_order
from titlegauge.operators.features import SPACE_COLUMNS, featurize
from titlegauge.operators.joins import lookup_join
from titlegauge.session import cut_lineage, let_workers_import

#: Rows and non-zero features of a chunk. A community of one chunk costs no pass of the cluster per step.
CHUNK_ROWS, CHUNK_CELLS = 262_144, 16_000_000
#: Non-zero features that a product expands at once, and rows that are dense at once.
BLOCK_CELLS, BLOCK_ROWS = 1 << 20, 16_384
#: The same where sums lie in order of what they are for: few enough for a core's cache.
STRETCH_CELLS = 1 << 16
#: Residual, relative to its start, at which a system stops, and steps after which a fit has failed.
TOLERANCE, FOLD_TOLERANCE, MAX_STEPS = 1e-10, 1e-7, 2_000
#: Features up to which a community of one chunk holds the products of its columns, a table per system.
GRAM_FEATURES = 256
#: Passes between two looks at whether a system is left.
LOOK_EVERY = 4
#: The row of a chunk's sums that holds counts and label sums instead of a feature.
TOTALS = -1


def with_local_index(space: DataFrame) -> DataFrame:
    """``space`` with ``idx``: 0, 1, ... within each community; the intercept has none (null).

    The window sorts one community's features, which the vocabulary limits bound.
    """
    order = Window.partitionBy("subreddit").orderBy("kind", "feature")
    number = F.when(F.col("kind") != "i", F.row_number().over(order) - 1).cast("int")
    # The intercept sorts among the kinds; count only the others.
    others = F.sum((F.col("kind") == "i").cast("int")).over(order)
    return space.withColumn("idx", (number - others).cast("int"))


def fold_of(key: Column, folds: int) -> Column:
    return F.pmod(seeded_order(key, 1), F.lit(folds)) if folds else F.lit(0).cast("long")


def row_chunks(
    labelled: DataFrame, indexed: DataFrame, folds: int, analyzer: str | None, embedding: str | None
) -> tuple[DataFrame, DataFrame]:
    """The rows of every chunk (subreddit, chunk, fold, label, idx, value) and the communities' sizes
    (subreddit, chunks, m)."""
    keys = ["subreddit", "id", "label"]
    wide = featurize(labelled, indexed, keys, analyzer, embedding, extra=["idx"], named=False)
    # Only the intercept has no index.
    cells = F.filter("features", lambda f: f["idx"].isNotNull())
    rows = cut_lineage(
        wide.select(
            *keys, fold_of(F.col("id"), folds).cast("int").alias("fold"),
            F.transform(cells, lambda f: f["idx"]).alias("idx"),
            F.transform(cells, lambda f: f["value"]).alias("value"),
        )
    )
    features = indexed.groupBy("subreddit").agg(F.count("idx").cast("int").alias("m"))
    by_rows, by_cells = F.ceil(F.count(F.lit(1)) / CHUNK_ROWS), F.ceil(F.sum(F.size("idx")) / CHUNK_CELLS)
    counted = rows.groupBy("subreddit").agg(F.greatest(by_rows, by_cells).cast("int").alias("chunks"))
    sizes = cut_lineage(counted.join(features, "subreddit"))
    dealt = lookup_join(rows, sizes.select("subreddit", "chunks"), ["subreddit"], spread=["id"]).select(
        "subreddit", F.pmod(F.xxhash64("id", "label"), F.col("chunks")).cast("int").alias("chunk"),
        "fold", "label", "idx", "value",
    )
    # A number of its own, so that few communities do not end in the same task.
    spark, chunks = labelled.sparkSession, sizes.agg(F.sum("chunks")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, min(4 * int(chunks), 400))
    dealt = dealt.repartition(tasks, "subreddit", "chunk").sortWithinPartitions("subreddit", "chunk")
    return dealt.persist(StorageLevel.MEMORY_AND_DISK), sizes


@dataclass
class Chunk:
    """Sparse rows of one community."""

    row: np.ndarray
    idx: np.ndarray
    value: np.ndarray
    label: np.ndarray
    fold: np.ndarray | None = None
    weight: np.ndarray | None = None
    #: Cells in order of feature, for many products: (places where a feature begins, those features, row, value).
    turned: tuple[np.ndarray, ...] | None = None

    @classmethod
    def of(cls, table: pa.Table) -> Chunk:
        idx, value = (table[c].combine_chunks() for c in ("idx", "value"))
        counts = np.diff(idx.offsets.to_numpy())
        fold, weight = (table[c].to_numpy() if c in table.column_names else None for c in ("fold", "weight"))
        return cls(
            np.repeat(np.arange(table.num_rows, dtype=np.int32), counts), idx.flatten().to_numpy(), value.flatten().to_numpy(),
            table["label"].to_numpy(), fold, weight,
        )

    def trained(self, systems: int) -> np.ndarray:
        """1 where a system trains on a row: the last on all, the others on all but their fold."""
        mask = np.ones((len(self.label), systems))
        mask[:, :-1] = self.fold[:, None] != np.arange(systems - 1)[None, :]
        return mask

    def blocks(self) -> Iterator[slice]:
        """The cells in parts of ``BLOCK_CELLS``, so a product needs little beside the chunk."""
        for begin in range(0, len(self.row), BLOCK_CELLS):
            yield slice(begin, begin + BLOCK_CELLS)

    def local(self) -> tuple[np.ndarray, Chunk]:
        """The features that the chunk holds, and the chunk with their places instead."""
        held = np.bincount(self.idx) > 0
        place = (np.cumsum(held) - 1).astype(np.int32)
        return np.flatnonzero(held), Chunk(self.row, place[self.idx], self.value, self.label, self.fold)

    def turn(self) -> None:
        """Lay the cells in order of feature as well, for more products than one."""
        order = np.argsort(self.idx, kind="stable")
        idx = self.idx[order]
        begin = np.flatnonzero(np.diff(idx, prepend=-1))
        self.turned = begin, idx[begin], self.row[order], self.value[order]

    def times(self, vector: np.ndarray) -> np.ndarray:
        # Rows stand in order; one without cells has no stretch.
        return _sums(self.starts, self.held_rows, self.idx, self.value, vector, len(self.label))

    @cached_property
    def starts(self) -> np.ndarray:
        return np.flatnonzero(np.diff(self.row, prepend=-1))

    @cached_property
    def held_rows(self) -> np.ndarray:
        return self.row[self.starts]

    def dense(self, m: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(all columns, labels) of ``BLOCK_ROWS`` rows at a time."""
        for begin in range(0, len(self.label), BLOCK_ROWS):
            label = self.label[begin : begin + BLOCK_ROWS]
            cells = slice(*np.searchsorted(self.row, [begin, begin + len(label)]))
            wide = np.zeros((len(label), m))
            wide[self.row[cells] - begin, self.idx[cells]] = self.value[cells]
            yield wide, label

    def back(self, weights: np.ndarray, m: int) -> np.ndarray:
        if self.turned is not None:
            begin, held, row, value = self.turned
            return _sums(begin, held, row, value, weights, m)
        out = np.zeros(m)
        for part in self.blocks():
            out += np.bincount(self.idx[part], self.value[part] * weights[self.row[part]], m)
        return out


def _sums(
    begin: np.ndarray, held: np.ndarray, place: np.ndarray, value: np.ndarray, vector: np.ndarray, n: int
) -> np.ndarray:
    """Sums of value * vector[place] over the stretches of cells that begin at ``begin``, as entries ``held`` of n."""
    out, ends, at = np.zeros(n), np.append(begin, len(value)), 0
    room = np.empty(min(STRETCH_CELLS, len(value)))
    while at < len(begin):
        # Whole stretches, of STRETCH_CELLS cells if there are several.
        end = max(at + 1, int(np.searchsorted(ends, begin[at] + STRETCH_CELLS, side="right")) - 1)
        low, high = ends[at], ends[end]
        # All places are inside, which "clip" need not check first.
        product = room[: high - low] if high - low <= len(room) else np.empty(high - low)
        np.take(vector, place[low:high], out=product, mode="clip")
        product *= value[low:high]
        out[held[at:end]] = np.add.reduceat(product, begin[at:end] - low)
        at = end
    return out


def _sum_rows(name: str, idx: np.ndarray, columns: list[np.ndarray]) -> pa.Table:
    named = {f"s{i}": pa.array(c, pa.float64()) for i, c in enumerate(columns)}
    return pa.table({"subreddit": pa.array([name] * len(idx), pa.string()), "idx": pa.array(idx, pa.int32()), **named})


def _sums_schema(n: int) -> str:
    return "subreddit string, idx int" + "".join(f", s{i} double" for i in range(n))


def over_chunks(
    rows: DataFrame, sent: DataFrame, n: int, work: Callable[[Chunk, object], tuple[np.ndarray, list[np.ndarray]]],
    load: Callable[[bytes], object] = pickle.loads,
) -> DataFrame:
    """(subreddit, idx, s0, ...): ``work`` of each chunk and what its community was sent, summed.

    ``sent``: (subreddit, chunks, sent), one row per community.
    """

    def run(key: tuple, mine: pa.Table, given: pa.Table) -> pa.Table:
        if not (mine.num_rows and given.num_rows):
            return _sum_rows("", np.zeros(0, np.int32), [np.zeros(0)] * n)
        return _sum_rows(key[0].as_py(), *work(Chunk.of(mine), load(given["sent"][0].as_py())))

    spread = sent.select("subreddit", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "sent")
    keys = ["subreddit", "chunk"]
    parts = rows.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInArrow(run, _sums_schema(n))
    return parts.groupBy("subreddit", "idx").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(n)])


@dataclass
class Systems:
    """The systems of one community: K of them (folds, then all rows), A penalties, m features."""

    alphas: np.ndarray
    mean: np.ndarray  # K x m
    label_mean: np.ndarray  # K
    square: np.ndarray  # m: length of the columns, squared, on all rows
    label_square: float
    residual: np.ndarray  # K x m
    direction: np.ndarray  # K x m
    solution: np.ndarray  # K x A x m
    shifted: np.ndarray  # K x A x m: the directions of the larger penalties
    size: np.ndarray  # K: squared residual
    goal: np.ndarray  # K
    step: np.ndarray  # K: the last step length
    turn: np.ndarray  # K: the last weight of the old direction
    zeta: np.ndarray  # K x A: residual of a penalty relative to that of the smallest
    zeta_before: np.ndarray

    @classmethod
    def start(cls, idx: np.ndarray, sums: np.ndarray, m: int, alphas: Sequence[float]) -> Systems:
        """From the sums of values and of value * label per system, and of squares."""
        k = (sums.shape[1] - 1) // 2
        totals = sums[idx == TOTALS][0]
        dense = np.zeros((m, sums.shape[1]))
        dense[idx[idx != TOTALS]] = sums[idx != TOTALS]
        n = np.maximum(totals[:k], 1.0)
        mean, label_mean = (dense[:, :k] / n).T, totals[k : 2 * k] / n
        right = dense[:, k : 2 * k].T - totals[:k, None] * mean * label_mean[:, None]
        size = (right**2).sum(axis=1)
        shape = (k, len(alphas))
        goal = size * np.append(np.full(k - 1, FOLD_TOLERANCE), TOLERANCE) ** 2
        return cls(
            np.array(alphas, float), mean, label_mean, dense[:, -1], float(totals[-1]), right, right.copy(),
            np.zeros((*shape, m)), np.repeat(right[:, None, :], len(alphas), axis=1), size, goal,
            np.ones(k), np.zeros(k), np.ones(shape), np.ones(shape),
        )

    @property
    def open(self) -> np.ndarray:
        return self.size > self.goal

    def sent(self) -> bytes:
        """Directions of the systems that still move, and what centring takes off each product."""
        direction = self.direction * self.open[:, None]
        return pickle.dumps((direction, (direction * self.mean).sum(axis=1)))

    def advance(self, product: np.ndarray) -> None:
        """One step; ``product`` is X'X times the directions (K x m)."""
        least = self.alphas.min()
        for k in np.flatnonzero(self.open):
            image = product[k] + least * self.direction[k]
            step = self.size[k] / (self.direction[k] @ image)
            zeta, before = self.zeta[k], self.zeta_before[k]
            moving = zeta**2 * self.size[k] > self.goal[k]
            below = step * self.turn[k] * (before - zeta) + before * self.step[k] * (1 + (self.alphas - least) * step)
            after = np.where(moving, zeta * before * self.step[k] / np.where(moving, below, 1.0), zeta)
            ratio = np.where(moving, after / np.where(moving, zeta, 1.0), 0.0)
            self.solution[k] += (step * ratio)[:, None] * self.shifted[k]
            self.residual[k] -= step * image
            size = self.residual[k] @ self.residual[k]
            turn = size / self.size[k]
            moved = after[:, None] * self.residual[k] + (turn * ratio**2)[:, None] * self.shifted[k]
            self.shifted[k] = np.where(moving[:, None], moved, self.shifted[k])
            self.direction[k] = self.residual[k] + turn * self.direction[k]
            self.zeta_before[k], self.zeta[k] = np.where(moving, zeta, before), after
            self.size[k], self.step[k], self.turn[k] = size, step, turn


STATE = "subreddit string, chunks int, m int, open boolean, sent binary, state binary"


def _state_row(name: str, chunks: int, m: int, state: Systems) -> pa.Table:
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary())
    values = (name, chunks, m, bool(state.open.any()), state.sent(), pickle.dumps(state))
    names = [field.split()[0] for field in STATE.split(", ")]
    return pa.table({n: pa.array([v], t) for n, v, t in zip(names, values, kinds, strict=True)})


def _no_state() -> pa.Table:
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary())
    names = [field.split()[0] for field in STATE.split(", ")]
    return pa.table({n: pa.array([], t) for n, t in zip(names, kinds, strict=True)})


def _dense(sums: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    columns = [c for c in sums.column_names if c.startswith("s") and c[1:].isdigit()]
    return sums["idx"].to_numpy(), np.stack([sums[c].to_numpy() for c in columns], axis=1)


def _first_sums(chunk: Chunk, systems: int) -> tuple[np.ndarray, list[np.ndarray]]:
    mask = chunk.trained(systems)
    idx, local = chunk.local()
    columns = [local.back(mask[:, k], len(idx)) for k in range(systems)]
    columns += [local.back(mask[:, k] * chunk.label, len(idx)) for k in range(systems)]
    columns.append(np.bincount(local.idx, chunk.value**2, len(idx)))
    totals = [*mask.sum(axis=0), *(mask * chunk.label[:, None]).sum(axis=0), (chunk.label**2).sum()]
    return np.append(idx, TOTALS), [np.append(c, t) for c, t in zip(columns, totals, strict=True)]


def _product(chunk: Chunk, given: tuple) -> tuple[np.ndarray, list[np.ndarray]]:
    directions, offsets = given
    mask = chunk.trained(len(directions))
    idx, local = chunk.local()
    return idx, [
        local.back((chunk.times(d) - c) * mask[:, k], len(idx)) if d.any() else np.zeros(len(idx))
        for k, (d, c) in enumerate(zip(directions, offsets, strict=True))
    ]


def _fold_errors(chunk: Chunk, state: Systems) -> tuple[np.ndarray, list[np.ndarray]]:
    """Squared errors of each penalty on the rows that a fold left out."""
    errors = np.zeros(len(state.alphas))
    for fold in range(len(state.label_mean) - 1):
        out = chunk.fold == fold
        for a, w in enumerate(state.solution[fold]):
            guess = chunk.times(w) - state.mean[fold] @ w + state.label_mean[fold]
            errors[a] += ((chunk.label - guess)[out] ** 2).sum()
    return np.array([TOTALS]), [np.array([e]) for e in errors]


def _slopes(chunk: Chunk, given: tuple) -> tuple[np.ndarray, list[np.ndarray]]:
    """Per feature, the sum of value * (what the solution leaves of the label)."""
    weights, intercept = given
    idx, local = chunk.local()
    return idx, [local.back(chunk.label - chunk.times(weights) - intercept, len(idx))]


def _solved_here(mine: Chunk, m: int, systems: int, alphas: Sequence[float]) -> Systems:
    """All steps of a community whose rows are one chunk."""
    idx, columns = _first_sums(mine, systems)
    state = Systems.start(idx, np.stack(columns, axis=1), m, alphas)
    image = _image_of_few(mine, m, state) if m <= GRAM_FEATURES else _image_of_rows(mine, m, state)
    for _ in range(MAX_STEPS):
        if not state.open.any():
            return state
        product = np.zeros((systems, m))
        for k in np.flatnonzero(state.open):
            product[k] = image(k, state.direction[k])
        state.advance(product)
    raise RuntimeError(f"no optimum after {MAX_STEPS} steps")


def _image_of_rows(mine: Chunk, m: int, state: Systems) -> Callable[[int, np.ndarray], np.ndarray]:
    """X'X of a system times a direction, by the rows and back."""
    mask = mine.trained(len(state.mean))
    mine.turn()

    def image(k: int, p: np.ndarray) -> np.ndarray:
        return mine.back((mine.times(p) - p @ state.mean[k]) * mask[:, k], m)

    return image


def _image_of_few(mine: Chunk, m: int, state: Systems) -> Callable[[int, np.ndarray], np.ndarray]:
    """The same for few features, whose products with each other are summed once, per fold."""
    systems = len(state.mean)
    grams = np.zeros((systems, m, m))
    for begin in range(0, len(mine.label), BLOCK_ROWS):
        fold = mine.fold[begin : begin + BLOCK_ROWS]
        cells = slice(*np.searchsorted(mine.row, [begin, begin + len(fold)]))
        # A feature that a row holds twice counts twice.
        place = (mine.row[cells] - begin).astype(np.int64) * m + mine.idx[cells]
        wide = np.bincount(place, mine.value[cells], len(fold) * m).reshape(len(fold), m)
        for k in range(systems):
            held = (wide if k == systems - 1 else wide[fold != k]) - state.mean[k]
            grams[k] += held.T @ held
    return lambda k, p: grams[k] @ p


def solve(rows: DataFrame, sizes: DataFrame, alphas: Sequence[float], folds: int) -> DataFrame:
    """The solved systems of every community: rows of ``STATE``."""
    systems = folds + 1

    def here(key: tuple, mine: pa.Table, size: pa.Table) -> pa.Table:
        if not (mine.num_rows and size.num_rows):
            return _no_state()
        m = size["m"][0].as_py()
        return _state_row(key[0].as_py(), 1, m, _solved_here(Chunk.of(mine), m, systems, alphas))

    def begin(key: tuple, size: pa.Table, sums: pa.Table) -> pa.Table:
        m = size["m"][0].as_py()
        return _state_row(key[0].as_py(), size["chunks"][0].as_py(), m, Systems.start(*_dense(sums), m, alphas))

    def step(key: tuple, old: pa.Table, sums: pa.Table) -> pa.Table:
        if not sums.num_rows:
            return old
        state, m = pickle.loads(old["state"][0].as_py()), old["m"][0].as_py()
        product = np.zeros((systems, m))
        idx, values = _dense(sums)
        product[:, idx] = values.T
        state.advance(product)
        return _state_row(key[0].as_py(), old["chunks"][0].as_py(), m, state)

    def moved(left: DataFrame, sums: DataFrame, work: Callable) -> DataFrame:
        return cut_lineage(left.groupBy("subreddit").cogroup(sums.groupBy("subreddit")).applyInArrow(work, STATE))

    keys = ["subreddit", "chunk"]
    single = sizes.filter("chunks = 1").withColumn("chunk", F.lit(0))
    done = cut_lineage(rows.groupBy(*keys).cogroup(single.groupBy(*keys)).applyInArrow(here, STATE))
    large = sizes.filter("chunks > 1")
    if large.isEmpty():
        return done
    every = large.withColumn("sent", F.lit(pickle.dumps(systems)))
    state = moved(large, over_chunks(rows, every, 2 * systems + 1, _first_sums), begin)
    for at in range(MAX_STEPS):
        open_ones = state.filter("open")
        if at % LOOK_EVERY == 0 and open_ones.select("open").isEmpty():
            return done.unionByName(state)
        state = moved(state, over_chunks(rows, open_ones, systems, _product), step)
    raise RuntimeError(f"no optimum after {MAX_STEPS} steps")


def choose_by_folds(rows: DataFrame, state: DataFrame, alphas: Sequence[float]) -> DataFrame:
    """(subreddit, alpha, error) with the least squared error over the folds, ties to the smaller."""
    sent = state.select("subreddit", "chunks", F.col("state").alias("sent"))
    return _least(over_chunks(rows, sent, len(alphas), _fold_errors), alphas)


def _least(errors: DataFrame, alphas: Sequence[float]) -> DataFrame:
    """(subreddit, alpha, error): the penalty of the least error sum, ties to the smaller one."""
    ways = [
        F.struct(F.when(F.isnan(f"s{i}"), None).otherwise(F.col(f"s{i}")).alias("error"), F.lit(float(a)).alias("alpha"))
        for i, a in enumerate(alphas)
    ]
    best = F.array_min(F.array(*ways))
    return errors.select("subreddit", best["alpha"].alias("alpha"), best["error"].alias("error"))


def _products(chunk: Chunk, m: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sums of products of the columns [1, features, label] with each other, upper triangle."""
    total = np.zeros((m + 2, m + 2))
    for wide, label in chunk.dense(m):
        columns = np.column_stack([np.ones(len(wide)), wide, label])
        total += columns.T @ columns
    i, j = np.triu_indices(m + 2)
    return i * (m + 2) + j, [total[i, j]]


@dataclass
class Factors:
    """Centre and eigenvectors of a community's X'X, with the right side in their terms."""

    n: float
    mean: np.ndarray
    label_mean: float
    axes: np.ndarray
    lengths: np.ndarray
    right: np.ndarray
    alphas: np.ndarray


def _left_out_errors(chunk: Chunk, given: Factors) -> tuple[np.ndarray, list[np.ndarray]]:
    """Per penalty, the squared errors that each row would have had without it: with the hat matrix H,
    residual / (1 - H_ii)."""
    errors = np.zeros(len(given.alphas))
    for wide, label in chunk.dense(len(given.mean)):
        turned = (wide - given.mean) @ given.axes
        for a, alpha in enumerate(given.alphas):
            inverse = 1 / (given.lengths + alpha)
            leverage = 1 / given.n + turned**2 @ inverse
            rest = label - given.label_mean - turned @ (inverse * given.right)
            errors[a] += ((rest / (1 - leverage)) ** 2).sum()
    return np.array([TOTALS]), [np.array([e]) for e in errors]


#: Features up to which a community's X'X is factored for the leave-one-out choice.
LOO_FEATURES = 512


def choose_by_leaving_out(rows: DataFrame, sizes: DataFrame, alphas: Sequence[float]) -> DataFrame:
    """(subreddit, alpha, error): the penalty with the least squared leave-one-out error, exact.

    Two passes: products of the columns, whose factors are found per community, then one error a row.
    Raises above ``LOO_FEATURES`` features: those communities choose by folds. A community of one row
    has no such error and takes the smallest penalty.
    """
    most = sizes.agg(F.max("m")).first()[0]
    if most is not None and most > LOO_FEATURES:
        raise ValueError(f"{most} features are too many to factor; choose the penalty by folds")

    def pack(value: object) -> pa.Table:
        return pa.array([pickle.dumps(value)], pa.binary())

    def factor(key: tuple, size: pa.Table, sums: pa.Table) -> pa.Table:
        m = size["m"][0].as_py()
        table = np.zeros((m + 2, m + 2))
        table.flat[sums["idx"].to_numpy()] = sums["s0"].to_numpy()
        n, mean, label_mean = table[0, 0], table[0, 1:-1] / table[0, 0], table[0, -1] / table[0, 0]
        inner = np.triu(table[1:-1, 1:-1])
        inner = inner + np.triu(inner, 1).T - n * np.outer(mean, mean)
        lengths, axes = np.linalg.eigh(inner)
        right = axes.T @ (table[1:-1, -1] - n * mean * label_mean)
        sent = Factors(n, mean, label_mean, axes, np.maximum(lengths, 0), right, np.array(alphas, float))
        return pa.table({
            "subreddit": pa.array([key[0].as_py()], pa.string()), "chunks": pa.array([size["chunks"][0].as_py()], pa.int32()),
            "sent": pack(sent),
        })

    asked = sizes.select("subreddit", "chunks", "m")
    products = over_chunks(rows, asked.withColumn("sent", F.col("m").cast("string").cast("binary")), 1, _products, int)
    factors = cut_lineage(
        asked.groupBy("subreddit").cogroup(products.groupBy("subreddit"))
        .applyInArrow(factor, "subreddit string, chunks int, sent binary")
    )
    return _least(over_chunks(rows, factors, len(alphas), _left_out_errors), alphas)


COEFFICIENTS = "subreddit string, idx int, coef double, square double, labels double"


def coefficients(state: DataFrame, best: DataFrame) -> DataFrame:
    """(subreddit, idx, coef, square, labels) of the system on all rows at the chosen penalty; the
    intercept has no idx."""

    def rows(key: tuple, mine: pa.Table) -> pa.Table:
        state = pickle.loads(mine["state"][0].as_py())
        w = state.solution[-1][int(np.argmin(np.abs(state.alphas - mine["alpha"][0].as_py())))]
        m = len(w)
        coef = np.append(w, state.label_mean[-1] - state.mean[-1] @ w)
        return pa.table({
            "subreddit": pa.array([key[0].as_py()] * (m + 1), pa.string()), "idx": pa.array([*range(m), None], pa.int32()),
            "coef": coef, "square": np.append(state.square, 0.0), "labels": np.full(m + 1, state.label_square),
        })

    chosen = state.join(best, "subreddit").select("subreddit", "state", "alpha")
    return chosen.groupBy("subreddit").applyInArrow(rows, COEFFICIENTS)


def gradients(rows: DataFrame, sizes: DataFrame, coefs: DataFrame) -> DataFrame:
    """(subreddit, idx, slope) of the squared error at the coefficients, from the rows themselves."""

    def pack(key: tuple, mine: pa.Table) -> pa.Table:
        idx, coef = mine["idx"].to_pylist(), mine["coef"].to_numpy()
        weights = np.zeros(len(idx) - 1)
        for i, c in zip(idx, coef, strict=True):
            if i is not None:
                weights[i] = c
        sent = pickle.dumps((weights, float(coef[idx.index(None)])))
        return pa.table({"subreddit": pa.array([key[0].as_py()], pa.string()), "sent": pa.array([sent], pa.binary())})

    packed = coefs.groupBy("subreddit").applyInArrow(pack, "subreddit string, sent binary")
    return over_chunks(rows, packed.join(sizes, "subreddit"), 1, _slopes).withColumnRenamed("s0", "slope")


def fit(
    labelled: DataFrame, space: DataFrame, alphas: Sequence[float], folds: int,
    analyzer: str | None = "word", embedding: str | None = None, intercept_factor: float = 1.0,
) -> DataFrame:
    """``space`` with coef, the chosen alpha, and the gradient left at each feature, relative to the
    lengths of its column and of the labels. ``folds`` 0 chooses the penalty by leaving out each row."""
    let_workers_import(labelled.sparkSession)
    indexed = cut_lineage(with_local_index(space))
    folds = folds if len(alphas) > 1 else 0
    rows, sizes = row_chunks(labelled, indexed, folds, analyzer, embedding)
    try:
        state = solve(rows, sizes, alphas, folds)
        if folds:
            best = cut_lineage(choose_by_folds(rows, state, alphas).select("subreddit", "alpha"))
        elif len(alphas) > 1:
            best = cut_lineage(choose_by_leaving_out(rows, sizes, alphas).select("subreddit", "alpha"))
        else:
            best = sizes.select("subreddit", F.lit(float(alphas[0])).alias("alpha"))
        coefs = cut_lineage(coefficients(state, best))
        slopes = cut_lineage(gradients(rows, sizes, coefs))
    finally:
        rows.unpersist()
    keys = ["subreddit", F.coalesce("idx", F.lit(TOTALS)).alias("idx")]
    solved = coefs.select(*keys, "coef", "square", "labels").join(slopes, ["subreddit", "idx"], "left").join(best, "subreddit")
    slope = F.coalesce("slope", F.lit(0.0)) - F.col("alpha") * F.col("coef")
    length = F.sqrt(F.col("square") + F.col("alpha")) * F.sqrt("labels")
    left = F.when((F.col("kind") != "i") & (length > 0), F.abs(slope) / length).otherwise(0.0)
    coef = F.when(F.col("kind") == "i", F.col("coef") / intercept_factor).otherwise(F.col("coef"))
    numbered = indexed.withColumn("idx", F.coalesce("idx", F.lit(TOTALS)))
    return numbered.join(solved, ["subreddit", "idx"]).select(
        *SPACE_COLUMNS, coef.alias("coef"), "alpha", left.alias("gradient")
    )


def compare_choices(
    labelled: DataFrame, space: DataFrame, alphas: Sequence[float], folds: int,
    analyzer: str | None = None, embedding: str | None = None,
) -> DataFrame:
    """Per community: the penalty chosen by leaving out each row and the one chosen by folds, with the
    sums of squared errors that they have there."""
    let_workers_import(labelled.sparkSession)
    indexed = cut_lineage(with_local_index(space))
    rows, sizes = row_chunks(labelled, indexed, folds, analyzer, embedding)
    try:
        left_out = cut_lineage(choose_by_leaving_out(rows, sizes, alphas))
        by_folds = cut_lineage(choose_by_folds(rows, solve(rows, sizes, alphas, folds), alphas))
    finally:
        rows.unpersist()
    return left_out.select("subreddit", F.col("alpha").alias("loo_alpha"), F.col("error").alias("loo_error")).join(
        by_folds.select("subreddit", F.col("alpha").alias("fold_alpha"), F.col("error").alias("fold_error")), "subreddit"
    ).withColumn("same", F.col("loo_alpha") == F.col("fold_alpha"))
