"""Order statistics of the ratios of all pairs of a group, found without listing a pair.

The k-th smallest of all ratios is the least double that at least k + 1 pairs do not exceed. How many
pairs do not exceed a bound is a sweep: sorted by value, each cell looks up how much weight of its group
lies between its own value and the bound times it. Positive doubles are ordered like their bits, so the
interval that holds the answer is cut into ``PIECES`` by bits until one double is left: some twelve
sweeps whatever the number of pairs. Several positions advance in the same sweeps. A group of few cells
is cheaper pair by pair: its ratios are made in the task and counted between the bounds; if no group is
larger, bounds cost next to nothing and the interval is cut into ``FINE_PIECES``.

Two posts are time-matched if both are on a weekend or both are not and their hours are near on the
24-hour circle: a cell looks up the classes (hour, weekend) within reach of its own.

Sums over pairs of blocks add up, so a group of more than ``BLOCK_ROWS`` cells is cut into blocks on
both sides and no task holds a hot group.
"""

from __future__ import annotations

from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titlegauge.functions.values import TIME_MATCH_HOURS
from titlegauge.operators.joins import lookup_join
from titlegauge.session import cut_lineage, let_workers_import

#: Cells of a group above which it is cut, cells of a task, and parts of an interval per sweep.
BLOCK_ROWS, TASK_ROWS, PIECES = 100_000, 200_000, 32
#: Cells of a group up to which its pairs are made one by one, and parts of an interval if no group has more.
PAIR_ROWS, FINE_PIECES = 256, 2_048
HOURS, CLASSES = 24, 48
UNIT = ["u1", "u2"]


class Sweep:
    """The cells of one task, sorted by unit, class and value, with running weights."""

    def __init__(self, unit, sign, x, time_class, n, as_a, as_b):
        self.sign, self.x, self.n = sign[as_a], x[as_a], n[as_a]
        self.unit, self.time_class = unit[as_a], time_class[as_a]
        self.values = np.unique(x[as_b])
        self.width = len(self.values) + 1
        place = np.searchsorted(self.values, x[as_b])
        self.whole = self._running(unit[as_b], place, n[as_b])
        timed = time_class[as_b] >= 0
        self.by_class = self._running((unit[as_b] * CLASSES + time_class[as_b])[timed], place[timed], n[as_b][timed])
        # Where each class within reach lies, for cells that have a time.
        self.timed = self.time_class >= 0
        hour, weekend = self.time_class % HOURS, self.time_class // HOURS
        steps = range(-TIME_MATCH_HOURS, TIME_MATCH_HOURS + 1)
        self.near = [(self.unit * CLASSES + (hour + d) % HOURS + HOURS * weekend)[self.timed] for d in steps]
        self.low = np.searchsorted(self.values, self.x, side="left")
        self.high = np.searchsorted(self.values, self.x, side="right")

    def _running(self, key, place, n):
        order = np.argsort(key * self.width + place, kind="stable")
        return (key * self.width + place)[order], np.concatenate([[0], np.cumsum(n[order])])

    def _weight(self, table, key, upto):
        """Weight of the key's cells among the first ``upto`` values."""
        keys, sums = table
        return sums[np.searchsorted(keys, key * self.width + upto)]

    def _limit(self, bound: float) -> np.ndarray:
        """How many values v have v / x <= bound, as the division rounds, for each cell."""
        own, back = np.unique(self.x, return_inverse=True)
        at = np.searchsorted(self.values, np.minimum(own * bound, np.finfo(float).max), side="right")
        last = len(self.values) - 1
        if last >= 0:
            more = (at <= last) & (self.values[np.minimum(at, last)] / own <= bound)
            fewer = (at > 0) & (self.values[np.maximum(at - 1, 0)] / own > bound)
            at = at + more - fewer
        return at[back]

    def twice_pairs(self, bounds: list[float], matched: bool) -> list[int]:
        """Signed: twice the pairs of different values within each bound, and the ordered equal ones
        (each cell with itself too)."""
        on = self.timed if matched else slice(None)
        table, keys = (self.by_class, self.near) if matched else (self.whole, [self.unit])
        weight = self.sign[on] * self.n[on]
        below = sum(self._weight(table, k, self.low[on]) for k in keys)
        equal = sum(self._weight(table, k, self.high[on]) for k in keys)
        out = []
        for bound in bounds:
            upto = np.maximum(self._limit(bound)[on], self.high[on])
            within = sum(self._weight(table, k, upto) for k in keys)
            out.append(int((weight * (2 * within - equal - below)).sum()))
        return out


def _near_classes() -> np.ndarray:
    """Whether two time classes match; the last row and column (-1) are cells without a time."""
    hour, weekend = np.arange(CLASSES) % HOURS, np.arange(CLASSES) // HOURS
    gap = np.abs(hour[:, None] - hour)
    near = np.zeros((CLASSES + 1, CLASSES + 1), bool)
    near[:-1, :-1] = (np.minimum(gap, HOURS - gap) <= TIME_MATCH_HOURS) & (weekend[:, None] == weekend)
    return near


class FewCells:
    """The cells of a task's small units, whose pairs are made one by one: each cell meets the next of its
    unit, then the next but one, and so on."""

    def __init__(self, unit, sign, x, time_class, n):
        order = np.lexsort((x, unit))
        self.unit, self.sign, self.x, self.n = unit[order], sign[order], x[order], n[order]
        self.time_class = time_class[order]
        self.near = _near_classes()

    def twice_pairs(self, bounds: list[list[float]]) -> list[list[int]]:
        """As ``Sweep.twice_pairs``, for the bounds of all pairs and those of the time-matched ones."""
        asked = [np.unique(np.array(b, float)) for b in bounds]
        # Sums of doubles are exact up to 2^53.
        kind = float if float(self.n.sum()) ** 2 < 2**52 else object
        found = [np.zeros(len(a) + 1, kind) for a in asked]
        selves = [int((self.sign * self.n * self.n)[on].sum()) for on in (slice(None), self.time_class >= 0)]
        first, step = np.arange(len(self.x)), 0
        while len(first):
            step += 1
            first = first[first + step < len(self.x)]
            first = first[self.unit[first] == self.unit[first + step]]
            ratio = self.x[first + step] / self.x[first]
            weight = 2 * self.sign[first] * self.n[first] * self.n[first + step]
            matched = self.near[self.time_class[first], self.time_class[first + step]]
            for i, on in enumerate((slice(None), matched)):
                place = np.searchsorted(asked[i], ratio[on], side="left")
                if kind is float:
                    found[i] += np.bincount(place, weight[on], len(found[i]))
                else:
                    np.add.at(found[i], place, weight[on].astype(object))
        out = []
        for b, a, part, own in zip(bounds, asked, found, selves, strict=True):
            upto = np.cumsum(part)
            out.append([int(upto[i]) + own for i in np.searchsorted(a, b)])
        return out


def _twice_pairs(rows: pa.Table, bounds: list[list[float]]) -> list[list[int]]:
    """For each of (all, time-matched), the signed pairs of a task within each bound, as counted by ``Sweep``."""
    u1, u2 = (rows[c].to_numpy() for c in UNIT)
    order = np.lexsort((u2, u1))
    new = np.r_[True, (np.diff(u1[order]) != 0) | (np.diff(u2[order]) != 0)][: len(order)]
    unit = np.empty(len(order), np.int64)
    unit[order] = np.cumsum(new) - 1
    columns = [unit, *(rows[c].to_numpy() for c in ("sign", "x", "time_class", "n"))]
    as_a, as_b = rows["as_a"].to_numpy(), rows["as_b"].to_numpy()
    few = (np.bincount(unit) <= PAIR_ROWS)[unit] & as_a & as_b
    out = FewCells(*[c[few] for c in columns]).twice_pairs(bounds)
    if not few.all():
        sweep = Sweep(*[c[~few] for c in columns], as_a[~few], as_b[~few])
        more = [sweep.twice_pairs(b, matched) for b, matched in zip(bounds, (False, True), strict=True)]
        out = [[p + q for p, q in zip(*parts, strict=True)] for parts in zip(out, more, strict=True)]
    return out


class PairRatios:
    """Pairs of cells that share their keys, signed: ``tables`` are (cells, keys, sign), and the cells have
    ``x`` (a positive double), ``time_class`` (hour + 24 for a weekend, -1 unknown) and ``n``, the posts."""

    def __init__(self, tables: list[tuple[DataFrame, list[str], int]]):
        named = None
        for cells, keys, sign in tables:
            part = cells.select(
                F.xxhash64(F.lit(1), *keys).alias("u1"), F.xxhash64(F.lit(2), *keys).alias("u2"),
                F.lit(sign).cast("long").alias("sign"), F.col("x").cast("double").alias("x"),
                F.col("time_class").cast("long").alias("time_class"), F.col("n").cast("long").alias("n"),
            )
            named = part if named is None else named.unionByName(part)
        let_workers_import(named.sparkSession)
        self.cells = cut_lineage(named)
        summary = self.cells.agg(
            F.min("x").alias("low"), F.max("x").alias("high"), F.count(F.lit(1)).alias("rows"),
            F.sum(F.col("sign") * F.col("n")).alias("all"),
            F.sum(F.when(F.col("time_class") >= 0, F.col("sign") * F.col("n"))).alias("matched"),
        ).first()
        self.widest = (summary["high"] or 1.0) / (summary["low"] or 1.0)
        self.selves = {False: summary["all"] or 0, True: summary["matched"] or 0}
        self.dealt = self._dealt(summary["rows"])

    def _dealt(self, rows: int) -> DataFrame:
        counted = self.cells.groupBy(*UNIT, "sign").agg(F.count(F.lit(1)).alias("_n"))
        sizes = cut_lineage(counted.filter(F.col("_n") > min(PAIR_ROWS, BLOCK_ROWS)))
        self.pieces = FINE_PIECES if sizes.isEmpty() else PIECES
        cuts = sizes.filter(F.col("_n") > BLOCK_ROWS).select(
            *UNIT, "sign", F.ceil(F.col("_n") / BLOCK_ROWS).cast("long").alias("_blocks")
        )
        cut = lookup_join(self.cells, cuts, [*UNIT, "sign"], how="left", spread=["x", "time_class"])
        whole = cut.filter(F.col("_blocks").isNull()).select(
            *self.cells.columns, F.lit(True).alias("as_a"), F.lit(True).alias("as_b"),
            F.lit(0).cast("long").alias("a_block"), F.lit(0).cast("long").alias("b_block"),
        )
        own = F.pmod(F.xxhash64("x", "time_class"), F.col("_blocks"))
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))
        large = cut.filter(F.col("_blocks").isNotNull()).withColumn("_own", own)
        sides = [
            large.withColumn("_every", every).select(
                *self.cells.columns, F.lit(role == "a").alias("as_a"), F.lit(role == "b").alias("as_b"),
                F.col("_own" if role == "a" else "_every").alias("a_block"),
                F.col("_every" if role == "a" else "_own").alias("b_block"),
            )
            for role in "ab"
        ]
        tasks = max(self.cells.sparkSession.sparkContext.defaultParallelism, ceil(rows / TASK_ROWS))
        dealt = whole.unionByName(sides[0]).unionByName(sides[1])
        task = F.pmod(F.xxhash64(*UNIT, "sign", "a_block", "b_block"), F.lit(tasks))
        # Tables and pairs of blocks that share a task stay apart in it.
        apart = F.xxhash64("u2", "sign", "a_block", "b_block")
        return cut_lineage(dealt.withColumns({"_task": task, "u2": apart}).drop("a_block", "b_block"))

    def counts(self, bounds: list[tuple[bool, float]]) -> dict[tuple[bool, float], int]:
        """How many pairs have a ratio within each (time-matched only, bound)."""
        wanted = {m: [b for matched, b in bounds if matched == m] for m in (False, True)}

        def run(rows: pa.Table) -> pa.Table:
            found = _twice_pairs(rows, [wanted[m] for m in (False, True)])
            return pa.table({
                "matched": pa.array([m for m in (False, True) for _ in wanted[m]], pa.bool_()),
                "place": pa.array([i for m in (False, True) for i in range(len(wanted[m]))], pa.int32()),
                "pairs": pa.array([n for part in found for n in part], pa.int64()),
            })

        parts = self.dealt.groupBy("_task").applyInArrow(run, "matched boolean, place int, pairs long")
        out = {key: 0 for key in bounds}
        summed = parts.groupBy("matched", "place").agg(F.sum(F.col("pairs").cast("decimal(38,0)")).alias("pairs"))
        for r in summed.collect():  # one row per bound
            key = (r["matched"], wanted[r["matched"]][r["place"]])
            out[key] = (int(r["pairs"]) - self.selves[r["matched"]]) // 2
        return out

    def medians(self) -> dict[bool, tuple[int, float | None]]:
        """(pairs, median ratio) of all pairs and of the time-matched ones."""
        totals = self.counts([(False, np.inf), (True, np.inf)])
        totals = {m: totals[m, np.inf] for m in (False, True)}
        targets = {(m, k) for m, n in totals.items() if n for k in (floor((n - 1) / 2), ceil((n - 1) / 2))}
        found = self._order_statistics(targets)
        out = {}
        for m, n in totals.items():
            if not n:
                out[m] = (0, None)
                continue
            low, high = found[m, floor((n - 1) / 2)], found[m, ceil((n - 1) / 2)]
            out[m] = (n, low if low == high else low + (high - low) * 0.5)
        return out

    def _order_statistics(self, targets: set[tuple[bool, int]]) -> dict[tuple[bool, int], float]:
        """The ratio at each (time-matched only, position from 0)."""
        inside = {t: (_bits(1.0) - 1, _bits(self.widest)) for t in targets}
        while any(high - low > 1 for low, high in inside.values()):
            cuts: dict[tuple[bool, float], int] = {}
            for (matched, _), (low, high) in inside.items():
                for i in range(1, self.pieces):
                    at = low + (high - low) * i // self.pieces
                    if low < at < high:
                        cuts[matched, _double(at)] = at
            counted = self.counts(sorted(cuts))
            for target in inside:
                matched, k = target
                low, high = inside[target]
                for key, at in cuts.items():
                    if key[0] == matched and low < at < high:
                        low, high = (at, high) if counted[key] <= k else (low, at)
                inside[target] = (low, high)
        return {t: _double(high) for t, (_, high) in inside.items()}


def _bits(value: float) -> int:
    return int(np.float64(value).view(np.int64))


def _double(bits: int) -> float:
    return float(np.int64(bits).view(np.float64))
