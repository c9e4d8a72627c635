"""Pairs of a group that two values order alike, counted without listing a pair.

Within a task the pairs are counted by the bits of their ranks: two ranks differ first in one bit, and at
each bit a sort and a running sum count the pairs that part there. Many groups share a task.

Rows are shuffled once, by group. A row may be in many slots of its group, first in some and second in others;
the slots are bits of two numbers, and are only told apart inside a task.

A group of more than ``BLOCK_ROWS`` rows is cut by quantiles of either value, slot by slot. A pair is in one
block of x, or in one block of y and two of x, or in two of both; each case is a count of its own over
tasks that hold a block, so no task holds a hot group. Cuts need only keep the order, so approximate
quantiles give exact counts.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titlegauge.operators.joins import lookup_join
from titlegauge.operators.title_cells import codes as group_codes
from titlegauge.session import cut_lineage, let_workers_import

#: Rows of a group up to which one task counts it, cuts of a larger one, and rows that a task unfolds at once.
BLOCK_ROWS, CUTS, STEP_ROWS = 50_000, 63, 50_000
#: Numbers that groups are counted by at first: a group is no larger than what shares its number.
COUNT_BUCKETS = 1 << 16
#: Slots that fit a number.
SLOTS = 63


def count_ordered(group: np.ndarray, x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Per group 0 .. max: the sum of a_i * b_j over its pairs with x_i > x_j and y_i > y_j."""
    total = np.zeros(int(group.max()) + 1 if len(group) else 0)
    x, y = (np.unique(v, return_inverse=True)[1] for v in (x, y))
    # Ranks within the group: their bits are few where groups are small.
    order = np.lexsort((x, group))
    g, value = group[order], x[order]
    new = np.r_[True, g[1:] != g[:-1]][: len(g)]
    step = np.cumsum(new | np.r_[True, value[1:] != value[:-1]][: len(g)])
    x[order] = step - np.repeat(step[new], np.diff(np.flatnonzero(new), append=len(g)))
    for bit in range(int(x.max()).bit_length() if len(x) else 0):
        # Pairs whose x ranks part at this bit have the higher bits in common.
        order = np.lexsort((-y, x >> (bit + 1), group))
        g, block, rank = group[order], (x >> (bit + 1))[order], y[order]
        upper = (x[order] >> bit & 1).astype(bool)
        before = np.concatenate([[0.0], np.cumsum(np.where(upper, a[order], 0))])
        new = np.r_[True, (g[1:] != g[:-1]) | (block[1:] != block[:-1])]
        tie = new | np.r_[True, rank[1:] != rank[:-1]]
        places = np.arange(len(g))
        begin = np.maximum.accumulate(np.where(new, places, 0))
        above = np.maximum.accumulate(np.where(tie, places, 0))
        found = np.where(upper, 0, b[order] * (before[above] - before[begin]))
        total += np.bincount(g, found, len(total))
    return total


def _counted(cells: DataFrame, unit: Sequence[str], keys: Sequence[str], x: str, y: str) -> DataFrame:
    """(keys, pairs) over units that each fit a task."""
    folded = cells.groupBy(*dict.fromkeys([*unit, *keys]), F.col(x).alias("x"), F.col(y).alias("y")).agg(
        F.sum("a").alias("a"), F.sum("b").alias("b")
    )
    tasks = F.lit(max(1, folded.sparkSession.sparkContext.defaultParallelism))
    spread = F.pmod(F.xxhash64(*unit), tasks * F.lit(16))
    schema = folded.select(*keys).schema

    def run(rows: pa.Table) -> pa.Table:
        codes = rows.select(list(unit)).to_pandas().groupby(list(unit), dropna=False, sort=False).ngroup().to_numpy()
        first = np.unique(codes, return_index=True)[1]
        pairs = count_ordered(codes, *(rows[c].to_numpy().astype(float) for c in ("x", "y", "a", "b")))
        named = rows.select(list(keys)).take(pa.array(first))
        return named.append_column("pairs", pa.array(np.rint(pairs).astype(np.int64)))

    return folded.withColumn("_task", spread).groupBy("_task").applyInArrow(
        lambda rows: run(rows), schema.add("pairs", "long")
    )


def _unfolded(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, slot, a, b) of every slot that a row is in."""
    slots = np.arange(SLOTS)
    row, slot = np.nonzero((first | second)[:, None] >> slots & 1)
    return row, slot, first[row] >> slot & 1, second[row] >> slot & 1


def _whole_groups(cells: DataFrame, keys: list[str], masked: bool) -> DataFrame:
    """(keys, pairs) of groups that each fit a task; with slots (keys, slotted, pairs), where there are any."""
    tasks = F.lit(max(1, cells.sparkSession.sparkContext.defaultParallelism))
    spread = F.pmod(F.xxhash64(*keys), tasks * F.lit(16))
    schema = cells.select(*keys).schema
    schema = (schema.add("slotted", "boolean") if masked else schema).add("pairs", "long")

    def run(rows: pa.Table) -> pa.Table:
        codes, firsts = group_codes(rows, keys)
        order = np.argsort(codes, kind="stable")
        sorted_codes = codes[order]
        x, y = (rows[c].to_numpy().astype(float) for c in ("_x", "_y"))
        a, b = (rows[c].to_numpy().astype(np.int64) for c in ROLES[masked])
        pairs = np.zeros((2, len(firsts)))
        begin = 0
        while begin < len(order):
            # Whole groups, of STEP_ROWS rows if there are several.
            end = min(begin + STEP_ROWS, len(order))
            if end < len(order):
                end = np.searchsorted(sorted_codes, sorted_codes[end])
            if end <= begin:
                end = np.searchsorted(sorted_codes, sorted_codes[begin], side="right")
            mine = order[begin:end]
            code = codes[mine]
            if masked:
                row, slot, first, second = _unfolded(a[mine], b[mine])
                unit, place = np.unique(code[row] * SLOTS + slot, return_inverse=True)
                found = count_ordered(place, x[mine][row], y[mine][row], first, second)
                np.add.at(pairs, ((unit % SLOTS > 0).astype(int), unit // SLOTS), found)
            else:
                low = code[0]
                found = count_ordered(code - low, x[mine], y[mine], a[mine], b[mine])
                pairs[0, low : low + len(found)] += found
            begin = end
        named = rows.select(keys)
        if not masked:
            return named.take(pa.array(firsts)).append_column("pairs", pa.array(np.rint(pairs[0]).astype(np.int64)))
        slotted, at = np.nonzero(pairs)
        named = named.take(pa.array(firsts[at])).append_column("slotted", pa.array(slotted.astype(bool)))
        return named.append_column("pairs", pa.array(np.rint(pairs[slotted, at]).astype(np.int64)))

    return cells.withColumn("_task", spread).groupBy("_task").applyInArrow(lambda rows: run(rows), schema)


def _large_groups(cells: DataFrame, keys: list[str]) -> DataFrame | None:
    """The keys of groups above ``BLOCK_ROWS`` rows; none is counted by its keys unless a bucket is as large."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(COUNT_BUCKETS))
    counted = cells.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
    held = [r["_bucket"] for r in counted.filter(F.col("_n") > BLOCK_ROWS).select("_bucket").collect()]
    if not held:
        return None
    inside = cells if len(held) > COUNT_BUCKETS // 64 else cells.filter(bucket.isin(held))
    return cut_lineage(inside.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > BLOCK_ROWS).select(*keys))


#: What a row counts for as first and as second of a pair: numbers, or with slots the bits of those it is in.
ROLES = (("a", "b"), ("first", "second"))


def ordered_pairs(cells: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """(keys, pairs): the number of pairs (i, j) of a group with x_i > x_j and y_i > y_j, weighted by
    a_i * b_j. ``cells``: keys, two values, and the counts ``a`` and ``b`` of either role.

    With ``first`` and ``second`` instead, the bits of the slots in which a row has that role, a pair counts once
    per slot where it has both roles: (keys, slotted, pairs), ``slotted`` false for slot 0 and true for the sum
    over the others, where there are pairs.
    """
    let_workers_import(cells.sparkSession)
    keys, masked = list(keys), "first" in cells.columns
    cells = cells.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), *ROLES[masked])
    large = _large_groups(cells, keys)
    if large is None:
        return _whole_groups(cells, keys, masked)
    small = _whole_groups(lookup_join(cells, large, keys, how="left_anti"), keys, masked)
    hot = lookup_join(cells, large, keys, how="left_semi")
    if not masked:
        return small.unionByName(_in_blocks(hot, keys))
    slots = hot.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))))
    slots = slots.withColumns({"a": _bit("first"), "b": _bit("second")}).filter("a + b > 0").drop(*ROLES[True])
    found = _in_blocks(slots, [*keys, "slot"]).withColumn("slotted", F.col("slot") > 0)
    return small.unionByName(found.groupBy(*keys, "slotted").agg(F.sum("pairs").alias("pairs")).filter("pairs > 0"))


def _bit(name: str) -> Column:
    return F.expr(f"shiftrightunsigned({name}, slot) & 1")


def _in_blocks(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pairs) of groups of any size, cut into blocks where they are large."""
    parts = [(i + 1) / (CUTS + 1) for i in range(CUTS)]
    large = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > BLOCK_ROWS)
    cuts = (
        cells.join(large, keys, "left_semi").groupBy(*keys)
        .agg(F.percentile_approx("_x", parts).alias("_xs"), F.percentile_approx("_y", parts).alias("_ys"))
    )
    cut = lookup_join(cells, cuts, keys, how="left", spread=["_x", "_y"])

    def block(value: str, at: str):
        return F.coalesce(F.size(F.filter(at, lambda c: c < F.col(value))), F.lit(0))

    cut = cut.withColumns({
        "_xb": F.when(F.col("_xs").isNull(), 0).otherwise(block("_x", "_xs")),
        "_yb": F.when(F.col("_ys").isNull(), 0).otherwise(block("_y", "_ys")),
    })
    several = cut.filter(F.col("_xs").isNotNull())
    found = (
        _counted(cut, [*keys, "_xb"], keys, "_x", "_y")
        .unionByName(_counted(several, [*keys, "_yb"], keys, "_xb", "_y"))
        .unionByName(_counted(several, keys, keys, "_xb", "_yb"))
    )
    return found.groupBy(*keys).agg(F.sum("pairs").alias("pairs"))
