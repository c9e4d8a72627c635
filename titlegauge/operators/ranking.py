"""Exact ranks, quantiles and top-n without putting a whole group into one task.

Equal values are counted first (map-side combine). Distinct values then fall into order-keeping
buckets whose number has a fixed bound, so only bucket totals are ever accumulated per group and
the values themselves are ordered inside one bucket at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from titlegauge.operators.joins import lookup_join
from titlegauge.session import cut_lineage

BUCKETS_PER_OCTAVE = 4096
# Above the bucket of every finite number; infinity has it to itself.
TOP_BUCKET = 1 << 40
INDEX_BUCKETS = 4096
# Sampled values that cut the texts of a group into buckets.
SPLITTERS = 255
SPLITTER_SALTS = 16


def order_bucket(value: Column, per_octave: int = BUCKETS_PER_OCTAVE) -> Column:
    """A bucket number that never decreases as ``value`` grows.

    Whole numbers span at most 64 octaves a side, so their bucket count is bounded whatever the
    row count is.
    """
    number = value.cast("double")
    finite = F.floor(F.signum(number) * F.log2(1 + F.abs(number)) * per_octave)
    top = F.lit(TOP_BUCKET)
    return F.when(F.abs(number) == float("inf"), F.signum(number) * top).otherwise(finite).cast("long")


def with_bucket(df: DataFrame, keys: Sequence[str], name: str, out: str) -> DataFrame:
    """Add the order-keeping bucket ``out`` of the column ``name`` within its group.

    Texts of a group are cut by ``SPLITTERS`` of its own values, those lowest in hash order, so the
    buckets are even whatever the texts have in common. The rest of the values needs no order here.
    """
    if not isinstance(df.schema[name].dataType, T.StringType):
        return df.withColumn(out, order_bucket(F.col(name)))
    keys = list(keys)
    known = df.select(*keys, name).filter(F.col(name).isNotNull())
    # Equal values share a hash, so a group of repeats is folded before the sample is taken.
    folded = known.groupBy(*keys, name).agg(F.xxhash64(name).alias("_place"))
    sample = first_n(
        folded, keys, [F.col("_place"), F.col(name)], SPLITTERS, salts=SPLITTER_SALTS, spread=[name]
    )
    cuts = sample.groupBy(*keys).agg(F.sort_array(F.collect_list(name)).alias("_cuts"))
    if keys:
        staged = lookup_join(df, cuts, keys, how="left", spread=[name])
    else:
        staged = df.withColumn("_cuts", cuts.select("_cuts").scalar())
    below = F.size(F.filter("_cuts", lambda cut: cut <= F.col(name)))
    return staged.withColumn(out, F.coalesce(below, F.lit(0)).cast("long")).drop("_cuts")


def first_n(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, salts: int = 1,
    spread: Sequence[str] = ("id",), rank: str | None = None,
) -> DataFrame:
    """The first ``n`` rows of each group in ``order`` (ties must be settled by ``order``).

    ``row_number() <= n`` is pruned in every map task before the shuffle. With ``salts`` > 1 a
    first round ranks inside (group, salt), so the last round sees at most n * salts rows of a
    group however large the group is.
    """
    keys = list(keys)
    staged = df
    if salts > 1:
        salt = F.pmod(F.xxhash64(*spread), F.lit(salts))
        inner = Window.partitionBy(*keys, "_salt").orderBy(*order)
        staged = (
            staged.withColumn("_salt", salt)
            .withColumn("_rn", F.row_number().over(inner))
            .filter(F.col("_rn") <= n)
            .drop("_salt", "_rn")
        )
    name = rank or "_rn"
    ranked = staged.withColumn(
        name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    ).filter(F.col(name) <= n)
    return ranked if rank else ranked.drop(name)


def value_counts(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None):
    """One row per (group, distinct value) with its multiplicity ``n``."""
    count = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(count.alias("n"))


def _bucket_totals(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(group, bucket) with ``_offset`` = rows in lower buckets and ``_total`` = rows in group."""
    before = (
        Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        counts.groupBy(*keys, "_bucket")
        .agg(F.sum("n").alias("_cell"))
        .withColumn("_offset", F.coalesce(F.sum("_cell").over(before), F.lit(0)))
        .withColumn("_total", F.sum("_cell").over(Window.partitionBy(*keys)))
    )


def _rows_below(keys: list[str], value: str) -> Column:
    inside = (
        Window.partitionBy(*keys, "_bucket")
        .orderBy(value)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return F.col("_offset") + F.coalesce(F.sum("n").over(inside), F.lit(0))


def cumulative_counts(counts: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Add ``below`` (rows of the group with a smaller value) and ``total`` to value counts."""
    keys = list(keys)
    bucketed = with_bucket(counts, keys, value, "_bucket")
    totals = _bucket_totals(bucketed, keys).drop("_cell")
    return (
        bucketed.join(totals, [*keys, "_bucket"])
        .withColumn("below", _rows_below(keys, value))
        .withColumnRenamed("_total", "total")
        .drop("_bucket", "_offset")
    )


@dataclass(frozen=True)
class Quantile:
    """Zero-based position in the sorted group as a function of the group size."""

    position: Callable[[Column], Column]


def interpolated(p: float) -> Quantile:
    return Quantile(lambda total: F.lit(p) * (total - 1))


def upper_median() -> Quantile:
    return Quantile(lambda total: F.floor(total / 2).cast("double"))


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, Quantile],
    weight: str | None = None,
) -> DataFrame:
    """Exact (linearly interpolated) quantiles per group; ``weight`` repeats a row.

    Only the buckets holding a wanted position are ordered.
    """
    keys = list(keys)
    counts = value_counts(df, keys, value, weight).filter(F.col("n") > 0)
    bucketed = counts.withColumn("_bucket", order_bucket(F.col(value)))
    cells = _bucket_totals(bucketed, keys)
    wanted = F.lit(False)
    for quantile in quantiles.values():
        at = quantile.position(F.col("_total"))
        for edge in (F.floor(at), F.ceil(at)):
            wanted = wanted | (
                (F.col("_offset") <= edge) & (edge < F.col("_offset") + F.col("_cell"))
            )
    candidates = (
        bucketed.join(cells.filter(wanted), [*keys, "_bucket"])
        .withColumn("_below", _rows_below(keys, value))
    )
    aggregates = []
    for name, quantile in quantiles.items():
        at = quantile.position(F.col("_total"))

        def value_at(rank: Column) -> Column:
            held = (F.col("_below") <= rank) & (rank < F.col("_below") + F.col("n"))
            return F.max(F.when(held, F.col(value).cast("double")))

        low, high = value_at(F.floor(at)), value_at(F.ceil(at))
        fraction = F.max(at - F.floor(at))
        between = F.when((fraction == 0) | (low == high), low).otherwise(low + (high - low) * fraction)
        aggregates.append(between.alias(name))
    return candidates.groupBy(*keys).agg(*aggregates)


def average_ranks(
    df: DataFrame, keys: Sequence[str], value: str, out: str, weight: str | None = None
) -> DataFrame:
    """(group, value, out, total): 1-based rank of each distinct value, ties sharing their mean,
    and the size of the group. ``weight`` repeats a row."""
    keys = list(keys)
    ranked = cumulative_counts(value_counts(df, keys, value, weight), keys, value)
    return ranked.select(*keys, value, (F.col("below") + (F.col("n") + 1) / 2).alias(out), "total")


def mark_lowest(
    df: DataFrame, keys: Sequence[str], value: str, tie: str,
    quota: Callable[[Column], Column], out: str,
) -> DataFrame:
    """Flag the ``quota(group size)`` rows of each group that are lowest by (value, tie).

    Finds the boundary value, then the boundary ``tie`` among the rows sharing it, and compares
    every row with that boundary. ``tie`` is a number or text, unique in a group.
    """
    keys = list(keys)
    ranked = cumulative_counts(value_counts(df, keys, value), keys, value)
    k = quota(F.col("total")).cast("long")
    edge = ranked.filter((F.col("below") < k) & (k <= F.col("below") + F.col("n"))).select(
        *keys, F.col(value).alias("_edge"), (k - F.col("below")).alias("_need")
    )

    if not keys:
        # One boundary for the whole table: scalar subqueries, nothing moves.
        value_edge = edge.select("_edge").scalar()
        tied = df.filter(F.col(value) == value_edge)
        tie_edge = _nth_lowest(tied, [], tie, edge.select("_need").scalar())
        low, high = value_edge, tie_edge.select("_tie_edge").scalar()
        inside = (F.col(value) < low) | ((F.col(value) == low) & (F.col(tie) <= high))
        return df.withColumn(out, F.coalesce(inside, F.lit(False)))

    # A row per group, written, as the plans that find the boundaries are large and would be part of each other.
    edge = cut_lineage(edge)
    tied = lookup_join(df, edge, keys, spread=[tie]).filter(F.col(value) == F.col("_edge"))
    tie_edge = cut_lineage(_nth_lowest(tied, [*keys, "_need"], tie, F.col("_need")).drop("_need"))
    inside = (F.col(value) < F.col("_edge")) | (
        (F.col(value) == F.col("_edge")) & (F.col(tie) <= F.col("_tie_edge"))
    )
    return (
        lookup_join(df, edge.join(tie_edge, keys), keys, how="left", spread=[tie])
        .withColumn(out, F.coalesce(inside, F.lit(False)))
        .drop("_edge", "_need", "_tie_edge")
    )


def _nth_lowest(df: DataFrame, keys: list[str], tie: str, position: Column) -> DataFrame:
    ranked = cumulative_counts(value_counts(df, keys, tie), keys, tie)
    return ranked.filter(F.col("below") + 1 == position).select(
        *keys, F.col(tie).alias("_tie_edge")
    )


def ordinal_rank(
    df: DataFrame, keys: Sequence[str], value: str, tie: str, out: str
) -> DataFrame:
    """1-based row number of each row in its group by (value, tie).

    Rows move once, to (group, value, tie bucket); the two offsets come from counts.
    """
    keys = list(keys)
    staged = with_bucket(df, keys, tie, "_tie_bucket")
    cells = staged.groupBy(*keys, value, "_tie_bucket").agg(F.count(F.lit(1)).alias("_cell"))
    before = (
        Window.partitionBy(*keys, value)
        .orderBy("_tie_bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    cells = cells.withColumn("_inside", F.coalesce(F.sum("_cell").over(before), F.lit(0)))
    starts = cumulative_counts(value_counts(cells, keys, value, "_cell"), keys, value).select(
        *keys, value, "below"
    )
    offsets = cells.join(starts, [*keys, value]).select(
        *keys, value, "_tie_bucket", (F.col("below") + F.col("_inside")).alias("_offset")
    )
    inside = Window.partitionBy(*keys, value, "_tie_bucket").orderBy(tie)
    return (
        staged.join(offsets, [*keys, value, "_tie_bucket"])
        .withColumn(out, (F.col("_offset") + F.row_number().over(inside)).cast("long"))
        .drop("_tie_bucket", "_offset")
    )


def global_index(
    df: DataFrame, order: Column, tie: Sequence[str], out: str, buckets: int = INDEX_BUCKETS
) -> DataFrame:
    """Zero-based position of every row in the total order (order, tie...).

    ``order`` is an evenly spread 32-bit number such as ``seeded_order``. Rows are numbered
    inside a slice of its range; slice totals (at most ``buckets`` rows) give the offsets.
    """
    width = (1 << 32) // buckets
    sliced = df.withColumn("_order", order).withColumn(
        "_slice", F.floor(F.col("_order") / width).cast("long")
    )
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy("_slice")
        .agg(F.count(F.lit(1)).alias("_cell"))
        .withColumn("_offset", F.coalesce(F.sum("_cell").over(before), F.lit(0)))
        .select("_slice", "_offset")
    )
    inside = Window.partitionBy("_slice").orderBy("_order", *tie)
    return (
        sliced.withColumn("_rn", F.row_number().over(inside))
        .join(F.broadcast(offsets), "_slice")  # at most ``buckets`` rows
        .withColumn(out, F.col("_offset") + F.col("_rn") - 1)
        .drop("_order", "_slice", "_rn", "_offset")
    )
