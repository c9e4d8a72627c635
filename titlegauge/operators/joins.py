"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 1_000_000
LOOKUP_SALTS = 16
PAIR_BLOCK_ROWS = 20_000


def lookup_join(
    facts: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    spread: Sequence[str] | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
    salts: int = LOOKUP_SALTS,
) -> DataFrame:
    """Join a large table with a lookup table that has one row per key.

    The lookup is cached and counted. Up to ``broadcast_rows`` it is broadcast, so the facts do
    not move. Beyond that both sides shuffle on (key, salt): the lookup is repeated per salt and
    the facts spread over the salts by a hash of ``spread`` (default: all their columns).
    """
    on = list(on)
    cached = table.persist()
    if cached.count() <= broadcast_rows:
        return facts.join(F.broadcast(cached), on, how)
    spread_by = list(spread or [c for c in facts.columns if c not in on])
    salted_facts = facts.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)))
    salted_table = cached.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))
    )
    return salted_facts.join(salted_table, [*on, "_salt"], how).drop("_salt")


def pairs_within(
    rows: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str],
    condition: Callable[[Callable[[str], Column], Callable[[str], Column]], Column],
    columns: Callable[[Callable[[str], Column], Callable[[str], Column]], list[Column]],
    block_rows: int = PAIR_BLOCK_ROWS,
) -> DataFrame:
    """Pairs (a, b) of rows that share ``keys`` and satisfy ``condition(a, b)``.

    Groups above ``block_rows`` rows are cut into blocks on both sides, and each block of ``a`` meets
    each block of ``b`` under a key of its own, so the rows of a task fall with the number of blocks
    and no task owns a whole side of a hot group. ``columns`` names the output; the condition is part
    of the join, so rejected pairs are never materialised.
    """
    keys = list(keys)
    large = (
        rows.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > block_rows)
        .select(*keys, F.ceil(F.col("_n") / block_rows).cast("long").alias("_blocks"))
    )
    sized = lookup_join(rows, large, keys, how="left", spread=spread).withColumn(
        "_blocks", F.coalesce("_blocks", F.lit(1).cast("long"))
    )
    own = F.pmod(F.xxhash64(*spread), F.col("_blocks"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))
    left = sized.withColumn("_a_block", own).withColumn("_b_block", every).alias("a")
    right = sized.withColumn("_b_block", own).withColumn("_a_block", every).alias("b")

    def a(name: str) -> Column:
        return F.col(f"a.{name}")

    def b(name: str) -> Column:
        return F.col(f"b.{name}")

    same_group = F.lit(True)
    for key in [*keys, "_a_block", "_b_block"]:
        same_group = same_group & (a(key) == b(key))
    return left.join(right, same_group & condition(a, b)).select(*columns(a, b))
