"""Mixing sources to target weights by weighted fair queueing; DataFrame functions only.

Every source serves its documents in a shuffled order, up to ``max_repeats`` times over. A copy's
virtual finish time is the number of words its source has then served, divided by the source's
target. All copies are taken in the order of finish time until the word budget is reached.

Scale: the running sums of a source are split by ranges of the shuffle key, so a hot source is many
groups. The global order is never built: the cut is found by summing words in ranges of finish
time, narrowing to the range where the budget falls, and only that range is sorted.

Cases: null text has size 0; null source is a source of its own, last in order; empty documents
and empty sources take 0 words; rows with the same id are separate documents, equal rows are taken
together or not at all; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from titlegauge.llm.common import id_text, written

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a source whose running sum one task orders.
GROUP_ROWS = 2_000
#: Ranges that one narrowing step sums, and the copies that are sorted at last.
RANGES = 4_096
SORT_ROWS = 50_000
#: Finish times are compared in ranges as multiples of 1 / SCALE.
SCALE = 1 << 40
COPY_ORDER = ("finish", "key", "doc_id", "size", "time")


@dataclass(frozen=True)
class MixPlan:
    """``weights`` repeat over the sources; ``share`` is the budget as a multiple of all words."""

    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5
    max_repeats: int = 2


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(doc_id: Column) -> Column:
    """60 bits of an md5, the same in every engine and run."""
    digest = F.md5(F.concat(F.lit("mix"), id_text(doc_id)))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def source_targets(sized: DataFrame, plan: MixPlan) -> DataFrame:
    """One row per source: n_docs, source_size, target.

    Filling by level: with sources ordered by limit / weight, those whose limit lies below the level
    that the rest would get keep their limit; the first one above sets the level of all others.
    The windows here run over sources only.
    """
    by_source = sized.groupBy("source").agg(
        F.count("*").alias("n_docs"), F.sum("size").alias("source_size")
    )
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    cycle = F.array(*[F.lit(float(w)) for w in plan.weights])
    limits = by_source.select(
        "*",
        F.element_at(cycle, ((place - 1) % len(plan.weights) + 1).cast("int")).alias("weight"),
        (F.col("source_size") * F.lit(float(plan.max_repeats))).alias("limit"),
    ).withColumn("ratio", F.col("limit") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    budget = F.sum("source_size").over(everything) * F.lit(plan.share)
    levels = limits.withColumn(
        "level",
        (budget - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(onward),
    )
    above = F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "level"))
    # Past the first source above its level all others are above it too.
    final = levels.withColumn("final", F.min(above).over(everything)["level"])
    return final.select(
        "source",
        "n_docs",
        "source_size",
        F.when(F.col("ratio") > F.col("final"), F.col("weight") * F.col("final"))
        .otherwise(F.col("limit"))
        .alias("target"),
    )


def finish_times(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Each document with ``served``, the words its source has served when it is through once."""
    same = sized["source"].eqNullSafe(targets["source"])
    keyed = sized.join(F.broadcast(targets) if _few(targets) else targets, same).select(
        sized["*"], targets["n_docs"], targets["source_size"], targets["target"]
    )
    groups = F.ceil(F.col("n_docs") / GROUP_ROWS)
    keyed = keyed.withColumn(
        "part", F.floor(F.col("key") / F.lit(float(1 << 60)) * groups).cast("long")
    )
    parts = keyed.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        F.col("source").alias("p_source"),
        F.col("part").alias("p_part"),
        F.coalesce(F.sum("part_size").over(earlier), F.lit(0)).alias("offset"),
    )
    here = keyed["source"].eqNullSafe(parts["p_source"]) & (keyed["part"] == parts["p_part"])
    inside = Window.partitionBy("source", "part").orderBy("key", "doc_id", "size")
    running = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return keyed.join(parts, here).select(
        "doc_id", "size", "source_size", "target", "key", (F.col("offset") + running).alias("served")
    )


def _few(targets: DataFrame, most: int = 100_000) -> bool:
    """Whether the sources are few enough to broadcast (a name and three numbers each)."""
    return targets.limit(most + 1).count() <= most


def _finish(times: int) -> Column:
    served = F.col("served") + F.col("source_size") * times
    return F.when(F.col("target") > 0, served / F.col("target")).otherwise(0.0)


def copies(docs: DataFrame, plan: MixPlan) -> DataFrame:
    """One row per document and repeat, with its finish time."""
    each = F.array(*[F.struct(F.lit(i).alias("time"), _finish(i).alias("finish")) for i in range(plan.max_repeats)])
    return docs.select("doc_id", "size", "key", F.explode(each).alias("copy")).select(
        "doc_id", "size", "key", "copy.time", "copy.finish"
    )


def _position(finish: Column) -> Column:
    """Finish time mapped to 0..2, order kept; targets are met about the value 1."""
    return F.when(finish <= 1, finish).otherwise(F.lit(2.0) - F.lit(1.0) / finish)


def budget_cut(served: DataFrame, plan: MixPlan, budget: float) -> Row | None:
    """(finish, key, doc_id, size, time) of the last copy taken, in that order; None if none is."""
    scaled = F.floor(_position(F.col("finish")) * F.lit(float(SCALE))).cast("long")
    every = copies(served, plan).withColumn("position", scaled)
    low, high, taken = 0, 2 * SCALE + 1, 0
    while True:
        step = -(-(high - low) // RANGES)
        ranges = (
            every.filter(F.col("position").between(low, high - 1))
            .groupBy(F.floor((F.col("position") - low) / step).alias("range"))
            .agg(F.sum("size").alias("size"), F.count("*").alias("n"))
            .orderBy("range")
            .collect()  # at most RANGES rows
        )
        crossed = None
        for row in ranges:
            if taken + row["size"] > budget:
                crossed = row
                break
            taken += row["size"]
        if crossed is None:
            return _last(every)
        low += crossed["range"] * step
        high = min(high, low + step)
        if step == 1 or crossed["n"] <= SORT_ROWS:
            break
    order = Window.orderBy(*COPY_ORDER).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    fits = (
        every.filter(F.col("position").between(low, high - 1))
        .withColumn("words", F.sum("size").over(order))
        .filter(F.col("words") + taken <= budget)
    )
    return _last(fits) or _last(every.filter(F.col("position") < low))


def _last(some: DataFrame) -> Row | None:
    return some.agg(F.max(F.struct(*COPY_ORDER)).alias("last")).first()["last"]


def mix_sources(
    docs: DataFrame,
    plan: MixPlan = MixPlan(),
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes, repeats counted)."""
    return _mixed(docs, plan, id_col, text_col, source_col).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).cast("long").alias("taken")
    )


def take_mix(
    docs: DataFrame,
    plan: MixPlan = MixPlan(),
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The documents of the mix with ``copies``, how many times it takes each (a column of that name is
    replaced); ids are unique.

    Rows without an id cannot be told apart and are taken once.
    """
    docs = docs.drop("copies")
    mix = _mixed(docs.filter(docs[id_col].isNotNull()), plan, id_col, text_col, source_col)
    taken_id = _free_name(docs, "mix_id")
    times = mix.filter("times > 0").select(F.col("doc_id").alias(taken_id), F.col("times").cast("int").alias("copies"))
    taken = docs.join(times, docs[id_col].cast("long") == times[taken_id]).drop(taken_id)
    return taken.unionByName(docs.filter(docs[id_col].isNull()).withColumn("copies", F.lit(1)))


def _free_name(docs: DataFrame, name: str) -> str:
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def _mixed(docs: DataFrame, plan: MixPlan, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """doc_id, size, source_size, target, times (how often the mix takes the document)."""
    sized = written(
        docs.select(
            docs[id_col].cast("long").alias("doc_id"),
            docs[source_col].cast("string").alias("source"),
            word_count(docs[text_col]).alias("size"),
        ).withColumn("key", shuffle_key(F.col("doc_id")))
    )
    targets = written(source_targets(sized, plan))
    served = written(finish_times(sized, targets))
    total = served.agg(F.sum("size")).first()[0] or 0
    last = budget_cut(served, plan, total * plan.share)
    times = F.lit(0)
    if last is not None:
        cut = F.struct(
            F.lit(last["finish"]).alias("finish"),
            F.lit(last["key"]).cast("long").alias("key"),
            F.lit(last["doc_id"]).cast("long").alias("doc_id"),
            F.lit(last["size"]).cast("long").alias("size"),
            F.lit(last["time"]).cast("int").alias("time"),
        )
        for i in range(plan.max_repeats):
            own = F.struct(
                _finish(i).alias("finish"), F.col("key"), F.col("doc_id"), F.col("size"), F.lit(i).alias("time")
            )
            times = times + F.when(own <= cut, 1).otherwise(0)
    return served.select("doc_id", "size", "source_size", "target", times.alias("times"))


ORACLE = r"""
WITH RECURSIVE sized AS (
  SELECT row_number() OVER () AS rid, doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM sized GROUP BY source),
fill AS (
  SELECT 0 AS round, source, source_size, weight, false AS full_up, 0::DOUBLE AS target FROM sources
  UNION ALL
  SELECT round + 1, source, source_size, weight,
         full_up OR share >= 2.0 * source_size,
         CASE WHEN full_up OR share >= 2.0 * source_size THEN 2.0 * source_size ELSE share END
  FROM (SELECT *, CASE WHEN full_up THEN 0 ELSE weight
               * (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0 * source_size) FILTER (full_up) OVER (), 0))
               / sum(weight) FILTER (NOT full_up) OVER () END AS share
        FROM fill WHERE round < (SELECT count(*) FROM sources))),
targets AS (SELECT source, source_size, target FROM fill WHERE round = (SELECT count(*) FROM sources)),
served AS (
  SELECT rid, doc_id, size, source_size, target, key,
         sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS served
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT *, CASE WHEN target > 0 THEN (served + source_size * time)::DOUBLE / target ELSE 0 END AS finish
  FROM served, (VALUES (0), (1)) AS times(time)),
ordered AS (
  SELECT *, sum(size) OVER (ORDER BY finish, key, doc_id, size, time) AS words, 1.5 * (SELECT sum(size) FROM sized) AS budget
  FROM copies)
SELECT doc_id, size, source_size, target,
       sum(CASE WHEN words <= budget THEN size ELSE 0 END)::BIGINT AS taken
FROM ordered GROUP BY rid, doc_id, size, source_size, target
"""
