"""The training-data pipeline over ``documents``: five stages, each written and read again.

Every stage works on all that the stage before kept and returns the columns of documents; the last
adds ``copies`` (in place of a column of that name). Rows with a null text or id pass through the stages
like empty or unnamed documents; of repeated rows of an id one stays, the smallest text, then the smallest
other columns; an empty table passes as an empty table; other columns are carried along under any name, and
only ``doc_id``, ``text`` and ``source`` have to be there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titlegauge.llm import decontaminate, near_dup, pii, source_mix, toxicity
from titlegauge.llm.common import let_workers_import, table, written


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows of the given ids; rows without an id stay."""
    gone = ids.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id")).distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples do not reject."""
    scored = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out())
    return _without(docs, scored.filter("predicted = 1"))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 80 %)."""
    groups = near_dup.near_duplicates(docs, near_dup.CORPUS)
    return _without(docs, groups.filter("not kept")).transform(_one_row_per_id)


def _one_row_per_id(docs: DataFrame) -> DataFrame:
    """Repeated rows of an id are copies of one document: the smallest text stays."""
    named = docs.filter("doc_id is not null")
    repeated = named.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    several = named.join(repeated, "doc_id", "left_semi")
    rest = docs.join(repeated, "doc_id", "left_anti").select(docs.columns)
    smallest = several.groupBy("doc_id").agg(F.min(F.struct("text", *_others(docs))).alias("row"))
    one = smallest.select("doc_id", "row.*").select(docs.columns)
    return rest.unionByName(one)


def _others(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c not in ("doc_id", "text")]


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return _without(docs, decontaminate.contaminated_pairs(docs, table(spark, sf_dir, "benchmark")))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    if "n_chars" not in docs.columns:
        return pii.mask_personal_data(docs)
    size = F.when(F.col("n_chars").isNotNull(), F.coalesce(F.char_length("text"), F.col("n_chars")))
    return pii.mask_personal_data(docs).withColumn("n_chars", size.cast(docs.schema["n_chars"].dataType))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with ``copies``, the times it takes each."""
    return source_mix.take_mix(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_dup_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", pii_stage),
    ("mix_sources", mix_stage),
]

#: The first stage's neighbours and the fourth's tagger have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    let_workers_import(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
