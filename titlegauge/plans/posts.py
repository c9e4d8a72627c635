"""Raw posts to clean, split and labelled posts."""

from __future__ import annotations

from pyspark.sql import DataFrame

from titlegauge.operators.ingest import clean_posts
from titlegauge.operators.labels import era_percentile, stratified_split
from titlegauge.session import cut_lineage


def labelled_posts(raw: DataFrame, share: float = 0.2, seed: int = 0) -> DataFrame:
    """Clean posts with ``is_test`` and the era-aware ``label``.

    Clean posts and their split are written once: finding the split reads the posts several
    times (few columns), and labels, vocabularies and models all read the split.
    """
    split = cut_lineage(stratified_split(cut_lineage(clean_posts(raw)), share, seed))
    return era_percentile(split)


def split_sides(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    return labelled.filter("not is_test"), labelled.filter("is_test")
