"""Ingest plans: landed raw posts to a clean post table, with its profile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from titlegauge.operators.ingest import historical_sample, recent_sample, with_month
from titlegauge.operators.profile import community_profile, hash_sample, rows_per, table_summary
from titlegauge.sources.tables import read_posts, write_table


def _write_and_profile(posts: DataFrame, out: str, sample: int) -> dict[str, DataFrame]:
    write_table(posts, out)
    stored = read_posts(posts.sparkSession, out)
    return {
        "posts": stored,
        "summary": table_summary(stored),
        "communities": community_profile(stored),
        "years": rows_per(stored, ["year"]),
        "sample": hash_sample(stored, sample),
    }


def ingest_recent(
    raw: DataFrame, communities: Sequence[str], out: str, per_community: int = 2000,
    before: int | None = None, min_score: int = 1,
) -> dict[str, DataFrame]:
    """Newest posts per community to ``out``, with summary tables."""
    kept = recent_sample(raw, communities, per_community, before, min_score)
    return _write_and_profile(kept, out, sample=6)


def ingest_historical(
    raw: DataFrame, communities: Sequence[str], out: str, per_community: int = 8000,
    stride: int = 3, rows_per_month: int | None = None, min_score: int = 1,
) -> dict[str, DataFrame]:
    """Quota sample over strided months to ``out``, with summary tables.

    ``rows_per_month`` bounds the scan of each month, where that is wanted.
    """
    kept = historical_sample(
        with_month(raw), communities, stride, per_community, rows_per_month, min_score
    )
    return _write_and_profile(kept, out, sample=5)
