"""Numeric, time and banding expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Verdict floors on the 0-100 band, margin bucket edges, pairing tolerances.
VERDICTS = [(75.0, "strong"), (50.0, "above average"), (25.0, "below average")]
LOWEST_VERDICT = "weak"
MARGIN_BUCKETS = [(1.0, 2.0, "<2x"), (2.0, 5.0, "2-5x"), (5.0, 20.0, "5-20x"), (20.0, 1e9, ">20x")]
TIME_MATCH_HOURS = 3


def whole_number(df: DataFrame, name: str) -> Column:
    """Column ``name`` as bigint: numbers lose their fraction, text must be a signed integer, and
    anything else (also a number that is none, or too large) is null."""
    if isinstance(df.schema[name].dataType, T.NumericType):
        return F.col(name).try_cast("bigint")
    plain = F.trim(F.col(name).cast("string"))
    return F.when(plain.rlike(r"^[+-]?[0-9]+$"), plain.try_cast("bigint"))


def number_or_zero(value: Column) -> Column:
    return F.coalesce(value.cast("string").try_cast("double"), F.lit(0.0))


def utc_timestamp(epoch: Column) -> Column:
    return F.timestamp_seconds(epoch)


def utc_year(epoch: Column) -> Column:
    return F.year(utc_timestamp(epoch))


def utc_month(epoch: Column) -> Column:
    return F.date_format(utc_timestamp(epoch), "yyyy-MM")


def utc_hour(epoch: Column) -> Column:
    return F.hour(utc_timestamp(epoch))


def is_weekend(epoch: Column) -> Column:
    return F.weekday(utc_timestamp(epoch)) >= 5


def hour_distance(first: Column, second: Column) -> Column:
    """Distance on the 24-hour circle."""
    gap = F.abs(first - second)
    return F.least(gap, F.lit(24) - gap)


def time_matched(
    first_hour: Column, first_weekend: Column, second_hour: Column, second_weekend: Column
) -> Column:
    return (hour_distance(first_hour, second_hour) <= TIME_MATCH_HOURS) & (
        first_weekend == second_weekend
    )


def smoothed_ratio(first: Column, second: Column) -> Column:
    return (F.greatest(first, second) + 1) / (F.least(first, second) + 1)


def verdict(band: Column) -> Column:
    chain = F
    for floor, name in VERDICTS:
        chain = chain.when(band >= floor, F.lit(name))
    return chain.otherwise(F.lit(LOWEST_VERDICT))


def margin_bucket(ratio: Column) -> Column:
    chain = F
    for low, high, name in MARGIN_BUCKETS:
        chain = chain.when((ratio >= low) & (ratio < high), F.lit(name))
    return chain


def seeded_order(key: Column, seed: int = 0) -> Column:
    """A reproducible pseudo-random 32-bit number for ``key``."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(f"#{seed}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
