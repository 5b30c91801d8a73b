"""Joins with tables that have one row for each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def lookup_join(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join to a table with one row per key (``left`` or ``inner``); ``key`` comes as the left side has it.

    Spark's adaptive execution picks the strategy from measured sizes. Rows of a key that fills a
    large share of the left side are split over tasks, as each part needs the one right row only.
    """
    if how not in ("left", "inner"):
        raise ValueError("how must be left or inner")
    return left.join(right, key, how).select(left.columns + [c for c in right.columns if c != key])


def large_join(left: DataFrame, right: DataFrame, on: Column | str | list[str], how: str = "inner") -> DataFrame:
    """Join of two tables that grow with the input, by sorting both sides: never broadcast.

    Spark takes rows that were exploded, and columns that are small on disk, for smaller than they
    are; broadcasting them would fill the driver.
    """
    return left.join(right.hint("merge"), on, how)
