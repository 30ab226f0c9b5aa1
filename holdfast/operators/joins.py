"""Joins of a fact table with a dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame


def join_dimension(facts: DataFrame, dimension: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join facts with a dimension that has one row per key.

    No hint: a dimension under the session's broadcast threshold in bytes is broadcast, a
    larger one shuffles, and adaptive execution splits the partitions of hot keys.
    """
    return facts.join(dimension, key, how)
