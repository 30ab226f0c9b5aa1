"""Global order without a single-partition window.

Rows are range-partitioned on the sort key and written once, with their range
number kept as a column, so later passes never see other boundaries. Running
totals are then taken inside each range and shifted by the totals of the ranges
before it; the table of shifts has one row per range. A sort key that ends in a
unique column also splits a value held by very many rows over several ranges.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.functions.numbers import count_rows, int_div
from holdfast.sources.workspace import publish

_RANGE = "_range"


def running_totals(df: DataFrame, order: Sequence[str], totals: Mapping[str, str]) -> DataFrame:
    """Add for each ``new: column`` the sum of column up to and including the row."""
    ranged = publish(
        df.repartitionByRange(*order).withColumn(_RANGE, F.spark_partition_id()), "ranged"
    )
    before = Window.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        ranged.groupBy(_RANGE)
        .agg(*[F.sum(source).alias(f"_{new}") for new, source in totals.items()])
        .select(
            _RANGE,
            *[F.coalesce(F.sum(f"_{new}").over(before), F.lit(0)).alias(f"_{new}") for new in totals],
        )
    )
    inside = (
        Window.partitionBy(_RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # One row per shuffle partition, so this side stays small at any data size.
    shifted = ranged.join(F.broadcast(shifts), _RANGE)
    return shifted.select(
        *df.columns,
        *[(F.col(f"_{new}") + F.sum(source).over(inside)).alias(new) for new, source in totals.items()],
    )


def row_index(df: DataFrame, order: Sequence[str], name: str = "row_index") -> DataFrame:
    """Add the 0-based position of each row in the global order."""
    counted = running_totals(df.withColumn("_one", F.lit(1)), order, {name: "_one"})
    return counted.withColumn(name, F.col(name) - 1).drop("_one")


def ntile_of(index: Column, total: Column, tiles: int) -> Column:
    """SQL NTILE from a 0-based position: the first ``total % tiles`` tiles get one row more."""
    small = int_div(total, tiles)
    larger = total % tiles
    in_larger = larger * (small + 1)
    tile = F.when(index < in_larger, int_div(index, small + 1)).otherwise(
        larger + int_div(index - in_larger, F.greatest(small, F.lit(1)))
    )
    return (tile + 1).cast("int")


def score_totals(df: DataFrame, score: str, label: str) -> DataFrame:
    """Per distinct score: rows, positives, and both summed up to that score.

    Rows that share a score fold into one before the sort, whatever their number.
    """
    folded = (
        df.where(F.col(score).isNotNull())
        .groupBy(F.col(score).alias("score"))
        .agg(count_rows().alias("n"), F.sum(F.col(label).cast("long")).alias("positives"))
    )
    return running_totals(folded, ["score"], {"n_upto": "n", "positives_upto": "positives"})


def quantile_edges(totals: DataFrame, rows: DataFrame, parts: int) -> Column:
    """Sorted unique quantile edges with linear interpolation, as one scalar array.

    The value at position p is the smallest score whose running count exceeds p, so
    all positions come from one aggregation over the folded scores. ``rows`` is a
    one-row frame with the number of scored rows.
    """
    scaled = [(F.col("_rows") - 1) * i for i in range(parts + 1)]

    def value_at(position: Column) -> Column:
        return F.min(F.when(F.col("n_upto") > position, F.col("score")))

    picked = (
        totals.withColumn("_rows", rows.scalar())
        .groupBy("_rows")
        .agg(
            *[value_at(int_div(s, parts)).alias(f"low{i}") for i, s in enumerate(scaled)],
            *[value_at(int_div(s + (parts - 1), parts)).alias(f"high{i}") for i, s in enumerate(scaled)],
        )
    )
    edges = [
        F.col(f"low{i}") + (F.col(f"high{i}") - F.col(f"low{i}")) * ((s % parts) / F.lit(float(parts)))
        for i, s in enumerate(scaled)
    ]
    return picked.select(F.sort_array(F.array_distinct(F.array(*edges)))).scalar()
