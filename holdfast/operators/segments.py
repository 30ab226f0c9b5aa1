"""Churn and head counts by user segment, and the two churn curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions import bands
from holdfast.functions.numbers import count_rows, percent, round_dp

def segment_columns() -> dict[str, Column]:
    return {
        "subscription": F.col("subscription_type"),
        "country": F.col("country"),
        "genre": F.col("favorite_genre"),
        "age_band": bands.AGE_CUT.label(),
        "recency_band": bands.RECENCY_CUT.label(),
        "watch_band": bands.WATCH_CUT.label(),
        "support_tickets": bands.TICKET_CUT.label(),
        "tenure_band": bands.TENURE_CUT.label(),
    }


def churn_by(users: DataFrame, segment: Column, name: str, *order: Column) -> DataFrame:
    """Churn percentage per segment; rows outside every segment are left out."""
    grouped = (
        users.select(segment.alias(name), "churn")
        .where(F.col(name).isNotNull())
        .groupBy(name)
        .agg(percent(F.avg("churn"), 2).alias("churn_rate"))
    )
    return grouped.orderBy(*(order or (F.col(name),)))


def users_by(users: DataFrame, column: str) -> DataFrame:
    return (
        users.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(count_rows().alias("users"))
        .orderBy(F.desc("users"), column)
    )


def all_segments(users: DataFrame, names: tuple[str, ...] | None = None) -> DataFrame:
    """(segment, value, users, churn_rate) for many segments in one scan and one shuffle."""
    available = segment_columns()
    names = names or tuple(available)
    wide = users.select(*[available[name].alias(name) for name in names], "churn")
    cells = wide.groupingSets([[F.col(name)] for name in names], *[F.col(n) for n in names]).agg(
        F.grouping_id().alias("set_id"),
        count_rows().alias("users"),
        percent(F.avg("churn"), 2).alias("churn_rate"),
    )
    # grouping_id has a 1 for every column that is not part of the row's set.
    full = 2 ** len(names) - 1
    chosen = F
    for i, name in enumerate(names):
        chosen = chosen.when(F.col("set_id") == full - 2 ** (len(names) - 1 - i), F.lit(name))
    return cells.select(
        chosen.alias("segment"), F.coalesce(*names).alias("value"), "users", "churn_rate"
    ).where(F.col("value").isNotNull())


def parity_spread(users: DataFrame) -> DataFrame:
    """Lowest, highest and spread of segment churn over three demographic dimensions."""
    low, high = F.min("churn_rate"), F.max("churn_rate")
    return (
        all_segments(users, ("country", "age_band", "subscription"))
        .groupBy(F.col("segment").alias("dimension"))
        .agg(
            round_dp(low, 1).alias("lowest"),
            round_dp(high, 1).alias("highest"),
            round_dp(high - low, 1).alias("spread"),
        )
        .orderBy("dimension")
    )


def churn_curve(users: DataFrame, column: str, step: int, last: int, stop: int = 1000) -> DataFrame:
    """Churn per left-closed bin, labelled by the left edge; empty bins do not appear."""
    binned = users.select(bands.curve_bin(F.col(column), step, last, stop).alias("x"), "churn")
    return (
        binned.where(F.col("x").isNotNull())
        .groupBy("x")
        .agg(percent(F.avg("churn"), 1).alias("churn_rate"), count_rows().alias("n"))
        .orderBy("x")
    )


def recency_curve(users: DataFrame) -> DataFrame:
    return churn_curve(users, "days_since_login", step=3, last=57)


def watch_time_curve(users: DataFrame) -> DataFrame:
    return churn_curve(users, "watch_time_hours", step=1, last=19)


def outside_bands(users: DataFrame) -> DataFrame:
    """(report, users, left_out): how many users the edges of each cut and curve leave out, in one scan."""
    banded = {
        "age_band": bands.AGE_CUT.label(),
        "recency_band": bands.RECENCY_CUT.label(),
        "watch_band": bands.WATCH_CUT.label(),
        "ticket_band": bands.TICKET_CUT.label(),
        "tenure_band": bands.TENURE_CUT.label(),
        "recency_curve": bands.curve_bin(F.col("days_since_login"), 3, 57, 1000),
        "watch_time_curve": bands.curve_bin(F.col("watch_time_hours"), 1, 19, 1000),
    }
    missing = [F.count_if(band.isNull()).alias(report) for report, band in banded.items()]
    return users.agg(count_rows().alias("users"), *missing).unpivot("users", list(banded), "report", "left_out")
