"""Demand, completion and ratings by title, genre, year and month.

Facts are folded per title before they meet the content table, so a title with a
large share of all sessions costs one row in the join, and both join sides have
at most one row per title.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.functions.numbers import count_rows, month_of, ratio, round_dp


def title_views(watch: DataFrame, content: DataFrame, how: str = "inner") -> DataFrame:
    """Per content_id: views and the parts of the average completion, with title facts."""
    folded = watch.groupBy("content_id").agg(
        count_rows().alias("views"),
        F.sum("completion_rate").alias("completion_sum"),
        F.count("completion_rate").alias("completion_n"),
    )
    return folded.join(content, "content_id", how)


def title_ratings(ratings: DataFrame, content: DataFrame, how: str = "inner") -> DataFrame:
    folded = ratings.groupBy("content_id").agg(
        count_rows().alias("n"),
        F.sum("rating").alias("rating_sum"),
        F.count("rating").alias("rating_n"),
    )
    return folded.join(content, "content_id", how)


def mean_completion(places: int):
    return round_dp(ratio(F.sum("completion_sum"), F.sum("completion_n")), places)


def mean_rating(places: int):
    return round_dp(ratio(F.sum("rating_sum"), F.sum("rating_n")), places)


def genre_views(watch: DataFrame, content: DataFrame) -> DataFrame:
    return (
        title_views(watch, content, "left")
        .where(F.col("genre").isNotNull())
        .groupBy("genre")
        .agg(F.sum("views").alias("views"))
        .orderBy(F.desc("views"), "genre")
    )


def genre_completion(watch: DataFrame, content: DataFrame) -> DataFrame:
    return (
        title_views(watch, content, "left")
        .where(F.col("genre").isNotNull())
        .groupBy("genre")
        .agg(mean_completion(1).alias("avg_completion"))
        .orderBy(F.desc("avg_completion"), "genre")
    )


def best_rated(ratings: DataFrame, content: DataFrame, at_least: int = 15, limit: int = 10) -> DataFrame:
    """Best titles by unrounded ``mean`` rating among those with enough ratings."""
    mean = ratio(F.col("rating_sum"), F.col("rating_n"))
    return (
        title_ratings(ratings, content, "left")
        .where(F.col("n") >= at_least)
        .select("content_id", "title", "genre", mean.alias("mean"), "n")
        .orderBy(F.desc("mean"), "content_id")
        .limit(limit)
        .withColumn("avg_rating", round_dp(F.col("mean"), 2))
    )


def top_rated(ratings: DataFrame, content: DataFrame, at_least: int = 15, limit: int = 10) -> DataFrame:
    best = best_rated(ratings, content, at_least, limit)
    return best.select("content_id", "title", "genre", "avg_rating", "n")


def monthly_totals(watch: DataFrame) -> DataFrame:
    """Per month (NULL for undated sessions): the parts of every count and average.

    One row per month, so anything derived from it costs one scan of the facts.
    """
    return watch.groupBy(month_of(F.col("watch_date")).alias("month")).agg(
        count_rows().alias("sessions"),
        F.sum("completion_rate").alias("completion_sum"),
        F.count("completion_rate").alias("completion_n"),
        F.sum("session_duration").alias("duration_sum"),
        F.count("session_duration").alias("duration_n"),
    )


def growth_of(totals: DataFrame) -> DataFrame:
    """Sessions and average completion of each month."""
    completion = round_dp(ratio(F.col("completion_sum"), F.col("completion_n")), 1)
    return (
        totals.where(F.col("month").isNotNull())
        .select("month", "sessions", completion.alias("completion"))
        .orderBy("month")
    )


def monthly_growth(watch: DataFrame) -> DataFrame:
    return growth_of(monthly_totals(watch))


def monthly_sessions(watch: DataFrame) -> DataFrame:
    return monthly_growth(watch).select("month", "sessions")


def monthly_completion(watch: DataFrame) -> DataFrame:
    return monthly_growth(watch).select("month", "completion")


def views_by_year_of(titles: DataFrame) -> DataFrame:
    return (
        titles.where(F.col("release_year").isNotNull())
        .groupBy("release_year")
        .agg(F.sum("views").alias("views"))
        .orderBy("release_year")
    )


def views_by_release_year(watch: DataFrame, content: DataFrame) -> DataFrame:
    return views_by_year_of(title_views(watch, content))


def most_watched_of(titles: DataFrame, limit: int = 10) -> DataFrame:
    return (
        titles.where(F.col("title").isNotNull() & F.col("genre").isNotNull())
        .select("content_id", "title", "genre", "views")
        .orderBy(F.desc("views"), "content_id")
        .limit(limit)
    )


def most_watched(watch: DataFrame, content: DataFrame) -> DataFrame:
    return most_watched_of(title_views(watch, content))
