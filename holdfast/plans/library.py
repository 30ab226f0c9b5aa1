"""The twenty library reports: basic counts, joins with bands, and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from holdfast.functions import bands
from holdfast.functions.numbers import count_rows, month_of, percent, round_dp
from holdfast.operators.content import mean_completion, mean_rating, title_ratings, title_views
from holdfast.operators.risk import ntile_deciles
from holdfast.sources.tables import Tables


def total_users(t: Tables) -> DataFrame:
    return t.users.agg(count_rows().alias("total_users"))


def users_by_plan(t: Tables) -> DataFrame:
    counted = t.users.groupBy("subscription_type").agg(count_rows().alias("users"))
    return counted.orderBy(F.desc("users"), "subscription_type")


def engagement(t: Tables) -> DataFrame:
    return t.users.agg(
        round_dp(F.avg("watch_time_hours"), 2).alias("avg_watch_time_hours"),
        round_dp(F.avg("tenure_days"), 0).alias("avg_tenure_days"),
        round_dp(F.avg("support_tickets"), 2).alias("avg_support_tickets"),
    )


def titles_by_genre(t: Tables) -> DataFrame:
    counted = t.content.groupBy("genre").agg(count_rows().alias("titles"))
    return counted.orderBy(F.desc("titles"), "genre")


def average_rating(t: Tables) -> DataFrame:
    return t.ratings.agg(
        round_dp(F.avg("rating"), 2).alias("avg_rating"), count_rows().alias("total_ratings")
    )


def genre_engagement(t: Tables) -> DataFrame:
    return (
        title_views(t.watch_history, t.content)
        .groupBy("genre")
        .agg(F.sum("views").alias("total_views"), mean_completion(1).alias("avg_completion_rate"))
        .orderBy(F.desc("total_views"), "genre")
    )


def views_by_title(t: Tables) -> DataFrame:
    """Views per (title, genre); titles that share a name and genre count together."""
    folded = title_views(t.watch_history, t.content)
    return folded.groupBy("title", "genre").agg(F.sum("views").alias("views"))


def top_titles(t: Tables, limit: int = 10) -> DataFrame:
    return views_by_title(t).orderBy(F.desc("views"), "title", "genre").limit(limit)


def churn_by_plan(t: Tables) -> DataFrame:
    return (
        t.users.groupBy("subscription_type")
        .agg(count_rows().alias("users"), percent(F.avg("churn"), 2).alias("churn_rate_pct"))
        .orderBy(F.desc("churn_rate_pct"), "subscription_type")
    )


def genre_completion(t: Tables) -> DataFrame:
    return (
        title_views(t.watch_history, t.content)
        .groupBy("genre")
        .agg(mean_completion(2).alias("avg_completion"))
        .orderBy(F.desc("avg_completion"), "genre")
    )


def genre_ratings(t: Tables, at_least: int = 100) -> DataFrame:
    return (
        title_ratings(t.ratings, t.content)
        .groupBy("genre")
        .agg(mean_rating(2).alias("avg_rating"), F.sum("n").alias("num_ratings"))
        .where(F.col("num_ratings") >= at_least)
        .orderBy(F.desc("avg_rating"), "genre")
    )


def churn_by_ladder(t: Tables, ladder: bands.Ladder, name: str) -> DataFrame:
    """Users and churn per band, in the order of the banded value."""
    return (
        t.users.groupBy(ladder.label().alias(name))
        .agg(
            count_rows().alias("users"),
            percent(F.avg("churn"), 2).alias("churn_rate_pct"),
            F.min(ladder.column).alias("lowest"),
        )
        .orderBy("lowest")
        .drop("lowest")
    )


def recency_bands(t: Tables) -> DataFrame:
    return churn_by_ladder(t, bands.RECENCY, "recency_band")


def tenure_bands(t: Tables) -> DataFrame:
    return churn_by_ladder(t, bands.TENURE, "tenure_band")


def ticket_bands(t: Tables) -> DataFrame:
    return churn_by_ladder(t, bands.TICKETS, "ticket_band")


def genre_rank(t: Tables) -> DataFrame:
    """Genres by demand; the window runs over one row per genre."""
    by_genre = (
        title_views(t.watch_history, t.content).groupBy("genre").agg(F.sum("views").alias("total_views"))
    )
    rank = F.rank().over(Window.orderBy(F.desc("total_views")))
    return by_genre.select("genre", "total_views", rank.alias("genre_rank"))


def top_user_per_country(t: Tables) -> DataFrame:
    """Heaviest watcher per country; each task keeps one row per country before the shuffle."""
    best = Window.partitionBy("country").orderBy(F.desc_nulls_last("watch_time_hours"), "user_id")
    return (
        t.users.select("user_id", "country", "watch_time_hours")
        .withColumn("rn", F.row_number().over(best))
        .where(F.col("rn") == 1)
    )


def monthly_change(t: Tables) -> DataFrame:
    """Sessions per month beside the month before; the window runs over one row per month."""
    monthly = t.watch_history.groupBy(month_of(F.col("watch_date")).alias("month")).agg(
        count_rows().alias("sessions")
    )
    previous = F.lag("sessions").over(Window.orderBy("month"))
    return monthly.withColumn("prev_month_sessions", previous).orderBy("month")


def plan_vs_benchmark(t: Tables) -> DataFrame:
    overall = t.users.agg(F.avg("churn")).scalar()
    by_plan = t.users.groupBy("subscription_type").agg(F.avg("churn").alias("rate"))
    return by_plan.select(
        "subscription_type",
        percent(F.col("rate"), 2).alias("churn_rate_pct"),
        percent(F.col("rate") - overall, 2).alias("diff_vs_benchmark_pts"),
    )


def top_titles_per_genre(t: Tables, limit: int = 3) -> DataFrame:
    best = Window.partitionBy("genre").orderBy(F.desc("views"), "title")
    return (
        views_by_title(t)
        .withColumn("rn", F.row_number().over(best))
        .where(F.col("rn") <= limit)
        .select("genre", "title", "views", "rn")
    )


def risk_ntile(t: Tables) -> DataFrame:
    return ntile_deciles(t.users)


def signup_cohorts(t: Tables) -> DataFrame:
    return (
        t.users.groupBy(month_of(F.col("signup_date")).alias("signup_cohort"))
        .agg(
            count_rows().alias("cohort_size"),
            percent(F.avg(F.lit(1) - F.col("churn")), 1).alias("retained_pct"),
        )
        .orderBy("signup_cohort")
    )
