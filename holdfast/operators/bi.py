"""BI measures, band columns, filters and drill-downs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.functions import bands
from holdfast.functions.numbers import count_rows, percent, ratio, round_dp
from holdfast.operators.joins import join_dimension
from holdfast.operators.segments import churn_by
from holdfast.sources.tables import Tables
from holdfast.sources.workspace import publish

LADDERS = {
    "tenure_band": bands.TENURE,
    "ticket_band": bands.TICKETS,
    "recency_band": bands.RECENCY,
    "age_band": bands.AGE,
}


def user_measures() -> list[Column]:
    """Measures over users; they follow whatever filter or grouping surrounds them."""
    churned = F.count_if(F.col("churn") == 1)
    rate = ratio(churned, count_rows())
    return [
        count_rows().alias("total_users"),
        churned.alias("churned_users"),
        round_dp(rate, 6).alias("churn_rate"),
        round_dp(F.lit(1.0) - rate, 6).alias("retention_rate"),
        round_dp(F.avg("watch_time_hours"), 4).alias("avg_watch_hours"),
        round_dp(F.avg("tenure_days"), 4).alias("avg_tenure_days"),
    ]


def measures(t: Tables) -> DataFrame:
    """All nine measures in one row."""
    facts = t.watch_history.agg(
        F.struct(
            count_rows().alias("total_sessions"),
            round_dp(F.avg("completion_rate"), 4).alias("avg_completion_rate"),
        )
    ).scalar()
    rating = t.ratings.agg(round_dp(F.avg("rating"), 4)).scalar()
    return (
        t.users.agg(*user_measures())
        .withColumn("_facts", facts)
        .withColumn("avg_rating", rating)
        .select("*", "_facts.*")
        .drop("_facts")
    )


def measures_by(users: DataFrame, segment: Column, name: str) -> DataFrame:
    return users.groupBy(segment.alias(name)).agg(*user_measures()).orderBy(name)


def churn_vs_benchmark(users: DataFrame, column: str = "country") -> DataFrame:
    overall = users.agg(F.avg("churn")).scalar()
    return (
        users.groupBy(column)
        .agg(F.avg("churn").alias("rate"))
        .select(
            column,
            round_dp(F.col("rate"), 6).alias("churn_rate"),
            round_dp(F.col("rate") - overall, 6).alias("churn_vs_benchmark"),
        )
        .orderBy(column)
    )


def band_columns(users: DataFrame) -> DataFrame:
    return users.select("user_id", *[ladder.label().alias(n) for n, ladder in LADDERS.items()])


def band_orders(users: DataFrame) -> DataFrame:
    return users.select(
        "user_id", *[ladder.order().alias(f"{n}_order") for n, ladder in LADDERS.items()]
    )


def pick_plans(users: DataFrame, plans: Sequence[str]) -> DataFrame:
    return users.where(F.col("subscription_type").isin(list(plans)))


def filtered(t: Tables, plans: Sequence[str]) -> Tables:
    """The tables under a plan filter: facts keep only the sessions of the picked users."""
    users = pick_plans(t.users, plans)
    ids = users.select("user_id")
    return Tables(
        users=users,
        content=t.content,
        watch_history=join_dimension(t.watch_history, ids, "user_id", "left_semi"),
        ratings=join_dimension(t.ratings, ids, "user_id", "left_semi"),
        watch_key=t.watch_key,
        rating_key=t.rating_key,
    )


def filtered_kpis(t: Tables, plans: Sequence[str]) -> DataFrame:
    """Five headline figures under a plan filter.

    Sessions fold to one row per user before they meet the filter, so a user with a
    large share of the facts does not weigh on the join.
    """
    users = pick_plans(t.users, plans)
    per_user = t.watch_history.groupBy("user_id").agg(
        F.sum("completion_rate").alias("total"), F.count("completion_rate").alias("n")
    )
    completion = (
        per_user.join(users.select("user_id"), "user_id", "left_semi")
        .agg(round_dp(ratio(F.sum("total"), F.sum("n")), 1))
        .scalar()
    )
    return users.agg(
        count_rows().alias("total_users"),
        percent(F.avg("churn"), 2).alias("churn_rate"),
        round_dp(F.avg("tenure_days"), 0).alias("avg_tenure_days"),
        round_dp(F.avg("support_tickets"), 2).alias("avg_support_tickets"),
    ).withColumn("avg_completion", completion)


def date_drill(watch: DataFrame) -> DataFrame:
    """Sessions by year, quarter and month with subtotals.

    Days fold first, so the rollup expands one row per day rather than per session.
    """
    daily = watch.groupBy("watch_date").agg(count_rows().alias("n"))
    day = F.col("watch_date")
    return (
        daily.select(
            F.year(day).alias("year"), F.quarter(day).alias("quarter"), F.month(day).alias("month"), "n"
        )
        .rollup("year", "quarter", "month")
        .agg(F.sum("n").alias("sessions"))
        .orderBy("year", "quarter", "month")
    )


def plan_share(users: DataFrame) -> DataFrame:
    total = users.agg(count_rows()).scalar()
    counted = users.groupBy("subscription_type").agg(count_rows().alias("users"))
    return counted.withColumn("share", round_dp(ratio(F.col("users"), total), 4)).orderBy(
        F.desc("users"), "subscription_type"
    )


def top_titles_with_ties(title_counts: DataFrame, limit: int = 10) -> DataFrame:
    """Top titles by views, keeping every title that ties with the last place.

    Titles fold to one row a number of views; the ``limit`` highest numbers reach that many
    titles, and titles join their places. No task ranks tied titles.
    """
    counts = publish(title_counts, "title-counts")
    highest = counts.groupBy("views").agg(count_rows().alias("_titles")).orderBy(F.desc("views")).limit(limit)
    above = Window.orderBy(F.desc("views")).rowsBetween(Window.unboundedPreceding, -1)
    places = highest.select("views", (F.coalesce(F.sum("_titles").over(above), F.lit(0)) + 1).cast("int").alias("position"))
    # At most ``limit`` rows, whatever the data.
    return counts.join(F.broadcast(places.where(F.col("position") <= limit)), "views").select(*counts.columns, "position")


def old_recency_bands(users: DataFrame) -> DataFrame:
    return churn_by(users, bands.OLD_RECENCY_CUT.label(), "recency_band")


def old_tenure_bands(users: DataFrame) -> DataFrame:
    return churn_by(users, bands.OLD_TENURE_CUT.label(), "tenure_band")
