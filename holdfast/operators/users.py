"""Per-user derivations from sessions: totals, recency, z-scores, churn score, genre."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions.numbers import count_rows, ratio, round_dp
from holdfast.operators.joins import join_dimension
from holdfast.sources import tables
from holdfast.sources.workspace import publish

# Fill for users without sessions, and the weights of the churn score.
DEFAULT_COMPLETION = 30.0
INTERCEPT = -1.60
WEIGHTS = {
    "z_recency": 1.55,
    "z_watch": -1.05,
    "z_tenure": -0.30,
    "z_tickets": 0.28,
    "z_completion": -0.22,
    "z_age": 0.03,
}
PLAN_EFFECT = {"Basic": 0.05, "Standard": -0.03, "Premium": -0.10}


def by_user(watch: DataFrame) -> DataFrame:
    """Sessions folded by user, as far as the totals of ``sources.tables`` are not at hand."""
    return tables.session_totals(watch, ("user_id",))


def _with_sessions(users: DataFrame, totals: DataFrame) -> DataFrame:
    """Users with their session totals; one row per watching user enters the join."""
    watched = totals.groupBy("user_id").agg(
        (F.sum("minutes").cast("double") / F.lit(60.0)).alias("hours"),
        ratio(F.sum("completion_sum"), F.sum("completion_n")).alias("completion"),
        F.sum("n").alias("sessions"),
        F.max("last_watch").alias("last_watch"),
    )
    return users.join(watched, "user_id", "left").select(
        *[users[c] for c in users.columns],
        F.coalesce("hours", F.lit(0.0)).alias("total_hours"),
        F.coalesce("completion", F.lit(DEFAULT_COMPLETION)).alias("avg_completion"),
        F.coalesce("sessions", F.lit(0)).alias("n_sessions"),
        "last_watch",
    )


def session_stats(users: DataFrame, watch: DataFrame) -> DataFrame:
    return session_stats_of(users, by_user(watch))


def session_stats_of(users: DataFrame, totals: DataFrame) -> DataFrame:
    return _with_sessions(users, totals).select(
        "user_id",
        round_dp(F.col("total_hours"), 6).alias("total_hours"),
        round_dp(F.col("avg_completion"), 6).alias("avg_completion"),
        "n_sessions",
    )


def _with_recency(users: DataFrame, totals: DataFrame) -> DataFrame:
    """Idle days up to the snapshot; without sessions, the account's whole age."""
    snapshot = totals.agg(F.max("last_watch")).scalar()
    joined = _with_sessions(users, totals).withColumn("snapshot", snapshot)
    idle = F.coalesce(F.datediff("snapshot", "last_watch"), F.col("tenure_days"))
    return joined.withColumn("idle_days", idle)


def recency(users: DataFrame, watch: DataFrame) -> DataFrame:
    return recency_of(users, by_user(watch))


def recency_of(users: DataFrame, totals: DataFrame) -> DataFrame:
    return _with_recency(users, totals).select(
        "user_id",
        F.col("idle_days").alias("days_since_login"),
        F.date_sub("snapshot", F.col("idle_days")).alias("last_login"),
    )


_Z_SOURCES = {
    "z_recency": "idle_days",
    "z_watch": "total_hours",
    "z_tenure": "tenure_days",
    "z_tickets": "support_tickets",
    "z_completion": "avg_completion",
    "z_age": "age",
}


def _with_zscores(users: DataFrame, totals: DataFrame) -> DataFrame:
    """Distance from the mean in sample standard deviations, as one scalar of moments.

    The joined columns are published first: the moments and the scores both read
    them, and the totals are joined once.
    """
    joined = _with_recency(users, totals).select("user_id", "subscription_type", *_Z_SOURCES.values())
    base = publish(joined, "user-totals")
    moments = base.agg(
        F.struct(
            *[F.avg(c).alias(f"mean_{z}") for z, c in _Z_SOURCES.items()],
            *[F.stddev_samp(c).alias(f"std_{z}") for z, c in _Z_SOURCES.items()],
        )
    ).scalar()
    placed = base.withColumn("_m", moments)

    def z(name: str, column: str) -> Column:
        centred = F.col(column) - F.col(f"_m.mean_{name}")
        return centred / (F.col(f"_m.std_{name}") + F.lit(1e-9))

    return placed.select(
        "user_id", "subscription_type", *[z(n, c).alias(n) for n, c in _Z_SOURCES.items()]
    )


def zscores_of(users: DataFrame, totals: DataFrame) -> DataFrame:
    scored = _with_zscores(users, totals)
    return scored.select("user_id", *[round_dp(F.col(z), 6).alias(z) for z in _Z_SOURCES])


def churn_score_of(
    users: DataFrame, totals: DataFrame, plan_effect: Mapping[str, float] = PLAN_EFFECT
) -> DataFrame:
    """Weighted logit and its sigmoid, without any noise term; unknown plans add nothing."""
    plan = F
    for name, effect in plan_effect.items():
        plan = plan.when(F.col("subscription_type") == name, F.lit(effect))
    logit = F.lit(INTERCEPT) + plan.otherwise(F.lit(0.0))
    for name, weight in WEIGHTS.items():
        logit = logit + F.lit(weight) * F.col(name)
    return (
        _with_zscores(users, totals)
        .select("user_id", logit.alias("logit"))
        .select(
            "user_id",
            round_dp(F.col("logit"), 6).alias("logit"),
            round_dp(F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("logit"))), 6).alias("probability"),
        )
    )


def favourite_genre(users: DataFrame, watch: DataFrame, content: DataFrame) -> DataFrame:
    """Most watched genre per user; without sessions, the first genre by name."""
    counts = (
        join_dimension(watch.select("user_id", "content_id"), content.select("content_id", "genre"), "content_id")
        .groupBy("user_id", "genre")
        .agg(count_rows().alias("of_titles"))
    )
    return favourite_genre_of(users, counts, content)


def favourite_genre_of(users: DataFrame, totals: DataFrame, content: DataFrame) -> DataFrame:
    counts = totals.where("of_titles > 0").select("user_id", "genre", F.col("of_titles").alias("n"))
    fallback = content.agg(F.min("genre")).scalar()
    return (
        users.select("user_id")
        .join(tables.favourite_genre(counts), "user_id", "left")
        .select("user_id", F.coalesce("favorite_genre", fallback).alias("favorite_genre"))
    )


def session_minutes(watch: DataFrame, content: DataFrame, key: tuple[str, ...]) -> DataFrame:
    titles = content.select("content_id", "duration_min")
    minutes = tables.session_minutes(F.col("duration_min"), F.col("completion_rate"))
    return join_dimension(watch, titles, "content_id").select(
        *key, "user_id", "content_id", minutes.alias("session_minutes")
    )
