"""Behavioural risk score, its deciles, and how well it ranks churners."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.functions.bands import quantile_bucket
from holdfast.functions.numbers import count_rows, int_div, percent, ratio, round_small
from holdfast.operators.ordered import ntile_of, quantile_edges, row_index, score_totals

PROFILE_COLUMNS = (
    "user_id",
    "name",
    "age",
    "country",
    "subscription_type",
    "tenure_days",
    "watch_time_hours",
    "favorite_genre",
    "days_since_login",
    "support_tickets",
    "num_devices",
    "churn",
)


def with_raw_score(users: DataFrame, name: str = "raw_score") -> DataFrame:
    """Add idle days against the maximum, minus watch hours against the maximum.

    Both maxima are one scalar subquery; the score is NULL when a maximum is 0.
    """
    top = users.agg(
        F.struct(F.max("days_since_login").alias("days"), F.max("watch_time_hours").alias("watched"))
    ).scalar()
    idle = ratio(F.col("days_since_login"), F.col("_top.days"))
    watched = ratio(F.col("watch_time_hours"), F.col("_top.watched"))
    return users.withColumn("_top", top).withColumn(name, idle - watched).drop("_top")


def scored(users: DataFrame) -> DataFrame:
    proxy = round_small(F.col("raw_score"), 4).alias("risk_proxy")
    return with_raw_score(users.select(*PROFILE_COLUMNS)).select(*PROFILE_COLUMNS, proxy)


def clamp_limit(requested: int | None) -> int:
    """Missing or 0 means 20; never more than 100."""
    return min(requested or 20, 100)


def top_users(users: DataFrame, limit: int | None = None) -> DataFrame:
    ranked = scored(users).orderBy(F.desc_nulls_last("risk_proxy"), "user_id")
    return ranked.limit(clamp_limit(limit))


def find_user(users: DataFrame, user_id: int) -> DataFrame:
    return scored(users).where(F.col("user_id") == user_id)


def status_badges(users: DataFrame, limit: int = 15) -> DataFrame:
    badge = F.when(F.col("churn") == 1, "Churned").otherwise("At risk")
    return top_users(users, limit).select("user_id", "name", "risk_proxy", badge.alias("status"))


def ntile_deciles(users: DataFrame) -> DataFrame:
    """Ten equal-count groups by unrounded score; ties are split by user_id."""
    ranked = row_index(
        with_raw_score(users).select("raw_score", "user_id", "churn"), ["raw_score", "user_id"]
    )
    decile = ntile_of(F.col("row_index"), F.col("_rows"), 10)
    return (
        ranked.withColumn("_rows", users.agg(count_rows()).scalar())
        .groupBy(decile.alias("risk_decile"))
        .agg(count_rows().alias("users"), percent(F.avg("churn"), 1).alias("churn_rate_pct"))
        .orderBy("risk_decile")
    )


def with_quantile_decile(df: DataFrame, score: str, label: str) -> DataFrame:
    """Add ``decile`` by interpolated quantile edges; ties stay together."""
    rows = df.agg(F.count(score))
    edges = quantile_edges(score_totals(df, score, label), rows, 10)
    bucket = quantile_bucket(F.col(score), F.col("_edges"))
    return (
        df.where(F.col(score).isNotNull())
        .withColumn("_edges", edges)
        .withColumn("decile", bucket)
        .drop("_edges")
    )


def decile_summary(deciled: DataFrame, score: str, label: str = "churn") -> DataFrame:
    return (
        deciled.groupBy("decile")
        .agg(
            count_rows().alias("n"),
            percent(F.avg(label), 1).alias("churn_rate"),
            percent(F.avg(score), 1).alias("avg_score"),
        )
        .orderBy("decile")
    )


def capture(deciled: DataFrame, label: str = "churn") -> DataFrame:
    """Share of all positives, and of all rows, in deciles 9 and above."""
    top = F.col("decile") >= 9
    caught = F.sum(F.when(top, F.col(label)).otherwise(0))
    return deciled.agg(
        percent(ratio(caught, F.sum(label)), 1).alias("capture_pct"),
        percent(ratio(F.count_if(top), count_rows()), 1).alias("share_of_base_pct"),
    )


def proxy_deciles(users: DataFrame) -> DataFrame:
    return with_quantile_decile(scored(users), "risk_proxy", "churn")


def decile_tiers(summary: DataFrame) -> DataFrame:
    tier = F.when(F.col("decile") >= 9, "high").when(F.col("decile") <= 3, "low").otherwise("mid")
    label = F.concat(F.lit("D"), F.col("decile").cast("string"))
    return summary.select("decile", label.alias("label"), tier.alias("tier"), "n", "churn_rate")


def rank_deciles(users: DataFrame) -> DataFrame:
    """Ascending rank with ties sharing the lowest rank, scaled to 1..10 and rounded up.

    The decile only grows with the score, so the lowest score of each decile is
    enough to place every user: one ten-element array, no join back.
    """
    base = with_raw_score(users).select("user_id", "churn", "raw_score")
    rows = F.col("_rows")
    rank = F.col("n_upto") - F.col("n") + 1
    starts = (
        score_totals(base, "raw_score", "churn")
        .withColumn("_rows", users.agg(count_rows()).scalar())
        .groupBy(int_div(rank * 10 + rows - 1, rows).cast("int").alias("decile"))
        .agg(F.min("score").alias("start"))
        .agg(F.sort_array(F.collect_list(F.struct("start", "decile"))))
        .scalar()
    )
    reached = F.filter("_starts", lambda s: s["start"] <= F.col("raw_score"))
    return base.withColumn("_starts", starts).select(
        "user_id",
        round_small(F.col("raw_score"), 4).alias("risk_score"),
        F.element_at(reached, -1).getField("decile").alias("risk_decile"),
    )


def auc(df: DataFrame, score: str, label: str = "churn") -> DataFrame:
    """Exact ROC-AUC: pairs ranked right, with half a point for ties."""
    folded = score_totals(df, score, label).select(
        F.col("positives").cast("double").alias("positives"),
        (F.col("n") - F.col("positives")).cast("double").alias("negatives"),
        (F.col("n_upto") - F.col("positives_upto")).cast("double").alias("negatives_upto"),
    )
    won = F.col("positives") * (F.col("negatives_upto") - F.col("negatives") / 2.0)
    pairs = F.sum("positives") * F.sum("negatives")
    return folded.agg(ratio(F.sum(won), pairs).alias("auc"))


def confusion(df: DataFrame, score: str, cut: float, label: str = "churn") -> DataFrame:
    flagged = F.col(score) > cut
    actual = F.col(label) == 1
    right = F.count_if(flagged & actual)
    return df.where(F.col(score).isNotNull()).agg(
        percent(ratio(F.count_if(flagged == actual), count_rows()), 1).alias("accuracy"),
        percent(ratio(right, F.count_if(flagged)), 1).alias("precision"),
        percent(ratio(right, F.count_if(actual)), 1).alias("recall"),
    )
