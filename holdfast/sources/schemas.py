"""Explicit schemas of the four tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

USERS = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("age", T.IntegerType()),
        T.StructField("country", T.StringType()),
        T.StructField("subscription_type", T.StringType()),
        T.StructField("signup_date", T.DateType()),
        T.StructField("tenure_days", T.IntegerType()),
        T.StructField("watch_time_hours", T.DoubleType()),
        T.StructField("favorite_genre", T.StringType()),
        T.StructField("last_login", T.DateType()),
        T.StructField("days_since_login", T.IntegerType()),
        T.StructField("support_tickets", T.IntegerType()),
        T.StructField("num_devices", T.IntegerType()),
        T.StructField("churn", T.IntegerType()),
    ]
)

CONTENT = T.StructType(
    [
        T.StructField("content_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("genre", T.StringType()),
        T.StructField("release_year", T.IntegerType()),
        T.StructField("duration_min", T.IntegerType()),
    ]
)

WATCH_HISTORY = T.StructType(
    [
        T.StructField("watch_id", T.LongType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("content_id", T.StringType()),
        T.StructField("watch_date", T.DateType()),
        T.StructField("session_duration", T.DoubleType()),
        T.StructField("completion_rate", T.DoubleType()),
    ]
)

RATINGS = T.StructType(
    [
        T.StructField("rating_id", T.LongType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("content_id", T.StringType()),
        T.StructField("rating", T.ShortType()),
    ]
)

ALL = {"users": USERS, "content": CONTENT, "watch_history": WATCH_HISTORY, "ratings": RATINGS}
