"""Hand-made tables for edge cases."""

from __future__ import annotations

import datetime

from holdfast.sources import schemas
from holdfast.sources.tables import Tables

DAY = datetime.date

USER = dict(
    user_id=1,
    name="Ada",
    age=30,
    country="X",
    subscription_type="Basic",
    signup_date=DAY(2024, 1, 1),
    tenure_days=100,
    watch_time_hours=2.0,
    favorite_genre="Drama",
    last_login=DAY(2024, 4, 1),
    days_since_login=9,
    support_tickets=0,
    num_devices=1,
    churn=0,
)
TITLE = dict(content_id="C000001", title="One", genre="Drama", release_year=2020, duration_min=100)
SESSION = dict(
    watch_id=1,
    user_id=1,
    content_id="C000001",
    watch_date=DAY(2024, 2, 1),
    session_duration=50.0,
    completion_rate=50.0,
)
RATING = dict(rating_id=1, user_id=1, content_id="C000001", rating=4)


def frame(spark, name, base, rows):
    schema = schemas.ALL[name]
    filled = [{**base, **row} for row in rows]
    return spark.createDataFrame([tuple(r[f.name] for f in schema) for r in filled], schema)


def make(spark, users=({},), content=({},), watch=({},), ratings=({},)) -> Tables:
    return Tables(
        users=frame(spark, "users", USER, users),
        content=frame(spark, "content", TITLE, content),
        watch_history=frame(spark, "watch_history", SESSION, watch),
        ratings=frame(spark, "ratings", RATING, ratings),
    )
