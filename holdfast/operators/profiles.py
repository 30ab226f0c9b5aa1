"""Text profiles of users and the request texts built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions.numbers import plain_number
from holdfast.operators.risk import proxy_deciles

# The line after each label in a profile, and the request wording.
PROFILE_NOTES = {
    "tenure_days": " (account age)",
    "days_since_login": " (higher = more inactive)",
    "watch_time_hours": " (lifetime; lower = less engaged)",
    "support_tickets": " (more tickets correlate with churn)",
    "churn_label_in_data": " (1 = churned, 0 = retained)",
}
PROFILE_LINES = (
    "user_id",
    "name",
    "age",
    "country",
    "subscription_type",
    "tenure_days",
    "days_since_login",
    "watch_time_hours",
    "favorite_genre",
    "support_tickets",
    "num_devices",
    "churn_label_in_data",
)
TONES = {
    "friendly": "Tone: friendly, concise, professional.",
    "playful": "Tone: warm and playful, but still professional.",
}
REQUEST_HEAD = "User profile:"
REQUEST_TAIL = "Write the win-back email."


def fact_sheet() -> Column:
    """Twelve ``label: value`` lines; a missing value reads null."""

    def line(label: str) -> Column:
        column = F.col("churn" if label == "churn_label_in_data" else label)
        value = plain_number(column, 2) if label == "watch_time_hours" else column.cast("string")
        return F.concat(
            F.lit(f"{label}: "), F.coalesce(value, F.lit("null")), F.lit(PROFILE_NOTES.get(label, ""))
        )

    return F.concat_ws("\n", *[line(label) for label in PROFILE_LINES])


def fact_sheets(users: DataFrame) -> DataFrame:
    return users.select("user_id", fact_sheet().alias("fact_sheet"))


def winback_requests(users: DataFrame) -> DataFrame:
    """A request text per tone for every user in the two riskiest deciles."""
    tones = F.create_map(*[F.lit(part) for pair in TONES.items() for part in pair])
    body = F.concat(F.lit(f"{REQUEST_HEAD}\n"), fact_sheet(), F.lit(f"\n\n{REQUEST_TAIL}"))
    return (
        proxy_deciles(users)
        .where(F.col("decile") >= 9)
        .select("user_id", body.alias("body"), F.explode(tones).alias("tone", "style"))
        .select("user_id", "tone", F.concat("style", F.lit("\n\n"), "body").alias("request"))
    )
