"""Key, reference and domain checks; Spark does not enforce them on write."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions.numbers import count_rows
from holdfast.sources.tables import Tables


def _stack(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def row_counts(t: Tables) -> DataFrame:
    return _stack(
        [
            df.agg(count_rows().alias("n")).select(F.lit(name).alias("table_name"), "n")
            for name, df in t.named().items()
        ]
    )


def null_normalised(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns in the given order; blank text becomes NULL."""
    text = {f.name for f in df.schema.fields if f.dataType.typeName() == "string"}
    return df.select(
        *[F.nullif(F.trim(F.col(c)), F.lit("")).alias(c) if c in text else F.col(c) for c in columns]
    )


def key_findings(t: Tables) -> DataFrame:
    """Per table: rows with a NULL key part, keys held by several rows, rows beyond the first."""
    frames = []
    for name, key in t.keys().items():
        missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in key])
        per_key = t.named()[name].groupBy(*key).agg(count_rows().alias("rows"))
        repeated = ~missing & (F.col("rows") > 1)
        frames.append(
            per_key.agg(
                F.coalesce(F.sum(F.when(missing, F.col("rows"))), F.lit(0)).alias("null_keys"),
                F.count_if(repeated).alias("repeated_keys"),
                F.coalesce(F.sum(F.when(repeated, F.col("rows") - 1)), F.lit(0)).alias("surplus_rows"),
            ).select(F.lit(name).alias("table_name"), "null_keys", "repeated_keys", "surplus_rows")
        )
    return _stack(frames)


def orphans(t: Tables) -> DataFrame:
    """Rows per foreign key without a parent; each key joins once, with its row count."""
    frames = []
    for fact in ("watch_history", "ratings"):
        for parent, key in (("users", "user_id"), ("content", "content_id")):
            per_key = t.named()[fact].where(F.col(key).isNotNull()).groupBy(key).agg(count_rows().alias("rows"))
            parents = t.named()[parent].select(key)
            frames.append(
                per_key.join(parents, key, "left_anti")
                .agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("orphan_rows"))
                .select(F.lit(f"{fact}.{key}").alias("relationship"), "orphan_rows")
            )
    return _stack(frames)


def _violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    names = list(checks)
    counted = df.agg(*[F.count_if(~ok).alias(name) for name, ok in checks.items()])
    return counted.unpivot([], names, "check_name", "violations")


def domain_violations(t: Tables, plans: Sequence[str]) -> DataFrame:
    """Values outside their domain; NULL breaks no rule."""
    return _stack(
        [
            _violations(
                t.users,
                {
                    "churn_is_0_or_1": F.col("churn").isin(0, 1),
                    "plan_is_known": F.col("subscription_type").isin(list(plans)),
                },
            ),
            _violations(t.ratings, {"rating_1_to_5": F.col("rating").between(1, 5)}),
            _violations(t.watch_history, {"completion_0_to_100": F.col("completion_rate").between(0, 100)}),
        ]
    )


def sessions_outside_membership(t: Tables) -> DataFrame:
    """Sessions before signup or after the last login, counted per user and day first."""
    daily = t.watch_history.groupBy("user_id", "watch_date").agg(count_rows().alias("rows"))
    spans = t.users.select("user_id", "signup_date", "last_login")

    def rows_where(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("rows"))), F.lit(0))

    return daily.join(spans, "user_id").agg(
        rows_where(F.col("watch_date") < F.col("signup_date")).alias("before_signup"),
        rows_where(F.col("watch_date") > F.col("last_login")).alias("after_last_login"),
        F.sum("rows").alias("sessions"),
    )
