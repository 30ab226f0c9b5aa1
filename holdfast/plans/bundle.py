"""The dashboard document: every metric in one row, and the rows charts read from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions import bands
from holdfast.functions.numbers import count_rows, percent, plain_number, ratio, round_dp
from holdfast.operators import content, model, risk, segments
from holdfast.operators.model import ChurnModel
from holdfast.sources.tables import Tables
from holdfast.sources.workspace import publish


def headline(t: Tables, months: DataFrame | None = None) -> DataFrame:
    """The eleven headline figures in one row, one scan per table.

    ``months`` takes monthly totals that are already at hand.
    """
    months = content.monthly_totals(t.watch_history) if months is None else months
    completion = ratio(F.sum("completion_sum"), F.sum("completion_n"))
    watched = months.agg(
        F.struct(
            F.coalesce(F.sum("sessions"), F.lit(0)).alias("total_sessions"),
            round_dp(completion, 1).alias("avg_completion_rate"),
        )
    ).scalar()
    rated = t.ratings.agg(
        F.struct(count_rows().alias("total_ratings"), round_dp(F.avg("rating"), 2).alias("avg_rating"))
    ).scalar()
    titles = t.content.agg(count_rows()).scalar()
    return (
        t.users.agg(
            count_rows().alias("total_users"),
            percent(F.avg("churn"), 2).alias("churn_rate"),
            round_dp(F.avg("watch_time_hours"), 2).alias("avg_watch_time"),
            F.countDistinct("country").alias("countries"),
            round_dp(F.avg("tenure_days"), 0).alias("avg_tenure_days"),
            round_dp(F.avg("support_tickets"), 2).alias("avg_support_tickets"),
        )
        .withColumn("_w", watched)
        .withColumn("_r", rated)
        .withColumn("total_titles", titles)
        .select("*", "_w.*", "_r.*")
        .drop("_w", "_r")
    )


def average_session_of(months: DataFrame) -> DataFrame:
    minutes = ratio(F.sum("duration_sum"), F.sum("duration_n"))
    return months.agg(round_dp(minutes, 1).alias("avg_session_duration"))


def average_session(watch: DataFrame) -> DataFrame:
    return average_session_of(content.monthly_totals(watch))


def _packed_map(rows: DataFrame, key: str, value: str, order: Column) -> Column:
    """(key -> value) in one map; ``order`` fixes the order of its entries.

    Only reports with one row per segment, genre, year, month or decile come here.
    """
    entries = F.sort_array(
        F.collect_list(F.struct(order.alias("o"), F.col(key).cast("string").alias("k"), F.col(value).alias("v")))
    )
    packed = rows.agg(entries.alias("entries"))
    keys, values = F.col("entries.k"), F.col("entries.v")
    return packed.select(F.map_from_arrays(keys, values)).scalar()


def _packed_rows(rows: DataFrame, order: Column, *columns: str) -> Column:
    entries = F.sort_array(F.collect_list(F.struct(order.alias("o"), F.struct(*columns).alias("row"))))
    return rows.agg(entries.alias("entries")).select(F.col("entries.row")).scalar()


# Segment reports and the names they carry in the document.
CHURN_MAPS = {
    "subscription": "churn_by_subscription",
    "country": "churn_by_country",
    "genre": "churn_by_genre",
    "age_band": "churn_by_age_band",
    "recency_band": "churn_by_recency_band",
    "watch_band": "churn_by_watch_band",
    "support_tickets": "churn_by_support_tickets",
    "tenure_band": "churn_by_tenure_band",
}
COUNT_MAPS = {"subscription": "users_by_subscription", "country": "users_by_country"}


BAND_LABELS = {
    "age_band": bands.AGE_CUT.labels,
    "recency_band": bands.RECENCY_CUT.labels,
    "watch_band": bands.WATCH_CUT.labels,
    "support_tickets": bands.TICKET_CUT.labels,
    "tenure_band": bands.TENURE_CUT.labels,
}


def segment_maps(users: DataFrame) -> DataFrame:
    """One row with all segment maps, from one scan of the users."""
    cells = segments.all_segments(users)

    def packed(segment: str, value: str) -> Column:
        # Bands keep their axis order; names go by falling value, plans by name.
        if segment in BAND_LABELS:
            labels = F.array(*[F.lit(label) for label in BAND_LABELS[segment]])
            order = F.array_position(labels, F.col("value"))
        elif segment == "subscription" and value == "churn_rate":
            order = F.lit(0)
        else:
            order = -F.col(value)
        mine = F.col("segment") == segment
        entry = F.struct(order.cast("double").alias("o"), F.col("value").alias("k"), F.col(value).alias("v"))
        return F.sort_array(F.collect_list(F.when(mine, entry)))

    names = [(s, "churn_rate", n) for s, n in CHURN_MAPS.items()]
    names += [(s, "users", n) for s, n in COUNT_MAPS.items()]
    lists = cells.agg(*[packed(segment, value).alias(name) for segment, value, name in names])
    return lists.select(
        *[F.map_from_arrays(F.col(f"{n}.k"), F.col(f"{n}.v")).alias(n) for _, _, n in names]
    )


def document(t: Tables, churn_model: ChurnModel) -> DataFrame:
    """All 39 metrics as one row of scalars, maps and arrays of structs.

    Views per title and totals per month are published, so the many metrics on
    sessions scan the facts twice in all.
    """
    by_title = publish(content.title_views(t.watch_history, t.content, "left"), "title-views")
    months = publish(content.monthly_totals(t.watch_history), "months")
    growth = content.growth_of(months)
    genre = by_title.where(F.col("genre").isNotNull()).groupBy("genre").agg(
        F.sum("views").alias("views"), content.mean_completion(1).alias("completion")
    )
    deciled = model.model_deciles(churn_model)
    deciles = risk.decile_summary(deciled, "probability")
    quality = model.evaluation(churn_model).select(F.struct("*")).scalar()
    caught = risk.capture(deciled).select(F.struct("*")).scalar()
    maps = segment_maps(t.users).select(F.struct("*")).scalar()
    wide = (
        headline(t, months)
        .withColumn("_maps", maps)
        .withColumn("_quality", quality)
        .withColumn("_caught", caught)
        .withColumn("avg_session_duration", average_session_of(months).scalar())
        .withColumn(
            "recency_curve", _packed_rows(segments.recency_curve(t.users), F.col("x"), "x", "churn_rate", "n")
        )
        .withColumn(
            "watch_time_curve",
            _packed_rows(segments.watch_time_curve(t.users), F.col("x"), "x", "churn_rate", "n"),
        )
        .withColumn(
            "churn_driver_coefs",
            _packed_map(model.drivers(churn_model), "feature", "coefficient", -F.abs("coefficient")),
        )
        .withColumn(
            "risk_deciles", _packed_rows(deciles, F.col("decile"), "decile", "n", "churn_rate", "avg_score")
        )
        .withColumn("genre_views", _packed_map(genre, "genre", "views", -F.col("views")))
        .withColumn("genre_completion", _packed_map(genre, "genre", "completion", -F.col("completion")))
        .withColumn(
            "top_content",
            _packed_rows(
                content.best_rated(t.ratings, t.content),
                F.struct(-F.col("mean"), "content_id"),
                "title",
                "genre",
                "avg_rating",
                "n",
            ),
        )
        .withColumn(
            "most_watched_content",
            _packed_rows(
                content.most_watched_of(by_title), F.struct(-F.col("views"), "content_id"), "title", "genre", "views"
            ),
        )
        .withColumn(
            "views_by_release_year",
            _packed_map(
                content.views_by_year_of(by_title),
                "release_year",
                "views",
                F.col("release_year"),
            ),
        )
        .withColumn("monthly_sessions", _packed_map(growth, "month", "sessions", F.col("month")))
        .withColumn("monthly_completion", _packed_map(growth, "month", "completion", F.col("month")))
    )
    return wide.select(
        "*",
        "_maps.*",
        F.col("_quality.auc").alias("model_auc"),
        F.col("_quality.accuracy").alias("model_accuracy"),
        F.col("_quality.precision").alias("model_precision"),
        F.col("_quality.recall").alias("model_recall"),
        F.col("_caught.capture_pct").alias("top2decile_capture_pct"),
        F.col("_caught.share_of_base_pct").alias("top2decile_share_of_base"),
    ).drop("_maps", "_quality", "_caught")


def json_document(wide: DataFrame) -> DataFrame:
    return wide.select(F.to_json(F.struct(*wide.columns), {"pretty": "true"}).alias("document"))


def map_rows(users: DataFrame) -> DataFrame:
    """(metric, name, value) rows from the churn maps of the document."""
    maps = segment_maps(users)
    metrics = F.create_map(*[part for n in CHURN_MAPS.values() for part in (F.lit(n), F.col(n))])
    return maps.select(F.explode(metrics).alias("metric", "entries")).select(
        "metric", F.explode("entries").alias("name", "value")
    )


def month_label(month: Column) -> Column:
    """2023-06 -> Jun 23."""
    return F.date_format(F.to_date(month, "yyyy-MM"), "MMM yy")


def growth_rows(watch: DataFrame) -> DataFrame:
    growth = content.monthly_growth(watch)
    return growth.select("month", month_label(F.col("month")).alias("name"), "sessions", "completion")


def month_labels(watch: DataFrame) -> DataFrame:
    months = content.monthly_sessions(watch)
    return months.select("month", month_label(F.col("month")).alias("label"))


def kpi_cards(t: Tables, churn_model: ChurnModel | None = None) -> DataFrame:
    """Six formatted figures. The capture card shows the top two deciles of the model's
    probability, or of the proxy score where no model is given."""
    deciled = model.model_deciles(churn_model) if churn_model else risk.proxy_deciles(t.users)
    caught = risk.capture(deciled).select("capture_pct").scalar()
    row = headline(t).withColumn("captured", caught)

    def thousands(column: str) -> Column:
        return F.format_number(F.col(column), 0)

    return row.select(
        thousands("total_users").alias("Total Users"),
        F.concat(plain_number(F.col("churn_rate"), 2), F.lit("%")).alias("Churn Rate"),
        F.concat(F.col("avg_tenure_days").cast("long").cast("string"), F.lit(" days")).alias("Avg Tenure"),
        F.col("countries").cast("string").alias("Countries"),
        thousands("total_sessions").alias("Total Sessions"),
        F.concat(plain_number(F.col("captured"), 1), F.lit("%")).alias("Top-Decile Capture"),
    ).unpivot(
        [],
        ["`Total Users`", "`Churn Rate`", "`Avg Tenure`", "Countries", "`Total Sessions`", "`Top-Decile Capture`"],
        "label",
        "value",
    )
