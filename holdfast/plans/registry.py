"""Every report by its key, over a folder with the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.functions import bands
from holdfast.functions.numbers import count_rows, percent, round_dp
from holdfast.operators import (
    bi,
    content,
    guard,
    model,
    profiles,
    quality,
    risk,
    segments,
    throttle,
    users,
)
from holdfast.plans import bundle, library
from holdfast.sources import schemas
from holdfast.sources.tables import Tables, load, load_events
from holdfast.streaming import throttle as streaming

Query = Callable[[SparkSession, str], DataFrame]

# The given tables name plans by market segment.
PLANS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
PICKED_PLANS = ("BUILDING", "MACHINERY")
PLAN_EFFECT = {"AUTOMOBILE": 0.05, "BUILDING": -0.03, "FURNITURE": -0.10}
# The given log has about two requests of a key a day.
DAILY_QUOTA = (throttle.DAY_US, 2)
SAMPLE_STATEMENT = (
    "SELECT u.country, count(*) AS sessions, max(w.watch_date) AS last_day "
    "FROM watch_history w JOIN users u ON u.user_id = w.user_id GROUP BY u.country;"
)

_models: dict[tuple[str, str], tuple[Tables, model.ChurnModel]] = {}


def churn_model(spark: SparkSession, sf_dir: str) -> model.ChurnModel:
    """The model over a folder's users, fitted once for the tables that are loaded."""
    key, t = (spark.sparkContext.applicationId, sf_dir), load(spark, sf_dir)
    if key not in _models or _models[key][0] is not t:
        _models[key] = (t, model.fit(t.users))
    return _models[key][1]


def _on_tables(report: Callable[[Tables], DataFrame]) -> Query:
    return lambda spark, sf_dir: report(load(spark, sf_dir))


def _on_picked(report: Callable[[Tables], DataFrame]) -> Query:
    """The report under the plan filter of the dashboard."""
    return _on_tables(lambda t: report(bi.filtered(t, PICKED_PLANS)))


def _on_model(report: Callable[[model.ChurnModel], DataFrame]) -> Query:
    return lambda spark, sf_dir: report(churn_model(spark, sf_dir))


def _on_events(report: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: report(load_events(spark, sf_dir))


def _churn_by(column: str) -> Callable[[Tables], DataFrame]:
    return lambda t: segments.churn_by(t.users, F.col(column), column, F.desc("churn_rate"), F.col(column))


def _churn_by_cut(cut: bands.Cut, name: str) -> Callable[[Tables], DataFrame]:
    return lambda t: segments.churn_by(t.users, cut.label(), name)


def _best_rated_genre(t: Tables) -> DataFrame:
    ranked = library.genre_ratings(t, at_least=1)
    return ranked.select("genre", "avg_rating").orderBy(F.desc("avg_rating"), "genre").limit(1)


def _top_churn_country(t: Tables) -> DataFrame:
    return _churn_by("country")(t).limit(1)


def _overall_churn(t: Tables) -> DataFrame:
    return t.users.agg(percent(F.avg("churn"), 2).alias("churn_rate_pct"))


def _churn_with_tickets(t: Tables) -> DataFrame:
    many = t.users.where(F.col("support_tickets") >= 3)
    return many.agg(count_rows().alias("users"), percent(F.avg("churn"), 2).alias("churn_rate_pct"))


def _document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundle.document(load(spark, sf_dir), churn_model(spark, sf_dir))


_SOURCES: dict[str, Query] = {
    "src_users": _on_tables(lambda t: t.users),
    "src_content": _on_tables(lambda t: t.content),
    "src_watch_history": _on_tables(lambda t: t.watch_history),
    "src_ratings": _on_tables(lambda t: t.ratings),
    "src_row_counts": _on_tables(quality.row_counts),
    "src_null_normalise": _on_tables(lambda t: quality.null_normalised(t.users, schemas.USERS.names)),
    "sink_dashboard_json": lambda spark, sf_dir: bundle.json_document(_document(spark, sf_dir)),
}

_LIBRARY: dict[str, Query] = {
    "sql_b1_total_users": _on_tables(library.total_users),
    "sql_b2_users_by_plan": _on_tables(library.users_by_plan),
    "sql_b3_engagement": _on_tables(library.engagement),
    "sql_b4_titles_by_genre": _on_tables(library.titles_by_genre),
    "sql_b5_avg_rating": _on_tables(library.average_rating),
    "sql_i1_genre_engagement": _on_tables(library.genre_engagement),
    "sql_i2_top_titles": _on_tables(library.top_titles),
    "sql_i3_churn_by_plan": _on_tables(library.churn_by_plan),
    "sql_i4_genre_completion": _on_tables(library.genre_completion),
    "sql_i5_genre_ratings": _on_tables(library.genre_ratings),
    "sql_i6_recency_bands": _on_tables(library.recency_bands),
    "sql_i7_tenure_bands": _on_tables(library.tenure_bands),
    "sql_i8_ticket_bands": _on_tables(library.ticket_bands),
    "sql_a1_genre_rank": _on_tables(library.genre_rank),
    "sql_a2_top_user_per_country": _on_tables(library.top_user_per_country),
    "sql_a3_monthly_lag": _on_tables(library.monthly_change),
    "sql_a4_plan_vs_benchmark": _on_tables(library.plan_vs_benchmark),
    "sql_a5_top3_titles_per_genre": _on_tables(library.top_titles_per_genre),
    "sql_a6_ntile_deciles": _on_tables(library.risk_ntile),
    "sql_a7_signup_cohorts": _on_tables(library.signup_cohorts),
}

_ANALYSIS: dict[str, Query] = {
    "an_kpis": _on_tables(bundle.headline),
    "an_avg_session_duration": _on_tables(lambda t: bundle.average_session(t.watch_history)),
    "an_churn_by_subscription": _on_tables(_churn_by("subscription_type")),
    "an_users_by_subscription": _on_tables(lambda t: segments.users_by(t.users, "subscription_type")),
    "an_churn_by_country": _on_tables(_churn_by("country")),
    "an_users_by_country": _on_tables(lambda t: segments.users_by(t.users, "country")),
    "an_churn_by_genre": _on_tables(_churn_by("favorite_genre")),
    "an_churn_by_age_band": _on_tables(_churn_by_cut(bands.AGE_CUT, "age_band")),
    "an_churn_by_recency_band": _on_tables(_churn_by_cut(bands.RECENCY_CUT, "recency_band")),
    "an_churn_by_watch_band": _on_tables(_churn_by_cut(bands.WATCH_CUT, "watch_band")),
    "an_churn_by_ticket_band": _on_tables(_churn_by_cut(bands.TICKET_CUT, "ticket_band")),
    "an_churn_by_tenure_band": _on_tables(_churn_by_cut(bands.TENURE_CUT, "tenure_band")),
    "an_recency_curve": _on_tables(lambda t: segments.recency_curve(t.users)),
    "an_watch_time_curve": _on_tables(lambda t: segments.watch_time_curve(t.users)),
    "an_parity_spread": _on_tables(lambda t: segments.parity_spread(t.users)),
    "an_genre_views": _on_tables(lambda t: content.genre_views(t.watch_history, t.content)),
    "an_genre_completion": _on_tables(lambda t: content.genre_completion(t.watch_history, t.content)),
    "an_top_content": _on_tables(lambda t: content.top_rated(t.ratings, t.content)),
    "an_most_watched": _on_tables(lambda t: content.most_watched(t.watch_history, t.content)),
    "an_views_by_release_year": _on_tables(lambda t: content.views_by_release_year(t.watch_history, t.content)),
    "an_monthly_sessions": _on_tables(lambda t: content.monthly_sessions(t.watch_history)),
    "an_monthly_completion": _on_tables(lambda t: content.monthly_completion(t.watch_history)),
}

_RISK: dict[str, Query] = {
    "risk_proxy": _on_tables(lambda t: risk.scored(t.users)),
    "risk_top_users": _on_tables(lambda t: risk.top_users(t.users)),
    "risk_user_lookup": _on_tables(lambda t: risk.find_user(t.users, 42)),
    "risk_qcut_deciles": _on_tables(
        lambda t: risk.decile_summary(risk.proxy_deciles(t.users), "risk_proxy")
    ),
    "risk_capture": _on_tables(lambda t: risk.capture(risk.proxy_deciles(t.users))),
    "risk_rank_deciles": _on_tables(lambda t: risk.rank_deciles(t.users)),
    "risk_decile_tier": _on_tables(
        lambda t: risk.decile_tiers(risk.decile_summary(risk.proxy_deciles(t.users), "risk_proxy"))
    ),
    "risk_status_badge": _on_tables(lambda t: risk.status_badges(t.users)),
    "ml_features": _on_tables(lambda t: model.feature_totals(t.users)),
    "ml_feature_rows": _on_tables(lambda t: model.feature_rows(t.users)),
    "ml_split": _on_tables(lambda t: model.split(t.users)),
    "ml_zscore": _on_tables(lambda t: model.zscores(t.users)),
    "ml_logistic": _on_model(model.coefficient_report),
    "ml_auc": _on_tables(
        lambda t: risk.auc(risk.scored(t.users), "risk_proxy").select(round_dp(F.col("auc"), 6).alias("auc"))
    ),
    "ml_confusion": _on_tables(lambda t: risk.confusion(risk.scored(t.users), "risk_proxy", 0.0)),
    "ml_driver_coefs": _on_model(model.drivers),
    "ml_scored_deciles": _on_model(model.scored_deciles),
}

_USERS: dict[str, Query] = {
    "user_session_stats": _on_tables(lambda t: users.session_stats_of(t.users, t.user_totals)),
    "user_recency": _on_tables(lambda t: users.recency_of(t.users, t.user_totals)),
    "user_zscores": _on_tables(lambda t: users.zscores_of(t.users, t.user_totals)),
    "user_churn_score": _on_tables(lambda t: users.churn_score_of(t.users, t.user_totals, PLAN_EFFECT)),
    "user_favourite_genre": _on_tables(lambda t: users.favourite_genre_of(t.users, t.user_totals, t.content)),
    "session_minutes": _on_tables(lambda t: users.session_minutes(t.watch_history, t.content, t.watch_key)),
}

_BI: dict[str, Query] = {
    "bi_measures": _on_tables(bi.measures),
    "bi_churn_vs_benchmark": _on_tables(lambda t: bi.churn_vs_benchmark(t.users)),
    "bi_bands": _on_tables(lambda t: bi.band_columns(t.users)),
    "bi_band_order": _on_tables(lambda t: bi.band_orders(t.users)),
    "bi_measure_by_segment": _on_tables(
        lambda t: bi.measures_by(t.users, bands.RECENCY.label(), "recency_band")
    ),
    "bi_plan_slicer": _on_tables(
        lambda t: bi.pick_plans(t.users, PICKED_PLANS).select("user_id", "subscription_type", "churn")
    ),
    "bi_filtered_facts": _on_tables(lambda t: bi.filtered(t, PICKED_PLANS).watch_history),
    "bi_filtered_kpis": _on_tables(lambda t: bi.filtered_kpis(t, PICKED_PLANS)),
    "bi_date_hierarchy": _on_tables(lambda t: bi.date_drill(t.watch_history)),
    "bi_plan_share": _on_tables(lambda t: bi.plan_share(t.users)),
    "bi_top_titles": _on_tables(lambda t: bi.top_titles_with_ties(library.views_by_title(t))),
    "lg_recency_bands": _on_tables(lambda t: bi.old_recency_bands(t.users)),
    "lg_tenure_bands": _on_tables(lambda t: bi.old_tenure_bands(t.users)),
    "lg_churn_by_tickets": _on_picked(_churn_by_cut(bands.TICKET_CUT, "ticket_band")),
    "lg_churn_by_country": _on_picked(_churn_by("country")),
    "lg_genre_views": _on_picked(lambda t: content.genre_views(t.watch_history, t.content)),
    "lg_genre_completion": _on_picked(lambda t: content.genre_completion(t.watch_history, t.content)),
    "lg_top_content": _on_picked(lambda t: content.top_rated(t.ratings, t.content)),
    "lg_monthly_sessions": _on_picked(lambda t: content.monthly_sessions(t.watch_history)),
    "lg_monthly_completion": _on_picked(lambda t: content.monthly_completion(t.watch_history)),
    "lg_views_by_release_year": _on_picked(
        lambda t: content.views_by_release_year(t.watch_history, t.content)
    ),
    "lg_guarded_model": _on_tables(lambda t: model.guarded_deciles(bi.pick_plans(t.users, PICKED_PLANS))),
}

_QUALITY: dict[str, Query] = {
    "dq_pk": _on_tables(quality.key_findings),
    "dq_fk": _on_tables(quality.orphans),
    "dq_domain": _on_tables(lambda t: quality.domain_violations(t, PLANS)),
    "dq_session_window": _on_tables(quality.sessions_outside_membership),
    "dq_outside_bands": _on_tables(lambda t: segments.outside_bands(t.users)),
}

_REQUESTS: dict[str, Query] = {
    "guard_audit": _on_events(
        lambda e: guard.audit(guard.statement_log(e)).select("stmt_id", "statement", "problem", "accepted")
    ),
    "guard_row_cap": _on_events(
        lambda e: guard.with_row_cap(guard.audit(guard.statement_log(e))).select("stmt_id", "capped_sql")
    ),
    "guard_audit_text": lambda spark, sf_dir: guard.audit(
        guard.text_lookups(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    ).select("stmt_id", "statement", "problem", "accepted"),
    "guarded_summary": lambda spark, sf_dir: guard.guarded_summary(
        spark, load(spark, sf_dir), SAMPLE_STATEMENT
    ),
    "guarded_answer": lambda spark, sf_dir: guard.guarded_answer(spark, load(spark, sf_dir), SAMPLE_STATEMENT),
    "guarded_query": lambda spark, sf_dir: guard.guarded_query(spark, load(spark, sf_dir), SAMPLE_STATEMENT),
    "user_fact_sheets": _on_tables(lambda t: profiles.fact_sheets(t.users)),
    "winback_requests": _on_tables(lambda t: profiles.winback_requests(t.users)),
    "risk_reasons": _on_model(model.reasons),
    "throttle_batch": _on_events(lambda e: throttle.throttle_batch(e, *DAILY_QUOTA)),
    "throttle_text_keys": _on_events(lambda e: throttle.throttle_batch(e, throttle.DAY_US, throttle.QUOTA, "event_type")),
    "throttle_stream": lambda spark, sf_dir: streaming.replay(
        streaming.open_log(spark, sf_dir, "events.parquet"), *DAILY_QUOTA
    ),
    "ask_overall_churn": _on_tables(_overall_churn),
    "ask_top_churn_country": _on_tables(_top_churn_country),
    "ask_churn_by_plan": _on_tables(library.churn_by_plan),
    "ask_churn_3plus_tickets": _on_tables(_churn_with_tickets),
    "ask_best_rated_genre": _on_tables(_best_rated_genre),
    "ask_churn_by_tenure": _on_tables(library.tenure_bands),
}

_BUNDLE: dict[str, Query] = {
    "bundle_maps_to_rows": _on_tables(lambda t: bundle.map_rows(t.users)),
    "bundle_growth_rows": _on_tables(lambda t: bundle.growth_rows(t.watch_history)),
    "bundle_month_label": _on_tables(lambda t: bundle.month_labels(t.watch_history)),
    "bundle_kpi_cards": _on_tables(bundle.kpi_cards),
    "bundle_model_cards": lambda spark, sf_dir: bundle.kpi_cards(load(spark, sf_dir), churn_model(spark, sf_dir)),
    "bundle_full": _document,
}

QUERIES: dict[str, Query] = {
    **_SOURCES,
    **_LIBRARY,
    **_ANALYSIS,
    **_RISK,
    **_USERS,
    **_BI,
    **_QUALITY,
    **_REQUESTS,
    **_BUNDLE,
}
