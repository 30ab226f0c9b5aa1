"""Files, quality checks, derivations and the document on small and given tables."""

from __future__ import annotations

import datetime
import json

import pytest
from pyspark.sql import functions as F

import small
from holdfast.operators import bi, content, joins, quality, segments, users
from holdfast.plans import bundle, library, registry
from holdfast.sources import files, workspace


def test_csv_round_trip(spark, tmp_path):
    t = small.make(spark, users=[dict(user_id=1, name=None), dict(user_id=2, name="Bo, \"B\"")])
    files.write_csv_tables(t, str(tmp_path))
    back = files.read_csv_tables(spark, str(tmp_path))
    for name, df in t.named().items():
        assert back.named()[name].schema.names == df.schema.names
        assert sorted(map(tuple, back.named()[name].collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    header = spark.read.text(str(tmp_path / "users_with_churn.csv")).first().value
    assert header.startswith("User_ID,Name,Age,Country,Subscription_Type,Signup_Date,Tenure_Days")


def test_csv_header_is_checked(spark, tmp_path):
    (tmp_path / "ratings.csv").write_text("user_id,rating_id,content_id,rating\n1,2,C1,5\n")
    with pytest.raises(Exception, match="(?i)header"):
        files.read_csv(spark, str(tmp_path), "ratings").collect()


def test_empty_field_is_null(spark, tmp_path):
    (tmp_path / "content.csv").write_text("content_id,title,genre,release_year,duration_min\nC1,,Drama,,90\n")
    assert tuple(files.read_csv(spark, str(tmp_path), "content").first()) == ("C1", None, "Drama", None, 90)


def test_unreachable_database_falls_back_to_files(spark, tmp_path):
    files.write_csv_tables(small.make(spark), str(tmp_path))
    t = files.read_tables(spark, str(tmp_path), url="jdbc:nosuchdriver://nowhere/db")
    assert t.users.count() == 1


def test_shared_folder_follows_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    folder = workspace.shared_folder(spark)
    assert folder == configured.rstrip("/") if configured else folder


def test_quality_findings(spark):
    t = small.make(
        spark,
        users=[dict(user_id=1), dict(user_id=1), dict(user_id=None), dict(user_id=2, churn=7, subscription_type="Z")],
        watch=[dict(watch_id=1, user_id=9), dict(watch_id=2, content_id="C9"), dict(watch_id=3, completion_rate=101.0),
               dict(watch_id=4, user_id=2, watch_date=datetime.date(2023, 1, 1)),
               dict(watch_id=5, user_id=2, watch_date=datetime.date(2024, 4, 2))],
        ratings=[dict(rating_id=1, rating=6), dict(rating_id=1, rating=0)],
    )
    keys = {r.table_name: tuple(r)[1:] for r in quality.key_findings(t).collect()}
    assert keys == {"users": (1, 1, 1), "content": (0, 0, 0), "watch_history": (0, 0, 0), "ratings": (0, 1, 1)}
    assert {r.relationship: r.orphan_rows for r in quality.orphans(t).collect()} == {
        "watch_history.user_id": 1, "watch_history.content_id": 1, "ratings.user_id": 0, "ratings.content_id": 0}
    assert {r.check_name: r.violations for r in quality.domain_violations(t, ["Basic"]).collect()} == {
        "churn_is_0_or_1": 1, "plan_is_known": 1, "rating_1_to_5": 2, "completion_0_to_100": 1}
    only = small.make(spark, users=[dict(user_id=2)], watch=[
        dict(user_id=2, watch_date=datetime.date(2023, 1, 1)), dict(user_id=2, watch_date=datetime.date(2024, 4, 2)),
        dict(user_id=2)])
    assert tuple(quality.sessions_outside_membership(only).first()) == (1, 1, 3)


def test_blank_text_becomes_null(spark):
    t = small.make(spark, users=[dict(name="  ", country="")])
    row = quality.null_normalised(t.users, ["country", "user_id", "name"]).first()
    assert tuple(row) == (None, 1, None)


def test_users_without_sessions_are_filled(spark):
    t = small.make(spark, users=[dict(user_id=1), dict(user_id=2, tenure_days=40)],
                   content=[dict(), dict(content_id="C2", genre="Action")])
    stats = {r.user_id: tuple(r)[1:] for r in users.session_stats(t.users, t.watch_history).collect()}
    assert stats == {1: (round(50 / 60, 6), 50.0, 1), 2: (0.0, 30.0, 0)}
    idle = {r.user_id: r.days_since_login for r in users.recency(t.users, t.watch_history).collect()}
    assert idle == {1: 0, 2: 40}
    genres = {r.user_id: r.favorite_genre for r in users.favourite_genre(t.users, t.watch_history, t.content).collect()}
    assert stats == {r.user_id: tuple(r)[1:] for r in users.session_stats_of(t.users, t.user_totals).collect()}
    assert idle == {r.user_id: r.days_since_login for r in users.recency_of(t.users, t.user_totals).collect()}
    assert genres == {r.user_id: r.favorite_genre for r in users.favourite_genre_of(t.users, t.user_totals, t.content).collect()}
    assert genres == {1: "Drama", 2: "Action"}


def test_dimension_beyond_the_broadcast_threshold_joins_by_shuffle(spark, tables, capsys):
    wanted = users.favourite_genre(tables.users, tables.watch_history, tables.content).collect()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = joins.join_dimension(tables.watch_history, tables.content, "content_id")
        capsys.readouterr()
        joined.explain()
        assert "BroadcastHashJoin" not in capsys.readouterr().out
        assert joined.count() == tables.watch_history.count()
        found = users.favourite_genre(tables.users, tables.watch_history, tables.content).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(found) == sorted(wanted)


def test_title_with_most_sessions_and_unmatched_sessions(spark):
    t = small.make(spark, content=[dict(), dict(content_id="C2", genre="Action", title="Two")],
                   watch=[dict(watch_id=i) for i in range(50)] + [dict(watch_id=99, content_id="gone")])
    assert [tuple(r) for r in content.genre_views(t.watch_history, t.content).collect()] == [("Drama", 50)]
    assert [tuple(r) for r in library.top_titles(t).collect()] == [("One", "Drama", 50)]


def test_ties_at_the_last_place_stay(spark):
    counts = spark.createDataFrame([(f"t{i}", "g", 5 if i < 3 else 1) for i in range(6)], "title string, genre string, views long")
    assert bi.top_titles_with_ties(counts, 4).count() == 6
    assert bi.top_titles_with_ties(counts, 3).count() == 3


def test_segments_in_one_pass_equal_single_reports(tables):
    cells = segments.all_segments(tables.users).collect()
    for name, column in segments.segment_columns().items():
        single = {r[0]: r[1] for r in segments.churn_by(tables.users, column, "s").collect()}
        assert {c.value: c.churn_rate for c in cells if c.segment == name} == single


@pytest.fixture(scope="module")
def document(spark, sf_dir):
    row = registry.QUERIES["sink_dashboard_json"](spark, sf_dir).first()
    return json.loads(row.document)


# The keys a dashboard expects in the document.
KEYS = """total_users churn_rate avg_watch_time countries total_sessions total_ratings total_titles avg_rating
avg_completion_rate avg_tenure_days avg_support_tickets churn_by_subscription users_by_subscription
churn_by_country users_by_country churn_by_genre churn_by_age_band churn_by_recency_band churn_by_watch_band
churn_by_support_tickets churn_by_tenure_band recency_curve watch_time_curve model_auc model_accuracy
model_precision model_recall churn_driver_coefs risk_deciles top2decile_capture_pct top2decile_share_of_base
genre_views genre_completion top_content most_watched_content views_by_release_year monthly_sessions
monthly_completion avg_session_duration""".split()


def test_document_keys(document):
    assert len(KEYS) == 39 and set(document) == set(KEYS)


def test_document_invariants(document, tables):
    for name in ("genre_views", "views_by_release_year", "monthly_sessions"):
        assert sum(document[name].values()) == document["total_sessions"]
    assert sum(row["n"] for row in document["risk_deciles"]) == document["total_users"]
    # The curves end at 1000.
    for name, column in (("recency_curve", "days_since_login"), ("watch_time_curve", "watch_time_hours")):
        inside = tables.users.where(F.col(column) < 1000).count()
        assert sum(row["n"] for row in document[name]) == inside
    for name in ("users_by_subscription", "users_by_country"):
        assert sum(document[name].values()) == document["total_users"]
    weighted = sum(d["n"] * d["churn_rate"] for d in document["risk_deciles"]) / document["total_users"]
    assert abs(weighted - document["churn_rate"]) < 0.1
    caught = sum(d["n"] * d["churn_rate"] for d in document["risk_deciles"] if d["decile"] >= 9)
    assert abs(caught / weighted / document["total_users"] * 100 - document["top2decile_capture_pct"]) < 0.5
    assert len(document["churn_driver_coefs"]) == 10 and len(document["most_watched_content"]) == 10


def test_document_order(document):
    countries = list(document["churn_by_country"].values())
    assert countries == sorted(countries, reverse=True)
    months = list(document["monthly_sessions"])
    assert months == sorted(months)
    tenure = [b for b in ("0-90d", "91-180d", "181-365d", "1-2yr", "2yr+") if b in document["churn_by_tenure_band"]]
    assert list(document["churn_by_tenure_band"]) == tenure


def test_document_is_written_as_one_file(spark, tables, tmp_path):
    small_document = bundle.json_document(bundle.headline(tables))
    files.write_document(small_document, str(tmp_path / "doc"))
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "doc")).collect())
    assert json.loads(text)["total_users"] == tables.users.count()


def test_filter_restricts_facts(tables):
    picked = bi.filtered(tables, ["BUILDING"])
    assert picked.users.select("subscription_type").distinct().count() == 1
    assert 0 < picked.watch_history.count() < tables.watch_history.count()
    assert picked.ratings.join(picked.users, "user_id", "left_anti").count() == 0
    assert content.genre_views(picked.watch_history, picked.content).agg(F.sum("views")).first()[0] == picked.watch_history.count()


def test_sessions_carry_derived_values_through_the_joins(spark):
    from holdfast.sources import tables

    lines = spark.createDataFrame(
        [(1, 1, 7, 3.0, 0.04, "R"), (1, 2, 7, 4.0, None, "R"), (1, 3, 7, 5.0, 0.04, "N"), (1, 4, 7, 5.0, 0.1, None), (1, 5, 7, None, 0.1, "R")],
        "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_discount double, l_returnflag string",
    ).selectExpr("*", "TIMESTAMP '2024-02-01 00:00:00' AS l_shipdate")
    orders = spark.createDataFrame([(1, 9)], "o_orderkey long, o_custkey long")
    part = spark.createDataFrame([(7, "One", "Drama", 5)], "p_partkey long, p_name string, p_type string, p_size int")
    sessions = tables._sessions(lines, orders, part)
    plan = sessions._jdf.queryExecution().optimizedPlan().toString()
    assert not any(name in plan.split("Join")[1].split("\n")[0] for name in ("l_discount", "l_returnflag"))
    assert not {"discount", "return_flag"} & set(sessions.columns)
    assert sorted((r.line_no, r.rating) for r in tables._ratings(sessions).collect()) == [(1, 3), (2, 5), (5, 5)]
    assert [r.completion_rate for r in sessions.orderBy("line_no").collect()] == [6.0, 8.0, 10.0, 10.0, None]
