"""Plan shapes that matter at scale."""

from __future__ import annotations

import pytest

from holdfast.plans.registry import QUERIES


def plan_of(df, capsys) -> str:
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


NO_LOOP_JOINS = [
    "an_kpis",
    "bi_filtered_kpis",
    "bi_measures",
    "bundle_full",
    "dq_fk",
    "dq_session_window",
    "ml_split",
    "ml_zscore",
    "risk_proxy",
    "risk_qcut_deciles",
    "risk_rank_deciles",
    "sql_a4_plan_vs_benchmark",
    "sql_a6_ntile_deciles",
    "user_zscores",
    "winback_requests",
]


@pytest.mark.parametrize("key", NO_LOOP_JOINS)
def test_no_cross_or_loop_join(spark, sf_dir, capsys, key):
    plan = plan_of(QUERIES[key](spark, sf_dir), capsys)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("key", ["sql_a2_top_user_per_country", "sql_a5_top3_titles_per_genre"])
def test_ranks_are_limited_before_the_shuffle(spark, sf_dir, capsys, key):
    assert plan_of(QUERIES[key](spark, sf_dir), capsys).count("WindowGroupLimit") == 2


def test_tied_titles_are_ranked_by_their_number_of_views(spark, sf_dir, capsys):
    plan = plan_of(QUERIES["bi_top_titles"](spark, sf_dir), capsys)
    ranked = plan[plan.index("Window") :]
    assert plan.count("Window") == ranked.count("Window") and "title#" not in ranked[: ranked.index("TakeOrderedAndProject")]


def test_model_card_equals_the_document(spark, sf_dir):
    cards = {r.label: r.value for r in QUERIES["bundle_model_cards"](spark, sf_dir).collect()}
    caught = QUERIES["bundle_full"](spark, sf_dir).select("top2decile_capture_pct").first()[0]
    assert cards["Top-Decile Capture"] == f"{caught:.1f}%"


@pytest.mark.parametrize("key", ["risk_top_users", "sql_i2_top_titles", "an_most_watched", "an_top_content"])
def test_top_k_does_not_sort_everything(spark, sf_dir, capsys, key):
    assert "TakeOrderedAndProject" in plan_of(QUERIES[key](spark, sf_dir), capsys)


def test_facts_fold_before_they_meet_titles(spark, sf_dir, capsys):
    plan = plan_of(QUERIES["sql_i1_genre_engagement"](spark, sf_dir), capsys)
    assert plan.index("Join") < plan.index("partial_count(1)")
    assert "ReadSchema: struct<content_id:string,completion_rate:double>" in plan


@pytest.mark.parametrize("key", ["user_session_stats", "user_favourite_genre"])
def test_user_totals_meet_users_without_a_shuffle(spark, sf_dir, capsys, key):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(QUERIES[key](spark, sf_dir), capsys)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # A one-row subquery may gather its value in one place.
    assert "SortMergeJoin" in plan and "Exchange hashpartitioning" not in plan


def test_lookup_reaches_the_scan(spark, sf_dir, capsys):
    plan = QUERIES["risk_user_lookup"](spark, sf_dir)
    capsys.readouterr()
    plan.explain("formatted")
    assert "EqualTo(user_id,42)" in capsys.readouterr().out


def test_audit_has_no_shuffle_and_no_python(spark, sf_dir, capsys):
    plan = plan_of(QUERIES["guard_audit"](spark, sf_dir), capsys)
    assert "Exchange" not in plan and "Python" not in plan
