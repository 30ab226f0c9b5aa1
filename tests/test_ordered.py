from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import small
from holdfast.operators import risk
from holdfast.operators.ordered import ntile_of, quantile_edges, row_index, score_totals


def scored_frame(spark, scores, labels):
    rows = [(i, float(s), int(c)) for i, (s, c) in enumerate(zip(scores, labels))]
    return spark.createDataFrame(rows, "user_id long, score double, churn int").repartition(5)


def draw(kind: str, n: int):
    rng = np.random.default_rng(7)
    if kind == "hot":  # half of all rows share one score
        scores = np.where(rng.random(n) < 0.5, 0.25, rng.random(n).round(3))
    elif kind == "constant":
        scores = np.full(n, 0.5)
    else:
        scores = rng.random(n).round(4)
    return scores, (rng.random(n) < scores).astype(int)


@pytest.mark.parametrize("kind", ["smooth", "hot", "constant"])
@pytest.mark.parametrize("n", [2, 7, 25, 3000])
def test_index_and_ntile_equal_the_window_functions(spark, kind, n):
    df = scored_frame(spark, *draw(kind, n))
    w = Window.orderBy("score", "user_id")
    wanted = {
        r.user_id: (r.i, r.t)
        for r in df.select(
            "user_id", (F.row_number().over(w) - 1).alias("i"), F.ntile(10).over(w).alias("t")
        ).collect()
    }
    indexed = row_index(df, ["score", "user_id"])
    tile = ntile_of(F.col("row_index"), F.lit(n), 10)
    found = {r.user_id: (r.row_index, r.t) for r in indexed.select("*", tile.alias("t")).collect()}
    assert found == wanted


@pytest.mark.parametrize("kind", ["smooth", "hot", "constant"])
@pytest.mark.parametrize("n", [2, 7, 25, 3000])
def test_quantile_deciles_equal_pandas(spark, kind, n):
    scores, labels = draw(kind, n)
    df = scored_frame(spark, scores, labels)
    totals = score_totals(df, "score", "churn")
    edges = spark.range(1).select(quantile_edges(totals, df.agg(F.count("score")), 10)).first()[0]
    wanted_edges = np.unique(np.quantile(scores, np.linspace(0, 1, 11)))
    assert np.allclose(edges, wanted_edges, atol=1e-12)
    if kind == "constant":
        return  # pandas cannot cut a constant; here all rows fall into bucket 1
    bins = pd.qcut(pd.Series(scores), 10, labels=False, duplicates="drop") + 1
    found = {r.user_id: r.decile for r in risk.with_quantile_decile(df, "score", "churn").collect()}
    assert [found[i] for i in range(n)] == bins.tolist()


def test_full_precision_scores_stay_within_ten_buckets(spark):
    scores = np.random.default_rng(1).random(500)
    df = scored_frame(spark, scores, scores > 0.5)
    summary = risk.decile_summary(risk.with_quantile_decile(df, "score", "churn"), "score").collect()
    assert [(s.decile, s.n) for s in summary] == [(d, 50) for d in range(1, 11)]


def test_constant_score_is_one_bucket(spark):
    df = scored_frame(spark, *draw("constant", 25))
    assert {r.decile for r in risk.with_quantile_decile(df, "score", "churn").collect()} == {1}


@pytest.mark.parametrize("kind", ["smooth", "hot", "constant"])
def test_auc_counts_pairs(spark, kind):
    scores, labels = draw(kind, 400)
    up, down = scores[labels == 1], scores[labels == 0]
    wins = (up[:, None] > down[None, :]).sum() + 0.5 * (up[:, None] == down[None, :]).sum()
    found = risk.auc(scored_frame(spark, scores, labels), "score").first().auc
    assert found == pytest.approx(wins / (len(up) * len(down)), abs=1e-12)


def test_auc_is_null_with_one_class(spark):
    assert risk.auc(scored_frame(spark, [0.1, 0.2], [1, 1]), "score").first().auc is None


def users_with(spark, days):
    rows = [dict(user_id=i, days_since_login=d, watch_time_hours=1.0, churn=i % 2) for i, d in enumerate(days)]
    return small.make(spark, users=rows).users


def test_rank_deciles_share_the_lowest_rank(spark):
    days = [0, 0, 0, 1, 2, 2, 5, 9, 9, 9, 9, 10, 20]
    found = {r.user_id: r.risk_decile for r in risk.rank_deciles(users_with(spark, days)).collect()}
    ranks = pd.Series(days).rank(method="min").astype(int)
    assert [found[i] for i in range(len(days))] == [-(-int(r) * 10 // len(days)) for r in ranks]


def test_score_is_null_when_a_maximum_is_zero(spark):
    users = users_with(spark, [0, 0])
    assert [r.risk_proxy for r in risk.scored(users).collect()] == [None, None]
    assert risk.top_users(users).count() == 2
    assert risk.proxy_deciles(users).count() == 0


def test_limit_is_clamped():
    assert [risk.clamp_limit(n) for n in (None, 0, 5, 100, 1000)] == [20, 20, 5, 100, 100]


def test_capture_and_tiers(spark):
    rows = [(d, d, int(d >= 9), 0.1 * d) for d in range(1, 11)]
    deciled = spark.createDataFrame(rows, "user_id int, decile int, churn int, score double")
    assert tuple(risk.capture(deciled).first()) == (100.0, 20.0)
    tiers = risk.decile_tiers(risk.decile_summary(deciled, "score")).orderBy("decile").collect()
    assert [(t.label, t.tier) for t in tiers[:4]] == [("D1", "low"), ("D2", "low"), ("D3", "low"), ("D4", "mid")]
    assert [t.tier for t in tiers[7:]] == ["mid", "high", "high"]
