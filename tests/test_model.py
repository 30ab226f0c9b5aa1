from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.linalg import SparseVector
from pyspark.sql import functions as F

import small
from holdfast.operators import model


@pytest.fixture(scope="module")
def fitted(tables):
    return model.fit(tables.users)


def test_split_is_stratified_and_exact(tables):
    counts = {(r.churn, r.is_train): r.n for r in model.split(tables.users).groupBy("churn", "is_train").agg(
        F.count("*").alias("n")).collect()}
    for churn in (0, 1):
        size = counts[churn, True] + counts[churn, False]
        assert counts[churn, False] == int(np.floor(size * 0.25 + 0.5))
    assert sum(counts.values()) == tables.users.count()


def training_matrix(fitted):
    rows = fitted.features.where("is_train").select("churn", "features").toPandas()
    x = (np.stack([v.toArray() for v in rows["features"]]) - fitted.means) / fitted.shrink
    return x, rows["churn"].to_numpy(float)


def test_weights_minimise_the_penalised_loss(fitted):
    """Newton's method on the same rows: summed log loss + |w|^2 / 2, free intercept."""
    x, y = training_matrix(fitted)
    x = np.column_stack([np.ones(len(x)), x])
    penalty = np.diag([0.0] + [1.0] * (x.shape[1] - 1))
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
        w -= step
    found = {r.feature: r.coefficient for r in fitted.coefficients().collect()}
    assert np.allclose(fitted.intercept, w[0], atol=2e-6)
    assert np.allclose([found[n] for n in fitted.names], w[1:], atol=1e-6)


def test_training_features_are_standardised(fitted):
    x, _ = training_matrix(fitted)
    assert np.allclose(x.mean(axis=0), 0, atol=1e-9) and np.allclose(x.std(axis=0), 1, atol=1e-9)


def test_quality_and_lift(fitted, tables):
    quality = model.evaluation(fitted).first()
    assert quality.auc > 0.8
    deciles = model.scored_deciles(fitted).collect()
    assert sum(d.n for d in deciles) == tables.users.count()
    assert [d.decile for d in deciles] == list(range(1, 11))
    assert deciles[-1].churn_rate > 10 * max(deciles[0].churn_rate, 1)


def test_first_level_is_dropped(spark):
    users = small.make(
        spark,
        users=[dict(user_id=i, country=c, favorite_genre=g) for i, (c, g) in enumerate(["BA", "AB", "CA", "BB"])],
    ).users
    names = model.feature_names(model.feature_frame(users))
    assert names == [*model.NUMERIC, "favorite_genre_B", "country_B", "country_C"]


def test_reasons_are_the_strongest_parts(fitted):
    user = fitted.features.orderBy("user_id").first()
    parts = (user.features.toArray() - fitted.means) * np.array(fitted.weights)
    strongest = sorted(zip(np.abs(parts), fitted.names, parts), reverse=True)[:3]
    found = model.reasons(fitted).where(F.col("user_id") == user.user_id).orderBy("place").collect()
    assert [r.feature for r in found] == [name for _, name, _ in strongest]
    assert np.allclose([r.contribution for r in found], [part for _, _, part in strongest], atol=1e-6)


def test_levels_with_dots_are_features_too(spark):
    rows = [dict(user_id=i, country="St. A" if i % 3 else "B.", churn=int(i % 4 == 0), age=20 + i % 30) for i in range(300)]
    fitted = model.fit(small.make(spark, users=rows).users)
    assert "country_St. A" in fitted.names
    assert fitted.coefficients().count() == len(fitted.names)


def test_guarded_model_wants_enough_users_and_both_classes(spark):
    few = small.make(spark, users=[dict(user_id=i, churn=i % 2) for i in range(200)]).users
    one_class = small.make(spark, users=[dict(user_id=i) for i in range(300)]).users
    for users in (few, one_class):
        assert [r.message for r in model.guarded_deciles(users).collect()] == [model.TOO_LITTLE]


def test_a_hundred_thousand_levels_stay_sparse(spark):
    base = small.make(spark).users.drop("user_id", "country", "age", "churn")
    users = spark.range(150_000).selectExpr(
        "CAST(id AS INT) AS user_id",
        "concat('c', lpad(CAST(id % 100000 AS STRING), 6, '0')) AS country",
        "CAST(20 + id % 41 AS INT) AS age",
        "CAST(CASE WHEN id % 41 + id % 7 > 30 THEN 1 ELSE 0 END AS SMALLINT) AS churn",
    ).crossJoin(base)
    fitted = model.fit(users, max_iter=8)
    assert len(fitted.names) == len(model.NUMERIC) + 99_999
    row = fitted.features.where("user_id = 77777").first()
    assert isinstance(row.features, SparseVector) and len(row.features.indices) <= len(model.NUMERIC) + 1
    assert row.indicators == ["country_c077777"]
    assert model.reasons(fitted).count() == 3 * 150_000


def test_users_without_a_level(spark):
    rows = [dict(user_id=i, churn=int(i % 4 == 0), age=20 + i % 30, country=None if i % 5 else "A", favorite_genre=None) for i in range(300)]
    fitted = model.fit(small.make(spark, users=rows).users)
    assert fitted.names == list(model.NUMERIC) and model.reasons(fitted).count() == 900
