"""Cases that a review found: exact quotients, times before 1970, and statements beyond ASCII."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import small
from holdfast.functions.numbers import int_div
from holdfast.operators import content, guard
from holdfast.plans import bundle


def test_int_div_is_exact(spark):
    big = 2**53 + 1
    row = spark.range(1).select(int_div(F.lit(big), 1).alias("a"), int_div(F.lit(7 * big), 7).alias("b")).first()
    assert (row.a, row.b) == (big, big)


def test_audit_sees_all_white_space_and_nulls(spark):
    made = [(1, "SELECT * FROM\u00a0invoices"), (2, None), (3, "WITH x\u00a0AS (SELECT 1) SELECT * FROM x"), (4, "SELECT 1 LIMIT\u00a05")]
    audited = guard.audit(spark.createDataFrame(made, "stmt_id int, sql_text string"), "sql_text")
    assert {r.stmt_id: r.accepted for r in audited.collect()} == {1: False, 2: False, 3: True, 4: True}
    capped = {r.stmt_id: r.capped_sql for r in guard.with_row_cap(audited).collect()}
    assert capped[4].upper().count("LIMIT") == 1


def test_guarded_query_reads_the_four_views_only(spark):
    t = small.make(spark)
    spark.createDataFrame([("hidden",)], "secret string").createOrReplaceTempView("secrets")
    spark.range(3).createOrReplaceTempView("users")
    try:
        for text in (
            "SELECT x.secret FROM users u, secrets x WHERE u.user_id = 1",
            "SELECT (SELECT max(secret) FROM `secrets`) AS s FROM users",
            "SELECT r.id FROM users u, range(3) r",
            "WITH a AS (SELECT * FROM `secrets`) SELECT * FROM a",
        ):
            with pytest.raises(guard.RejectedStatement, match="outside|unknown"):
                guard.guarded_query(spark, t, text)
        good = "WITH a AS (SELECT user_id FROM users) SELECT a.user_id, (SELECT count(*) FROM ratings) AS n FROM a"
        assert [tuple(r) for r in guard.guarded_query(spark, t, good).collect()] == [(1, 1)]
        assert spark.table("users").count() == 3
    finally:
        spark.catalog.dropTempView("secrets")
        spark.catalog.dropTempView("users")


def test_document_keeps_the_order_of_the_reports(spark):
    titles = [dict(content_id="C1", title="zeta"), dict(content_id="C2", title="alpha")]
    marks = [("C1", 3, 4), ("C1", 1, 5), ("C2", 3, 4), ("C2", 1, 5)]
    rows = [dict(content_id=c, rating=mark) for c, n, mark in marks for _ in range(5 * n)]
    t = small.make(spark, content=titles, ratings=rows, watch=[dict(content_id="C2"), dict(content_id="C1")])
    best = content.best_rated(t.ratings, t.content)
    packed = bundle._packed_rows(best, F.struct(-F.col("mean"), "content_id"), "title", "n")
    listed = spark.range(1).select(packed.alias("rows")).first().rows
    assert [r.title for r in listed] == [r.title for r in content.top_rated(t.ratings, t.content).collect()] == ["zeta", "alpha"]
