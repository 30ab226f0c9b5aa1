from __future__ import annotations

import pytest
from pyspark.sql.utils import AnalysisException

import small
from holdfast.operators import guard

CASES = {
    "SELECT 1 FROM users": None,
    "  select * from Users ;; ": None,
    "WITH a AS (SELECT 1), b as (select * from ratings) SELECT * FROM a JOIN b ON true": None,
    "SELECT updated_at FROM users": None,
    "SELECT 1; SELECT 2": guard.MANY_STATEMENTS,
    "SELECT 1 ; ;": guard.MANY_STATEMENTS,
    "EXPLAIN SELECT 1": guard.NOT_A_QUERY,
    "SELECTED": guard.NOT_A_QUERY,
    "": guard.NOT_A_QUERY,
    "SELECT * FROM users; DROP TABLE users": guard.MANY_STATEMENTS,
    "WITH x AS (delete from users) SELECT 1": guard.FORBIDDEN_WORD + "DELETE",
    # The first word of the list is reported, not the first in the text.
    "SELECT 1 FROM users -- do copy, then insert": guard.FORBIDDEN_WORD + "INSERT",
    "SELECT 'drop' FROM users": guard.FORBIDDEN_WORD + "DROP",
    "SELECT replace(name, 'a', 'b') FROM users": guard.FORBIDDEN_WORD + "REPLACE",
    "SELECT * FROM invoices": guard.UNKNOWN_TABLE + "invoices",
    "SELECT * FROM pg_catalog.pg_tables": guard.UNKNOWN_TABLE + "pg_catalog",
    "SELECT EXTRACT(YEAR FROM signup_date) FROM users": guard.UNKNOWN_TABLE + "signup_date",
    "SELECT '\u0131nsert', 'in\u017fert' FROM users": None,
    # Not seen by the text rules.
    "SELECT * FROM users u, invoices i": None,
    'SELECT * FROM "invoices"': None,
}


def audited(spark, texts):
    rows = list(enumerate(texts))
    return guard.audit(spark.createDataFrame(rows, "id int, sql_text string"))


def test_first_broken_rule(spark):
    found = {r.sql_text: r.problem for r in audited(spark, CASES).collect()}
    assert found == CASES


@pytest.mark.parametrize("word", guard.FORBIDDEN)
def test_every_word_is_found_whole_and_in_any_case(spark, word):
    texts = [f"SELECT {word.lower()} FROM users", f"SELECT x{word}_ FROM users"]
    assert [r.problem for r in audited(spark, texts).orderBy("id").collect()] == [guard.FORBIDDEN_WORD + word, None]


def test_row_cap(spark):
    texts = [
        "SELECT * FROM users;",
        "SELECT * FROM users limit 7",
        "SELECT * FROM (SELECT * FROM users LIMIT 5) t",
        "DROP TABLE users",
    ]
    capped = guard.with_row_cap(audited(spark, texts)).orderBy("id").collect()
    assert [r.capped_sql for r in capped] == ["SELECT * FROM users\nLIMIT 500", texts[1], texts[2]]


@pytest.fixture
def many(spark, tmp_path):
    t = small.make(spark, users=[dict(user_id=i) for i in range(700)])
    stored = {}
    for name, df in t.named().items():
        path = str(tmp_path / name)
        df.coalesce(1).write.parquet(path)
        stored[name] = spark.read.parquet(path)
    return type(t)(**stored)


def test_guarded_query_keeps_at_most_200_rows(spark, many):
    assert guard.guarded_query(spark, many, "SELECT * FROM users").count() == 200
    assert guard.guarded_query(spark, many, "SELECT count(*) AS n FROM users;").first().n == 700


def test_guarded_answer_counts_what_one_run_gives(spark, many):
    rows = guard.guarded_answer(spark, many, "SELECT u.user_id, w.user_id FROM users u, users w WHERE u.user_id = w.user_id").collect()
    assert len(rows) == 200 and {tuple(r)[1:3] for r in rows} == {(500, True)}
    assert all(r[3] == r[4] for r in rows) and rows[0].executed_sql.endswith("LIMIT 500")
    few = guard.guarded_answer(spark, many, "SELECT name FROM users LIMIT 3").collect()
    assert [tuple(r)[1:3] for r in few] == [(3, False)] * 3
    assert guard.guarded_answer(spark, many, "SELECT name FROM users WHERE user_id < 0").count() == 0
    drawn = [guard.guarded_answer(spark, many, "SELECT rand() AS x FROM users") for _ in range(2)]
    assert drawn[0].collect() == drawn[0].collect()


def test_guarded_query_rejects(spark, many, tmp_path):
    with pytest.raises(guard.RejectedStatement, match="unknown table: invoices"):
        guard.guarded_query(spark, many, "SELECT * FROM invoices")
    path = str(tmp_path / "other")
    spark.range(3).write.parquet(path)
    spark.read.parquet(path).createOrReplaceTempView("invoices")
    # A comma join passes the text rules; the files it would read give it away.
    with pytest.raises(guard.RejectedStatement, match="outside the four tables"):
        guard.guarded_query(spark, many, "SELECT i.id FROM users u, invoices i")
    with pytest.raises(AnalysisException):
        guard.guarded_query(spark, many, "SELECT * FROM users u, missing m")
    spark.catalog.dropTempView("invoices")
