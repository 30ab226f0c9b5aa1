"""Audit of SQL statement texts held in a table, and guarded execution of one."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.sources.tables import Tables
from holdfast.sources.workspace import publish

# White space, rejected words in reporting order, readable tables, caps, messages.
WHITE_SPACE = " \t\n\v\f\r\u00a0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(
    chr(code) for code in range(0x2000, 0x200B)
)
# The same characters as a pattern; Java's own class has ASCII ones alone.
_SPACE = rf"[{WHITE_SPACE}]"
FORBIDDEN = (
    "INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "CREATE", "REPLACE", "TRUNCATE", "VACUUM",
    "ATTACH", "DETACH", "PRAGMA", "REINDEX", "EXEC", "EXECUTE", "COPY", "GRANT", "REVOKE",
    "MERGE", "CALL", "DO",
)
READABLE = ("users", "content", "watch_history", "ratings")
ROW_CAP = 500
KEPT_ROWS = 200
MANY_STATEMENTS = "Multiple statements are not allowed."
NOT_A_QUERY = "Only SELECT / WITH (read-only) queries are allowed."
FORBIDDEN_WORD = "Forbidden keyword detected: "
UNKNOWN_TABLE = "Query references an unknown table: "

_NAME = "([a-zA-Z_][a-zA-Z0-9_]*)"


def _trimmed(text: Column) -> Column:
    """Without surrounding white space, then without closing semicolons."""
    return F.rtrim(F.trim(text, F.lit(WHITE_SPACE)), F.lit(";"))


def _ascii_upper(text: Column) -> Column:
    """Upper case in which no other letter turns into an ASCII one (two would)."""
    return F.upper(F.replace(F.replace(text, F.lit("\u017f"), F.lit(" ")), F.lit("\u0131"), F.lit(" ")))


def _all_matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def _first(items: Column) -> Column:
    return F.get(items, F.lit(0))


def audit(statements: DataFrame, text: str = "sql_text") -> DataFrame:
    """Add ``statement`` (trimmed), ``problem`` (first broken rule or NULL) and ``accepted``.

    All rules are native expressions over the whole text, so a statement log of any
    size is one scan without a shuffle.
    """
    sql = F.col("statement")
    forbidden = F.array(*[F.lit(w) for w in FORBIDDEN])
    words = F.split(_ascii_upper(sql), r"\W+")
    found = F.when(F.arrays_overlap(forbidden, words), _first(F.array_intersect(forbidden, words)))
    # Looking for the names in front of "AS (" is worth it only where that occurs.
    named = F.transform(_all_matches(sql, rf"(?i)\b{_NAME}{_SPACE}+AS{_SPACE}*\("), F.lower)
    named_parts = F.when(sql.rlike(rf"(?i){_SPACE}AS{_SPACE}*\("), named).otherwise(F.array().cast("array<string>"))
    sources = F.transform(_all_matches(sql, rf"(?i)\b(?:FROM|JOIN){_SPACE}+{_NAME}"), F.lower)
    known = F.concat(F.array(*[F.lit(name) for name in READABLE]), named_parts)
    unknown = F.array_except(sources, known)
    problem = F.coalesce(
        F.when(sql.isNull(), F.lit(NOT_A_QUERY)),
        F.when(F.contains(sql, F.lit(";")), F.lit(MANY_STATEMENTS)),
        F.when(~F.upper(sql).rlike(rf"^{_SPACE}*(SELECT|WITH)\b"), F.lit(NOT_A_QUERY)),
        F.concat(F.lit(FORBIDDEN_WORD), found),
        F.concat(F.lit(UNKNOWN_TABLE), _first(unknown)),
    )
    return (
        statements.withColumn("statement", _trimmed(F.col(text)))
        .withColumn("problem", problem)
        .withColumn("accepted", F.col("problem").isNull())
    )


def with_row_cap(audited: DataFrame) -> DataFrame:
    """Accepted statements with a row cap added where the text has no LIMIT of its own."""
    sql = F.col("statement")
    capped = F.when(sql.rlike(rf"(?i)\bLIMIT{_SPACE}+\d+"), sql).otherwise(
        F.concat(sql, F.lit(f"\nLIMIT {ROW_CAP}"))
    )
    return audited.where("accepted").withColumn("capped_sql", capped)


class RejectedStatement(ValueError):
    """The statement breaks a rule; the message names the first one."""


def _guarded(spark: SparkSession, t: Tables, text: str) -> tuple[str, DataFrame]:
    """The capped text of one statement over the four views only, and its result.

    The text rules cannot see quoted names or tables after a comma, so every relation of
    the analysed query, those of its subqueries included, must be one of the four views.
    The caller's own views of these names are put back.
    """
    one = audit(spark.createDataFrame([(text,)], "sql_text string"))
    problem = one.select("problem").first().problem
    if problem:
        raise RejectedStatement(problem)
    statement = with_row_cap(one).select("capped_sql").first().capped_sql
    with _views(spark, t):
        result = spark.sql(statement)
    if not set(_relations(result._jdf.queryExecution().analyzed())) <= set(READABLE):
        raise RejectedStatement(f"{UNKNOWN_TABLE}outside the four tables")
    return statement, result


def guarded_query(spark: SparkSession, t: Tables, text: str) -> DataFrame:
    """The first rows of a guarded statement's result, 200 at most."""
    return _guarded(spark, t, text)[1].limit(KEPT_ROWS)


def guarded_summary(spark: SparkSession, t: Tables, text: str) -> DataFrame:
    """One row: the text that was run (``executed_sql``) and how many rows it gives under its cap."""
    statement, result = _guarded(spark, t, text)
    return result.agg(F.count("*").alias("row_count")).select(F.lit(statement).alias("executed_sql"), "row_count")


def guarded_answer(spark: SparkSession, t: Tables, text: str) -> DataFrame:
    """The kept rows of a statement that runs once, beside the text that was run, the number
    of its rows under its cap, and whether rows were cut.

    The result is written once; its rows and their number are read from there. A statement
    without rows gives none.
    """
    statement, result = _guarded(spark, t, text)
    names = result.columns
    written = publish(result.toDF(*[f"c{i}" for i in range(len(names))]), "guarded")
    rows = written.agg(F.count("*")).scalar()
    return written.limit(KEPT_ROWS).select(
        F.lit(statement).alias("executed_sql"),
        rows.alias("row_count"),
        (rows > KEPT_ROWS).alias("rows_cut"),
        *[F.col(f"c{i}").alias(name) for i, name in enumerate(names)],
    )


@contextmanager
def _views(spark: SparkSession, t: Tables) -> Iterator[None]:
    """The four views while a statement is analysed, then the caller's again."""
    before = {
        name: spark.table(name)
        for name in READABLE
        if spark.catalog.tableExists(name) and spark.catalog.getTable(name).isTemporary
    }
    t.create_views()
    try:
        yield
    finally:
        for name in READABLE:
            if name in before:
                before[name].createOrReplaceTempView(name)
            else:
                spark.catalog.dropTempView(name)


# Leaves of a plan that read nothing: constants and references to named parts of the statement.
_NOT_READING = ("OneRowRelation", "LocalRelation", "CTERelationRef")


def _relations(node: JavaObject) -> Iterator[str]:
    """Names of the session's views in an analysed plan; of anything else that is read, the kind of its node."""
    if node.nodeName() == "View" and node.isTempView() and node.desc().identifier().database().isEmpty():
        yield node.desc().identifier().table()
        return
    inside = [part.apply(i) for part in (node.children(), node.subqueries()) for i in range(part.size())]
    if not node.children().size() and node.nodeName() not in _NOT_READING:
        yield node.nodeName()
    for part in inside:
        yield from _relations(part)


# Statement shapes of a query log; {u} is filled with the requesting user's id.
LOG_SHAPES = (
    "SELECT * FROM users WHERE user_id = {u}",
    "  select count(*) from ratings where user_id = {u};  ",
    "WITH mine AS (SELECT * FROM watch_history WHERE user_id = {u}) SELECT count(*) FROM mine",
    "SELECT name FROM users WHERE user_id = {u}; SELECT 1",
    "UPDATE users SET churn = 0 WHERE user_id = {u}",
    "SELECT updated_at FROM users WHERE user_id = {u}",
    "SELECT * FROM users WHERE name = 'drop {u}'",
    "SELECT * FROM invoices WHERE user_id = {u}",
    "SELECT * FROM pg_catalog.pg_tables LIMIT {u}",
    "SELECT u.name FROM users u, invoices i WHERE i.user_id = {u}",
    'SELECT * FROM "invoices" WHERE user_id = {u}',
    "SELECT EXTRACT(YEAR FROM signup_date) FROM users WHERE user_id = {u}",
    "SELECT title FROM content ORDER BY title LIMIT 20",
    "SELECT * FROM (SELECT * FROM ratings LIMIT 5) r WHERE r.user_id = {u}",
    "SELECT 1 FROM users WHERE user_id = {u} -- then delete or create it",
    "EXPLAIN SELECT * FROM users WHERE user_id = {u}",
    "SELECT u.name, c.title FROM users u JOIN watch_history w ON u.user_id = w.user_id "
    "JOIN content c ON c.content_id = w.content_id WHERE u.user_id = {u}\n;;",
)


def statement_log(events: DataFrame) -> DataFrame:
    """One statement per request event, its shape chosen by the event."""
    shapes = F.array(*[F.lit(s) for s in LOG_SHAPES])
    shape = F.get(shapes, F.pmod("event_id", F.lit(len(LOG_SHAPES))).cast("int"))
    return events.select(
        F.col("event_id").alias("stmt_id"),
        F.replace(shape, F.lit("{u}"), F.col("user_id").cast("string")).alias("sql_text"),
    )


def text_lookups(turns: DataFrame) -> DataFrame:
    """One statement per conversation turn: a lookup of the turn's whole text as a quoted literal."""
    quoted = F.replace("text", F.lit("'"), F.lit("''"))
    return turns.select(
        F.concat_ws("-", "conv_id", "turn").alias("stmt_id"),
        F.concat(F.lit("SELECT title FROM content WHERE title = '"), quoted, F.lit("'")).alias("sql_text"),
    )
