"""The four tables as DuckDB common table expressions over the given parquet tables."""

from __future__ import annotations


def rnd(expr: str, places: int) -> str:
    return f"CAST(ROUND(CAST({expr} AS DECIMAL(28,8)), {places}) AS DOUBLE)"


def pct(expr: str, places: int) -> str:
    return rnd(f"({expr}) * 100.0", places)


TABLES = f"""
content AS (
  SELECT printf('C%06d', p_partkey) AS content_id, p_name AS title, p_type AS genre,
         CAST(2015 + p_partkey % 11 AS INTEGER) AS release_year,
         CAST(45 + 3 * p_size AS INTEGER) AS duration_min
  FROM part
),
sessions AS (
  SELECT l_orderkey AS order_key, l_linenumber AS line_no, o_custkey AS user_id,
         printf('C%06d', l_partkey) AS content_id, CAST(l_shipdate AS DATE) AS watch_date,
         {rnd("(45 + 3 * p_size) * (2.0 * l_quantity) / 100.0", 1)} AS session_duration,
         CAST(2.0 * l_quantity AS DOUBLE) AS completion_rate,
         p_type AS genre, l_returnflag AS return_flag, l_discount AS discount
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey
),
watch_history AS (
  SELECT order_key, line_no, user_id, content_id, watch_date, session_duration, completion_rate
  FROM sessions
),
ratings AS (
  SELECT order_key, line_no, user_id, content_id,
         least(5, 1 + CAST(floor(round(discount * 100) / 2.0) AS INTEGER)) AS rating
  FROM sessions WHERE return_flag = 'R'
),
snap AS (SELECT max(watch_date) AS snapshot FROM sessions),
ordered AS (
  SELECT o_custkey AS user_id, min(CAST(o_orderdate AS DATE)) AS first_order,
         CAST(count(*) FILTER (o_orderpriority = '1-URGENT') AS INTEGER) AS urgent,
         CAST(count(DISTINCT o_orderpriority) AS INTEGER) AS priorities
  FROM orders GROUP BY 1
),
watched AS (
  SELECT user_id, sum(CAST(session_duration AS DECIMAL(18,1))) AS minutes, max(watch_date) AS last_watch
  FROM sessions GROUP BY 1
),
genre_counts AS (SELECT user_id, genre, count(*) AS n FROM sessions GROUP BY 1, 2),
top_genres AS (
  SELECT user_id, genre FROM genre_counts
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, genre) = 1
),
dated AS (
  SELECT c_custkey AS user_id, c_name, n_name, c_mktsegment, c_acctbal, snapshot,
         coalesce(first_order, snapshot) AS signup_date,
         coalesce(last_watch, first_order, snapshot) AS last_login,
         minutes, genre, coalesce(urgent, 0) AS support_tickets, coalesce(priorities, 0) AS priorities
  FROM customer CROSS JOIN snap
  LEFT JOIN nation ON n_nationkey = c_nationkey
  LEFT JOIN ordered ON ordered.user_id = c_custkey
  LEFT JOIN watched ON watched.user_id = c_custkey
  LEFT JOIN top_genres ON top_genres.user_id = c_custkey
),
users AS (
  SELECT user_id, c_name AS name, CAST(18 + (user_id * 7) % 55 AS INTEGER) AS age, n_name AS country,
         c_mktsegment AS subscription_type, signup_date,
         CAST(date_diff('day', signup_date, snapshot) AS INTEGER) AS tenure_days,
         coalesce({rnd("CAST(minutes AS DOUBLE) / 60.0", 2)}, 0.0) AS watch_time_hours,
         coalesce(genre, (SELECT min(p_type) FROM part)) AS favorite_genre, last_login,
         CAST(date_diff('day', last_login, snapshot) AS INTEGER) AS days_since_login,
         support_tickets, greatest(1, priorities) AS num_devices,
         CASE WHEN 40 * date_diff('day', last_login, snapshot) + 300 * support_tickets > c_acctbal + 3000
              THEN 1 ELSE 0 END AS churn
  FROM dated
)"""


def over_tables(body: str, *ctes: str, recursive: bool = False) -> str:
    """``body`` with the four tables, and further expressions, in front of it."""
    parts = ",\n".join([TABLES.strip(), *[c.strip() for c in ctes]])
    return f"WITH {'RECURSIVE ' if recursive else ''}{parts}\n{body.strip()}"
