"""DuckDB text per report key."""

from __future__ import annotations

from holdfast.functions import bands
from holdfast.operators import guard, profiles, users
from holdfast.plans import registry
from oracle.prefix import over_tables, pct, rnd

CHURN2 = f"{pct('avg(churn)', 2)} AS churn_rate_pct"


def ladder_case(ladder: bands.Ladder, order: bool = False) -> str:
    sign = "=" if ladder.exact else "<="
    arms = " ".join(
        f"WHEN {ladder.column} {sign} {limit} THEN {i if order else repr(label)}"
        for i, (limit, label) in enumerate(ladder.arms, 1)
    )
    rest = len(ladder.arms) + 1 if order else repr(ladder.rest)
    return f"CASE {arms} ELSE {rest} END"


def cut_case(cut: bands.Cut) -> str:
    arms = " ".join(
        f"WHEN {cut.column} > {low} AND {cut.column} <= {high} THEN '{label}'"
        for low, high, label in zip(cut.edges, cut.edges[1:], cut.labels)
    )
    return f"CASE {arms} END"


def ladder_report(ladder: bands.Ladder, name: str) -> str:
    return over_tables(
        f"SELECT {ladder_case(ladder)} AS {name}, count(*) AS users, {CHURN2} FROM users "
        f"GROUP BY 1 ORDER BY min({ladder.column})"
    )


def churn_by(expr: str, name: str) -> str:
    return over_tables(
        f"SELECT {name}, {pct('avg(churn)', 2)} AS churn_rate FROM "
        f"(SELECT {expr} AS {name}, churn FROM users) WHERE {name} IS NOT NULL GROUP BY 1"
    )


def users_by(column: str) -> str:
    return over_tables(f"SELECT {column}, count(*) AS users FROM users GROUP BY 1")


def curve(column: str, step: int, last: int) -> str:
    return over_tables(
        f"SELECT CAST(least(floor({column} / {step}.0) * {step}, {last}) AS INTEGER) AS x, "
        f"{pct('avg(churn)', 1)} AS churn_rate, count(*) AS n FROM users "
        f"WHERE {column} >= 0 AND {column} < 1000 GROUP BY 1"
    )


WATCHED_TITLES = "watch_history w JOIN content c ON c.content_id = w.content_id"

SCORE = """
score AS (
  SELECT *, CAST(days_since_login AS DOUBLE) / nullif((SELECT max(days_since_login) FROM users), 0)
            - watch_time_hours / nullif((SELECT max(watch_time_hours) FROM users), 0) AS raw_score
  FROM users
)"""
PROXY = f"""
proxy AS (
  SELECT user_id, name, age, country, subscription_type, tenure_days, watch_time_hours, favorite_genre,
         days_since_login, support_tickets, num_devices, churn, {rnd('raw_score', 4)} AS risk_proxy
  FROM score
)"""
EDGES = """
edges AS (
  SELECT list_sort(list_distinct(quantiles)) AS edges
  FROM (SELECT quantile_cont(risk_proxy, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]) AS quantiles
        FROM proxy)
)"""
QCUT = """
deciled AS (
  SELECT proxy.*, CAST(greatest(1, len(list_filter(edges, lambda e: e < risk_proxy))) AS INTEGER) AS decile
  FROM proxy, edges WHERE risk_proxy IS NOT NULL
)"""
DECILES = (SCORE, PROXY, EDGES, QCUT)
SUMMARY = f"""
summary AS (
  SELECT decile, count(*) AS n, {pct('avg(churn)', 1)} AS churn_rate,
         {pct('avg(risk_proxy)', 1)} AS avg_score
  FROM deciled GROUP BY 1
)"""
CAPTURE = f"""
caught AS (
  SELECT {pct('CAST(sum(CASE WHEN decile >= 9 THEN churn ELSE 0 END) AS DOUBLE) / nullif(sum(churn), 0)', 1)}
           AS capture_pct,
         {pct('CAST(count(*) FILTER (decile >= 9) AS DOUBLE) / nullif(count(*), 0)', 1)} AS share_of_base_pct
  FROM deciled
)"""

SOURCES = {
    "src_users": over_tables("SELECT * FROM users"),
    "src_content": over_tables("SELECT * FROM content"),
    "src_watch_history": over_tables("SELECT * FROM watch_history"),
    "src_ratings": over_tables("SELECT * FROM ratings"),
    "src_row_counts": over_tables(
        " UNION ALL ".join(
            f"SELECT '{name}' AS table_name, count(*) AS n FROM {name}"
            for name in ("users", "content", "watch_history", "ratings")
        )
    ),
    "src_null_normalise": over_tables(
        """
        SELECT user_id, nullif(trim(name), '') AS name, age, nullif(trim(country), '') AS country,
               nullif(trim(subscription_type), '') AS subscription_type, signup_date, tenure_days,
               watch_time_hours, nullif(trim(favorite_genre), '') AS favorite_genre, last_login,
               days_since_login, support_tickets, num_devices, churn
        FROM users"""
    ),
}

LIBRARY = {
    "sql_b1_total_users": over_tables("SELECT count(*) AS total_users FROM users"),
    "sql_b2_users_by_plan": users_by("subscription_type"),
    "sql_b3_engagement": over_tables(
        f"SELECT {rnd('avg(watch_time_hours)', 2)} AS avg_watch_time_hours, "
        f"{rnd('avg(tenure_days)', 0)} AS avg_tenure_days, "
        f"{rnd('avg(support_tickets)', 2)} AS avg_support_tickets FROM users"
    ),
    "sql_b4_titles_by_genre": over_tables("SELECT genre, count(*) AS titles FROM content GROUP BY 1"),
    "sql_b5_avg_rating": over_tables(
        f"SELECT {rnd('avg(rating)', 2)} AS avg_rating, count(*) AS total_ratings FROM ratings"
    ),
    "sql_i1_genre_engagement": over_tables(
        f"SELECT genre, count(*) AS total_views, {rnd('avg(completion_rate)', 1)} AS avg_completion_rate "
        f"FROM {WATCHED_TITLES} GROUP BY 1"
    ),
    "sql_i2_top_titles": over_tables(
        f"SELECT title, genre, count(*) AS views FROM {WATCHED_TITLES} GROUP BY 1, 2 "
        "ORDER BY views DESC, title, genre LIMIT 10"
    ),
    "sql_i3_churn_by_plan": over_tables(
        f"SELECT subscription_type, count(*) AS users, {CHURN2} FROM users GROUP BY 1"
    ),
    "sql_i4_genre_completion": over_tables(
        f"SELECT genre, {rnd('avg(completion_rate)', 2)} AS avg_completion FROM {WATCHED_TITLES} GROUP BY 1"
    ),
    "sql_i5_genre_ratings": over_tables(
        f"SELECT genre, {rnd('avg(rating)', 2)} AS avg_rating, count(*) AS num_ratings "
        "FROM ratings r JOIN content c ON c.content_id = r.content_id GROUP BY 1 HAVING count(*) >= 100"
    ),
    "sql_i6_recency_bands": ladder_report(bands.RECENCY, "recency_band"),
    "sql_i7_tenure_bands": ladder_report(bands.TENURE, "tenure_band"),
    "sql_i8_ticket_bands": ladder_report(bands.TICKETS, "ticket_band"),
    "sql_a1_genre_rank": over_tables(
        "SELECT genre, total_views, CAST(rank() OVER (ORDER BY total_views DESC) AS INTEGER) AS genre_rank "
        f"FROM (SELECT genre, count(*) AS total_views FROM {WATCHED_TITLES} GROUP BY 1)"
    ),
    "sql_a2_top_user_per_country": over_tables(
        """
        SELECT user_id, country, watch_time_hours, CAST(rn AS INTEGER) AS rn FROM (
          SELECT user_id, country, watch_time_hours, row_number() OVER (
                   PARTITION BY country ORDER BY watch_time_hours DESC NULLS LAST, user_id) AS rn
          FROM users) WHERE rn = 1"""
    ),
    "sql_a3_monthly_lag": over_tables(
        """
        SELECT month, sessions, lag(sessions) OVER (ORDER BY month) AS prev_month_sessions
        FROM (SELECT strftime(watch_date, '%Y-%m') AS month, count(*) AS sessions FROM watch_history GROUP BY 1)"""
    ),
    "sql_a4_plan_vs_benchmark": over_tables(
        f"SELECT subscription_type, {CHURN2}, "
        f"{pct('avg(churn) - (SELECT avg(churn) FROM users)', 2)} AS diff_vs_benchmark_pts FROM users GROUP BY 1"
    ),
    "sql_a5_top3_titles_per_genre": over_tables(
        f"""
        SELECT genre, title, views, CAST(rn AS INTEGER) AS rn FROM (
          SELECT genre, title, views, row_number() OVER (PARTITION BY genre ORDER BY views DESC, title) AS rn
          FROM (SELECT genre, title, count(*) AS views FROM {WATCHED_TITLES} GROUP BY 1, 2)) WHERE rn <= 3"""
    ),
    "sql_a6_ntile_deciles": over_tables(
        f"""
        SELECT risk_decile, count(*) AS users, {pct('avg(churn)', 1)} AS churn_rate_pct
        FROM (SELECT churn, CAST(ntile(10) OVER (ORDER BY raw_score NULLS FIRST, user_id) AS INTEGER) AS risk_decile
              FROM score) GROUP BY 1""",
        SCORE,
    ),
    "sql_a7_signup_cohorts": over_tables(
        f"SELECT strftime(signup_date, '%Y-%m') AS signup_cohort, count(*) AS cohort_size, "
        f"{pct('avg(1 - churn)', 1)} AS retained_pct FROM users GROUP BY 1"
    ),
}

KPIS = f"""
  SELECT (SELECT count(*) FROM users) AS total_users,
         (SELECT {pct('avg(churn)', 2)} FROM users) AS churn_rate,
         (SELECT {rnd('avg(watch_time_hours)', 2)} FROM users) AS avg_watch_time,
         (SELECT count(DISTINCT country) FROM users) AS countries,
         (SELECT count(*) FROM watch_history) AS total_sessions,
         (SELECT count(*) FROM ratings) AS total_ratings,
         (SELECT count(*) FROM content) AS total_titles,
         (SELECT {rnd('avg(rating)', 2)} FROM ratings) AS avg_rating,
         (SELECT {rnd('avg(completion_rate)', 1)} FROM watch_history) AS avg_completion_rate,
         (SELECT {rnd('avg(tenure_days)', 0)} FROM users) AS avg_tenure_days,
         (SELECT {rnd('avg(support_tickets)', 2)} FROM users) AS avg_support_tickets"""

ANALYSIS = {
    "an_kpis": over_tables(KPIS),
    "an_avg_session_duration": over_tables(
        f"SELECT {rnd('avg(session_duration)', 1)} AS avg_session_duration FROM watch_history"
    ),
    "an_churn_by_subscription": churn_by("subscription_type", "subscription_type"),
    "an_users_by_subscription": users_by("subscription_type"),
    "an_churn_by_country": churn_by("country", "country"),
    "an_users_by_country": users_by("country"),
    "an_churn_by_genre": churn_by("favorite_genre", "favorite_genre"),
    "an_churn_by_age_band": churn_by(cut_case(bands.AGE_CUT), "age_band"),
    "an_churn_by_recency_band": churn_by(cut_case(bands.RECENCY_CUT), "recency_band"),
    "an_churn_by_watch_band": churn_by(cut_case(bands.WATCH_CUT), "watch_band"),
    "an_churn_by_ticket_band": churn_by(cut_case(bands.TICKET_CUT), "ticket_band"),
    "an_churn_by_tenure_band": churn_by(cut_case(bands.TENURE_CUT), "tenure_band"),
    "an_recency_curve": curve("days_since_login", 3, 57),
    "an_watch_time_curve": curve("watch_time_hours", 1, 19),
    "an_parity_spread": over_tables(
        f"""
        SELECT dimension, {rnd('min(rate)', 1)} AS lowest, {rnd('max(rate)', 1)} AS highest,
               {rnd('max(rate) - min(rate)', 1)} AS spread
        FROM (
          SELECT 'country' AS dimension, country AS cell, {pct('avg(churn)', 2)} AS rate FROM users GROUP BY 2
          UNION ALL
          SELECT 'subscription', subscription_type, {pct('avg(churn)', 2)} FROM users GROUP BY 2
          UNION ALL
          SELECT 'age_band', {cut_case(bands.AGE_CUT)}, {pct('avg(churn)', 2)} FROM users GROUP BY 2)
        WHERE cell IS NOT NULL GROUP BY 1"""
    ),
    "an_genre_views": over_tables(
        "SELECT genre, count(*) AS views FROM watch_history w LEFT JOIN content c ON c.content_id = w.content_id "
        "WHERE genre IS NOT NULL GROUP BY 1"
    ),
    "an_genre_completion": over_tables(
        f"SELECT genre, {rnd('avg(completion_rate)', 1)} AS avg_completion FROM watch_history w "
        "LEFT JOIN content c ON c.content_id = w.content_id WHERE genre IS NOT NULL GROUP BY 1"
    ),
    "an_top_content": over_tables(
        f"""
        SELECT content_id, title, genre, {rnd('mean', 2)} AS avg_rating, n
        FROM (SELECT content_id, avg(rating) AS mean, count(*) AS n FROM ratings GROUP BY 1 HAVING count(*) >= 15)
        LEFT JOIN content USING (content_id) ORDER BY mean DESC, content_id LIMIT 10"""
    ),
    "an_most_watched": over_tables(
        f"SELECT c.content_id, title, genre, count(*) AS views FROM {WATCHED_TITLES} GROUP BY 1, 2, 3 "
        "ORDER BY views DESC, c.content_id LIMIT 10"
    ),
    "an_views_by_release_year": over_tables(
        f"SELECT release_year, count(*) AS views FROM {WATCHED_TITLES} GROUP BY 1"
    ),
    "an_monthly_sessions": over_tables(
        "SELECT strftime(watch_date, '%Y-%m') AS month, count(*) AS sessions FROM watch_history GROUP BY 1"
    ),
    "an_monthly_completion": over_tables(
        f"SELECT strftime(watch_date, '%Y-%m') AS month, {rnd('avg(completion_rate)', 1)} AS completion "
        "FROM watch_history GROUP BY 1"
    ),
}

NUMERIC = ("age", "tenure_days", "watch_time_hours", "days_since_login", "support_tickets", "num_devices")

SPLIT = """
placed AS (
  SELECT user_id, churn,
         row_number() OVER (PARTITION BY churn
                            ORDER BY ((user_id % 2147483647) * 48271) % 2147483647, user_id) AS place,
         count(*) OVER (PARTITION BY churn) AS size
  FROM users
),
parts AS (SELECT user_id, churn, place > floor(size * 0.25 + 0.5) AS is_train FROM placed)"""

RISK = {
    "risk_proxy": over_tables("SELECT * FROM proxy", SCORE, PROXY),
    "risk_top_users": over_tables(
        "SELECT * FROM proxy ORDER BY risk_proxy DESC NULLS LAST, user_id LIMIT 20", SCORE, PROXY
    ),
    "risk_user_lookup": over_tables("SELECT * FROM proxy WHERE user_id = 42", SCORE, PROXY),
    "risk_qcut_deciles": over_tables("SELECT * FROM summary", *DECILES, SUMMARY),
    "risk_capture": over_tables("SELECT * FROM caught", *DECILES, CAPTURE),
    "risk_rank_deciles": over_tables(
        f"""
        SELECT user_id, {rnd('raw_score', 4)} AS risk_score,
               CAST(ceil(rank() OVER (ORDER BY raw_score) * 10.0 / (SELECT count(*) FROM users)) AS INTEGER)
                 AS risk_decile
        FROM score""",
        SCORE,
    ),
    "risk_decile_tier": over_tables(
        """
        SELECT decile, concat('D', decile) AS label,
               CASE WHEN decile >= 9 THEN 'high' WHEN decile <= 3 THEN 'low' ELSE 'mid' END AS tier, n, churn_rate
        FROM summary""",
        *DECILES,
        SUMMARY,
    ),
    "risk_status_badge": over_tables(
        """
        SELECT user_id, name, risk_proxy, CASE WHEN churn = 1 THEN 'Churned' ELSE 'At risk' END AS status
        FROM proxy ORDER BY risk_proxy DESC NULLS LAST, user_id LIMIT 15""",
        SCORE,
        PROXY,
    ),
    "ml_features": over_tables(
        " UNION ALL ".join(
            [f"SELECT '{c}' AS feature, {rnd(f'sum({c})', 2)} AS total FROM users" for c in NUMERIC]
            + [
                f"SELECT concat('{c}_', {c}), CAST(count(*) AS DOUBLE) FROM users "
                f"WHERE {c} > (SELECT min({c}) FROM users) GROUP BY {c}"
                for c in ("subscription_type", "favorite_genre", "country")
            ]
        )
    ),
    "ml_feature_rows": over_tables(
        "SELECT user_id, "
        + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in NUMERIC)
        + ", concat_ws('|', "
        + ", ".join(
            f"CASE WHEN {c} > (SELECT min({c}) FROM users) THEN concat('{c}_', {c}) END"
            for c in ("subscription_type", "favorite_genre", "country")
        )
        + ") AS indicators FROM users"
    ),
    "ml_split": over_tables("SELECT user_id, churn, is_train FROM parts", SPLIT),
    "ml_zscore": over_tables(
        "SELECT user_id, "
        + ", ".join(f"{rnd(f'({c} - mean_{c}) / std_{c}', 6)} AS z_{c}" for c in NUMERIC)
        + " FROM users CROSS JOIN train_moments",
        SPLIT,
        "train_moments AS (SELECT "
        + ", ".join(
            f"avg({c}) AS mean_{c}, CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1 END AS std_{c}"
            for c in NUMERIC
        )
        + " FROM users WHERE user_id IN (SELECT user_id FROM parts WHERE is_train))",
    ),
    "ml_auc": over_tables(
        f"""
        SELECT {rnd('(sum(CASE WHEN churn = 1 THEN mean_rank ELSE 0 END) - p * (p + 1) / 2.0) / (p * (n - p))', 6)}
                 AS auc
        FROM (SELECT churn, sum(churn) OVER () AS p, count(*) OVER () AS n,
                     rank() OVER (ORDER BY risk_proxy)
                       + (count(*) OVER (PARTITION BY risk_proxy) - 1) / 2.0 AS mean_rank
              FROM proxy WHERE risk_proxy IS NOT NULL)
        GROUP BY p, n""",
        SCORE,
        PROXY,
    ),
    "ml_confusion": over_tables(
        f"""
        SELECT {pct("CAST(count(*) FILTER ((risk_proxy > 0.0) = (churn = 1)) AS DOUBLE) / nullif(count(*), 0)", 1)}
                 AS accuracy,
               {pct("CAST(count(*) FILTER (risk_proxy > 0.0 AND churn = 1) AS DOUBLE) / nullif(count(*) FILTER (risk_proxy > 0.0), 0)", 1)}
                 AS precision,
               {pct("CAST(count(*) FILTER (risk_proxy > 0.0 AND churn = 1) AS DOUBLE) / nullif(count(*) FILTER (churn = 1), 0)", 1)}
                 AS recall
        FROM proxy WHERE risk_proxy IS NOT NULL""",
        SCORE,
        PROXY,
    ),
}

STATS = f"""
stats AS (
  SELECT u.*, coalesce(h, 0.0) AS total_hours, coalesce(c, {users.DEFAULT_COMPLETION}) AS avg_completion,
         coalesce(n, 0) AS n_sessions, snapshot,
         CAST(coalesce(date_diff('day', last_watch, snapshot), tenure_days) AS INTEGER) AS idle_days
  FROM users u CROSS JOIN snap LEFT JOIN (
    SELECT user_id, CAST(sum(CAST(session_duration AS DECIMAL(18,1))) AS DOUBLE) / 60.0 AS h,
           avg(completion_rate) AS c, count(*) AS n, max(watch_date) AS last_watch
    FROM watch_history GROUP BY 1) s ON s.user_id = u.user_id
)"""
Z_SOURCES = {
    "z_recency": "idle_days",
    "z_watch": "total_hours",
    "z_tenure": "tenure_days",
    "z_tickets": "support_tickets",
    "z_completion": "avg_completion",
    "z_age": "age",
}
ZSCORES = "zscores AS (SELECT user_id, subscription_type, {} FROM stats)".format(
    ", ".join(f"({c} - avg({c}) OVER ()) / (stddev_samp({c}) OVER () + 1e-9) AS {z}" for z, c in Z_SOURCES.items())
)
_PLAN_CASE = "WHEN 'AUTOMOBILE' THEN 0.05 WHEN 'BUILDING' THEN -0.03 WHEN 'FURNITURE' THEN -0.1"
_LOGIT = " + ".join(f"({weight}) * {z}" for z, weight in users.WEIGHTS.items())

USERS = {
    "user_session_stats": over_tables(
        f"SELECT user_id, {rnd('total_hours', 6)} AS total_hours, {rnd('avg_completion', 6)} AS avg_completion, "
        "n_sessions FROM stats",
        STATS,
    ),
    "user_recency": over_tables(
        "SELECT user_id, idle_days AS days_since_login, CAST(snapshot - idle_days AS DATE) AS last_login FROM stats",
        STATS,
    ),
    "user_zscores": over_tables(
        "SELECT user_id, " + ", ".join(f"{rnd(z, 6)} AS {z}" for z in Z_SOURCES) + " FROM zscores", STATS, ZSCORES
    ),
    "user_churn_score": over_tables(
        f"SELECT user_id, {rnd('logit', 6)} AS logit, {rnd('1.0 / (1.0 + exp(-logit))', 6)} AS probability FROM "
        f"(SELECT user_id, CAST({users.INTERCEPT} AS DOUBLE) + CASE subscription_type {_PLAN_CASE} ELSE 0.0 END "
        f"+ {_LOGIT} AS logit FROM zscores)",
        STATS,
        ZSCORES,
    ),
    "user_favourite_genre": over_tables(
        """
        SELECT u.user_id, coalesce(f.genre, (SELECT min(genre) FROM content)) AS favorite_genre
        FROM users u LEFT JOIN (
          SELECT user_id, genre FROM (SELECT user_id, c.genre, count(*) AS n FROM watch_history w
            JOIN content c ON c.content_id = w.content_id GROUP BY 1, 2)
          QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, genre) = 1) f ON f.user_id = u.user_id"""
    ),
    "session_minutes": over_tables(
        f"SELECT order_key, line_no, user_id, w.content_id, "
        f"{rnd('duration_min * completion_rate / 100.0', 1)} AS session_minutes FROM {WATCHED_TITLES}"
    ),
}

USER_MEASURES = f"""count(*) AS total_users, count(*) FILTER (churn = 1) AS churned_users,
  {rnd('CAST(count(*) FILTER (churn = 1) AS DOUBLE) / nullif(count(*), 0)', 6)} AS churn_rate,
  {rnd('1.0 - CAST(count(*) FILTER (churn = 1) AS DOUBLE) / nullif(count(*), 0)', 6)} AS retention_rate,
  {rnd('avg(watch_time_hours)', 4)} AS avg_watch_hours, {rnd('avg(tenure_days)', 4)} AS avg_tenure_days"""
PICKED = "'BUILDING', 'MACHINERY'"
ALL_PLANS = "'AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'"
PICKED_TABLES = f"""
picked_users AS (SELECT * FROM users WHERE subscription_type IN ({PICKED})),
picked_watch AS (SELECT * FROM watch_history WHERE user_id IN (SELECT user_id FROM picked_users)),
picked_ratings AS (SELECT * FROM ratings WHERE user_id IN (SELECT user_id FROM picked_users)),
picked_titles AS (
  SELECT genre, release_year, completion_rate FROM picked_watch w JOIN content c ON c.content_id = w.content_id
)"""


def picked_churn(expr: str, name: str) -> str:
    return over_tables(
        f"SELECT {name}, {pct('avg(churn)', 2)} AS churn_rate FROM "
        f"(SELECT {expr} AS {name}, churn FROM picked_users) WHERE {name} IS NOT NULL GROUP BY 1",
        PICKED_TABLES,
    )


LADDERS = {
    "tenure_band": bands.TENURE,
    "ticket_band": bands.TICKETS,
    "recency_band": bands.RECENCY,
    "age_band": bands.AGE,
}

BI = {
    "bi_measures": over_tables(
        f"""
        SELECT {USER_MEASURES}, (SELECT count(*) FROM watch_history) AS total_sessions,
               (SELECT {rnd('avg(completion_rate)', 4)} FROM watch_history) AS avg_completion_rate,
               (SELECT {rnd('avg(rating)', 4)} FROM ratings) AS avg_rating
        FROM users"""
    ),
    "bi_churn_vs_benchmark": over_tables(
        f"SELECT country, {rnd('avg(churn)', 6)} AS churn_rate, "
        f"{rnd('avg(churn) - (SELECT avg(churn) FROM users)', 6)} AS churn_vs_benchmark FROM users GROUP BY 1"
    ),
    "bi_bands": over_tables(
        "SELECT user_id, " + ", ".join(f"{ladder_case(x)} AS {n}" for n, x in LADDERS.items()) + " FROM users"
    ),
    "bi_band_order": over_tables(
        "SELECT user_id, "
        + ", ".join(f"{ladder_case(x, order=True)} AS {n}_order" for n, x in LADDERS.items())
        + " FROM users"
    ),
    "bi_measure_by_segment": over_tables(
        f"SELECT {ladder_case(bands.RECENCY)} AS recency_band, {USER_MEASURES} FROM users GROUP BY 1"
    ),
    "bi_plan_slicer": over_tables(
        f"SELECT user_id, subscription_type, churn FROM users WHERE subscription_type IN ({PICKED})"
    ),
    "bi_filtered_facts": over_tables(
        "SELECT * FROM watch_history WHERE user_id IN "
        f"(SELECT user_id FROM users WHERE subscription_type IN ({PICKED}))"
    ),
    "bi_filtered_kpis": over_tables(
        f"""
        SELECT count(*) AS total_users, {pct('avg(churn)', 2)} AS churn_rate,
               {rnd('avg(tenure_days)', 0)} AS avg_tenure_days,
               {rnd('avg(support_tickets)', 2)} AS avg_support_tickets,
               (SELECT {rnd('avg(completion_rate)', 1)} FROM watch_history WHERE user_id IN
                 (SELECT user_id FROM users WHERE subscription_type IN ({PICKED}))) AS avg_completion
        FROM users WHERE subscription_type IN ({PICKED})"""
    ),
    "bi_date_hierarchy": over_tables(
        """
        SELECT year, quarter, month, count(*) AS sessions FROM (
          SELECT CAST(year(watch_date) AS INTEGER) AS year, CAST(quarter(watch_date) AS INTEGER) AS quarter,
                 CAST(month(watch_date) AS INTEGER) AS month FROM watch_history)
        GROUP BY ROLLUP (year, quarter, month)"""
    ),
    "bi_plan_share": over_tables(
        f"SELECT subscription_type, count(*) AS users, "
        f"{rnd('CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM users)', 4)} AS share FROM users GROUP BY 1"
    ),
    "bi_top_titles": over_tables(
        f"""
        SELECT title, genre, views, CAST(position AS INTEGER) AS position FROM (
          SELECT title, genre, views, rank() OVER (ORDER BY views DESC) AS position
          FROM (SELECT title, genre, count(*) AS views FROM {WATCHED_TITLES} GROUP BY 1, 2))
        WHERE position <= 10"""
    ),
    "lg_churn_by_tickets": picked_churn(cut_case(bands.TICKET_CUT), "ticket_band"),
    "lg_churn_by_country": picked_churn("country", "country"),
    "lg_genre_views": over_tables("SELECT genre, count(*) AS views FROM picked_titles GROUP BY 1", PICKED_TABLES),
    "lg_genre_completion": over_tables(
        f"SELECT genre, {rnd('avg(completion_rate)', 1)} AS avg_completion FROM picked_titles GROUP BY 1",
        PICKED_TABLES,
    ),
    "lg_top_content": over_tables(
        f"""
        SELECT content_id, title, genre, {rnd('mean', 2)} AS avg_rating, n FROM
          (SELECT content_id, avg(rating) AS mean, count(*) AS n FROM picked_ratings GROUP BY 1 HAVING count(*) >= 15)
        LEFT JOIN content USING (content_id) ORDER BY mean DESC, content_id LIMIT 10""",
        PICKED_TABLES,
    ),
    "lg_monthly_sessions": over_tables(
        "SELECT strftime(watch_date, '%Y-%m') AS month, count(*) AS sessions FROM picked_watch GROUP BY 1",
        PICKED_TABLES,
    ),
    "lg_monthly_completion": over_tables(
        f"SELECT strftime(watch_date, '%Y-%m') AS month, {rnd('avg(completion_rate)', 1)} AS completion "
        "FROM picked_watch GROUP BY 1",
        PICKED_TABLES,
    ),
    "lg_views_by_release_year": over_tables(
        "SELECT release_year, count(*) AS views FROM picked_titles GROUP BY 1", PICKED_TABLES
    ),
    "lg_recency_bands": churn_by(cut_case(bands.OLD_RECENCY_CUT), "recency_band"),
    "lg_tenure_bands": churn_by(cut_case(bands.OLD_TENURE_CUT), "tenure_band"),
}


def _keys(table: str, *key: str) -> str:
    missing = " OR ".join(f"{c} IS NULL" for c in key)
    return f"""
        SELECT '{table}' AS table_name, CAST(coalesce(sum(rows) FILTER ({missing}), 0) AS BIGINT) AS null_keys,
               count(*) FILTER (NOT ({missing}) AND rows > 1) AS repeated_keys,
               CAST(coalesce(sum(rows - 1) FILTER (NOT ({missing}) AND rows > 1), 0) AS BIGINT) AS surplus_rows
        FROM (SELECT {", ".join(key)}, count(*) AS rows FROM {table} GROUP BY ALL)"""


def _orphans(fact: str, parent: str, key: str) -> str:
    return (
        f"SELECT '{fact}.{key}' AS relationship, count(*) AS orphan_rows FROM {fact} f "
        f"WHERE f.{key} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{key} = f.{key})"
    )


QUALITY = {
    "dq_pk": over_tables(
        " UNION ALL ".join(
            [
                _keys("users", "user_id"),
                _keys("content", "content_id"),
                _keys("watch_history", "order_key", "line_no"),
                _keys("ratings", "order_key", "line_no"),
            ]
        )
    ),
    "dq_fk": over_tables(
        " UNION ALL ".join(
            _orphans(fact, parent, key)
            for fact in ("watch_history", "ratings")
            for parent, key in (("users", "user_id"), ("content", "content_id"))
        )
    ),
    "dq_domain": over_tables(
        f"""
        SELECT 'churn_is_0_or_1' AS check_name, count(*) AS violations FROM users WHERE churn NOT IN (0, 1)
        UNION ALL SELECT 'plan_is_known', count(*) FROM users WHERE subscription_type NOT IN ({ALL_PLANS})
        UNION ALL SELECT 'rating_1_to_5', count(*) FROM ratings WHERE rating NOT BETWEEN 1 AND 5
        UNION ALL SELECT 'completion_0_to_100', count(*) FROM watch_history
                  WHERE completion_rate NOT BETWEEN 0 AND 100"""
    ),
    "dq_outside_bands": over_tables(
        " UNION ALL ".join(
            f"SELECT '{report}' AS report, count(*) AS users, "
            f"count(*) FILTER (coalesce(NOT ({inside}), true)) AS left_out FROM users"
            for report, inside in (
                ("age_band", "age > 17 AND age <= 100"),
                ("recency_band", "days_since_login > -1 AND days_since_login <= 1000"),
                ("watch_band", "watch_time_hours > -1 AND watch_time_hours <= 1000"),
                ("ticket_band", "support_tickets > -1 AND support_tickets <= 100"),
                ("tenure_band", "tenure_days > 0 AND tenure_days <= 1200"),
                ("recency_curve", "days_since_login >= 0 AND days_since_login < 1000"),
                ("watch_time_curve", "watch_time_hours >= 0 AND watch_time_hours < 1000"),
            )
        )
    ),
    "dq_session_window": over_tables(
        """
        SELECT count(*) FILTER (watch_date < signup_date) AS before_signup,
               count(*) FILTER (watch_date > last_login) AS after_last_login, count(*) AS sessions
        FROM watch_history w JOIN users u ON u.user_id = w.user_id"""
    ),
}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_SHAPES = ", ".join(_quoted(s) for s in guard.LOG_SHAPES)
# White space, rejected words in reporting order, messages.
_WHITE = " \t\n\v\f\r\u00a0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(map(chr, range(0x2000, 0x200B)))
_FORBIDDEN = (
    "INSERT UPDATE DELETE DROP ALTER CREATE REPLACE TRUNCATE VACUUM ATTACH DETACH PRAGMA REINDEX "
    "EXEC EXECUTE COPY GRANT REVOKE MERGE CALL DO"
).split()
_MANY_STATEMENTS = "Multiple statements are not allowed."
_NOT_A_QUERY = "Only SELECT / WITH (read-only) queries are allowed."
_FORBIDDEN_WORD = "Forbidden keyword detected: "
_UNKNOWN_TABLE = "Query references an unknown table: "
_WORDS = ", ".join(f"'{w}'" for w in _FORBIDDEN)
_NAME = "([a-zA-Z_][a-zA-Z0-9_]*)"
def audited(log: str) -> str:
    """The audit as table expressions over the statements (stmt_id, sql_text) that ``log`` selects."""
    return f"""
log AS ({log}),
cleaned AS (
  SELECT stmt_id, rtrim(trim(sql_text, '{_WHITE}'), ';') AS statement
  FROM log
),
parsed AS (
  SELECT *,
         [upper(w) FOR w IN regexp_extract_all(statement, '(?i)\\b({"|".join(_FORBIDDEN)})\\b', 1)] AS words,
         [lower(t) FOR t IN regexp_extract_all(statement, '(?i)\\b(?:FROM|JOIN)[{_WHITE}]+{_NAME}', 1)] AS refs,
         list_concat(['users', 'content', 'watch_history', 'ratings'],
           [lower(t) FOR t IN regexp_extract_all(statement, '(?i)\\b{_NAME}[{_WHITE}]+AS[{_WHITE}]*\\(', 1)]) AS known
  FROM cleaned
),
audited AS (
  SELECT stmt_id, statement, CASE
    WHEN statement IS NULL THEN '{_NOT_A_QUERY}'
    WHEN contains(statement, ';') THEN '{_MANY_STATEMENTS}'
    WHEN NOT regexp_matches(statement, '(?i)^[{_WHITE}]*(SELECT|WITH)\\b') THEN '{_NOT_A_QUERY}'
    WHEN len(words) > 0 THEN '{_FORBIDDEN_WORD}' || [w FOR w IN [{_WORDS}] IF list_contains(words, w)][1]
    WHEN len([t FOR t IN refs IF NOT list_contains(known, t)]) > 0
      THEN '{_UNKNOWN_TABLE}' || [t FOR t IN refs IF NOT list_contains(known, t)][1]
  END AS problem
  FROM parsed
)"""


_LOOKUPS = """SELECT concat_ws('-', conv_id, turn) AS stmt_id,
       concat('SELECT title FROM content WHERE title = ', chr(39), replace(text, chr(39), chr(39) || chr(39)), chr(39)) AS sql_text
FROM conversations"""
AUDIT = audited(
    f"""SELECT event_id AS stmt_id,
       replace([{_SHAPES}][event_id % {len(guard.LOG_SHAPES)} + 1], '{{u}}', CAST(user_id AS VARCHAR)) AS sql_text
  FROM events"""
)

SHEET_FIELDS = {"churn_label_in_data": "churn"}


def _sheet_line(label: str) -> str:
    column = SHEET_FIELDS.get(label, label)
    value = f"CAST({column} AS VARCHAR)"
    if label == "watch_time_hours":
        value = "regexp_replace(CAST(CAST(watch_time_hours AS DECIMAL(28,2)) AS VARCHAR), '\\.?0+$', '')"
    note = profiles.PROFILE_NOTES.get(label, "")
    return f"concat('{label}: ', coalesce({value}, 'null'), {_quoted(note)})"


SHEET = "concat_ws(chr(10), " + ", ".join(_sheet_line(label) for label in profiles.PROFILE_LINES) + ")"
_TONES = ", ".join(f"('{tone}', {_quoted(style)})" for tone, style in profiles.TONES.items())
DAY_US = 86_400_000_000



def throttled(key: str, quota: int) -> str:
    return f"""
        WITH RECURSIVE log AS (
          SELECT event_id, {key}, epoch_us(ts) AS us,
                 row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS rn FROM events
        ), run AS (
          SELECT event_id, {key}, us, rn, us AS opened, 1 AS passed, true AS accepted FROM log WHERE rn = 1
          UNION ALL
          SELECT l.event_id, l.{key}, l.us, l.rn,
                 CASE WHEN l.us > r.opened + {DAY_US} THEN l.us ELSE r.opened END,
                 CASE WHEN l.us > r.opened + {DAY_US} THEN 1 WHEN r.passed >= {quota} THEN r.passed ELSE r.passed + 1 END,
                 l.us > r.opened + {DAY_US} OR r.passed < {quota}
          FROM run r JOIN log l ON l.{key} = r.{key} AND l.rn = r.rn + 1
        )
        SELECT event_id, {key}, accepted,
               CASE WHEN NOT accepted THEN CAST((opened + {DAY_US} - us + 999999) // 1000000 AS INTEGER) END
                 AS retry_after
        FROM run"""


THROTTLE = throttled("user_id", 2)

_SAMPLE = (
    "SELECT u.country, count(*) AS sessions, max(w.watch_date) AS last_day "
    "FROM watch_history w JOIN users u ON u.user_id = w.user_id GROUP BY u.country"
)
REQUESTS = {
    "guard_audit": f"WITH {AUDIT.strip()}\nSELECT *, problem IS NULL AS accepted FROM audited",
    "guard_row_cap": f"""WITH {AUDIT.strip()}
        SELECT stmt_id, CASE WHEN regexp_matches(statement, '(?i)\\bLIMIT\\s+\\d+') THEN statement
                             ELSE statement || chr(10) || 'LIMIT {guard.ROW_CAP}' END AS capped_sql
        FROM audited WHERE problem IS NULL""",
    "guard_audit_text": f"WITH {audited(_LOOKUPS).strip()}\nSELECT *, problem IS NULL AS accepted FROM audited",
    "guarded_query": over_tables(_SAMPLE),
    "guarded_summary": over_tables(
        f"SELECT {_quoted(_SAMPLE)} || chr(10) || 'LIMIT 500' AS executed_sql, count(*) AS row_count FROM ({_SAMPLE})"
    ),
    "guarded_answer": over_tables(
        f"SELECT {_quoted(_SAMPLE)} || chr(10) || 'LIMIT 500' AS executed_sql, count(*) OVER () AS row_count, "
        f"count(*) OVER () > 200 AS rows_cut, * FROM ({_SAMPLE})"
    ),
    "user_fact_sheets": over_tables(f"SELECT user_id, {SHEET} AS fact_sheet FROM users"),
    "winback_requests": over_tables(
        f"""
        SELECT user_id, tone, style || chr(10) || chr(10) || '{profiles.REQUEST_HEAD}' || chr(10) || {SHEET}
               || chr(10) || chr(10) || '{profiles.REQUEST_TAIL}' AS request
        FROM deciled CROSS JOIN (VALUES {_TONES}) AS tones (tone, style) WHERE decile >= 9""",
        *DECILES,
    ),
    "throttle_batch": THROTTLE,
    "throttle_text_keys": throttled("event_type", 15),
    # The log lies in one file, so one micro-batch sees it in order and no row is late.
    "throttle_stream": f"SELECT *, false AS late FROM ({THROTTLE})",
    "ask_overall_churn": over_tables(f"SELECT {CHURN2} FROM users"),
    "ask_top_churn_country": over_tables(
        f"SELECT country, {pct('avg(churn)', 2)} AS churn_rate FROM users GROUP BY 1 "
        "ORDER BY churn_rate DESC, country LIMIT 1"
    ),
    "ask_churn_by_plan": LIBRARY["sql_i3_churn_by_plan"],
    "ask_churn_3plus_tickets": over_tables(
        f"SELECT count(*) AS users, {CHURN2} FROM users WHERE support_tickets >= 3"
    ),
    "ask_best_rated_genre": over_tables(
        f"SELECT genre, {rnd('avg(rating)', 2)} AS avg_rating FROM ratings r JOIN content c "
        "ON c.content_id = r.content_id GROUP BY 1 ORDER BY avg_rating DESC, genre LIMIT 1"
    ),
    "ask_churn_by_tenure": LIBRARY["sql_i7_tenure_bands"],
}

_METRICS = {
    "churn_by_subscription": "subscription_type",
    "churn_by_country": "country",
    "churn_by_genre": "favorite_genre",
    "churn_by_age_band": cut_case(bands.AGE_CUT),
    "churn_by_recency_band": cut_case(bands.RECENCY_CUT),
    "churn_by_watch_band": cut_case(bands.WATCH_CUT),
    "churn_by_support_tickets": cut_case(bands.TICKET_CUT),
    "churn_by_tenure_band": cut_case(bands.TENURE_CUT),
}


def _plain(expr: str, places: int) -> str:
    return f"regexp_replace(CAST(CAST({expr} AS DECIMAL(28,{places})) AS VARCHAR), '\\.?0+$', '')"


BUNDLE = {
    "bundle_maps_to_rows": over_tables(
        "SELECT * FROM ("
        + " UNION ALL ".join(
            f"SELECT '{metric}' AS metric, {expr} AS name, {pct('avg(churn)', 2)} AS value FROM users GROUP BY 2"
            for metric, expr in _METRICS.items()
        )
        + ") WHERE name IS NOT NULL"
    ),
    "bundle_growth_rows": over_tables(
        f"""
        SELECT strftime(watch_date, '%Y-%m') AS month, strftime(min(watch_date), '%b %y') AS name,
               count(*) AS sessions, {rnd('avg(completion_rate)', 1)} AS completion
        FROM watch_history GROUP BY 1"""
    ),
    "bundle_month_label": over_tables(
        "SELECT strftime(watch_date, '%Y-%m') AS month, strftime(min(watch_date), '%b %y') AS label "
        "FROM watch_history GROUP BY 1"
    ),
    "bundle_kpi_cards": over_tables(
        f"""
        SELECT 'Total Users' AS label, format('{{:,}}', total_users) AS value FROM kpis
        UNION ALL SELECT 'Churn Rate', {_plain('churn_rate', 2)} || '%' FROM kpis
        UNION ALL SELECT 'Avg Tenure', CAST(CAST(avg_tenure_days AS BIGINT) AS VARCHAR) || ' days' FROM kpis
        UNION ALL SELECT 'Countries', CAST(countries AS VARCHAR) FROM kpis
        UNION ALL SELECT 'Total Sessions', format('{{:,}}', total_sessions) FROM kpis
        UNION ALL SELECT 'Top-Decile Capture', {_plain('capture_pct', 1)} || '%' FROM caught""",
        f"kpis AS ({KPIS})",
        *DECILES,
        CAPTURE,
    ),
}

TEXTS: dict[str, str] = {**SOURCES, **LIBRARY, **ANALYSIS, **RISK, **USERS, **BI, **QUALITY, **REQUESTS, **BUNDLE}
