"""The four-table model, and its derivation from the order tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.functions.numbers import round_dp, round_small
from holdfast.sources import schemas
from holdfast.sources.workspace import publish, publish_bucketed


@dataclass(frozen=True)
class Tables:
    """users and content are dimensions, watch_history and ratings are facts.

    ``watch_key`` and ``rating_key`` name the columns that should identify a row.
    """

    users: DataFrame
    content: DataFrame
    watch_history: DataFrame
    ratings: DataFrame
    watch_key: tuple[str, ...] = ("watch_id",)
    rating_key: tuple[str, ...] = ("rating_id",)

    def named(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in schemas.ALL}

    def create_views(self) -> None:
        """Register the four tables as temporary views for Spark SQL."""
        for name, df in self.named().items():
            df.createOrReplaceTempView(name)

    def keys(self) -> dict[str, tuple[str, ...]]:
        return {
            "users": ("user_id",),
            "content": ("content_id",),
            "watch_history": self.watch_key,
            "ratings": self.rating_key,
        }

    @property
    def user_totals(self) -> DataFrame:
        """Sessions folded by user and genre, those of unknown titles under no genre."""
        titles = self.content.select("content_id", "genre", F.lit(1).alias("_known"))
        sessions = self.watch_history.join(titles, "content_id", "left")
        return session_totals(sessions, ("user_id", "genre"), F.col("_known"))


_WATCH_COLUMNS = (
    "order_key",
    "line_no",
    "user_id",
    "content_id",
    "watch_date",
    "session_duration",
    "completion_rate",
)


def session_minutes(duration_min, completion_rate):
    """Minutes watched: the title's length times the share completed, one decimal."""
    return round_small(duration_min * completion_rate / F.lit(100.0), 1)


def session_totals(sessions: DataFrame, by: tuple[str, ...], known: Column | None = None) -> DataFrame:
    """Sessions, those of a known title, minutes, completion and last day of each group."""
    return sessions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.lit(1) if known is None else known).alias("of_titles"),
        F.sum(F.col("session_duration").cast("decimal(18,1)")).alias("minutes"),
        F.sum("completion_rate").alias("completion_sum"),
        F.count("completion_rate").alias("completion_n"),
        F.max("watch_date").alias("last_watch"),
    )


def _content(part: DataFrame, *keep: str) -> DataFrame:
    return part.select(
        *keep,
        F.format_string("C%06d", "p_partkey").alias("content_id"),
        F.col("p_name").alias("title"),
        F.col("p_type").alias("genre"),
        (F.lit(2015) + F.col("p_partkey") % 11).cast("int").alias("release_year"),
        (F.lit(45) + F.col("p_size") * 3).alias("duration_min"),
    )


def _sessions(lineitem: DataFrame, orders: DataFrame, part: DataFrame) -> DataFrame:
    """One row per order line, with the user, the title's genre and the rating, if it has one.

    Values are derived before the joins, which move fewer bytes then. Both joins are left to Catalyst: order keys shuffle, titles are broadcast only
    while they are under the session's threshold, and AQE splits hot keys.
    """
    buyers = orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user_id"))
    titles = _content(part.withColumn("l_partkey", F.col("p_partkey")), "l_partkey")
    steps = F.floor(F.round(F.col("l_discount") * 100) / 2.0).cast("int")
    lines = lineitem.select(
        "l_orderkey",
        "l_partkey",
        F.col("l_linenumber").alias("line_no"),
        F.col("l_shipdate").cast("date").alias("watch_date"),
        (F.lit(2.0) * F.col("l_quantity")).alias("completion_rate"),
        # Never null where the flag is R: the least of two numbers passes over a null.
        F.when(F.col("l_returnflag") == "R", F.least(F.lit(5), F.lit(1) + steps)).alias("rating"),
    )
    return (
        lines.join(buyers, "l_orderkey")
        .join(titles, "l_partkey")
        .select(
            F.col("l_orderkey").alias("order_key"),
            "line_no",
            "user_id",
            "content_id",
            "watch_date",
            session_minutes(F.col("duration_min"), F.col("completion_rate")).alias("session_duration"),
            "completion_rate",
            "genre",
            "rating",
        )
    )


def _ratings(sessions: DataFrame) -> DataFrame:
    return sessions.where("rating IS NOT NULL").select("order_key", "line_no", "user_id", "content_id", "rating")


def favourite_genre(counts: DataFrame) -> DataFrame:
    """Most frequent genre per user from (user_id, genre, n); ties go to the first name."""
    best = F.min(F.struct((-F.col("n")).alias("n"), "genre"))
    return counts.groupBy("user_id").agg(best.getField("genre").alias("favorite_genre"))


def _users(
    customer: DataFrame, nation: DataFrame, orders: DataFrame, part: DataFrame, totals: DataFrame
) -> DataFrame:
    snapshot = totals.agg(F.max("last_watch")).scalar()
    fallback_genre = part.agg(F.min("p_type")).scalar()
    ordered = orders.groupBy(F.col("o_custkey").alias("user_id")).agg(
        F.min(F.col("o_orderdate").cast("date")).alias("first_order"),
        F.count_if(F.col("o_orderpriority") == "1-URGENT").cast("int").alias("urgent"),
        F.countDistinct("o_orderpriority").cast("int").alias("priorities"),
    )
    best = F.min(F.struct((-F.col("n")).alias("n"), "genre"))
    watched = totals.groupBy("user_id").agg(
        F.sum("minutes").alias("minutes"),
        F.max("last_watch").alias("last_watch"),
        best.getField("genre").alias("top_genre"),
    )
    nations = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("country"))
    dated = (
        customer.withColumnRenamed("c_custkey", "user_id")
        .join(nations, "c_nationkey", "left")
        .join(ordered, "user_id", "left")
        .join(watched, "user_id", "left")
        .withColumn("snapshot", snapshot)
        .withColumn("signup_date", F.coalesce("first_order", "snapshot"))
        .withColumn("last_login", F.coalesce("last_watch", "signup_date"))
        .withColumn("days_since_login", F.datediff("snapshot", "last_login"))
        .withColumn("support_tickets", F.coalesce("urgent", F.lit(0)))
    )
    watched_hours = round_dp(F.col("minutes").cast("double") / F.lit(60.0), 2)
    strain = F.lit(40) * F.col("days_since_login") + F.lit(300) * F.col("support_tickets")
    return dated.select(
        "user_id",
        F.col("c_name").alias("name"),
        (F.lit(18) + (F.col("user_id") * 7) % 55).cast("int").alias("age"),
        "country",
        F.col("c_mktsegment").alias("subscription_type"),
        "signup_date",
        F.datediff("snapshot", "signup_date").alias("tenure_days"),
        F.coalesce(watched_hours, F.lit(0.0)).alias("watch_time_hours"),
        F.coalesce("top_genre", fallback_genre).alias("favorite_genre"),
        "last_login",
        "days_since_login",
        "support_tickets",
        F.greatest(F.lit(1), F.coalesce("priorities", F.lit(0))).alias("num_devices"),
        F.when(strain > F.col("c_acctbal") + 3000, 1).otherwise(0).alias("churn"),
    )


_INPUTS = ("customer", "nation", "orders", "lineitem", "part")


class DerivedTables(Tables):
    """The four tables over a folder of order tables, each derived and published at its first use.

    Later queries scan only the columns they need of the published tables. Ratings are a
    filter over the published sessions and have no copy of their own.
    """

    watch_key = rating_key = ("order_key", "line_no")

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.base = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in _INPUTS}

    @cached_property
    def sessions(self) -> DataFrame:
        return publish(_sessions(self.base["lineitem"], self.base["orders"], self.base["part"]), "sessions")

    @cached_property
    def user_totals(self) -> DataFrame:
        """In the buckets of the users; a user has one row a genre, whatever number of sessions."""
        return publish_bucketed(session_totals(self.sessions, ("user_id", "genre")), "user-totals", "user_id")

    @cached_property
    def users(self) -> DataFrame:
        b = self.base
        users = _users(b["customer"], b["nation"], b["orders"], b["part"], self.user_totals)
        # The lookup of one user reads one bucket and skips its other row groups.
        return publish_bucketed(users, "users", "user_id")

    @cached_property
    def content(self) -> DataFrame:
        return publish(_content(self.base["part"]), "content")

    @cached_property
    def watch_history(self) -> DataFrame:
        return self.sessions.select(*_WATCH_COLUMNS)

    @cached_property
    def ratings(self) -> DataFrame:
        return _ratings(self.sessions)


def _input_state(spark: SparkSession, sf_dir: str) -> tuple:
    """Files, bytes and time of change of each input, so that new data under an old path is seen."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    state = []
    for name in _INPUTS:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        fs = path.getFileSystem(conf)
        held = fs.getContentSummary(path)
        state.append((held.getFileCount(), held.getLength(), fs.getFileStatus(path).getModificationTime()))
    return tuple(state)


_loaded: dict[tuple[str, str], tuple[tuple, Tables]] = {}


def load(spark: SparkSession, sf_dir: str) -> Tables:
    """The tables of a folder, the same ones for an application until the folder's files change."""
    key, state = (spark.sparkContext.applicationId, sf_dir), _input_state(spark, sf_dir)
    if key not in _loaded or _loaded[key][0] != state:
        _loaded[key] = (state, DerivedTables(spark, sf_dir))
    return _loaded[key][1]


def load_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")
