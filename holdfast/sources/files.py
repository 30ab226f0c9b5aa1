"""CSV, JSON and database ends of the four-table model."""

from __future__ import annotations

import warnings
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.sources import schemas
from holdfast.sources.tables import Tables

# File names of the four tables; the users file capitalises its header.
CSV_FILES = {
    "users": "users_with_churn.csv",
    "content": "content.csv",
    "watch_history": "watch_history.csv",
    "ratings": "ratings.csv",
}
USER_HEADERS = {
    "user_id": "User_ID",
    "name": "Name",
    "age": "Age",
    "country": "Country",
    "subscription_type": "Subscription_Type",
    "signup_date": "Signup_Date",
    "tenure_days": "Tenure_Days",
    "watch_time_hours": "Watch_Time_Hours",
    "favorite_genre": "Favorite_Genre",
    "last_login": "Last_Login",
    "days_since_login": "Days_Since_Login",
    "support_tickets": "Support_Tickets",
    "num_devices": "Num_Devices",
    "churn": "Churn",
}


def read_csv(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table from CSV files with a header: lower-case names, empty field is NULL.

    Columns are taken by position under the explicit schema, so a capitalised header
    needs no renaming; a header that does not fit the schema fails.
    """
    path = f"{folder}/{CSV_FILES[name]}"
    reader = spark.read.option("header", True).option("nullValue", "").option("emptyValue", "")
    schema = schemas.ALL[name]
    if name == "users":
        headed = T.StructType([T.StructField(USER_HEADERS[f.name], f.dataType) for f in schema])
        lower = {header: column for column, header in USER_HEADERS.items()}
        return reader.schema(headed).csv(path, enforceSchema=False).withColumnsRenamed(lower)
    return reader.schema(schema).csv(path, enforceSchema=False)


def read_csv_tables(spark: SparkSession, folder: str) -> Tables:
    return Tables(**{name: read_csv(spark, folder, name) for name in CSV_FILES})


def write_csv_tables(t: Tables, folder: str) -> None:
    """One folder of CSV parts per table, each part with a header."""
    for name, file_name in CSV_FILES.items():
        df = t.named()[name].select(*schemas.ALL[name].names)
        if name == "users":
            df = df.withColumnsRenamed(USER_HEADERS)
        df.write.option("header", True).option("emptyValue", "").csv(f"{folder}/{file_name}")


def read_jdbc_tables(
    spark: SparkSession, url: str, partitions: int, key_ranges: Mapping[str, tuple[str, int, int]], **options: str
) -> Tables:
    """The four tables from a database, each read in parallel ranges of a numeric key.

    ``key_ranges`` maps a table to (column, lowest, highest); content has a text key
    and no entry, so it is read in one piece.
    """
    frames = {}
    for name, schema in schemas.ALL.items():
        reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
        if name in key_ranges:
            column, low, high = key_ranges[name]
            reader = reader.options(
                partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=partitions
            )
        frames[name] = reader.load().select(*[F.col(f.name).cast(f.dataType) for f in schema])
    return Tables(**frames)


def read_tables(
    spark: SparkSession, folder: str, url: str | None = None, partitions: int = 64, key_ranges=None, **options: str
) -> Tables:
    """From the database when a URL is given and reachable, else from the CSV files."""
    if url:
        try:
            return read_jdbc_tables(spark, url, partitions, key_ranges or {}, **options)
        except Exception as problem:  # any connection or driver failure falls back
            warnings.warn(f"database load failed ({problem}); reading the CSV files")
    return read_csv_tables(spark, folder)


def append_jdbc_tables(t: Tables, url: str, connections: int = 16, batch_rows: int = 10_000, **options: str) -> None:
    """Append the four tables to existing database tables, dimensions first.

    ``numPartitions`` bounds the connections; every task sends batches of rows.
    """
    for name, schema in schemas.ALL.items():
        (
            t.named()[name]
            .select(*schema.names)
            .write.format("jdbc")
            .options(url=url, dbtable=name, numPartitions=connections, batchsize=batch_rows, **options)
            .mode("append")
            .save()
        )


def write_document(document: DataFrame, path: str) -> None:
    """Write a one-row frame with a JSON text column as one text file."""
    document.select("document").coalesce(1).write.text(path)
