"""Intermediate tables in the cluster's shared folder.

A published table is written once and read back, so its lineage is cut and it
survives the loss of any executor. The folder is ``spark.checkpoint.dir``; a
temporary one is made only in local mode when that setting is missing.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = context.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="holdfast-")
    return _local_folders[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/holdfast/{app}/{name}-{uuid.uuid4().hex}"


def publish_bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """Published in one file a bucket of ``key``, sorted by it: joins and groups by the key move no rows.

    For tables with few rows a key only. The table is external and stays in the session's catalog.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    (
        df.repartition(buckets, key)
        .write.bucketBy(buckets, key)
        .sortBy(key)
        .option("compression", "zstd")
        .option("path", fresh_path(spark, name))
        .saveAsTable(table)
    )
    return spark.table(table)


def publish(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.partitionBy(*partition_by).option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
