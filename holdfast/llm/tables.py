"""Reading inputs, cutting lineage and small rules that several operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.sources.workspace import fresh_path

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
BLOCK_GROUP_BYTES = 16 << 20
# Bits of a sieve, 64 in a row: bounds what is broadcast, at 16 bytes a row.
SIEVE_BITS = 1 << 26


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def settled(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder and read back: no lineage is left to recompute."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sifted(rows: DataFrame, key: str, ids: DataFrame, name: str) -> DataFrame:
    """Adds the boolean ``name``: false where ``ids`` (one column) surely lacks the key, as it does a null one.

    A key that ids has is always true, and few others are, while ids are fewer than ``SIEVE_BITS``:
    rows are told apart where they lie, before the exact join moves those that are left.
    """

    def place(column: Column) -> Column:
        return F.pmod(F.xxhash64(column.cast("long")), F.lit(SIEVE_BITS))

    held = ids.select(place(F.col(ids.columns[0])).alias("place")).groupBy(F.shiftright("place", 6).alias("__word"))
    words = held.agg(F.bit_or(F.expr("shiftleft(1L, CAST(place % 64 AS INT))")).alias("__bits"))
    at = place(F.col(key))
    met = rows.withColumn("__at", at).withColumn("__word", F.shiftright("__at", 6)).join(F.broadcast(words), "__word", "left")
    bit = F.expr("__bits & shiftleft(1L, CAST(__at % 64 AS INT))") != 0
    return met.select(*rows.columns, (F.col(key).isNotNull() & F.coalesce(bit, F.lit(False))).alias(name))


def settled_blocks(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Rows of some MB each, written as they come into buckets by ``key``: joins and groups by it move none of them.

    Row groups hold a few rows, and their size is looked at after every row.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    sizes = {"parquet.block.size": BLOCK_GROUP_BYTES, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}
    (
        df.write.bucketBy(buckets, key)
        .options(**sizes)
        .option("parquet.enable.dictionary", False)
        .option("compression", "zstd")
        .option("path", fresh_path(spark, name))
        .saveAsTable(table)
    )
    return spark.table(table)


def block_ids() -> Iterator[int]:
    """Numbers that no other task of the running job gives; a task that is run again gives the same ones."""
    return count(TaskContext.get().partitionId() << 33)


def folded(block: pa.RecordBatch) -> bytes:
    """A block as one compressed value."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, block.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(block)
    return sink.getvalue().to_pybytes()


def unfolded(value: pa.BinaryScalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(value.as_buffer()).read_next_batch()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_slices(batches: Iterator[pa.RecordBatch], limit: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches cut so that the text of each holds about ``limit`` bytes; one row is never cut.

    After a batch, Arrow gives back the memory it keeps for reuse: the worker lives on beside other stages.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum(byte_lengths(text))
        begin = 0
        while begin < batch.num_rows:
            before = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end
        pa.default_memory_pool().release_unused()


def byte_lengths(text: pa.Array) -> np.ndarray:
    lengths = pc.binary_length(text).fill_null(0)
    return lengths.to_numpy(zero_copy_only=False).astype(np.int64)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[i] .. starts[i] + lengths[i] - 1 of all i, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
