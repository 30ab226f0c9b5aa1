"""Token ids as Arrow files of equal-length sequences.

Documents are dealt to shards by ranges of ``doc_id``, those of one id by a hash of their
text, equal rows by chance: many rows without an id fill as many shards as other rows. A shard is two Arrow files:
``tokens-<shard>.arrow`` holds the ids of its documents one after another, cut into
sequences of ``length`` ids, each a row of a fixed-size list beside a fixed-size list of
mask bits (false on the padding behind the shard's last id); ``index-<shard>.arrow`` holds
``doc_id``, the place of its first id in the shard and its number of ids. All batches but
the last have ``BATCH_ROWS`` rows, so sequence r is row r % BATCH_ROWS of batch
r // BATCH_ROWS, a view into the mapped file.

Defined results: a null text is an empty one; documents of equal id stand in the
order of their texts' hashes; documents without an id stand first; an id that has no room in
narrow files ends the write with an OverflowError; other columns are not read; an empty table gives no
shard. A text is held whole by one task; a shard is written block by block.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from holdfast.llm.encoding import BLOCK_BYTES, LibraryEncoder, encode, encoder_of, with_end
from holdfast.llm.tables import partitions, settled, text_slices
from holdfast.sources.workspace import fresh_path

BATCH_ROWS = 256
SEED = 3


@dataclass(frozen=True)
class Layout:
    """``wide`` ids take four bytes, others two; None: as the vocabulary needs."""

    length: int = 1024
    wide: bool | None = None

    def for_ids(self, largest: int) -> Layout:
        return self if self.wide is not None else replace(self, wide=largest > np.iinfo(np.uint16).max)

    @property
    def schema(self) -> pa.Schema:
        kind = pa.uint32() if self.wide else pa.uint16()
        return pa.schema([("ids", pa.list_(kind, self.length)), ("mask", pa.list_(pa.bool_(), self.length))])

    @property
    def dtype(self):
        return np.uint32 if self.wide else np.uint16


INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class ShardWriter:
    """Writes a shard beside its final name and moves it there when whole, so a retried task replaces it."""

    def __init__(self, folder: str, shard: int, layout: Layout):
        self.files, base = fs.FileSystem.from_uri(folder)
        self.files.create_dir(base, recursive=True)
        self.names = [f"{base}/{kind}-{shard:06d}.arrow" for kind in ("tokens", "index")]
        mark = uuid.uuid4().hex
        self.drafts = [f"{name}.{mark}" for name in self.names]
        self.sinks = [self.files.open_output_stream(draft) for draft in self.drafts]
        self.layout = layout
        self.tokens = pa.ipc.new_file(self.sinks[0], layout.schema)
        self.index = pa.ipc.new_file(self.sinks[1], INDEX)
        self.rest = np.zeros(0, layout.dtype)
        self.n_tokens = self.n_docs = 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        starts = self.n_tokens + np.cumsum(counts) - counts
        self.index.write(pa.record_batch([doc_ids, pa.array(starts), pa.array(counts)], schema=INDEX))
        self.n_tokens += len(ids)
        self.n_docs += len(counts)
        if len(ids) and ids.max() > np.iinfo(self.layout.dtype).max:
            raise OverflowError(f"id {ids.max()} needs a wide layout")
        ids = np.concatenate((self.rest, ids.astype(self.layout.dtype)))
        full = self.layout.length * BATCH_ROWS
        end = len(ids) // full * full
        for at in range(0, end, full):
            self._rows(ids[at : at + full])
        self.rest = ids[end:]

    def _rows(self, ids: np.ndarray) -> None:
        length = self.layout.length
        rows = -(-len(ids) // length)
        padded = np.zeros(rows * length, self.layout.dtype)
        padded[: len(ids)] = ids
        mask = np.arange(rows * length) < len(ids)
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), length) for x in (padded, mask)]
        self.tokens.write(pa.record_batch(columns, schema=self.layout.schema))

    def close(self) -> None:
        if len(self.rest):
            self._rows(self.rest)
        for part in (self.tokens, self.index, *self.sinks):
            part.close()
        for draft, name in zip(self.drafts, self.names):
            if self.files.get_file_info(name).type != fs.FileType.NotFound:
                self.files.delete_file(name)
            self.files.move(draft, name)


class Shard:
    """Views into a shard's files."""

    def __init__(self, folder: str, shard: int):
        files, base = fs.FileSystem.from_uri(folder)
        names = [f"{base}/{kind}-{shard:06d}.arrow" for kind in ("tokens", "index")]
        mapped = pa.memory_map if isinstance(files, fs.LocalFileSystem) else files.open_input_file
        self.tokens, self.index = (pa.ipc.open_file(mapped(name)) for name in names)
        self.length = self.tokens.schema.field("ids").type.list_size
        self._held: tuple[int, np.ndarray] = (-1, np.zeros(0))

    def sequence(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of a sequence; the ids are a view."""
        batch = self.tokens.get_batch(row // BATCH_ROWS)
        ids, mask = (batch.column(i)[row % BATCH_ROWS].values for i in (0, 1))
        return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)

    def _ids(self, batch: int) -> np.ndarray:
        """All ids of a batch; the last batch is kept, as spans one after another lie in it."""
        if self._held[0] != batch:
            self._held = batch, self.tokens.get_batch(batch).column(0).flatten().to_numpy()
        return self._held[1]

    def span(self, start: int, count: int) -> np.ndarray:
        """Ids start .. start + count - 1 of the shard, as uint32."""
        full, parts = self.length * BATCH_ROWS, []
        while count:
            ids = self._ids(start // full)
            part = ids[start % full : start % full + count]
            parts.append(part)
            start, count = start + len(part), count - len(part)
        return np.concatenate(parts).astype("<u4") if parts else np.zeros(0, "<u4")


def write(docs: DataFrame, vocabulary: str, end_id: int, layout: Layout = Layout(), lowered: bool = True) -> DataFrame:
    """Writes the shards into the shared folder; their list: shard, folder, n_docs, n_tokens, start."""
    spark = docs.sparkSession
    folder = fresh_path(spark, "token-files")
    layout = layout.for_ids(max(end_id, *Tokenizer.from_file(vocabulary).get_vocab().values()))

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer = encoder_of(LibraryEncoder, vocabulary, lowered), None
        number = TaskContext.get().partitionId()
        for block in text_slices(batches, BLOCK_BYTES):
            writer = writer or ShardWriter(folder, number, layout)
            writer.add(block.column(0), *with_end(*encode(encoder, block.column(1)), end_id))
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pylist(
                [{"shard": number, "folder": folder, "n_docs": writer.n_docs, "n_tokens": writer.n_tokens}]
            )

    ranged = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"), F.rand(SEED).alias("deal"))
        .repartitionByRange(2 * partitions(spark), "doc_id", "hash", "deal")
        .sortWithinPartitions("doc_id", "hash", "text")
        .select("doc_id", "text")
    )
    # One row a shard: the running total below is over as many rows as there are files.
    shards = settled(ranged.mapInArrow(shard, "shard long, folder string, n_docs long, n_tokens long"), "shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read(shards: DataFrame) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens, ids (four bytes each)."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["folder"], row["shard"])
                for i in range(shard.index.num_record_batches):
                    part = shard.index.get_batch(i)
                    starts, counts = (part.column(c).to_numpy() for c in (1, 2))
                    ids = [shard.span(int(s), int(n)).tobytes() for s, n in zip(starts, counts)]
                    yield pa.record_batch(
                        [part.column(0), pa.array(starts + row["start"]), part.column(2), pa.array(ids, pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )

    spark = shards.sparkSession
    dealt = shards.select("shard", "folder", "start").repartition(2 * partitions(spark))
    return dealt.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids binary")
