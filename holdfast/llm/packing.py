"""Best-two-fit packing of token sequences.

Only the number of pieces of each length matters to a packing, and there are at most
``capacity`` lengths. ``plan`` packs that histogram: a bin takes the longest pieces that
fit, then its smallest piece gives way to two unpacked ones that fill the widened gap more
tightly; as many bins as the counts allow are filled alike at once. Pieces then find their
places by their number among the pieces of their length. They are written in blocks, each
one compressed value beside its counts by length; a block's pieces are numbered from the
counts of the blocks before it. Only these counts are shuffled, no ids.

Defined results: a null text is an empty one and holds only the end id; equal documents
are packed separately; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from holdfast.llm.encoding import BLOCK_BYTES, LibraryEncoder, encode, encoder_of, with_end
from holdfast.llm.tables import block_ids, folded, partitions, settled_blocks, text_slices, unfolded

CAPACITY = 1024


def fill(counts: np.ndarray) -> dict[int, int]:
    """The lengths of one bin and how often each: longest first, then the exchange of the smallest."""
    capacity = len(counts) - 1
    left = counts.copy()
    sizes = np.arange(capacity + 1)

    def longest() -> np.ndarray:
        return np.maximum.accumulate(np.where(left > 0, sizes, 0))

    taken: dict[int, int] = {}
    gap = capacity
    while size := int(longest()[gap]):
        times = min(int(left[size]), gap // size)
        taken[size] = taken.get(size, 0) + times
        left[size] -= times
        gap -= size * times
    smallest = min(taken)
    room = gap + smallest
    if gap:
        fits = longest()
        firsts = sizes[1 : room + 1][left[1 : room + 1] > 0]
        if len(firsts):
            seconds = fits[room - firsts]
            twice = (seconds == firsts) & (left[firsts] < 2)
            # The only piece of its length can't stand twice: its partner is the next shorter one.
            seconds[twice] = fits[np.maximum(firsts[twice] - 1, 0)]
            sums = np.where(seconds > 0, firsts + seconds, 0)
            best = int(np.argmax(sums))
            if sums[best] > smallest:
                taken[smallest] -= 1
                for size in (int(firsts[best]), int(seconds[best])):
                    taken[size] = taken.get(size, 0) + 1
    return {size: times for size, times in taken.items() if times}


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first number, end number, pieces a bin, first bin, offset), by length and number."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, count in counts.items():
        left[length] = count
    used, rows, first = np.zeros_like(left), [], 0
    while left.any():
        taken = fill(left)
        bins = min(int(left[size]) // times for size, times in taken.items())
        offset = 0
        for size, times in sorted(taken.items(), reverse=True):
            rows.append((size, used[size], used[size] + bins * times, times, first, offset))
            used[size] += bins * times
            left[size] -= bins * times
            offset += size * times
        first += bins
    table = np.array(rows, dtype=np.int64).reshape(-1, 6)
    return table[np.lexsort((table[:, 1], table[:, 0]))]


def pieces(texts: pa.RecordBatch, encoder: LibraryEncoder, end_id: int, capacity: int) -> pa.RecordBatch:
    """Ids of every document with the end id, longer ones cut so that only the first piece is shorter."""
    ids, counts = with_end(*encode(encoder, texts.column(1)), end_id)
    parts = -(-counts // capacity)
    owner = np.repeat(np.arange(len(counts)), parts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    head = counts - (parts - 1) * capacity
    start = np.where(number > 0, head[owner] + (number - 1) * capacity, 0)
    length = np.where(number > 0, capacity, head[owner])
    ends = 4 * np.cumsum(length).astype(np.int64)
    offsets = pa.py_buffer(np.concatenate(([0], ends)).astype(np.int32))
    data = pa.BinaryArray.from_buffers(pa.binary(), len(owner), [None, offsets, pa.py_buffer(ids.tobytes())])
    crc = np.fromiter((zlib.crc32(value.as_buffer()) for value in data), np.int64, len(owner))
    return pa.record_batch(
        [texts.column(0).take(pa.array(owner)), *map(pa.array, (number.astype(np.int32), start, length)), data, pa.array(crc)],
        names=["doc_id", "piece", "start", "length", "ids", "ids_crc32"],
    )


def packed_documents(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = CAPACITY, ids: bool = True) -> DataFrame:
    """Blocks of pieces with their crc32 (and their ids), written once in buckets to the shared folder.

    A row is a block: its number, its pieces as one compressed value, and its counts by length from 0.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(LibraryEncoder, vocabulary, False)
        numbers = block_ids()
        for texts in text_slices(batches, BLOCK_BYTES):
            found = pieces(texts, encoder, end_id, capacity)
            counts = np.bincount(found.column("length"), minlength=capacity + 1)
            yield pa.record_batch(
                [
                    pa.array([next(numbers)], pa.int64()),
                    pa.array([folded(found if ids else found.drop_columns(["ids"]))], pa.binary()),
                    pa.ListArray.from_arrays(pa.array([0, len(counts)], pa.int32()), pa.array(counts.astype(np.int64))),
                ],
                names=["block", "rows", "counts"],
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = texts.mapInArrow(cut, "block long, rows binary, counts array<long>")
    return settled_blocks(blocks, "pieces", "block", partitions(docs.sparkSession))


def pack(blocks: DataFrame, capacity: int = CAPACITY, ids: bool = True) -> DataFrame:
    """The pieces of ``packed_documents`` with sequence_id and offset; ``ids`` as there."""
    spark = blocks.sparkSession
    counted = blocks.select(F.col("block").alias("_block"), F.posexplode("counts").alias("length", "n")).where("n > 0")
    # One count a length: at most ``capacity`` rows on the driver, and a plan that grows with them alone.
    total = {row["length"]: row["n"] for row in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = spark.sparkContext.broadcast(plan(total, capacity))
    # One narrow row a block and length meets here.
    before = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    shifted = counted.select("_block", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    shifts = shifted.groupBy("_block").agg(F.map_from_entries(F.collect_list(F.struct("length", "shift"))).alias("shifts"))
    lengths = F.sequence(F.lit(0), F.lit(capacity))
    first = F.transform(lengths, lambda x: F.coalesce(F.element_at("shifts", x), F.lit(0)))

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = places.value
        step = int(table[:, 2].max()) + 1 if len(table) else 1
        keys = table[:, 0] * step + table[:, 1]
        for batch in batches:
            for rows, shift in zip(batch.column("rows"), batch.column("first")):
                found = unfolded(rows)
                length = found.column("length").to_numpy()
                order = np.argsort(length, kind="stable")
                counts = np.bincount(length, minlength=capacity + 1)
                number = np.empty(len(length), np.int64)
                number[order] = np.arange(len(length)) - np.repeat(np.cumsum(counts) - counts, counts)
                number += shift.values.to_numpy()[length]
                row = table[np.searchsorted(keys, length * step + number, side="right") - 1]
                index = number - row[:, 1]
                sequence = row[:, 4] + index // row[:, 3]
                offset = row[:, 5] + index % row[:, 3] * length
                yield found.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    fields = f"doc_id long, piece int, start long, length long, {'ids binary, ' if ids else ''}ids_crc32 long"
    joined = blocks.select("block", "rows").join(shifts, F.col("block") == F.col("_block"))
    return joined.select("rows", first.alias("first")).mapInArrow(seat, f"{fields}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed ids: sequence_id, ids, and the lengths of its pieces in order (at most a capacity each)."""
    part = F.struct("offset", "length", "ids")
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda done, x: F.concat(done, x["ids"]))
    return parts.select("sequence_id", joined.alias("ids"), F.col("parts.length").alias("lengths"))
