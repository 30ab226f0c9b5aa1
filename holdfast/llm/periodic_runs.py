"""Periodic runs of words, found in overlapping tiles by octave of the period.

A run is a stretch of words with smallest period q that no neighbouring word extends, at
least max(``LEAST``, 2 q) words long; in other terms a longest interval of places i whose
words i and i + q are equal, at least max(q, LEAST - q) places long. Periods 2^k .. 2^(k+1) - 1
are octave k. An octave has a boundary every two blocks of ``block(k)`` words, and each of its
intervals that a boundary lies in holds the block before or the one behind the boundary.
Boundaries whose blocks recur nowhere at a distance of the octave therefore have no run;
hashes of the blocks find them out.

The others are dealt in tiles, with as many words on both sides as a boundary looks at, and
shuffled, so that a very long text is solved by many tasks. At a boundary c the Z-functions
of the words behind it and, backwards, of those before it tell for every period how far the
words stay equal to each side, up to ``reach(k)``. Fragments of one document and period then
meet in a shuffle, and touching ones are stitched together. Periods that are multiples of a
smaller one are dropped at the boundary: any fragment holds two periods, so each boundary
decides alike.

Defined results: a null text has no words, no runs and is collapsed to an empty text; a row
without an id and repeated rows have results of their own; other columns are not read;
an empty table gives no rows. No text is too long: what a task holds is one text and its
hashes, then a tile at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from holdfast.llm.tables import partitions, settled, text_slices
from holdfast.llm.words import word_codes

LEAST = 12
BLOCK_BYTES = 4 << 20
# Boundaries of one tile lie within so many words, or four strides if that is more.
TILE_WORDS = 4096
TILE_ROWS = 64
# Elements that the Z-function compares at once.
STEP = 32
TILES = "doc long, octave int, boundaries binary, codes binary"
RUNS = "array<struct<start:long,period:long,length:long>>"
FRAGMENTS = "doc long, period long, first long, behind long"


def block(octave: int) -> int:
    """Half the length of the shortest interval of the octave, or less."""
    return max(LEAST // 4, 1 << max(0, octave - 1))


def stride(octave: int) -> int:
    """Words between boundaries."""
    return 2 * block(octave)


def reach(octave: int) -> int:
    """How far a boundary looks to each side; no less than the shortest interval of any of its periods."""
    return max(LEAST, 2 << octave)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def block_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all stretches of ``size`` words, from those of halves."""
    if size == 1:
        return hashes
    half = size // 2
    first = block_hashes(hashes, half)
    second = first if size == 2 * half else block_hashes(hashes, size - half)
    count = len(hashes) - size + 1
    return _mixed(first[:count]) + second[half : half + count]


class Recurrence:
    """Where the blocks of one size of a text recur; ``none`` if no block does at all."""

    def __init__(self, blocks: np.ndarray):
        order = np.argsort(blocks, kind="stable")
        ordered = blocks[order]
        new = np.ones(len(order), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        self.none = bool(new.all())
        self.kind = np.empty(len(order), np.int64)
        self.kind[order] = np.cumsum(new)
        self.span = 4 * len(order) + 64
        self.keys = self.kind[order] * self.span + order

    def at(self, places: np.ndarray, octave: int) -> np.ndarray:
        """Whether there is a block at the place that recurs at a distance of the octave."""
        held = np.clip(places, 0, len(self.kind) - 1)
        least = self.kind[held] * self.span + held + (1 << octave)
        next_ = self.keys[np.minimum(np.searchsorted(self.keys, least), len(self.keys) - 1)]
        return (held == places) & (next_ >= least) & (next_ < least + (1 << octave))


def one_word(hashes: np.ndarray, boundaries: np.ndarray, octave: int) -> np.ndarray:
    """Whether all that a boundary looks at is one word: no period of a higher octave is the smallest there."""
    changes = np.concatenate(([0], np.cumsum(hashes[1:] != hashes[:-1])))
    first = np.maximum(boundaries - reach(octave), 0)
    last = np.minimum(boundaries + reach(octave) + (2 << octave), len(hashes)) - 1
    return changes[first] == changes[last]


def candidates(hashes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(octave, boundaries) of a text that may lie in a run."""
    octave, known = 0, 0
    while 2 << octave <= max(2, len(hashes)) and block(octave) <= len(hashes):
        if block(octave) != known:
            known = block(octave)
            recurrence = Recurrence(block_hashes(hashes, known))
            if recurrence.none:
                return  # longer blocks recur no more
        boundaries = np.arange(0, len(hashes), stride(octave))
        boundaries = boundaries[recurrence.at(boundaries, octave) | recurrence.at(boundaries - known, octave)]
        if octave and len(boundaries):
            boundaries = boundaries[~one_word(hashes, boundaries, octave)]
        if len(boundaries):
            yield octave, boundaries
        octave += 1


def tiles(codes: np.ndarray, found: list[tuple[int, np.ndarray]], tile_words: int = TILE_WORDS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(octave, boundaries, codes) of a text's tiles; boundaries are preceded by the tile's first place."""
    for octave, boundaries in found:
        number = boundaries // max(tile_words, 4 * stride(octave))
        for own in np.split(boundaries, np.flatnonzero(np.diff(number)) + 1):
            begin = max(0, int(own[0]) - reach(octave))
            end = int(own[-1]) + reach(octave) + (2 << octave)
            yield octave, np.concatenate(([begin], own)), codes[begin:end]


def z_function(s: list[int], end: int) -> dict[int, int]:
    """For each place from 1 to ``end`` how many elements from there on equal the first ones, if any do."""
    z: dict[int, int] = {}
    n, end, left, right, i = len(s), min(end, len(s)), 0, 0, 0
    while i + 1 < end:
        try:
            i = s.index(s[0], i + 1, end)
        except ValueError:
            break
        k = min(z.get(i - left, 0), right - i) if i < right else 1
        if i + k >= right:
            while k < n - i and s[k : k + STEP] == s[i + k : i + k + STEP]:
                k += STEP
            while i + k < n and s[k] == s[i + k]:
                k += 1
            k = min(k, n - i)
            left, right = i, i + k
        z[i] = k
    return z


def at_boundary(words: list[int], c: int, octave: int) -> Iterator[tuple[int, int, int]]:
    """(period, first, behind) of the equal interval at c of each period of the octave that is long enough and no multiple."""
    far, low, high = reach(octave), 1 << octave, 2 << octave
    ahead = z_function(words[c : c + far + high], high) if c < len(words) else {}
    back = words[max(0, c - far) : c][::-1]
    beyond = words[c : c + high - 1][::-1]
    # Backwards, period q stands at the q-th place before the end of ``beyond``.
    zero = len(back) + 1 + len(beyond)
    behind = z_function([*back, -1, *beyond, *back], zero - low + 1) if back else {}
    divisors = [d for d, equal in ahead.items() if equal >= d]
    for q in {q for q in ahead if q >= low} | {zero - i for i in behind if len(back) < i <= zero - low}:
        left, right = min(behind.get(zero - q, 0), far), min(ahead.get(q, 0), far)
        if left + right >= max(q, LEAST - q) and not any(q % d == 0 and ahead[d] >= q - d for d in divisors if d < q):
            yield q, c - left, c + right


def stitched(fragments: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Touching fragments of a period made one."""
    whole: list[tuple[int, int, int]] = []
    for period, first, behind in sorted(fragments):
        if whole and whole[-1][0] == period and first <= whole[-1][2]:
            whole[-1] = (period, whole[-1][1], max(behind, whole[-1][2]))
        else:
            whole.append((period, first, behind))
    return whole


def _texts(block: pa.RecordBatch) -> Iterator[tuple[int, list[str], np.ndarray, np.ndarray]]:
    """Row, the block's distinct words, and the codes and hashes of the row's words."""
    words, codes, bounds = word_codes(block.column(block.schema.get_field_index("text")))
    empty = words.index("") if "" in words else -1  # from white space around a text
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    for row, (begin, end) in enumerate(zip(bounds[:-1], bounds[1:])):
        own = codes[begin:end]
        own = own[own != empty]
        yield row, words, own, hashes[own]


def _without_candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in text_slices(batches, BLOCK_BYTES):
        rows, texts = [], []
        for row, words, codes, hashes in _texts(block):
            if next(candidates(hashes), None) is None:
                rows.append(row)
                texts.append(" ".join([words[i] for i in codes]))
        yield pa.record_batch([block.column(0).take(pa.array(rows, pa.int64())), pa.array(texts, pa.string())], names=["doc_id", "collapsed"])


def _with_candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in text_slices(batches, BLOCK_BYTES):
        yield block.take(pa.array([row for row, _, _, hashes in _texts(block) if next(candidates(hashes), None)], pa.int64()))


def dealt(tile_words: int):
    """For mapInArrow over (doc, text): the texts' tiles."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_slices(batches, BLOCK_BYTES):
            rows: list[tuple] = []
            for row, _, codes, hashes in _texts(block):
                for octave, boundaries, own in tiles(codes.astype("<i4"), list(candidates(hashes)), tile_words):
                    rows.append((block.column(0)[row].as_py(), octave, boundaries.astype("<i8").tobytes(), own.tobytes()))
                    if len(rows) == TILE_ROWS:
                        yield _batch(rows)
                        rows = []
            yield _batch(rows)

    return cut


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
    return pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["doc", "octave", "boundaries", "codes"])


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for doc, octave, places, codes in zip(*(column.to_pylist() for column in batch.columns)):
            begin, *boundaries = np.frombuffer(places, "<i8").tolist()
            words = np.frombuffer(codes, "<i4").tolist()
            parts = [part for c in boundaries for part in at_boundary(words, c - begin, octave)]
            found += [(doc, period, first + begin, behind + begin) for period, first, behind in stitched(parts)]
        yield pa.record_batch([pa.array([f[i] for f in found], pa.int64()) for i in range(4)], names=["doc", "period", "first", "behind"])


def _collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in text_slices(batches, BLOCK_BYTES):
        runs, texts = block.column(2), []
        for row, words, codes, _ in _texts(block):
            kept = np.ones(len(codes), bool)
            for run in runs[row].as_py() or ():
                kept[run["start"] + run["period"] : run["start"] + run["length"]] = False
            texts.append(" ".join([words[i] for i in codes[kept]]))
        yield pa.record_batch([block.column(0), runs, pa.array(texts, pa.string())], names=["doc_id", "runs", "collapsed"])


def intervals(fragments: DataFrame) -> DataFrame:
    """doc, start, period, length of the runs that the fragments of each document and period make up."""
    order = Window.partitionBy("doc", "period").orderBy("first", "behind")
    reached = F.max("behind").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce((F.col("first") > reached).cast("int"), F.lit(1))
    numbered = fragments.withColumn("_opens", opens).withColumn("_island", F.sum("_opens").over(order))
    whole = numbered.groupBy("doc", "period", "_island").agg(F.min("first").alias("start"), F.max("behind").alias("behind"))
    return whole.select("doc", "start", "period", (F.col("behind") + F.col("period") - F.col("start")).alias("length"))


def collapsed(docs: DataFrame, tile_words: int = TILE_WORDS) -> DataFrame:
    """doc_id, runs (start, period, length; in this order) and the text's words without the repetitions of runs,
    joined by one space, of each row of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    plain = rows.mapInArrow(_without_candidates, "doc_id long, collapsed string")
    plain = plain.select("doc_id", F.array().cast(RUNS).alias("runs"), "collapsed")
    held = settled(rows.mapInArrow(_with_candidates, "doc_id long, text string").withColumn("doc", F.monotonically_increasing_id()), "run-texts")
    cut = held.select("doc", "text").mapInArrow(dealt(tile_words), TILES)
    runs = intervals(cut.repartition(partitions(docs.sparkSession), F.xxhash64("doc", "octave", "boundaries")).mapInArrow(_solved, FRAGMENTS))
    listed = runs.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    met = held.join(listed, "doc", "left").select("doc_id", "text", F.coalesce("runs", F.array().cast(RUNS)).alias("runs"))
    return plain.unionByName(met.mapInArrow(_collapsed, f"doc_id long, runs {RUNS}, collapsed string"))
