"""MinHash near-duplicates: many universal hash minima, banding, signature verification, star contraction.

Documents with equal shingle sets are one class. A class has ``Plan.bands`` x ``Plan.rows``
minima of multiply-add hashes of its shingles; bands of rows equal minima put it into
buckets. Pairs come from buckets in three rounds, and never all pairs of one:

1. Every class meets the most typical member (the one that shares most buckets) of its
   largest bucket: one pair a class.
2. Members that are not connected with their bucket's most typical member meet that one.
3. Members that are not connected by then meet in blocks of ``BLOCK``; blocks of one
   component never meet, and pairs whose signatures differ too much stay in the task that
   compares them. Members of one component are left out, as further links can't change it.

Pairs of each round are compared by size, by the share of equal minima, with a margin of
more than six deviations below the limit, and by the odd ones of ``PARITIES`` groups of
shingles, as two sets differ in at least as many shingles as in these; the full sets decide
on the rest. Components
are found by alternating large-star and small-star steps, whose edges are written to the
shared folder each time.

A pair at a similarity of 0.8 shares no band of the 32 x 4 minima once in 20 million times,
and passes the margin but for once in a billion; more similar pairs do so ever more rarely.

Defined results: a null text, or one without words, has no shingles and no links; equal rows
and equal sets are one class; rows that share an id share its component; a row without
doc_id keeps its count, has no component and is kept; other columns are not read; an empty
table gives no rows. Shingles are compared by 64-bit hashes of 64-bit word hashes. No text is
too long: a task holds one text with its set.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.shingle_join import shingle_sets
from holdfast.llm.tables import settled, text_slices

BLOCK_BYTES = 4 << 20
BLOCK = 64
# Shingles hashed at a time, to stay in a core's cache.
STRETCH = 1 << 15
PARITIES = 1024


@dataclass(frozen=True)
class Plan:
    """Shingles of so many words; similar from so many percent on; bands of so many minima; equal minima asked for."""

    words: int = 2
    percent: int = 80
    bands: int = 32
    rows: int = 4
    least_equal: int = 72

    def minima(self) -> int:
        return self.bands * self.rows


def universal_hashes(count: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and shifts of h(x) = (a x + b) mod 2^64, of which the upper 32 bits count."""
    draw = np.random.default_rng(seed).integers(0, 1 << 64, (2, count), dtype=np.uint64)
    return draw[0] | np.uint64(1), draw[1]


def minima_of(shingles: np.ndarray, counts: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """For each text (none empty) and hash the least value over its shingles."""
    ends = np.cumsum(counts)
    least = np.full((len(counts), len(factors)), np.iinfo(np.uint32).max, np.uint32)
    for begin in range(0, len(shingles), STRETCH):
        part = shingles[begin : begin + STRETCH]
        first = int(np.searchsorted(ends, begin, side="right"))
        last = int(np.searchsorted(ends, begin + len(part) - 1, side="right"))
        starts = np.maximum(np.concatenate(([0], ends))[first : last + 1] - begin, 0)
        own = least[first : last + 1]
        for i, (factor, shift) in enumerate(zip(factors, shifts)):
            values = ((part * factor + shift) >> np.uint64(32)).astype(np.uint32)
            own[:, i] = np.minimum(own[:, i], np.minimum.reduceat(values, starts))
    return least


def parities_of(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each text ``PARITIES`` bits: of which groups of shingles it has an odd number."""
    owner = np.repeat(np.arange(len(counts)), counts)
    groups = (shingles & np.uint64(PARITIES - 1)).astype(np.int64)
    odd = np.bincount(owner * PARITIES + groups, minlength=PARITIES * len(counts)).astype(np.uint8) & 1
    return np.packbits(odd.reshape(len(counts), PARITIES), axis=1)


def alike_enough(plan: Plan, n: np.ndarray, other_n: np.ndarray, sketches: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes and sketches (minima, then parities) may be similar enough, row by row."""
    near = 100 * np.minimum(n, other_n) >= plan.percent * np.maximum(n, other_n)
    cut = 2 * plan.minima()
    near &= np.count_nonzero(sketches[:, :cut].view("<u2") == others[:, :cut].view("<u2"), axis=1) >= plan.least_equal
    differing = np.bitwise_count(sketches[:, cut:] ^ others[:, cut:]).sum(axis=1, dtype=np.int64)
    return near & ((100 + plan.percent) * differing <= (100 - plan.percent) * (n + other_n))


def rows_of(sketches: list[bytes], plan: Plan) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), np.uint8).reshape(-1, 2 * plan.minima() + PARITIES // 8)


def band_hashes(least: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit hash of each band's minima, of the band's number too."""
    cut = least.reshape(len(least), bands, -1).astype(np.uint64)
    mixed = np.full((len(least), bands), 0x9E3779B97F4A7C15, np.uint64) * np.arange(1, bands + 1, dtype=np.uint64)
    for row in range(cut.shape[2]):
        mixed = (mixed ^ cut[:, :, row]) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
    return mixed


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))


def signatures(docs: DataFrame, plan: Plan) -> DataFrame:
    """doc_id, n, key (of the set), sketch (16 bits of each minimum, parities) and buckets of each row; the last two null without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, shifts = universal_hashes(plan.minima())
        for block in text_slices(batches, BLOCK_BYTES):
            shingles, counts = shingle_sets(block.column(1), plan.words)
            ends = np.cumsum(counts)
            data = memoryview(shingles.view(np.uint8))
            keys = [xxhash.xxh3_128_digest(data[8 * (e - n) : 8 * e]) if n else None for e, n in zip(ends, counts)]
            full = np.flatnonzero(counts)
            least = minima_of(shingles, counts[full], factors, shifts)
            place = np.full(len(counts), -1)
            place[full] = np.arange(len(full))
            at = pa.array(place, mask=place < 0)
            sketches = np.concatenate((least.astype("<u2").view(np.uint8), parities_of(shingles, counts[full])), axis=1)
            short = pa.array([x.tobytes() for x in sketches], pa.binary()).take(at)
            buckets = _lists(band_hashes(least, plan.bands).ravel(), np.full(len(full), plan.bands)).take(at)
            yield pa.record_batch([block.column(0), pa.array(counts), pa.array(keys, pa.binary()), short, buckets], names=["doc_id", "n", "key", "sketch", "buckets"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return settled(rows.mapInArrow(run, "doc_id long, n long, key binary, sketch binary, buckets array<long>"), "signatures")


def full_sets(docs: DataFrame, plan: Plan) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_slices(batches, BLOCK_BYTES):
            yield pa.record_batch([block.column(0), _lists(*shingle_sets(block.column(1), plan.words))], names=["id", "shingles"])

    return docs.mapInArrow(run, "id long, shingles array<long>")


def alike(pairs: DataFrame, known: DataFrame, plan: Plan) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches (id, n, sketch) may be similar enough."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, other_n = (batch.column(i).to_numpy() for i in (2, 3))
            sketches, others = (rows_of(batch.column(i).to_pylist(), plan) for i in (4, 5))
            yield batch.select(["a", "b"]).filter(pa.array(alike_enough(plan, n, other_n, sketches, others)))

    a = known.select(F.col("id").alias("a"), F.col("n").alias("a_n"), F.col("sketch").alias("a_sketch"))
    b = known.select(F.col("id").alias("b"), F.col("n").alias("b_n"), F.col("sketch").alias("b_sketch"))
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "a_n", "b_n", "a_sketch", "b_sketch")
    return both.mapInArrow(compare, "a long, b long")


def linked(pairs: DataFrame, sets: DataFrame, plan: Plan) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    a = sets.select(F.col("id").alias("a"), F.col("shingles").alias("a_set"))
    b = sets.select(F.col("id").alias("b"), F.col("shingles").alias("b_set"))
    shared = F.size(F.array_intersect("a_set", "b_set")).cast("long")
    whole = F.size("a_set") + F.size("b_set") - shared
    return pairs.join(b, "b").join(a, "a").where(100 * shared >= plan.percent * whole).select("a", "b")


def star_components(links: DataFrame) -> DataFrame:
    """id and component (the smallest id reachable) of every id in the links (a, b).

    A large-star step links every larger neighbour of an id to its least neighbour, a
    small-star step the id and its smaller neighbours; alternating, they leave each
    component a star around its smallest id. Neighbourhoods only fold to minima, so that
    one of any size is spread over tasks.
    """

    def least(edges: DataFrame) -> DataFrame:
        return edges.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))

    def large_star(edges: DataFrame) -> DataFrame:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        larger = both.where("v > u").join(least(both), "u")
        return larger.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()

    def small_star(edges: DataFrame) -> DataFrame:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        minima = least(down)
        moved = down.join(minima, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.union(minima.select("u", F.col("m").alias("v"))).where("u != v").distinct()

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = settled(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    before = state(edges)
    while True:
        edges = settled(small_star(settled(large_star(edges), "large-star")), "small-star")
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


def centres_of(members: DataFrame) -> DataFrame:
    """bucket, centre: its most typical member."""
    weights = members.groupBy("id").agg(F.sum("size").alias("weight"))
    placed = members.select("bucket", "id").join(weights, "id")
    return placed.groupBy("bucket").agg(F.max_by("id", F.struct("weight", -F.col("id"))).alias("centre"))


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()


def first_round(met: DataFrame) -> DataFrame:
    """(a, b): each member (id, centre, size) beside the centre of its largest bucket."""
    return ordered(met.where("id != centre").groupBy("id").agg(F.max_by("centre", F.struct("size", "centre")).alias("centre")))


def second_round(met: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b): each member beside the centres of its buckets that it is not connected with."""
    of_centre = labels.select(F.col("id").alias("centre"), F.col("component").alias("other"))
    named = met.where("id != centre").select("id", "centre").distinct().join(labels, "id", "left").join(of_centre, "centre", "left")
    return ordered(named.where(F.coalesce("component", "id") != F.coalesce("other", "centre")))


def third_round(members: DataFrame, labels: DataFrame, known: DataFrame, plan: Plan) -> DataFrame:
    """(a, b): pairs of members in different components, block by block, whose sketches may be similar enough.

    A component with ``BLOCK`` members of a bucket or more has blocks of its own, which never meet.
    """
    named = members.join(labels, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("component"))
    parts = named.groupBy("bucket", "component").agg(F.count("*").alias("own"))
    large = F.col("own") >= BLOCK
    sizes = parts.groupBy("bucket").agg(F.count("*").alias("parts"), F.sum(F.when(~large, F.col("own")).otherwise(0)).alias("loose"))
    mixed = parts.join(sizes.where("parts > 1"), "bucket").select(
        "bucket", "component", F.when(large, F.col("component")).alias("whole"), F.when(large, F.col("own")).otherwise(F.col("loose")).alias("sharing")
    )
    block = F.pmod(F.xxhash64("id"), F.ceil(F.col("sharing") / BLOCK)).cast("int")
    salted = named.join(mixed, ["bucket", "component"]).select("bucket", "whole", block.alias("block"), "id", "component")
    listed = settled(
        salted.join(known, "id")
        .groupBy("bucket", "whole", "block")
        .agg(F.collect_list(F.struct("id", "component", "n", "sketch")).alias("docs")),
        "bucket-blocks",
    )
    # Only the places of blocks meet by bucket; their documents come to each pair of blocks afterwards.
    places = listed.select("bucket", F.struct("whole", "block").alias("x"))
    met = places.join(places.withColumnRenamed("x", "y"), "bucket").where("x <= y AND NOT (x != y AND x.whole <=> y.whole AND x.whole IS NOT NULL)")
    met = met.where("x != y OR x.whole IS NULL")

    def held(side: str) -> DataFrame:
        return listed.select("bucket", F.struct("whole", "block").alias(side), F.col("docs").alias(f"{side}_docs"))

    both = met.join(held("x"), ["bucket", "x"]).join(held("y"), ["bucket", "y"]).select("x_docs", "y_docs")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for row in range(batch.num_rows):
                sides = []
                for column in batch.columns:
                    docs = column[row].values
                    fields = [docs.field(i) for i in range(4)]
                    sides.append((*(f.to_numpy(zero_copy_only=False) for f in fields[:3]), rows_of(fields[3].to_pylist(), plan)))
                (ids, groups, n, sketches), (other_ids, other_groups, other_n, others) = sides
                for i in range(len(ids)):
                    at = np.flatnonzero((other_groups != groups[i]) & (other_ids != ids[i]))
                    at = at[alike_enough(plan, n[i], other_n[at], sketches[i : i + 1], others[at])]
                    found.append((np.minimum(ids[i], other_ids[at]), np.maximum(ids[i], other_ids[at])))
            a, b = (np.concatenate([f[side] for f in found]) if found else np.zeros(0, np.int64) for side in (0, 1))
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return both.mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable by links), kept, of every row."""
    found = signatures(docs, plan)
    classes = found.where("doc_id IS NOT NULL AND n > 0").groupBy("key").agg(F.min_by(F.struct("doc_id", "n", "sketch", "buckets"), "doc_id").alias("first"))
    rows = classes.select(F.col("first.doc_id").alias("id"), F.explode("first.buckets").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = settled(rows.join(shared, "bucket"), "shared-buckets")
    in_buckets = members.select("id").distinct()
    known = settled(
        classes.select(F.col("first.doc_id").alias("id"), "first.n", "first.sketch").join(in_buckets, "id", "left_semi"), "known"
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(in_buckets.hint("merge"), "id", "left_semi")
    sets = settled(full_sets(texts, plan), "sets")
    met = settled(members.join(centres_of(members), "bucket").select("id", "centre", "size"), "centres")
    links = settled(linked(alike(first_round(met), known, plan), sets, plan), "links")
    labels = star_components(links)
    for pairs in (
        lambda: alike(second_round(met, labels), known, plan),
        lambda: third_round(members, labels, known, plan),
    ):
        later = settled(linked(settled(pairs(), "later-pairs"), sets, plan), "later-links")
        if not later.isEmpty():
            # The components found so far stand for all links before.
            links = labels.select(F.col("id").alias("a"), F.col("component").alias("b")).union(later)
            labels = star_components(links)
    of_class = classes.select("key", F.col("first.doc_id").alias("_first"))
    named = of_class.join(labels, F.col("_first") == F.col("id"), "left").select(
        F.col("key").alias("_key"), F.coalesce("component", "_first").alias("_component")
    )
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id"))
    joined = found.join(named, F.col("key") == F.col("_key"), "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return joined.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
