"""Nearest neighbours by inner product along shifted Hilbert curves.

Vectors are scaled by the largest norm and get one more component, so that the largest
inner product is the smallest distance. Every curve projects them to a few random
directions, shifts the grid and sorts by Hilbert key; Spark range-partitions the keys and
numbers them along each curve. A curve is cut into blocks of as many places as a window
reaches to either side; a query meets its own block and those beside it, in one matrix
product a block. Candidates that a rounding error could place among the best of a block are
scored in one fixed order of summation before any is left out, so scores and ties don't
depend on the block. Equal vectors are one class, with as many of its smallest ids as can be among
the nearest.

The directions' ranges come from at most ``SAMPLE_ROWS`` vectors, chosen by a hash of the
id; all vectors are indexed. ``WINDOW`` is a share of all rows because the given vectors
fill their 64 dimensions almost evenly: ``tests/llm`` measures a recall above 0.9.

Defined results: vectors that are null, zero, or hold null or non-finite components take
no part; neither do rows without an id, and vectors of another length than most distinct
ones (of two lengths as frequent: the shorter); rows of equal id and vector count once; equal
scores go to the smaller id; a query without candidates has no rows; other columns are not
read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from holdfast.llm.tables import partitions, settled

CURVES = 28
DIMENSIONS = 6
BITS = 10
WINDOW = 0.0125
LEAST_WINDOW = 48
MOST_BLOCK = 4096
SAMPLE_ROWS = 4096
SALTS = 64
QUERIES_AT_ONCE = 256
PAIRS_AT_ONCE = 1 << 15
SEED = 11


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of integer points (rows), by Skilling's transposition."""
    x = cells.astype(np.uint64).T.copy()
    n, one = len(x), np.uint64(1)
    for level in range(bits - 1, 0, -1):
        q = np.uint64(1 << level)
        p = q - one
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        q = np.uint64(1 << level)
        turn ^= np.where((x[n - 1] & q) != 0, q - one, np.uint64(0))
    x ^= turn
    keys = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            keys = keys << one | (x[i] >> np.uint64(bit)) & one
    return keys.astype(np.int64)


@dataclass
class Curves:
    directions: np.ndarray  # curve, component, direction
    low: np.ndarray  # curve, direction
    high: np.ndarray

    def keys(self, points: np.ndarray, curve: int) -> np.ndarray:
        y = (points @ self.directions[curve] - self.low[curve]) / (self.high[curve] - self.low[curve])
        return hilbert_keys((np.clip(y, 0, 1) * ((1 << BITS) - 1)).astype(np.int64))


def curves_for(sample: np.ndarray) -> Curves:
    """Random directions; the grid of each curve is wider than the sample and shifted by chance."""
    random = np.random.default_rng(SEED)
    size = sample.shape[1]
    count = min(DIMENSIONS, size)
    directions = np.stack([np.linalg.qr(random.normal(size=(size, size)))[0][:, :count] for _ in range(CURVES)])
    projected = np.einsum("ri,cij->crj", sample, directions)
    low, high = projected.min(axis=1), projected.max(axis=1)
    width = np.maximum(high - low, 1e-9)
    shift = random.uniform(-0.1, 0.1, size=low.shape)
    return Curves(directions, low - (0.1 + shift) * width, high + (0.1 - shift) * width)


def classes(vectors: DataFrame, k: int, every: int) -> DataFrame:
    """id (the smallest), vector, ids (the k + 1 smallest) and asks (an id is divisible by ``every``) of distinct vectors."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(
        F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)
    )
    # Ids of a frequent vector are cut to the smallest in salted groups before they meet.
    salted = usable.distinct().groupBy("embedding", F.pmod("vec_id", F.lit(SALTS)).alias("salt")).agg(
        F.slice(F.array_sort(F.collect_list("vec_id")), 1, k + 1).alias("ids"),
        F.max(F.col("vec_id") % every == 0).alias("asks"),
    )
    return salted.groupBy("embedding").agg(
        F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"),
        F.max("asks").alias("asks"),
    ).select(F.element_at("ids", 1).alias("id"), F.col("embedding").alias("vector"), "ids", "asks")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def places(found: DataFrame, curves: Curves, norm: float) -> DataFrame:
    """curve, place, id, asks: the order of data points and query points along each curve."""
    sent = found.sparkSession.sparkContext.broadcast(curves)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            lengths = np.linalg.norm(x, axis=1)
            data = np.column_stack((x / norm, np.sqrt(np.maximum(0, 1 - (lengths / norm) ** 2))))
            asking = np.flatnonzero(batch.column(2).to_numpy(zero_copy_only=False))
            asked = np.column_stack((x[asking] / lengths[asking, None], np.zeros(len(asking))))
            points, rows = np.concatenate((data, asked)), np.concatenate((np.arange(len(x)), asking))
            asks = pa.array(np.arange(len(points)) >= len(x))
            ids = batch.column(0).take(pa.array(rows))
            for curve in range(CURVES):
                number = pa.array(np.full(len(points), curve, np.int32))
                yield pa.record_batch(
                    [number, pa.array(sent.value.keys(points, curve)), ids, asks], names=["curve", "key", "id", "asks"]
                )

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for batch in batches:
            curve = batch.column(0).to_numpy()
            begins = np.flatnonzero(np.r_[True, curve[1:] != curve[:-1]]) if len(curve) else []
            place = np.empty(len(curve), np.int64)
            for begin, end in zip(begins, [*begins[1:], len(curve)]):
                c = int(curve[begin])
                place[begin:end] = seen.get(c, 0) + np.arange(end - begin)
                seen[c] = seen.get(c, 0) + end - begin
            yield pa.record_batch(
                [batch.column(0), pa.array(np.full(len(curve), part, np.int32)), pa.array(place), batch.column(2), batch.column(3)],
                names=["curve", "part", "own", "id", "asks"],
            )

    keyed = found.select("id", "vector", "asks").mapInArrow(run, "curve int, key long, id long, asks boolean")
    # Range bounds are sampled from the input: written first, the keys are computed once.
    ordered = (
        settled(keyed, "curve-keys")
        .repartitionByRange(2 * partitions(found.sparkSession), "curve", "key", "id", "asks")
        .sortWithinPartitions("curve", "key", "id", "asks")
    )
    numbered = settled(ordered.mapInArrow(number, "curve int, part int, own long, id long, asks boolean"), "curve-places")
    before = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = numbered.groupBy("curve", "part").agg(F.count("*").alias("n")).withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return numbered.join(shifts.drop("n"), ["curve", "part"]).select("curve", (F.col("shift") + F.col("own")).alias("place"), "id", "asks")


def in_order(left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows a of ``left`` with the rows b of ``right``, terms added one after another."""
    found = np.zeros(len(a))
    for at in range(0, len(a), PAIRS_AT_ONCE):
        part = slice(at, at + PAIRS_AT_ONCE)
        found[part] += np.cumsum(left[a[part]] * right[b[part]], axis=1)[:, -1]
    return found


def best_of_block(k: int):
    """The k best candidates of a block for each of its queries."""

    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        if not candidates.num_rows or not queries.num_rows:
            return pa.table({name: pa.array([], kind) for name, kind in (("query", pa.int64()), ("id", pa.int64()), ("score", pa.float64()))})
        asked, ids = queries["id"].to_numpy(), candidates["id"].to_numpy()
        data, rows = _matrix(candidates["vector"]), []
        vectors = _matrix(queries["vector"])
        # Twice the largest difference between a product and its terms added in order.
        longest = np.linalg.norm(data, axis=1).max()
        slack = 4 * data.shape[1] * np.finfo(float).eps * longest * np.linalg.norm(vectors, axis=1)
        for at in range(0, len(asked), QUERIES_AT_ONCE):
            scores = vectors[at : at + QUERIES_AT_ONCE] @ data.T
            last = max(0, len(ids) - k)
            least = np.partition(scores, last, axis=1)[:, last] - slack[at : at + QUERIES_AT_ONCE]
            query, found = np.nonzero(scores >= least[:, None])
            exact = in_order(vectors[at : at + QUERIES_AT_ONCE], data, query, found)
            order = np.lexsort((ids[found], -exact, query))
            first = np.searchsorted(query, query, side="left")  # of each query, in either order
            best = order[np.arange(len(order)) - first < k]
            rows.append((asked[at + query[best]], ids[found[best]], exact[best]))
        query, found, score = (np.concatenate(x) for x in zip(*rows))
        return pa.table({"query": query, "id": found, "score": score})

    return run


def nearest(vectors: DataFrame, k: int, every: int) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id is divisible by ``every``."""
    found = settled(classes(vectors, k, every), "vector-classes")
    size = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    widths = found.groupBy(F.size("vector").alias("width")).agg(F.count("*").alias("n"), F.max(size).alias("norm"))
    width, total, norm = widths.orderBy(F.desc("n"), "width").first() or (1, 0, None)
    found = found.where(F.size("vector") == width)
    share = min(1.0, SAMPLE_ROWS / max(1, total))
    picked = found.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share * (1 << 30)).select("vector").limit(2 * SAMPLE_ROWS).toArrow()
    sample = _matrix(picked["vector"]) if picked.num_rows else np.zeros((1, width))
    lengths = np.linalg.norm(sample, axis=1)
    norm = norm or 1.0
    curves = curves_for(np.column_stack((sample / norm, np.sqrt(np.maximum(0, 1 - (lengths / norm) ** 2)))))
    reach = max(LEAST_WINDOW, int(np.ceil(WINDOW * total)))
    block = min(MOST_BLOCK, reach)
    steps = -(-reach // block)
    placed = places(found, curves, norm).withColumn("block", F.floor(F.col("place") / block).cast("int"))
    with_vector = placed.join(found.select("id", "vector"), "id")
    data = with_vector.where("NOT asks").select("curve", "block", "id", "vector")
    asked = with_vector.where("asks").select(
        "curve", F.explode(F.array(*[F.col("block") + i for i in range(-steps, steps + 1)])).alias("block"), "id", "vector"
    ).toDF("curve", "block", "id", "vector")
    met = data.groupBy("curve", "block").cogroup(asked.groupBy("curve", "block"))
    matches = met.applyInArrow(best_of_block(k + 1), "query long, id long, score double")
    by_query = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    merged = (
        matches.groupBy("query", "id").agg(F.max("score").alias("score"))
        .withColumn("place", F.row_number().over(by_query))
        .where(F.col("place") <= k + 1)
        .select("query", "id", "score")
    )
    scored = merged.join(found.select("id", "ids"), "id").select("query", F.explode("ids").alias("vec_id"), "score")
    # Every query row of a class has the class's answer without itself.
    own = settled(scored.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k + 1).alias("best")), "answers")
    members = vectors.select(F.col("vec_id").cast("long").alias("query_id"), "embedding").where(F.col("query_id") % every == 0).distinct()
    asking = members.join(found.select(F.col("vector").alias("embedding"), F.col("id").alias("query")), "embedding").select("query_id", "query")
    answers = asking.join(own, "query").select(
        "query_id", F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k).alias("best")
    )
    return answers.select("query_id", F.posexplode("best").alias("rank", "b")).select(
        "query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score")
    )
