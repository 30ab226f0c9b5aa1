"""Ranked lexical search: accumulators of short lists are one bounded iterator beside the long lists.

Documents are read once into posting lists of the queries' terms, a row for each block of
texts, written to the shared folder with the number of terms of each document. Counts over
all documents (documents, terms, documents of a term) are folded from these rows by Spark.

A task then takes its blocks one after another and keeps the best documents of each query
over all of them. In a block the lists of a query that hold few documents are summed term at
a time into accumulators; sorted by document they are one iterator, whose bound is the
largest sum. It and the long lists, each with its largest score as a bound, are passed
document at a time: once the best documents found so far outdo the bounds of some
iterators together, only the others propose documents, and the former are asked by skipping
forward, strongest first, until a document can't be among the best any more. The best of
all tasks meet in one ranking a query.

Queries are taken in parts of about ``PART_TERMS`` terms, which is what is broadcast and what
the driver holds; each part reads the documents once.

Defined results: a null text has no term; a document without a term counts nowhere; equal
scores go to the smaller doc_id, and repeated rows are ranked each; a row without doc_id
counts in all statistics and is never returned; terms of all rows of one item are one
query; an item without an id or a term has no rows; other columns are not read; empty
tables give no rows. No text is too long: a block is at least one whole text.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from holdfast.llm.tables import settled, text_slices

BLOCK_BYTES = 16 << 20
PART_TERMS = 1 << 19
# Lists with fewer than one in so many documents of a block are short.
SHORT = 4
# Fixed values of the score.
SCALE, SATURATION, LENGTH_SHARE = 1_000_000_000, 8, 90
POSTINGS = "doc_ids binary, sizes binary, terms array<int>, counts array<long>, docs binary, times binary"

# What a byte of a text becomes: marks, signs and white space a blank, A-Z a-z.
_BYTES = np.arange(256, dtype=np.uint8)
_BYTES[:128] = [c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(128)]
TERM = r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"


def terms_of(text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct terms of a block of texts, the code of each term in order, and where texts begin and end."""
    filled = text.fill_null("")
    plain = pa.concat_arrays([filled]) if filled.offset else filled
    _, offsets, data = plain.buffers()
    bounds = np.frombuffer(offsets, np.int32)[plain.offset : plain.offset + len(plain) + 1]
    raw = np.frombuffer(data or b"", np.uint8)[bounds[0] : bounds[-1]]
    mapped = pa.StringArray.from_buffers(len(plain), pa.py_buffer(bounds - bounds[0]), pa.py_buffer(_BYTES[raw]))
    cut = pc.ascii_split_whitespace(mapped)
    ends = cut.offsets.to_numpy().astype(np.int64)
    flat = cut.values.slice(ends[0], ends[-1] - ends[0])
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    coded = flat.filter(pa.array(full)).dictionary_encode()
    places = np.concatenate(([0], np.cumsum(full)))[ends - ends[0]]
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), places


def query_terms(items: DataFrame) -> DataFrame:
    """item_id, term of the distinct terms of each item."""
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.explode(F.regexp_extract_all(lowered, F.lit(TERM), 1)).alias("term")
    return items.where("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), found).distinct()


def postings(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """A row for each block of documents: ids (0 where ``sizes`` is negative: no id), numbers of terms, and by term its documents and times."""
    spread = docs.sparkSession.sparkContext.broadcast(pa.array(vocabulary, pa.string()))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = spread.value
        for block in text_slices(batches, BLOCK_BYTES):
            distinct, codes, bounds = terms_of(block.column(1))
            size = np.diff(bounds)
            term = pc.fill_null(pc.index_in(distinct, known), -1).to_numpy(zero_copy_only=False).astype(np.int64)[codes]
            doc = np.repeat(np.arange(len(size)), size)
            wanted = term >= 0
            pairs, times = np.unique(term[wanted] * len(size) + doc[wanted], return_counts=True)
            own, counts = np.unique(pairs // max(1, len(size)), return_counts=True)
            ids = block.column(0)
            named = ids.is_valid().to_numpy(zero_copy_only=False)
            columns = (
                ids.fill_null(0).to_numpy().astype("<i8").tobytes(),
                np.where(named, size, -size - 1).astype("<i8").tobytes(),
                own.tolist(),
                counts.tolist(),
                (pairs % max(1, len(size))).astype("<i4").tobytes(),
                times.astype("<i4").tobytes(),
            )
            kinds = (pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary(), pa.binary())
            yield pa.record_batch([pa.array([c], k) for c, k in zip(columns, kinds)], names=["doc_ids", "sizes", "terms", "counts", "docs", "times"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return settled(rows.mapInArrow(index, POSTINGS), "postings")


def _sizes(data: bytes) -> np.ndarray:
    stored = np.frombuffer(data, "<i8")
    return np.where(stored < 0, -stored - 1, stored)


def totals(index: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all their terms with repeats."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [_sizes(x) for x in batch.column(0).to_pylist()]
            n, terms = ([int(f(s)) for s in sizes] for f in (np.count_nonzero, np.sum))
            yield pa.record_batch([pa.array(n, pa.int64()), pa.array(terms, pa.int64())], names=["n", "terms"])

    row = index.select("sizes").mapInArrow(count, "n long, terms long").agg(F.sum("n"), F.sum("terms")).first()
    return row[0] or 0, row[1] or 0


@dataclass
class Postings:
    """Documents of a block, ascending, what each adds, and the most that one adds; ``at`` is the place reached."""

    docs: np.ndarray
    scores: np.ndarray
    bound: int
    at: int = 0

    def skipped_to(self, doc: int) -> int:
        """What ``doc`` gets; places before it are passed for good."""
        self.at += int(self.docs[self.at :].searchsorted(doc))
        return int(self.scores[self.at]) if self.at < len(self.docs) and self.docs[self.at] == doc else 0


def accumulated(lists: list[Postings]) -> Postings:
    """The sums of several lists, term at a time, as one list."""
    docs, place = np.unique(np.concatenate([x.docs for x in lists]), return_inverse=True)
    sums = np.zeros(len(docs), np.int64)
    begin = 0
    for x in lists:  # a document stands once in a list
        sums[place[begin : begin + len(x.docs)]] += x.scores
        begin += len(x.docs)
    return Postings(docs, sums, int(sums.max()))


def best_of_block(short: list[Postings], long: list[Postings], best: list[tuple[int, int]], ids: list[int], top: int) -> None:
    """Takes the block's documents into the heap ``best`` of (score, -doc_id).

    Rows of a block stand by ascending doc_id. Until the heap is full the least score wanted is 1.
    """
    iterators = ([accumulated(short)] if short else []) + long
    iterators.sort(key=lambda x: x.bound)
    below = [0]  # bounds of the weaker iterators together
    for x in iterators:
        below.append(below[-1] + x.bound)
    seeds = set()

    def offered(doc: int, score: int) -> None:
        entry = (score, -ids[doc])
        if len(best) < top:
            heapq.heappush(best, entry)
        elif entry > best[0]:
            heapq.heapreplace(best, entry)

    if short:
        # The largest accumulators are judged first, so that few of the others matter.
        first = next(x for x in iterators if not any(x is y for y in long))
        for place in np.argsort(-first.scores, kind="stable")[:top].tolist():
            doc = int(first.docs[place])
            seeds.add(doc)
            parts = [(x, int(np.searchsorted(x.docs, doc))) for x in long]
            offered(doc, int(first.scores[place]) + sum(int(x.scores[i]) for x, i in parts if i < len(x.docs) and x.docs[i] == doc))

    def wanted() -> int:
        return best[0][0] if len(best) == top else 1

    need = wanted()
    essential = next((i for i in range(len(iterators)) if below[i + 1] >= need), len(iterators))
    while essential < len(iterators):
        proposing = iterators[essential:]
        if len(proposing) == 1:
            # One iterator proposes: its documents that are too weak even with all others are passed at once.
            x = proposing[0]
            rest = x.scores[x.at :] + below[essential] >= need
            x.at += int(np.argmax(rest)) if rest.any() else len(rest)
        heads = [int(x.docs[x.at]) for x in proposing if x.at < len(x.docs)]
        if not heads:
            return
        doc = min(heads)
        score = 0
        for x in proposing:
            if x.at < len(x.docs) and x.docs[x.at] == doc:
                score += int(x.scores[x.at])
                x.at += 1
        if doc in seeds:
            continue
        for i in range(essential - 1, -1, -1):
            if score + below[i + 1] < need:
                break
            score += iterators[i].skipped_to(doc)
        else:
            if score >= need:
                offered(doc, score)
                need = wanted()
                while essential < len(iterators) and below[essential + 1] < need:
                    essential += 1


def _searcher(queries: list[tuple[int, list[int]]], weights: np.ndarray, documents: int, terms: int, top: int, short_share: int):
    """For mapInArrow over rows of postings: the best of a task's documents for each query."""

    def lists(row: dict) -> tuple[list[int], dict[int, tuple[np.ndarray, np.ndarray]], int]:
        ids, stored = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["sizes"], "<i8")
        size = _sizes(row["sizes"])
        order = np.argsort(ids, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        m = 100 - LENGTH_SHARE + LENGTH_SHARE * size * documents // max(1, terms)
        docs, times = np.frombuffer(row["docs"], "<i4"), np.frombuffer(row["times"], "<i4").astype(np.int64)
        share = SCALE * times // (1000 * times + SATURATION * m[docs])
        named = stored[docs] >= 0
        found, begin = {}, 0
        for term, count in zip(row["terms"], row["counts"]):
            own = slice(begin, begin + count)
            begin += count
            at = place[docs[own]][named[own]]
            ascending = np.argsort(at)
            found[term] = at[ascending], weights[term] * share[own][named[own]][ascending]
        return ids[order].tolist(), found, len(ids)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[int, int]]] = {item: [] for item, _ in queries}
        for batch in batches:
            for i in range(batch.num_rows):
                ids, found, count = lists({name: batch.column(name)[i].as_py() for name in batch.schema.names})
                bounds = {term: int(scores.max()) for term, (_, scores) in found.items() if len(scores)}
                for item, own in queries:
                    held = [Postings(*found[t], bounds[t]) for t in own if bounds.get(t)]
                    short = [x for x in held if short_share * len(x.docs) < count]
                    long = [x for x in held if short_share * len(x.docs) >= count]
                    if held:
                        best_of_block(short, long, best[item], ids, top)
        rows = [(item, -doc, score) for item, heap in best.items() for score, doc in heap if score > 0]
        yield pa.record_batch([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["item_id", "doc_id", "score"])

    return search


def _ranked(docs: DataFrame, pairs: DataFrame, top: int, short_share: int) -> DataFrame:
    """item_id, doc_id, score of the best documents of each task, for the queries of (item_id, term)."""
    spark = docs.sparkSession
    vocabulary = sorted(r.term for r in pairs.select("term").distinct().toLocalIterator())
    number = {term: i for i, term in enumerate(vocabulary)}
    queries: dict[int, list[int]] = {}
    for row in pairs.toLocalIterator():
        queries.setdefault(row.item_id, []).append(number[row.term])
    index = postings(docs, vocabulary)
    documents, terms = totals(index)
    held = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("x.terms").agg(F.sum("x.counts").alias("df"))
    df = np.zeros(len(vocabulary), np.int64)
    for row in held.toLocalIterator():
        df[row.terms] = row.df
    weights = np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64)
    search = spark.sparkContext.broadcast((sorted(queries.items()), weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _searcher(*search.value, documents, terms, top, short_share)(batches)

    return index.mapInArrow(run, "item_id long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, top: int = 10, short_share: int = SHORT) -> DataFrame:
    """item_id, rank, doc_id, score of the ``top`` documents (doc_id, text) of each item (item_id, text)."""
    pairs = settled(query_terms(items), "query-terms")
    parts = max(1, -(-pairs.count() // PART_TERMS))
    part = F.pmod(F.xxhash64("item_id"), F.lit(parts))
    found = reduce(DataFrame.unionByName, [_ranked(docs, pairs.where(part == i), top, short_share) for i in range(parts)])
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
