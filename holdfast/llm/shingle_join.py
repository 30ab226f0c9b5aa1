"""N-gram Jaccard join by a blocked product of document by n-gram incidence.

Documents with equal shingle sets are one class. With sets ordered alike, two sets of
Jaccard similarity t or more share k of the first |x| - ceil(t |x|) + k shingles of each, so
only these rows of the incidence matrix enter the product (k is ``SHARED``, or less for
tiny sets). Shingles of rare words stand first in the order, and ones that several texts of
a block have, more of them than their words explain, stand last. This keeps both common
words that meet by chance and common lines out of the rows, in a corpus of any size; the
lists of words and shingles are bounded and affect cost alone.

The product runs column by column: columns of at most ``BLOCK`` documents give all their
pairs, larger ones pair every document with the column's most typical one. Overlap counts
of a pair are summed over the columns, and the pair is discarded when they, the places of
the shingles or the parities of the sets bound its similarity below t. Full sets, made of
the texts of these pairs alone, decide on the rest. Documents of one large column that are not yet connected are then paired block by block, each pair at
its first common column, except within one component, where further links can't change
the result.

Defined results: a null text, or one without words, has no shingles and no links; equal
rows and equal sets are one class; a row without doc_id keeps its count and has no
component; other columns are not read; an empty table gives no rows. Shingles are compared
by 64-bit hashes of 64-bit word hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm.components import components
from holdfast.llm.tables import settled, sifted, text_slices
from holdfast.llm.words import word_codes

BLOCK_BYTES = 4 << 20
BLOCK = 64
SHARED = 3
FREQUENT = 1 << 18
# A word that a block has less often counts as rare; so many times what chance gives make a shingle common.
WORD_LEAST = 8
EXCESS = 4

Weigh = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Rule:
    """Shingles of so many words; similar from so many percent on."""

    words: int = 3
    percent: int = 90

    def holds(self, shared: Column) -> Column:
        """100 * intersection >= percent * union of a and b, for an intersection (or a bound of it) of ``shared``."""
        return 100 * shared >= self.percent * (F.col("a.n") + F.col("b.n") - shared)

    def least_shared(self, sizes: np.ndarray) -> np.ndarray:
        """ceil(percent * size / 100): no similar set shares less."""
        return -(-sizes * self.percent // 100)


def shingle_sets(text: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingles of all texts, one text after another, and the number of each text's."""
    return weighed_sets(text, size, lambda _, counts: np.zeros(len(counts)))[:2]


def weighed_sets(text: pa.Array, size: int, weigh: Weigh) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``shingle_sets``, and the weight of each shingle: the sum of its words'.

    ``weigh`` gets hashes and counts of the distinct words.
    """
    words, codes, bounds = word_codes(pc.ascii_lower(text.fill_null("")))
    empty = words.index("") if "" in words else -1
    if empty >= 0:  # from white space around a text
        keep = codes != empty
        bounds = np.concatenate(([0], np.cumsum(keep)))[bounds]
        codes = codes[keep]
    of_words = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    hashes = of_words[codes]
    total = np.concatenate(([0], np.cumsum(weigh(of_words, np.bincount(codes, minlength=len(words)))[codes])))
    count = np.diff(bounds)
    owner = np.repeat(np.arange(len(count)), count)
    rolled = hashes.copy()
    for step in range(1, size):
        ahead = hashes[step:]
        rolled[: len(ahead)] = _mix(rolled[: len(ahead)]) + ahead
    rolled = _mix(rolled)
    inside = np.arange(len(codes)) <= np.repeat(bounds[1:] - size, count)
    shingles, owner = rolled[inside], owner[inside]
    weights = (total[size:] - total[:-size])[inside[: max(0, len(total) - size)]]
    short = np.flatnonzero((count > 0) & (count < size))
    whole = np.fromiter((xxhash.xxh3_64_intdigest(hashes[bounds[i] : bounds[i + 1]].tobytes()) for i in short), np.uint64, len(short))
    shingles, owner = np.concatenate((shingles, whole)), np.concatenate((owner, short))
    weights = np.concatenate((weights, total[bounds[short + 1]] - total[bounds[short]]))
    order = np.lexsort((shingles, owner))
    shingles, owner, weights = shingles[order], owner[order], weights[order]
    new = np.ones(len(owner), bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])
    return shingles[new], np.bincount(owner[new], minlength=len(count)), weights[new]


def parities(shingles: np.ndarray, owner: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Longs of each text: of groups of shingles, whether it has an odd number.

    Two sets differ in at least as many shingles as their parities in bits. A text has 256
    groups, or the least power of two from half its shingles on.
    """
    wide = 1 << np.ceil(np.log2(np.maximum(counts, 512) / 2)).astype(np.int64)
    starts = np.cumsum(wide) - wide
    group = (shingles & (wide[owner] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(starts[owner] + group, minlength=int(wide.sum())) & 1
    return _lists(np.packbits(odd.astype(bool)).view(np.int64), wide // 64)


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))


@dataclass(frozen=True)
class Order:
    """The order of shingles: ``common`` ones last, by the ``levels`` of their ``words`` before that. Sorted hashes."""

    common: np.ndarray
    words: np.ndarray
    levels: np.ndarray

    def level(self, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, self.levels[at], 0)

    def is_common(self, shingles: np.ndarray) -> np.ndarray:
        if not len(self.common):
            return np.zeros(len(shingles), bool)
        return self.common[np.minimum(np.searchsorted(self.common, shingles), len(self.common) - 1)] == shingles


def global_order(docs: DataFrame, rule: Rule) -> Order:
    """Frequent words and shingles, about ``FREQUENT`` of each at most, counted in blocks.

    A shingle of a block stands in several of its texts. Words that come one after another by
    chance give such shingles, too, and the more the larger the corpus is; the levels of the
    words put these behind others, so only those that stand there more often are listed.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_slices(batches, BLOCK_BYTES):
            found = []

            def share(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
                found.extend((words, counts))
                return np.log(np.maximum(counts, 1) / max(1, counts.sum()))

            shingles, _, weights = weighed_sets(block.column(0), rule.words, share)
            distinct, first, n = np.unique(shingles, return_index=True, return_counts=True)
            words, counts = found
            by_chance = np.exp(weights[first]) * counts.sum()
            many, often = (n > 1) & (n > EXCESS * by_chance), counts >= WORD_LEAST
            listed = by_chance[many]
            # A block without words counts, too. The chance is of the texts that a block's count of two or more has.
            kinds = np.repeat(np.array([0, 1, 2], np.int8), (many.sum(), often.sum(), 1))
            codes = np.concatenate((distinct[many], words[often], np.zeros(1, np.uint64))).view(np.int64)
            counted = np.concatenate((n[many], counts[often], [1])).astype(np.int64)
            chance = np.concatenate((listed * -np.expm1(-listed), np.zeros(often.sum() + 1)))
            yield pa.record_batch([pa.array(kinds), pa.array(codes), pa.array(counted), pa.array(chance)], names=["kind", "code", "n", "chance"])

    rows = docs.select("text").mapInArrow(count, "kind byte, code long, n long, chance double")
    summed = rows.groupBy("kind", "code").agg(F.sum("n").alias("n"), F.avg("chance").alias("chance"))
    counted = settled(summed, "frequent")
    blocks = (counted.where("kind = 2").agg(F.sum("n")).first()[0]) or 0

    def top(kept: DataFrame) -> pa.Table:
        share = max(0.0, 1 - FREQUENT / max(1, kept.count()))
        [least] = kept.agg(F.percentile_approx("n", share, 10_000)).first()
        return kept.where(F.col("n") > (least or 0) if share else F.lit(True)).select("code", "n").toArrow()

    common = top(counted.where("kind = 0").where(F.col("n") > EXCESS * blocks * F.col("chance")))
    words = top(counted.where("kind = 1"))
    hashes, n = words["code"].to_numpy().view(np.uint64), words["n"].to_numpy()
    levels = 1 + np.round(4 * np.log2(n / WORD_LEAST)).astype(np.int64)
    by_hash = np.argsort(hashes)
    return Order(np.sort(common["code"].to_numpy().view(np.uint64)), hashes[by_hash], levels[by_hash])


def profiles(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, n, key (of the set), typical (its share of frequent shingles), prefix (the rows that enter the product)."""
    order = docs.sparkSession.sparkContext.broadcast(global_order(docs, rule))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_slices(batches, BLOCK_BYTES):
            shingles, counts, weights = weighed_sets(block.column(1), rule.words, order.value.level)
            ends = np.cumsum(counts)
            data, starts = memoryview(shingles.view(np.uint8)), ends - counts
            keys = [xxhash.xxh3_128_digest(data[8 * s : 8 * e]) for s, e in zip(starts, ends)]
            owner = np.repeat(np.arange(len(counts)), counts)
            is_common = order.value.is_common(shingles)
            ordered = shingles[np.lexsort((weights, is_common, owner))]
            least = rule.least_shared(counts)
            size = counts - least + np.minimum(least, SHARED)
            prefix = ordered[np.arange(len(ordered)) - np.repeat(starts, counts) < np.repeat(size, counts)]
            typical = np.bincount(owner, weights=is_common, minlength=len(counts)) / np.maximum(counts, 1)
            yield pa.record_batch(
                [
                    block.column(0),
                    pa.array(counts),
                    pa.array(keys, pa.binary()),
                    pa.array(typical),
                    _lists(prefix, size),
                    parities(shingles, owner, counts),
                ],
                names=["doc_id", "n", "key", "typical", "prefix", "bits"],
            )

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return settled(chosen.mapInArrow(run, "doc_id long, n long, key binary, typical double, prefix array<long>, bits array<long>"), "profiles")


def full_sets(docs: DataFrame, rule: Rule) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_slices(batches, BLOCK_BYTES):
            yield pa.record_batch([block.column(0), _lists(*shingle_sets(block.column(1), rule.words))], names=["id", "shingles"])

    return docs.mapInArrow(run, "id long, shingles array<long>")


def overlaps(pairs: DataFrame, rule: Rule, crowded: DataFrame | None = None) -> DataFrame:
    """Sums the columns' pairs (a, b: structs of id, n, place); those that may be similar, once each.

    ``crowded`` has the ids of documents in large columns. Two of these may share more than
    was summed here, so of them, and without ``crowded`` of all, only the places decide.
    """
    forward = F.col("a.id") < F.col("b.id")
    low, high = F.when(forward, F.col("a")).otherwise(F.col("b")), F.when(forward, F.col("b")).otherwise(F.col("a"))
    sized = pairs.where(F.col("a.id") != F.col("b.id")).where(rule.holds(F.least("a.n", "b.n")))
    summed = (
        sized.select(low.alias("a"), high.alias("b"))
        .groupBy("a.id", "a.n", F.col("b.id").alias("b_id"), F.col("b.n").alias("b_n"))
        .agg(F.count("*").alias("shared"), F.max("a.place").alias("a_place"), F.max("b.place").alias("b_place"))
        .select(
            F.struct("id", "n", F.col("a_place").alias("place")).alias("a"),
            F.struct(F.col("b_id").alias("id"), F.col("b_n").alias("n"), F.col("b_place").alias("place")).alias("b"),
            "shared",
        )
    )
    # Behind the last shared places, at most the shorter rest can be shared as well.
    rest = F.least(F.col("a.n") - F.col("a.place"), F.col("b.n") - F.col("b.place")) - 1
    by_place = rule.holds(F.least("a.place", "b.place") + 1 + rest)
    if crowded is None:
        return summed.where(by_place).select("a", "b")
    least = F.least(F.lit(SHARED), F.ceil(rule.percent * F.least("a.n", "b.n") / 100))
    by_count = (F.col("shared") >= least) & rule.holds(F.col("shared") + rest)
    both = summed.where(by_place)
    for side in ("a", "b"):
        both = both.join(crowded.select(F.col("id").alias(f"{side}_crowded")), F.col(f"{side}.id") == F.col(f"{side}_crowded"), "left")
    return both.where(by_count | (F.col("a_crowded").isNotNull() & F.col("b_crowded").isNotNull())).select("a", "b")


def possible_pairs(pairs: DataFrame, profile: DataFrame, rule: Rule) -> DataFrame:
    """The pairs whose parities allow them to be similar enough, before their texts are moved."""
    ids = settled(pairs.select("a.id").union(pairs.select("b.id")).distinct(), "pair-ids")
    met = sifted(profile.select("doc_id", F.col("n").alias("size"), "bits"), "doc_id", ids, "may_be").where("may_be")
    sides = [met.select(F.col("doc_id").alias(f"{x}_id"), F.struct("size", "bits").alias(x)) for x in ("x", "y")]
    both = pairs.join(sides[0], F.col("a.id") == F.col("x_id")).join(sides[1], F.col("b.id") == F.col("y_id"))
    most = F.floor((F.col("x.size") + F.col("y.size") - differing(F.col("x.bits"), F.col("y.bits"))) / 2)
    return both.where(rule.holds(most)).select("a", "b").distinct()


def linked(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    of_a = sets.select(F.col("id").alias("a_id"), F.col("shingles").alias("a_set"))
    of_b = sets.select(F.col("id").alias("b_id"), F.col("shingles").alias("b_set"))
    both = pairs.join(of_a, F.col("a.id") == F.col("a_id")).join(of_b, F.col("b.id") == F.col("b_id"))
    shared = F.size(F.array_intersect("a_set", "b_set")).cast("long")
    return both.where(rule.holds(shared)).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def differing(x: Column, y: Column) -> Column:
    """In how many parities two sets differ, at most as many as in shingles; more groups are folded to fewer."""
    wide = F.least(F.size(x), F.size(y))

    def fold(bits: Column, at: Column) -> Column:
        return F.aggregate(F.sequence(at, F.size(bits) - 1, wide), F.lit(0).cast("long"), lambda odd, i: odd.bitwiseXOR(bits[i]))

    return F.aggregate(
        F.sequence(F.lit(0), wide - 1), F.lit(0), lambda n, at: n + F.bit_count(fold(x, at).bitwiseXOR(fold(y, at))).cast("int")
    )


def column_pairs(members: DataFrame) -> DataFrame:
    """All pairs inside columns of at most ``BLOCK`` members."""
    listed = members.groupBy("shingle").agg(F.collect_list("doc").alias("docs"))
    ahead = listed.select("docs", F.posexplode("docs").alias("at", "a"))
    return ahead.select("a", F.explode(F.slice("docs", F.col("at") + 2, BLOCK)).alias("b"))


def block_pairs(members: DataFrame, labels: DataFrame, bits: DataFrame, rule: Rule) -> DataFrame:
    """Pairs of members of a large column that lie in different components, block by block.

    Pairs that share a small column are decided by then. Any other similar pair shares none
    but large columns, and is made at the first of them: nothing before it is shared, so what
    is left behind bounds its overlap, and a member with too little left stays out. A
    component with ``BLOCK`` members or more has blocks of its own, which never meet. Before a
    pair leaves its blocks, sizes, places and parities bound what it can share.
    """
    size, place = F.col("doc.n").cast("long"), F.col("doc.place")
    named = (
        members.where(100 * (size - place) >= rule.percent * size)
        .join(labels, F.col("doc.id") == labels["id"], "left")
        .select("shingle", "doc", F.coalesce("component", "doc.id").alias("component"))
        .join(bits, F.col("doc.id") == F.col("bits_id"))
        .drop("bits_id")
    )
    alike = named.groupBy("shingle", "component").agg(F.count("*").alias("alike"))
    own = F.when(F.col("alike") >= BLOCK, F.col("component"))
    parts = alike.withColumn("own", own).withColumn("loose", F.when(F.col("own").isNull(), F.col("alike")).otherwise(0))
    columns = parts.groupBy("shingle").agg(F.count("*").alias("kinds"), F.sum("loose").alias("all_loose")).where("kinds > 1")
    placed = parts.join(columns.select("shingle", "all_loose"), "shingle").select(
        "shingle", "component", "own", F.when(F.col("own").isNull(), F.col("all_loose")).otherwise(F.col("alike")).alias("sharing")
    )
    salted = settled(named.join(placed, ["shingle", "component"]), "mixed-columns").withColumn(
        "block", F.pmod(F.xxhash64("doc.id"), F.ceil(F.col("sharing") / BLOCK)).cast("int")
    )
    blocks = settled(
        salted.groupBy("shingle", "own", "block").agg(F.collect_list(F.struct("doc", "component", "bits")).alias("docs")), "column-blocks"
    )
    others = blocks.select("shingle", F.col("own").alias("other_own"), F.struct("own", "block").alias("other"), F.col("docs").alias("others"))
    apart = F.col("own").isNull() | F.col("other_own").isNull() | (F.col("own") != F.col("other_own"))
    one = blocks.join(others, "shingle").where(apart & (F.struct("own", "block") <= F.col("other"))).select(F.explode("docs").alias("x"), "others")

    def possible(y: Column) -> Column:
        x = F.col("x")
        n, m = x["doc"]["n"].cast("long"), y["doc"]["n"].cast("long")
        most = F.least(n - x["doc"]["place"], m - y["doc"]["place"])
        return (
            (x["component"] != y["component"])
            & (100 * most >= rule.percent * (n + m - most))
            & ((100 - rule.percent) * (n + m) >= (100 + rule.percent) * differing(x["bits"], y["bits"]))
        )

    two = one.select("x", F.explode(F.filter("others", possible)).alias("y"))
    return two.select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b"))


def first_of_classes(profile: DataFrame) -> DataFrame:
    """doc_id, n, typical, prefix of the smallest id of each key.

    Rows whose key surely stands once are told by a broadcast set and stay where they lie.
    """
    own = F.xxhash64("key").alias("own")
    repeated = settled(profile.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1").select(own), "repeated-keys")
    apart = sifted(profile.select("doc_id", "n", "typical", "prefix", "key", own), "own", repeated, "may_be")
    met = apart.where("may_be").groupBy("key").agg(F.min_by(F.struct("doc_id", "n", "typical", "prefix"), "doc_id").alias("first"))
    return apart.where("NOT may_be").select("doc_id", "n", "typical", "prefix").union(met.select("first.*"))


def joined(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable by links) of every row."""
    profile = profiles(docs, rule)
    with_set = profile.where("doc_id IS NOT NULL AND n > 0")
    by_key = with_set.groupBy("key")
    # A row of the product is three longs and a byte; most rows of one text alone are left out where they lie.
    of_doc = F.shiftleft("n", 32).alias("n_high"), F.round(100 * F.col("typical")).cast("byte").alias("typical")
    rows = first_of_classes(with_set).select("doc_id", *of_doc, F.posexplode("prefix").alias("place", "shingle"))
    columns = settled(rows.groupBy("shingle").agg(F.count("*").alias("members")).where("members > 1"), "columns")
    members = sifted(
        rows.select("shingle", "doc_id", F.col("n_high").bitwiseOR(F.col("place")).alias("n_place"), "typical"),
        "shingle", columns.select("shingle"), "may_be",
    ).where("may_be").drop("may_be")
    doc = F.struct(
        F.col("doc_id").alias("id"),
        F.shiftright("n_place", 32).cast("int").alias("n"),
        F.col("n_place").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("place"),
    )
    shared = settled(members.join(columns, "shingle").select("shingle", "typical", doc.alias("doc"), "members"), "shared-columns")
    large = shared.where(F.col("members") > BLOCK)
    centres = large.groupBy("shingle").agg(F.max_by("doc", F.struct("typical", -F.col("doc.id"))).alias("b"))
    first = large.join(centres, "shingle").select(F.col("doc").alias("a"), "b")
    small = column_pairs(shared.where(F.col("members") <= BLOCK))
    crowded = settled(large.select("doc.id").distinct(), "crowded")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")

    def decided(candidates: DataFrame) -> DataFrame:
        """Links among the pairs; only texts of pairs that may be similar are moved."""
        pairs = settled(possible_pairs(candidates, with_set, rule), "pairs")
        wanted = pairs.select("a.id").union(pairs.select("b.id")).distinct()
        met = sifted(texts, "id", wanted, "may_be").where("may_be").drop("may_be").join(wanted.hint("merge"), "id", "left_semi")
        return settled(linked(pairs, settled(full_sets(met, rule), "sets"), rule), "links")

    links = decided(settled(overlaps(small.union(first), rule, crowded), "candidates"))
    labels = components(links)
    if not crowded.isEmpty():
        met = sifted(with_set.select("key", "doc_id", "bits"), "doc_id", crowded, "may_be").where("may_be")
        bits = met.groupBy("key").agg(F.min_by(F.struct(F.col("doc_id").alias("bits_id"), "bits"), "doc_id").alias("first")).select("first.*")
        later = settled(overlaps(block_pairs(large.select("shingle", "doc"), labels, bits, rule), rule), "later-pairs")
        if not later.isEmpty():
            links = links.union(decided(later))
            labels = components(links)
    of_class = by_key.agg(F.min("doc_id").alias("_first"))
    named = of_class.join(labels, F.col("_first") == F.col("id"), "left").select(
        F.col("key").alias("_key"), F.coalesce("component", "_first").alias("_component")
    )
    return profile.join(named, F.col("key") == F.col("_key"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id")).alias("component_id")
    )
