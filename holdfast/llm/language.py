"""Language identification with interpolated Kneser-Ney character models.

Every language has a model of character four-grams inside lower-cased words (letters only,
a zero before and after a word). Four characters of 16 bits make one 64-bit key. Counts
are gathered from all learning texts by Spark; the lower orders count the distinct
characters that precede an n-gram. No n-gram is left out: texts are written once in blocks as
they are read, each block one compressed value in a bucket by its number, so that no text is shuffled, and
the distinct four-grams of the blocks meet the counted ones by their middle two
characters, which all shares and weights of orders four and three have in common. Counts of
two characters are joined before that; what all tasks get is by single characters only.
A text gets the language of
the lowest cross-entropy by character. Its score is the softmax of the languages' mean log
probabilities over ``SPAN`` characters, lowered when the cross-entropy is above the
language's calibrated limit; a text below ``REJECT`` is rejected. The limit is the exact
quantile of the cross-entropies of all learning texts that get their own language. Texts
that learn and are identified are compared with the models once (``self_identified``).

Defined results: a null text, or one without a letter, is ``und`` with score 0 and
rejected; equal cross-entropies go to the language first by name; with no learning text
everything is ``und``; repeated rows are scored each; other columns pass
through, and one that is named like a result gives way to it.
Characters outside the first plane share the code of their low 16 bits. Names that begin
with ``_llm_`` are reserved.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm.tables import block_ids, folded, partitions, settled, settled_blocks, text_slices, unfolded
from holdfast.llm.words import sums_by_text, word_codes
from holdfast.operators.ordered import running_totals

BLOCK_BYTES = 4 << 20
# Texts that ask the models together; larger blocks ask less often for the same n-grams.
ASKING_BYTES = 16 << 20
BLOCK, ASKING = "_llm_block", "_llm_asking"
OWN, SHARE = "_llm_own", "_llm_share"
RESULTS = ("lang_pred", "score", "cross_entropy")
BUCKET_GRAMS = 1 << 20
ORDER = 4
CALIBRATION_SHARE = 0.999
SPAN = 20
REJECT = 0.25
UNKNOWN = "und"
_LETTERS = regex.compile(r"\p{L}+")


def letter_runs(words: list[str]) -> tuple[list[str], np.ndarray]:
    """The lower-cased letter runs of all words, and the number of the word that each is in."""
    runs, owner = [], []
    for i, word in enumerate(words):
        if word.isalpha():
            runs.append(word.lower())
            owner.append(i)
        else:
            found = _LETTERS.findall(word)
            runs += [x.lower() for x in found]
            owner += [i] * len(found)
    return runs, np.asarray(owner, np.int64)


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all four-grams that end at a letter or at the end of a run; the word of each."""
    runs, owner = letter_runs(words)
    if not runs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    pad = "\0" * (ORDER - 1)
    line = np.frombuffer((pad + pad.join(runs) + pad).encode("utf-32-le", "replace"), "<u4") & 0xFFFF
    line = line.astype(np.uint64)
    lengths = np.fromiter(map(len, runs), np.int64, len(runs))
    keys = line[:-3] << np.uint64(48) | line[1:-2] << np.uint64(32) | line[2:-1] << np.uint64(16) | line[3:]
    # Of the windows, those that end inside a run or on the zero right behind it.
    starts = np.cumsum(lengths + 3) - (lengths + 3)
    at = np.arange(int((lengths + 1).sum())) + np.repeat(starts - (np.cumsum(lengths + 1) - lengths - 1), lengths + 1)
    return keys[at], np.repeat(owner, lengths + 1)


def gram_counts(learning: DataFrame) -> DataFrame:
    """lang, gram, n over all rows of (text, lang)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_slices(batches, BLOCK_BYTES):
            words, codes, bounds = word_codes(block.column(0))
            langs = block.column(1).dictionary_encode()
            names = langs.dictionary.to_pylist()
            lang = np.repeat(langs.indices.to_numpy(zero_copy_only=False), np.diff(bounds))
            keys, owner = grams(words)
            distinct, place = np.unique(keys, return_inverse=True)
            for i, name in enumerate(names):
                times = np.bincount(codes[lang == i], minlength=len(words))
                n = np.bincount(place, weights=times[owner], minlength=len(distinct)).astype(np.int64)
                seen = n > 0
                yield pa.record_batch(
                    [pa.array([name] * int(seen.sum()), pa.string()), pa.array(distinct[seen].view(np.int64)), pa.array(n[seen])],
                    names=["lang", "gram", "n"],
                )

    rows = learning.select("text", "lang").mapInArrow(count, "lang string, gram long, n long")
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Level:
    """N-grams of one order: discounted shares by key, and the weight left to the lower order by context."""

    keys: np.ndarray
    share: np.ndarray
    contexts: np.ndarray
    rest: np.ndarray


def look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), missing)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], missing)


def level(keys: np.ndarray, counts: np.ndarray, discount: float) -> Level:
    """Keys sorted, with all that share a context."""
    contexts, place = np.unique(keys >> np.uint64(16), return_inverse=True)
    total = np.bincount(place, weights=counts)
    kinds = np.bincount(place)
    return Level(keys, (counts - discount) / total[place], contexts, discount * kinds / total)


def lowered(level: Level, wanted: np.ndarray, size: int, lower: np.ndarray) -> np.ndarray:
    """Probabilities at an order from those of the order below."""
    own = wanted & last(size)
    return look_up(level.keys, level.share, own, 0.0) + look_up(level.contexts, level.rest, own >> np.uint64(16), 1.0) * lower


def last(size: int) -> np.uint64:
    """The mask of the last characters of a key."""
    return np.uint64((1 << 16 * size) - 1)


@dataclass
class Model:
    """What tasks hold of a language: discounts by order, the first order, and totals of the second by context."""

    discounts: dict[int, float]
    first: Level
    contexts: np.ndarray
    total: np.ndarray
    kinds: np.ndarray

    def probabilities(self, wanted: np.ndarray, pairs: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Of wanted four-grams, with the counts of their last two characters and the counted four-grams of like middle."""
        p = lowered(self.first, wanted, 1, np.full(len(wanted), 1 / (len(self.first.keys) + 1)))
        context = (wanted & last(2)) >> np.uint64(16)
        total = look_up(self.contexts, self.total, context, 1.0)
        rest = look_up(self.contexts, self.discounts[2] * self.kinds / self.total, context, 1.0)
        p = np.where(pairs > 0, (pairs - self.discounts[2]) / total, 0.0) + rest * p
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order].astype(float)
        shorter, before = np.unique(keys & last(3), return_counts=True)
        p = lowered(level(shorter, before.astype(float), self.discounts[3]), wanted, 3, p)
        return lowered(level(keys, counts, self.discounts[4]), wanted, 4, p)


@dataclass
class Identifier:
    """``grams`` holds lang, gram, n; ``pairs`` the counts of two characters (gram, n) by language in the order of ``names``."""

    names: list[str]
    models: list[Model]
    limits: np.ndarray
    grams: DataFrame | None = None
    pairs: DataFrame | None = None

    def probabilities(self, asked: DataFrame) -> DataFrame:
        """gram, p (by language) of the distinct four-grams of ``asked``."""
        names, models = self.names, self.models
        distinct = asked.agg(F.approx_count_distinct("gram")).first()[0] + self.grams.count()
        buckets = max(partitions(asked.sparkSession), -(-distinct // BUCKET_GRAMS))
        middle = F.shiftrightunsigned("gram", 16).bitwiseAND(F.lit((1 << 32) - 1))
        bucket = F.pmod(F.xxhash64(middle), F.lit(buckets)).cast("int").alias("bucket")
        pairs = self.pairs.select(F.col("gram").alias("_pair"), "n")
        wanted = asked.select("gram").distinct().withColumn("_pair", F.col("gram").bitwiseAND(F.lit((1 << 32) - 1)))
        wanted = wanted.join(pairs, "_pair", "left").select(bucket, "gram", "n")

        def answer(wanted: pa.Table, counted: pa.Table) -> pa.Table:
            keys = wanted["gram"].to_numpy().view(np.uint64)
            known = wanted["n"].is_valid().to_numpy()
            n = np.zeros((len(keys), len(names)))
            n[known] = wanted["n"].combine_chunks().flatten().to_numpy().reshape(-1, len(names))
            lang = pc.index_in(counted["lang"], pa.array(names, pa.string())).to_numpy()
            grams, times = counted["gram"].to_numpy().view(np.uint64), counted["n"].to_numpy()
            p = np.empty((len(keys), len(names)))
            for i, model in enumerate(models):
                p[:, i] = model.probabilities(keys, n[:, i], grams[lang == i], times[lang == i])
            offsets = pa.array(np.arange(0, p.size + 1, len(names)), pa.int32())
            return pa.table({"gram": wanted["gram"], "p": pa.ListArray.from_arrays(offsets, pa.array(p.ravel()))})

        counted = self.grams.select(bucket, "lang", "gram", "n")
        return wanted.groupBy("bucket").cogroup(counted.groupBy("bucket")).applyInArrow(answer, "gram long, p array<double>")

    def entropies(self, text: pa.Array, asked: np.ndarray, log_p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each text and language the cross-entropy by character; the number of characters. ``asked`` is sorted."""
        words, codes, bounds = word_codes(text)
        keys, owner = grams(words)
        distinct, place = np.unique(keys, return_inverse=True)
        by_word = np.empty((len(words), len(self.names) + 1))
        by_word[:, -1] = np.bincount(owner, minlength=len(words))
        at = np.searchsorted(asked, distinct)
        for i in range(len(self.names)):
            by_word[:, i] = np.bincount(owner, weights=log_p[at, i][place], minlength=len(words))
        sums = np.stack([sums_by_text(by_word[codes, i], bounds) for i in range(by_word.shape[1])], axis=1)
        count = np.round(sums[:, -1])
        return -sums[:, :-1] / np.maximum(count, 1)[:, None], count

    def identify(self, text: pa.Array, asked: np.ndarray, log_p: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Language, its share in the softmax and the cross-entropy."""
        if not self.names:
            return pa.array([UNKNOWN] * len(text)), np.zeros(len(text)), np.zeros(len(text))
        entropy, count = self.entropies(text, asked, log_p)
        best = np.argmin(entropy, axis=1)
        lowest = entropy[np.arange(len(best)), best]
        share = 1 / np.exp(-SPAN * (entropy - lowest[:, None])).sum(axis=1)
        known = count > 0
        names = np.where(known, np.array(self.names, dtype=object)[best], UNKNOWN)
        return pa.array(names.tolist(), pa.string()), np.where(known, share, 0.0), np.where(known, lowest, 0.0)


def shorter(grams: DataFrame, size: int) -> DataFrame:
    """lang, gram, n of the last characters: how many different characters precede them."""
    own = F.col("gram").bitwiseAND(F.lit(int(last(size)))).alias("gram")
    return grams.groupBy("lang", own).agg(F.count("*").alias("n"))


def models_of(counts: DataFrame) -> Identifier:
    """The models of all languages of lang, gram, n."""
    four = settled(counts, "grams-4")
    three = settled(shorter(four, 3), "grams-3")
    two = settled(shorter(three, 2), "grams-2")
    # At most one row for each language and character.
    one = shorter(two, 1).toArrow().to_pandas()
    before = F.shiftrightunsigned("gram", 16).alias("context")
    contexts = two.groupBy("lang", before).agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).toArrow().to_pandas()
    sized = [own.select("lang", "n", F.lit(size).alias("size")) for size, own in ((4, four), (3, three), (2, two))]
    rare = sized[0].union(sized[1]).union(sized[2]).groupBy("lang", "size")
    seen = {(r.lang, r.size): (r.once, r.twice) for r in rare.agg(F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")).collect()}
    names = sorted(one["lang"].unique())

    def discount(once: int, twice: int) -> float:
        """One for all counts of an order, n1 / (n1 + 2 n2)."""
        return min(max(once / (once + 2 * twice), 0.1), 0.9) if once else 0.5

    models = []
    for name in names:
        own = one[one["lang"] == name].sort_values("gram")
        n = own["n"].to_numpy().astype(float)
        first = level(own["gram"].to_numpy().view(np.uint64), n, discount(int((n == 1).sum()), int((n == 2).sum())))
        held = contexts[contexts["lang"] == name].sort_values("context")
        total, kinds = (held[c].to_numpy().astype(float) for c in ("total", "kinds"))
        discounts = {size: discount(*seen[name, size]) for size in (2, 3, 4)}
        models.append(Model(discounts, first, held["context"].to_numpy().view(np.uint64), total, kinds))
    by_lang = two.groupBy("gram").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
    row = F.array(*[F.coalesce(F.col("by")[name], F.lit(0)).cast("double") for name in names]).alias("n")
    pairs = settled(by_lang.select("gram", row), "pairs") if names else None
    return Identifier(names, models, np.full(len(names), np.inf), four, pairs)


def learning_texts(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())


def limits(rows: DataFrame, names: list[str]) -> np.ndarray:
    """Of each language the cross-entropy that ``CALIBRATION_SHARE`` of all its texts in ``OWN`` do not exceed."""
    folded = rows.where(F.col("lang_pred") == F.col(OWN)).groupBy("lang_pred", "cross_entropy").agg(F.count("*").alias("n"))
    upto = running_totals(folded, ["lang_pred", "cross_entropy"], {"upto": "n"})
    # One row for each language.
    sums = upto.groupBy("lang_pred").agg(F.sum("n").alias("all"), F.min(F.col("upto") - F.col("n")).alias("before"))
    reached = F.col("upto") - F.col("before") >= F.ceil(F.col("all") * F.lit(CALIBRATION_SHARE))
    found = upto.join(F.broadcast(sums), "lang_pred").where(reached).groupBy("lang_pred").agg(F.min("cross_entropy"))
    by_name = dict(found.collect())
    return np.array([by_name.get(name, np.inf) for name in names])


def fit(learning: DataFrame) -> Identifier:
    """A model of each non-null ``lang`` of the learning rows (text, lang), with a limit from all of them."""
    learning = learning_texts(learning)
    found = models_of(gram_counts(learning))
    if found.names:
        rows = compared(learning.select("text", F.col("lang").alias(OWN)), found, [OWN])
        found.limits = limits(settled(rows, "calibration"), found.names)
    return found


def self_identified(docs: DataFrame, learning: Column, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs`` with lang_pred, score and cross_entropy by models of the rows of ``learning``.

    What ``identified`` gives with ``fit`` on these rows, but each text is compared once.
    """
    found = models_of(gram_counts(learning_texts(docs.where(learning))))
    kept = docs.drop(*RESULTS, *[name for name in docs.columns if name not in columns])
    if not found.names:
        return identified(kept, found)
    marked = docs.withColumn(OWN, F.when(learning & F.col("text").isNotNull(), F.col("lang")))
    rows = settled(compared(marked, found, [*kept.columns, OWN]), "compared")
    found.limits = limits(rows, found.names)
    return scored(rows, found).drop(OWN)


def blocked(docs: DataFrame) -> DataFrame:
    """Blocks of about ``ASKING_BYTES`` of text as read, each a compressed value beside its distinct n-grams."""

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = block_ids()
        for rows in text_slices(batches, ASKING_BYTES):
            found = [np.unique(grams(word_codes(part.column("text"))[0])[0]) for part in text_slices(iter([rows]), BLOCK_BYTES)]
            distinct = np.unique(np.concatenate(found)).view(np.int64)
            asked = pa.ListArray.from_arrays(pa.array([0, len(distinct)], pa.int32()), pa.array(distinct))
            yield pa.record_batch(
                [pa.array([next(numbers)], pa.int64()), pa.array([folded(rows)], pa.binary()), asked],
                names=[BLOCK, "rows", "grams"],
            )

    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(max(spark.sparkContext.defaultParallelism, -(-total // ASKING_BYTES)), partitions(spark))
    blocks = docs.mapInArrow(block, f"{BLOCK} long, rows binary, grams array<long>")
    return settled_blocks(blocks, "asking", BLOCK, buckets)


def identified(docs: DataFrame, identifier: Identifier) -> DataFrame:
    """``docs`` with lang_pred, score and cross_entropy."""
    docs = docs.drop(*RESULTS)
    if not identifier.names:
        return docs.select("*", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("cross_entropy"))
    return scored(compared(docs, identifier, docs.columns), identifier)


def scored(rows: DataFrame, identifier: Identifier) -> DataFrame:
    """The score: the share, lowered by what the cross-entropy is above the language's limit."""
    by_name = [part for pair in zip(identifier.names, identifier.limits.tolist()) for part in map(F.lit, pair)]
    left = F.coalesce(F.create_map(*by_name)[F.col("lang_pred")], F.lit(np.inf)) - F.col("cross_entropy")
    score = F.col(SHARE) * F.exp(F.least(F.lit(0.0), left))
    return rows.withColumn(SHARE, score).withColumnRenamed(SHARE, "score")


def compared(docs: DataFrame, identifier: Identifier, names: list[str]) -> DataFrame:
    """``names`` of ``docs`` with lang_pred, its share in the softmax and cross_entropy."""
    docs = docs.drop(*[name for name in docs.columns if name not in (*names, "text")])
    fields = "".join(f"`{name}` {kind}, " for name, kind in docs.dtypes if name in names)
    names = [name for name in docs.columns if name in names]
    table = blocked(docs)
    asked = table.select(F.col(BLOCK).alias(ASKING), F.explode("grams").alias("gram"))
    answers = asked.join(identifier.probabilities(asked), "gram")
    plain = Identifier(identifier.names, [], identifier.limits)

    def run(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        keys = answers["gram"].to_numpy().view(np.uint64)
        order = np.argsort(keys)
        p = np.concatenate([c.flatten().to_numpy() for c in answers["p"].chunks]) if len(keys) else np.zeros(0)
        log_p = np.log(p.reshape(len(keys), len(plain.names))[order])
        found = []
        for block in text_slices(iter([unfolded(rows["rows"][0])]), BLOCK_BYTES):
            lang, share, entropy = plain.identify(block.column("text"), keys[order], log_p)
            found.append(
                pa.record_batch(
                    [*(block.column(name) for name in names), lang, pa.array(share), pa.array(entropy)],
                    names=[*names, "lang_pred", SHARE, "cross_entropy"],
                )
            )
        return pa.Table.from_batches(found)

    return (
        table.select(BLOCK, "rows")
        .groupBy(BLOCK)
        .cogroup(answers.groupBy(ASKING))
        .applyInArrow(run, f"{fields}lang_pred string, {SHARE} double, cross_entropy double")
    )
